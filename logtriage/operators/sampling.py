"""Exact, reproducible sampling and splitting.

Order comes from ``md5(seed | key)`` rather than ``rand()``: the same seed gives the
same rows in Spark and in any SQL engine, and recomputation after an executor loss
yields identical results.

Positions are computed without a single-partition window: rows are bucketed by a hex
prefix of the hash (``16**prefix`` buckets per group), the bucket counts form a small
table that is cumulated and joined back (``groups * 16**prefix`` rows at most), and ``row_number`` runs inside each (group, bucket).  A class
holding a third of all rows is therefore spread over 65,536 tasks-worth of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

DEFAULT_SEED = 42
PREFIX_HEX = 4


def hash_key(keys, seed=DEFAULT_SEED, salt: str | None = None):
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt else []) + [F.col(k).cast('string') for k in keys]
    return F.md5(F.concat_ws('|', *parts))


def hash_uniform(keys, seed=DEFAULT_SEED, salt: str | None = None):
    """Uniform [0,1) draw: first 8 hex digits of the md5 as an integer / 2**32."""
    return hex8(hash_key(keys, seed, salt)) / float(2 ** 32)


def hex8(h):
    return F.conv(F.substring(h, 1, 8), 16, 10).cast('long')


def hex15(h):
    """A draw of 60 bits: reaches every position of any class."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast('long')


def on_groups(left: DataFrame, right: DataFrame, groups, extra=()) -> DataFrame:
    """Inner join on columns of one name, null being equal to null."""
    names = [*groups, *extra]
    r = right.withColumnsRenamed({c: f'_r_{c}' for c in names})
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(r[f'_r_{c}'])
    return left.join(r, cond).drop(*[f'_r_{c}' for c in names])


def hash_rank(df: DataFrame, keys, seed=DEFAULT_SEED, groups=(), prefix_hex: int = PREFIX_HEX,
              pos_col: str = 'pos', total_col: str | None = None, salt: str | None = None) -> DataFrame:
    """Add ``pos`` = 0-based rank of each row inside its group by hash order.

    ``keys`` must identify rows uniquely (ties would be broken arbitrarily).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    groups = list(groups)
    h = df.withColumn('_h', hash_key(keys, seed, salt)).withColumn('_b', F.substring('_h', 1, prefix_hex))
    counts = h.groupBy(*groups, '_b').agg(F.count(F.lit(1)).alias('_n'))
    wg = Window.partitionBy(*groups) if groups else Window.partitionBy()
    offsets = counts.select(*groups, '_b',
                            (F.sum('_n').over(wg.orderBy('_b')) - F.col('_n')).alias('_off'),
                            F.sum('_n').over(wg).alias('_gn'))
    joined = on_groups(h, offsets, groups, ['_b'])
    within = Window.partitionBy(*groups, '_b').orderBy('_h', *keys)
    out = joined.withColumn(pos_col, (F.col('_off') + F.row_number().over(within) - 1).cast('long'))
    if total_col:
        out = out.withColumnRenamed('_gn', total_col)
    return out.drop('_h', '_b', '_off', '_gn')


def _class_counts(df: DataFrame, label: str):
    return df.groupBy(F.col(label)).agg(F.count(F.lit(1)).alias('_cnt'))


def labelled_only(df: DataFrame, label: str) -> DataFrame:
    """Balancing needs classes: a null label ends the query with an error."""
    name = F.lit(f'column {label} holds null labels')
    kind = df.schema[label].dataType
    return df.withColumn(label, F.when(F.col(label).isNull(), F.raise_error(name).cast(kind)).otherwise(F.col(label)))


# ---------------------------------------------------------------- C5 undersample
def balance_undersample(df: DataFrame, label: str, keys, seed=DEFAULT_SEED) -> DataFrame:
    """Keep min(n0, n1) rows of each class, drawn without replacement."""
    # the input is used three times (ranks, their offsets, counts): written once
    df = written(labelled_only(df, label), 'undersample')
    ranked = hash_rank(df, keys, seed, groups=[label], pos_col='_pos')
    smallest = _class_counts(df, label).agg(F.min('_cnt').alias('_m'), F.count(F.lit(1)).alias('_k'))
    smallest = smallest.select(F.when(F.col('_k') >= 2, F.col('_m')).otherwise(F.lit(0)).alias('_m'))
    out = ranked.crossJoin(F.broadcast(smallest))  # one row
    return out.filter(F.col('_pos') < F.col('_m')).drop('_pos', '_m')


# ---------------------------------------------------------------- C6 oversample
def balance_oversample(df: DataFrame, label: str, keys, seed=DEFAULT_SEED,
                       target_ratio: float = 0.5) -> DataFrame:
    """Resample the minority class with replacement up to the majority size.

    ``target_ratio`` is accepted and ignored, as in the reproduced operator.  With equal
    class sizes class 1 is resampled.  Output has a ``copy_id`` column: the draw index for
    resampled rows, null for the kept class.
    """
    del target_ratio
    # the input is used three times (counts, kept class, draws): written once
    df = written(labelled_only(df, label), 'oversample')
    counts = {r[0]: r[1] for r in _class_counts(df.filter(F.col(label).isin(0, 1)), label).collect()}  # 2 rows at most
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    max_size = max(n0, n1)
    minority = 0 if n0 < max_size else 1
    n_min = counts.get(minority, 0)
    majority_rows = df.filter(F.col(label) != minority).withColumn('copy_id', F.lit(None).cast('long'))
    if n_min == 0 or max_size == 0:
        return majority_rows
    spark = df.sparkSession
    draws = (spark.range(max_size).withColumnRenamed('id', 'copy_id')
             .withColumn('_pos', F.pmod(hex15(hash_key(['copy_id'], seed, 'draw')), F.lit(n_min))))
    ranked = hash_rank(df.filter(F.col(label) == minority), keys, seed, pos_col='_pos')
    drawn = draws.join(ranked, '_pos').drop('_pos')
    return majority_rows.unionByName(drawn.select(*majority_rows.columns))


# ---------------------------------------------------------------- C7 shuffle
def seeded_shuffle(df: DataFrame, keys, seed=DEFAULT_SEED, pos_col: str = 'pos') -> DataFrame:
    """A full seeded permutation: ``pos`` in [0, n)."""
    return hash_rank(df, keys, seed, pos_col=pos_col)


# ---------------------------------------------------------------- C8 positional split
def positional_split(df: DataFrame, keys, train: float = 0.7, val: float = 0.15,
                     seed=DEFAULT_SEED) -> DataFrame:
    """Shuffle, then cut at int(n*train) and int(n*(train+val)); adds ``split``."""
    cut2 = train + val
    r = hash_rank(df, keys, seed, pos_col='_pos', total_col='_n')
    return r.withColumn('split', F.when(F.col('_pos') < F.floor(F.col('_n') * F.lit(train)), 'train')
                        .when(F.col('_pos') < F.floor(F.col('_n') * F.lit(cut2)), 'val')
                        .otherwise('test')).drop('_pos', '_n')


# ---------------------------------------------------------------- C9 / C10 stratified
def _totals(ranked: DataFrame, label: str) -> DataFrame:
    """One row per class (null is a class of its own) with its number of rows."""
    return ranked.groupBy(label).agg(F.first('_n').alias('_cnt'))


def _quota_table(counts: DataFrame, label: str, cnt: str, frac_test: float, out: str) -> DataFrame:
    """Per-class train quota: test size ceil(n*frac), largest remainder, ties by label.

    ``counts`` has one row per class (tiny).  Returns (label, out) with the number of
    rows of each class that go to the first part.
    """
    w = Window.partitionBy()
    n = F.sum(cnt).over(w)
    n_first = n - F.ceil(n * F.lit(frac_test))
    t = counts.select(label, cnt, (F.col(cnt) * n_first / n).alias('_cont'))
    t = t.withColumn('_floor', F.floor('_cont')).withColumn('_rem', F.col('_cont') - F.col('_floor'))
    t = t.withColumn('_need', (F.sum(cnt).over(w) - F.ceil(F.sum(cnt).over(w) * F.lit(frac_test)))
                     - F.sum('_floor').over(w))
    t = t.withColumn('_r', F.row_number().over(Window.orderBy(F.col('_rem').desc(), F.col(label))))
    return t.select(label, (F.col('_floor') + F.when(F.col('_r') <= F.col('_need'), 1).otherwise(0))
                    .cast('long').alias(out))


def stratified_split(df: DataFrame, label: str, keys, test: float = 0.2, seed=DEFAULT_SEED) -> DataFrame:
    """Two-way stratified split; adds ``split`` in {'train','test'}."""
    ranked = hash_rank(df, keys, seed, groups=[label], pos_col='_pos', total_col='_n')
    # the class totals come with the ranks, so the input is not counted again for them
    q = _quota_table(_totals(ranked, label), label, '_cnt', test, '_q')
    out = on_groups(ranked.drop('_n'), q, [label])
    return out.withColumn('split', F.when(F.col('_pos') < F.col('_q'), 'train').otherwise('test')) \
        .drop('_pos', '_q')


def stratified_split3(df: DataFrame, label: str, keys, holdout: float = 0.3, test_of_holdout: float = 0.5,
                      seed=DEFAULT_SEED) -> DataFrame:
    """70/15/15: stratified 30 % hold-out, then the hold-out halved, stratified."""
    ranked = hash_rank(df, keys, seed, groups=[label], pos_col='_pos', total_col='_n')
    cc = _totals(ranked, label)
    q1 = _quota_table(cc, label, '_cnt', holdout, '_q1')
    rest = on_groups(cc, q1, [label]).select(label, (F.col('_cnt') - F.col('_q1')).alias('_cnt2'), '_q1')
    q2 = _quota_table(rest.select(label, '_cnt2'), label, '_cnt2', test_of_holdout, '_q2')
    q = on_groups(rest, q2, [label]).select(label, '_q1', '_q2')
    out = on_groups(ranked.drop('_n'), q, [label])
    return out.withColumn('split', F.when(F.col('_pos') < F.col('_q1'), 'train')
                          .when(F.col('_pos') < F.col('_q1') + F.col('_q2'), 'val')
                          .otherwise('test')).drop('_pos', '_q1', '_q2')


# ---------------------------------------------------------------- H4 class mix
def class_mix_sample(df: DataFrame, label: str, keys, n: int, balance: float = 0.5,
                     seed=DEFAULT_SEED) -> DataFrame:
    """Exactly int(n*balance) rows of class 1 and the rest of class 0, then shuffled."""
    n1 = int(n * balance)
    n0 = n - n1
    counts = {r[0]: r[1] for r in _class_counts(df.filter(F.col(label).isin(0, 1)), label).collect()}  # 2 rows at most
    for cls, need in ((0, n0), (1, n1)):
        if counts.get(cls, 0) < need:
            raise ValueError(f'class {cls} has {counts.get(cls, 0)} rows, {need} requested')
    ranked = hash_rank(df, keys, seed, groups=[label], pos_col='_pos')
    picked = ranked.filter(((F.col(label) == 0) & (F.col('_pos') < n0))
                           | ((F.col(label) == 1) & (F.col('_pos') < n1))).drop('_pos')
    return seeded_shuffle(picked, keys, seed, pos_col='pos')


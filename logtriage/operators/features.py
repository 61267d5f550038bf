"""Categorical codes, scaling, assembling, and sklearn-style TF-IDF.

TF-IDF plan: terms are counted inside each document's row, or for a vocabulary alone over ranges of
rows, as numbers of an Arrow dictionary, and written once, so texts are never shuffled.  Of a bounded vocabulary, bucket counts are shuffled first, then only the terms of
the largest buckets; it is broadcast.  Without a bound the join is left to the planner.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import bigrams, word_tokens
from ..session import written
from .sampling import hash_uniform


#: Vocabularies bounded by at most this many terms are broadcast.
BROADCAST_TERMS = 200_000
#: Hash buckets whose counts bound the counts of their terms.
BUCKETS = 1 << 20
#: Tokens counted together (one row's at least), and rows of a batch of counts.
COUNTED, OUT_ROWS = 1 << 20, 1 << 17


def _r6(c):
    return F.round(c, 6)


def global_positions(df: DataFrame, order_cols, out_col: str) -> DataFrame:
    """Add the 0-based position in the order of ``order_cols`` without a one-task window.

    The rows are range-partitioned and written once; the partitions' sizes are cumulated.
    """
    n = int(df.sparkSession.conf.get('spark.sql.shuffle.partitions'))
    d = written(df.repartitionByRange(n, *order_cols).withColumn('_part', F.spark_partition_id()), 'positions')
    sizes = d.groupBy('_part').agg(F.count(F.lit(1)).alias('_size'))  # one row per partition
    before = sizes.select('_part', (F.sum('_size').over(Window.orderBy('_part')) - F.col('_size')).alias('_before'))
    rank = F.row_number().over(Window.partitionBy('_part').orderBy(*order_cols)) - 1
    return d.join(before, '_part').withColumn(out_col, F.col('_before') + rank).drop('_part', '_before')


# ---------------------------------------------------------------- D1
def label_encode(df: DataFrame, cols, suffix: str = '_code') -> DataFrame:
    """Code = rank of the value in sorted order, from 0 (fitted on the whole table); null
    values have no code."""
    out = df
    for c in cols:
        codes = global_positions(df.select(c).filter(F.col(c).isNotNull()).distinct(), [c], c + suffix)
        out = out.join(codes.withColumn(c + suffix, F.col(c + suffix).cast('int')), c, 'left')
    return out


# ---------------------------------------------------------------- D2
def standard_scale(df: DataFrame, cols, train_flag: str, suffix: str = '') -> DataFrame:
    """Fit mean and population std on rows where ``train_flag`` is true; apply to all.

    A constant column divides by 1.  The statistics are one aggregate row joined back
    by broadcast (never collected).
    """
    stats = df.filter(F.col(train_flag)).agg(
        *[F.avg(c).alias(f'_m_{c}') for c in cols], *[F.stddev_pop(c).alias(f'_s_{c}') for c in cols])
    stats = stats.withColumn('_one', F.lit(1))
    out = df.withColumn('_one', F.lit(1)).join(F.broadcast(stats), '_one')
    for c in cols:
        sd = F.col(f'_s_{c}')
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f'_m_{c}')) /
                             F.when((sd.isNull()) | (sd == 0), F.lit(1.0)).otherwise(sd))
    return out.drop('_one', *[f'_m_{c}' for c in cols], *[f'_s_{c}' for c in cols])


def hash_train_flag(keys, frac: float = 0.8, seed=42):
    return hash_uniform(keys, seed, 'train') < frac


# ---------------------------------------------------------------- D3
def assemble(df: DataFrame, num_cols, cat_cols, flag_cols, out_col: str = 'features',
             as_vector: bool = False) -> DataFrame:
    """Features in order numeric, categorical codes, flags, all as double.

    Codes are cast to plain doubles so tree learners treat them as ordinal values.
    """
    cols = [F.col(c).cast('double') for c in [*num_cols, *cat_cols, *flag_cols]]
    if not as_vector:
        return df.withColumn(out_col, F.array(*cols))
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out_col, array_to_vector(F.array(*cols)))


# ---------------------------------------------------------------- D4
def tokenize_ngrams(df: DataFrame, text_col: str, out_col: str = 'terms', ngram_range=(1, 2)) -> DataFrame:
    toks = df.withColumn('_tok', word_tokens(F.col(text_col)))
    parts = []
    if ngram_range[0] <= 1:
        parts.append(F.col('_tok'))
    if ngram_range[1] >= 2:
        parts.append(bigrams(F.col('_tok')))
    return toks.withColumn(out_col, parts[0] if len(parts) == 1 else F.concat(*parts)).drop('_tok')


def _runs(batches: Iterator[pa.RecordBatch], ngram_range: tuple, by_row: bool) -> Iterator[pa.RecordBatch]:
    """Terms of (id, tokens) batches counted, a range of rows at a time: (id, term, tf) of each row,
    or (term, df, cf) of each range."""
    for batch in batches:
        ids, tokens = batch.columns
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(batch):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + COUNTED, 'right')))
            size = np.diff(ends[lo:hi], prepend=before)
            words = tokens.slice(lo, hi - lo).flatten().dictionary_encode()
            w, row, n = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(hi - lo), size), len(words.dictionary)
            keys, rows = [], []  # a word is its number, two words are (first + 1) * n + second
            if ngram_range[0] <= 1:
                keys, rows = [w], [row]
            if ngram_range[1] >= 2:
                two = np.flatnonzero(row[1:] == row[:-1])
                keys, rows = [*keys, (w[two] + 1) * n + w[two + 1]], [*rows, row[two]]
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            fresh = np.append(True, key[1:] != key[:-1])[:len(key)]
            start = np.flatnonzero(fresh | np.append(True, row[1:] != row[:-1])[:len(key)])  # of the terms of each row
            if by_row:
                key, counts = key[start], [np.diff(np.append(start, len(key)))]
                of = ids.slice(lo, hi - lo).take(pa.array(row[start]))
            else:
                first = np.flatnonzero(fresh)
                at = np.append(np.searchsorted(start, first), len(start))
                key, counts = key[first], [np.diff(at), np.diff(np.append(first, len(key)))]
            for i in range(0, len(key), OUT_ROWS):
                k = key[i:i + OUT_ROWS]
                second = words.dictionary.take(pa.array(k % max(n, 1)))
                pair = pc.binary_join_element_wise(words.dictionary.take(pa.array(np.maximum(k // max(n, 1) - 1, 0))), second, ' ')
                term = pc.if_else(pa.array(k < n), second, pair)
                cols = [term, *[pa.array(c[i:i + OUT_ROWS], pa.int64()) for c in counts]]
                if by_row:
                    yield pa.RecordBatch.from_arrays([of.slice(i, OUT_ROWS), *cols], [batch.schema.names[0], 'term', 'tf'])
                else:
                    yield pa.RecordBatch.from_arrays(cols, ['term', 'df', 'cf'])
            lo = hi


def term_counts(docs: DataFrame, id_col: str, text_col: str, ngram_range=(1, 2)) -> DataFrame:
    """(id, term, tf): one row per distinct term of each document."""
    d = docs.select(id_col, word_tokens(F.col(text_col)).alias('_tok'))
    kind = T.StructType([d.schema[id_col], T.StructField('term', T.StringType()), T.StructField('tf', T.LongType())])
    return d.mapInArrow(partial(_runs, ngram_range=tuple(ngram_range), by_row=True), kind)


# ---------------------------------------------------------------- D5
def written_terms(docs: DataFrame, id_col: str, text_col: str, ngram_range=(1, 2)) -> DataFrame:
    """``term_counts`` with the hash bucket of each term, written: texts are taken apart once for
    the passes over their terms."""
    return written(term_counts(docs, id_col, text_col, ngram_range).withColumn('_bucket', _bucket()), 'terms')


def written_counts(docs: DataFrame, text_col: str, ngram_range=(1, 2)) -> DataFrame:
    """(term, df, cf, _bucket), written: the counts of ranges of documents, to be summed by term."""
    d = docs.select(F.lit(0).alias('_id'), word_tokens(F.col(text_col)).alias('_tok'))
    counts = d.mapInArrow(partial(_runs, ngram_range=tuple(ngram_range), by_row=False), 'term string, df long, cf long')
    return written(counts.withColumn('_bucket', _bucket()), 'terms')


def _bucket():
    return F.pmod(F.xxhash64('term'), F.lit(BUCKETS)).cast('int')


def _counted(counts: DataFrame) -> DataFrame:
    return counts.groupBy('term').agg(F.sum('df').alias('df'), F.sum('cf').alias('cf'))


def frequent_terms(counts: DataFrame, size: int, eligible) -> DataFrame:
    """(term, df, cf) of the ``size`` eligible terms of largest cf (ties: term ascending), from
    counts of parts of the documents (see ``written_counts``).

    Counts by hash bucket are upper bounds of the counts of their terms and the same for any
    text; only terms of the largest buckets are counted and shuffled as strings.  If the last
    one kept has fewer occurrences than a bucket left out, all buckets of at least its count are
    taken in a second round, which then holds every term that can be among the first."""
    totals = written(counts.groupBy('_bucket').agg(F.sum('cf').alias('_total')), 'buckets')  # BUCKETS rows at most
    last = totals.orderBy(F.col('_total').desc()).limit(2 * size).agg(F.min('_total')).first()[0]
    for _ in range(2):
        some = totals.filter(F.col('_total') >= (last or 0)).select('_bucket')
        top = _counted(counts.join(some, '_bucket', 'left_semi')).filter(eligible).orderBy(F.col('cf').desc(), F.col('term')).limit(size)
        top = written(top, 'frequent')
        n, least = top.agg(F.count(F.lit(1)), F.min('cf')).first()
        need = least if n == size else 0
        if not last or need >= last:  # what is left out has smaller buckets than ``last``
            return top
        last = need
    return top


def fit_tfidf(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text', min_df=2, max_df=0.95,
              max_features: int | None = 5000, ngram_range=(1, 2), tf: DataFrame | None = None) -> DataFrame:
    """Vocabulary (term, idx, df, cf, idf).

    Terms with min_df <= df <= max_df (ints are counts, floats fractions of N) are kept,
    then the ``max_features`` most frequent by total count (ties: term ascending).
    ``idx`` is the alphabetical position; ``idf = ln((1+N)/(1+df)) + 1``.  ``tf`` is a table of
    ``written_terms`` made before.
    """
    n_docs = docs.count()
    if tf is None:
        counts = written_counts(docs, text_col, ngram_range)
    else:
        counts = tf.select('term', '_bucket', F.lit(1).alias('df'), F.col('tf').alias('cf'))
    lo = min_df if isinstance(min_df, int) else min_df * n_docs
    hi = max_df if isinstance(max_df, int) else max_df * n_docs
    eligible = (F.col('df') >= lo) & (F.col('df') <= hi)
    idf = F.log((F.lit(1 + n_docs)) / (F.col('df') + 1)) + 1
    if max_features is not None:
        kept = frequent_terms(counts, max_features, eligible)
        kept = kept.withColumn('idx', F.row_number().over(Window.orderBy('term')) - 1)  # max_features rows
    else:
        kept = global_positions(_counted(counts).filter(eligible), ['term'], 'idx')
    return kept.select('term', F.col('idx').cast('int').alias('idx'),
                       F.col('df').cast('long').alias('df'), F.col('cf').cast('long').alias('cf'), idf.alias('idf'))


def save_vocabulary(vocab: DataFrame, path: str, **settings) -> str:
    """A fitted vocabulary and the settings of its analyser."""
    vocab.write.mode('overwrite').parquet(f'{path}/terms')
    vocab.sparkSession.createDataFrame([(json.dumps(settings),)], 'value string').coalesce(1).write.mode('overwrite').text(f'{path}/settings')
    return path


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(vocabulary, settings)."""
    return spark.read.parquet(f'{path}/terms'), json.loads(spark.read.text(f'{path}/settings').first()[0])


# ---------------------------------------------------------------- D6
def tfidf_transform(docs: DataFrame, vocab: DataFrame, id_col: str = 'doc_id', text_col: str = 'text',
                    ngram_range=(1, 2), tf: DataFrame | None = None,
                    max_features: int | None = None) -> DataFrame:
    """(id, term, idx, tfidf) with sublinear tf, L2-normalised per document.

    ``max_features``: the bound the vocabulary was fitted with; only then it is broadcast.
    Only ids and weights of vocabulary terms are shuffled for the norm.
    """
    if vocab is None:
        raise ValueError('vectoriser is not fitted: call fit_tfidf first')
    tf = tf if tf is not None else term_counts(docs, id_col, text_col, ngram_range)
    small = max_features is not None and max_features <= BROADCAST_TERMS
    v = vocab.select('term', 'idx', 'idf')
    j = tf.join(F.broadcast(v) if small else v, 'term')
    j = j.select(id_col, 'idx', ((1 + F.log(F.col('tf'))) * F.col('idf')).alias('_w'))
    norm = F.sqrt(F.sum(F.col('_w') * F.col('_w')).over(Window.partitionBy(id_col)))
    j = j.select(id_col, 'idx', (F.col('_w') / norm).alias('tfidf'))
    names = vocab.select('idx', 'term')
    return j.join(F.broadcast(names) if small else names, 'idx').select(id_col, 'term', 'idx', 'tfidf')


def fit_transform(docs, id_col='doc_id', text_col='text', **kw):
    tf = written_terms(docs, id_col, text_col, kw.get('ngram_range', (1, 2)))
    vocab = written(fit_tfidf(docs, id_col, text_col, tf=tf, **kw), 'vocabulary')
    return vocab, tfidf_transform(docs, vocab, id_col, text_col, tf=tf, max_features=kw.get('max_features', 5000))


# ---------------------------------------------------------------- D7 / D8 / D9
def top_features(vocab: DataFrame, n: int = 20) -> DataFrame:
    """The n terms of lowest idf (most frequent), ties by term."""
    return vocab.orderBy('idf', 'term').limit(n)


def top_terms_per_doc(tfidf: DataFrame, id_col: str = 'doc_id', n: int = 10) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(F.col('tfidf').desc(), 'term')
    return tfidf.withColumn('rank', F.row_number().over(w).cast('long')).filter(F.col('rank') <= n)


def vocab_stats(vocab: DataFrame, max_features=5000, ngram_range=(1, 2), min_df=2, max_df=0.95) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias('vocabulary_size')).select(
        'vocabulary_size', F.lit(max_features).cast('long').alias('max_features'),
        F.lit(f'{ngram_range[0]},{ngram_range[1]}').alias('ngram_range'),
        F.lit(float(min_df)).alias('min_df'), F.lit(float(max_df)).alias('max_df'))

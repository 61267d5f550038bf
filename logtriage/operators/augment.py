"""H1-H3, H5: template rendering, text augmentation, label noise, split materialisation.

All random choices are seeded hashes of the row key, so reruns (and recomputation after
a lost executor) reproduce the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import AUGMENT_PREFIXES, AUGMENT_SUFFIXES
from .sampling import DEFAULT_SEED, hash_key, hash_uniform, hex8, positional_split


def _pick(values, keys, seed, salt) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(hex8(hash_key(keys, seed, salt)), F.lit(len(values))) + 1).cast('int'))


def _filler(name: str, values, keys, seed):
    """(part, i) -> the part after the i-th slot with the slot's pick before it."""
    choices = F.array(*[F.lit(v) for v in values])

    def filled(part, i):
        salt = F.concat(F.lit(f'{name}|'), (i - 1).cast('string'))
        h = F.md5(F.concat_ws('|', F.lit(str(seed)), salt, *[F.col(k).cast('string') for k in keys]))
        pick = F.get(choices, F.pmod(hex8(h), F.lit(len(values))).cast('int'))
        return F.when(i > 0, F.concat(pick, part)).otherwise(part)

    return filled


def render_templates(df: DataFrame, template_col: str, slots: dict, out_col: str = 'rendered',
                     keys=None, seed=DEFAULT_SEED) -> DataFrame:
    """Fill every ``{slot}`` of ``template_col`` (H1).

    A slot given as a Column fills all its occurrences with that value.  A slot given as
    a list of strings gets an independent seeded pick per (row key, slot, occurrence): the
    text is split at the slot and joined again with the picks, however many there are.
    """
    out = F.col(template_col)
    if not keys and any(not isinstance(v, Column) for v in slots.values()):
        raise ValueError('list-valued slots need row keys for the seeded choice')
    names = [keys] if isinstance(keys, str) else list(keys or ())
    for name, val in slots.items():
        if isinstance(val, Column):
            out = F.replace(out, F.lit('{' + name + '}'), F.coalesce(val.cast('string'), F.lit('')))
            continue
        out = F.array_join(F.transform(F.split(out, '\\{' + name + '\\}', -1), _filler(name, val, names, seed)), '')
    return df.withColumn(out_col, out)


def augment_text(df: DataFrame, text_col: str, keys, p_prefix: float = 0.3, p_suffix: float = 0.2,
                 p_upper: float = 0.1, seed=DEFAULT_SEED, out_col: str | None = None) -> DataFrame:
    """Level prefix (p .3), suffix (p .2), then upper-case the whole result (p .1) (H2)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t = F.col(text_col)
    t = F.when(hash_uniform(keys, seed, 'prefix') < p_prefix,
               F.concat(_pick(AUGMENT_PREFIXES, keys, seed, 'prefix-choice'), t)).otherwise(t)
    t = F.when(hash_uniform(keys, seed, 'suffix') < p_suffix,
               F.concat(t, _pick(AUGMENT_SUFFIXES, keys, seed, 'suffix-choice'))).otherwise(t)
    t = F.when(hash_uniform(keys, seed, 'upper') < p_upper, F.upper(t)).otherwise(t)
    return df.withColumn(out_col or text_col, t)


def inject_label_noise(df: DataFrame, label_col: str, keys, p: float = 0.1, seed=DEFAULT_SEED,
                       out_col: str | None = None) -> DataFrame:
    """Flip a 0/1 label with probability p (H3)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    flip = hash_uniform(keys, seed, 'noise') < p
    y = F.col(label_col)
    return df.withColumn(out_col or label_col, F.when(flip, 1 - y).otherwise(y).cast('int'))


def materialize_splits(df: DataFrame, path: str, keys, train: float = 0.7, val: float = 0.15,
                       seed=DEFAULT_SEED, mode: str = 'overwrite') -> str:
    """Write the full set partitioned by split (train/val/test) in one job (H5)."""
    positional_split(df, keys, train, val, seed).write.mode(mode).partitionBy('split').parquet(path)
    return path

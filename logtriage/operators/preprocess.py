"""Preprocessing pipeline, keep-first dedup, funnel counts, label distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_RULES, LABEL_NAMES, Rules
from ..functions.text import clean_text, is_relevant


def dedup_keep_first(df: DataFrame, keys, order_by) -> DataFrame:
    """Keep, per key, the row that is first by ``order_by``.

    ``min_by`` is a partial aggregate, so a key that holds a large share of all rows
    is reduced map-side before the shuffle (no single hot task).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(c) for c in others])
    order = F.struct(*[F.col(c) for c in order_by])  # a struct: min_by passes over null orders
    kept = df.groupBy(*keys).agg(F.min_by(row, order).alias('_first'))
    return kept.select(*keys, *[F.col('_first')[c].alias(c) for c in others]).select(*df.columns)


def with_cleaned_text(df: DataFrame, text_column: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add ``cleaned_text``.  It comes out of a generator, so the optimizer does not copy the
    cleaning chain into every later expression that names the column."""
    return df.select('*', F.explode(F.array(clean_text(text_column, rules))).alias('cleaned_text'))


def preprocess_logs(df: DataFrame, text_column: str = 'log_text', filter_relevant: bool = True,
                    order_by=None, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """clean -> optional relevance filter -> dedup on cleaned_text keeping the first."""
    if not order_by:
        raise ValueError('order_by must name the columns that say which row is first')
    out = with_cleaned_text(df, text_column, rules)
    if filter_relevant:
        out = out.filter(is_relevant('cleaned_text', rules))
    return dedup_keep_first(out, 'cleaned_text', order_by)


def preprocess_funnel(df: DataFrame, text_column: str = 'log_text',
                      rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Rows in / after the relevance filter / after dedup, with kept percentages."""
    cleaned = df.select(F.explode(F.array(clean_text(text_column, rules))).alias('c'))
    cleaned = cleaned.select('c', is_relevant('c', rules).alias('rel'))
    rel = F.col('rel')
    agg = cleaned.agg(F.count(F.lit(1)).alias('n_in'),
                      F.count(F.when(rel, 1)).alias('n_relevant'),
                      F.count_distinct(F.when(rel, F.col('c'))).alias('n_dedup'))
    denom = F.greatest(F.col('n_in'), F.lit(1))
    return agg.select('n_in', 'n_relevant', 'n_dedup',
                      F.round(F.col('n_relevant') / denom * 100, 6).alias('pct_relevant'),
                      F.round(F.col('n_dedup') / denom * 100, 6).alias('pct_kept'))


def label_distribution(df: DataFrame, label_col: str = 'label') -> DataFrame:
    """Count and percentage per label; both classes always present (C4)."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(label_col).cast('int').alias('label')).agg(F.count(F.lit(1)).alias('n'))
    base = spark.createDataFrame([(k,) for k in sorted(LABEL_NAMES)], 'label int')
    full = base.join(counts, 'label', 'full_outer').fillna(0, ['n'])  # a null label keeps its row, without a name
    total = F.sum('n').over(Window.partitionBy())
    return full.select(
        'label',
        F.when(F.col('label') == 0, F.lit(LABEL_NAMES[0])).when(F.col('label') == 1, F.lit(LABEL_NAMES[1])).alias('label_name'),
        F.col('n').cast('long').alias('n'),
        F.round(F.col('n') / F.greatest(total, F.lit(1)) * 100, 6).alias('pct'))

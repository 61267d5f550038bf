"""Row-wise triage on a stream: the text operators are pure Column expressions.

Cleaning, relevance and rule labelling need no state, so they run unchanged on a
``readStream`` DataFrame.  Keep-first dedup across a stream needs state; use
``dropDuplicatesWithinWatermark`` on ``cleaned_text`` with an event-time watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import DEFAULT_RULES, Rules
from ..functions.text import is_relevant, label_logs
from ..operators.preprocess import with_cleaned_text


def triage_stream(df: DataFrame, text_column: str = 'log_text', rules: Rules = DEFAULT_RULES,
                  dedup: bool = True, event_time: str | None = None, watermark: str = '10 minutes') -> DataFrame:
    """Clean, filter, deduplicate (unless ``dedup`` is off) and label a stream of log lines."""
    if dedup and not event_time:
        raise ValueError('dedup on a stream needs event_time')
    out = with_cleaned_text(df, text_column, rules)
    out = out.filter(is_relevant('cleaned_text', rules))
    if dedup:
        out = out.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(['cleaned_text'])
    return label_logs(out, 'cleaned_text')


def read_log_stream(spark: SparkSession, directory: str) -> DataFrame:
    """New text files of a directory as a stream of lines (column ``log_text``)."""
    return spark.readStream.text(directory).withColumnRenamed('value', 'log_text')

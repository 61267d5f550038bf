"""CSV and JSON sinks (with read-back helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = 'overwrite') -> str:
    """Header, no index; the target directory (and parents) are created by the writer."""
    (df.write.mode(mode).option('header', True).option('escape', '"').option('quote', '"')
     .csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option('header', True).option('multiLine', True).option('escape', '"')
    return (r.schema(schema) if schema is not None else r.option('inferSchema', True)).csv(path)


def save_results(df: DataFrame, path: str, mode: str = 'overwrite') -> str:
    """Evaluation records (nested structs allowed) as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def load_results(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)

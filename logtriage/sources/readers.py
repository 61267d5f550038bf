"""A1-A5: log readers and table normalisation."""

from __future__ import annotations

import os
import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import regex_trim
from . import csv_records as C

TEXT_EXTENSIONS = ('.log', '.txt')
CSV_EXTENSIONS = ('.csv',)
CSV_SEPARATORS = (',', ';', '\t')
_TEXT_GLOB = '*.{[lL][oO][gG],[tT][xX][tT]}'
_CSV_GLOB = '*.[cC][sS][vV]'


def _lines(spark: SparkSession, path, recursive: bool = False, glob: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """(log_text, source_file): stripped, non-blank lines, of ``files`` (file) only if given.

    Files are split over tasks; lines keep their raw bytes until a file's encoding is known:
    UTF-8 if every line of the file is valid, else Latin-1 (which accepts any byte).
    """
    reader = spark.read.option('recursiveFileLookup', recursive)
    reader = reader.option('pathGlobFilter', glob) if glob else reader
    raw = reader.text(path).select('value', F.col('_metadata.file_path').alias('_file'))
    if files is not None:
        raw = raw.join(files, F.col('_file') == F.col('file'), 'left_semi')
    other = raw.filter(~F.is_valid_utf8('value')).select('_file').distinct().withColumn('_latin', F.lit(True))
    text = F.when(F.col('_latin'), F.decode(F.col('value').cast('binary'), 'ISO-8859-1')).otherwise(F.col('value'))
    out = raw.join(other, '_file', 'left').select(regex_trim(text).alias('log_text'), base_name('_file').alias('source_file'))
    return out.filter(F.col('log_text') != '')


def base_name(path: str):
    return F.element_at(F.split(path, '/'), -1)


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank stripped line (A2)."""
    return _lines(spark, path).select('log_text')


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0] if first else ''


def separator(header: str) -> str | None:
    """The first of ``, ; TAB`` that yields more than one column."""
    return next((x for x in CSV_SEPARATORS if len(header.split(x)) > 1), None)


def _whole_files(spark: SparkSession, sep: str):
    """Spark's reader for files whose quotes are not RFC 4180's: a task per file."""
    return spark.read.options(header=True, multiLine=True, **C.options_of(sep))


def read_csv_logs(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with the first of ``, ; TAB`` that yields more than one column (A1).

    Falls back to line reading when no separator works.  Quoted fields may span lines
    (stack traces) and quotes are escaped by doubling; files are cut into records in
    parallel.  Where a record's quotes are of another kind, files are read whole.
    """
    sep = separator(_header(spark, path))
    if sep is None:
        return read_text_logs(spark, path)
    lines = C.lines_of(spark, path)
    rows = C.records(lines, C.splits(lines))
    if not rows.filter(~C.strict('text', sep)).isEmpty():
        warnings.warn(f'{path} has quotes inside unquoted fields: a task per file')
        reader = _whole_files(spark, sep)
        return (reader.schema(schema) if schema is not None else reader.option('inferSchema', True)).csv(path)
    if schema is not None:
        kind = schema if not isinstance(schema, str) else StructType.fromDDL(schema)
        names, kinds = kind.names, [f.dataType.simpleString() for f in kind]
    else:
        names = C.columns_of(rows.filter('first').agg(F.min_by('text', 'file')).first()[0], sep)
        kinds = C.infer(rows.filter('not first'), names, sep)
    return rows.filter('not first').select(C.parsed(names, kinds, sep).alias('r')).select('r.*')


def read_log_file(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the extension (case-insensitive): .csv / .log / .txt (A3)."""
    ext = os.path.splitext(path)[1].lower()
    try:
        spark.read.format('binaryFile').load(path).limit(0).collect()
    except AnalysisException as exc:
        raise FileNotFoundError(path) from exc
    if ext in CSV_EXTENSIONS:
        return read_csv_logs(spark, path)
    if ext in TEXT_EXTENSIONS:
        return read_text_logs(spark, path)
    raise ValueError(f'unsupported extension: {ext}')


def read_log_dir(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """All .log/.txt/.csv files of a directory with ``source_file`` = base name (A4).

    Text files are read by one distributed job.  CSV files are cut into records together and
    parsed per distinct header line (formats are few, files may be many), every column as
    string, and unioned by name; files without a separator in their header count as text.
    """
    try:
        listed = (spark.read.format('binaryFile').option('recursiveFileLookup', recursive).load(directory).select('path'))
        names = listed.filter(F.lower('path').rlike(r'\.(log|txt|csv)$'))
    except AnalysisException as exc:
        if 'PATH_NOT_FOUND' in str(exc) or 'Path does not exist' in str(exc):
            raise FileNotFoundError(directory) from exc
        raise
    kinds = {r.kind: r.n for r in names.groupBy(F.lower(F.substring_index('path', '.', -1)).alias('kind')).agg(F.count(F.lit(1)).alias('n')).collect()}
    parts = []
    if kinds.keys() & {'log', 'txt'}:
        parts.append(_lines(spark, directory, recursive, _TEXT_GLOB))
    if 'csv' in kinds:
        lines = C.lines_of(spark, directory, recursive, _CSV_GLOB)
        splits = C.splits(lines)
        rows = C.records(lines, splits)
        heads = splits.filter('block = 0').select('file', 'header')
        for (h,) in heads.select('header').distinct().collect():  # one row per format
            sep, files = separator(h), heads.filter(F.col('header') == h).select('file')
            if sep is None:
                parts.append(_lines(spark, directory, recursive, _CSV_GLOB, files))
                continue
            names = C.columns_of(h, sep)
            own = rows.join(files, 'file', 'left_semi')
            odd = [r.file for r in own.filter(~C.strict('text', sep)).select('file').distinct().collect()]  # files that must be read whole
            if odd:
                parts.append(_whole_files(spark, sep).csv(odd).withColumn('source_file', base_name('_metadata.file_path')))
                own = own.filter(~F.col('file').isin(odd))
            text = own.filter('not first').select(C.parsed(names, ['string'] * len(names), sep).alias('r'), base_name('file').alias('source_file'))
            parts.append(text.select('r.*', 'source_file'))
    if not parts:
        warnings.warn(f'no log file found in {directory}')
        return spark.createDataFrame([], 'log_text string')
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize_log_table(df: DataFrame, text_column: str = 'log_text') -> DataFrame:
    """Pick the text column, cast it to ``log_text``, keep label/target/class columns (A5).

    Text column: the named one, else the first whose name contains text/log/message,
    else the first column.  Nulls stay null (not the string 'nan').
    """
    cols = df.columns
    if text_column not in cols:
        cands = [c for c in cols if any(w in c.lower() for w in ('text', 'log', 'message'))]
        text_column = cands[0] if cands else cols[0]
    keep = [c for c in cols if any(w in c.lower() for w in ('label', 'target', 'class'))]
    keep = [c for c in keep if c != 'log_text']
    return df.select(F.col(text_column).cast('string').alias('log_text'), *keep)

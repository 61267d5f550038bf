"""Shared pieces: row keys, scratch tables in the shared folder, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words of a text: runs without the six ASCII white-space characters.
WORD = r'[^\x20\x09-\x0D]+'


def text_of(c='text') -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(c).cast('string'), F.lit(''))


def keyed(docs: DataFrame, id_col='doc_id', text_col='text') -> DataFrame:
    """(doc_id, th, text): ``th`` hashes the text, so (doc_id, th) names a row's content.

    Repeated rows share a key and therefore get the same result; rows with the same id
    but other texts stay apart.  Extra columns are not carried.
    """
    t = text_of(text_col)
    return docs.select(F.col(id_col).cast('long').alias('doc_id'), F.xxhash64(t).alias('th'), t.alias('text'))


def on_key(a: DataFrame, b: DataFrame, how='left') -> DataFrame:
    """Join on (doc_id, th), null ids being equal to null ids; keeps the keys of ``a``."""
    r = b.withColumnsRenamed({'doc_id': '_r_id', 'th': '_r_th'})
    return a.join(r, a.doc_id.eqNullSafe(r._r_id) & (a.th == r._r_th), how).drop('_r_id', '_r_th')


def renamed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its columns as c0, c1, ... plus the row key (_id, _th), so that no
    column can clash with helper columns; and the new names of doc_id and text.  ``toDF``
    with the old names undoes it."""
    names = docs.columns
    i, t = f'c{names.index("doc_id")}', f'c{names.index("text")}'
    df = docs.toDF(*[f'c{k}' for k in range(len(names))])
    return df.withColumns({'_id': F.col(i).cast('long'), '_th': F.xxhash64(text_of(t))}), i, t


def by_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join ``renamed`` rows with (doc_id, th) keys, null ids being equal."""
    k = keys.withColumnsRenamed({'doc_id': '_k_id', 'th': '_k_th'})
    return rows.join(k, rows._id.eqNullSafe(k._k_id) & (rows._th == k._k_th), how)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: one evaluation for
    several readers, and a lost executor later rereads files instead of recomputing."""
    path = scratch_path(df.sparkSession, f'llm-{name}')
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished work deleted now.  Spark's cleaner does that once the
    driver has collected the objects that stood for them, which may take long by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Have a worker return the memory that a task's arrays have left free; workers stay for the
    next tasks, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL('libc.so.6').malloc_trim(0)


def lean(function: Callable) -> Callable:
    """A generator over batches that gives memory back at its end."""
    @functools.wraps(function)
    def run(*args, **options):
        try:
            yield from function(*args, **options)
        finally:
            give_back()
    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get('spark.sql.shuffle.partitions'))


def text_slices(batch: pa.RecordBatch, column='text', max_bytes=1 << 20) -> Iterator[tuple]:
    """Cut an Arrow batch into row ranges of about ``max_bytes`` of text (one row at least).

    Yields (lo, hi, data, offsets): the UTF-8 bytes of the rows as one uint8 array and
    int64 offsets (hi - lo + 1 of them, from 0).  Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null('')
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off_buf, data_buf = col.buffers()
    n = len(col)
    if not n:
        return
    off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, 'right')) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column from a flat uint8 array and n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate data[s:s+n] for all (s, n): the flat array and its offsets."""
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    idx = np.arange(off[-1]) + np.repeat(starts - off[:-1], lengths)
    return data[idx], off


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

"""Quoted CSV read in parallel: records that span lines, cut at quote parity.

The text source splits files over tasks, wherever the splits fall.  A first pass counts the
quotes of each split; sums over a file's earlier splits tell which splits begin inside a
quoted field.  A second pass cuts every split into records on its own; the pieces of a record
that crosses splits are put together by their order in the file.

That holds for quotes as RFC 4180 has them (a quoted field is quoted from end to end, quotes in
it are doubled).  ``strict`` says whether a record is of that form; files with other records
must be read whole.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

_PIECES = 'file string, first boolean, text binary, block long, piece int'
_PIECES_ARROW = pa.schema([('file', pa.string()), ('first', pa.bool_()), ('text', pa.binary()), ('block', pa.int64()), ('piece', pa.int32())])
#: Records per Arrow batch that a task returns, and their bytes.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
# piece: 0 a whole record, 1 the first lines of one, 2 the lines of a split inside one, 3 its last lines
WHOLE, HEAD, INSIDE, TAIL = range(4)


def lines_of(spark: SparkSession, path, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(file, block, value): lines by split, in their order within a task."""
    reader = spark.read.option('recursiveFileLookup', recursive).option('lineSep', '\n')
    reader = reader.option('pathGlobFilter', glob) if glob else reader
    return reader.text(path).select(F.col('_metadata.file_path').alias('file'), F.col('_metadata.file_block_start').alias('block'), F.col('value').cast('binary').alias('value'))


def splits(lines: DataFrame) -> DataFrame:
    """(file, block, inside, header): whether the split begins inside a quoted field, and the
    file's first line at its first split; a row per split, written."""
    text = F.col('value').cast('string')
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit('')))
    one = lines.select('file', 'block', quotes.alias('quotes'), F.when(F.col('block') == 0, text).alias('line'), F.monotonically_increasing_id().alias('at'))
    one = one.groupBy('file', 'block').agg((F.sum('quotes') % 2).alias('odd'), F.min_by('line', 'at').alias('header'))
    before = F.sum('odd').over(Window.partitionBy('file').orderBy('block').rowsBetween(Window.unboundedPreceding, -1))
    return written(one.select('file', 'block', (F.coalesce(before, F.lit(0)) % 2 == 1).alias('inside'), F.regexp_replace('header', '\r$', '').alias('header')), 'csv-splits')


def strict(text: str, sep: str) -> Column:
    """Whether a record has quotes only around whole fields, and doubled inside them."""
    field = '(?:"[^"]*+(?:""[^"]*+)*+"|[^"' + re.escape(sep) + ']*+)'
    return ~F.col(text).contains('"') | F.col(text).rlike(r'\A' + field + '(?:' + re.escape(sep) + field + r')*+\z')


class Cutter:
    """Records of one split, line by line."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.kept, self.open, self.started, self.first = file, block, [], inside, not inside, block == 0

    def line(self, value: bytes):
        self.kept.append(value)
        if value.count(b'"') % 2:
            self.open = not self.open
        if not self.open:
            yield self._out(WHOLE if self.started else TAIL)
            self.started = True

    def end(self):
        if self.kept:
            yield self._out(HEAD if self.started else INSIDE)

    def _out(self, piece: int) -> tuple:
        text, self.kept = b'\n'.join(self.kept), []
        first, self.first = self.first, False
        return self.file, first, text, self.block, piece


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES_ARROW.types, strict=True)], schema=_PIECES_ARROW)


def records(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """(file, first, text): the non-empty records of the files; ``first`` marks a file's first
    one.  The splits that begin inside a field (fewer than the splits that the driver plans
    anyway) go to the tasks as a set."""
    inside = lines.sparkSession.sparkContext.broadcast({(r.file, r.block) for r in parts.filter('inside').select('file', 'block').toLocalIterator()})

    def cut(batches: Iterator[pa.RecordBatch]):
        cutter = None
        for batch in batches:
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if cutter is None or (cutter.file, cutter.block) != (file, block):
                    yield from cutter.end() if cutter else ()
                    cutter = Cutter(file, block, (file, block) in inside.value)
                yield from cutter.line(value)
        yield from cutter.end() if cutter else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for piece in cut(batches):
            out.append(piece)
            size += len(piece[2])
            if len(out) >= BATCH_ROWS or size > BATCH_BYTES:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    pieces = written(lines.mapInArrow(run, _PIECES), 'csv-pieces').withColumn('text', F.col('text').cast('string'))
    # a record that crosses splits: its head, the splits inside it and its tail follow each other
    number = F.sum(F.when(F.col('piece') == HEAD, 1).otherwise(0)).over(Window.partitionBy('file').orderBy('block', F.col('piece') != TAIL))
    crossing = pieces.filter(F.col('piece') != WHOLE).withColumn('record', number).groupBy('file', 'record').agg(
        F.bool_or('first').alias('first'), F.sort_array(F.collect_list(F.struct('block', 'text'))).alias('parts'))
    crossing = crossing.select('file', 'first', F.array_join(F.transform('parts', lambda p: p['text']), '\n').alias('text'))
    both = pieces.filter(F.col('piece') == WHOLE).select('file', 'first', 'text').unionByName(crossing)
    # where records end in CR LF, that is a line end inside their fields too
    text = F.when(F.col('text').endswith('\r'), F.replace(F.regexp_replace('text', r'\r\z', ''), F.lit('\r\n'), F.lit('\n'))).otherwise(F.col('text'))
    return both.withColumn('text', text).filter("text <> ''")


def columns_of(header: str, sep: str) -> list[str]:
    """Column names: unnamed ones by position, repeated ones with it appended."""
    names = [n if n else f'_c{i}' for i, n in enumerate(next(csv.reader([header], delimiter=sep), []))]
    low = [n.lower() for n in names]
    return [f'{n}{i}' if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def options_of(sep: str) -> dict[str, str]:
    return {'sep': sep, 'quote': '"', 'escape': '"', 'maxCharsPerColumn': '-1'}


def quoted(name: str) -> str:
    return '`' + name.replace('`', '``') + '`'


def parsed(names: list[str], kinds: list[str], sep: str) -> Column:
    """The columns of a record as a struct."""
    schema = ', '.join(f'{quoted(n)} {k}' for n, k in zip(names, kinds, strict=True))
    return F.from_csv('text', schema, options_of(sep))


#: Types tried for a column, the first that fits all its values wins.
_TRIED = [('int', r'^[+-]?[0-9]+$'), ('bigint', r'^[+-]?[0-9]+$'), ('double', r'^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Inf(inity)?)$'),
          ('date', r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), ('timestamp', r'^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+([Zz]|[+-][0-9:]+)?$'), ('boolean', r'^(?i)(true|false)$')]


def infer(rows: DataFrame, names: list[str], sep: str) -> list[str]:
    """The types of the columns, from one pass over all records."""
    strings = rows.select(parsed(names, ['string'] * len(names), sep).alias('r')).select(*[F.col('r').getField(n).alias(f'c{i}') for i, n in enumerate(names)])
    checks = [F.coalesce(F.bool_and(F.col(f'c{i}').isNull() | (F.col(f'c{i}').rlike(p) & F.expr(f'try_cast(c{i} AS {k})').isNotNull())), F.lit(False)).alias(f'c{i}_{k}')
              for i in range(len(names)) for k, p in _TRIED]
    some = [F.count(f'c{i}').alias(f'n{i}') for i in range(len(names))]
    got = strings.agg(*checks, *some).first()
    return [next((k for k, _ in _TRIED if got[f'c{i}_{k}']), 'string') if got[f'n{i}'] else 'string' for i in range(len(names))]

"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

* Words are counted per task by array operations on the UTF-8 bytes, so that only distinct
  words with counts are shuffled.
* Of two words one edit apart the shorter one (either, if equally long) contributes two
  disjoint chunks, its halves; the other contributes its positional grams of those sizes.  One
  edit leaves a chunk whole, and that starts where it did or, behind an insertion, one later;
  grams that begin elsewhere for both possible lengths of the partner meet no chunk and are
  not written.
* A key that many words share ("...ing") is not paired: what lies beside the matched chunk
  again differs by one edit, so its rows get the two chunks (or the grams) of the rest added
  to their key, and again while a key is shared by too many.
* Pairs that meet are verified by their edit distance.  Forms are followed by doubling.

Edge cases: null texts have no words; a null id stands as empty before the ``:``; repeated
rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather, text_slices, written

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR, DAMAGE = 7, 2, 10, 31
#: Pairs that a key may give before its rows are told apart by chunks of the rest.
PAIRS = 4096
#: Distinct words that a task gathers before it passes them on.
GATHERED = 400_000
#: Runs up to that many bytes are hashed side by side, longer ones one by one.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 the byte
    C3 and one more) inside each text."""
    lead = data == 0xC3
    solid = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | lead
    solid[1:] |= lead[:-1]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = solid[inner]
    tail[inner - 1] = solid[inner - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each run behind a prefix with the CRC-32 ``first``."""
    state, size = ~first.astype(np.uint32), ends - starts
    order = np.argsort(-size, kind='stable')
    order = order[size[order] <= SHORT]
    s, at, left = state[order], starts[order], -size[order]
    for j in range(int(-left[0]) if len(order) else 0):
        k = int(np.searchsorted(left, -j, 'left'))  # runs longer than j
        s[:k] = _CRC[(s[:k] ^ data[at[:k] + j]) & 255] ^ (s[:k] >> 8)
    state[order] = s
    out = ~state
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(first[i]))
    return out


def _words(data: np.ndarray, offsets: np.ndarray, ids: list, damage: int, least: int) -> pa.Array:
    """The words of some texts, damaged where the hash of id and run says so."""
    data = _LOWER[data]
    starts, ends = letter_runs(data, offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    keep = points[ends] - points[starts] >= least
    starts, ends = starts[keep], ends[keep]
    prefix = np.array([zlib.crc32(f'{"" if i is None else i}:'.encode()) for i in ids], np.uint32)
    h = run_hashes(data, starts, ends, prefix[np.searchsorted(offsets, starts, 'right') - 1])
    cut = h % damage == 0
    odd = []
    for s, e, x in zip(starts[cut].tolist(), ends[cut].tolist(), h[cut].tolist(), strict=True):
        run = data[s:e].tobytes().decode()
        if len(run) > least:
            at = x % len(run)
            odd.append(run[:at] + run[at + 1:])
    flat, off = gather(data, starts[~cut], (ends - starts)[~cut])
    whole = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(flat)])
    return pa.concat_arrays([whole, pa.array(odd, pa.large_string())])


_COUNT = pa.schema([('word', pa.large_string()), ('n', pa.int64())])


def _count(damage: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(have).group_by('word').aggregate([('n', 'sum')]).select(['word', 'n_sum']).rename_columns(['word', 'n'])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_slices(batch):
                got = _words(data, offsets, ids[lo:hi], damage, least).value_counts()
                have.append(pa.table([got.field(0), got.field(1)], schema=_COUNT))
                size += len(got)
                if size > GATHERED:
                    have = [merged()]
                    size = len(have[0])
                    if size > GATHERED // 2:
                        yield from have[0].to_batches(max_chunksize=50_000)
                        have, size = [], 0
        if have:
            yield from merged().to_batches(max_chunksize=50_000)
    return run


def count_words(docs: DataFrame, id_col='doc_id', text_col='text', damage: int = DAMAGE, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the lower-cased letter runs of at least ``least`` code points.  A run whose
    CRC-32 behind ``<id>:`` is divisible by ``damage`` loses a code point before it counts."""
    rows = docs.select(F.col(id_col).cast('string').alias('doc_id'), F.col(text_col).cast('string').alias('text'))
    return rows.mapInArrow(_count(damage, least), 'word string, n long').groupBy('word').agg(F.sum('n').alias('n'))


def _part(start: Column, n: Column) -> Column:
    return F.substr('word', (start + 1).cast('int'), n.cast('int'))


def _refined(rows: DataFrame) -> DataFrame:
    """Rows (key, word, n, lo, hi, r): [lo, hi) is the part of the word beside what the key has
    matched, r the length of that part in the word that gives chunks; ``hi - lo`` is r there, r
    or r + 1 in its partner.  Two rows each, by the halves of the part."""
    q = F.expr('r div 2')
    first = F.struct(F.xxhash64('key', F.lit(1), _part(F.col('lo'), q)).alias('key'), (F.col('lo') + q).alias('lo'), F.col('hi'), (F.col('r') - q).alias('r'))
    second = F.col('hi') - (F.col('r') - q)
    last = F.struct(F.xxhash64('key', F.lit(2), _part(second, F.col('r') - q)).alias('key'), F.col('lo'), second.alias('hi'), q.alias('r'))
    return rows.withColumn('x', F.explode(F.array(first, last))).select('gram', 'word', 'n', 'x.*')


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): each two words at edit distance one, once, the shorter as ``a`` (of
    equally long ones the smaller).  ``words`` is a written table (word, n)."""
    size = F.length('word').cast('long')
    base = words.select('word', 'n', F.lit(0).cast('long').alias('lo'), size.alias('hi'))
    chunks = base.withColumns({'gram': F.lit(False), 'r': F.col('hi')})
    grams = base.withColumns({'gram': F.lit(True), 'r': F.explode(F.array('hi', F.col('hi') - 1))})
    rows = chunks.unionByName(grams).filter('r >= 2').withColumn('key', F.xxhash64('r'))
    cold = []
    while True:
        rows = written(_refined(rows), 'spelling-keys')
        sides = rows.groupBy('key').agg(F.count_if(~F.col('gram')).alias('_a'), F.count_if(F.col('gram')).alias('_b')).filter('_a > 0 and _b > 0')
        rows = rows.join(sides, 'key')
        hot = (F.col('_a') * F.col('_b') > pairs) & (F.col('r') >= 2)
        cold.append(rows.filter(~hot).drop('_a', '_b'))
        rows = written(rows.filter(hot).drop('_a', '_b'), 'spelling-hot')
        if rows.isEmpty():
            break
    found = []
    for c in cold:
        a = c.filter('not gram').select('key', F.col('word').alias('a'), F.col('n').alias('n_a'))
        b = c.filter('gram').select('key', F.col('word').alias('b'), F.col('n').alias('n_b'))
        both = a.join(b, 'key').filter('length(a) < length(b) or length(a) = length(b) and a < b')
        found.append(both.filter(F.levenshtein('a', 'b', 1) == 1).drop('key'))
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0].distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that the forms lead to."""
    state = written(forms.select('word', F.col('form').alias('root')), 'spelling-roots')
    while True:
        more = state.select(F.col('word').alias('root'), F.col('root').alias('_next'))
        step = written(state.join(more, 'root', 'left').select('word', F.coalesce('_next', 'root').alias('root'), F.col('_next').isNotNull().alias('moved')), 'spelling-roots')
        state = step.drop('moved')
        if step.filter('moved').isEmpty():
            return state


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n): ``form`` is the near word
    of largest n (the smallest in code-point order of several), if its n is at least
    ``factor`` times the word's; ``root`` is where the forms lead from the word."""
    words = written(words.select('word', F.col('n').cast('long').alias('n')), 'spelling-words')
    pairs = written(near_pairs(words), 'spelling-pairs')
    ways = pairs.select(F.col('a').alias('word'), F.col('n_b').alias('_n'), F.col('b').alias('_w')).unionAll(
        pairs.select(F.col('b').alias('word'), F.col('n_a').alias('_n'), F.col('a').alias('_w')))
    best = ways.groupBy('word').agg(F.count(F.lit(1)).alias('n_near'), F.min(F.struct((-F.col('_n')).alias('m'), '_w')).alias('_best'))
    fits = -F.col('_best.m') >= factor * F.col('n')
    out = written(words.join(best, 'word', 'left').select(
        'word', 'n', F.coalesce('n_near', F.lit(0)).alias('n_near'), F.when(fits, F.col('_best._w')).alias('form'), F.when(fits, -F.col('_best.m')).alias('form_n')), 'spelling-forms')
    roots = followed(out.filter('form is not null'))
    return out.join(roots, 'word', 'left').select('word', 'form', F.coalesce('root', 'word').alias('root'), 'n', 'n_near', 'form_n')


def spelling_variants(docs: DataFrame, id_col='doc_id', text_col='text') -> DataFrame:
    """``variants`` of the words of all texts that occur at least twice."""
    return variants(count_words(docs, id_col, text_col).filter(F.col('n') >= LEAST_COUNT))

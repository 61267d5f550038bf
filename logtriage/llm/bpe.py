"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a byte string the last token of its encoding is unique: it is the one
token ending there that follows on the encoding of what stands before it, i.e. the pair
(last token before it, it) would be left apart by the merges.  ``PrefixEncoding`` keeps
that token for each prefix, so appending goes on from the table, and an edit recomputes
only until the table agrees again with the one before, over the longest token's length.

Texts are cut by a pattern first and each match is encoded alone.  A match never spans the
border before a space that follows a solid character, so texts are split there and equal
pieces are encoded once per process (the memory of pieces is bounded).

Edge cases: null text is empty and has no tokens; ids and other columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_slices

#: Pieces remembered per process before the older half is forgotten.
REMEMBERED = 400_000


class Vocabulary:
    """Tokens by rank, and how each came about: its two parts in the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.tokens = [b''] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for t, r in ranks.items():
            if len(t) > 1:
                ids = self.merged(t, r)
                if len(ids) == 2:  # other tokens are never made by merging
                    self.parts[r] = self.joined_as(ids, r)
        self.apart: dict[tuple[int, int], bool] = {}
        # all tokens that end at a position, the longest first
        self.endings = ahocorasick.Automaton()
        for t, r in ranks.items():
            if len(t) == 1 or r in self.parts:
                self.endings.add_word(t.decode('latin-1'), (r, len(t)))
        self.endings.make_automaton()
        flat = b''.join(self.tokens)
        self.bytes = np.frombuffer(flat, np.uint8)
        self.ends = np.cumsum([len(t) for t in self.tokens])

    def joined_as(self, ids: list[int], rank: int) -> tuple[int, int]:
        pair = (ids[0], ids[1])
        self.joined[pair] = rank
        return pair

    def merged(self, data: bytes, below: float = float('inf')) -> list[int]:
        """Plain BPE: merge the leftmost pair of least rank, while it is under ``below``."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges that make ``a`` and ``b`` side by side never cross the border.

        The merges are undone from the last: the tokens that touched the border before it
        would have joined if their merge came earlier than the undone one (an equal rank
        goes to the left first).
        """
        known = self.apart.get((a, b))
        if known is not None:
            return known
        x, y, limit, ok = a, b, len(self.tokens) + 1, True
        while True:
            if self.joined.get((x, y), limit) < limit:
                ok = False
                break
            left, right = self.parts.get(x), self.parts.get(y)
            if left is None and right is None:
                break
            if right is None or left is not None and x > y:
                limit, x = x, left[1]
            else:
                limit, y = y + 1, right[0]
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[a, b] = ok
        return ok


class PrefixEncoding:
    """The encoding of one byte string as the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b''):
        self.vocabulary, self.data, self.last = vocabulary, b'', [-1]
        self.append(data)

    def _fill(self, at: int) -> Iterator[int]:
        """Finds the last token of the prefixes longer than ``at``; yields their lengths."""
        v, last = self.vocabulary, self.last
        known, apart = v.apart, v.stay_apart
        lo = max(0, at - v.longest)
        for end, (t, n) in v.endings.iter(self.data[lo:].decode('latin-1')):
            end += lo + 1
            if end <= at or len(last) > end:  # found already
                continue
            before = end - n
            if before:
                ok = known.get((last[before], t))
                if ok is None:
                    ok = apart(last[before], t)
                if not ok:
                    continue
            last.append(t)
            yield end

    def append(self, data: bytes) -> None:
        at = len(self.data)
        self.data += data
        for _ in self._fill(at):
            pass
        if len(self.last) <= len(self.data):
            raise ValueError('bytes that no token covers')

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of [start, stop); returns how many prefixes were recomputed."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[:start + 1]
        same = 0
        for end in self._fill(start):
            # the table before is comparable where the token lies behind the edit
            behind = end - len(self.vocabulary.tokens[self.last[-1]]) >= start + len(data)
            same = same + 1 if behind and self.last[-1] == old[end - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift + 1:]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


class Encoder:
    """Encodes texts by the ranks of a file and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, 'rb') as f:
            self.vocabulary = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern = regex.compile(pattern)
        self.unsafe = regex.compile(r'\s ')  # a space after white space: not a border
        self.matches: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, text: str) -> bytes:
        """The ids (int32) of a piece, remembered."""
        got = self.new.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None:
                got = self._encoded(text)
            if len(text) <= 64:
                if len(self.new) >= REMEMBERED // 2:
                    self.old, self.new = self.new, {}
                self.new[text] = got
        return got

    def _match(self, text: str) -> bytes:
        """The ids of one match of the pattern, remembered."""
        got = self.matches.get(text)
        if got is None:
            v, b = self.vocabulary, text.encode()
            whole = v.ranks.get(b)
            got = array('i', [whole] if whole is not None else PrefixEncoding(v, b).ids()).tobytes()
            if len(text) <= 64:
                if len(self.matches) >= REMEMBERED:
                    self.matches.clear()
                self.matches[text] = got
        return got

    def _encoded(self, text: str) -> bytes:
        return b''.join([self._match(m) for m in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes."""
        if self.unsafe.search(text):
            return self._encoded(text)
        head, *rest = text.split(' ')
        get, piece = self.new.get, self._piece
        return b''.join([piece(head), *[get(x) or piece(x) for x in [' ' + r for r in rest]]])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as one uint8 array."""
        end = self.vocabulary.ends[ids]
        size = end - np.where(ids > 0, self.vocabulary.ends[ids - 1], 0)
        at = np.cumsum(size) - size
        return self.vocabulary.bytes[np.arange(size.sum()) + np.repeat(end - size - at, size)]


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per process and file."""
    return Encoder(path, pattern)


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, f in enumerate(batch.schema) if f.name != name]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], column], [*[batch.schema.field(i).name for i in keep], name])


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for batch in batches:
        for lo, hi, data, off in text_slices(batch, max_bytes=2 << 20):
            raw = data.tobytes()
            ids = [own.encode(raw[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            sizes = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b''.join(ids), np.int32)))
            yield _with_column(batch.slice(lo, hi - lo), 'ids', column)


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index('ids'))
        values = [own.decode(np.asarray(x.values)).tobytes() if x.is_valid else None for x in lists]
        yield _with_column(batch, 'decoded', pa.array(values, pa.binary()))


def _plus(df: DataFrame, name: str, kind: str) -> str:
    return ', '.join([*[f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != name], f'{name} {kind}'])


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` plus ``ids`` (array<int>): the encoding of ``text``."""
    return docs.mapInArrow(partial(_encode, path=path, pattern=pattern), _plus(docs, 'ids', 'array<int>'))


def decode_ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``df`` plus ``decoded`` (binary): the bytes of ``ids`` (null stays null)."""
    return df.mapInArrow(partial(_decode, path=path, pattern=pattern), _plus(df, 'decoded', 'binary'))

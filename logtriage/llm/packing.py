"""Packing token sequences by vector bin packing with the dot-product heuristic.

Every text becomes ids, and pieces of it are placed into sequences of ``capacity`` tokens
under three limits at once: tokens, segments, and loss-bearing tokens (those from position
``prompt`` of a text on; its first token never bears loss).  A sequence takes the waiting
piece with the largest dot product of its demands and what is left of the sequence, as long
as one fits, and is then filled by cutting a piece.  Texts longer than a sequence give
whole sequences first.  What remains at the end of a partition is cut into sequences whose
lengths are powers of two, which need no padding.

A partition is packed by one pass over it with ``waiting`` pieces in memory, so nothing is
shuffled; sequence ids carry the partition number, and a repeated task gives the same rows
for the same rows in the same order.

Edge cases: null text is empty (it still gets the end token); null or repeated ids each
keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, lean, text_of, text_slices

#: Settings for instruction data: the first sixteenth of a text is its prompt, and a sequence holds
#: at most 2,000 loss-bearing tokens, so that none consists of answers alone.
INSTRUCTION = {'prompt_share': 1 / 16, 'loss': 2000}
#: Words remembered per process before all are forgotten.
REMEMBERED = 300_000


# ------------------------------------------------------------ fixed values
#: What a tokenizer file must say for its texts to be encoded word by word: white space parts
#: words and nothing else of a text bears on a word's ids, nor do letters on marks behind them.
NORMALIZERS = ['NFC', 'Replace', 'Lowercase']
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# -------------------------------------------------------------------------
_MARKS = ''.join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Words:
    """Ids of texts by a tokenizer file, without the special tokens that it would add.

    If the file parts texts at white space, letters and marks (``SPLIT``), words are encoded
    once while they are remembered: many unseen ones in one call, their ids told apart by the
    mark that ends a word's last token.  Texts that hold an added token, and all texts of other
    files, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ['TOKENIZERS_PARALLELISM'] = 'false'
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding='utf-8') as f:
            about = json.load(f)
        steps = (about.get('normalizer') or {}).get('normalizers', [])
        parts = (about.get('pre_tokenizer') or {}).get('pretokenizers', [{}])
        self.added = [a['content'] for a in about.get('added_tokens', [])]
        self.suffix = about['model'].get('end_of_word_suffix')
        self.by_word = ([x['type'] for x in steps] == NORMALIZERS and parts[0].get('pattern') == {'Regex': SPLIT} and parts[0].get('invert') is True
                        and bool(self.suffix) and not any(a.get('normalized') for a in about.get('added_tokens', [])))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.by_word:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True
        self.known: dict[str, bytes] = {'': b''}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return [self.whole(t) for t in texts.to_pylist()]
        parts = pc.split_pattern(pc.replace_substring(texts, '\n', ' '), ' ')
        words = parts.flatten().dictionary_encode()
        ids, size = self._found(words.dictionary)
        at = words.indices.to_numpy()
        flat, ends = gather(ids, (np.cumsum(size) - size)[at], size[at])
        first = parts.offsets.to_numpy()
        off = ends[first - first[0]]
        out = [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        for a in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, a).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.whole(texts[i].as_py())
        return out

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has; unseen ones are learned.

        A word of ASCII letters is parted from the marks behind it, and each half is looked up once.
        """
        if len(self.known) > REMEMBERED:
            self.known = {'': b''}
        base = pc.ascii_rtrim(words, _MARKS)
        plain = pc.ascii_is_alpha(base).to_numpy(zero_copy_only=False)
        letters = pc.ascii_lower(base.filter(pa.array(plain))).dictionary_encode()
        cut = pc.binary_length(base.filter(pa.array(plain))).to_numpy(zero_copy_only=False).tolist()
        marks = pa.array([w[n:] for w, n in zip(words.filter(pa.array(plain)).to_numpy(zero_copy_only=False).tolist(), cut, strict=True)], pa.string())
        marks = marks.dictionary_encode()
        heads, tails = letters.dictionary.to_numpy(zero_copy_only=False).tolist(), marks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn_words(set(heads))
        self._learn(set(tails))
        others = self._others(words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
        table = [b'', *map(self.known.__getitem__, heads), *map(self.known.__getitem__, tails), *others]
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        halves = np.zeros((len(words), 2), np.int64)  # rows of the table
        halves[plain, 0] = letters.indices.to_numpy() + 1
        halves[plain, 1] = marks.indices.to_numpy() + 1 + len(heads)
        halves[~plain, 0] = np.arange(len(others)) + 1 + len(heads) + len(tails)
        ids, _ = gather(np.frombuffer(b''.join(table), np.int32), (np.cumsum(size) - size)[halves].ravel(), size[halves].ravel())
        return ids, size[halves].sum(1)

    def _others(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        letters, others, marked, rest = set(), set(), [], []
        for k in [k for k, x in enumerate(out) if x is None]:
            p = words[k]
            base = p.rstrip(_MARKS)
            if base and base.isalpha():
                letters.add(base)
                marks = p[len(base):]
                others.add(marks)
                marked.append((k, base, marks))  # not remembered: made from the two again
            else:
                others.add(p)
                rest.append((k, p))
        self._learn_words(letters)
        self._learn(others)
        get = self.known.__getitem__
        for k, word, marks in marked:
            out[k] = get(word) + get(marks) if marks else get(word)
        for k, p in rest:
            out[k] = get(p)
        return out

    def _learn_words(self, some: set[str]) -> None:
        """Words of letters, each one token run with one end."""
        fresh = list(some.difference(self.known))
        groups = [fresh[lo:lo + 2000] for lo in range(0, len(fresh), 2000)]
        for lo in range(0, len(groups), 8):
            several = groups[lo:lo + 8]
            for group, e in zip(several, self.tokenizer.encode_batch_fast([' '.join(g) for g in several], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                at = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
                if len(at) != len(group) + 1:  # a letter that the normalizer takes apart
                    self._learn(set(group))
                    continue
                raw = ids.tobytes()
                self.known.update(zip(group, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))

    def _learn(self, some: set[str]) -> None:
        fresh = list(some.difference(self.known))
        for lo in range(0, len(fresh), 2000):
            part = fresh[lo:lo + 2000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = array('i', e.ids).tobytes()


@lru_cache(4)
def tokenizer(path: str) -> Words:
    return Words(path)


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int
    prompt: int

    def demand(self) -> tuple[int, int, int]:
        end = self.start + len(self.ids)
        return len(self.ids), 1, max(0, end - max(self.start, self.prompt, 1))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n], self.total, self.prompt),
                Piece(self.doc, self.start + n, self.ids[n:], self.total, self.prompt))

    def free(self) -> int:
        """Leading ids that bear no loss."""
        return max(0, max(self.prompt, 1) - self.start)

    def longest(self, tokens: int, loss: int) -> int:
        """How many of its ids fit into that many tokens and loss-bearing tokens."""
        return min(len(self.ids), tokens, self.free() + loss)


class Packer:
    """Packs pieces that arrive one by one; ``sequences`` yields (id, [pieces])."""

    def __init__(self, limits: tuple[int, int, int], waiting: int, first_id: int):
        self.limits, self.waiting, self.next_id = np.array(limits), waiting, first_id
        self.pool: list[Piece] = []
        self.demands = np.zeros((2 * waiting + 64, 3), np.int64)  # tokens, segments, loss-bearing tokens
        self.free = np.zeros(2 * waiting + 64, np.int64)  # leading tokens without loss

    def _add(self, p: Piece) -> None:
        n = len(self.pool)
        if n == len(self.demands):
            self.demands = np.concatenate([self.demands, np.zeros_like(self.demands)])
            self.free = np.concatenate([self.free, np.zeros_like(self.free)])
        self.demands[n], self.free[n] = p.demand(), p.free()
        self.pool.append(p)

    def _take(self, i: int) -> Piece:
        p, last = self.pool[i], self.pool.pop()
        if last is not p:
            self.pool[i] = last
            self.demands[i], self.free[i] = self.demands[len(self.pool)], self.free[len(self.pool)]
        return p

    def add(self, p: Piece) -> Iterator[tuple[int, list[Piece]]]:
        while True:  # whole sequences of one text
            n = p.longest(int(self.limits[0]), int(self.limits[2]))
            if n == len(p.ids):
                break
            whole, p = p.cut(n)
            if n == self.limits[0]:
                yield self._sequence([whole])
            else:
                self._add(whole)
        if len(p.ids) == self.limits[0]:
            yield self._sequence([p])
        elif len(p.ids):
            self._add(p)
        while len(self.pool) >= 2 * self.waiting:
            for _ in range(self.waiting // 8):
                yield self._sequence(self._fill(self.limits))

    def _sequence(self, pieces: list[Piece]) -> tuple[int, list[Piece]]:
        self.next_id += 1
        return self.next_id - 1, pieces

    def _fill(self, limits: np.ndarray) -> list[Piece]:
        left, out, weight = limits.tolist(), [], 1 / self.limits.astype(float) ** 2
        while self.pool and left[0] > 0 and left[1] > 0:
            n = len(self.pool)
            d, free = self.demands[:n], self.free[:n]
            fits = (d[:, 0] <= left[0]) & (d[:, 2] <= left[2])
            if left[1] == 1:  # the last segment: only a piece that fills it up, else cut one
                fits &= d[:, 0] == left[0]
            if fits.any():
                score = np.where(fits, d @ (weight * left), -1)
                out.append(self._take(int(score.argmax())))
            else:
                room = np.minimum(np.minimum(d[:, 0], left[0]), free + left[2])
                best = int(room.argmax())
                if room[best] == 0:
                    break
                head, rest = self._take(best).cut(int(room[best]))
                out.append(head)
                if len(rest.ids):
                    self._add(rest)
            left = [a - b for a, b in zip(left, out[-1].demand(), strict=True)]
        return out

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """Empty the pool: whole sequences, then sequences of powers of two."""
        while self.pool:
            tokens = int(self.demands[:len(self.pool), 0].sum())
            size = int(self.limits[0])
            if tokens < size:
                size = 1 << (tokens.bit_length() - 1)
            yield self._sequence(self._fill(np.array([size, *self.limits[1:]])))


FIELDS = [('start', pa.int64()), ('length', pa.int64()), ('ids_crc32', pa.int64()), ('doc_tokens', pa.int64()),
          ('sequence_id', pa.int64()), ('offset', pa.int64()), ('segment', pa.int64()), ('loss_tokens', pa.int64()), ('ids', pa.list_(pa.int32()))]
DDL = ('start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, '
       'loss_tokens long, ids array<int>')


@lean
def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limits: tuple, waiting: int, share: float, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words = tokenizer(path)
    packer = Packer(limits, waiting, TaskContext.get().partitionId() << 33)
    end = np.int32(end_id)
    rows: list[tuple] = []

    def note(sequences):
        for sid, pieces in sequences:
            at = 0
            for k, p in enumerate(pieces):
                raw = np.ascontiguousarray(p.ids).astype('<i4').tobytes()
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(raw), p.total, sid, at, k, p.demand()[2], p.ids if with_ids else None))
                at += len(p.ids)

    def batch_of():
        names = ['doc_id', *[n for n, _ in FIELDS]]
        kinds = [pa.int64(), *[t for _, t in FIELDS]]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        rows.clear()
        return out

    for batch in batches:
        ids, prompts = batch.column('doc_id').to_pylist(), batch.column('prompt').to_pylist()
        column = batch.column('text')
        for lo, hi, _, _ in text_slices(batch):
            for i, x in zip(range(lo, hi), words.encode(column.slice(lo, hi - lo)), strict=True):
                own = np.append(x, end)
                note(packer.add(Piece(ids[i], 0, own, len(own), max(prompts[i] or 0, int(share * len(own))))))
            if rows:
                yield batch_of()
    note(packer.rest())
    if rows:
        yield batch_of()


def pack_texts(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, segments: int = 64,
               loss: int | None = None, prompt: str | None = None, prompt_share: float = 0.0, waiting: int = 512, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    segment (its number in the sequence), loss_tokens and, with ``with_ids``, its ids.

    ``prompt`` names a column with the number of leading tokens that bear no loss, at least the
    first ``prompt_share`` of a text's tokens (rounded down) bear none;
    ``segments`` and ``loss`` (default: ``capacity``) limit a sequence like ``capacity`` does.
    """
    limits = (capacity, segments, capacity if loss is None else loss)
    if min(limits) < 1:
        raise ValueError('limits are at least 1')
    t = docs.select(F.col('doc_id').cast('long').alias('doc_id'), text_of().alias('text'),
                    (F.col(prompt).cast('int') if prompt else F.lit(0)).alias('prompt'))
    out = t.mapInArrow(partial(_pack, path=path, end_id=end_id, limits=limits, waiting=waiting, share=prompt_share, with_ids=with_ids), f'doc_id long, {DDL}')
    return out if with_ids else out.drop('ids')

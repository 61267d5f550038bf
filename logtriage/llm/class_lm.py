"""Scoring by a Brown class-based bigram model with exchange clustering.

P(text) is the product over its words and one end mark of P(class | class before) *
P(word | class).  The ``top`` most frequent words are put into ``classes`` classes by the
exchange algorithm on their bigram counts: a word moves to the class that raises the
likelihood of the class bigrams most, until no pass moves many.  Every other training word
takes one exchange step against these classes: from the counts of the classes before and
after it (words outside the ``top`` are one class there) it goes to a second copy of the
class that raises the likelihood most.  Words unseen in training go to the copy of the class
whose frequent words are spelled most like them (naive Bayes over byte pairs).  Class
bigrams are smoothed with class unigrams; a class of rare words keeps mass for one unknown
word, by its number of words seen once.

All counts cover all training documents.  What is held by the driver or sent to every task
does not grow with the corpus: ``top`` words, their bigrams, and the class tables.  Counts,
contexts and classes of all words stay in hash buckets: chunks of documents ask the buckets for the counts of
their distinct words, and the answers meet the documents again in the chunk.

Edge cases: null text is empty (one token, the end mark); a null ``doc_id`` hashes like an
empty id and is trained on; repeated rows count each time and get equal scores; an empty
table gives an empty result; other columns are ignored.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, text_slices, written
from .hashing import mix, prefix_sums, range_hashes, words

U = np.uint64
#: The end mark, as a word that no text can hold (and the begin mark, as a class only).
END = mix(np.array([0x0E4D], U))[0]
TOP, CLASSES = 2000, 32
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
FEATURES = 4096


def tokens_of(data: np.ndarray, off: np.ndarray):
    """(hash, start, end, first): the words of each text, each text followed by the end
    mark; text i has the tokens first[i]:first[i + 1]."""
    starts, ends, first = words(data, off)
    h = range_hashes(prefix_sums(data, fold_case=True), starts, ends)
    at = first[1:]
    return np.insert(h, at, END), np.insert(starts, at, 0), np.insert(ends, at, 0), first + np.arange(len(first))


def _binary_rows(names: list, rows: list) -> pa.RecordBatch:
    """Rows of ints and bytes as an Arrow batch (ints are 32-bit)."""
    kinds = [pa.binary() if rows and isinstance(rows[0][i], bytes) else pa.int32() for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _by_bucket(h: np.ndarray, buckets: int):
    """Order of the hashes by (bucket, hash), the buckets and their borders."""
    b = ((h >> U(40)) % U(buckets)).astype(np.int64)
    order = np.lexsort((h, b))
    b = b[order]
    cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
    return order, b, cut


def _added(hashes: np.ndarray, counts: np.ndarray):
    order = np.argsort(hashes, kind='stable')
    h, c = hashes[order], counts[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[start], np.add.reduceat(c, start) if len(h) else c


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Word counts of the training rows, packed by bucket."""
    for batch in batches:
        got = []
        for _, _, data, off in text_slices(batch):
            h, _, _, _ = tokens_of(data, off)
            got.append(_added(h, np.ones(len(h), np.int64)))
        if not got:
            continue
        h, c = _added(*(np.concatenate([g[i] for g in got]) for i in (0, 1)))
        order, b, cut = _by_bucket(h, buckets)
        h, c = h[order], c[order]
        yield _binary_rows(['bucket', 'words', 'counts'], [(int(b[lo]), h[lo:hi].tobytes(), c[lo:hi].astype(np.uint32).tobytes())
                                                          for lo, hi in zip(cut[:-1], cut[1:], strict=True)])


def _cat(column, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column]])


def _sum_bucket(table: pa.Table, top: int) -> pa.Table:
    """One row per bucket: its words and counts, and the hashes and counts of its ``top``."""
    h, c = _added(_cat(table.column('words'), U), _cat(table.column('counts'), np.uint32).astype(np.int64))
    best = np.lexsort((h, -c))[:top]
    return pa.table({'bucket': pa.array([table.column('bucket')[0].as_py()], pa.int32()), 'words': [h.tobytes()], 'counts': [c.tobytes()],
                     'n': pa.array([int(c.sum())], pa.int64()), 'v': pa.array([len(h)], pa.int64()),
                     'top_words': [h[best].tobytes()], 'top_counts': [c[best].tobytes()]})


def _unpack_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({'word': _cat(b.column('top_words'), np.int64), 'n': _cat(b.column('top_counts'), np.int64)})


PAIRS = 'part int, cells binary, counts binary, words binary, spelling binary'


def _pairs(batches: Iterator[pa.RecordBatch], tops: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bigram counts among the top words (index len(tops) stands for any other word) of a
    task, packed by the first word; and the spelling of the top words met."""
    size = len(tops) + 1
    rank = np.argsort(tops)
    ordered = tops[rank]
    table = np.zeros(size * size, np.int64)
    spelled: dict[int, bytes] = {}
    for batch in batches:
        for _, _, data, off in text_slices(batch):
            h, s, e, first = tokens_of(data, off)
            at = np.minimum(np.searchsorted(ordered, h), len(tops) - 1)
            w = np.where(ordered[at] == h, rank[at], len(tops))
            inner = np.ones(len(w) - 1, bool)
            inner[first[1:-1] - 1] = False  # from an end mark to the next text
            table += np.bincount((w[:-1] * size + w[1:])[inner], minlength=size * size)
            if len(spelled) < len(tops):
                for i, p in zip(*np.unique(w, return_index=True), strict=True):
                    if i < len(tops) and i not in spelled:
                        spelled[int(i)] = data[s[p]:e[p]].tobytes().lower()
    cells = np.flatnonzero(table)
    part = cells // size % 16
    rows = []
    for p in range(16):
        c = cells[part == p]
        own = [i for i in spelled if i % 16 == p]
        rows.append((p, c.tobytes(), table[c].tobytes(), np.array(own, np.int64).tobytes(), b' '.join(spelled[i] for i in own)))
    yield _binary_rows(['part', 'cells', 'counts', 'words', 'spelling'], rows)


def _sum_pairs(table: pa.Table) -> pa.Table:
    cells, counts = _added(_cat(table.column('cells'), U), _cat(table.column('counts'), np.int64))
    spelled: dict[int, bytes] = {}
    for w, t in zip(table.column('words'), table.column('spelling'), strict=True):
        own = np.frombuffer(w.as_buffer(), np.int64).tolist()
        spelled.update(zip(own, t.as_py().split(b' ') if len(own) else [], strict=True))
    return pa.table({'part': pa.array([table.column('part')[0].as_py()], pa.int32()), 'cells': [cells.tobytes()], 'counts': [counts.tobytes()],
                     'words': [np.array(list(spelled), np.int64).tobytes()], 'spelling': [b' '.join(spelled.values())]})


def exchange(pairs: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of the words of a bigram count matrix by the exchange algorithm.

    The last word stands for all others and keeps a class of its own (number ``classes``).
    Words start in the classes of their frequency ranks; in each round every word moves to
    the class with the highest sum of n log n over class bigrams less that over unigrams.
    """
    n = len(pairs)
    pairs = pairs.astype(float)
    cls = np.append(np.arange(n - 1) % classes, classes)
    k = classes + 1
    one = np.zeros((n, k))
    one[np.arange(n), cls] = 1
    big = one.T @ pairs @ one  # class bigrams
    after, before = pairs @ one, pairs.T @ one  # word -> class after it, class before it
    own = np.diag(pairs)
    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    for _ in range(rounds):
        moved = 0
        for w in range(n - 1):
            c = cls[w]
            r, l, d = after[w].copy(), before[w].copy(), own[w]
            # take w out of its class: its row and column of the class bigrams
            r[c] -= d
            l[c] -= d
            big[c] -= r
            big[:, c] -= l
            big[c, c] -= d
            # its neighbours stay first or second of a bigram, whatever its class
            row, col = big.sum(1) + l, big.sum(0) + r
            # gain of putting w into class x: row x, column x and the cell (x, x)
            fb = f(big)
            diag = np.diag(big)
            gain = (f(big + r[None, :]) - fb).sum(1) + (f(big + l[:, None]) - fb).sum(0)
            gain += f(diag + r + l + d) - f(diag + r) - f(diag + l) + f(diag)
            gain -= f(row + r.sum() + d) - f(row) + f(col + l.sum() + d) - f(col)
            gain[classes] = -np.inf
            x = int(np.argmax(gain)) if gain.max() > gain[c] + 1e-9 else c
            big[x] += r
            big[:, x] += l
            big[x, x] += d
            if x != c:
                after[:, c] -= pairs[:, w]
                after[:, x] += pairs[:, w]
                before[:, c] -= pairs[w]
                before[:, x] += pairs[w]
                cls[w] = x
                moved += 1
        if moved <= n // 200:
            break
    return cls


def step_classes(word: np.ndarray, ctx: np.ndarray, n: np.ndarray, size: int, big: np.ndarray) -> np.ndarray:
    """One exchange step for each of ``size`` words that stand in the last class: the class
    of the highest gain.

    Entries (word, context, count) are ordered by word; context j < k is the class after the
    word, k + j the class before.  ``big`` (k x k) holds the class bigrams with the words in
    the last class.
    """
    k = len(big)
    c = k - 1
    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    row, col, diag = big.sum(1)[:c], big.sum(0)[:c], np.diag(big)[:c]
    out = np.zeros(size, np.uint8)
    for lo in range(0, size, 4000):
        hi = min(lo + 4000, size)
        a, b = np.searchsorted(word, [lo, hi])
        w, x, m = word[a:b] - lo, ctx[a:b].astype(np.int64), n[a:b].astype(np.int64)
        d = np.zeros((hi - lo, 2 * k))
        d[w, x] = m
        r, l = d[:, :k], d[:, k:]
        gain = np.zeros((hi - lo, c))
        core = x % k < c
        if core.any():  # the same few (context, count) return in most words
            w, x, m = w[core], x[core], m[core]
            kinds, back = np.unique(m * (2 * k) + x, return_inverse=True)
            j, m = kinds % (2 * k), (kinds // (2 * k))[:, None]
            cells = np.where((j < k)[:, None], big[:c, j % k].T, big[j % k, :c])
            at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[at]] = np.add.reduceat((f(cells + m) - f(cells))[back], at, axis=0)
        # the word's own bigrams leave the cells of the last class
        rest = big[:c, c] - l[:, :c]
        gain += f(rest + r[:, c:]) - f(rest)
        rest = big[c, :c] - r[:, :c]
        gain += f(rest + l[:, c:]) - f(rest)
        gain += f(diag + r[:, :c] + l[:, :c]) - f(diag + r[:, :c]) - f(diag + l[:, :c]) + f(diag)
        gain -= f(row + r.sum(1)[:, None]) - f(row) + f(col + l.sum(1)[:, None]) - f(col)
        out[lo:hi] = gain.argmax(1)
    return out


def _contexts(batches: Iterator[pa.RecordBatch], model: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of (word, class after it or k + class before it) of the words outside the top,
    packed by bucket."""
    tops, k = model['words'], model['classes'] + 1
    for batch in batches:
        got = []
        for _, _, data, off in text_slices(batch):
            h, _, _, first = tokens_of(data, off)
            cls = np.full(len(h), k - 1)
            if len(tops):
                at = np.minimum(np.searchsorted(tops, h), len(tops) - 1)
                is_top = tops[at] == h
                cls[is_top] = model['class'][at[is_top]]
            else:
                is_top = np.zeros(len(h), bool)
            i = np.flatnonzero(~is_top & (h != END))  # an end mark follows every word
            begin = np.zeros(len(h), bool)
            begin[first[:-1]] = True
            j = i[~begin[i]]
            got.append((np.concatenate([h[i], h[j]]), np.concatenate([cls[i + 1], k + cls[j - 1]])))
        if not got:
            continue
        h, x = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        order = np.lexsort((x, h))
        h, x = h[order], x[order]
        start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]))) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(h)))
        h, x = h[start], x[start]
        order, b, cut = _by_bucket(h, buckets)
        h, x, n = h[order], x[order], n[order]
        rows = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = np.flatnonzero(np.append(True, h[lo + 1:hi] != h[lo:hi - 1]))
            rows.append((int(b[lo]), h[lo:hi][at].tobytes(), np.diff(np.append(at, hi - lo)).astype(np.uint8).tobytes(),
                         x[lo:hi].astype(np.uint8).tobytes(), n[lo:hi].astype(np.uint32).tobytes()))
        if rows:
            yield _binary_rows(['bucket', 'words', 'per', 'contexts', 'counts'], rows)


def _assign(seen: pa.Table, counts: pa.Table, big: np.ndarray) -> pa.Table:
    """A bucket's words and counts with the class of each by its contexts."""
    words, width = _cat(counts.column('words'), U), 2 * len(big)
    own = np.repeat(_cat(seen.column('words'), U), _cat(seen.column('per'), np.uint8))
    key = np.searchsorted(words, own) * width + _cat(seen.column('contexts'), np.uint8)
    key, n = _added(key, _cat(seen.column('counts'), np.uint32).astype(np.int64))
    kinds = step_classes(key // width, key % width, n, len(words), big)
    return pa.table({'bucket': counts.column('bucket'), 'words': counts.column('words'), 'counts': counts.column('counts'),
                     'kinds': pa.array([kinds.tobytes()], pa.binary())})


def byte_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Features of words: adjacent byte pairs, the borders being 0 (A-Z as a-z); and offsets."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    size = ends - starts + 1
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    at = np.repeat(starts, size) + step
    prev = np.where(step > 0, low[np.maximum(at - 1, 0)], 0)
    own = np.where(at < np.repeat(ends, size), low[np.minimum(at, len(low) - 1)], 0)
    return (prev * 0x9E37 + own * 0x85EB) % FEATURES, first


def spelling_model(spellings: list[bytes], cls: np.ndarray, classes: int) -> np.ndarray:
    """log P(byte pair | class), as a table of FEATURES rows."""
    counts = np.full((FEATURES, classes), 0.05)
    for s, c in zip(spellings, cls, strict=True):
        if s:
            x, _ = byte_pairs(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))
            np.add.at(counts, (x, c), 1)
    return np.log(counts / counts.sum(0)).astype(np.float32)


def word_classes(h: np.ndarray, data, starts, ends, model: dict, seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Class of each (distinct) word: learned for the top words, ``kinds`` for other words
    ``seen`` in training, by spelling for the rest."""
    c = model['classes']
    at = np.minimum(np.searchsorted(model['words'], h), len(model['words']) - 1)
    top = model['words'][at] == h if len(model['words']) else np.zeros(len(h), bool)
    out = np.empty(len(h), np.int64)
    out[top] = model['class'][at[top]]
    out[seen & ~top] = c + kinds[seen & ~top]
    rest = np.flatnonzero(~top & ~seen)
    for lo in range(0, len(rest), 50_000):
        some = rest[lo:lo + 50_000]
        x, first = byte_pairs(data, starts[some], ends[some])
        out[some] = c + np.add.reduceat(model['spelling'][x], first).argmax(1)
    out[h == END] = 2 * c
    return out


def _ask(table: pa.Table, buckets: int) -> pa.Table:
    """The distinct words of a chunk, packed by bucket."""
    got = [np.unique(tokens_of(data, off)[0]) for b in table.to_batches() for _, _, data, off in text_slices(b)]
    h = np.unique(np.concatenate([np.zeros(0, U), *got]))
    order, b, cut = _by_bucket(h, buckets)
    h, chunk = h[order], table.column('chunk')[0].as_py()
    return pa.Table.from_batches([_binary_rows(['bucket', 'chunk', 'words'], [(int(b[lo]), chunk, h[lo:hi].tobytes())
                                                                              for lo, hi in zip(cut[:-1], cut[1:], strict=True)])])


def _answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
    h, c, x = (_cat(counts.column(n), k) for n, k in (('words', U), ('counts', np.int64), ('kinds', np.uint8)))
    out = []
    for chunk, w in zip(asked.column('chunk').to_pylist(), asked.column('words'), strict=True):
        own = np.frombuffer(w.as_buffer(), U)
        at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
        n = np.where(h[at] == own, c[at], 0) if len(h) else np.zeros(len(own), np.int64)
        out.append((chunk, own.tobytes(), n.tobytes(), (x[at] if len(h) else np.zeros(len(own), np.uint8)).tobytes()))
    return pa.Table.from_batches([_binary_rows(['chunk', 'words', 'counts', 'kinds'], out)]) if out else pa.table(
        {'chunk': pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in ('words', 'counts', 'kinds')}})


STATS = ('doc_id long, th long, held_out boolean, n_tokens long, n_known long, log_counts double, log_plus double, '
         'cells binary, times binary, unknown binary, once binary')


def _stats(docs: pa.Table, answers: pa.Table, model: dict) -> pa.Table:
    """Per document: class bigram counts (cells of a square table, 2 * classes + 2 wide),
    unknown words and words seen once by class, and sums of log10 of the word counts."""
    k = 2 * model['classes'] + 2
    h, c, x = (_cat(answers.column(n), kind) for n, kind in (('words', U), ('counts', np.int64), ('kinds', np.uint8)))
    order = np.argsort(h)
    h, c, kinds = h[order], c[order], x[order]
    logs, plus = np.log10(np.maximum(c, 1)), np.log10(c + 1)
    cols: dict[str, list] = {n.split()[0]: [] for n in STATS.split(', ')}
    for batch in docs.to_batches():
        for lo, hi, data, off in text_slices(batch):
            w, s, e, first = tokens_of(data, off)
            own, at, back = np.unique(w, return_index=True, return_inverse=True)
            i = np.searchsorted(h, own)
            cls = word_classes(own, data, s[at], e[at], model, c[i] > 0, kinds[i])[back]
            i = i[back]
            n = c[i]
            size = np.diff(first)
            before = np.append(k - 1, cls[:-1])
            before[first[:-1]] = k - 1  # the begin mark
            doc = np.repeat(np.arange(hi - lo), size)
            key = np.sort((doc * k + before) * k + cls)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            cell, times = key[start], np.diff(np.append(start, len(key)))
            cut = np.searchsorted(cell, np.arange(hi - lo + 1) * k * k)
            rare = {'unknown': n == 0, 'once': n == 1}
            part = batch.slice(lo, hi - lo)
            for name in ('doc_id', 'th', 'held_out'):
                cols[name] += part.column(name).to_pylist()
            cols['n_tokens'] += size.tolist()
            for name, x in (('n_known', (n > 0).astype(np.int64)), ('log_counts', np.where(n > 0, logs[i], 0)), ('log_plus', plus[i])):
                cols[name] += np.add.reduceat(x, first[:-1]).tolist()
            for d in range(hi - lo):
                a, b = cut[d], cut[d + 1]
                cols['cells'].append((cell[a:b] % (k * k)).astype(np.uint16).tobytes())
                cols['times'].append(times[a:b].astype(np.uint32).tobytes())
                for name, flag in rare.items():
                    f = flag[first[d]:first[d + 1]]
                    cols[name].append(np.unique(cls[first[d]:first[d + 1]][f], return_counts=True)[0].astype(np.uint8).tobytes()
                                      + np.unique(cls[first[d]:first[d + 1]][f], return_counts=True)[1].astype(np.uint32).tobytes() if f.any() else b'')
    types = {'long': pa.int64(), 'boolean': pa.bool_(), 'double': pa.float64(), 'binary': pa.binary()}
    return pa.table({n: pa.array(cols[n], types[t]) for n, t in (x.split() for x in STATS.split(', '))})


def _by_class(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint8, n).astype(np.int64), np.frombuffer(raw[n:], np.uint32)


def _totals(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sums of a task over training rows: class bigrams, then words seen once by class."""
    table = np.zeros(k * k + k, np.int64)
    for b in batches:
        for cells, times, once, held in zip(b.column('cells'), b.column('times'), b.column('once'), b.column('held_out').to_pylist(), strict=True):
            if not held:
                table[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(times.as_buffer(), np.uint32)
                cls, n = _by_class(once.as_py())
                table[k * k + cls] += n
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict({'cell': at, 'n': table[at]})


def smoothed(table: np.ndarray, once: np.ndarray, classes: int):
    """(log10 P(class | class before), log10 of known mass / class size, log10 of unknown mass)."""
    k = len(table)
    n = table.sum(0)
    uni = n + 1.0
    uni[k - 1] = 0  # nothing is followed by the begin mark
    uni /= uni.sum()
    row = table.sum(1, keepdims=True)
    kinds = (table > 0).sum(1, keepdims=True) + 1  # Witten-Bell
    step = (table + kinds * uni) / (row + kinds)
    gap = np.where((np.arange(k) >= classes) & (np.arange(k) < 2 * classes), (once + 1) / (n + 2), 0)
    with np.errstate(divide='ignore'):
        return np.log10(step), np.where(n > 0, np.log10(1 - gap) - np.log10(np.maximum(n, 1)), 0.0), np.log10(gap)


SCORES = 'doc_id long, th long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double'


def _score(batches: Iterator[pa.RecordBatch], step, known, gap, n: int, v: int) -> Iterator[pa.RecordBatch]:
    k = len(known)
    flat = step.ravel()
    for b in batches:
        out = []
        for cells, times, unknown, logs in zip(b.column('cells'), b.column('times'), b.column('unknown'), b.column('log_counts').to_pylist(), strict=True):
            cell, t = np.frombuffer(cells.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64)
            own = np.bincount(cell % k, t, minlength=k)
            cls, m = _by_class(unknown.as_py())
            own[cls] -= m
            used = own > 0
            out.append(float(flat[cell] @ t) + logs + float(own[used] @ known[used]) + float(gap[cls] @ m))
        score = np.array(out)
        size = b.column('n_tokens').to_numpy()
        base = b.column('log_plus').to_numpy() - size * np.log10(n + v + 1)
        yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in ('doc_id', 'th', 'held_out', 'n_tokens', 'n_known')},
                                          'train_tokens': np.full(len(b), n), 'base_score': base, 'score': score,
                                          'perplexity': 10 ** np.minimum(-score / np.maximum(size, 1), 300)})


def score_texts(docs: DataFrame, held_out, top: int = TOP, classes: int = CLASSES) -> DataFrame:
    """Per row: doc_id, th, held_out, n_tokens, n_known, train_tokens, base_score (smoothed
    unigrams), score (log10 probability) and perplexity.  ``held_out``: a Column over the
    documents; rows where it holds are scored but not trained on."""
    spark = docs.sparkSession
    k = keyed(docs.withColumn('_held', F.coalesce(held_out, F.lit(False))))
    flags = docs.select(F.col('doc_id').cast('long').alias('doc_id'), F.coalesce(F.col('text').cast('string'), F.lit('')).alias('text'),
                        F.coalesce(held_out, F.lit(False)).alias('held_out')).withColumn('th', F.xxhash64('text'))
    total = k.agg(F.sum(F.octet_length('text'))).first()[0] or 0
    chunks, buckets = int(max(1, total // CHUNK_BYTES)), int(max(1, total // BUCKET_BYTES))
    train = flags.filter(~F.col('held_out')).select('text')
    counts = train.mapInArrow(partial(_count, buckets=buckets), 'bucket int, words binary, counts binary')
    counts = written(counts.groupBy('bucket').applyInArrow(
        lambda t: _sum_bucket(t, top), 'bucket int, words binary, counts binary, n long, v long, top_words binary, top_counts binary'), 'counts')
    n, v = counts.agg(F.coalesce(F.sum('n'), F.lit(0)), F.coalesce(F.sum('v'), F.lit(0))).first()
    best = (counts.select('top_words', 'top_counts').mapInArrow(_unpack_top, 'word long, n long')
            .orderBy(F.desc('n'), 'word').limit(top).collect())
    tops = np.array([r.word for r in best if r.word != END.view(np.int64)], np.int64).view(U)
    model = {'classes': classes, 'words': tops, 'class': np.zeros(0, np.int64), 'spelling': np.zeros((FEATURES, classes), np.float32)}
    big = np.zeros((classes + 1, classes + 1))
    if len(tops):
        learned, big = _learned(train, tops, classes)
        model |= learned
    kinds = written(_kinds(train, counts, model, big, buckets), 'kinds')

    t = flags.withColumn('chunk', F.pmod(F.xxhash64('doc_id', 'th'), F.lit(chunks)).cast('int'))
    own = t.groupBy('chunk')
    asked = own.applyInArrow(lambda x: _ask(x, buckets), 'bucket int, chunk int, words binary')
    answers = asked.groupBy('bucket').cogroup(kinds.groupBy('bucket')).applyInArrow(
        _answer, 'chunk int, words binary, counts binary, kinds binary')
    stats = written(own.cogroup(answers.groupBy('chunk')).applyInArrow(lambda x, y: _stats(x, y, model), STATS), 'lm-stats')

    width = 2 * classes + 2
    sums = stats.select('cells', 'times', 'once', 'held_out').mapInArrow(partial(_totals, k=width), 'cell long, n long').groupBy('cell').agg(F.sum('n').alias('n'))
    table = np.zeros(width * width + width)
    for r in sums.collect():  # width * (width + 1) rows at most
        table[r.cell] = r.n
    step, known, gap = smoothed(table[:width * width].reshape(width, width), table[width * width:], classes)
    return stats.mapInArrow(partial(_score, step=step, known=known, gap=gap, n=int(n), v=int(v)), SCORES)


def _kinds(train: DataFrame, counts: DataFrame, model: dict, big: np.ndarray, buckets: int) -> DataFrame:
    """The buckets of ``counts`` with the class of each word by its contexts in all training rows."""
    seen = train.mapInArrow(partial(_contexts, model=model, buckets=buckets), 'bucket int, words binary, per binary, contexts binary, counts binary')
    return seen.groupBy('bucket').cogroup(counts.select('bucket', 'words', 'counts').groupBy('bucket')).applyInArrow(
        lambda x, y: _assign(x, y, big), 'bucket int, words binary, counts binary, kinds binary')


def _learned(train: DataFrame, tops: np.ndarray, classes: int) -> tuple[dict, np.ndarray]:
    """Classes and spelling model of the top words, from their bigrams in all training rows;
    and the bigrams of the classes, other words being the last one."""
    size = len(tops) + 1
    pairs = np.zeros(size * size)
    spelling = [b''] * len(tops)
    for r in train.mapInArrow(partial(_pairs, tops=tops), PAIRS).groupBy('part').applyInArrow(_sum_pairs, PAIRS).collect():  # (top + 1)**2 counts
        pairs[np.frombuffer(r.cells, np.int64)] = np.frombuffer(r.counts, np.int64)
        for i, s in zip(np.frombuffer(r.words, np.int64).tolist(), bytes(r.spelling).split(b' '), strict=False):
            spelling[i] = s
    cls = exchange(pairs.reshape(size, size), classes)
    one = np.zeros((size, classes + 1))
    one[np.arange(size), cls] = 1
    big = one.T @ pairs.reshape(size, size) @ one
    cls, order = cls[:-1], np.argsort(tops)
    return {'words': tops[order], 'class': cls[order], 'spelling': spelling_model(spelling, cls, classes)}, big

"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (``passage`` words each).  A passage is encoded as the
shares of character kinds, length and repetition measures and hashed words (A-Z as a-z),
then h = tanh(W x + b).  Gated attention gives each passage the weight a_i proportional to
exp(u . (tanh(V h_i) * sigmoid(G h_i))); the document is z = sum a_i h_i and its score
sigmoid(c . z + d).  Only the documents' labels are needed to learn all of it.

The network is fitted on at most ``fit_rows`` labelled documents (the least hashes of their
ids), a documented bound, so the fit runs on the driver; every passage of every text is
scored.  Only the text enters a score.

Edge cases: null or empty text is one passage without words; null labels are left out of
the fit; without labelled rows of both kinds every score is 0.5; repeated rows each get
their result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, text_slices
from .hashing import U, mix, prefix_sums, range_hashes, words

FIT_ROWS, PASSAGE, HASHED, HIDDEN, GATE = 6000, 64, 128, 32, 16
KINDS = 7
MEASURES = KINDS + 6

#: Kind of a byte: lower, upper, digit, space, line end, other ASCII, non-ASCII.
_KIND = np.full(256, 5, np.int8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 0, 1, 2, 3, 4, 6


def passages(data: np.ndarray, off: np.ndarray, size: int = PASSAGE):
    """(features, first): a row for each passage; text i has the rows first[i]:first[i + 1]."""
    s, e, w_first = words(data, off)
    n = np.diff(w_first)
    count = np.maximum(-(-n // size), 1)
    first = np.append(0, np.cumsum(count))
    rows = int(first[-1])
    h = range_hashes(prefix_sums(data, fold_case=True), s, e)
    doc = np.repeat(np.arange(len(n)), n)
    at = first[doc] + (np.arange(len(s)) - w_first[doc]) // size  # passage of each word
    length = (e - s).astype(float)
    per = np.bincount(at, minlength=rows).astype(float)
    x = np.zeros((rows, MEASURES + HASHED), np.float32)
    # a text's bytes belong to its passages, from a passage's first word to the next one's
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    head = head[at[head] > first[doc[head]]]
    begin, whose = np.concatenate([off[:-1], s[head]]), np.concatenate([first[:-1], at[head]])
    order = np.lexsort((whose, begin))
    owner = np.repeat(whose[order], np.diff(np.append(begin[order], len(data))))
    kinds = np.bincount(owner * KINDS + _KIND[data], minlength=rows * KINDS).reshape(rows, KINDS)
    x[:, :KINDS] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    full = np.maximum(per, 1)
    mean = np.bincount(at, length, minlength=rows) / full
    x[:, KINDS] = mean / 10
    x[:, KINDS + 1] = np.sqrt(np.maximum(np.bincount(at, length ** 2, minlength=rows) / full - mean ** 2, 0)) / 10
    x[:, KINDS + 2] = per / size

    def distinct(key, place):
        order = np.lexsort((key, place))
        k, p = key[order], place[order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])) if len(k) else np.zeros(0, bool)
        return np.bincount(p[fresh], minlength=rows)

    x[:, KINDS + 3] = (per - distinct(h, at)) / full
    if len(h) > 1:
        same = at[1:] == at[:-1]
        pair = mix(h[:-1] * U(3) + h[1:])[same]
        x[:, KINDS + 4] = (np.maximum(per - 1, 0) - distinct(pair, at[:-1][same])) / np.maximum(per - 1, 1)
        x[:, KINDS + 5] = np.bincount(at[1:], same & (h[1:] == h[:-1]), minlength=rows) / full
    cells = np.bincount(at * HASHED + (h >> U(40)).astype(np.int64) % HASHED, minlength=rows * HASHED).reshape(rows, HASHED)
    x[:, MEASURES:] = cells / np.sqrt(full)[:, None]
    return x, first


def _examples(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in text_slices(b):
            x, first = passages(data, off, size)
            rows = [x[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column('doc_id').slice(lo, hi - lo), b.column('quality').slice(lo, hi - lo), pa.array(rows, pa.binary())],
                                             ['doc_id', 'quality', 'x'])


SHAPES = {'W': (MEASURES + HASHED, HIDDEN), 'b': (HIDDEN,), 'V': (HIDDEN, GATE), 'G': (HIDDEN, GATE), 'u': (GATE,), 'c': (HIDDEN,), 'd': (1,)}


def _forward(p: dict, x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ p['W'] + p['b'])
    t, g = np.tanh(h @ p['V']), 1 / (1 + np.exp(-np.clip(h @ p['G'], -30, 30)))
    raw = (t * g) @ p['u']
    size = np.diff(first)
    top = np.maximum.reduceat(raw, first[:-1])
    a = np.exp(raw - np.repeat(top, size))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), size)
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ p['c'] + p['d'][0], -30, 30)))
    return h, t, g, a, z, y


def _gradient(p: dict, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict:
    h, t, g, a, z, y = _forward(p, x, first)
    size = np.diff(first)
    e = (y - label) / len(label)
    dz = np.repeat(e[:, None] * p['c'], size, axis=0)
    da = (dz * h).sum(1)
    draw = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
    dt, dg = draw[:, None] * p['u'] * g * (1 - t * t), draw[:, None] * p['u'] * t * g * (1 - g)
    dh = a[:, None] * dz + dt @ p['V'].T + dg @ p['G'].T
    dw = dh * (1 - h * h)
    return {'W': x.T @ dw, 'b': dw.sum(0), 'V': h.T @ dt, 'G': h.T @ dg, 'u': (t * g).T @ draw, 'c': z.T @ e, 'd': np.array([e.sum()])}


def train(bags: list[np.ndarray], label: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.003, seed: int = 7) -> dict:
    """Network parameters by Adam over mini-batches of documents, in a fixed order."""
    rng = np.random.default_rng(seed)
    p = {n: rng.normal(0, 1 / np.sqrt(s[0]), s) if n not in 'bd' else np.zeros(s) for n, s in SHAPES.items()}
    m, v, step = {n: 0.0 for n in p}, {n: 0.0 for n in p}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            own = order[lo:lo + batch]
            first = np.append(0, np.cumsum([len(bags[i]) for i in own]))
            grad = _gradient(p, np.concatenate([bags[i] for i in own]).astype(float), first, label[own])
            step += 1
            for n, g in grad.items():
                g = g + 1e-4 * p[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                p[n] = p[n] - rate * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(v[n] / (1 - 0.999 ** step)) + 1e-8)
    return p


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, size: int = PASSAGE) -> dict | None:
    """Parameters learned from labelled documents; None without labels of both kinds.
    ``labels`` holds the rows that may be used (doc_id, quality)."""
    ids = (labels.filter('doc_id is not null and quality in (0, 1)').groupBy(F.col('doc_id').cast('long').alias('doc_id'))
           .agg(F.max('quality').cast('int').alias('quality')).orderBy(F.xxhash64('doc_id'), 'doc_id').limit(fit_rows))
    bags = keyed(docs).join(F.broadcast(ids), 'doc_id').select('doc_id', 'text', 'quality')  # fit_rows ids
    got = bags.mapInArrow(partial(_examples, size=size), 'doc_id long, quality int, x binary').collect()  # fit_rows documents
    got.sort(key=lambda r: (r.doc_id, r.x))
    label = np.array([r.quality for r in got], float)
    if len(set(label)) < 2:
        return None
    return train([np.frombuffer(r.x, np.float32).reshape(-1, MEASURES + HASHED) for r in got], label)


def _score(batches: Iterator[pa.RecordBatch], model: dict | None, size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in text_slices(b):
            x, first = passages(data, off, size)
            if model is None:
                y, top = np.full(hi - lo, 0.5), np.zeros(hi - lo)
            else:
                *_, a, _, y = _forward(model, x.astype(float), first)
                top = np.maximum.reduceat(a, first[:-1])
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column('doc_id'), pa.array(y), pa.array(np.diff(first)), pa.array(top)],
                                             ['doc_id', 'score', 'n_passages', 'top_attention'])


def score_texts(docs: DataFrame, model: dict | None, size: int = PASSAGE) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: label 1 likelier), n_passages, top_attention."""
    return keyed(docs).mapInArrow(partial(_score, model=model, size=size), 'doc_id long, score double, n_passages long, top_attention double')

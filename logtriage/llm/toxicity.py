"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(b_k - w.x) with ordered thresholds b_0 < b_1 < ... and one
weight vector w for all of them.  Features are the words of a text (runs of letters, A-Z as
a-z) with weight 1 + log(count).  Output is the expected grade, the most likely grade, and
the probability of any grade above 0.

Grades.  Labels say toxic or not.  Grade 0 is not toxic; toxic documents get grades 1 to
``grades`` by equal shares of their number of indicative words (those whose log odds for
toxic documents stand out most), so the thresholds separate mild from severe.

The model is fitted on at most ``fit_rows`` labelled documents (the least hashes of their
ids) and ``features`` words; both are documented bounds, so the fit runs on the driver.
Every document is scored.

Edge cases: null or empty text has no features and gets the grade of w.x = 0; null labels
are left out of the fit; without labelled rows of both kinds every document gets grade 0;
repeated rows each get their result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, lean, renamed, text_slices, written
from .hashing import U, letter_runs, mix, prefix_sums, range_hashes

FIT_ROWS, FEATURES, GRADES = 8000, 2000, 3
#: Log odds (in standard deviations) a feature needs.
LEAST_Z = 2.5
#: Beginnings of words that are features, in bytes: languages inflect the ends.
PREFIXES = (5, 6, 7, 8)
#: Documents with a higher probability of any toxic grade are rejected.
REJECT = 0.5


def _features(data: np.ndarray, off: np.ndarray):
    """(row, word hash, count) of the distinct words of each text, ordered by row and hash."""
    s, e = letter_runs(data, off)
    sums = prefix_sums(data, fold_case=True)
    parts, rows = [range_hashes(sums, s, e)], [np.searchsorted(off, s, 'right') - 1]
    for n in PREFIXES:
        long = np.flatnonzero(e - s > n)
        parts.append(mix(range_hashes(sums, s[long], s[long] + n) + U(n)))
        rows.append(rows[0][long])
    h, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return row[start], h[start], np.diff(np.append(start, len(h)))


@lean
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in text_slices(b):
            row, h, n = _features(data, off)
            at = pa.array(lo + row)
            yield pa.RecordBatch.from_arrays([b.column('doc_id').take(at), b.column('toxic').take(at), pa.array(h.view(np.int64)), pa.array(n)],
                                             ['doc_id', 'toxic', 'word', 'n'])


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``fit_rows`` labelled documents."""
    ids = (labels.filter('doc_id is not null and toxic in (0, 1)').groupBy(F.col('doc_id').cast('long').alias('doc_id'))
           .agg(F.max('toxic').cast('int').alias('toxic')).orderBy(F.xxhash64('doc_id'), 'doc_id').limit(fit_rows))
    return keyed(docs).join(F.broadcast(ids), 'doc_id').select('doc_id', 'text', 'toxic')  # fit_rows ids


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES, grades: int = GRADES) -> dict:
    """{'words': sorted hashes, 'weights', 'thresholds'}."""
    words = written(labelled(docs, labels, fit_rows).mapInArrow(_rows, 'doc_id long, toxic int, word long, n long'), 'toxic-words')
    totals = {r.toxic: r.n for r in words.groupBy('toxic').agg(F.count_distinct('doc_id').alias('n')).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    none = {'words': np.zeros(0, U), 'weights': np.zeros(0), 'thresholds': np.full(1, 30.0)}
    if not n1 or not n0:
        return none
    # log odds of a word's presence, in standard deviations
    a, b = F.count(F.when(F.col('toxic') == 1, 1)), F.count(F.when(F.col('toxic') == 0, 1))
    odds = F.log((F.col('a') + 0.5) / (n1 - F.col('a') + 0.5)) - F.log((F.col('b') + 0.5) / (n0 - F.col('b') + 0.5))
    best = words.groupBy('word').agg(a.alias('a'), b.alias('b')).withColumn('z', odds / F.sqrt(1 / (F.col('a') + 0.5) + 1 / (F.col('b') + 0.5)))
    best = best.filter(F.abs('z') >= LEAST_Z).orderBy(F.abs('z').desc(), 'word').limit(features).select('word', 'z').collect()
    if not best:
        return none
    chosen = {r.word: r.z for r in best}
    strong = max(3.0, 0.5 * max(chosen.values()))
    x = words.filter(F.col('word').isin(list(chosen))).select('doc_id', 'word', 'n').toPandas()  # fit_rows documents, ``features`` words
    y = words.select('doc_id', 'toxic').distinct().toPandas().sort_values('doc_id')
    order = np.array(sorted(chosen), np.int64)
    row, col = np.searchsorted(y.doc_id.to_numpy(), x.doc_id.to_numpy()), np.searchsorted(order, x.word.to_numpy())
    value, toxic = 1 + np.log(x.n.to_numpy()), y.toxic.to_numpy()
    z = np.array([chosen[w] for w in order.tolist()])
    level = np.bincount(row[z[col] >= strong], x.n.to_numpy()[z[col] >= strong], minlength=len(y))
    cuts = np.unique(np.quantile(level[toxic == 1], np.arange(1, grades) / grades, method='nearest'))
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, level, 'right'), 0)
    _, grade = np.unique(grade, return_inverse=True)  # without empty grades
    w, b = cumulative_link(row, col, value, grade, len(order))
    by_hash = np.argsort(order.view(U))
    return {'words': order.view(U)[by_hash], 'weights': w[by_hash], 'thresholds': b}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cumulative_link(row, col, value, grade, n_features: int, penalty: float = 2e-5, steps: int = 600, rate: float = 0.05):
    """Weights and ordered thresholds by gradient steps (Adam) on the mean log-likelihood
    with an L2 penalty.  Thresholds are the first one plus sums of exponentials."""
    n, k = len(grade), int(grade.max())
    w = np.zeros(n_features)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    b = np.log(share / (1 - share))
    p = np.concatenate([w, b[:1], np.log(np.maximum(np.diff(b), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, steps_up = p[:n_features], np.exp(p[n_features + 1:])
        b = np.concatenate([[-np.inf], p[n_features] + np.concatenate([[0], np.cumsum(steps_up)]), [np.inf]])
        eta = np.bincount(row, value * w[col], minlength=n)
        hi, lo = _sigmoid(b[grade + 1] - eta), _sigmoid(b[grade] - eta)
        hi[grade == k], lo[grade == 0] = 1, 0
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_eta = (d_hi - d_lo) / n  # of the negative log-likelihood
        g_b = (np.bincount(grade, -d_hi, minlength=k + 1)[:-1] + np.bincount(grade, d_lo, minlength=k + 1)[1:]) / n
        g = np.concatenate([np.bincount(col, value * g_eta[row], minlength=n_features) + penalty * w,
                            [g_b.sum()], np.cumsum(g_b[::-1])[::-1][1:] * steps_up])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1:]))])


def _above(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """P(grade > k) of each text, a column for each k."""
    words, eta = model['words'], np.zeros(len(off) - 1)
    if len(words):
        row, h, n = _features(data, off)
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        eta = np.bincount(row[hit], (1 + np.log(n[hit])) * model['weights'][at[hit]], minlength=len(eta))
    return 1 - _sigmoid(model['thresholds'][None, :] - eta[:, None])


@lean
def _keep(batches: Iterator[pa.RecordBatch], model: dict, text: str, reject: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_slices(batch, text):
            yield batch.slice(lo, hi - lo).filter(pa.array(_above(data, off, model)[:, 0] <= reject))


@lean
def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_slices(batch):
            above = _above(data, off, model)
            each = np.concatenate([np.ones((hi - lo, 1)), above], 1) - np.concatenate([above, np.zeros((hi - lo, 1))], 1)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column('doc_id'), part.column('th'), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0])],
                                             ['doc_id', 'th', 'severity', 'grade', 'p_toxic'])


def grade_texts(docs: DataFrame, model: dict, reject: float = REJECT) -> DataFrame:
    """Per row: doc_id, th, severity (expected grade), grade, p_toxic, toxic (rejected)."""
    out = keyed(docs).mapInArrow(partial(_score, model=model), 'doc_id long, th long, severity double, grade int, p_toxic double')
    return out.withColumn('toxic', F.col('p_toxic') > reject)


def drop_toxic(docs: DataFrame, model: dict, reject: float = REJECT) -> DataFrame:
    """The rows that are not rejected, with their columns."""
    rows, _, text = renamed(docs)
    rows = rows.drop('_id', '_th')
    return rows.mapInArrow(partial(_keep, model=model, text=text, reject=reject), rows.schema).toDF(*docs.columns)

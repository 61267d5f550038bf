"""Text classifier against a plain loop, vocabularies against plain counts."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logtriage.models import text as T
from logtriage.operators import features as D

WORDS = 'alpha beta gamma delta omega kappa sigma lambda theta zeta'.split()


def docs(spark, n=240):
    rows = []
    for i in range(n):
        words = [WORDS[(i * 7 + k * k) % 10] for k in range(3 + i % 9)] + (['good'] if i % 3 == 0 else ['bad'] * (i % 2))
        rows.append((i, None if i % 41 == 40 else ' '.join(words), None if i % 37 == 36 else int(i % 3 == 0)))
    return spark.createDataFrame(rows, 'doc_id long, text string, label int')


def test_epochs_equal_a_plain_loop(spark):
    df = docs(spark)
    model = T.fit_text(df, epochs=3, batches=4)
    batch = F.pmod(T.hex15(T.hash_key(['_key'], 42, 'batch')), F.lit(4))
    rows = df.filter('label is not null').withColumn('_key', F.col('doc_id').cast('string')).withColumn('b', batch).orderBy('doc_id').collect()
    terms = sorted(t for t, n in Counter(w for r in rows for w in set((r.text or '').split())).items() if n >= 2)
    df_of = Counter(w for r in rows for w in set((r.text or '').split()))
    assert list(model.terms) == terms
    x = np.zeros((len(rows), len(terms) + 1))
    for i, r in enumerate(rows):
        for t, n in Counter((r.text or '').split()).items():
            if t in model.terms:
                x[i, model.terms[t]] = (1 + np.log(n)) * (np.log((1 + len(rows)) / (1 + df_of[t])) + 1)
        norm = np.sqrt((x[i] ** 2).sum())
        x[i] /= norm if norm else 1
    x[:, -1] = 1
    y, b = np.array([r.label for r in rows], float), np.array([r.b for r in rows])
    w, m1, m2, step, losses = np.zeros(x.shape[1]), 0.0, 0.0, 0, []
    for _ in range(3):
        total = 0.0
        for k in range(4):
            xb, yb = x[b == k], y[b == k]
            z = xb @ w
            total += np.logaddexp(0, np.where(yb == 1, -z, z)).sum()
            g = xb.T @ (1 / (1 + np.exp(-z)) - yb) / len(yb) + 1e-4 * np.append(w[:-1], 0)
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - 0.05 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        losses.append(total / len(y))
    assert np.allclose(model.losses, losses, atol=1e-9) and np.allclose([*model.weights, model.bias], w, atol=1e-9)


def test_held_out_scores_and_reloading(spark, tmp_path):
    df = docs(spark)
    model = T.fit_text(df.filter('doc_id % 5 > 0'), epochs=20, rate=0.2)
    assert all(a > b for a, b in zip(model.losses, model.losses[1:], strict=False)) and T.epoch_losses(model).count() == 20
    out = T.score_text(model, df.filter('doc_id % 5 = 0 and label is not null and text is not null')).collect()
    tp = sum(r.prediction and r.label for r in out)
    assert 2 * tp / (sum(r.prediction for r in out) + sum(r.label for r in out)) > 0.9
    assert all(abs(r.probability_0 + r.probability_1 - 1) < 1e-12 for r in out)
    again = T.load_text(spark, model.save(str(tmp_path / 'm')))
    a, b = ({r.doc_id: (r.prediction, round(r.probability_1, 12)) for r in T.score_text(m, df).collect()} for m in (model, again))
    assert a == b and len(a) == 240 and again.losses == model.losses
    none = T.fit_text(df.limit(0), epochs=1)
    assert T.score_text(none, df).count() == 240
    with pytest.raises(ValueError):
        T.fit_text(df, max_features=10**6)


@pytest.mark.parametrize('buckets', [4, 64, 1 << 20])
def test_vocabulary_of_the_largest_buckets_is_exact(spark, monkeypatch, tmp_path, buckets):
    monkeypatch.setattr(D, 'BUCKETS', buckets)
    texts = [' '.join([f'w{(i * k) % 97}' for k in range(1, 12)] + ['every', f'only{i}'] + ['thrice'] * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), 'doc_id int, text string')
    cf, dfs = Counter(), Counter()
    for t in texts:
        w = t.split()
        terms = w + [f'{a} {b}' for a, b in zip(w, w[1:], strict=False)]
        cf.update(terms)
        dfs.update(set(terms))
    for size in (5, 40, 5000):
        want = sorted((t for t in cf if 2 <= dfs[t] <= 0.95 * 200), key=lambda t: (-cf[t], t))[:size]
        got = D.fit_tfidf(df, max_features=size)
        assert {(r.term, r.df, r.cf, r.idx) for r in got.collect()} == {(t, dfs[t], cf[t], i) for i, t in enumerate(sorted(want))}
    vocab, about = D.load_vocabulary(spark, D.save_vocabulary(got, str(tmp_path / 'v'), ngram_range=[1, 2]))
    assert vocab.count() == got.count() and about == {'ngram_range': [1, 2]}
    assert D.fit_tfidf(df.limit(0)).collect() == []


def test_terms_are_counted_over_ranges_of_rows(spark):
    texts = [None, '', 'One', 'one two one two', 'Éa é éa', '1a a1 _b b_'] + ['one two three'] * 50
    df = spark.createDataFrame(list(enumerate(texts)), 'doc_id int, text string').coalesce(1)
    want = D.tokenize_ngrams(df, 'text').collect()
    for r in (1, 1), (2, 2), (1, 2):
        keep = lambda t: r[0] <= t.count(' ') + 1 <= r[1]  # noqa: E731, B023
        rows = {x.doc_id: Counter(t for t in x.terms if keep(t)) for x in want}
        cf, dfs = Counter(), Counter()
        for c in rows.values():
            cf.update(c)
            dfs.update(c.keys())
        got = D.term_counts(df, 'doc_id', 'text', r).collect()
        assert Counter((x.doc_id, x.term, x.tf) for x in got) == Counter((i, t, n) for i, c in rows.items() for t, n in c.items())
        parts = D.written_counts(df, 'text', r).collect()
        assert len(parts) == len(cf) == len({x.term for x in parts})  # one range: a term once, not once a document
        assert {(x.term, x.df, x.cf) for x in parts} == {(t, dfs[t], n) for t, n in cf.items()}


def test_ranges_of_few_tokens_count_alike():
    rows = [['a', 'b', 'a'], [], ['b', 'a', 'b', 'a'], ['c']] * 3
    batch = pa.RecordBatch.from_pydict({'i': pa.array(range(12)), 't': pa.array(rows, pa.list_(pa.string()))})
    whole = pa.Table.from_batches(D._runs(iter([batch]), (1, 2), True)).to_pylist()
    old = D.COUNTED, D.OUT_ROWS
    try:
        D.COUNTED, D.OUT_ROWS = 4, 2
        assert sorted(pa.Table.from_batches(D._runs(iter([batch]), (1, 2), True)).to_pylist(), key=str) == sorted(whole, key=str)
        cf, dfs = Counter(), Counter()
        for r in pa.Table.from_batches(D._runs(iter([batch]), (1, 2), False)).to_pylist():
            cf[r['term']] += r['cf']
            dfs[r['term']] += r['df']
    finally:
        D.COUNTED, D.OUT_ROWS = old
    assert cf == {'a': 12, 'b': 9, 'c': 3, 'a b': 6, 'b a': 9} and dfs == {'a': 6, 'b': 6, 'c': 3, 'a b': 6, 'b a': 6}

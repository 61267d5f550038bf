"""What the queries read, keep and compute once; results against plain versions."""

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from logtriage.functions import rules as R
from logtriage.functions import text as X
from logtriage.functions.tokens import strip_accents, word_tokens
from logtriage.models import text as M
from logtriage.models import trees as T
from logtriage.operators import encoding as N
from logtriage.operators import sampling as S
from pyspark.sql import functions as F


def test_fits_in_memory_place_each_row_once_a_level(monkeypatch):
    """no row is led through a finished tree again, and all nodes of a level are split at once."""
    rng = np.random.default_rng(5)
    n = 3000
    bins, y, part = rng.integers(0, 9, (4, n)).astype(np.int32), rng.integers(0, 2, n), rng.integers(0, 3, n)
    rows = T.Rows(bins, y, part, rng.integers(1, 3, n).astype(float), rng.integers(1, T.MODULUS - 1, n))
    for kind, sub in (('logistic', 0.7), ('samme.r', 1.0), ('samme', 1.0)):
        spec = T.Spec(rounds=5, depth=4, kind=kind, subsample=sub, colsample=0.75, min_rows=3, reg_lambda=1.0)
        p, q = (float(rows.n[(part != 1) & (y == c)].sum()) for c in (1, 0))
        plain = T.Fit(spec, 1, (4, 10), p, q)
        while not plain.done:  # as the passes by rows do it
            v = plain.view(0)
            margin = plain.base + T.scored(plain.trees, bins)
            stats = T.watched(v, rows, margin) if v.ask else None
            hist = T.added(v, rows, v.open.places(bins), T.channels(v, rows, margin), (4, 10)) if len(v.frontier) else []
            T._advance(plain, stats, [T._best(h, i, spec, (4, 10)) for i, h in enumerate(hist)])
        with monkeypatch.context() as m:
            m.setattr(T.Tree, 'places', None)
            got = T.grow_here(rows, T.Fit(spec, 1, (4, 10), p, q))
        assert len(got.trees) == len(plain.trees) > 0 and got.alphas == plain.alphas
        assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-12) for a, b in zip(got.trees, plain.trees, strict=True))
        assert [c['tp'] for c in got.curve] == [c['tp'] for c in plain.curve]


@pytest.mark.parametrize('kind, sub, col', [('logistic', 0.7, 0.75), ('logistic', 1.0, 1.0), ('samme.r', 1.0, 1.0), ('samme', 1.0, 0.5)])
def test_levels_read_sums_of_equal_rows(monkeypatch, kind, sub, col):
    """a round adds up its rows once, whatever the depth; the trees are those of all rows."""
    monkeypatch.setattr(T, 'MERGED_ROWS', 0)
    rng = np.random.default_rng(6)
    n = 20_000
    bins, part = rng.integers(0, 9, (4, n)).astype(np.int32), rng.integers(0, 3, n)
    y = ((bins[0] + bins[1] * bins[3] > 14) ^ (rng.random(n) < 0.2)).astype(np.int64)
    rows = T.Rows(bins, y, part, rng.integers(1, 3, n).astype(float), rng.integers(1, T.MODULUS - 1, n))
    spec = T.Spec(rounds=6, depth=5, kind=kind, subsample=sub, colsample=col, min_rows=20, reg_lambda=1.0)
    for held in (1, None):
        p, q = (float(rows.n[(part != held) & (y == c)].sum()) for c in (1, 0))
        plain = T.Fit(spec, held, (4, 10), p, q)
        while not plain.done:
            v = plain.view(0)
            margin = plain.base + T.scored(plain.trees, bins)
            stats = T.watched(v, rows, margin) if v.ask else None
            hist = T.added(v, rows, v.open.places(bins), T.channels(v, rows, margin), (4, 10)) if len(v.frontier) else []
            T._advance(plain, stats, [T._best(h, i, spec, (4, 10)) for i, h in enumerate(hist)])
        sizes = []
        with monkeypatch.context() as m:
            m.setattr(T.np, 'bincount', lambda x, *a, own=np.bincount: (sizes.append(len(x)), own(x, *a))[1])
            got = T.grow_here(rows, T.Fit(spec, held, (4, 10), p, q))
        assert sum(x > 9 ** 4 for x in sizes) <= 2 + spec.rounds  # the classes of all rows, and of those drawn
        assert len(got.trees) == len(plain.trees) == 6 and np.allclose(got.alphas, plain.alphas, rtol=1e-9)
        for a, b in zip(got.trees, plain.trees, strict=True):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9) and np.allclose(a.rows, b.rows)
        for a, b in zip(got.curve, plain.curve, strict=True):
            assert all(a[k] == b[k] for k in ('round', 'tp', 'fp', 'fn', 'train_rows', 'held_rows')) and np.allclose([a['train_loss'], a['held_loss']], [b['train_loss'], b['held_loss']])


def test_merged_rows_keep_their_order_out_of_the_trees(monkeypatch):
    """cuts that part the same rows are equal, whatever order their sums come in."""
    monkeypatch.setattr(T, 'MERGED_ROWS', 0)
    rng = np.random.default_rng(7)
    n = 20_000
    one = rng.integers(0, 40, n)
    bins = np.stack([one, 39 - one, one // 2, rng.integers(0, 40, n)]).astype(np.int32)
    y, w = (rng.random(n) < 0.2 + one / 80).astype(np.int64), np.ones(n)
    spec, rid = T.Spec(rounds=20, depth=6, min_hessian=1.0, reg_lambda=1.0), rng.integers(1, T.MODULUS - 1, n)
    trees = []
    for order in (np.arange(n), rng.permutation(n)):
        rows = T.Rows(np.ascontiguousarray(bins[:, order]), y[order], np.zeros(n, np.int64), w, rid[order])
        trees.append(T.grow_here(rows, T.Fit(spec, None, (4, 40), float(y.sum()), float(n - y.sum()))).trees)
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(*trees, strict=True))
    assert all((t.feature != 1).all() for t in trees[0])  # the mirror of feature 0 comes after it


def test_fits_run_side_by_side(spark, monkeypatch):
    """the driver does not wait for one fit before the next begins."""
    import time

    def slow(rows, fit):
        began = time.time()
        time.sleep(3)
        fit.curve, fit.done = [(began, time.time())], True
        return fit

    if spark.sparkContext.defaultParallelism < 2:
        pytest.skip('one core')
    monkeypatch.setattr(T, 'grow_here', slow)
    data = spark.createDataFrame([(1, 0, 0, 1.0, 5), (2, 1, 0, 1.0, 6)], 'b0 int, y int, part int, n double, rid long')
    fits, _ = T.new_fits(data, (1, 4), [(T.Spec(rounds=1), None)] * 2)
    T.grow_by_fit(data, fits)
    (a, b), (c, d) = sorted(f.curve[0] for f in fits)
    assert a <= c < b <= d


def test_a_grid_reads_its_table_twice(spark, monkeypatch):
    """bounds of the bins and binned rows by fold; the model over all rows is fitted on the latter, put together."""
    from logtriage.models import boosting as B

    df = spark.range(600).select('id', (F.col('id') % 7).cast('double').alias('a'), (F.col('id') % 11).cast('double').alias('b'), (F.col('id') * 7919 % 5 < 2).cast('int').alias('label'))
    df = df.withColumn('label', F.when(F.col('id') > 20, F.col('label')))
    calls = []
    for name in ('fit_bins', 'binned'):
        monkeypatch.setattr(T, name, lambda *a, own=getattr(T, name), name=name, **k: (calls.append(name), own(*a, **k))[1])
    _, model = B.grid_search(df, ['a', 'b'], B.PRESETS['xgb'], {'rounds': [2], 'depth': [2]}, ['id'])
    assert calls == ['fit_bins', 'binned'] and model.stats['n_rows'] == 579
    edges = T.fit_bins(df, ['a', 'b'])
    whole, folds = (T.binned(df, ['a', 'b'], edges, F.col('label'), part) for part in (F.lit(0), F.col('id') % 3))
    together = T.one_part(folds)
    assert together.columns == whole.columns and sorted(map(tuple, together.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize('most', [1, 4, 1 << 18])
def test_words_are_looked_up_in_runs(monkeypatch, most):
    """at most WORDS_AT_ONCE words of several texts are in work."""
    monkeypatch.setattr(M, 'WORDS_AT_ONCE', most)
    model = M.TextModel({'a': 0, 'b': 1, 'c': 2}, np.array([1.0, 2.0, 3.0]), np.zeros(3), 0.0)
    texts = [['a', 'b', 'a', 'x'], [], None, ['c'], ['x'], ['b', 'c', 'c', 'c', 'a']]
    runs = list(model.vectors(pa.array(texts, pa.list_(pa.string())).slice(0)))
    got = [(idx[a:b].tolist(), val[a:b].tolist()) for _, bounds, idx, val in runs for a, b in pairwise(bounds.tolist())]
    assert sum(n for n, *_ in runs) == len(got) == 6 and (len(runs) == 1) == (most > 4)
    for words, (idx, val) in zip(texts, got, strict=True):
        count = {model.terms[w]: (words or []).count(w) for w in words or [] if w in model.terms}
        raw = np.array([(1 + np.log(count[i])) * model.idf[i] for i in sorted(count)])
        assert idx == sorted(count) and np.allclose(val, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw)
    assert list(model.vectors(pa.array([], pa.list_(pa.string())))) == []


def test_balancing_computes_its_input_once(spark, monkeypatch):
    """F9"""
    names = []
    monkeypatch.setattr(S, 'written', lambda df, name, own=S.written: (names.append(name), own(df, name))[1])
    df = spark.range(100).select('id', (F.col('id') % 10 < 3).cast('int').alias('label'))
    assert S.balance_undersample(df, 'label', ['id']).groupBy('label').count().count() == 2 and names == ['undersample']


def test_decoding_reads_the_rows_once(spark):
    """F10"""
    docs = spark.createDataFrame([(1, 'x y zz'), (2, None), (None, 'y'), (4, 'q q y')], 'doc_id long, text string')
    vocab = spark.createDataFrame([*N.SPECIAL.items(), ('x', 4), ('y', 5)], 'token string, token_id int')
    out = N.decode(N.encode(docs, vocab, 8), vocab)
    assert {r.doc_id: r.text for r in out.collect()} == {1: 'x y', 2: '', None: '', 4: 'y'}
    assert out._jdf.queryExecution().optimizedPlan().toString().count('input_ids') <= 3


def test_cleaning_looks_for_digests_once(spark):
    """one search for a run of hexadecimal digits stands before the three patterns."""
    rows = ['x' + 'a' * 32, 'a' * 32, 'A1' * 20 + ' y', 'b ' + '0' * 64 + '!', 'a' * 33, ' é ' + 'f' * 32, '0xAf 0X1', 'K 0xK', None]
    df = spark.createDataFrame([(t,) for t in rows], 't string')
    plain = F.coalesce('t', F.lit(''))
    for p in R.DEFAULT_REMOVE_PATTERNS:
        plain = F.regexp_replace(plain, R.java_pattern(p), ' ')
    plain = F.regexp_replace(F.regexp_replace(plain, r'(?U)[^\w\s' + R.KEPT_PUNCTUATION + ']', ' '), r'(?U)\s+', ' ')
    out = df.select(X.clean_text('t').alias('c'), X.regex_trim(F.lower(plain)).alias('p')).collect()
    assert [r.c for r in out] == [r.p for r in out]
    assert [R.digest_length(p) for p in R.DEFAULT_REMOVE_PATTERNS if R.digest_length(p)] == [32, 40, 64]
    long = spark.createDataFrame([('the heap',), ('nothing here',), ('x' * 513 + 'error',), ('PASSED it all',), ('err',)], 't string')
    assert [r[0] for r in long.select(X.is_relevant('t')).collect()] == [False, False, False, True, False]


def test_accents_are_stripped_by_parts(spark):
    texts = ['Ünï  ço de', 'plain only', ' é', 'é ', '', None, 'ﬁne ﬂow\tstraße x́y', 'a b ½x']
    df = spark.createDataFrame([(t,) for t in texts], 't string')
    whole = F.regexp_extract_all(strip_accents(F.lower(F.coalesce('t', F.lit('')))), F.lit(r'(?U)\b[a-zA-Z][a-zA-Z0-9_]*\b'), 0)
    assert all(r.a == r.b for r in df.select(word_tokens(F.col('t')).alias('a'), whole.alias('b')).collect())

"""Boosting against a plain version that looks at every cut of every node by masks."""

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtriage.models import boosting as B
from logtriage.models import trees as T

NAMES = ['a', 'b', 'c']


def table(spark, n=700):
    h = F.xxhash64('id')
    noise = F.pmod(h, F.lit(100))
    df = spark.range(n).select('id', F.when(noise < 4, None).otherwise(F.pmod(h, F.lit(13)).cast('double')).alias('a'), (F.pmod(F.shiftright(h, 8), F.lit(977)) / 10).alias('b'),
                               F.when(noise == 50, float('nan')).otherwise(F.pmod(F.shiftright(h, 20), F.lit(5)).cast('double')).alias('c'), noise.alias('noise'))
    label = ((F.coalesce('a', F.lit(20.0)) + F.col('b') / 12 > 9) | (F.col('c') == 2)).cast('int')
    return df.withColumn('label', F.when(noise < 90, label).otherwise(1 - label)).drop('noise')


def cells(data):
    rows = sorted((tuple(r) for r in data.select('b0', 'b1', 'b2', 'y', 'part', 'n', 'rid').collect()))
    x = np.array(rows, float)
    return x[:, :3].astype(int), x[:, 3], x[:, 4], x[:, 5], x[:, 6].astype(np.int64)


def plain(data, spec, held=None):
    """(trees as {node: (feature, cut) or value}, margins by round)."""
    x, y, part, n, rid = cells(data)
    train = np.ones(len(y), bool) if held is None else part != held
    base = math.log((n * y)[train].sum() / (n * (1 - y))[train].sum()) if spec.kind == 'logistic' else 0.0
    m, w = np.full(len(y), base), n / n[train].sum()
    trees, margins = [], []
    for t in range(1, spec.rounds + 1):
        kept = np.where(train, n, 0.0)
        if spec.subsample < 1:
            state = rid.copy()
            for _ in range(t):
                state = state * 48271 % (2 ** 31 - 1)
            kept = np.floor(kept * spec.subsample + state / (2 ** 31 - 1)) * train
        order = sorted(range(3), key=lambda f: hashlib.md5(f'{spec.seed}|{t}|{f}'.encode()).hexdigest())
        use = sorted(order[:max(1, int(spec.colsample * 3 + 1e-9))])
        if spec.kind == 'logistic':
            p = 1 / (1 + np.exp(-m))
            g, d = kept * (p - y), kept * p * (1 - p)
        else:
            g, d = w * train * y * n.sum(), w * train * n.sum()

        def soft(v, alpha=spec.reg_alpha):
            return math.copysign(max(abs(v) - alpha, 0), v)

        def part_score(at, g=g, d=d, kept=kept, soft=soft):
            den = kept[at].sum() if spec.plain else d[at].sum() + spec.reg_lambda
            return soft(g[at].sum()) ** 2 / den if den > 0 else 0.0

        tree, leaves = {}, {}

        def grow(node, at, depth, g=g, d=d, kept=kept, use=use, tree=tree, leaves=leaves, part_score=part_score):
            best = None
            if depth < spec.depth and kept[at].sum() >= spec.min_split:
                for f in use:
                    for cut in sorted(set(x[at & (kept > 0), f]))[:-1]:
                        lo, hi = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                        if min(kept[lo].sum(), kept[hi].sum()) < spec.min_rows or min(d[lo].sum(), d[hi].sum()) < spec.min_hessian:
                            continue
                        gain = part_score(lo) + part_score(hi) - part_score(at) - spec.gamma
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, f, cut, lo, hi
            if best is None or best[0] <= 1e-9:
                leaves[node] = at
                return
            tree[node] = best[1:3]
            grow(2 * node, best[3], depth + 1)
            grow(2 * node + 1, best[4], depth + 1)

        grow(1, np.ones(len(y), bool), 0)
        if spec.kind == 'logistic':
            value = {k: -spec.rate * soft(g[at].sum()) / (d[at].sum() + spec.reg_lambda) for k, at in leaves.items()}
        else:
            share = {k: g[at].sum() / d[at].sum() for k, at in leaves.items()}
            err = sum(min(s, 1 - s) * d[leaves[k]].sum() for k, s in share.items()) / d.sum()
            if spec.kind == 'samme':
                if err >= 0.5:
                    break
                alpha = spec.rate * math.log((1 - err) / err)
                value = {k: alpha if s > 0.5 else -alpha for k, s in share.items()}
            else:
                value = {k: spec.rate * 0.5 * math.log(min(max(s, 1e-9), 1 - 1e-9) / (1 - min(max(s, 1e-9), 1 - 1e-9))) for k, s in share.items()}
        step = sum(v * leaves[k] for k, v in value.items())
        m = m + step
        if spec.kind != 'logistic':  # weights carried on and normalised each round
            w = w * np.exp(-(0.5 if spec.kind == 'samme' else 1.0) * (2 * y - 1) * step)
            w = w / w[train].sum()
        trees.append((tree, value))
        margins.append(m)
    return trees, margins


SPECS = {
    'regularised': T.Spec(rounds=12, depth=3, rate=0.3, subsample=0.8, colsample=0.7, reg_alpha=0.05, reg_lambda=1.0, gamma=0.01, min_hessian=1.0),
    'plain': T.Spec(rounds=12, depth=2, rate=0.5, subsample=0.5, plain=True, min_split=50, min_rows=30),
    'samme': T.Spec(rounds=11, depth=1, rate=1.0, kind='samme'),
    'samme.r': T.Spec(rounds=11, depth=2, rate=0.5, kind='samme.r'),
}


@pytest.fixture(scope='module')
def data(spark):
    df = table(spark)
    edges = T.fit_bins(df, NAMES, 16)
    out = T.binned(df, NAMES, edges, F.col('label'), (F.col('id') % 5 == 0).cast('int'))
    return out.repartition(3).transform(lambda d: T.written(d, 'cells')), edges


@pytest.mark.parametrize('name', SPECS)
def test_trees_equal_a_plain_version(data, name):
    rows, edges = data
    shape = 3, max(map(len, edges)) + 2
    want, margins = plain(rows, SPECS[name], 1)

    def grown(how):
        fits, _ = T.new_fits(rows, shape, [(SPECS[name], 1)])
        return fits[0], how(fits)

    ways = {'rows': lambda f: T.grow_by_rows(rows, f), 'shuffled': lambda f: T.grow_by_rows(rows, f, sum_bytes=0), 'often': lambda f: T.grow_by_rows(rows, f, write_rounds=3),
            'fit': lambda f: T.grow_by_fit(rows, f)}
    x = cells(rows)[0]
    for way, how in ways.items():
        fit, wrote = grown(how)
        assert len(fit.trees) == len(want), way
        for t, (tree, value) in zip(fit.trees, want, strict=True):
            assert {i: (int(t.feature[i]), int(t.cut[i])) for i in np.flatnonzero(t.feature >= 0).tolist()} == tree, way
            assert all(abs(t.value[i] - v) < 1e-9 for i, v in value.items()), way
        assert np.abs(fit.base + T.scored(fit.trees, x.T) - margins[-1]).max() < 1e-9, way
        assert [c['round'] for c in fit.curve] == list(range(1, len(want) + 1))
        if way == 'rows':
            assert wrote == (len(want) - 1) // T.WRITE_ROUNDS  # not a table per round
        if way == 'often':
            assert wrote == (len(want) - 1) // 3


def test_curves_watch_the_held_rows(data):
    rows, edges = data
    spec = SPECS['regularised']
    (fit,), _ = T.new_fits(rows, (3, max(map(len, edges)) + 2), [(spec, 1)])
    T.grow_by_rows(rows, [fit])
    _, margins = plain(rows, spec, 1)
    _, y, part, n, _ = cells(rows)
    for c, m in zip(fit.curve, margins, strict=True):
        held, loss = part == 1, n * np.logaddexp(0, np.where(y == 1, -m, m))
        want = (loss[~held].sum(), n[~held].sum(), loss[held].sum(), n[held].sum(), (n * held * (m > 0) * y).sum(), (n * held * (m > 0) * (1 - y)).sum(), (n * held * (m <= 0) * y).sum())
        assert np.allclose([c[k] for k in ('train_loss', 'train_rows', 'held_loss', 'held_rows', 'tp', 'fp', 'fn')], want, atol=1e-9)


def test_early_stopping_keeps_the_best_round(spark):
    df = table(spark, 400).withColumn('label', F.when(F.col('id') % 3 == 0, 1 - F.col('label')).otherwise(F.col('label')))
    train, val = df.filter('id % 4 > 0'), df.filter('id % 4 = 0')
    m = B.fit_boosted(train, NAMES, 'xgb', val=val, rounds=60, rate=0.5)
    losses = [c['held_loss'] / c['held_rows'] for c in m.stats['curve']]
    best = int(np.argmin(losses)) + 1
    assert m.stats['best_round'] == best < m.stats['rounds'] == best + B.PATIENCE < 60
    assert len(m.trees) == best and B.training_stats(m).first().best_round == best
    own = B.fit_boosted(df, NAMES, 'gb', keys=['id'], rate=0.5)
    assert own.stats['best_round'] < own.stats['rounds'] < 100 and own.stats['n_rows'] < 400
    with pytest.raises(ValueError, match='keys'):
        B.fit_boosted(df, NAMES, 'gb')


def test_grid_reads_nested_rounds_off_one_fit(spark):
    df = table(spark)
    spec = B.PRESETS['xgb']
    grid = {'rounds': [3, 7], 'depth': [2, 4], 'rate': [0.1, 0.5]}
    by_fit, model = B.grid_search(df, NAMES, spec, grid, ['id'], k=3)
    assert [tuple(r) for r in by_fit.collect()] == [tuple(r) for r in B.grid_search(df, NAMES, spec, grid, ['id'], k=3, by='rows')[0].collect()]
    rows = by_fit.collect()
    assert len(rows) == 8 and [r.cv_f1_mean for r in rows] == sorted((r.cv_f1_mean for r in rows), reverse=True)
    for r in rows[:2] + rows[-2:]:
        import json
        own = B.cross_validate(df, NAMES, replace(spec, **json.loads(r.params)), ['id'], k=3).first()
        assert math.isclose(own.cv_f1_mean, r.cv_f1_mean, rel_tol=1e-12)
    assert len(model.trees) == json.loads(rows[0].params)['rounds']


def test_saved_models_score_alike_on_all_paths(spark, tmp_path):
    df = table(spark)
    for i, m in enumerate((B.fit_boosted(df, NAMES, 'xgb', rounds=5, depth=3), B.fit_adaboost(df, NAMES, rounds=4, depth=2), B.fit_adaboost(df, NAMES, 'ada_benchmark', rounds=4, rate=1.0))):
        again = B.load(spark, m.save(str(tmp_path / f'm{i}')))
        one = {r.id: r.m for r in df.select('id', m.margin().alias('m')).collect()}
        for other in ({r.id: r.m for r in df.select('id', again.margin().alias('m')).collect()}, {r.id: r.margin for r in B.margins_by_join(again, df, ['id']).collect()}):
            assert other.keys() == one.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)
        scores = B.score(again, df).collect()
        assert all(r.prediction == int(one[r.id] > 0) and abs(r.probability_0 + r.probability_1 - 1) < 1e-12 for r in scores)
        f1 = {r['round']: r.f1 for r in B.staged_scores(again, df).collect()}
        assert set(f1) == set(range(1, len(m.trees) + 1)) and f1[len(m.trees)] == B.evaluate_on(again, df).first().f1 > 0.7
        noted = [r.deviance for r in B.training_deviance(m).orderBy('round').collect()]
        assert np.allclose(noted, [r.deviance for r in B.training_deviance(again, df).orderBy('round').collect()])
        assert abs(sum(r.importance for r in B.feature_importance(again).collect()) - 1) < 1e-12


def test_missing_values_odd_labels_and_small_tables(spark):
    schema = 'x double, label int'
    df = spark.createDataFrame([(None, 1), (float('nan'), 1), (1.0, 0), (2.0, 0), (3.0, None)] * 20, schema)
    m = B.fit_boosted(df, ['x'], 'xgb', rounds=3, depth=1, subsample=1.0)
    got = {(r.x if r.x == r.x else 'nan'): r.prediction for r in B.score(m, df.distinct()).collect()}
    assert got == {None: 1, 'nan': 1, 1.0: 0, 2.0: 0, 3.0: 0} and m.stats['n_rows'] == 80
    one = B.fit_boosted(df.filter('label = 1'), ['x'], 'xgb', rounds=2)
    assert all(abs(t.value).max() == 0 or t.feature.max() < 0 for t in one.trees)
    none = B.fit_boosted(df.limit(0), ['x'], 'xgb', rounds=2)
    assert none.trees == [] and B.score(none, df).count() == 100 and none.nodes(spark).count() == 0
    right = B.fit_adaboost(df.filter('x is not null and label is not null'), ['x'], rounds=3, depth=1)
    assert len(right.trees) <= 1


def test_sketch_bins_are_ranks(spark):
    df = spark.range(5000).select((F.col('id') * 7919 % 5000).cast('double').alias('x'), F.lit(1.0).alias('same'))
    edges = T.fit_bins(df, ['x', 'same'], 11)
    assert edges[1] == [] and len(edges[0]) == 9 and all(abs(e - 500 * i) <= 1 for i, e in enumerate(edges[0], 1))
    codes = {r.c: r.n for r in df.groupBy(T.code(F.col('x'), edges[0]).alias('c')).agg(F.count('*').alias('n')).collect()}
    assert sorted(codes) == list(range(1, 11)) and max(codes.values()) <= 502

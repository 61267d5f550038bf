"""Boosted trees, AdaBoost, scoring, folds, grids, reports.

A fitted model is an ``Ensemble``: the trees as a table of nodes with thresholds in the units
of the features, small enough for the driver (rounds x 2**depth).  Rows are scored by arrays
in one UDF over the feature columns, or by joins with that table (``margins_by_join``).
"""

from __future__ import annotations

import itertools
import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import binary_metrics
from ..operators.sampling import hash_rank, hash_uniform
from ..session import written
from . import trees as T
from .trees import Spec, Tree

# ------------------------------------------------------------ fixed values: presets
#: Library and benchmark settings.
PRESETS = {
    'xgb': Spec(rounds=100, depth=6, rate=0.1, subsample=0.8, colsample=0.8, reg_lambda=1.0, min_hessian=1.0),
    'xgb_benchmark': Spec(rounds=200, depth=4, rate=0.05, subsample=0.9, colsample=0.9, reg_alpha=0.05, reg_lambda=1.0, min_hessian=1.0, gamma=0.01),
    'gb': Spec(rounds=100, depth=6, rate=0.1, subsample=0.8, plain=True, patience=10, tol=1e-4),
    'gb_benchmark': Spec(rounds=20, depth=1, rate=0.8, subsample=0.3, plain=True, min_split=50, min_rows=30),
    'ada': Spec(rounds=100, depth=3, rate=0.1, kind='samme.r'),
    'ada_benchmark': Spec(rounds=25, depth=1, rate=2.0, kind='samme'),
}
#: Share of the rows set aside by a preset, and rounds without gain after which a fit with a
#: validation table ends.
VALIDATION = {'gb': 0.1}
PATIENCE = 10
GRID = {'rounds': [50, 100, 200], 'depth': [3, 6, 9], 'rate': [0.01, 0.1, 0.2]}
ADABOOST_GRID = {'rounds': [50, 100, 200], 'rate': [0.01, 0.1, 0.5, 1.0]}
# ----------------------------------------------------------------------------------
NODES = 'round int, node int, feature string, cut int, threshold double, value double, gain double, rows double, alpha double'


@dataclass
class Ensemble:
    """Rows of class 1 have a positive margin ``base`` + sum of the trees' values."""
    names: list[str]
    edges: list[list[float]]
    kind: str
    base: float
    trees: list[Tree]
    alphas: list[float]
    stats: dict = field(default_factory=dict)

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.where(np.isnan(x), 0, np.searchsorted(e, x, 'left') + 1) for x, e in zip(columns, self.edges, strict=True)]) if columns else np.zeros((0, 0), int)

    def margin(self) -> Column:
        trees, codes, base = self.trees, self.codes, self.base

        @F.pandas_udf('double')
        def margin(*columns: pd.Series) -> pd.Series:
            return pd.Series(base + T.scored(trees, codes([c.to_numpy(float) for c in columns])))
        return margin(*[F.col(c).cast('double') for c in self.names])

    def probability(self, margin: Column) -> Column:
        """Of class 1."""
        if self.kind == 'logistic':
            return 1 / (1 + F.exp(-margin))
        return 1 / (1 + F.exp(-2 * margin / F.lit(sum(map(abs, self.alphas)) or 1.0)))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table: children of node i are 2i (missing values and those up to
        ``threshold``) and 2i + 1; ``feature`` is null at leaves."""
        rows = []
        for r, (t, a) in enumerate(zip(self.trees, self.alphas, strict=True), 1):
            stack = [1]
            while stack:
                i = stack.pop()
                f, cut = int(t.feature[i]), int(t.cut[i])
                if f >= 0:
                    stack += [2 * i, 2 * i + 1]
                rows.append((r, i, self.names[f] if f >= 0 else None, cut if f >= 0 else None, float(self.edges[f][cut - 1]) if f >= 0 and cut else None,
                             float(t.value[i]), float(t.gain[i]), float(t.rows[i]), float(a)))
        return spark.createDataFrame(rows, NODES)

    def save(self, path: str) -> str:
        """The node table and a text file about it."""
        spark = SparkSession.getActiveSession()
        self.nodes(spark).coalesce(1).write.mode('overwrite').parquet(f'{path}/nodes')
        depth = max((len(t.feature).bit_length() - 2 for t in self.trees), default=0)
        about = {'names': self.names, 'edges': self.edges, 'kind': self.kind, 'base': self.base, 'depth': depth, 'rounds': len(self.trees), 'stats': self.stats}
        spark.createDataFrame([(json.dumps(about),)], 'value string').coalesce(1).write.mode('overwrite').text(f'{path}/about')
        return path


def load(spark: SparkSession, path: str) -> Ensemble:
    """A saved model."""
    about = json.loads(spark.read.text(f'{path}/about').first()[0])
    size = 2 << about['depth']
    trees = [Tree(np.full(size, -1, np.int16), np.zeros(size, np.int32), np.zeros(size), np.zeros(size), np.zeros(size)) for _ in range(about['rounds'])]
    alphas = [0.0] * about['rounds']
    for r in spark.read.parquet(f'{path}/nodes').collect():  # the model: rounds x 2**depth rows at most
        t = trees[r['round'] - 1]
        t.feature[r.node] = about['names'].index(r.feature) if r.feature is not None else -1
        t.cut[r.node], t.value[r.node], t.gain[r.node], t.rows[r.node] = r.cut or 0, r.value, r.gain, r.rows
        alphas[r['round'] - 1] = r.alpha
    return Ensemble(about['names'], about['edges'], about['kind'], about['base'], trees, alphas, about['stats'])


# ---------------------------------------------------------------- fitting
def _ensemble(fit: T.Fit, names, edges, seconds: float, wrote: int) -> Ensemble:
    keep = fit.best_round
    stats = {'seconds': seconds, 'n_rows': int(fit.positives + fit.negatives), 'n_features': len(names), 'rounds': len(fit.trees), 'best_round': keep,
             'written': wrote, 'curve': fit.curve, 'deviance': [2 * c['train_loss'] / c['train_rows'] for c in fit.curve]}
    return Ensemble(list(names), edges, fit.spec.kind, fit.base, fit.trees[:keep], fit.alphas[:keep], stats)


def _grow(data: DataFrame, edges, specs: list[tuple[Spec, int | None]], by: str | None) -> tuple[list[T.Fit], int]:
    """Grow the fits by 'rows', by 'fit', or (None) by fit where the binned table is small."""
    shape = len(edges), max(len(e) for e in edges) + 2
    fits, rows = T.new_fits(data, shape, specs)
    if by == 'fit' and rows > T.ROWS_PER_FIT:
        raise ValueError(f'{rows} binned rows are too many for one task')
    if by == 'fit' or (by is None and rows <= T.ROWS_PER_FIT):
        T.grow_by_fit(data, fits)
        return fits, 0
    return fits, T.grow_by_rows(data, fits)


def fit_spec(df: DataFrame, feature_cols, spec: Spec, val: DataFrame | None = None, label_col='label', keys=None, validation: float = 0.0,
             bins: int = T.BINS, by: str | None = None) -> Ensemble:
    """A model by ``spec``.  With ``val``, or a share ``validation`` of the rows drawn by hash of
    ``keys``, its loss is watched after each round and the model cut to the best round; with
    ``spec.patience`` the fit also ends after so many rounds without gain."""
    names = list(feature_cols)
    part = F.lit(0)
    data = df
    if val is not None:
        cols = [*names, label_col]
        data = df.select(*cols, F.lit(0).alias('_part')).unionByName(val.select(*cols, F.lit(1).alias('_part')))
        part = F.col('_part')
    elif validation:
        if not keys:
            raise ValueError('a validation share needs the keys of the rows')
        part = F.when(hash_uniform(keys, spec.seed, 'validation') < validation, 1).otherwise(0)
    began = time.perf_counter()
    watch = val is not None or bool(validation)
    edges = T.fit_bins(data.filter(part == 0), names, bins)
    table = T.binned(data, names, edges, F.col(label_col), part, spec.seed)
    if not watch:
        spec = replace(spec, patience=None)
    fits, wrote = _grow(table, edges, [(spec, 1 if watch else None)], by or 'rows')
    return _ensemble(fits[0], names, edges, time.perf_counter() - began, wrote)


def fit_boosted(df: DataFrame, feature_cols, preset: str = 'xgb', val: DataFrame | None = None, label_col='label', keys=None,
                validation: float | None = None, seed: int = 42, bins: int = T.BINS, **options) -> Ensemble:
    """Boosted trees by a preset of PRESETS; ``options`` replace its settings."""
    share = VALIDATION.get(preset, 0.0) if validation is None else validation
    spec = replace(PRESETS[preset], seed=seed, **options)
    if val is not None:
        share, spec = 0.0, replace(spec, patience=spec.patience or PATIENCE)
    return fit_spec(df, feature_cols, spec, val, label_col, keys, share, bins)


def fit_adaboost(df: DataFrame, feature_cols, preset: str = 'ada', label_col='label', seed: int = 42, bins: int = T.BINS, **options) -> Ensemble:
    """E3 (SAMME) and E4 (SAMME.R): weights are a function of the trees so far."""
    return fit_spec(df, feature_cols, replace(PRESETS[preset], seed=seed, **options), label_col=label_col, bins=bins)


# ---------------------------------------------------------------- scoring
def score(model: Ensemble, df: DataFrame) -> DataFrame:
    """E5: ``df`` plus ``prediction`` (int), ``probability_0``, ``probability_1``."""
    if model is None:
        raise ValueError('the model is not fitted')
    keep = [c for c in df.columns if c not in ('prediction', 'probability_0', 'probability_1')]
    p = model.probability(F.col('_margin'))
    out = df.withColumn('_margin', model.margin())
    return out.select(*keep, (F.col('_margin') > 0).cast('int').alias('prediction'), (1 - p).alias('probability_0'), p.alias('probability_1'))


def margins_by_join(model: Ensemble, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, margin) by joins with the node table, a level at a time: the scoring that any SQL
    engine can do.  ``keys`` must identify the rows."""
    nodes = model.nodes(df.sparkSession).select('round', 'node', 'feature', 'threshold', 'value')
    depth = max((len(t.feature).bit_length() - 2 for t in model.trees), default=0)
    values = F.create_map(*[x for n in model.names for x in (F.lit(n), F.col(n).cast('double'))])
    at = df.select(*keys, values.alias('_x'), F.explode(F.sequence(F.lit(1), F.lit(len(model.trees)))).alias('round'), F.lit(1).alias('node'))
    for _ in range(depth):
        x = F.col('_x')[F.col('feature')]
        left = x.isNull() | F.isnan(x) | (F.col('threshold').isNotNull() & (x <= F.col('threshold')))
        step = F.when(F.col('feature').isNull(), F.col('node')).when(left, 2 * F.col('node')).otherwise(2 * F.col('node') + 1)
        at = at.join(nodes.drop('value'), ['round', 'node']).select(*keys, '_x', 'round', step.alias('node'))
    return at.join(nodes, ['round', 'node']).groupBy(*keys).agg((F.lit(model.base) + F.sum('value')).alias('margin'))


def evaluate_on(model: Ensemble, df: DataFrame, label_col='label') -> DataFrame:
    """Accuracy, precision, recall, F1, seconds of scoring, ms per row."""
    began = time.perf_counter()
    scored = written(score(model, df).select(F.col(label_col).cast('int').alias('label'), 'prediction'), 'scored')
    n = scored.count()
    took = time.perf_counter() - began
    return binary_metrics(scored).withColumns({'n_rows': F.lit(n).cast('long'), 'inference_seconds': F.lit(took), 'ms_per_row': F.lit(took * 1000 / max(n, 1))})


# ---------------------------------------------------------------- folds and grids
def folds(df: DataFrame, keys, label_col='label', k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` = position within the class (by hash of the keys) modulo k."""
    return hash_rank(df, keys, seed, groups=[label_col], pos_col='_pos').withColumn('fold', (F.col('_pos') % k).cast('int')).drop('_pos')


def _f1(curve: list[dict], rounds: int) -> float:
    """F1 of the held rows after ``rounds`` rounds, or as many as there are."""
    at = [c for c in curve if c['round'] <= rounds]
    tp, other = (at[-1]['tp'], at[-1]['fp'] + at[-1]['fn']) if at else (0.0, 0.0)
    return 2 * tp / (2 * tp + other) if tp else 0.0


def _held_out(df: DataFrame, feature_cols, specs: list[Spec], keys, label_col, k, seed, bins, by):
    """Curves of each spec on each of k folds, the binned rows and their bins, which all share."""
    names = list(feature_cols)
    data = folds(df.select(*dict.fromkeys([*keys, *names, label_col])), keys, label_col, k, seed)
    edges = T.fit_bins(df, names, bins)
    table = T.binned(data, names, edges, F.col(label_col), F.col('fold'), seed)
    fits, _ = _grow(table, edges, [(replace(s, patience=None), i) for s in specs for i in range(k)], by)
    return [[f.curve for f in fits[i * k:(i + 1) * k]] for i in range(len(specs))], table, edges


def _mean_std(x: list[float]) -> tuple[float, float]:
    mean = sum(x) / len(x)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))


def cross_validate(df: DataFrame, feature_cols, spec: Spec, keys, label_col='label', k: int = 5, seed: int = 42, bins: int = T.BINS, by: str | None = None) -> DataFrame:
    """F1 of class 1 on each fold for a model fitted on the others; mean and std."""
    (curves,), *_ = _held_out(df, feature_cols, [spec], keys, label_col, k, seed, bins, by)
    f1 = [_f1(c, spec.rounds) for c in curves]
    return df.sparkSession.createDataFrame([(*_mean_std(f1), f1)], 'cv_f1_mean double, cv_f1_std double, cv_f1 array<double>')


def grid_search(df: DataFrame, feature_cols, spec: Spec, grid: dict | None, keys, label_col='label', k: int = 3, seed: int = 42, bins: int = T.BINS, by: str | None = None):
    """(table of params and F1, best first; the model refitted on all rows).  ``grid`` (GRID
    by default) maps settings of ``spec`` to lists.  Points that differ in ``rounds`` alone share
    a fit: its held-out F1 is read off after each of those rounds."""
    grid = GRID if grid is None else grid
    points = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    own = {json.dumps({**p, 'rounds': None}): replace(spec, **{**p, 'rounds': max(grid.get('rounds', [spec.rounds]))}) for p in points}
    found, binned, edges = _held_out(df, feature_cols, list(own.values()), keys, label_col, k, seed, bins, by)
    curves = dict(zip(own, found, strict=True))
    rows = []
    for p in points:
        f1 = [_f1(c, p.get('rounds', spec.rounds)) for c in curves[json.dumps({**p, 'rounds': None})]]
        rows.append((json.dumps(p), *_mean_std(f1)))
    rows.sort(key=lambda r: (-r[1], r[0]))
    best = replace(spec, patience=None, **json.loads(rows[0][0]))
    fits, wrote = _grow(T.one_part(binned, seed), edges, [(best, None)], by)
    table = df.sparkSession.createDataFrame(rows, 'params string, cv_f1_mean double, cv_f1_std double')
    return table, _ensemble(fits[0], list(feature_cols), edges, 0.0, wrote)


# ---------------------------------------------------------------- reports
def feature_importance(model: Ensemble, names=None) -> DataFrame:
    """(feature, importance), highest first: shares of the gain in each tree, their mean
    over the rounds (weighted by the rounds' weights in AdaBoost)."""
    total = np.zeros(len(model.names))
    for t, a in zip(model.trees, model.alphas, strict=True):
        own = np.zeros(len(total))
        inner = t.feature >= 0
        np.add.at(own, t.feature[inner], t.gain[inner])
        total += (1.0 if model.kind == 'logistic' else a) * own / own.sum() if own.sum() else 0.0
    total = total / total.sum() if total.sum() else total
    names = list(names or model.names or [f'feature_{i}' for i in range(len(total))])
    return SparkSession.getActiveSession().createDataFrame(sorted(zip(names, total.tolist(), strict=True), key=lambda x: (-x[1], x[0])), 'feature string, importance double')


def staged(model: Ensemble, df: DataFrame, label_col='label') -> DataFrame:
    """(round, n, loss, tp, fp, fn) after 1, 2, ... rounds: summed inside the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.trees), 5))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            bins, one = model.codes(columns[:-1]), columns[-1] == 1
            margin = np.full(batch.num_rows, model.base)
            for i, t in enumerate(model.trees):
                margin = margin + t.value[t.places(bins)]
                hit = margin > 0
                total[i] += batch.num_rows, np.logaddexp(0, np.where(one, -margin, margin)).sum(), (hit & one).sum(), (hit & ~one).sum(), (~hit & one).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(total) + 1), pa.int32()), *map(pa.array, total.T)], ['round', 'n', 'loss', 'tp', 'fp', 'fn'])

    data = df.filter(F.col(label_col).isNotNull()).select(*[F.col(c).cast('double').alias(f'x{i}') for i, c in enumerate(model.names)], F.col(label_col).cast('double').alias('y'))
    sums = data.mapInArrow(run, 'round int, n double, loss double, tp double, fp double, fn double')
    return sums.groupBy('round').agg(*[F.sum(c).alias(c) for c in ('n', 'loss', 'tp', 'fp', 'fn')])


def staged_scores(model: Ensemble, df: DataFrame, label_col='label') -> DataFrame:
    """(round, f1) of the first 1, 2, ... rounds."""
    f1 = F.when(F.col('tp') > 0, 2 * F.col('tp') / (2 * F.col('tp') + F.col('fp') + F.col('fn'))).otherwise(0.0)
    return staged(model, df, label_col).select('round', F.round(f1, 6).alias('f1'))


def training_deviance(model: Ensemble, df: DataFrame | None = None, label_col='label') -> DataFrame:
    """(round, deviance): twice the mean log-loss, on ``df`` or as noted on the training rows."""
    if df is not None:
        return staged(model, df, label_col).select('round', (2 * F.col('loss') / F.col('n')).alias('deviance'))
    rows = [(i, float(x)) for i, x in enumerate(model.stats['deviance'], 1)]
    return SparkSession.getActiveSession().createDataFrame(rows, 'round int, deviance double')


def training_stats(model: Ensemble) -> DataFrame:
    """One row with seconds, rows, features, rounds fitted, the best round, the last deviance."""
    s = model.stats
    last = s['deviance'][-1] if s['deviance'] else None
    return SparkSession.getActiveSession().createDataFrame(
        [(float(s['seconds']), int(s['n_rows']), int(s['n_features']), int(s['rounds']), int(s['best_round']), last)],
        'seconds double, n_rows long, n_features int, rounds int, best_round int, last_deviance double')

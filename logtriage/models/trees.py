"""Histogram trees for boosting, grown level by level from sums over binned rows.

* A table is binned once (``fit_bins``, ``binned``): each feature gets at most ``bins`` codes
  between quantiles of an approximate sketch, 0 being missing.  Equal binned rows of one class
  and part become one weighted row, so what the rounds read shrinks with the data's variety.
* A level of all models in work is one pass (``grow_by_rows``): each task adds up gradients by
  (model, node, feature, bin) in arrays, the sums of all tasks give the splits.  Small sums are
  added on the driver, larger ones are shuffled by (model, node) and split there.  Scores so far
  are a function of the trees: those of the last ``WRITE_ROUNDS`` rounds are computed in the
  pass, older ones stand in a written column.
* Many fits over one binned table that is proven small (``ROWS_PER_FIT``) run as one task each
  over a broadcast copy instead (``grow_by_fit``).  Rows of equal bins share a score, so (from
  ``MERGED_ROWS`` on) a round adds them up by cell, and cells by what the features drawn for its
  tree tell apart; its levels read those sums.  The trees are the same, where rounding does not choose among equal cuts.

Draws are reproducible in any engine: a row's draw in round t is the t-th term of the
multiplicative congruential sequence (48271, 2**31 - 1) that starts at its hash.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import hex8
from ..session import written

#: Codes per feature, missing included.
BINS = 64
#: Rank error of the quantile sketch, as 1 / ACCURACY of the rows.
ACCURACY = 100_000
#: Rounds between two writings of the scores.
WRITE_ROUNDS = 10
#: Binned rows (distinct, weighted) up to which fits run side by side, one task each.
ROWS_PER_FIT = 2_000_000
#: Binned rows from which a task merges those of equal bins; fewer are added up in their order.
MERGED_ROWS = 1 << 17
#: Share of the scores up to which the gains of merged rows are equal: their sums come in the
#: order of the cells, and rounding would choose among cuts that part the same rows.
TIE = 1e-10
#: Choices of features whose kinds of cells a task remembers; rows drawn at a time.
KINDS, RUN = 8, 1 << 16
#: Bytes of sums from all tasks up to which the driver adds them up.
SUM_BYTES = 64 << 20
# ------------------------------------------------------------ fixed values: the draws
MULTIPLIER, MODULUS = 48271, 2 ** 31 - 1
# -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """What is fitted.  ``kind``: 'logistic' (gradient boosting), 'samme' or 'samme.r'.  Gains
    are G^2 / D with D the sum of hessians plus ``reg_lambda``, or with ``plain`` of rows."""
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    kind: str = 'logistic'
    subsample: float = 1.0
    colsample: float = 1.0
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_hessian: float = 0.0
    min_rows: float = 1
    min_split: float = 2
    plain: bool = False
    patience: int | None = None
    tol: float = 0.0
    seed: int = 42


# ---------------------------------------------------------------- binning
def fit_bins(df: DataFrame, features: list[str], bins: int = BINS, accuracy: int = ACCURACY) -> list[list[float]]:
    """Upper bounds of the codes 1, 2, ... of each feature, ascending; the last code has none."""
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    x = [F.when(~F.isnan(c), c) for c in (F.col(f).cast('double') for f in features)]
    row = df.agg(*[F.percentile_approx(c, at, accuracy).alias(f'q{i}') for i, c in enumerate(x)], *[F.max(c).alias(f'm{i}') for i, c in enumerate(x)]).first()
    return [sorted({q for q in row[f'q{i}'] or [] if q < row[f'm{i}']}) for i in range(len(features))]


def code(x: Column, edges: list[float]) -> Column:
    """0 for missing, else 1 + the bounds below x."""
    x = x.cast('double')
    above = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast('array<double>')
    n = F.size(F.filter(above, lambda e: e < x))
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(n + 1).cast('short')


def binned(df: DataFrame, features: list[str], edges: list[list[float]], label: Column, part: Column, seed: int = 42) -> DataFrame:
    """(b0, b1, ..., y, part, n, rid): equal binned rows counted; written to shared storage.
    Null labels take no part."""
    names = [f'b{i}' for i in range(len(features))]
    rows = df.select(*[code(F.col(f), e).alias(b) for f, e, b in zip(features, edges, names, strict=True)], F.when(label.isNotNull(), (label == 1).cast('int')).alias('y'), part.cast('int').alias('part'))
    rows = rows.filter('y is not null').groupBy(*names, 'y', 'part').agg(F.count(F.lit(1)).cast('double').alias('n'))
    return _drawable(rows, seed)


def _drawable(rows: DataFrame, seed: int) -> DataFrame:
    text = F.md5(F.concat_ws('|', F.lit(str(seed)), *[F.col(c).cast('string') for c in rows.columns if c != 'n']))
    return written(rows.withColumn('rid', hex8(text) % (MODULUS - 1) + 1), 'binned')


def one_part(data: DataFrame, seed: int = 42) -> DataFrame:
    """What ``binned`` gives for the rows of all parts of a binned table as part 0."""
    names = [c for c in data.columns if c not in ('y', 'part', 'n', 'rid')]
    return _drawable(data.groupBy(*names, 'y', F.lit(0).alias('part')).agg(F.sum('n').alias('n')), seed)


def draws(rid: np.ndarray, t: int) -> np.ndarray:
    """The draw of round t (from 1) of each row, in (0, 1)."""
    return rid * pow(MULTIPLIER, t, MODULUS) % MODULUS / MODULUS


# ---------------------------------------------------------------- trees
@dataclass
class Tree:
    """Heap-ordered arrays: node i has the children 2i and 2i + 1; ``feature`` is -1 at leaves,
    codes up to ``cut`` go left."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (column of ``bins``) ends in."""
        node, at = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(len(self.feature).bit_length() - 2):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + (bins[f, at] > self.cut[node]), node)
        return node


def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


def splits_of(hist: np.ndarray, spec: Spec, tie: float = 0.0) -> list[tuple[float, int, int, np.ndarray] | None]:
    """Best (gain, feature, cut, sums of the left side) of each node, from sums by (channel, node,
    feature, bin); the first of equals, up to a share ``tie`` of the scores."""
    left = np.cumsum(hist, axis=3)
    whole = left[..., -1:]
    right = whole - left

    def score(s):
        d = s[2] if spec.plain else s[1] + spec.reg_lambda
        return np.where(d > 0, soft(s[0], spec.reg_alpha) ** 2 / np.where(d > 0, d, 1), 0.0)

    ok = (left[2] >= spec.min_rows) & (right[2] >= spec.min_rows) & (left[1] >= spec.min_hessian) & (right[1] >= spec.min_hessian)
    gain = np.where(ok, score(left) + score(right) - score(whole) - spec.gamma, -np.inf).reshape(hist.shape[1], -1)
    out = []
    best = gain.max(axis=1)
    near = best - tie * (np.abs(best) + score(whole).reshape(len(best), -1).max(axis=1)) if tie else best
    for i, at in enumerate((gain >= near[:, None]).argmax(axis=1).tolist()):
        f, cut = divmod(at, hist.shape[3])
        out.append((float(gain[i, at]), f, cut, left[:, i, f, cut].copy()) if gain[i, at] > 1e-9 else None)
    return out


def split_of(hist: np.ndarray, spec: Spec) -> tuple[float, int, int, np.ndarray] | None:
    """``splits_of`` one node, from sums by (feature, bin, channel)."""
    return splits_of(np.moveaxis(hist, 2, 0)[:, None], spec)[0]


@dataclass
class View:
    """What a pass must know of a fit."""
    spec: Spec
    held: int | None
    column: int
    base: float
    shift: float
    recent: list[Tree]
    open: Tree | None
    frontier: np.ndarray
    features: list[int]
    round: int
    ask: bool


@dataclass
class Fit:
    """A fit in work: rows with ``part`` = ``held`` are set aside and watched."""
    spec: Spec
    held: int | None
    shape: tuple[int, int]
    positives: float
    negatives: float
    trees: list[Tree] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    curve: list[dict] = field(default_factory=list)
    done: bool = False
    folded: int = 0
    shift: float = 0.0
    best_round: int = 0

    def __post_init__(self):
        n = self.positives + self.negatives
        self.base = math.log(self.positives / self.negatives) if self.spec.kind == 'logistic' and self.positives and self.negatives else 0.0
        if self.spec.kind not in ('logistic', 'samme', 'samme.r'):
            raise ValueError(f'unknown kind {self.spec.kind}')
        self.open, self.frontier, self.ask = None, np.zeros(0, np.int64), False
        if not n or self.spec.rounds < 1:
            self.done = True
        else:
            self._begin()

    def _begin(self) -> None:
        size = 2 << self.spec.depth
        self.open = Tree(np.full(size, -1, np.int16), np.zeros(size, np.int32), np.zeros(size), np.zeros(size), np.zeros(size))
        self.sums = np.zeros((size, 3))
        self.leaves: list[int] = []
        self.frontier, self.level, self.ask = np.array([1]), 0, bool(self.trees)
        k = self.shape[0]
        order = sorted(range(k), key=lambda f: hashlib.md5(f'{self.spec.seed}|{len(self.trees) + 1}|{f}'.encode()).hexdigest())
        self.features = sorted(order[:max(1, int(self.spec.colsample * k + 1e-9))])

    def view(self, column: int) -> View:
        return View(self.spec, self.held, column, self.base, self.shift, self.trees[self.folded:], self.open, self.frontier, self.features, len(self.trees) + 1, self.ask)

    def noted(self, stats: np.ndarray) -> None:
        """Takes the watched sums after the rounds so far; may end the fit."""
        names = ('train_loss', 'train_rows', 'held_loss', 'held_rows', 'tp', 'fp', 'fn')
        row = dict(zip(names, map(float, stats), strict=True)) | {'round': len(self.trees)}
        self.curve.append(row)
        loss = row['held_loss'] / row['held_rows'] if row['held_rows'] else math.inf
        if self.spec.patience and self.held is not None:
            if not self.best_round or loss < self.best - self.spec.tol:
                self.best, self.best_round = loss, row['round']
            elif row['round'] - self.best_round >= self.spec.patience:
                self.done = True
        else:
            self.best_round = row['round']
        if self.open is None:
            self.done = True

    def advance(self, splits: list, roots: np.ndarray | None) -> None:
        """Takes the best split (or None) of every node of the frontier and, on the first
        level, the sums of the root."""
        if roots is not None:
            self.sums[1] = roots
        nodes = []
        for node, split in zip(self.frontier.tolist(), splits, strict=True):
            own = self.sums[node]
            if split is None or own[2] < self.spec.min_split:
                self.leaves.append(node)
                continue
            gain, f, cut, left = split
            self.open.feature[node], self.open.cut[node], self.open.gain[node] = f, cut, gain
            self.sums[2 * node], self.sums[2 * node + 1] = left, own - left
            nodes += [2 * node, 2 * node + 1]
        self.level, self.ask = self.level + 1, False
        if self.level < self.spec.depth and nodes:
            self.frontier = np.array(nodes)
            return
        self.leaves += nodes
        self._finish()

    def _finish(self) -> None:
        tree, at = self.open, np.array(self.leaves)
        g, h, n = self.sums[at].T
        tree.rows[:] = self.sums[:, 2]
        self.open, self.frontier = None, np.zeros(0, np.int64)
        if self.spec.kind == 'logistic':
            d = h + self.spec.reg_lambda
            tree.value[at] = np.where(d > 0, -soft(g, self.spec.reg_alpha) / np.where(d > 0, d, 1), 0.0) * self.spec.rate
            alpha = self.spec.rate
        else:
            err = float(np.minimum(g, h - g).sum() / h.sum())
            real = self.spec.kind == 'samme.r'
            if err <= 1e-12 or (not real and err >= 0.5):
                if err <= 1e-12 and not self.trees:  # one tree that is always right is the model
                    tree.value[at] = np.where(g > h - g, 1.0, -1.0)
                    self._add(tree, 1.0)
                    self.ask = True
                else:
                    self.done = True
                return
            if real:
                alpha, p = self.spec.rate, np.clip(np.where(h > 0, g / np.where(h > 0, h, 1), 0.5), 1e-9, 1 - 1e-9)
                tree.value[at] = alpha * 0.5 * np.log(p / (1 - p))
            else:
                alpha = self.spec.rate * math.log((1 - err) / err)
                tree.value[at] = np.where(g > h - g, alpha, -alpha)
            c = 1.0 if real else 0.5
            after = float((g * np.exp(-c * tree.value[at]) + (h - g) * np.exp(c * tree.value[at])).sum())
            self.shift += math.log(after / (self.positives + self.negatives))
        self._add(tree, alpha)
        if len(self.trees) < self.spec.rounds:
            self._begin()
        self.ask = True

    def _add(self, tree: Tree, alpha: float) -> None:
        self.trees.append(tree)
        self.alphas.append(alpha)


# ---------------------------------------------------------------- what a task adds up
@dataclass
class Rows:
    """Binned rows as arrays; ``bins`` is (feature, row)."""
    bins: np.ndarray
    y: np.ndarray
    part: np.ndarray
    n: np.ndarray
    rid: np.ndarray

    @staticmethod
    def of(batch, features: int) -> Rows:
        def column(name, kind):
            return np.ascontiguousarray(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False), kind)
        bins = np.stack([column(f'b{i}', np.int32) for i in range(features)])
        return Rows(bins, column('y', np.int64), column('part', np.int64), column('n', np.float64), column('rid', np.int64))


def channels(view: View, rows: Rows, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(G, D, rows) of each row in this round; zero where it is held or not drawn."""
    return weighted(view, rows.y, times(view, rows), margin)


def times(view: View, rows: Rows) -> np.ndarray:
    """How often each row is drawn in this round; never if it is held."""
    n = np.where(rows.part == view.held, 0.0, rows.n) if view.held is not None else rows.n
    return np.floor(n * view.spec.subsample + draws(rows.rid, view.round)) if view.spec.subsample < 1 else n


def weighted(view: View, y: np.ndarray, n: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if view.spec.kind == 'logistic':
        p = 1 / (1 + np.exp(-margin))
        return n * (p - y), n * p * (1 - p), n
    w = n * np.exp(-(1.0 if view.spec.kind == 'samme.r' else 0.5) * (2 * y - 1) * margin - view.shift)
    return w * y, w, n


def added(view: View, rows: Rows, node: np.ndarray, values: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Sums by (node of the frontier, feature, bin, channel)."""
    k, b = shape
    slot = np.full(2 << view.spec.depth, -1)
    slot[view.frontier] = np.arange(len(view.frontier))
    s = slot[node]
    use = (s >= 0) & (values[2] > 0)
    use = slice(None) if use.all() else np.flatnonzero(use)
    out = np.zeros((len(view.frontier), k, b, 3))
    start, weights = s[use] * b, [v[use] for v in values]
    if (weights[2] == 1).all():
        weights[2] = None  # counted, which is the same
    for f in view.features:
        at = start + rows.bins[f, use]
        for c, w in enumerate(weights):
            out[:, f, :, c] = np.bincount(at, w, len(view.frontier) * b).reshape(-1, b)
    return out


def watched(view: View, rows: Rows, margin: np.ndarray) -> np.ndarray:
    """Log-loss and rows of those trained on and of those held, and tp, fp, fn of the held
    ones (of all, if none are)."""
    loss = rows.n * np.logaddexp(0, np.where(rows.y == 1, -margin, margin))
    held = rows.part == view.held if view.held is not None else np.zeros(len(margin), bool)
    seen = held if view.held is not None else np.ones(len(margin), bool)
    hit, one = margin > 0, rows.y == 1
    return np.array([loss[~held].sum(), rows.n[~held].sum(), loss[held].sum(), rows.n[held].sum(),
                     rows.n[seen & hit & one].sum(), rows.n[seen & hit & ~one].sum(), rows.n[seen & ~hit & one].sum()])


def scored(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    for t in trees:
        out += t.value[t.places(bins)]
    return out


# ---------------------------------------------------------------- fits, by rows
def _pass(views: dict[int, View], shape: tuple[int, int]):
    """Per task: (model, node place or -1 for the watched sums, sums)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows.of(batch, shape[0])
            old = np.asarray(batch.column(batch.schema.get_field_index('margins')).flatten()).reshape(batch.num_rows, -1)
            for m, v in views.items():
                margin = old[:, v.column] + scored(v.recent, rows.bins)
                found = []
                if v.ask:
                    found.append((True, watched(v, rows, margin)))
                if len(v.frontier):
                    found.append((False, added(v, rows, v.open.places(rows.bins), channels(v, rows, margin), shape)))
                for ask, x in found:
                    total[m, ask] = total[m, ask] + x if (m, ask) in total else x
        for (m, ask), x in total.items():
            parts = [x] if ask else list(x)
            places = [-1] if ask else range(len(parts))
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(parts), pa.int32()), pa.array(places, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ['model', 'place', 'sums'])
    return run


def _merge(specs: dict[int, Spec], shape: tuple[int, int]):
    """Adds up the sums of one (model, place) and keeps its best split."""
    def run(table: pa.Table) -> pa.Table:
        m, place = table.column('model')[0].as_py(), table.column('place')[0].as_py()
        total = sum(np.frombuffer(x.as_py()) for x in table.column('sums'))
        return pa.table({'model': pa.array([m], pa.int32()), 'place': pa.array([place], pa.int32()), 'best': [pickle.dumps(_best(total, place, specs[m], shape))]})
    return run


def _best(total: np.ndarray, place: int, spec: Spec, shape: tuple[int, int]):
    """The watched sums, or (split, sums of the node)."""
    if place < 0:
        return total
    hist = total.reshape(*shape, 3)
    used = int(np.argmax(hist[:, :, 2].sum(axis=1)))
    return split_of(hist, spec), hist[used].sum(axis=0)


def grow_by_rows(data: DataFrame, fits: list[Fit], write_rounds: int = WRITE_ROUNDS, sum_bytes: int = SUM_BYTES) -> int:
    """Grow all ``fits`` over the binned table, one pass per level; how often scores were
    written.  All partitions are read in each pass; nothing but sums leaves them."""
    if all(f.done for f in fits):
        return 0
    shape, wrote = fits[0].shape, 0
    data = data.withColumn('margins', F.array(*[F.lit(float(f.base)) for f in fits]))
    tasks = data.rdd.getNumPartitions()
    while True:
        live = {m: f for m, f in enumerate(fits) if not f.done}
        if not live:
            return wrote
        if any(len(f.trees) - f.folded >= write_rounds and f.ask and f.open is not None for f in live.values()):
            data, wrote = _folded(data, fits, shape[0]), wrote + 1
            tasks = data.rdd.getNumPartitions()
        views = {m: f.view(m) for m, f in live.items()}
        sums = data.mapInArrow(_pass(views, shape), 'model int, place int, sums binary')
        specs = {m: f.spec for m, f in live.items()}
        if tasks * sum(len(v.frontier) for v in views.values()) * shape[0] * shape[1] * 24 <= sum_bytes:
            total: dict = {}
            for r in sums.toArrow().to_pylist():
                k, x = (r['model'], r['place']), np.frombuffer(r['sums'])
                total[k] = total[k] + x if k in total else x
            best = {(m, place): _best(x, place, specs[m], shape) for (m, place), x in total.items()}
        else:
            got = sums.groupBy('model', 'place').applyInArrow(_merge(specs, shape), 'model int, place int, best binary').toArrow().to_pylist()
            best = {(r['model'], r['place']): pickle.loads(r['best']) for r in got}
        for m, f in live.items():
            _advance(f, best.get((m, -1)), [best.get((m, i)) for i in range(len(f.frontier))])


def _advance(fit: Fit, stats: np.ndarray | None, best: list) -> None:
    if fit.ask:
        fit.noted(stats)
        if fit.done:
            return
    fit.advance([b[0] if b else None for b in best], best[0][1] if fit.level == 0 and best[0] else None)


def _folded(data: DataFrame, fits: list[Fit], k: int) -> DataFrame:
    """The table with the trees so far added to its scores."""
    recent = [f.trees[f.folded:] for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows.of(batch, k)
            at = batch.schema.get_field_index('margins')
            new = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, -1).copy()
            for m, trees in enumerate(recent):
                new[:, m] += scored(trees, rows.bins)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * new.shape[1])
            yield batch.set_column(at, 'margins', pa.ListArray.from_arrays(offsets, pa.array(new.ravel())))

    out = written(data.mapInArrow(run, data.schema), 'scores')
    for f in fits:
        f.folded = len(f.trees)
    return out


# ---------------------------------------------------------------- fits, one task each
@dataclass
class Cells:
    """Binned rows over the distinct bins among them: a cell has one score whatever its rows'
    class and part.  ``bins`` is (feature, cell), ``cell`` the cell of each row."""
    bins: np.ndarray
    cell: np.ndarray
    y: np.ndarray
    part: np.ndarray
    n: np.ndarray
    rid: np.ndarray
    merged: bool

    @staticmethod
    def of(rows: Rows) -> Cells:
        """Few rows are a cell each, in their order; more are sorted by cell.  Cells are mixed, by
        their bins alone: sums of neighbours in one bin wait for each other."""
        if len(rows.y) < MERGED_ROWS:
            return Cells(rows.bins, np.arange(len(rows.y)), rows.y, rows.part, rows.n, rows.rid, False)
        first, cell = distinct(rows.bins)
        mixed = np.random.default_rng(0).permutation(len(first))
        first[mixed], cell = first.copy(), mixed[cell]
        order = np.argsort(cell, kind='stable')
        return Cells(rows.bins[:, first], cell[order].astype(np.int32), rows.y[order].astype(np.int8), rows.part[order].astype(np.int32), rows.n[order], rows.rid[order].astype(np.int32), True)


def distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one column of each kind, the kind of each column); kinds are ordered by their bins."""
    order = np.lexsort(bins[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (bins[:, order[1:]] != bins[:, order[:-1]]).any(axis=0)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class Grower:
    """Grows one fit over cells in memory.  A round adds up its rows by cell once, and the cells
    by what the features of the round tell apart; the levels read those sums."""

    def __init__(self, cells: Cells, fit: Fit):
        self.cells, self.fit, count = cells, fit, cells.bins.shape[1]
        held = cells.part == fit.held if fit.held is not None else np.zeros(len(cells.y), bool)
        place = cells.cell + count * cells.y.astype(np.int64)
        self.own = np.flatnonzero(~held)
        self.place, self.rid, self.n = place[self.own], cells.rid[self.own].astype(np.int64), cells.n[self.own]
        self.train = self.by_class(self.place, self.n)
        self.seen = self.by_class(place[held], cells.n[held])
        self.margin = np.full(count, fit.base)
        self.kinds: dict[tuple, tuple] = {}

    def by_class(self, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows by (class, cell)."""
        count = self.cells.bins.shape[1]
        return np.bincount(place, n, 2 * count).reshape(2, count)

    def drawn(self, v: View) -> np.ndarray:
        """Rows of this round by (class, cell)."""
        if v.spec.subsample >= 1:
            return self.train
        n = np.empty(len(self.n))
        for i in range(0, len(n), RUN):
            n[i:i + RUN] = np.floor(self.n[i:i + RUN] * v.spec.subsample + draws(self.rid[i:i + RUN], v.round))
        return self.by_class(self.place, n)

    def weighted(self, v: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(G, D, rows) of each cell in this round."""
        n0, n1 = self.drawn(v)
        if v.spec.kind == 'logistic':
            p = 1 / (1 + np.exp(-self.margin))
            return n1 * (p - 1) + n0 * p, (n0 + n1) * p * (1 - p), n0 + n1
        c = 1.0 if v.spec.kind == 'samme.r' else 0.5
        w0, w1 = (n * np.exp(np.minimum(s * c * self.margin - v.shift, 709.0)) for n, s in ((n0, 1), (n1, -1)))  # no infinity where there are no rows
        return w1, w0 + w1, n0 + n1

    def watched(self) -> np.ndarray:
        """``watched``, by cells."""
        m, hit = self.margin, self.margin > 0
        small = np.log(1 + np.exp(-np.abs(m)))
        one, zero = small + np.maximum(-m, 0), small + np.maximum(m, 0)
        (n0, n1), (h0, h1) = self.train, self.seen
        s0, s1 = self.train if self.fit.held is None else self.seen
        return np.array([n1 @ one + n0 @ zero, self.train.sum(), h1 @ one + h0 @ zero, self.seen.sum(), s1 @ hit, s0 @ hit, s1 @ ~hit])

    def kinds_by(self, features: list[int]) -> tuple[np.ndarray | None, np.ndarray]:
        """(what each cell is to the features, or None; the bins of those kinds)."""
        key = tuple(features)
        if key not in self.kinds:
            bins, kind = self.cells.bins[features], None
            if self.cells.merged and len(features) < len(self.cells.bins):
                first, kind = distinct(bins)
                bins, kind = (bins[:, first], kind) if len(first) < 0.8 * len(kind) else (bins, None)
            while len(self.kinds) >= KINDS:
                self.kinds.pop(next(iter(self.kinds)))
            self.kinds[key] = kind, np.ascontiguousarray(bins)
        return self.kinds[key]

    def run(self) -> Fit:
        fit, (_, b), done = self.fit, self.fit.shape, 0
        kind = bins = codes = node = everyone = values = use = None
        while not fit.done:
            for t in fit.trees[done:]:
                self.margin += t.value[node] if kind is None else t.value[node][kind]
            done = len(fit.trees)
            v = fit.view(0)
            stats = self.watched() if v.ask else None
            best = []
            if len(v.frontier):
                if fit.level == 0:
                    kind, bins = self.kinds_by(v.features)
                    values = self.weighted(v)
                    if kind is not None:
                        values = [np.bincount(kind, x, bins.shape[1]) for x in values]
                    everyone = np.arange(bins.shape[1])
                    node, use, codes = np.ones_like(everyone), everyone, bins
                    if not (values[2] > 0).all():
                        use = np.flatnonzero(values[2] > 0)
                        values, codes = [x[use] for x in values], bins[:, use]
                place = np.full(2 << fit.spec.depth, -1)
                place[v.frontier] = np.arange(len(v.frontier))
                slot = place[node if use is everyone else node[use]]
                if (slot < 0).any():  # what has come to a leaf stays there
                    on = np.flatnonzero(slot >= 0)
                    use, slot, values, codes = use[on], slot[on], [x[on] for x in values], codes[:, on]
                hist = np.empty((3, len(v.frontier), len(bins), b))
                for f, own in enumerate(codes):
                    at = slot * b + own
                    for c, x in enumerate(values):
                        hist[c, :, f] = np.bincount(at, x, len(v.frontier) * b).reshape(-1, b)
                best = [s and (s[0], v.features[s[1]], *s[2:]) for s in splits_of(hist, fit.spec, TIE if self.cells.merged else 0.0)]
                root = np.stack(hist[:, 0, int(hist[2, 0].sum(axis=1).argmax())], axis=1).sum(axis=0) if fit.level == 0 else None
                best = [(s, root) for s in best]
            _advance(fit, stats, best)
            if len(v.frontier):  # on to the children that the level has got
                f, nodes = v.open.feature, np.arange(len(v.open.feature))
                where = np.zeros(fit.shape[0], np.int64)
                where[v.features] = np.arange(len(bins)) * bins.shape[1]
                at, cut, child = np.where(f >= 0, where[f], 0), np.where(f >= 0, v.open.cut, b), np.where(f >= 0, 2 * nodes, nodes)
                node = child[node] + (bins.ravel()[at[node] + everyone] > cut[node])
        return fit


def grow_here(rows: Rows | Cells, fit: Fit) -> Fit:
    """Grow one fit over rows in memory."""
    return Grower(rows if isinstance(rows, Cells) else Cells.of(rows), fit).run()


def grow_by_fit(data: DataFrame, fits: list[Fit]) -> None:
    """Grow each of ``fits`` in a task of its own over a broadcast copy of the binned table,
    which the caller has found to be small.  All tasks run side by side; they write their fits,
    which the driver reads one after another."""
    spark = data.sparkSession
    table, k = data.toArrow(), fits[0].shape[0]
    shared = spark.sparkContext.broadcast(Cells.of(Rows.of(table.combine_chunks().to_batches()[0], k)) if table.num_rows else None)
    del table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{'id': row['id'], 'fit': pickle.dumps(grow_here(shared.value, pickle.loads(row['fit'])))}])

    longest = sorted((i for i, f in enumerate(fits) if not f.done), key=lambda i: -fits[i].spec.rounds * fits[i].spec.depth)
    todo = [(k, i, pickle.dumps(fits[i])) for k, i in enumerate(longest)]  # the longest fits begin first
    if todo:
        jobs = spark.createDataFrame(todo, 'turn long, id long, fit binary').repartitionByRange(len(todo), 'turn')
        for r in written(jobs.mapInArrow(run, 'id long, fit binary'), 'fits').toLocalIterator():
            fits[r.id].__dict__.update(pickle.loads(r.fit).__dict__)
    shared.destroy()


def new_fits(data: DataFrame, shape: tuple[int, int], specs: list[tuple[Spec, int | None]]) -> tuple[list[Fit], int]:
    """Fits at their start, and the rows of the binned table."""
    counts = data.groupBy('part', 'y').agg(F.sum('n').alias('n'), F.count(F.lit(1)).alias('rows')).collect()  # parts x classes
    out = []
    for spec, held in specs:
        n = [sum(r.n for r in counts if r.y == y and (held is None or r.part != held)) for y in (1, 0)]
        out.append(Fit(spec, held, shape, *n))
    return out, sum(r.rows for r in counts)

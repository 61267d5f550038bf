"""Classification metrics, exact ROC / PR curves, run aggregation.

Every operator takes a predictions table and optional ``groups`` (e.g. one row per
model).  Curves are exact (one point per distinct score).  Counts are first reduced per
distinct score (a hot score collapses map-side); the scores are then range-partitioned, the
totals of the partitions are cumulated, and the running sum continues inside each one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import REPORT_TARGET_NAMES
from ..session import written
from .sampling import on_groups


def _ind(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _r6(c):
    return F.round(c, 6)


def confusion_counts(preds: DataFrame, label='label', prediction='prediction', groups=()) -> DataFrame:
    y, yh = F.col(label), F.col(prediction)
    return preds.groupBy(*groups).agg(
        _ind((y == 1) & (yh == 1)).alias('tp'), _ind((y == 0) & (yh == 1)).alias('fp'),
        _ind((y == 1) & (yh == 0)).alias('fn'), _ind((y == 0) & (yh == 0)).alias('tn'),
        F.count(F.lit(1)).alias('n'))


def _binary_cols():
    tp, fp, fn, tn, n = (F.col(c) for c in ('tp', 'fp', 'fn', 'tn', 'n'))
    return {'accuracy': _div(tp + tn, n), 'precision': _div(tp, tp + fp),
            'recall': _div(tp, tp + fn), 'f1': _div(2 * tp, 2 * tp + fp + fn)}


# ---------------------------------------------------------------- F1
def binary_metrics(preds, label='label', prediction='prediction', groups=()) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; zero division -> 0."""
    c = confusion_counts(preds, label, prediction, groups)
    return c.select(*groups, *[_r6(v).alias(k) for k, v in _binary_cols().items()])


# ---------------------------------------------------------------- F2
def weighted_metrics(preds, label='label', prediction='prediction', groups=()) -> DataFrame:
    """Per-class precision/recall/F1 averaged with support weights."""
    c = confusion_counts(preds, label, prediction, groups)
    tp, fp, fn, tn, n = (F.col(x) for x in ('tp', 'fp', 'fn', 'tn', 'n'))
    per = {1: (tp, tp + fp, tp + fn), 0: (tn, tn + fn, tn + fp)}

    def wsum(metric):
        tot = None
        for k, (t, pred_k, true_k) in per.items():
            m = {'p': _div(t, pred_k), 'r': _div(t, true_k), 'f': _div(2 * t, pred_k + true_k)}[metric]
            term = m * true_k
            tot = term if tot is None else tot + term
        return _div(tot, n)
    return c.select(*groups, _r6(_div(tp + tn, n)).alias('accuracy'), _r6(wsum('p')).alias('precision'),
                    _r6(wsum('r')).alias('recall'), _r6(wsum('f')).alias('f1'))


# ---------------------------------------------------------------- F3
def confusion(preds, label='label', prediction='prediction', groups=()) -> DataFrame:
    c = confusion_counts(preds, label, prediction, groups)
    tp, fp, fn, tn = (F.col(x) for x in ('tp', 'fp', 'fn', 'tn'))
    return c.select(*groups, 'tn', 'fp', 'fn', 'tp', _r6(_div(tn, tn + fp)).alias('specificity'),
                    _r6(_div(tp, tp + fn)).alias('sensitivity'))


# ---------------------------------------------------------------- F4
def classification_report(preds, label='label', prediction='prediction', groups=(),
                          target_names=REPORT_TARGET_NAMES) -> DataFrame:
    """Rows: each class, accuracy, macro avg, weighted avg (support = true count)."""
    c = confusion_counts(preds, label, prediction, groups)
    tp, fp, fn, tn, n = (F.col(x) for x in ('tp', 'fp', 'fn', 'tn', 'n'))
    cls = {0: (tn, tn + fn, tn + fp), 1: (tp, tp + fp, tp + fn)}
    m = {k: (_div(t, pk), _div(t, tk), _div(2 * t, pk + tk), tk) for k, (t, pk, tk) in cls.items()}
    rows = [F.struct(F.lit(target_names[k]).alias('row'), p.alias('precision'), r.alias('recall'),
                     f.alias('f1_score'), s.cast('long').alias('support')) for k, (p, r, f, s) in m.items()]
    acc = _div(tp + tn, n)
    rows.append(F.struct(F.lit('accuracy').alias('row'), F.lit(None).cast('double').alias('precision'),
                         F.lit(None).cast('double').alias('recall'), acc.alias('f1_score'),
                         n.cast('long').alias('support')))
    macro = [(m[0][i] + m[1][i]) / 2 for i in range(3)]
    weighted = [_div(m[0][i] * m[0][3] + m[1][i] * m[1][3], n) for i in range(3)]
    for name, vals in (('macro avg', macro), ('weighted avg', weighted)):
        rows.append(F.struct(F.lit(name).alias('row'), vals[0].alias('precision'), vals[1].alias('recall'),
                             vals[2].alias('f1_score'), n.cast('long').alias('support')))
    out = c.select(*groups, F.explode(F.array(*rows)).alias('r')).select(*groups, 'r.*')
    return out.select(*groups, 'row', *[_r6(F.col(x)).alias(x) for x in ('precision', 'recall', 'f1_score')],
                      'support')


# ---------------------------------------------------------------- shared curve table
def _scored(preds: DataFrame, score) -> DataFrame:
    """Rows without a score (null or NaN) take no part in rank metrics."""
    s = F.col(score)
    return preds.filter(s.isNotNull() & ~F.isnan(s.cast('double')))


def score_table(preds, label='label', score='score', groups=()) -> DataFrame:
    """One row per (group, distinct score), descending, with cumulative counts.

    Columns: groups, score, pos, neg, tps, fps (inclusive cumulative counts from the top),
    P, N (group totals), next_pos/next_neg (counts at the next lower distinct score).
    Rows are range-partitioned by (groups, score) and written once, so a partition is the
    same range for its totals and for its running sums; any range of scores splits evenly.
    """
    groups = list(groups)
    y = F.col(label)
    d = _scored(preds, score).groupBy(*groups, F.col(score).alias('score')).agg(_ind(y == 1).alias('pos'), _ind(y != 1).alias('neg'))
    n = int(preds.sparkSession.conf.get('spark.sql.shuffle.partitions'))
    d = written(d.repartitionByRange(n, *groups, F.col('score').desc()).withColumn('_b', F.spark_partition_id()), 'scores')
    bt = d.groupBy(*groups, '_b').agg(F.sum('pos').alias('bp'), F.sum('neg').alias('bn'),
                                      F.max_by(F.struct('pos', 'neg'), 'score').alias('top'))
    wg = Window.partitionBy(*groups)
    wb = wg.orderBy('_b')
    bt = bt.select(*groups, '_b',  # one row per group and partition
                   (F.sum('bp').over(wb) - F.col('bp')).alias('_op'),
                   (F.sum('bn').over(wb) - F.col('bn')).alias('_on'),
                   F.sum('bp').over(wg).alias('P'), F.sum('bn').over(wg).alias('N'),
                   F.lead('top').over(wb).alias('_nexttop'))
    j = on_groups(d, bt, groups, ['_b'])
    wi = Window.partitionBy(*groups, '_b').orderBy(F.col('score').desc())
    run = wi.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(
        *groups, 'score', 'pos', 'neg', 'P', 'N',
        (F.col('_op') + F.sum('pos').over(run)).alias('tps'),
        (F.col('_on') + F.sum('neg').over(run)).alias('fps'),
        F.coalesce(F.lead('pos').over(wi), F.col('_nexttop.pos')).alias('next_pos'),
        F.coalesce(F.lead('neg').over(wi), F.col('_nexttop.neg')).alias('next_neg'),
        (F.lead('pos').over(wi).isNull() & F.col('_nexttop').isNull()).alias('is_last'))


# ---------------------------------------------------------------- F5 / F6
def rank_metrics(preds, label='label', score='score', groups=(), table: DataFrame | None = None) -> DataFrame:
    """auc_roc (ties count one half; null when a class is missing) and average_precision
    (sum over descending thresholds of (R_n - R_n-1) * P_n) in one aggregate; ``table`` is a
    ``score_table`` made before."""
    t = score_table(preds, label, score, groups) if table is None else table
    pos, neg, tps, fps = (F.col(c).cast('double') for c in ('pos', 'neg', 'tps', 'fps'))
    p, n = F.first('P').cast('double'), F.first('N').cast('double')
    ranks, steps = F.sum(neg * (tps - pos * 0.5)), F.sum(pos * tps / (tps + fps))
    return t.groupBy(*groups).agg(_r6(F.when((p > 0) & (n > 0), ranks / (p * n))).alias('auc_roc'),
                                  _r6(F.when(p > 0, steps / p).otherwise(0.0)).alias('average_precision'))


def auc_roc(preds, label='label', score='score', groups=()) -> DataFrame:
    """Rank statistic over the scored rows."""
    return rank_metrics(preds, label, score, groups).select(*groups, 'auc_roc')


def average_precision(preds, label='label', score='score', groups=()) -> DataFrame:
    """Average precision over the scored rows (no interpolation)."""
    return rank_metrics(preds, label, score, groups).select(*groups, 'average_precision')


# ---------------------------------------------------------------- F7
def roc_curve(preds, label='label', score='score', groups=(), drop_intermediate=True, table: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus (inf, 0, 0); collinear points dropped.
    A rate is null where its class is missing."""
    t = score_table(preds, label, score, groups) if table is None else table
    is_first = (F.col('tps') == F.col('pos')) & (F.col('fps') == F.col('neg'))
    keep = is_first | F.col('is_last') | (F.col('pos') != F.col('next_pos')) | (F.col('neg') != F.col('next_neg'))
    point = lambda th, fp, tp: F.struct(th.alias('threshold'), fp.alias('fp'), tp.alias('tp'))
    own = point(F.col('score').cast('double'), F.col('fps'), F.col('tps'))
    origin = point(F.lit(float('inf')), F.lit(0).cast('long'), F.lit(0).cast('long'))
    own = F.when(keep, F.array(own)).otherwise(F.array().cast('array<struct<threshold:double,fp:bigint,tp:bigint>>')) if drop_intermediate else F.array(own)
    # the origin stands beside a group's first point
    pts = t.select(*groups, 'P', 'N', F.explode(F.when(is_first, F.concat(F.array(origin), own)).otherwise(own)).alias('_pt'))
    rate = lambda c, total: _r6(F.when(F.col(total) > 0, F.col(c) / F.col(total)))
    return pts.select(*groups, '_pt.threshold', rate('_pt.fp', 'N').alias('fpr'), rate('_pt.tp', 'P').alias('tpr'))


# ---------------------------------------------------------------- F8
def pr_curve(preds, label='label', score='score', groups=(), table: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall) for every distinct score plus (null, 1, 0)."""
    t = score_table(preds, label, score, groups) if table is None else table
    is_first = (F.col('tps') == F.col('pos')) & (F.col('fps') == F.col('neg'))
    rec = F.when(F.col('P') > 0, F.col('tps') / F.col('P')).otherwise(1.0)
    point = lambda th, pr, re: F.struct(th.cast('double').alias('threshold'), pr.alias('precision'), re.alias('recall'))
    own = F.array(point(F.col('score'), _r6(F.col('tps') / (F.col('tps') + F.col('fps'))), _r6(rec)))
    end = F.array(point(F.lit(None), F.lit(1.0), F.lit(0.0)))  # stands beside a group's first point
    return t.select(*groups, F.explode(F.when(is_first, F.concat(own, end)).otherwise(own)).alias('_pt')).select(*groups, '_pt.*')


# ---------------------------------------------------------------- F9
def aggregate_runs(runs: DataFrame, metrics) -> DataFrame:
    """mean, population std, min, max and n per metric over runs; nulls ignored, and a
    metric without values has no row."""
    long = runs.select(*[F.col(m).cast('double').alias(m) for m in metrics]).unpivot(
        [], list(metrics), 'metric', 'value').filter('value is not null')
    v = F.col('value')
    return long.groupBy('metric').agg(_r6(F.avg(v)).alias('mean'), _r6(F.stddev_pop(v)).alias('std'),
                                      _r6(F.min(v)).alias('min'), _r6(F.max(v)).alias('max'),
                                      F.count(v).alias('n_runs'))


# ---------------------------------------------------------------- F10
def performance_metrics(df: DataFrame, train_seconds='train_seconds', infer_seconds='inference_seconds',
                        n_train='n_train', n_test='n_test') -> DataFrame:
    """ms per train row, ms per test row, test rows per second (guarded denominators)."""
    return df.withColumns({
        'training_time_per_sample_ms': _r6(F.col(train_seconds) / F.greatest(F.col(n_train), F.lit(1)) * 1000),
        'inference_time_per_sample_ms': _r6(F.col(infer_seconds) / F.greatest(F.col(n_test), F.lit(1)) * 1000),
        'throughput_samples_per_second': _r6(F.col(n_test) / F.greatest(F.col(infer_seconds), F.lit(0.001))),
    })


# ---------------------------------------------------------------- F11
def left_on_groups(left: DataFrame, right: DataFrame, groups) -> DataFrame:
    """Left join on the group columns, null groups included."""
    r = right.withColumnsRenamed({c: f'_r_{c}' for c in groups})
    cond = F.lit(True)
    for c in groups:
        cond = cond & left[c].eqNullSafe(r[f'_r_{c}'])
    return left.join(r, cond, 'left').drop(*[f'_r_{c}' for c in groups])


def evaluation_record(preds, groups=(), label='label', prediction='prediction', score='score', table: DataFrame | None = None) -> DataFrame:
    """The scalars of the full record per group: n, metrics, the confusion counts as a struct and
    each row of the report as a struct.  The curves are a table of their own
    (``evaluation_curves``), since they have a point per distinct score."""
    groups = list(groups)
    out = evaluate(preds, groups, label, prediction, score, table=table)
    conf = confusion_counts(preds, label, prediction, groups).select(*groups, F.struct('tn', 'fp', 'fn', 'tp').alias('confusion'))
    out = left_on_groups(out, conf, groups)
    rows = classification_report(preds, label, prediction, groups)
    values = F.struct('precision', 'recall', 'f1_score', 'support')
    names = {**{n: f'class_{i}' for i, n in enumerate(REPORT_TARGET_NAMES)}, 'accuracy': 'accuracy', 'macro avg': 'macro_avg', 'weighted avg': 'weighted_avg'}
    report = rows.groupBy(*groups).agg(*[F.any_value(F.when(F.col('row') == n, values), True).alias(f'report_{short}') for n, short in names.items()])
    return left_on_groups(out, report, groups)


def evaluation_curves(preds, groups=(), label='label', score='score', table: DataFrame | None = None) -> DataFrame:
    """(groups, curve, threshold, x, y): 'roc' with x = fpr, y = tpr, and 'pr' with x = recall,
    y = precision; both from one table of scores."""
    groups = list(groups)
    t = score_table(preds, label, score, groups) if table is None else table
    roc = roc_curve(None, groups=groups, table=t).select(*groups, F.lit('roc').alias('curve'), 'threshold', F.col('fpr').alias('x'), F.col('tpr').alias('y'))
    pr = pr_curve(None, groups=groups, table=t).select(*groups, F.lit('pr').alias('curve'), 'threshold', F.col('recall').alias('x'), F.col('precision').alias('y'))
    return roc.unionByName(pr)


def flatten(record: DataFrame, prefix_sep: str = '_') -> DataFrame:
    """Scalars of a record as one row: struct fields become columns, arrays are left out."""
    cols = []
    for f in record.schema:
        kind = f.dataType.typeName()
        if kind == 'struct':
            cols += [F.col(f'`{f.name}`.`{g.name}`').alias(f'{f.name}{prefix_sep}{g.name}') for g in f.dataType]
        elif kind not in ('array', 'map'):
            cols.append(F.col(f'`{f.name}`'))
    return record.select(*cols)


def evaluate(preds, groups, label='label', prediction='prediction', score='score',
             training_stats: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Flat evaluation record per group: n, class-1 metrics, AUC, AP, ``train_*`` stats."""
    groups = list(groups)
    c = confusion_counts(preds, label, prediction, groups)
    base = c.select(*groups, F.col('n').alias('n_samples'),
                    *[_r6(v).alias(k) for k, v in _binary_cols().items()])
    out = left_on_groups(base, rank_metrics(preds, label, score, groups, table), groups)
    if training_stats is not None:
        stats = training_stats.select(*groups, *[F.col(c).alias(f'train_{c}') for c in training_stats.columns
                                                 if c not in groups])
        out = left_on_groups(out, stats, groups)
    return out


# ---------------------------------------------------------------- F12
def overfit_gap(preds, split='split', label='label', prediction='prediction', groups=(),
                train_value='train', test_value='test') -> DataFrame:
    ok = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    agg = preds.groupBy(*groups).agg(F.avg(F.when(F.col(split) == train_value, ok)).alias('train_accuracy'),
                                     F.avg(F.when(F.col(split) == test_value, ok)).alias('test_accuracy'))
    return agg.select(*groups, _r6('train_accuracy').alias('train_accuracy'),
                      _r6('test_accuracy').alias('test_accuracy'),
                      _r6(F.col('train_accuracy') - F.col('test_accuracy')).alias('overfit_gap'))

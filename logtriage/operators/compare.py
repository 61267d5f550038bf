"""Model comparison over a run table.

A run table has one row per evaluation run with at least ``model``, ``family`` and a
run order column; all operators are aggregates over it (small by nature, but nothing
here collects it to the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: display names of the families
FAMILY_LABELS = {'ML': 'ML (Boosting)', 'Text': 'Transformers'}
TABLE_COLS = ['accuracy', 'precision', 'recall', 'f1', 'train_seconds', 'ms_per_row', 'memory_mb']


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- G1
def latest_run(runs: DataFrame, keys=('model', 'family'), order='run_seq') -> DataFrame:
    """Last appended run per model and family (history is kept in the input)."""
    others = [c for c in runs.columns if c not in keys]
    last = runs.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias('_r'))
    return last.select(*keys, *[F.col('_r')[c].alias(c) for c in others])


# ---------------------------------------------------------------- G2 / G3
def family_table(runs: DataFrame, family: str) -> DataFrame:
    """Latest run per model of one family; missing numbers -> 0; ``rank`` by F1 desc."""
    t = latest_run(runs).filter(F.col('family') == family)
    cols = [F.coalesce(F.col(c).cast('double'), F.lit(0.0)).alias(c) for c in TABLE_COLS]
    extra = [F.coalesce(F.col('epochs'), F.lit(0)).cast('int').alias('epochs')] if family == 'Text' else []
    t = t.select('model', *cols, *extra, F.coalesce('dataset', F.lit('unknown')).alias('dataset'))
    return t.withColumn('rank', F.row_number().over(Window.orderBy(F.col('f1').desc(), 'model')).cast('long'))


def global_table(runs: DataFrame) -> DataFrame:
    parts = []
    for fam, label in FAMILY_LABELS.items():
        parts.append(family_table(runs, fam).select('model', F.lit(label).alias('type'), *TABLE_COLS))
    u = parts[0].unionByName(parts[1])
    return u.withColumn('rank', F.row_number().over(Window.orderBy(F.col('f1').desc(), 'type', 'model')).cast('long'))


# ---------------------------------------------------------------- G4 / G5
def analyze_family(runs: DataFrame, family: str, light_model: str = 'DistilBERT',
                   reference_substring: str = 'BERT', light_exclude: str = 'Distil') -> DataFrame:
    """One-row analysis: best/worst by F1, means, fastest, lowest memory, advice."""
    t = family_table(runs, family)
    r = F.col('rank')
    aggs = [
        F.min_by('model', r).alias('best_model'), F.min_by('f1', r).alias('best_f1'),
        F.max_by('model', r).alias('worst_model'), F.max_by('f1', r).alias('worst_f1'),
        _r6(F.avg('accuracy')).alias('mean_accuracy'), _r6(F.avg('precision')).alias('mean_precision'),
        _r6(F.avg('recall')).alias('mean_recall'), _r6(F.avg('f1')).alias('mean_f1'),
        F.min_by('model', F.struct('train_seconds', r)).alias('fastest_training'),
        F.min_by('model', F.struct('ms_per_row', r)).alias('fastest_inference'),
    ]
    if family == 'ML':
        aggs.append(F.when(F.sum('memory_mb') > 0, F.min_by('model', F.struct('memory_mb', r)))
                    .otherwise(F.lit('N/A')).alias('lowest_memory'))
    else:
        eff = F.col('f1') / (F.col('train_seconds') + 1)
        aggs.append(F.max_by('model', F.struct(eff, -r)).alias('efficiency_winner'))
        ref = F.lower('model').contains(reference_substring.lower()) & ~F.col('model').contains(light_exclude)
        aggs.append(F.max(F.when(F.col('model') == light_model, F.col('f1'))).alias('_light_f1'))
        aggs.append(F.min_by(F.when(ref, F.col('f1')), F.when(ref, r)).alias('_ref_f1'))
    a = t.agg(*aggs)
    best = F.col('best_f1')
    if family == 'ML':
        advice = F.when(best > 0.9, 'excellent').when(best > 0.8, 'good').otherwise('moderate')
        return a.withColumn('advice', advice)
    light_ok = F.coalesce(F.col('_light_f1') >= F.col('_ref_f1') * 0.97, F.lit(False))
    return (a.withColumn('advice', F.when(best > 0.9, 'excellent').otherwise(F.lit(None).cast('string')))
            .withColumn('light_model_advice', light_ok).drop('_light_f1', '_ref_f1'))


# ---------------------------------------------------------------- G6
def analyze_cross(runs: DataFrame) -> DataFrame:
    """Best F1 per family, mean train and inference time winners and ratios."""
    ml = family_table(runs, 'ML').agg(F.max('f1').alias('ml_best_f1'), F.avg('train_seconds').alias('ml_train'),
                                      F.avg('ms_per_row').alias('ml_infer'))
    tx = family_table(runs, 'Text').agg(F.max('f1').alias('tx_best_f1'), F.avg('train_seconds').alias('tx_train'),
                                        F.avg('ms_per_row').alias('tx_infer'))
    j = ml.unionByName(tx, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ('ml_best_f1', 'ml_train', 'ml_infer', 'tx_best_f1', 'tx_train', 'tx_infer')])
    c = F.col
    return j.select(
        _r6(c('ml_best_f1')).alias('ml_best_f1'), _r6(c('tx_best_f1')).alias('transformer_best_f1'),
        F.when(c('tx_best_f1') > c('ml_best_f1'), 'Transformers').otherwise('ML').alias('f1_winner'),
        _r6(F.abs(c('tx_best_f1') - c('ml_best_f1'))).alias('f1_difference'),
        _r6(c('ml_train')).alias('ml_mean_train_seconds'), _r6(c('tx_train')).alias('transformer_mean_train_seconds'),
        F.when(c('ml_train') < c('tx_train'), 'ML').otherwise('Transformers').alias('train_winner'),
        _r6(c('tx_train') / F.greatest(c('ml_train'), F.lit(0.001))).alias('train_ratio'),
        _r6(c('ml_infer')).alias('ml_mean_ms_per_row'), _r6(c('tx_infer')).alias('transformer_mean_ms_per_row'),
        F.when(c('ml_infer') < c('tx_infer'), 'ML').otherwise('Transformers').alias('inference_winner'),
        _r6(c('tx_infer') / F.greatest(c('ml_infer'), F.lit(0.001))).alias('inference_ratio'))


# ---------------------------------------------------------------- G7 / G8 / G10
def scoreboard(results: DataFrame, criteria: list, groups=(), name_col='model') -> DataFrame:
    """Weighted min-max scoreboard.

    ``criteria``: tuples ``(score_name, column_expr, weight, mode)``; mode is ``'higher'``,
    ``'lower'`` (1 - normalised), ``'lower_max'`` ((max - x) / (max - min), the other
    published variant) or ``'raw'`` (value used as is).  A constant column scores 1.
    """
    w = Window.partitionBy(*groups)
    cols, total = [], None
    for name, expr, weight, mode in criteria:
        x = F.expr(expr) if isinstance(expr, str) else expr
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        if mode == 'raw':
            s = x
        else:
            norm = (x - lo) / (hi - lo)
            s = {'higher': norm, 'lower': 1 - norm, 'lower_max': (hi - x) / (hi - lo)}[mode]
            s = F.when(hi == lo, F.lit(1.0)).otherwise(s)
        cols.append(s.alias(name))
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    scored = results.select(*groups, name_col, *cols)
    return scored.withColumn('total_score', total).select(
        *groups, name_col, *[_r6(F.col(c[0])).alias(c[0]) for c in criteria], _r6('total_score').alias('total_score'))


# ------------------------------------------------ fixed values: weights of the scoreboards
ML_CRITERIA = [
    ('score_f1_test', 'f1', 0.45, 'higher'),
    ('score_cv_f1', 'cv_f1_mean', 0.40, 'higher'),
    ('score_stability', 'cv_f1_std', 0.15, 'lower'),
    ('score_overfit', 'abs(overfit_gap)', 0.0, 'lower'),
    ('score_speed', 'train_cpu_seconds', 0.0, 'lower'),
]
TEXT_CRITERIA = [
    ('score_f1_test', 'f1', 0.40, 'higher'),
    ('score_overfit', 'abs(overfit_gap)', 0.10, 'lower_max'),
    ('score_speed', 'train_seconds', 0.10, 'lower_max'),
    ('score_memory', 'abs(memory_mb)', 0.20, 'lower_max'),
    ('score_token_loss', '1.0 - pct_tokens_lost / 100', 0.20, 'raw'),
]


def winners(scores: DataFrame, groups=('dataset',), name_col='model') -> DataFrame:
    """Top total score per dataset (ties: name ascending)."""
    w = Window.partitionBy(*groups).orderBy(F.col('total_score').desc(), name_col)
    return (scores.withColumn('_r', F.row_number().over(w)).filter('_r = 1')
            .select(*groups, F.col(name_col).alias('winner'), 'total_score'))


# ---------------------------------------------------------------- G9
def best_by(results: DataFrame, criteria: list, name_col='model') -> DataFrame:
    """One winner per criterion: ``(criterion, column_expr, 'max'|'min')``; ties by name.

    One aggregate over the table; rows whose value is null cannot win.
    """
    picks = []
    for crit, expr, how in criteria:
        value = (F.expr(expr) if isinstance(expr, str) else expr).cast('double')
        key = -value if how == 'max' else value
        order = F.when(key.isNotNull(), F.struct(key.alias('key'), F.col(name_col).alias('name')))
        best = F.min_by(F.struct(F.col(name_col).alias('model'), _r6(value).alias('value')), order)
        picks.append(F.struct(F.lit(crit).alias('criterion'), best.alias('best')))
    out = results.agg(F.array(*picks).alias('p')).select(F.explode('p').alias('p'))
    return out.filter('p.best is not null').select('p.criterion', 'p.best.model', 'p.best.value')

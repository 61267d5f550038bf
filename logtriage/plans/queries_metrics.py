"""Registered metric (F1-F12) and comparison (G1-G10) queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import REPORT_TARGET_NAMES
from ..operators import compare as G
from ..operators import metrics as M
from . import oracle as O
from .views import preds, runs

QUERIES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _conf(groups=''):
    g = f'{groups}, ' if groups else ''
    gb = f' GROUP BY {groups}' if groups else ''
    return (f"SELECT {g}CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            "CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            "CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            "CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            f"count(*) AS n FROM preds{gb}")


def _d(a, b):
    return f'CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END'


_BIN = {'accuracy': _d('tp + tn', 'n'), 'precision': _d('tp', 'tp + fp'), 'recall': _d('tp', 'tp + fn'),
        'f1': _d('2 * tp', '2 * tp + fp + fn')}


def _bin_cols():
    return ', '.join(f'round({v}, 6) AS {k}' for k, v in _BIN.items())


@register('f1_binary_metrics', O.with_views(f'SELECT {_bin_cols()} FROM ({_conf()})', 'preds'))
def q_binary(spark, sf):
    return M.binary_metrics(preds(spark, sf))


def _wsum(kind):
    per = {1: ('tp', 'tp + fp', 'tp + fn'), 0: ('tn', 'tn + fn', 'tn + fp')}
    terms = []
    for t, pk, tk in per.values():
        m = {'p': _d(t, pk), 'r': _d(t, tk), 'f': _d(f'2 * {t}', f'{pk} + {tk}')}[kind]
        terms.append(f'({m}) * ({tk})')
    return _d(' + '.join(terms), 'n')


@register('f2_weighted_metrics', O.with_views(
    f"SELECT round({_BIN['accuracy']}, 6) AS accuracy, round({_wsum('p')}, 6) AS precision, "
    f"round({_wsum('r')}, 6) AS recall, round({_wsum('f')}, 6) AS f1 FROM ({_conf()})", 'preds'))
def q_weighted(spark, sf):
    return M.weighted_metrics(preds(spark, sf))


@register('f3_confusion_matrix', O.with_views(
    f"SELECT tn, fp, fn, tp, round({_d('tn', 'tn + fp')}, 6) AS specificity, "
    f"round({_d('tp', 'tp + fn')}, 6) AS sensitivity FROM ({_conf()})", 'preds'))
def q_confusion(spark, sf):
    return M.confusion(preds(spark, sf))


def _report_sql():
    rows = []
    for name, (t, pk, tk) in ((REPORT_TARGET_NAMES[0], ('tn', 'tn + fn', 'tn + fp')),
                              (REPORT_TARGET_NAMES[1], ('tp', 'tp + fp', 'tp + fn'))):
        rows.append(f"SELECT {O.lit(name)} AS row, round({_d(t, pk)}, 6) AS precision, round({_d(t, tk)}, 6) AS recall, "
                    f"round({_d('2 * ' + t, pk + ' + ' + tk)}, 6) AS f1_score, CAST({tk} AS BIGINT) AS support FROM c")
    rows.append(f"SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round({_BIN['accuracy']}, 6), n FROM c")
    m0 = [_d('tn', 'tn + fn'), _d('tn', 'tn + fp'), _d('2 * tn', 'tn + fn + tn + fp')]
    m1 = [_d('tp', 'tp + fp'), _d('tp', 'tp + fn'), _d('2 * tp', 'tp + fp + tp + fn')]
    rows.append("SELECT 'macro avg', " + ', '.join(f'round((({a}) + ({b})) / 2, 6)' for a, b in zip(m0, m1))
                + ', n FROM c')
    rows.append("SELECT 'weighted avg', " + ', '.join(
        f"round({_d(f'({a}) * (tn + fp) + ({b}) * (tp + fn)', 'n')}, 6)" for a, b in zip(m0, m1)) + ', n FROM c')
    return O.with_views(f'SELECT * FROM (WITH c AS ({_conf()}) ' + ' UNION ALL '.join(rows) + ')', 'preds')


@register('f4_classification_report', _report_sql())
def q_report(spark, sf):
    return M.classification_report(preds(spark, sf))


def _curve_cte(groups=''):
    p = f'PARTITION BY {groups} ' if groups else ''
    g = f'{groups}, ' if groups else ''
    return (f"d AS (SELECT {g}score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos, "
            f"CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM preds GROUP BY {g}score), "
            f"t AS (SELECT {g}score, pos, neg, "
            f"sum(pos) OVER ({p}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps, "
            f"sum(neg) OVER ({p}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps, "
            f"sum(pos) OVER ({p}) AS P, sum(neg) OVER ({p}) AS N, max(score) OVER ({p}) AS top, "
            f"lead(pos) OVER ({p}ORDER BY score DESC) AS next_pos, lead(neg) OVER ({p}ORDER BY score DESC) AS next_neg "
            "FROM d)")


_AUC = ("round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * ((tps - pos) + pos * 0.5)) / (max(P) * max(N)) "
        "END, 6)")
_AP = 'round(CASE WHEN max(P) > 0 THEN sum(pos * tps / (tps + fps)) / max(P) ELSE 0.0 END, 6)'


def q_auc(spark, sf):
    return M.auc_roc(preds(spark, sf))


def _with_curve(body, groups=''):
    return O.with_views('', 'preds').rstrip() + ', ' + _curve_cte(groups) + ' ' + body


QUERIES['f5_auc_roc'] = (q_auc, _with_curve(f'SELECT {_AUC} AS auc_roc FROM t'))


@register('f6_average_precision', _with_curve(f'SELECT {_AP} AS average_precision FROM t'))
def q_ap(spark, sf):
    return M.average_precision(preds(spark, sf))


@register('f7_roc_curve', _with_curve(
    "SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
    "SELECT score, round(fps / N, 6), round(tps / P, 6) FROM t "
    "WHERE score = top OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg"))
def q_roc(spark, sf):
    return M.roc_curve(preds(spark, sf))


@register('f8_pr_curve', _with_curve(
    "SELECT score AS threshold, round(tps / (tps + fps), 6) AS precision, "
    "round(CASE WHEN P > 0 THEN tps / P ELSE 1.0 END, 6) AS recall FROM t "
    "UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0"))
def q_pr(spark, sf):
    return M.pr_curve(preds(spark, sf))


_AGG_METRICS = ['accuracy', 'precision', 'recall', 'f1', 'train_seconds', 'memory_mb', 'epochs']


@register('f9_aggregate_runs', O.with_views(
    "SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, "
    "round(max(value), 6) AS max, count(value) AS n_runs FROM (UNPIVOT (SELECT "
    + ', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in _AGG_METRICS) + ' FROM runs) ON '
    + ', '.join(_AGG_METRICS) + ' INTO NAME metric VALUE value) GROUP BY metric', 'runs'))
def q_aggregate(spark, sf):
    return M.aggregate_runs(runs(spark, sf), _AGG_METRICS)


@register('f10_performance_metrics', O.with_views(
    "SELECT model, family, dataset, "
    "round(train_seconds / greatest(n_rows, 1) * 1000, 6) AS training_time_per_sample_ms, "
    "round(ms_per_row * n_rows / 1000 / greatest(n_rows, 1) * 1000, 6) AS inference_time_per_sample_ms, "
    "round(n_rows / greatest(ms_per_row * n_rows / 1000, 0.001), 6) AS throughput_samples_per_second FROM runs",
    'runs'))
def q_performance(spark, sf):
    r = runs(spark, sf).select('model', 'family', 'dataset', 'train_seconds',
                               (F.col('ms_per_row') * F.col('n_rows') / 1000).alias('inference_seconds'),
                               F.col('n_rows').alias('n_train'), F.col('n_rows').alias('n_test'))
    return M.performance_metrics(r).select('model', 'family', 'dataset', 'training_time_per_sample_ms',
                                           'inference_time_per_sample_ms', 'throughput_samples_per_second')


@register('f11_evaluate_flat', _with_curve(f"""
SELECT c.source, c.n AS n_samples, {', '.join(f'round({v}, 6) AS {k}' for k, v in _BIN.items())},
       a.auc_roc, a.average_precision, s.train_seconds, s.train_memory_mb
FROM ({_conf('source')}) c
JOIN (SELECT source, {_AUC} AS auc_roc, {_AP} AS average_precision FROM t GROUP BY source) a USING (source)
LEFT JOIN (SELECT model AS source, round(sum(train_seconds), 6) AS train_seconds,
                  round(sum(memory_mb), 6) AS train_memory_mb FROM runs GROUP BY model) s USING (source)""",
                                               'source').replace('WITH preds AS', 'WITH preds AS', 1)
          .replace(', d AS (', f', runs AS ({O.runs_sql()}), d AS (', 1))
def q_evaluate(spark, sf):
    st = runs(spark, sf).groupBy(F.col('model').alias('source')).agg(
        F.round(F.sum('train_seconds'), 6).alias('seconds'), F.round(F.sum('memory_mb'), 6).alias('memory_mb'))
    return M.evaluate(preds(spark, sf), ['source'], training_stats=st)


def _record_sql():
    """All scalars of the record by source."""
    out = ['c.source', 'c.n AS n_samples', *[f'round({v}, 6) AS {k}' for k, v in _BIN.items()], 'a.auc_roc', 'a.average_precision', *[f'{x} AS confusion_{x}' for x in ('tn', 'fp', 'fn', 'tp')]]
    cls = {0: ('tn', 'tn + fn', 'tn + fp'), 1: ('tp', 'tp + fp', 'tp + fn')}
    m = {k: (_d(t, pk), _d(t, tk), _d(f'2 * {t}', f'{pk} + {tk}'), tk) for k, (t, pk, tk) in cls.items()}
    rows = {f'class_{k}': [*m[k][:3], f'CAST({m[k][3]} AS BIGINT)'] for k in m}
    rows['accuracy'] = ['CAST(NULL AS DOUBLE)', 'CAST(NULL AS DOUBLE)', _BIN['accuracy'], 'c.n']
    rows['macro_avg'] = [*[f'(({m[0][i]}) + ({m[1][i]})) / 2' for i in range(3)], 'c.n']
    rows['weighted_avg'] = [*[_d(f'({m[0][i]}) * (tn + fp) + ({m[1][i]}) * (tp + fn)', 'c.n') for i in range(3)], 'c.n']
    for name, values in rows.items():
        for field, v in zip(('precision', 'recall', 'f1_score', 'support'), values, strict=True):
            out.append(f"{v if field == 'support' else f'round({v}, 6)'} AS report_{name}_{field}")
    return _with_curve(f"SELECT {', '.join(out)} FROM ({_conf('source')}) c JOIN (SELECT source, {_AUC} AS auc_roc, {_AP} AS average_precision FROM t GROUP BY source) a USING (source)", 'source')


@register('f11_evaluation_record', _record_sql())
def q_record(spark, sf):
    return M.flatten(M.evaluation_record(preds(spark, sf), ['source']))


@register('f11_evaluation_curves', _with_curve(
    "SELECT DISTINCT source, 'roc' AS curve, CAST('Infinity' AS DOUBLE) AS threshold, CASE WHEN N > 0 THEN 0.0 END AS x, CASE WHEN P > 0 THEN 0.0 END AS y FROM t UNION ALL "
    "SELECT source, 'roc', score, round(CASE WHEN N > 0 THEN fps / N END, 6), round(CASE WHEN P > 0 THEN tps / P END, 6) FROM t WHERE score = top OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg "
    "UNION ALL SELECT source, 'pr', score, round(CASE WHEN P > 0 THEN tps / P ELSE 1.0 END, 6), round(tps / (tps + fps), 6) FROM t "
    "UNION ALL SELECT DISTINCT source, 'pr', CAST(NULL AS DOUBLE), 0.0, 1.0 FROM t", 'source'))
def q_curves(spark, sf):
    return M.evaluation_curves(preds(spark, sf), ['source'])


@register('f12_overfit_gap', O.with_views(
    "SELECT source, round(tr, 6) AS train_accuracy, round(te, 6) AS test_accuracy, round(tr - te, 6) AS overfit_gap "
    "FROM (SELECT source, avg(CASE WHEN split = 'train' THEN CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END END) AS tr, "
    "avg(CASE WHEN split = 'test' THEN CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END END) AS te "
    "FROM preds GROUP BY source)", 'preds'))
def q_overfit(spark, sf):
    return M.overfit_gap(preds(spark, sf), groups=['source'])


# ---------------------------------------------------------------- G1-G10
_LATEST = "latest AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY model, family ORDER BY run_seq DESC) AS _rn FROM runs) WHERE _rn = 1)"
_COLS = ['accuracy', 'precision', 'recall', 'f1', 'train_seconds', 'ms_per_row', 'memory_mb']


def _runs_with(*ctes):
    return O.with_views('', 'runs').rstrip() + ', ' + ', '.join(ctes) + ' '


def _family_sql(fam):
    extra = ', CAST(coalesce(epochs, 0) AS INTEGER) AS epochs' if fam == 'Text' else ''
    cols = ', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in _COLS)
    return (f"SELECT model, {cols}{extra}, coalesce(dataset, 'unknown') AS dataset, "
            f"row_number() OVER (ORDER BY f1 DESC, model) AS rank FROM latest WHERE family = '{fam}'")


@register('g1_latest_run', _runs_with(_LATEST) + 'SELECT * FROM latest')
def q_latest(spark, sf):
    return G.latest_run(runs(spark, sf))


@register('g2_family_table_ml', _runs_with(_LATEST) + _family_sql('ML'))
def q_family_ml(spark, sf):
    return G.family_table(runs(spark, sf), 'ML')


@register('g2_family_table_text', _runs_with(_LATEST) + _family_sql('Text'))
def q_family_text(spark, sf):
    return G.family_table(runs(spark, sf), 'Text')


@register('g3_global_table', _runs_with(_LATEST, f"ml AS ({_family_sql('ML')})", f"tx AS ({_family_sql('Text')})") + f"""
SELECT *, row_number() OVER (ORDER BY f1 DESC, type, model) AS rank FROM (
  SELECT model, 'ML (Boosting)' AS type, {', '.join(_COLS)} FROM ml UNION ALL
  SELECT model, 'Transformers' AS type, {', '.join(_COLS)} FROM tx)""")
def q_global(spark, sf):
    return G.global_table(runs(spark, sf))


def _analyze_sql(fam, light='src3', ref='src', excl='src3'):
    common = ("first(model ORDER BY rank) AS best_model, first(f1 ORDER BY rank) AS best_f1, "
              "first(model ORDER BY rank DESC) AS worst_model, first(f1 ORDER BY rank DESC) AS worst_f1, "
              "round(avg(accuracy), 6) AS mean_accuracy, round(avg(precision), 6) AS mean_precision, "
              "round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, "
              "first(model ORDER BY train_seconds, rank) AS fastest_training, "
              "first(model ORDER BY ms_per_row, rank) AS fastest_inference")
    if fam == 'ML':
        return (_runs_with(_LATEST, f"ft AS ({_family_sql('ML')})") +
                f"SELECT *, CASE WHEN best_f1 > 0.9 THEN 'excellent' WHEN best_f1 > 0.8 THEN 'good' ELSE 'moderate' END "
                f"AS advice FROM (SELECT {common}, CASE WHEN sum(memory_mb) > 0 THEN first(model ORDER BY memory_mb, rank) "
                "ELSE 'N/A' END AS lowest_memory FROM ft)")
    return (_runs_with(_LATEST, f"ft AS ({_family_sql('Text')})") +
            "SELECT * EXCLUDE (lf, rf), CASE WHEN best_f1 > 0.9 THEN 'excellent' END AS advice, "
            "coalesce(lf >= rf * 0.97, false) AS light_model_advice FROM ("
            f"SELECT {common}, first(model ORDER BY f1 / (train_seconds + 1) DESC, rank) AS efficiency_winner, "
            f"max(CASE WHEN model = '{light}' THEN f1 END) AS lf, "
            f"first(f1 ORDER BY rank) FILTER (WHERE contains(lower(model), '{ref}') AND NOT contains(model, '{excl}')) AS rf "
            "FROM ft)")


@register('g4_analyze_family_ml', _analyze_sql('ML'))
def q_analyze_ml(spark, sf):
    return G.analyze_family(runs(spark, sf), 'ML')


@register('g5_analyze_family_text', _analyze_sql('Text'))
def q_analyze_text(spark, sf):
    return G.analyze_family(runs(spark, sf), 'Text', light_model='src3', reference_substring='src',
                            light_exclude='src3')


@register('g6_analyze_cross', _runs_with(_LATEST, f"ml AS ({_family_sql('ML')})", f"tx AS ({_family_sql('Text')})") + """
SELECT round(mb, 6) AS ml_best_f1, round(tb, 6) AS transformer_best_f1,
       CASE WHEN tb > mb THEN 'Transformers' ELSE 'ML' END AS f1_winner, round(abs(tb - mb), 6) AS f1_difference,
       round(mt, 6) AS ml_mean_train_seconds, round(tt, 6) AS transformer_mean_train_seconds,
       CASE WHEN mt < tt THEN 'ML' ELSE 'Transformers' END AS train_winner,
       round(tt / greatest(mt, 0.001), 6) AS train_ratio,
       round(mi, 6) AS ml_mean_ms_per_row, round(ti, 6) AS transformer_mean_ms_per_row,
       CASE WHEN mi < ti THEN 'ML' ELSE 'Transformers' END AS inference_winner,
       round(ti / greatest(mi, 0.001), 6) AS inference_ratio
FROM (SELECT max(f1) AS mb, avg(train_seconds) AS mt, avg(ms_per_row) AS mi FROM ml),
     (SELECT max(f1) AS tb, avg(train_seconds) AS tt, avg(ms_per_row) AS ti FROM tx)""")
def q_cross(spark, sf):
    return G.analyze_cross(runs(spark, sf))


def _score_sql(criteria, src, groups=''):
    p = f'PARTITION BY {groups}' if groups else ''
    g = f'{groups}, ' if groups else ''
    cols, total = [], []
    for name, expr, weight, mode in criteria:
        lo, hi = f'min({expr}) OVER ({p})', f'max({expr}) OVER ({p})'
        if mode == 'raw':
            s = expr
        else:
            norm = f'(({expr}) - {lo}) / ({hi} - {lo})'
            s = {'higher': norm, 'lower': f'1 - {norm}', 'lower_max': f'({hi} - ({expr})) / ({hi} - {lo})'}[mode]
            s = f'CASE WHEN {hi} = {lo} THEN 1.0 ELSE {s} END'
        cols.append(f'{s} AS {name}')
        total.append(f'{name} * {O.dbl(weight)}')
    names = [c[0] for c in criteria]
    return (f"SELECT {g}model, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, "
            f"round({' + '.join(total)}, 6) AS total_score FROM (SELECT {g}model, {', '.join(cols)} FROM {src})")


@register('g7_scoreboard_ml', _runs_with(_LATEST) + _score_sql(G.ML_CRITERIA, "latest WHERE family = 'ML'"))
def q_score_ml(spark, sf):
    return G.scoreboard(G.latest_run(runs(spark, sf)).filter("family = 'ML'"), G.ML_CRITERIA)


@register('g8_scoreboard_text', _runs_with(_LATEST) + _score_sql(G.TEXT_CRITERIA, "latest WHERE family = 'Text'"))
def q_score_text(spark, sf):
    return G.scoreboard(G.latest_run(runs(spark, sf)).filter("family = 'Text'"), G.TEXT_CRITERIA)


_BEST_ML = [('f1', 'f1', 'max'), ('cv_f1_mean', 'cv_f1_mean', 'max'), ('cv_f1_std', 'cv_f1_std', 'min'),
            ('abs_overfit_gap', 'abs(overfit_gap)', 'min'), ('train_cpu_seconds', 'train_cpu_seconds', 'min')]


def _best_sql():
    parts = []
    for crit, expr, how in _BEST_ML:
        agg = 'max' if how == 'max' else 'min'
        parts.append(f"SELECT '{crit}' AS criterion, model, round({expr}, 6) AS value FROM ml WHERE model = "
                     f"(SELECT min(model) FROM ml WHERE {expr} = (SELECT {agg}({expr}) FROM ml))")
    return _runs_with(_LATEST, "ml AS (SELECT * FROM latest WHERE family = 'ML')") + ' UNION ALL '.join(parts)


@register('g9_best_by_criterion', _best_sql())
def q_best(spark, sf):
    return G.best_by(G.latest_run(runs(spark, sf)).filter("family = 'ML'"),
                     [(c, e, h) for c, e, h in _BEST_ML])


@register('g10_winner_per_dataset', O.with_views(
    "SELECT dataset, model AS winner, total_score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY dataset ORDER BY total_score DESC, model) AS _r FROM ("
    + _score_sql(G.ML_CRITERIA, 'runs', 'dataset') + ')) WHERE _r = 1', 'runs'))
def q_winners(spark, sf):
    return G.winners(G.scoreboard(runs(spark, sf), G.ML_CRITERIA, groups=['dataset']))

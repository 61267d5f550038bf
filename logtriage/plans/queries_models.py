"""Registered queries: word ids (D10-D15), models (E1-E15, A8), sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import boosting as B
from ..models import text as T
from ..operators import encoding as N
from ..operators.preprocess import dedup_keep_first
from ..operators.sampling import hash_uniform
from ..session import read_table, scratch_path, written
from ..sources import readers, writers
from . import models_sql as M
from . import oracle as O
from .queries_features import TOKS
from .views import ci_logs, doc_lines, preds

QUERIES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _docs(spark, sf):
    return read_table(spark, sf, 'documents').select('doc_id', 'text')


# ---------------------------------------------------------------- D10-D15
_SIZE, _LEN = 5000, 128
_VOCAB = f"""vocab AS (SELECT token, CAST(3 + row_number() OVER (ORDER BY df DESC, token) AS INTEGER) AS token_id FROM (
    SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM toks) GROUP BY token
    ORDER BY df DESC, token LIMIT {_SIZE}))"""
_IDS = f"""ids AS (SELECT doc_id, coalesce(list(coalesce(token_id, 1) ORDER BY p) FILTER (p IS NOT NULL), []) AS w FROM (
    SELECT k.doc_id, u.p, v.token_id FROM toks k
    LEFT JOIN (SELECT doc_id, unnest(range(1, 1 + least(len(t), {_LEN - 2}))) AS p,
                      unnest(t[1:{_LEN - 2}]) AS token FROM toks) u ON u.doc_id = k.doc_id
    LEFT JOIN vocab v ON v.token = u.token) GROUP BY doc_id)"""
_ENC = 'WITH ' + ', '.join([TOKS, _VOCAB, _IDS]) + ' '


def _vocab(spark, sf):
    return N.fit_token_vocab(_docs(spark, sf), max_size=_SIZE)


@register('d10_encode_fixed_length', _ENC + f"""
SELECT doc_id, list_concat([2], w, [3], list_transform(range({_LEN} - 2 - len(w)), lambda i: 0)) AS input_ids,
       list_concat(list_transform(range(len(w) + 2), lambda i: 1), list_transform(range({_LEN} - 2 - len(w)), lambda i: 0)) AS attention_mask
FROM ids""")
def q_encode(spark, sf):
    return N.encode(_docs(spark, sf), _vocab(spark, sf), _LEN, max_size=_SIZE)


@register('d11_decode', _ENC + f"""
SELECT k.doc_id, coalesce(string_agg(v.token, ' ' ORDER BY p), '') AS text FROM toks k
LEFT JOIN (SELECT doc_id, unnest(range(1, 1 + least(len(t), {_LEN - 2}))) AS p, unnest(t[1:{_LEN - 2}]) AS token FROM toks) u ON u.doc_id = k.doc_id
LEFT JOIN vocab v ON v.token = u.token GROUP BY k.doc_id""")
def q_decode(spark, sf):
    vocab = written(_vocab(spark, sf), 'vocab')
    return N.decode(N.encode(_docs(spark, sf), vocab, _LEN, max_size=_SIZE), vocab)


@register('d12_token_vocab_info', 'WITH ' + ', '.join([TOKS, _VOCAB]) + """
SELECT 'vocab_size' AS name, (SELECT count(*) + 4 FROM vocab) AS value
UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[START]', 2), ('[END]', 3))""")
def q_vocab_info(spark, sf):
    return N.token_vocab_info(_vocab(spark, sf))


@register('d13_token_stats', f"""WITH {TOKS}, n AS (SELECT len(t) + 2 AS n FROM toks)
SELECT count(n) AS num_texts, round(avg(n), 6) AS mean_length, max(n) AS max_length, min(n) AS min_length,
       count(CASE WHEN n > 256 THEN 1 END) AS truncated_count FROM n""")
def q_token_stats(spark, sf):
    return N.token_stats(_docs(spark, sf))


@register('d14_token_loss', f"""WITH {TOKS}, n AS (SELECT len(t) + 2 AS n FROM toks)
SELECT CAST(sum(n) AS BIGINT) AS total_tokens, count(CASE WHEN n > 512 THEN 1 END) AS samples_truncated,
       CAST(sum(greatest(n - 512, 0)) AS BIGINT) AS tokens_lost, round(count(CASE WHEN n > 512 THEN 1 END) * 100 / count(*), 6) AS pct_samples_truncated,
       round(sum(greatest(n - 512, 0)) * 100 / sum(n), 6) AS pct_tokens_lost FROM n""")
def q_token_loss(spark, sf):
    return N.token_loss(_docs(spark, sf))


@register('d15_masked_mean_pool', """
WITH tok AS (SELECT l_orderkey AS doc_id, l_partkey % 400 AS vec_id FROM lineitem),
j AS (SELECT t.doc_id, unnest(range(len(e.embedding))) AS dim, unnest(e.embedding) AS x FROM tok t JOIN embeddings e USING (vec_id))
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(x::double), 6) AS value FROM j GROUP BY doc_id, dim""")
def q_mean_pool(spark, sf):
    tok = read_table(spark, sf, 'lineitem').select(F.col('l_orderkey').alias('doc_id'), (F.col('l_partkey') % 400).alias('vec_id'))
    out = N.mean_pool(tok, read_table(spark, sf, 'embeddings'), token_col='vec_id', vector_col='embedding')
    return out.select('doc_id', 'dim', F.round('value', 6).alias('value'))


# ---------------------------------------------------------------- E1-E13, A8
# The benchmark preset of plain boosting has an oracle that fits the stumps in SQL; deeper
# trees and AdaBoost are compared with a plain version in tests/test_models.py.
_COLS, _KEYS = M.FEATURES, M.KEYS


def _lines(spark, sf):
    """lineitem rows: label 1 if the part was returned or is expensive for its quantity."""
    li = read_table(spark, sf, 'lineitem').select(*_KEYS, 'l_returnflag', *_COLS)
    label = (F.col('l_returnflag') == 'R') | (F.col('l_extendedprice') > 1500 * F.col('l_quantity'))
    li = li.withColumn('label', label.cast('int'))
    test = hash_uniform(_KEYS, 42, 'split') < 0.2
    return li.filter(~test), li.filter(test)


def _fit(d, **options):
    return B.fit_boosted(d, _COLS, 'gb_benchmark', **options)


def _judged(model, test):
    """E6 without the clock's readings, which no two runs share."""
    out = B.evaluate_on(model, test)
    return out.select('accuracy', 'precision', 'recall', 'f1', 'n_rows', ((F.col('inference_seconds') > 0) & (F.col('ms_per_row') > 0)).alias('timed'))


def _stats(model):
    return B.training_stats(model).select('n_rows', 'n_features', 'rounds', 'best_round', F.round('last_deviance', 6).alias('last_deviance'), (F.col('seconds') > 0).alias('timed'))


def _predicted(model, test):
    return B.score(model, test).select(*_KEYS, 'prediction', F.round('probability_0', 6).alias('probability_0'), F.round('probability_1', 6).alias('probability_1'))


@register('e1_boosted_trees_regularised')
def q_boosted(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(B.fit_boosted(train, _COLS, 'xgb'), test)


@register('e1_boosted_trees_benchmark')
def q_boosted_benchmark(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(B.fit_boosted(train, _COLS, 'xgb_benchmark'), test)


@register('e2_boosted_trees_plain', M.EVALUATE)
def q_plain(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(_fit(train), test)


@register('e2_boosted_trees_library')
def q_plain_library(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(B.fit_boosted(train, _COLS, 'gb', keys=_KEYS), test)


@register('e2_boosted_nodes', M.NODES)
def q_nodes(spark, sf):
    nodes = _fit(_lines(spark, sf)[0]).nodes(spark)
    leaf = nodes.filter('feature is null').select('round', 'node', 'value')
    top = nodes.filter('node = 1 and feature is not null').drop('value', 'node')
    for name, node in (('left_value', 2), ('right_value', 3)):
        top = top.join(leaf.filter(F.col('node') == node).select('round', F.round('value', 6).alias(name)), 'round')
    return top.select('round', 'feature', 'cut', 'threshold', 'left_value', 'right_value', F.round('gain', 6).alias('gain'), 'rows')


@register('e3_adaboost', M.ADABOOST)
def q_adaboost(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(B.fit_adaboost(train, _COLS, 'ada_benchmark'), test)


@register('e4_adaboost_real')
def q_adaboost_real(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(B.fit_adaboost(train, _COLS, 'ada'), test)


@register('e5_predict_proba', M.PREDICT)
def q_predict(spark, sf):
    train, test = _lines(spark, sf)
    return _predicted(_fit(train), test)


@register('e5_margins_by_join', M.MARGINS)
def q_margins(spark, sf):
    train, test = _lines(spark, sf)
    out = B.margins_by_join(_fit(train), test, _KEYS)
    return out.select(*_KEYS, F.round('margin', 6).alias('margin'))


@register('e6_evaluate_model_on', M.EVALUATE)
def q_evaluate_on(spark, sf):
    train, test = _lines(spark, sf)
    return _judged(_fit(train), test)


@register('e7_early_stopping', M.STOPPED)
def q_early(spark, sf):
    train, test = _lines(spark, sf)
    return _stats(_fit(train, val=test))


@register('e8_folds', f"""
SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY label ORDER BY {O.hash_sql(['l_orderkey', 'l_linenumber'])}, l_orderkey, l_linenumber) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT *, CASE WHEN l_returnflag = 'R' OR l_extendedprice > 1500 * l_quantity THEN 1 ELSE 0 END AS label FROM lineitem)""")
def q_folds(spark, sf):
    train, test = _lines(spark, sf)
    return B.folds(train.unionByName(test), ['l_orderkey', 'l_linenumber']).select('l_orderkey', 'l_linenumber', 'fold')


@register('e8_cross_validate', M.cross_validated(5))
def q_cv(spark, sf):
    out = B.cross_validate(_lines(spark, sf)[0], _COLS, B.PRESETS['gb_benchmark'], _KEYS, k=5)
    return out.select(F.round('cv_f1_mean', 6).alias('cv_f1_mean'), F.round('cv_f1_std', 6).alias('cv_f1_std'), F.transform('cv_f1', lambda x: F.round(x, 6)).alias('cv_f1'))


@register('e9_grid_search')
def q_grid(spark, sf):
    table, _ = B.grid_search(_lines(spark, sf)[0], _COLS, B.PRESETS['xgb'], B.GRID, _KEYS, k=3)
    return table


@register('e9_grid_search_adaboost')
def q_grid_adaboost(spark, sf):
    table, _ = B.grid_search(_lines(spark, sf)[0], _COLS, B.PRESETS['ada'], B.ADABOOST_GRID, _KEYS, k=3)
    return table


@register('e10_feature_importance', M.IMPORTANCE)
def q_importance(spark, sf):
    return B.feature_importance(_fit(_lines(spark, sf)[0])).select('feature', F.round('importance', 6).alias('importance'))


@register('e11_staged_scores', M.STAGED)
def q_staged(spark, sf):
    train, test = _lines(spark, sf)
    return B.staged_scores(_fit(train), test)


@register('e12_training_deviance', M.DEVIANCE)
def q_deviance(spark, sf):
    return B.training_deviance(_fit(_lines(spark, sf)[0])).select('round', F.round('deviance', 6).alias('deviance'))


@register('e13_training_stats', M.STATS)
def q_stats(spark, sf):
    return _stats(_fit(_lines(spark, sf)[0]))


@register('a8_save_load', M.PREDICT)
def q_save_load(spark, sf):
    train, test = _lines(spark, sf)
    return _predicted(B.load(spark, _fit(train).save(scratch_path(spark, 'model'))), test)


def _judged_docs(spark, sf):
    """Documents with a quality label, a fifth of them held out."""
    docs = _docs(spark, sf).join(read_table(spark, sf, 'labels').select('doc_id', F.col('quality').alias('label')), 'doc_id')
    return docs.withColumn('held_out', hash_uniform(['doc_id'], 42, 'held') < 0.2)


@register('e14_text_classifier')
def q_text(spark, sf):
    docs = _judged_docs(spark, sf)
    return T.score_text(T.fit_text(docs.filter('not held_out')), docs).drop('text')


@register('e14_epoch_losses')
def q_text_losses(spark, sf):
    return T.epoch_losses(T.fit_text(_judged_docs(spark, sf).filter('not held_out')))


@register('e15_batch_score', "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS score FROM documents")
def q_batch(spark, sf):
    return T.batch_score(_docs(spark, sf), lambda: lambda texts: [float(len(t)) for t in texts]).drop('text')


# ---------------------------------------------------------------- A1-A7, C2, F11
@register('a1_read_csv_logs', 'SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders')
def q_csv(spark, sf):
    orders = read_table(spark, sf, 'orders').select('o_orderkey', 'o_orderstatus', 'o_orderpriority')
    return readers.read_csv_logs(spark, writers.write_csv(orders, scratch_path(spark, 'csv')))


@register('a2_read_text_logs', O.with_views('SELECT log_text FROM doc_lines', 'doc_lines'))
def q_text_logs(spark, sf):
    path = scratch_path(spark, 'text')
    doc_lines(spark, sf).select('log_text').write.text(path)
    return readers.read_text_logs(spark, path)


@register('a3_read_log_file', O.with_views("""SELECT 'csv' AS kind, o_orderpriority AS log_text FROM orders
UNION ALL SELECT 'log', log_text FROM doc_lines
UNION ALL SELECT 'txt', trim(event_type) FROM events WHERE trim(event_type) <> ''""", 'doc_lines'))
def q_log_file(spark, sf):
    path = scratch_path(spark, 'files')
    writers.write_csv(read_table(spark, sf, 'orders').select(F.col('o_orderpriority').alias('log_text'), 'o_orderkey'), f'{path}/orders.CSV')
    doc_lines(spark, sf).select('log_text').write.text(f'{path}/lines.log')
    read_table(spark, sf, 'events').select(F.col('event_type')).write.text(f'{path}/events.txt')
    kinds = {'csv': 'orders.CSV', 'log': 'lines.log', 'txt': 'events.txt'}
    parts = [readers.read_log_file(spark, f'{path}/{name}').select(F.lit(k).alias('kind'), 'log_text') for k, name in kinds.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@register('a4_read_log_dir', O.with_views("""SELECT log_text, NULL AS o_orderstatus FROM doc_lines
UNION ALL SELECT o_orderpriority, o_orderstatus FROM orders""", 'doc_lines'))
def q_log_dir(spark, sf):
    path = scratch_path(spark, 'logs')
    doc_lines(spark, sf).select('log_text').write.text(f'{path}/text')
    orders = read_table(spark, sf, 'orders').select(F.col('o_orderpriority').alias('log_text'), 'o_orderstatus')
    writers.write_csv(orders, f'{path}/csv')
    return readers.read_log_dir(spark, path).select('log_text', 'o_orderstatus')


@register('a6_write_csv', 'SELECT conv_id, turn, role, text FROM conversations')
def q_write_csv(spark, sf):
    conv = read_table(spark, sf, 'conversations').select('conv_id', 'turn', 'role', 'text')
    return writers.read_csv(spark, writers.write_csv(conv, scratch_path(spark, 'csv')), conv.schema)


@register('a7_write_json', 'SELECT conv_id, turn, role, text FROM conversations')
def q_write_json(spark, sf):
    conv = read_table(spark, sf, 'conversations').select('conv_id', 'turn', 'role', 'text')
    return writers.load_results(spark, writers.save_results(conv, scratch_path(spark, 'json')), conv.schema)


@register('c2_dedup_keep_first', O.with_views("""SELECT event_type, error_type, log_id, user_id FROM ci_logs
QUALIFY row_number() OVER (PARTITION BY event_type, error_type ORDER BY user_id, log_id) = 1""", 'ci_logs'))
def q_dedup(spark, sf):
    logs = ci_logs(spark, sf).select('event_type', 'error_type', 'log_id', 'user_id')
    return dedup_keep_first(logs, ['event_type', 'error_type'], ['user_id', 'log_id'])



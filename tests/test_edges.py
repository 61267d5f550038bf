"""Nulls, missing classes, odd scores and plans of the library's operators."""

import io
import math
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from logtriage.functions.tokens import word_tokens
from logtriage.models import boosting as B
from logtriage.operators import augment, encoding, metrics, sampling
from logtriage.operators.compare import best_by
from logtriage.operators.features import label_encode
from logtriage.operators.preprocess import dedup_keep_first, preprocess_logs
from logtriage.sources import readers
from logtriage.streaming.triage import triage_stream


def test_null_labels_keep_their_rows(spark):
    df = spark.range(100).select('id', F.when(F.col('id') % 5 > 0, (F.col('id') % 2).cast('int')).alias('label'))
    assert sampling.stratified_split(df, 'label', ['id']).count() == 100
    three = sampling.stratified_split3(df, 'label', ['id'])
    assert three.count() == 100 and {r.split for r in three.collect()} == {'train', 'val', 'test'}
    with pytest.raises(Exception, match='null labels'):
        sampling.balance_undersample(df, 'label', ['id']).collect()


def test_oversample_reaches_every_class_size(spark):
    df = spark.range(90).select('id', (F.col('id') < 60).cast('int').alias('label'))
    out = sampling.balance_oversample(df, 'label', ['id'])
    assert {r.label: r['count'] for r in out.groupBy('label').count().collect()} == {0: 60, 1: 60}


def preds(spark, rows):
    return spark.createDataFrame(rows, 'm string, label int, prediction int, score double')


def test_null_scores_and_groups(spark):
    p = preds(spark, [('a', 1, 1, 0.9), ('a', 0, 0, 0.1), ('a', 1, 0, None), ('a', 0, 0, float('nan')), (None, 1, 1, 0.7), (None, 0, 1, 0.8)])
    assert {r.m: r.auc_roc for r in metrics.auc_roc(p, groups=['m']).collect()} == {'a': 1.0, None: 0.0}
    assert {r.m for r in metrics.roc_curve(p, groups=['m']).collect()} == {'a', None}
    assert {r.m: r.auc_roc for r in metrics.evaluate(p, ['m']).collect()} == {'a': 1.0, None: 0.0}


def test_one_class_and_wide_scores(spark):
    p = preds(spark, [('only1', 1, 1, 5.0), ('only1', 1, 1, -3.0), ('only0', 0, 0, 1e9), ('both', 1, 1, 1e-9), ('both', 0, 0, 2e-9), ('both', 1, 1, 3e-9)])
    roc = metrics.roc_curve(p, groups=['m']).collect()
    assert all(r.fpr is None for r in roc if r.m == 'only1') and all(r.tpr is None for r in roc if r.m == 'only0')
    both = sorted((r.threshold, r.fpr, r.tpr) for r in roc if r.m == 'both')
    assert both == [(1e-9, 1.0, 1.0), (2e-9, 1.0, 0.5), (3e-9, 0.0, 0.5), (math.inf, 0.0, 0.0)]
    got = {r.m: (r.auc_roc, r.average_precision) for r in metrics.rank_metrics(p, groups=['m']).collect()}
    assert got == {'only1': (None, 1.0), 'only0': (None, 0.0), 'both': (0.5, round((1 + 2 / 3) / 2, 6))}


def test_curve_equals_brute_force(spark):
    rows = [('x', int(i * 7919 % 10 < 4), 0, ((i * 104729) % 997) ** 3 / 1e6) for i in range(600)]
    t = sorted({r[3] for r in rows}, reverse=True)
    n1 = sum(r[1] for r in rows)
    want = [(s, round(sum(r[3] >= s and not r[1] for r in rows) / (600 - n1), 6), round(sum(r[3] >= s and r[1] for r in rows) / n1, 6)) for s in t]
    got = metrics.roc_curve(preds(spark, rows), groups=['m'], drop_intermediate=False).collect()
    assert sorted((r.threshold, r.fpr, r.tpr) for r in got if r.threshold < math.inf) == sorted(want)


def test_record_and_flatten(spark):
    p = preds(spark, [('a', 1, 1, 0.9), ('a', 0, 1, 0.8), ('a', 1, 0, 0.2), (None, 0, 0, 0.1)])
    rec = {r.m: r for r in metrics.evaluation_record(p, ['m']).collect()}
    assert rec['a'].confusion.fp == 1 and rec['a'].report_accuracy.f1_score == round(1 / 3, 6) and rec[None].report_macro_avg.support == 1
    flat = metrics.flatten(metrics.evaluation_record(p, ['m']))
    assert {'confusion_tp', 'report_weighted_avg_recall', 'auc_roc'} <= set(flat.columns) and not any(f.dataType.typeName() == 'array' for f in flat.schema)
    curves = [(r.curve, r.threshold, r.x, r.y) for r in metrics.evaluation_curves(p, ['m']).filter("m = 'a'").collect()]
    assert sorted(c for c in curves if c[0] == 'roc') == [('roc', 0.2, 1.0, 1.0), ('roc', 0.8, 1.0, 0.5), ('roc', 0.9, 0.0, 0.5), ('roc', math.inf, 0.0, 0.0)]
    assert len([c for c in curves if c[0] == 'pr']) == 4


def test_codes_skip_nulls(spark):
    df = spark.createDataFrame([(None,), ('b',), ('a',), ('b',)], 'c string')
    assert {(r.c, r.c_code) for r in label_encode(df, ['c']).collect()} == {(None, None), ('a', 0), ('b', 1)}


def test_keep_first_with_null_order(spark):
    df = spark.createDataFrame([('k', 'v', None)], 'k string, v string, o int')
    assert [tuple(r) for r in dedup_keep_first(df, 'k', 'o').collect()] == [('k', 'v', None)]
    with pytest.raises(ValueError):
        preprocess_logs(df, 'v')


def test_best_by_names_a_model_once(spark):
    df = spark.createDataFrame([('m1', 0.9), ('m1', 0.5), ('m2', 0.9), ('m0', None)], 'model string, f1 double')
    assert [tuple(r) for r in best_by(df, [('f1', 'f1', 'max')]).collect()] == [('f1', 'm1', 0.9)]


def test_tokens_fold_all_compatibility_forms(spark):
    df = spark.createDataFrame([('ﬁle ＡＢＣ café ½x naïve ㎏s',)], 't string')
    assert df.select(word_tokens(F.col('t')).alias('w')).first().w == ['file', 'abc', 'cafe', 'naive', 'kgs']


def test_cleaning_stands_in_the_plan_once(spark):
    df = spark.createDataFrame([(1, 'x')], 'id int, log_text string')
    text = io.StringIO()
    with redirect_stdout(text):
        preprocess_logs(df, order_by=['id']).explain()
        single = io.StringIO()
        with redirect_stdout(single):
            from logtriage.operators.preprocess import with_cleaned_text
            with_cleaned_text(df, 'log_text').explain()
    assert text.getvalue().count('regexp_replace') == single.getvalue().count('regexp_replace')


def test_list_slots_pick_for_every_occurrence(spark):
    df = spark.range(50).select('id', F.lit('{a} and {a} or {a}{b}').alias('t'))
    out = augment.render_templates(df, 't', {'a': ['x', 'y', 'z'], 'b': F.lit('!')}, keys='id').collect()
    assert all('{' not in r.rendered and r.rendered.endswith('!') for r in out)
    assert len({r.rendered for r in out}) > 10


def test_read_dir_with_mixed_columns_and_encodings(spark, tmp_path):
    (tmp_path / 'a.csv').write_text('id,log_text\n1,one\n')
    (tmp_path / 'b.csv').write_text('id,log_text\nx,two\n')
    (tmp_path / 'c.csv').write_text('when;log_text\ntoday;three\n')
    (tmp_path / 'd.log').write_bytes('caf\xe9 latin\r\nplain\n\n'.encode('latin-1'))
    (tmp_path / 'e.txt').write_text('café utf\n')
    rows = {(r.source_file, r.log_text, r.id) for r in readers.read_log_dir(spark, str(tmp_path)).collect()}
    assert rows == {('a.csv', 'one', '1'), ('b.csv', 'two', 'x'), ('c.csv', 'three', None), ('d.log', 'café latin', None),
                    ('d.log', 'plain', None), ('e.txt', 'café utf', None)}


def test_stream_dedup_must_be_explicit(spark, tmp_path):
    stream = spark.readStream.text(str(tmp_path)).withColumnRenamed('value', 'log_text')
    with pytest.raises(ValueError):
        triage_stream(stream)
    assert triage_stream(stream, dedup=False).isStreaming


def test_word_ids_round_trip(spark):
    docs = spark.createDataFrame([(1, 'red kite red'), (2, None), (3, 'kite over the mill and the kite')], 'doc_id long, text string')
    vocab = encoding.fit_token_vocab(docs)
    enc = {r.doc_id: r for r in encoding.encode(docs, vocab, 8).collect()}
    assert enc[2].input_ids == [2, 3, 0, 0, 0, 0, 0, 0] and sum(enc[3].attention_mask) == 8 and all(len(r.input_ids) == 8 for r in enc.values())
    text = {r.doc_id: r.text for r in encoding.decode(encoding.encode(docs, vocab, 16), vocab).collect()}
    assert text == {1: 'red kite red', 2: '', 3: 'kite over the mill and the kite'}


def test_models_learn_save_and_load(spark, tmp_path):
    df = spark.range(400).select('id', (F.col('id') % 20).alias('a'), (F.col('id') % 7).alias('b'), ((F.col('id') % 20 >= 10) | (F.col('id') % 7 == 0)).cast('int').alias('label'))
    gb = B.fit_boosted(df, ['a', 'b'], 'gb_benchmark', rounds=8, depth=2, min_rows=1, subsample=1.0)
    ada = B.fit_adaboost(df, ['a', 'b'], rounds=4, depth=1)
    assert all(x > y for x, y in zip(gb.stats['deviance'], gb.stats['deviance'][1:], strict=False))
    for i, m in enumerate((gb, ada)):
        assert B.evaluate_on(m, df).first().f1 > 0.8
        again = B.load(spark, m.save(str(tmp_path / f'm{i}')))
        a, b = (sorted((r.id, r.prediction, round(r.probability_1, 9)) for r in B.score(x, df).collect()) for x in (m, again))
        assert a == b
        stages = B.staged_scores(m, df).collect()
        assert len(stages) == m.stats['rounds'] and B.feature_importance(m).first().feature == 'a'
    with pytest.raises(ValueError):
        B.score(None, df)

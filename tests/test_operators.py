"""Unit tests with expected values worked out from the reproduced rules (FIXTURES.md)."""
import math

import pytest
from pyspark.sql import functions as F

from logtriage.functions.text import clean_text, is_relevant, label_logs, label_scores
from logtriage.operators import compare as G
from logtriage.operators import features as D
from logtriage.operators import metrics as M
from logtriage.operators.preprocess import dedup_keep_first, label_distribution
from logtriage.operators.sampling import balance_undersample, positional_split, stratified_split

CLEAN_CASES = [
    ('2023-11-02T08:15:59.007Z [WARN] Suite aborted: OutOfMemoryError at org.acme.build.Runner',
     'warn suite aborted: outofmemoryerror at org.acme.build.runner', True),
    ('Nightly job passed - 7 checks skipped', 'nightly job passed - 7 checks skipped', True),
    ('[DEBUG] Copying artifacts to mirror host 10.20.30.40', 'debug copying artifacts to mirror host', False),
    ('Flaky again: the upload step failed once, retry pending...', 'flaky again: the upload step failed once, retry pending...', True),
    ('===', '', False),
    ('Ünïcode café x /usr/lib/é 0xFF @bob #12 [33] Straße',
     'ünïcode café x é straße', None),
    (None, '', False),
    ('', '', False),
]


def test_clean_and_relevance(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLEAN_CASES)], 'id int, t string')
    rows = {r.id: r for r in df.select('id', clean_text('t').alias('c'),
                                       is_relevant(clean_text('t')).alias('rel')).collect()}
    for i, (_, cleaned, rel) in enumerate(CLEAN_CASES):
        assert rows[i].c == cleaned
        if rel is not None:
            assert rows[i].rel == rel


LABEL_CASES = [
    ('the upload step is flaky on slow agents', 1, 0, 0),
    ('NullPointerException thrown by the report writer', 0, 0, 1),
    ('all suites green, artifacts stored', 0, 0, 0),
    ('the cache warm-up step is unstable today', 1, 0, 0),
    ('AssertionError: totals differ by one cent', 0, 0, 1),
    ('timeout x fixed timeout', 1, 0, 0),
    ('timeout\rfixed', 0, 0, 0),
    ('timeout\nfixed timeout', 2, 0, 0),
    ('TIMEOUT timeouts fixed', 0, 0, 0),
    ('race condition and a memory leak error', 1, 1, 1),
    ('race condition and a memory leak', 1, 1, 0),
    ('unexpected exception in handler', 0, 0, 1),
    ('nothing to see here', 0, 0, 0),
    (None, 0, 0, 0),
]


def test_label_scores_and_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(LABEL_CASES)], 'id int, t string')
    out = {r.id: r for r in label_logs(df, 't', include_scores=True).collect()}
    for i, (_, fs, rs, lab) in enumerate(LABEL_CASES):
        assert (out[i].flaky_score, out[i].regression_score, out[i].label) == (fs, rs, lab), LABEL_CASES[i]


def test_dedup_keeps_first_and_distribution(spark):
    df = spark.createDataFrame([(1, 'a', 'x'), (2, 'a', 'y'), (3, 'b', 'z')], 'id int, k string, v string')
    kept = sorted(tuple(r) for r in dedup_keep_first(df, 'k', 'id').collect())
    assert kept == [(1, 'a', 'x'), (3, 'b', 'z')]
    dist = {r.label: (r.n, r.pct) for r in label_distribution(
        spark.createDataFrame([(1,), (1,), (1,)], 'label int')).collect()}
    assert dist == {0: (0, 0.0), 1: (3, 100.0)}


def test_sampling_counts(spark):
    df = spark.range(1000).select(F.col('id'), (F.col('id') % 10 < 3).cast('int').alias('label'))
    assert balance_undersample(df, 'label', ['id']).groupBy('label').count().collect().__len__() == 2
    cnt = {r.label: r['count'] for r in balance_undersample(df, 'label', ['id']).groupBy('label').count().collect()}
    assert cnt == {0: 300, 1: 300}
    split = {r.split: r['count'] for r in positional_split(df, ['id']).groupBy('split').count().collect()}
    assert split == {'train': 700, 'val': 150, 'test': 150}
    st = stratified_split(df, 'label', ['id'], 0.2).groupBy('split', 'label').count().collect()
    assert {(r.split, r.label): r['count'] for r in st} == {('train', 0): 560, ('train', 1): 240,
                                                            ('test', 0): 140, ('test', 1): 60}


TFIDF_CORPUS = [
    'red kite over the old mill',
    'old mill burned down',
    'nothing here matches anything',
    'kite season starts',
    'the mill is red',
]


def test_tfidf_fixture(spark):
    docs = spark.createDataFrame(list(enumerate(TFIDF_CORPUS)), 'doc_id long, text string')
    vocab, tfidf = D.fit_transform(docs)
    v = {r.term: (r.df, r.cf, round(r.idf, 6)) for r in vocab.collect()}
    two, three = round(math.log(6 / 3) + 1, 6), round(math.log(6 / 4) + 1, 6)
    assert v == {'kite': (2, 2, two), 'mill': (3, 3, three), 'old': (2, 2, two), 'old mill': (2, 2, two), 'red': (2, 2, two),
                 'the': (2, 2, two)}
    got = {(r.doc_id, r.term): r.tfidf for r in tfidf.collect()}
    assert round(got[(3, 'kite')], 6) == 1.0 and not any(d == 2 for d, _ in got)
    norm = math.sqrt(2 * (math.log(2) + 1) ** 2 + (math.log(1.5) + 1) ** 2)
    assert math.isclose(got[(4, 'mill')], (math.log(1.5) + 1) / norm)


def test_metrics_and_curves(spark):
    rows = [(1, 1, 0.9), (0, 1, 0.8), (1, 1, 0.8), (0, 0, 0.3), (1, 0, 0.3), (0, 0, 0.1)]
    p = spark.createDataFrame(rows, 'label int, prediction int, score double')
    b = M.binary_metrics(p).first()
    assert (b.accuracy, b.precision, b.recall) == (round(4 / 6, 6), round(2 / 3, 6), round(2 / 3, 6))
    auc = M.auc_roc(p).first().auc_roc
    # pairs: positives {.9,.8,.3}, negatives {.8,.3,.1}: 9 pairs, wins 1+1+1+.5+1+1+.5+1 -> 7/9? count by hand
    pos, neg = [0.9, 0.8, 0.3], [0.8, 0.3, 0.1]
    ref = sum(1.0 if a > c else 0.5 if a == c else 0.0 for a in pos for c in neg) / 9
    assert auc == round(ref, 6)
    one = spark.createDataFrame([(1, 1, 0.5)], 'label int, prediction int, score double')
    assert M.auc_roc(one).first().auc_roc is None


def test_aggregate_runs(spark):
    runs = spark.createDataFrame([(0.90, 0.88), (0.92, 0.90), (0.91, 0.89)], 'accuracy double, f1 double')
    agg = {r.metric: r for r in M.aggregate_runs(runs, ['accuracy', 'f1']).collect()}
    assert agg['accuracy'].mean == 0.91 and agg['accuracy'].std == 0.008165 and agg['accuracy'].n_runs == 3
    assert agg['f1'].mean == 0.89 and agg['f1'].std == 0.008165


RUNS = [('XGBoost', 'ML', .92, .91, .90, .905, .05, 5.2, 120.0, None),
        ('AdaBoost', 'ML', .88, .87, .86, .865, .08, 8.1, 95.0, None),
        ('Gradient Boosting', 'ML', .90, .89, .88, .885, .06, 12.5, 110.0, None),
        ('BERT', 'Text', .94, .93, .92, .925, 15.2, 180.0, 2048.0, 3),
        ('DistilBERT', 'Text', .93, .92, .91, .915, 8.5, 95.0, 1024.0, 3),
        ('RoBERTa', 'Text', .95, .94, .93, .935, 16.8, 200.0, 2200.0, 3)]


def test_comparison(spark):
    runs = spark.createDataFrame(
        [(*r, 1, 'small') for r in RUNS],
        'model string, family string, accuracy double, precision double, recall double, f1 double, '
        'ms_per_row double, train_seconds double, memory_mb double, epochs int, run_seq int, dataset string')
    ml = G.analyze_family(runs, 'ML').first()
    assert (ml.best_model, ml.worst_model, ml.fastest_training, ml.fastest_inference, ml.lowest_memory) == \
        ('XGBoost', 'AdaBoost', 'XGBoost', 'XGBoost', 'AdaBoost')
    tx = G.analyze_family(runs, 'Text').first()
    assert (tx.best_model, tx.worst_model, tx.efficiency_winner, tx.light_model_advice) == \
        ('RoBERTa', 'DistilBERT', 'DistilBERT', True)
    cr = G.analyze_cross(runs).first()
    assert cr.f1_winner == 'Transformers' and cr.f1_difference == 0.03 and cr.train_winner == 'ML'
    assert cr.train_ratio == 18.410853 and cr.inference_ratio == 213.157895


def test_scoreboard_matches_published(spark):
    # published boosted-tree results (test F1, CV mean, CV std, overfit gap, CPU seconds)
    res = spark.createDataFrame([
        ('XGBoost', 0.7871720116618076, 0.7829983601777392, 0.015346572378545831, 0.08324999999999994, 2.796875),
        ('AdaBoost', 0.6759956942949408, 0.6503829774830915, 0.06201749207449294, 0.0030000000000000027, 1.984375),
        ('GradientBoosting', 0.7796278158667973, 0.7752478546100872, 0.01956257223410333, 0.012249999999999983,
         0.0625)], 'model string, f1 double, cv_f1_mean double, cv_f1_std double, overfit_gap double, '
                   'train_cpu_seconds double')
    s = {r.model: r.total_score for r in G.scoreboard(res, G.ML_CRITERIA).collect()}
    assert s == {'XGBoost': 1.0, 'GradientBoosting': round(0.9325363388025587, 6), 'AdaBoost': 0.0}
    assert math.isclose(s['GradientBoosting'], 0.932536, abs_tol=1e-6)


@pytest.mark.parametrize('name', ['c4_label_distribution'])
def test_entry_smoke(spark, name):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ['label', 'label_name', 'n', 'pct'] and df.count() == 2

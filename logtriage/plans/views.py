"""Derived log tables built from the driver tables.

* ``ci_logs``   one rendered CI log line per ``events`` row (H1 over a template chosen
                from the event id), with message / error type / stack trace columns.
* ``doc_lines`` every non-blank line of every ``documents`` text.
* ``all_logs``  both, with (source, log_id, line_no) as the row identity.
* ``preds``     ``documents`` joined with ``labels`` plus a deterministic score.
* ``runs``      one evaluation run per (source, lang) group of ``preds``.

Every SQL oracle builds the same tables with the same expressions (see ``oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import regex_trim
from ..operators.augment import render_templates
from ..session import read_table

# Own wording; each template exercises a different rule group of cleaning / labelling.
LOG_TEMPLATES = [
    '{ts} [{lvl}] Test suite failed: NullPointerException in {path}',
    '{ts} WARN peer {ip} answered connection refused, retry number {k}',
    '{ts} ERROR segmentation fault at {hex} in worker {pid}',
    'Build #{n} successful - all tests passed by {user}',
    '{ts} lock {uuid} not granted: timeout, flaky by our rules',
    '{us_ts} timeout fixed after upgrade, rerun #{n} passed',
    'REGRESSION: expected status 200 but got 500 for request {md5}',
    '{ts} Unhandled exception in C:\\ci\\agents\\{user_name}\\run.log',
    '{ts} intermittent network error talking to {ip}; bug filed as #{n}',
    '{ts} race condition detected, memory leak error in {pid}',
    '{ts} [{lvl}] random failure with code {hex}, known issue',
    '{ts} Exception thrown while parsing config for {user}',
    '{ts} worker {user_name} idle for {k} ms',
    '{ts} ERROR type error in module {path}; stack overflow at depth {k}',
    '{ts} timeout talking to {ip}: retry budget exhausted, access denied for {user}',
    '{eu_ts} flaky test skipped; fatal assertion failed in commit {sha}',
]
ERROR_TYPES = [
    'NullPointerException', 'ConnectionRefused', 'SegmentationFault', '', 'LockTimeout',
    'Timeout', 'AssertionError', 'UnhandledException', 'NetworkError', 'RaceCondition',
    'RandomFailure', 'ConfigException', '', 'TypeError', 'AccessDenied', 'AssertionError',
]


def _s(c):
    return c.cast('string')


def event_slots() -> dict:
    e, u = F.col('event_id'), F.col('user_id')
    md = F.md5(_s(e))
    return {
        'ts': F.date_format('ts', "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        'us_ts': F.date_format('ts', 'MM/dd/yyyy HH:mm:ss'),
        'eu_ts': F.date_format('ts', 'dd-MM-yyyy HH:mm:ss'),
        'lvl': F.upper('event_type'),
        'user': F.concat(F.lit('@dev'), _s(u)),
        'user_name': F.concat(F.lit('dev'), _s(u)),
        'ip': F.concat(F.lit('10.'), _s(u % 250), F.lit('.'), _s(e % 250), F.lit('.'), _s(e % 7 + 1)),
        'hex': F.concat(F.lit('0x'), F.hex(e * 7919 + 4096)),
        'uuid': F.concat_ws('-', F.substring(md, 1, 8), F.substring(md, 9, 4), F.substring(md, 13, 4),
                            F.substring(md, 17, 4), F.substring(md, 21, 12)),
        'md5': F.md5(_s(u)),
        'sha': F.sha1(_s(e)),
        'pid': F.concat(F.lit('['), _s(u * 13 + 100), F.lit(']')),
        'n': _s(e % 1000),
        'k': _s(e % 7 + 1),
        'path': F.concat(F.lit('/var/lib/ci/'), F.col('event_type'), F.lit('/run_'), _s(e % 50), F.lit('.log')),
    }


def ci_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, 'events').select('event_id', 'ts', 'user_id', 'event_type')
    k = len(LOG_TEMPLATES)
    idx = (F.col('event_id') % k + 1).cast('int')
    tmpl = F.element_at(F.array(*[F.lit(t) for t in LOG_TEMPLATES]), idx)
    err = F.element_at(F.array(*[F.lit(t) for t in ERROR_TYPES]), idx)
    trace = F.when(F.col('event_id') % 4 == 0, F.lit(None).cast('string')).otherwise(F.concat(
        F.lit('Traceback (most recent call last):\n  at com.acme.'), F.col('event_type'),
        F.lit('.Runner.run(Runner.java:'), _s(F.col('event_id') % 300), F.lit(')\n  timeout handler '),
        F.when(F.col('event_id') % 3 == 0, F.lit('fixed')).otherwise(F.lit('engaged'))))
    rendered = ev.withColumns({'_tmpl': tmpl, 'error_type': err, 'stack_trace': trace})
    rendered = render_templates(rendered, '_tmpl', event_slots(), out_col='log_text')
    out = rendered.select(F.col('event_id').alias('log_id'), 'user_id', 'event_type', 'log_text',
                          'error_type', 'stack_trace')
    return out


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document: split on newline, stripped, blank lines dropped."""
    docs = read_table(spark, sf_dir, 'documents').select('doc_id', 'text')
    lines = docs.select('doc_id', F.posexplode(F.split(F.coalesce('text', F.lit('')), '\n'))
                        .alias('line_no', 'raw'))
    out = (lines.select('doc_id', F.col('line_no').cast('long').alias('line_no'),
                        regex_trim('raw').alias('log_text'))
           .filter(F.col('log_text') != ''))
    return out


def all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ci_logs(spark, sf_dir).select(F.lit('events').alias('source'), 'log_id',
                                       F.lit(0).cast('long').alias('line_no'), 'log_text')
    dl = doc_lines(spark, sf_dir).select(F.lit('documents').alias('source'),
                                         F.col('doc_id').alias('log_id'), 'line_no', 'log_text')
    return ev.unionByName(dl)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels with a deterministic score in [0, 1] (two decimals, many ties)."""
    d = read_table(spark, sf_dir, 'documents').select('doc_id', 'source', 'lang', 'n_chars')
    lab = read_table(spark, sf_dir, 'labels').select('doc_id', 'quality', 'toxic')
    j = d.join(lab, 'doc_id')
    h = F.conv(F.substring(F.md5(F.concat(F.lit('score|'), _s(F.col('doc_id')))), 1, 8), 16, 10).cast('long')
    score_int = h % 66 + F.col('quality') * 35
    return j.select('doc_id', 'source', 'lang', 'n_chars', 'toxic',
                    F.col('quality').cast('int').alias('label'),
                    (score_int / F.lit(100.0)).alias('score'),
                    F.when(score_int >= 50, 1).otherwise(0).alias('prediction'),
                    F.when(F.col('toxic') == 0, 'train').otherwise('test').alias('split'))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation run per (source, lang); ``model`` = source, family by language."""
    p = preds(spark, sf_dir)
    fold = (F.col('doc_id') % 5).alias('fold')
    y, yh = F.col('label'), F.col('prediction')
    tp, fp, fn = [F.sum(F.when(c, 1).otherwise(0)) for c in ((y == 1) & (yh == 1), (y == 0) & (yh == 1),
                                                              (y == 1) & (yh == 0))]
    per_fold = p.groupBy('source', 'lang', fold).agg(
        (F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)).alias('f1'))
    cv = per_fold.groupBy('source', 'lang').agg(F.avg('f1').alias('cv_f1_mean'),
                                                F.stddev_pop('f1').alias('cv_f1_std'))
    correct = F.when(y == yh, 1).otherwise(0)
    n = F.count(F.lit(1))
    base = p.groupBy('source', 'lang').agg(
        n.alias('n_rows'),
        (F.sum(correct) / n).alias('accuracy'),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias('precision'),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias('recall'),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias('f1'),
        (F.sum('n_chars') / F.lit(1000.0)).alias('train_seconds'),
        (F.avg('n_chars') / F.lit(100.0)).alias('ms_per_row'),
        (n * F.lit(8.0)).alias('memory_mb'),
        (F.avg(F.when(F.col('split') == 'train', correct)) -
         F.avg(F.when(F.col('split') == 'test', correct))).alias('overfit_gap'),
        (F.sum(F.greatest(F.col('n_chars') / 4 - 512, F.lit(0.0))) * 100 /
         F.greatest(F.sum(F.col('n_chars') / 4), F.lit(1.0))).alias('pct_tokens_lost'))
    out = base.join(cv, ['source', 'lang'])
    family = F.when(F.col('lang').isin('en', 'fr'), 'ML').otherwise('Text')
    seq = F.when(F.col('lang').isin('en', 'de'), 1).otherwise(2)
    r6 = lambda c: F.round(c, 6)
    return out.select(
        F.col('source').alias('model'), family.alias('family'), F.col('lang').alias('dataset'),
        seq.alias('run_seq'), 'n_rows',
        *[r6(c).alias(c) for c in ('accuracy', 'precision', 'recall', 'f1', 'train_seconds', 'ms_per_row',
                                   'memory_mb')],
        F.when(family == 'Text', 3).alias('epochs'),
        r6(F.coalesce('overfit_gap', F.lit(0.0))).alias('overfit_gap'),
        r6('cv_f1_mean').alias('cv_f1_mean'), r6('cv_f1_std').alias('cv_f1_std'),
        r6(F.col('train_seconds') * 1.5).alias('train_cpu_seconds'), r6('pct_tokens_lost').alias('pct_tokens_lost'))

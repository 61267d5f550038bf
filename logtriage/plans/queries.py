"""Registered queries: one Spark plan per operator ID, each with its DuckDB oracle.

Every query reads the driver tables (or views Spark derives from them) in full.
Float outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import (clean_text, compose_text, is_relevant, label_logs, label_name,
                              label_scores, manual_feature_columns)
from ..operators.augment import augment_text, inject_label_noise, materialize_splits
from ..operators.preprocess import label_distribution, preprocess_funnel, preprocess_logs
from ..operators.sampling import (balance_oversample, balance_undersample, class_mix_sample,
                                  positional_split, seeded_shuffle, stratified_split,
                                  stratified_split3)
from ..session import read_table, scratch_path
from ..sources.readers import normalize_log_table
from . import oracle as O
from .views import all_logs, ci_logs, doc_lines

KEYS = ['source', 'log_id', 'line_no']
_CI = 'log_id, user_id, event_type, log_text, error_type, stack_trace'
QUERIES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- shared SQL pieces
PRE_SQL = (f"pre AS (SELECT * FROM (SELECT *, {O.sql_clean('log_text')} AS cleaned_text FROM all_logs) "
           f"WHERE {O.sql_relevant('cleaned_text')} "
           "QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY source, log_id, line_no) = 1)")
LAB_SQL = f"lab AS ({O.labelled('source, log_id, line_no, log_text, cleaned_text', 'cleaned_text', 'pre')})"


def _logs_cte(*extra):
    return O.with_views('', 'all_logs').rstrip() + ', ' + ', '.join(extra) + ' '


def labelled_logs(spark, sf):
    pre = preprocess_logs(all_logs(spark, sf), 'log_text', True, order_by=KEYS)
    return label_logs(pre, 'cleaned_text')


# ---------------------------------------------------------------- flagship
FLAGSHIP_SQL = _logs_cte(PRE_SQL, LAB_SQL) + f"""
, cnt AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
SELECT label, CASE WHEN label = 0 THEN {O.lit(R.LABEL_NAMES[0])} ELSE {O.lit(R.LABEL_NAMES[1])} END AS label_name,
       CAST(coalesce(n, 0) AS BIGINT) AS n,
       round(coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (), 1) * 100, 6) AS pct
FROM (SELECT * FROM (VALUES (0), (1)) t(label)) b FULL OUTER JOIN cnt USING (label)"""


@register('c4_label_distribution', FLAGSHIP_SQL)
def q_flagship(spark, sf):
    return label_distribution(labelled_logs(spark, sf))


# ---------------------------------------------------------------- sources
@register('a2_doc_lines', O.with_views('SELECT doc_id, line_no, log_text FROM doc_lines', 'doc_lines'))
def q_doc_lines(spark, sf):
    return doc_lines(spark, sf)


@register('a5_normalize_conversations',
          'SELECT CAST(text AS VARCHAR) AS log_text FROM conversations')
def q_normalize(spark, sf):
    return normalize_log_table(read_table(spark, sf, 'conversations'), 'log_text')


# ---------------------------------------------------------------- B1-B8
@register('b1_clean_text', O.with_views(
    f'SELECT source, log_id, line_no, {O.sql_clean("log_text")} AS cleaned_text FROM all_logs', 'all_logs'))
def q_clean(spark, sf):
    return all_logs(spark, sf).select(*KEYS, clean_text('log_text').alias('cleaned_text'))


@register('b2_is_relevant', O.with_views(
    f'SELECT source, log_id, line_no, {O.sql_relevant(O.sql_clean("log_text"))} AS relevant FROM all_logs',
    'all_logs'))
def q_relevant(spark, sf):
    return all_logs(spark, sf).select(*KEYS, is_relevant(clean_text('log_text')).alias('relevant'))


def _feat_sql(x):
    t = f"coalesce({x}, '')"
    low = f'lower({t})'
    n = f'length({t})'
    return ', '.join([
        f'CAST({n} AS INTEGER) AS feat_length',
        f"CAST(len(regexp_extract_all({t}, '[^{O.WS}]+')) AS INTEGER) AS feat_word_count",
        f"contains({low}, 'error') AS feat_has_error",
        f"contains({low}, 'fail') AS feat_has_fail",
        f"contains({low}, 'exception') AS feat_has_exception",
        f"contains({low}, 'warning') AS feat_has_warning",
        f"contains({low}, 'timeout') AS feat_has_timeout",
        f"(contains({low}, 'retry') OR contains({low}, 'flaky')) AS feat_has_retry",
        f"(contains({low}, 'success') OR contains({low}, 'passed')) AS feat_has_success",
        f"CAST({n} - length(replace({t}, '!', '')) AS INTEGER) AS feat_exclamation_count",
        f"round(len(regexp_extract_all({t}, '\\p{{Lu}}')) / greatest({n}, 1), 6) AS feat_uppercase_ratio",
        f"round(len(regexp_extract_all({t}, '\\p{{Nd}}')) / greatest({n}, 1), 6) AS feat_digit_ratio",
    ])


@register('b3_manual_features', O.with_views(
    f'SELECT source, log_id, line_no, {_feat_sql("log_text")} FROM all_logs', 'all_logs'))
def q_features(spark, sf):
    feats = manual_feature_columns('log_text')
    cols = [(_r6(v) if k.endswith('_ratio') else v).alias(k) for k, v in feats.items()]
    return all_logs(spark, sf).select(*KEYS, *cols)


_FS, _RS = O.sql_scores('log_text')


@register('b4_label_scores', O.with_views(
    f'SELECT source, log_id, line_no, {_FS} AS flaky_score, {_RS} AS regression_score FROM all_logs',
    'all_logs'))
def q_scores(spark, sf):
    fs, rs = label_scores('log_text')
    return all_logs(spark, sf).select(*KEYS, fs.alias('flaky_score'), rs.alias('regression_score'))


@register('b5_label_logs', O.with_views(
    O.labelled('source, log_id, line_no, fs AS flaky_score, rs AS regression_score', 'cleaned_text',
               f'(SELECT *, {O.sql_clean("log_text")} AS cleaned_text FROM all_logs)'), 'all_logs'))
def q_label(spark, sf):
    df = all_logs(spark, sf).withColumn('cleaned_text', clean_text('log_text'))
    return label_logs(df, 'cleaned_text', include_scores=True).select(*KEYS, 'flaky_score', 'regression_score',
                                                                       'label')


@register('b6_label_name', O.with_views(
    f"SELECT log_id, label, CASE WHEN label = 0 THEN {O.lit(R.LABEL_NAMES[0])} ELSE {O.lit(R.LABEL_NAMES[1])} "
    f"END AS label_name FROM ({O.labelled(_CI, 'log_text', 'ci_logs')})", 'ci_logs'))
def q_label_name(spark, sf):
    lab = label_logs(ci_logs(spark, sf), 'log_text')
    return lab.select('log_id', 'label', label_name('label').alias('label_name'))


@register('b7_compose_text', O.with_views(
    "SELECT log_id, coalesce(log_text, '') || ' [SEP] ' || coalesce(error_type, '') || ' [SEP] ' || "
    "coalesce(stack_trace, '') AS text FROM ci_logs", 'ci_logs'))
def q_compose(spark, sf):
    return ci_logs(spark, sf).select('log_id', compose_text(['log_text', 'error_type', 'stack_trace']).alias('text'))


_P2 = R.Rules.preset2()


@register('b8_rules_preset2', O.with_views(
    f'SELECT source, log_id, line_no, c AS cleaned_text, {O.sql_relevant("c", _P2)} AS relevant '
    f'FROM (SELECT *, {O.sql_clean("log_text", _P2)} AS c FROM all_logs)', 'all_logs'))
def q_preset2(spark, sf):
    c = clean_text('log_text', _P2)
    df = all_logs(spark, sf).select(*KEYS, c.alias('cleaned_text'))
    return df.withColumn('relevant', is_relevant('cleaned_text', _P2))


# ---------------------------------------------------------------- C1-C10
@register('c1_preprocess_logs', _logs_cte(PRE_SQL) + 'SELECT source, log_id, line_no, cleaned_text FROM pre')
def q_preprocess(spark, sf):
    return preprocess_logs(all_logs(spark, sf), 'log_text', True, order_by=KEYS).select(*KEYS, 'cleaned_text')


@register('c3_preprocess_funnel', O.with_views(f"""
SELECT n_in, n_relevant, n_dedup, round(n_relevant / greatest(n_in, 1) * 100, 6) AS pct_relevant,
       round(n_dedup / greatest(n_in, 1) * 100, 6) AS pct_kept
FROM (SELECT count(*) AS n_in, count(CASE WHEN r THEN 1 END) AS n_relevant,
             count(DISTINCT CASE WHEN r THEN c END) AS n_dedup
      FROM (SELECT c, {O.sql_relevant('c')} AS r FROM (SELECT {O.sql_clean('log_text')} AS c FROM all_logs)))""",
                                                 'all_logs'))
def q_funnel(spark, sf):
    return preprocess_funnel(all_logs(spark, sf), 'log_text')


_HK = O.hash_sql(KEYS)


@register('c5_balance_undersample', _logs_cte(PRE_SQL, LAB_SQL) + f"""
SELECT source, log_id, line_no, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HK}, source, log_id, line_no) - 1 AS pos,
         min(cnt) OVER () AS m, count(*) OVER () AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS cnt FROM lab))
WHERE pos < (SELECT CASE WHEN count(DISTINCT label) >= 2 THEN min(c) ELSE 0 END
             FROM (SELECT label, count(*) AS c FROM lab GROUP BY label))""")
def q_undersample(spark, sf):
    return balance_undersample(labelled_logs(spark, sf), 'label', KEYS).select(*KEYS, 'label')


@register('c6_balance_oversample', _logs_cte(PRE_SQL, LAB_SQL) + f"""
, cnt AS (SELECT coalesce(sum(CASE WHEN label = 0 THEN 1 END), 0) AS n0,
                 coalesce(sum(CASE WHEN label = 1 THEN 1 END), 0) AS n1 FROM lab)
, par AS (SELECT greatest(n0, n1) AS mx, CASE WHEN n0 < greatest(n0, n1) THEN 0 ELSE 1 END AS mi,
                 CASE WHEN n0 < greatest(n0, n1) THEN n0 ELSE n1 END AS nmin FROM cnt)
, ranked AS (SELECT lab.*, row_number() OVER (ORDER BY {_HK}, source, log_id, line_no) - 1 AS pos
             FROM lab, par WHERE lab.label = par.mi)
, draws AS (SELECT k AS copy_id, {O.hex15_sql(O.hash_sql(['k'], salt='draw'))} % nmin AS pos
            FROM (SELECT unnest(range(CAST(mx AS BIGINT))) AS k, nmin FROM par WHERE nmin > 0))
SELECT source, log_id, line_no, label, CAST(NULL AS BIGINT) AS copy_id FROM lab, par WHERE lab.label <> par.mi
UNION ALL
SELECT r.source, r.log_id, r.line_no, r.label, d.copy_id FROM draws d JOIN ranked r ON d.pos = r.pos""")
def q_oversample(spark, sf):
    return balance_oversample(labelled_logs(spark, sf), 'label', KEYS).select(*KEYS, 'label', 'copy_id')


@register('c7_seeded_shuffle', O.with_views(
    f"SELECT *, row_number() OVER (ORDER BY {O.hash_sql(['log_id'])}, log_id) - 1 AS pos FROM ci_logs",
    'ci_logs'))
def q_shuffle(spark, sf):
    return seeded_shuffle(ci_logs(spark, sf), ['log_id'])


@register('c8_positional_split', O.with_views(f"""
SELECT {_CI}, CASE WHEN pos < floor(n * {O.dbl(0.7)}) THEN 'train'
                    WHEN pos < floor(n * {O.dbl(0.7 + 0.15)}) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {O.hash_sql(['log_id'])}, log_id) - 1 AS pos,
             count(*) OVER () AS n FROM ci_logs)""", 'ci_logs'))
def q_positional(spark, sf):
    return positional_split(ci_logs(spark, sf), ['log_id'])


def _quota_sql(src: str, cnt: str, frac: float, out: str) -> str:
    n = f'sum({cnt}) OVER ()'
    first = f'({n} - ceil({n} * {O.dbl(frac)}))'
    return f"""SELECT label, CAST(fl + CASE WHEN r <= need THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM (
      SELECT label, fl, need, row_number() OVER (ORDER BY cont - fl DESC, label) AS r FROM (
        SELECT label, cont, floor(cont) AS fl, nf - sum(floor(cont)) OVER () AS need FROM (
          SELECT label, {cnt} * {first} / {n} AS cont, {first} AS nf FROM {src})))"""


_LAB_CI = f"labci AS ({O.labelled(_CI, 'log_text', 'ci_logs')})"


@register('c9_stratified_split', O.with_views('', 'ci_logs').rstrip() + f""", {_LAB_CI}
, cc AS (SELECT label, count(*) AS cnt FROM labci GROUP BY label)
, q AS ({_quota_sql('cc', 'cnt', 0.2, 'q')})
SELECT {_CI}, label, CASE WHEN pos < q THEN 'train' ELSE 'test' END AS split FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.label ORDER BY {O.hash_sql(['log_id'])}, log_id) - 1 AS pos, q.q
  FROM labci l JOIN q USING (label))""")
def q_stratified(spark, sf):
    lab = label_logs(ci_logs(spark, sf), 'log_text')
    return stratified_split(lab, 'label', ['log_id'])


@register('c10_stratified_split3', O.with_views('', 'ci_logs').rstrip() + f""", {_LAB_CI}
, cc AS (SELECT label, count(*) AS cnt FROM labci GROUP BY label)
, q1 AS ({_quota_sql('cc', 'cnt', 0.3, 'q1')})
, rest AS (SELECT label, cnt - q1 AS cnt2, q1 FROM cc JOIN q1 USING (label))
, q2 AS ({_quota_sql('rest', 'cnt2', 0.5, 'q2')})
SELECT {_CI}, label, CASE WHEN pos < q1 THEN 'train' WHEN pos < q1 + q2 THEN 'val' ELSE 'test' END AS split
FROM (SELECT l.*, row_number() OVER (PARTITION BY l.label ORDER BY {O.hash_sql(['log_id'])}, log_id) - 1 AS pos,
             rest.q1, q2.q2
      FROM labci l JOIN rest USING (label) JOIN q2 USING (label))""")
def q_stratified3(spark, sf):
    lab = label_logs(ci_logs(spark, sf), 'log_text')
    return stratified_split3(lab, 'label', ['log_id'])


# ---------------------------------------------------------------- H1-H5
@register('h1_render_templates', O.with_views(
    'SELECT log_id, log_text, error_type, stack_trace FROM ci_logs', 'ci_logs'))
def q_render(spark, sf):
    return ci_logs(spark, sf).select('log_id', 'log_text', 'error_type', 'stack_trace')


def _augment_sql():
    k = ['doc_id', 'line_no']
    u = lambda salt: O.uniform_sql(k, salt=salt)
    pick = lambda vals, salt: (f"{O._list(vals)}[{O.hex8_sql(O.hash_sql(k, salt=salt))} % {len(vals)} + 1]")
    t = 'log_text'
    t = f"CASE WHEN {u('prefix')} < {O.dbl(0.3)} THEN {pick(R.AUGMENT_PREFIXES, 'prefix-choice')} || {t} ELSE {t} END"
    t = f"CASE WHEN {u('suffix')} < {O.dbl(0.2)} THEN ({t}) || {pick(R.AUGMENT_SUFFIXES, 'suffix-choice')} ELSE {t} END"
    # Java and Python upper-case 'ß' to 'SS'; DuckDB maps it to a capital sharp s.
    t = f"CASE WHEN {u('upper')} < {O.dbl(0.1)} THEN upper(replace({t}, 'ß', 'ss')) ELSE {t} END"
    return O.with_views(f'SELECT doc_id, line_no, {t} AS log_text FROM doc_lines', 'doc_lines')


@register('h2_augment_text', _augment_sql())
def q_augment(spark, sf):
    return augment_text(doc_lines(spark, sf), 'log_text', ['doc_id', 'line_no'])


@register('h3_inject_label_noise', f"""
SELECT doc_id, quality, CAST(CASE WHEN {O.uniform_sql(['doc_id'], salt='noise')} < {O.dbl(0.1)}
                                  THEN 1 - quality ELSE quality END AS INTEGER) AS noisy_quality FROM labels""")
def q_noise(spark, sf):
    lab = read_table(spark, sf, 'labels').select('doc_id', 'quality')
    return inject_label_noise(lab, 'quality', ['doc_id'], out_col='noisy_quality')


@register('h4_class_mix_sample', f"""
WITH par AS (SELECT 2 * least(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END),
                              sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)) AS n FROM labels)
, picked AS (SELECT doc_id, quality FROM (
    SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {O.hash_sql(['doc_id'])}, doc_id) - 1 AS p
    FROM labels) l, par
  WHERE (quality = 1 AND p < CAST(floor(par.n * {O.dbl(0.5)}) AS BIGINT))
     OR (quality = 0 AND p < par.n - CAST(floor(par.n * {O.dbl(0.5)}) AS BIGINT)))
SELECT doc_id, quality, row_number() OVER (ORDER BY {O.hash_sql(['doc_id'])}, doc_id) - 1 AS pos FROM picked""")
def q_class_mix(spark, sf):
    lab = read_table(spark, sf, 'labels').select('doc_id', 'quality')
    counts = {r[0]: r[1] for r in lab.filter('quality in (0, 1)').groupBy('quality').count().collect()}  # 2 rows at most
    n = 2 * min(counts.get(0, 0), counts.get(1, 0))
    return class_mix_sample(lab, 'quality', ['doc_id'], n, 0.5)


@register('h5_materialize_splits', O.with_views(f"""
SELECT {_CI}, CASE WHEN pos < floor(n * {O.dbl(0.7)}) THEN 'train'
                    WHEN pos < floor(n * {O.dbl(0.7 + 0.15)}) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {O.hash_sql(['log_id'])}, log_id) - 1 AS pos,
             count(*) OVER () AS n FROM ci_logs)""", 'ci_logs'))
def q_materialize(spark, sf):
    path = scratch_path(spark, 'splits')
    materialize_splits(ci_logs(spark, sf), path, ['log_id'])
    return spark.read.parquet(path)

"""Registered feature queries (D1-D9) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as D
from ..session import read_table, scratch_path
from . import oracle as O

QUERIES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- D1-D3
@register('d1_label_encode', """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus_code,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_code FROM orders""")
def q_encode(spark, sf):
    o = read_table(spark, sf, 'orders').select('o_orderkey', 'o_orderstatus', 'o_orderpriority')
    return D.label_encode(o, ['o_orderstatus', 'o_orderpriority']).select(
        'o_orderkey', 'o_orderstatus_code', 'o_orderpriority_code')


_SCALE = ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']
_TRAIN = f"{O.uniform_sql(['l_orderkey', 'l_linenumber'], salt='train')} < {O.dbl(0.8)}"


@register('d2_standard_scale', f"""
WITH li AS (SELECT *, {_TRAIN} AS is_train FROM lineitem),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALE)} FROM li WHERE is_train)
SELECT l_orderkey, l_linenumber, is_train,
       {', '.join(f'round(({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}'
                  for c in _SCALE)}
FROM li, st""")
def q_scale(spark, sf):
    li = read_table(spark, sf, 'lineitem').select('l_orderkey', 'l_linenumber', *_SCALE)
    li = li.withColumn('is_train', D.hash_train_flag(['l_orderkey', 'l_linenumber']))
    out = D.standard_scale(li, _SCALE, 'is_train')
    return out.select('l_orderkey', 'l_linenumber', 'is_train', *[_r6(F.col(c)).alias(c) for c in _SCALE])


@register('d3_assemble_features', """
SELECT o_orderkey, [round(o_totalprice, 6), CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE),
                    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE),
                    CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END] AS features FROM orders""")
def q_assemble(spark, sf):
    o = read_table(spark, sf, 'orders').select('o_orderkey', 'o_orderstatus', 'o_orderpriority', 'o_totalprice')
    o = D.label_encode(o, ['o_orderstatus', 'o_orderpriority'])
    o = o.withColumn('is_final', (F.col('o_orderstatus') == 'F').cast('double'))
    o = o.withColumn('o_totalprice', _r6('o_totalprice'))
    return D.assemble(o, ['o_totalprice'], ['o_orderstatus_code', 'o_orderpriority_code'], ['is_final']).select(
        'o_orderkey', 'features')


# ---------------------------------------------------------------- D4-D9 (documents)
_W = O.W
TOKS = (f"toks AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), "
        f"'[{_W}]+'), lambda w: regexp_full_match(w, '[a-zA-Z][a-zA-Z0-9_]*')) AS t FROM documents)")
TERMS = ("terms AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), "
         "lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM toks)")
TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY ALL)"
VOCAB = f"""vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, cf,
    ln((1 + (SELECT count(*) FROM documents)) / (df + 1)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term
        HAVING count(*) >= 2 AND count(*) <= {O.dbl(0.95)} * (SELECT count(*) FROM documents)
        ORDER BY cf DESC, term LIMIT 5000))"""
TFIDF = """tfidf AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf
  FROM (SELECT tf.doc_id, tf.term, v.idx, (1 + ln(tf.tf)) * v.idf AS w FROM tf JOIN vocab v USING (term)))"""
WITH_ALL = 'WITH ' + ', '.join([TOKS, TERMS, TF, VOCAB, TFIDF]) + ' '


def _docs(spark, sf):
    return read_table(spark, sf, 'documents').select('doc_id', 'text')


@register('d4_tokenize_ngrams', 'WITH ' + ', '.join([TOKS, TERMS]) + ' SELECT doc_id, terms FROM terms')
def q_tokenize(spark, sf):
    return D.tokenize_ngrams(_docs(spark, sf), 'text', 'terms').select('doc_id', 'terms')


@register('d5_fit_vocabulary', WITH_ALL + 'SELECT term, idx, df, cf, round(idf, 6) AS idf FROM vocab')
def q_vocab(spark, sf):
    v = D.fit_tfidf(_docs(spark, sf))
    return v.withColumn('idf', _r6('idf'))


@register('a8_save_load_vocabulary', WITH_ALL + 'SELECT term, idx, df, cf, round(idf, 6) AS idf FROM vocab')
def q_save_vocab(spark, sf):
    path = D.save_vocabulary(D.fit_tfidf(_docs(spark, sf)), scratch_path(spark, 'vocabulary'), ngram_range=[1, 2], max_features=5000)
    return D.load_vocabulary(spark, path)[0].withColumn('idf', _r6('idf'))


@register('d6_tfidf_transform', WITH_ALL + 'SELECT doc_id, term, idx, round(tfidf, 6) AS tfidf FROM tfidf')
def q_tfidf(spark, sf):
    _, t = D.fit_transform(_docs(spark, sf))
    return t.withColumn('tfidf', _r6('tfidf'))


@register('d7_top_features', WITH_ALL + 'SELECT term, round(idf, 6) AS idf FROM vocab ORDER BY idf, term LIMIT 20')
def q_top_features(spark, sf):
    v = D.fit_tfidf(_docs(spark, sf))
    return D.top_features(v, 20).select('term', _r6('idf').alias('idf'))


@register('d8_top_terms_per_doc', WITH_ALL + """
SELECT doc_id, term, round(tfidf, 6) AS tfidf, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM tfidf) WHERE rank <= 10""")
def q_top_terms(spark, sf):
    _, t = D.fit_transform(_docs(spark, sf))
    return D.top_terms_per_doc(t, 'doc_id', 10).select('doc_id', 'term', _r6('tfidf').alias('tfidf'), 'rank')


@register('d9_vocabulary_stats', WITH_ALL + """
SELECT count(*) AS vocabulary_size, CAST(5000 AS BIGINT) AS max_features, '1,2' AS ngram_range,
       CAST(2 AS DOUBLE) AS min_df, CAST(0.95 AS DOUBLE) AS max_df FROM vocab""")
def q_vocab_stats(spark, sf):
    return D.vocab_stats(D.fit_tfidf(_docs(spark, sf)))

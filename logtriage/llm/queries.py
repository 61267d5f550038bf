"""One registered query per operator, over the driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path
from . import bpe, class_lm, merkle, ngram_join, oracles, packing, quality_mil, quality_rules, secrets, spelling, suffix_dedup, topk, toxicity, warc


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, 'documents').select('doc_id', 'text')
    return suffix_dedup.remove_repeats(docs).drop('text')


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, sf_dir, 'documents'), public_tokenizers.path('word_bpe_49k.json'), **packing.INSTRUCTION)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read_table(spark, sf_dir, 'documents'), width=4, percent=85).drop('th')


def _id_crc(n: int) -> Column:
    return F.crc32(F.coalesce(F.col('doc_id').cast('string'), F.lit('')).cast('binary')) % n


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, 'documents'), read_table(spark, sf_dir, 'labels')
    model = quality_mil.fit(docs, labels.filter(_id_crc(3) != 1))
    return quality_mil.score_texts(docs, model).select(
        'doc_id', (_id_crc(3) == 1).alias('held_out'), 'score', F.when(F.col('score') >= 0.5, 1).otherwise(0).alias('predicted'),
        'n_passages', 'top_attention')


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, 'documents')
    return toxicity.grade_texts(docs, toxicity.fit(docs, read_table(spark, sf_dir, 'labels'))).drop('th')


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = public_tokenizers.path('byte_bpe_multi_50k.tiktoken'), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, 'documents').select('doc_id', 'text')
    ids = bpe.encode_texts(docs, *rules).drop('text')
    both = bpe.decode_ids(ids, *rules)
    return both.select('doc_id', F.size('ids').cast('long').alias('n_tokens'),
                       F.sha2(F.array_join(F.col('ids').cast('array<string>'), ','), 256).alias('ids_sha256'),
                       F.sha2('decoded', 256).alias('decoded_sha256'))


def op7_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, sf_dir, 'embeddings'), F.col('vec_id') % 50 == 0)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = class_lm.score_texts(read_table(spark, sf_dir, 'documents'), _id_crc(7) == 2)
    return out.select('doc_id', 'held_out', 'n_tokens', 'n_known', 'train_tokens', 'base_score', 'score', 'perplexity')


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, 'documents'))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, 'documents'), read_table(spark, sf_dir, 'labels'))


def op11_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(read_table(spark, sf_dir, 'pages'), scratch_path(spark, 'llm-warc'))
    return warc.resolved(warc.read_payloads(spark, path))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, 'documents'))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {'n_chars': F.col('n_chars').cast('decimal(20,0)') + 1}
    when = F.col('doc_id').isNotNull() & (_id_crc(7) == 0)
    return merkle.manifest(read_table(spark, sf_dir, 'documents'), 'lang', 'doc_id', ['doc_id', 'source', 'lang', 'n_chars', 'text'], changed, when)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_ngram_join, op4_quality_mil, op5_toxicity, op6_byte_bpe, op7_topk_products, op8_class_lm, op9_secret_scan, op10_quality_rules,
                                          op11_warc_segments, op12_spelling_variants, op13_merkle_manifest)}
ORACLES: dict[str, str] = {'op7_topk_products': oracles.TOPK_SQL, 'op11_warc_segments': oracles.WARC_SQL, 'op12_spelling_variants': oracles.SPELLING_SQL,
                           'op13_merkle_manifest': oracles.MERKLE_SQL}

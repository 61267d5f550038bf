"""From ``documents`` to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  All but the last return rows
with the columns of ``documents``; a stage's rows are written as Parquet and read again as
the next one's documents.

1. toxicity: documents whose probability of a toxic grade is over the limit go.
2. ngram_join: of each class of near copies (five-word shingles, similarity 0.8 or more)
   the document with the least id stays.
3. suffix_dedup: strings of 50 bytes that stand in a document with a smaller id are cut out;
   documents of which nothing but white space is left go.
4. secret_scan: secrets and identities found are replaced by a mark.
5. packing: the texts become ids, packed into sequences of 2048.

Rows with null text pass the first four stages as they are (packing gives them their end
token).  Repeated rows are near copies of each other: one stays after stage 2.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm import ngram_join, packing, secrets, suffix_dedup, toxicity
from logtriage.llm.common import written
from logtriage.session import ensure_checkpoint_dir, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, 'labels')))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return ngram_join.keep_first(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    names = docs.columns  # columns of the documents may be called like the measures
    docs = docs.withColumnsRenamed({c: f'own {i}' for i, c in enumerate(names) if c in suffix_dedup.MEASURED})
    out = suffix_dedup.remove_repeats(docs, 50, with_text=True)
    left = (F.col('n_removed') == 0) | F.col('text').rlike(r'[^\x20\x09-\x0D]')
    out = out.filter(left)
    if 'n_chars' in docs.columns:
        kind = docs.schema['n_chars'].dataType
        out = out.withColumn('n_chars', F.when(F.col('n_removed') > 0, F.length('text').cast(kind)).otherwise(F.col('n_chars')))
    return out.select(*[F.col(f'`{c}`') for c in docs.columns]).toDF(*names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, public_tokenizers.path('word_bpe_49k.json'), **packing.INSTRUCTION)


STAGES = [('toxicity', drop_toxic), ('ngram_join', keep_first_copies), ('suffix_dedup', cut_repeats),
          ('secret_scan', redact_secrets), ('packing', pack)]

#: Fitting, hashing and tokenizing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, 'documents')
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f'stage-{name}')
    return STAGES[-1][1](spark, docs, sf_dir)

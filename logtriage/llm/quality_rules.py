"""Quality rules: counting rules plus a hashed n-gram log-likelihood ratio (DataFrame only).

Unigrams and bigrams of every text are hashed into ``buckets`` cells.  Two multinomials are
counted over the whole corpus: raw (all documents) and trusted target (labelled good
documents).  A document's score is the mean over its n-grams of log(target / raw); it is
kept when no counting rule fails and the score reaches ``threshold``.  Log ratios are held
as integers of 1e-6, so sums do not depend on the order of rows.

The target is every document with a trusted label.  Their ids are counted first: up to
``BROADCAST_IDS`` go to every task, more are joined by shuffling.  The ratio table has
``buckets`` rows whatever the input's size, and is broadcast.

Edge cases: null or empty text has no words (``base_failed`` holds); a null ``doc_id`` is
never a target but gets its row; repeated rows each get the same result; an empty table
gives an empty result; without target rows all ratios are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, keyed, on_key, written

BUCKETS = 1 << 18
#: Trusted ids that are broadcast at most (16 bytes each in a task's table).
BROADCAST_IDS = 2_000_000
#: Mean log ratio below which a document is dropped.
THRESHOLD = -0.4
SYMBOLS = r'[#*$%&|<>]'


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def base_columns(k: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row."""
    t = F.col('text')
    lines = F.filter(F.split(t, '\n', -1), lambda x: x.rlike(r'[^\x20\x09-\x0D]'))
    df = k.select('doc_id', 'th', words_of(t).alias('w'), lines.alias('lines'),
                  F.length(F.regexp_replace(t, r'[\x20\x09-\x0D]+', '')).cast('long').alias('word_chars'),
                  F.regexp_count(t, F.lit(SYMBOLS)).cast('long').alias('n_symbols'))
    n = F.size('w')
    w = F.col('w')
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.select('doc_id', 'th', 'word_chars', 'n_symbols', n.cast('long').alias('n_words'),
                   (F.size('lines') - F.size(F.array_distinct('lines'))).cast('long').alias('n_dup_lines'), windows.alias('g'))
    # windows that occur twice are neighbours after sorting by (hash, position)
    at = F.when(F.size(F.array_distinct('g')) < F.size('g'), F.array_sort(F.transform('g', lambda x, i: F.struct(x.alias('h'), i.alias('i')))))
    df = df.select('doc_id', 'th', 'word_chars', 'n_symbols', 'n_words', 'n_dup_lines', at.alias('at'))
    s = F.col('at')
    same = lambda x, j: F.get(s, j)['h'] == x['h']
    twice = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x['i'], x['i'] + 1, x['i'] + 2)))))
    return df.select('doc_id', 'th', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines',
                     F.when(s.isNull(), 0).otherwise(covered).cast('long').alias('n_repeat_words'))


def _grams(k: DataFrame, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per word: the cell of the word and of the word with its successor (null at the end)."""
    df = k.select(*keep, words_of(F.col('text')).alias('w'))
    w = F.col('w')
    pairs = df.select(*keep, F.inline(F.arrays_zip(w.alias('a'), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias('b'))))
    pairs = pairs.toDF(*keep, 'a', 'b')
    cell = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast('int')
    return pairs.select(*keep, cell('a').alias('uni'), F.when(F.col('b').isNotNull(), cell('a', 'b')).alias('bi'))


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of the trusted documents (label 1), written."""
    ids = labels.filter((F.col('quality') == 1) & F.col('doc_id').isNotNull()).select(F.col('doc_id').cast('long').alias('doc_id'))
    return written(ids.distinct(), 'targets')


def ratio_table(k: DataFrame, targets: DataFrame, buckets: int = BUCKETS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(cell, lr): log of smoothed target over smoothed raw probability, in 1e-6."""
    flags = targets.withColumn('is_target', F.lit(1))
    flags = F.broadcast(flags) if targets.count() <= broadcast_ids else flags.hint('merge')
    marked = k.join(flags, 'doc_id', 'left')
    cells = (_grams(marked, 'is_target', buckets=buckets)
             .select('is_target', F.explode(F.array('uni', 'bi')).alias('cell')).filter(F.col('cell').isNotNull()))
    counts = cells.groupBy('cell').agg(F.count(F.lit(1)).alias('raw'), F.count('is_target').alias('target'))
    totals = counts.agg(F.sum('raw').alias('n_raw'), F.sum('target').alias('n_target'))
    lr = (F.log((F.col('target') + 1) / (F.col('n_target') + buckets)) - F.log((F.col('raw') + 1) / (F.col('n_raw') + buckets)))
    return (counts.join(F.broadcast(totals), how='cross')  # one row of totals
            .select('cell', F.when(F.col('n_target') > 0, F.round(lr * 1_000_000)).otherwise(0).cast('long').alias('lr')))


def ratio_scores(k: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, th, lr_sum, n_grams) per distinct row key."""
    uni = F.broadcast(ratios.toDF('uni', 'lr_uni'))
    bi = F.broadcast(ratios.toDF('bi', 'lr_bi'))
    g = _grams(k, 'doc_id', 'th', buckets=buckets).join(uni, 'uni', 'left').join(bi, 'bi', 'left')
    return g.groupBy('doc_id', 'th').agg((F.sum('lr_uni') + F.coalesce(F.sum('lr_bi'), F.lit(0))).alias('lr_sum'),
                                         (F.count('uni') + F.count('bi')).alias('n_grams'))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, the five counts, base_failed, llr (null without words), kept."""
    k = keyed(docs)
    ratios = written(ratio_table(k, target_ids(labels), buckets), 'ratios')
    scores = ratio_scores(k, ratios, buckets)
    # written first: a later filter on the counts must not be pushed into their expressions
    out = on_key(written(base_columns(k), 'counts'), scores)
    failed = (F.col('n_words') < 50) | (100 * F.col('n_repeat_words') > 50 * F.col('n_words'))
    llr = F.round(F.col('lr_sum') / F.col('n_grams') / 1_000_000, 6)
    out = out.withColumns({'base_failed': failed, 'llr': llr})
    return out.select('doc_id', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'base_failed',
                      'llr', (~F.col('base_failed') & F.coalesce(F.col('llr') >= threshold, F.lit(False))).alias('kept'))

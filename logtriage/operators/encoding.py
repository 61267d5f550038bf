"""Word ids of fixed length, decoding, length statistics, mean pooling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import word_tokens
from ..session import written
from .features import BROADCAST_TERMS, global_positions

#: Numbers of the vectors up to which they go to every task, and rows pooled at a time.
BROADCAST_NUMBERS, POOLED_ROWS = 1_000_000, 1024

#: Ids of the special tokens; words follow.
SPECIAL = {'[PAD]': 0, '[UNK]': 1, '[START]': 2, '[END]': 3}


def fit_token_vocab(docs: DataFrame, text_col='text', min_df: int = 1, max_size: int | None = None) -> DataFrame:
    """(token, token_id): special tokens, then words by document frequency (ties by word)."""
    words = docs.select(F.explode(F.array_distinct(word_tokens(F.col(text_col)))).alias('token'))
    words = words.groupBy('token').agg(F.count(F.lit(1)).alias('df')).filter(F.col('df') >= min_df)
    words = words.withColumn('less', -F.col('df'))
    if max_size is not None:
        words = words.orderBy('less', 'token').limit(max_size)
    words = global_positions(words, ['less', 'token'], 'token_id').select('token', (F.col('token_id') + len(SPECIAL)).cast('int').alias('token_id'))
    special = docs.sparkSession.createDataFrame(list(SPECIAL.items()), 'token string, token_id int')
    return special.unionByName(words)


def encode(docs: DataFrame, vocab: DataFrame, max_length: int = 256, id_col='doc_id', text_col='text',
           max_size: int | None = None) -> DataFrame:
    """(id, input_ids, attention_mask): start mark, words, end mark, cut and padded.

    Words are looked up once per document and distinct word.  ``max_size``: the bound the
    vocabulary was fitted with; only then is it broadcast.  Ids must be unique.
    """
    toks = docs.select(F.col(id_col), F.slice(word_tokens(F.col(text_col)), 1, max_length - 2).alias('t'))
    pos = toks.select(id_col, F.posexplode_outer('t').alias('p', 'token'))
    v = vocab.filter(F.col('token_id') >= len(SPECIAL))
    j = pos.join(F.broadcast(v) if max_size is not None and max_size <= BROADCAST_TERMS else v, 'token', 'left')
    ids = F.sort_array(F.collect_list(F.when(F.col('p').isNotNull(), F.struct('p', F.coalesce('token_id', F.lit(SPECIAL['[UNK]'])).alias('i')))))
    out = j.groupBy(id_col).agg(F.transform(ids, lambda x: x['i']).alias('w'))  # bounded by max_length
    row = F.concat(F.array(F.lit(SPECIAL['[START]'])), F.col('w'), F.array(F.lit(SPECIAL['[END]'])))
    pad = F.lit(max_length) - F.size('w') - 2
    return out.select(id_col, F.concat(row, F.array_repeat(F.lit(SPECIAL['[PAD]']), pad)).alias('input_ids'),
                      F.concat(F.array_repeat(F.lit(1), F.size('w') + 2), F.array_repeat(F.lit(0), pad)).alias('attention_mask'))


def decode(encoded: DataFrame, vocab: DataFrame, id_col='doc_id') -> DataFrame:
    """(id, text): the words of ``input_ids`` in order, special tokens dropped.

    Ids must be unique, as ``encode`` leaves them; a null id has no words.  The rows are read once.
    """
    pos = encoded.select(id_col, F.posexplode_outer(F.filter('input_ids', lambda x: x >= len(SPECIAL))).alias('p', 'token_id'))
    known = F.when(F.col('token').isNotNull() & F.col(id_col).isNotNull(), F.struct('p', 'token'))
    out = pos.join(vocab, 'token_id', 'left').groupBy(id_col).agg(F.sort_array(F.collect_list(known)).alias('w'))
    return out.select(id_col, F.array_join(F.transform('w', lambda x: x['token']), ' ').alias('text'))


def token_vocab_info(vocab: DataFrame) -> DataFrame:
    """(name, value): the size, and the id of each special token."""
    size = vocab.agg(F.lit('vocab_size').alias('name'), F.count(F.lit(1)).alias('value'))
    return size.unionByName(vocab.filter(F.col('token_id') < len(SPECIAL)).select(F.col('token').alias('name'), F.col('token_id').cast('long').alias('value')))


def _lengths(docs: DataFrame, text_col) -> DataFrame:
    """Ids of each text before cutting and padding: its words and the two marks."""
    return docs.select((F.size(word_tokens(F.col(text_col))) + 2).cast('long').alias('n'))


def token_stats(docs: DataFrame, max_length: int = 256, text_col='text') -> DataFrame:
    """Count, mean, max and min length, and texts that would be cut."""
    n = F.col('n')
    return _lengths(docs, text_col).agg(F.count(n).alias('num_texts'), F.round(F.avg(n), 6).alias('mean_length'), F.max(n).alias('max_length'),
                                        F.min(n).alias('min_length'), F.count(F.when(n > max_length, 1)).alias('truncated_count'))


def token_loss(docs: DataFrame, max_length: int = 512, text_col='text') -> DataFrame:
    """Tokens in all, texts cut, tokens lost, and both shares in percent."""
    n = F.col('n')
    lost = F.sum(F.greatest(n - max_length, F.lit(0)))
    agg = _lengths(docs, text_col).agg(F.coalesce(F.sum(n), F.lit(0)).alias('total_tokens'), F.count(F.when(n > max_length, 1)).alias('samples_truncated'),
                                       F.coalesce(lost, F.lit(0)).alias('tokens_lost'), F.count(n).alias('_rows'))
    return agg.select('total_tokens', 'samples_truncated', 'tokens_lost',
                      F.round(F.col('samples_truncated') * 100 / F.greatest('_rows', F.lit(1)), 6).alias('pct_samples_truncated'),
                      F.round(F.col('tokens_lost') * 100 / F.greatest('total_tokens', F.lit(1)), 6).alias('pct_tokens_lost'))


def mean_pool(tokens: DataFrame, vectors: DataFrame, id_col='doc_id', token_col='token_id', vector_col='vector') -> DataFrame:
    """(id, dim, value): the mean of the vectors of a document's tokens.

    ``tokens`` has one row per token to count (padding left out); tokens without a vector
    are left out too.  Equal tokens of a document are counted, and the sorted counts are added up
    document by document.  Vectors in use go to every task up to ``BROADCAST_NUMBERS`` numbers,
    so that only counts are shuffled; more are joined first.
    """
    n = tokens.groupBy(id_col, token_col).agg(F.count(F.lit(1)).cast('double').alias('_n')).filter(F.col(token_col).isNotNull())
    vectors = vectors.select(token_col, F.col(vector_col).cast('array<double>').alias('_x'))
    used = written(vectors.join(tokens.select(token_col).distinct(), token_col, 'left_semi'), 'used-vectors')
    rows, width = used.agg(F.count(F.lit(1)), F.max(F.size('_x'))).first()
    table = None
    if rows * (width or 0) <= BROADCAST_NUMBERS:
        table = used.toArrow().combine_chunks()
    else:
        n = n.join(used, token_col)
    n = n.repartition(id_col).sortWithinPartitions(id_col)
    kind = n.schema[id_col].dataType.simpleString()
    pooled = n.withColumnRenamed(id_col, '_id').mapInArrow(partial(_pooled, token_col=token_col, table=table), f'_id {kind}, values array<double>, present array<boolean>')
    parts = pooled.select(F.col('_id').alias(id_col), F.posexplode(F.arrays_zip('values', 'present')).alias('dim', '_v'))
    return parts.filter('_v.present').select(id_col, 'dim', F.col('_v.values').alias('value'))


def _cells(x: pa.Array) -> np.ndarray:
    """Numbers (null: 0), 1 where there is one or a null, 1 where there is one, by (row, dimension)."""
    size = np.asarray(x.value_lengths().fill_null(0))
    flat = x.flatten()
    at = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros((3, *at.shape))
    out[0][at], out[1][at], out[2][at] = np.asarray(flat.fill_null(0.0)), 1.0, np.asarray(flat.is_valid())
    return out


def _pooled(batches: Iterator[pa.RecordBatch], token_col: str, table: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """Means by dimension of counted tokens whose ids stand together; the last document of a slice
    is kept open.  The vectors are in ``table``, or beside the tokens."""
    if table is not None:
        names = table.column(token_col).combine_chunks().dictionary_encode()
        cells = _cells(table.column('_x').combine_chunks())
        known = np.zeros((3, len(names.dictionary), cells.shape[2]))
        for mine, own in zip(known, cells, strict=True):
            np.add.at(mine, np.asarray(names.indices), own)  # vectors may share a token
    open_id, held = None, None

    def batch_of(ids: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        value, weight, numbers = total
        off = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * value.shape[1])
        mean = pa.array((value / np.maximum(weight, 1e-9)).ravel(), mask=(numbers == 0).ravel())
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(off, mean), pa.ListArray.from_arrays(off, pa.array((weight > 0).ravel()))], ['_id', 'values', 'present'])

    for batch in batches:
        for lo in range(0, batch.num_rows, POOLED_ROWS):
            part = batch.slice(lo, POOLED_ROWS)
            if table is not None:
                at = pc.index_in(part.column(token_col), value_set=names.dictionary)
                part, at = part.filter(at.is_valid()), np.asarray(at.drop_null())
            if not part.num_rows:
                continue
            ids = part.column('_id')
            cells = known[:, at] if table is not None else _cells(part.column('_x'))
            code = np.asarray(ids.dictionary_encode('encode').indices)
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            # only numbers are counted once each, whatever their times
            cells[:2] *= np.asarray(part.column('_n'))[:, None]
            total, first = np.add.reduceat(cells, starts, axis=1), ids.take(pa.array(starts))
            if held is not None:
                width = max(held.shape[2], total.shape[2])
                held, total = (np.pad(x, ((0, 0), (0, 0), (0, width - x.shape[2]))) for x in (held, total))
                if open_id[0].as_py() == first[0].as_py():
                    total[:, :1] += held
                else:
                    yield batch_of(open_id, held)
            if len(starts) > 1:
                yield batch_of(first[:-1], total[:, :-1])
            open_id, held = first[-1:], total[:, -1:]
    if held is not None:
        yield batch_of(open_id, held)

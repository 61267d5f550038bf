"""Text classifier on TF-IDF trained in mini-batch epochs, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import word_tokens
from ..operators.features import fit_tfidf, load_vocabulary, save_vocabulary
from ..operators.sampling import hash_key, hex15
from ..session import scratch_path

#: Vocabularies that go to every task and whose gradients come back from each.
MOST_FEATURES = 200_000
#: Words that a task looks up at a time.
WORDS_AT_ONCE = 1 << 18
# ------------------------------------------------------------ fixed values: Adam
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
# ------------------------------------------------------------------------------


@dataclass
class TextModel:
    """Logistic regression over L2-normalised TF-IDF of words."""
    terms: dict[str, int]
    idf: np.ndarray
    weights: np.ndarray
    bias: float
    losses: list[float] = field(default_factory=list)

    def vectors(self, words: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, bounds, indices, values) of runs of texts, given as their words; text i of a run
        has the indices and values from bounds[i] to bounds[i + 1].  The words stay in Arrow's
        buffers, ``WORDS_AT_ONCE`` of them (one text at least) are looked up together."""
        terms, ids = pa.array(list(self.terms), pa.string()), np.fromiter(self.terms.values(), np.int64, len(self.terms))
        size = np.asarray(words.value_lengths().fill_null(0), np.int64)
        end, lo = np.cumsum(size), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + WORDS_AT_ONCE, 'right')))
            found = pc.index_in(words.slice(lo, hi - lo).flatten(), value_set=terms)
            known = np.asarray(found.is_valid())
            key = np.repeat(np.arange(hi - lo), size[lo:hi])[known] * len(ids) + ids[np.asarray(found.drop_null())]
            key, n = np.unique(key, return_counts=True)
            row, idx = key // max(len(ids), 1), key % max(len(ids), 1)
            w = (1 + np.log(n)) * self.idf[idx]
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            if len(w):
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)), np.diff(np.append(first, len(w))))
            yield hi - lo, bounds, idx, w
            lo = hi

    def save(self, path: str) -> str:
        """The vocabulary with its weights, and the rest as text."""
        spark = SparkSession.getActiveSession()
        rows = [(t, i, float(self.idf[i]), float(self.weights[i])) for t, i in self.terms.items()]
        return save_vocabulary(spark.createDataFrame(rows, 'term string, idx int, idf double, weight double'), path, bias=self.bias, losses=self.losses)


def load_text(spark: SparkSession, path: str) -> TextModel:
    vocab, about = load_vocabulary(spark, path)
    rows = sorted(vocab.collect(), key=lambda r: r.idx)  # at most MOST_FEATURES
    return TextModel({r.term: r.idx for r in rows}, np.array([r.idf for r in rows]), np.array([r.weight for r in rows]), about['bias'], about['losses'])


def _vectors(df: DataFrame, model: TextModel, text_col: str, names: list[str]) -> DataFrame:
    """``names`` of ``df`` with (idx, val) of each text."""
    fields = [F.col(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for n, bounds, idx, val in model.vectors(batch.column('_words')):
                at = pa.array(bounds, pa.int32())
                columns = [batch.column(c).slice(lo, n) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, pa.array(idx)), pa.ListArray.from_arrays(at, pa.array(val))], [*names, 'idx', 'val'])
                lo += n

    rows = df.select(*fields, word_tokens(F.col(text_col)).alias('_words'))
    schema = ', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.drop('_words').schema)
    return rows.mapInArrow(run, f'{schema}, idx array<long>, val array<double>')


def margins_of(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margin of each row, indices, values, row of each value)."""
    at = batch.column(batch.schema.get_field_index('idx'))
    idx, val = (np.asarray(batch.column(batch.schema.get_field_index(c)).flatten()) for c in ('idx', 'val'))
    row = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths().fill_null(0)))
    return np.bincount(row, val * weights[idx], batch.num_rows) + bias, idx, val, row


def _gradient(weights: np.ndarray, bias: float) -> Callable:
    """Per task: rows, loss and the gradient by weight, the bias last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 3)
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(batch.schema.get_field_index('label')))
                m, idx, val, row = margins_of(batch, weights, bias)
                d = 1 / (1 + np.exp(-m)) - y
                total[:-3] += np.bincount(idx, val * d[row], len(weights))
                total[-3:] += d.sum(), np.logaddexp(0, np.where(y == 1, -m, m)).sum(), batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ['sums'])
    return run


def fit_text(df: DataFrame, text_col='text', label_col='label', keys=('doc_id',), max_features: int = 5000, epochs: int = 10, batches: int = 8,
             rate: float = 0.05, reg: float = 1e-4, min_df: int = 2, seed: int = 42) -> TextModel:
    """Each epoch goes over ``batches`` mini-batches, equal shares of the rows in hash order
    of ``keys``; a step sums the gradients of the batch's partitions and moves the weights by
    Adam.  ``losses`` holds the mean loss of each epoch, as its batches were met.  Rows without
    a label take no part."""
    if max_features > MOST_FEATURES:
        raise ValueError(f'at most {MOST_FEATURES} features')
    key = F.concat_ws('|', *[F.col(k).cast('string') for k in keys])
    rows = df.filter(F.col(label_col).isNotNull()).select(key.alias('_key'), F.col(text_col).cast('string').alias('text'), (F.col(label_col) == 1).cast('double').alias('label'))
    vocab = fit_tfidf(rows, '_key', 'text', min_df=min_df, max_df=1.0, max_features=max_features, ngram_range=(1, 1)).orderBy('idx').collect()  # max_features rows
    model = TextModel({r.term: r.idx for r in vocab}, np.array([r.idf for r in vocab]), np.zeros(len(vocab)), 0.0)
    path = scratch_path(df.sparkSession, 'text-train')
    batch = F.pmod(hex15(hash_key(['_key'], seed, 'batch')), F.lit(batches)).cast('int')
    _vectors(rows.withColumn('batch', batch), model, 'text', ['label', 'batch']).write.partitionBy('batch').parquet(path)  # a step reads its batch only
    data = df.sparkSession.read.schema('label double, idx array<long>, val array<double>, batch int').parquet(path)
    w, first, second, step = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1), 0
    for _ in range(epochs):
        loss, seen = 0.0, 0.0
        for b in range(batches):
            out = data.filter(F.col('batch') == b).mapInArrow(_gradient(w[:-1], w[-1]), 'sums binary').toArrow()
            total = np.sum([np.frombuffer(x.as_py()) for x in out.column(0)], axis=0) if out.num_rows else np.zeros(len(w) + 2)
            loss, seen, n = loss + total[-2], seen + total[-1], total[-1]
            if not n:
                continue
            g = total[:-2] / n + reg * np.append(w[:-1], 0.0)
            step += 1
            first, second = BETA1 * first + (1 - BETA1) * g, BETA2 * second + (1 - BETA2) * g * g
            w = w - rate * (first / (1 - BETA1 ** step)) / (np.sqrt(second / (1 - BETA2 ** step)) + EPSILON)
        model.losses.append(float(loss / seen) if seen else 0.0)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def score_text(model: TextModel, df: DataFrame, text_col='text') -> DataFrame:
    """``df`` plus ``prediction``, ``probability_0``, ``probability_1``."""
    if model is None:
        raise ValueError('the model is not fitted')
    names = [c for c in df.columns if c not in ('prediction', 'probability_0', 'probability_1')]

    @F.arrow_udf('double')
    def margin(words: pa.Array) -> pa.Array:
        out = [float(val[a:b] @ model.weights[idx[a:b]]) + model.bias for _, bounds, idx, val in model.vectors(words) for a, b in pairwise(bounds.tolist())]
        return pa.array(out, pa.float64())

    p = 1 / (1 + F.exp(-F.col('_margin')))
    out = df.withColumn('_margin', margin(word_tokens(F.col(text_col))))
    return out.select(*names, (F.col('_margin') > 0).cast('int').alias('prediction'), (1 - p).alias('probability_0'), p.alias('probability_1'))


def epoch_losses(model: TextModel) -> DataFrame:
    """(epoch, loss)"""
    return SparkSession.getActiveSession().createDataFrame([(i, x) for i, x in enumerate(model.losses, 1)], 'epoch int, loss double')


def batch_score(df: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[float]]], text_col='text', batch: int = 16,
                out_col: str = 'score') -> DataFrame:
    """``make_scorer()`` runs once per task and returns a function from at most
    ``batch`` texts to as many numbers; null texts are empty.  Rows keep their columns."""
    @F.pandas_udf('double')
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for texts in parts:
            values = texts.fillna('').tolist()
            out: list[float] = []
            for lo in range(0, len(values), batch):
                got = list(scorer(values[lo:lo + batch]))
                if len(got) != len(values[lo:lo + batch]):
                    raise ValueError('the scorer returned another number of values than texts')
                out += got
            yield pd.Series(out, index=texts.index, dtype='float64')

    return df.withColumn(out_col, scored(F.col(text_col).cast('string')))

"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped into buckets of similar length and searched from the longest on.  For
a query with the k-th best score so far, a bucket whose longest vector cannot reach it is
skipped, and so are the shorter vectors at its end.  From that score follows the least
cosine a bucket's vector needs: where it is high, candidates must lie in a feasible interval
on the query's largest coordinates (coordinate pruning); else only lengths prune.  What is
left is verified by exact integer products.

A bounded number of the longest vectors (``seeds``) is sent to all queries for their first
bounds.  Then blocks of queries meet blocks of candidates: every query meets every block,
and each block returns at most k rows for a query.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows
without id, take no part; vectors meet those of the same dimension only; repeated rows are
candidates each, a repeated query id is one query (its least vector); ties go to the smaller
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a block at most, vectors in a bucket, queries in a block.
BLOCK_ROWS, BUCKET, QUERY_ROWS = 131_072, 1024, 65_536
SEEDS = 4096
#: From this local cosine threshold on, coordinates prune; so many coordinates are tried.
COSINE, FOCUS = 0.8, 4


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float('inf')))
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast('double') * scale)))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.int64)


def _exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer products of rows; by floats where these are exact."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(p).max(initial=0)))
    if top * top * q.shape[1] < 1 << 53:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ p.astype(np.int64).T


def search(q_ids, q, bound, p_ids, p, k: int):
    """(query, candidate, score) arrays: up to k best candidates of each query, those below
    its ``bound`` left out."""
    norm = np.sqrt((p.astype(float) ** 2).sum(1))
    order = np.lexsort((p_ids, -norm))
    p_ids, p, norm = p_ids[order], p[order], norm[order]
    q_norm = np.sqrt((q.astype(float) ** 2).sum(1))
    best = [np.zeros((0, 2), np.int64) for _ in q_ids]  # score, id
    bound = bound.astype(float).copy()
    focus = np.argsort(-np.abs(q), axis=1)[:, :FOCUS]
    for lo in range(0, len(p), BUCKET):
        hi = min(lo + BUCKET, len(p))
        reach = q_norm * norm[lo] * (1 + 1e-12)
        live = np.flatnonzero(reach >= bound)  # length pruning of the bucket
        if not len(live):
            continue
        with np.errstate(divide='ignore', invalid='ignore'):
            local = np.where(reach[live] > 0, bound[live] / reach[live], -1)
        coord = local >= COSINE
        whole = live[~coord]
        products = _exact(q[whole], p[lo:hi]) if len(whole) else None
        for i, j in enumerate(live.tolist()):
            if coord[i]:
                # cos >= t needs every coordinate within sqrt((1-t^2)(1-x^2)) of t*x
                unit = p[lo:hi][:, focus[j]] / np.maximum(norm[lo:hi, None], 1e-300)
                x, t = q[j, focus[j]] / q_norm[j], min(local[i] * (1 - 1e-9), 1.0)
                room = np.sqrt(max(1 - t * t, 0) * np.maximum(1 - x * x, 0)) + 1e-9
                near = unit >= t * x - room
                # above t the interval's other end is one-sided where the cosine may be higher
                ok = near if t <= 0 else near & (unit <= np.where(x >= t, 1.0, t * x + room))
                ok = np.where(x >= 0, ok, (unit <= t * x + room) & (unit >= np.where(-x >= t, -1.0, t * x - room))).all(1)
                rows = np.flatnonzero(ok)
                score = _exact(q[j:j + 1], p[lo:hi][rows])[0] if len(rows) else np.zeros(0, np.int64)
            else:
                rows, score = np.arange(hi - lo), products[np.searchsorted(whole, j)]
            pick = (score >= bound[j]) & (p_ids[lo:hi][rows] != q_ids[j])
            if not pick.any():
                continue
            new = np.stack([score[pick], p_ids[lo:hi][rows][pick]], 1)
            if len(new) > 4 * k:  # only the k-th best and its ties can stay
                cut = np.partition(new[:, 0], len(new) - k)[len(new) - k]
                new = new[new[:, 0] >= cut]
            both = np.concatenate([best[j], new])
            both = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
            best[j] = both
            if len(both) == k:
                bound[j] = max(bound[j], both[-1, 0])
    n = [len(b) for b in best]
    out = np.concatenate([np.zeros((0, 2), np.int64), *best])
    return np.repeat(q_ids, n), out[:, 1], out[:, 0]


def _seeded(batches, seeds: list, k: int):
    """Adds ``bound``: the k-th best score among the seeds (null if there are fewer)."""
    ids = np.array([s[0] for s in seeds], np.int64)
    size = np.array([len(s[1]) for s in seeds], np.int64)
    for b in batches:
        q_ids, lists = b.column('query_id').to_numpy(), b.column('q')
        q_size = np.array([len(x) for x in lists])
        bound = np.full(len(b), -np.inf)
        for d in np.unique(q_size):
            mine, theirs = np.flatnonzero(q_size == d), np.flatnonzero(size == d)
            if len(theirs) > k:
                s = _exact(_matrix(lists.take(pa.array(mine))), np.array([seeds[i][1] for i in theirs.tolist()]))
                s[q_ids[mine][:, None] == ids[theirs][None, :]] = np.iinfo(np.int64).min
                bound[mine] = np.partition(s, len(theirs) - k, axis=1)[:, len(theirs) - k]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in ('query_id', 'q', 'd')] + [pa.array(bound)], ['query_id', 'q', 'd', 'bound'])


def _block(queries: pa.Table, cands: pa.Table, k: int) -> pa.Table:
    if not len(queries) or not len(cands):
        a = b = s = np.zeros(0, np.int64)
    else:
        a, b, s = search(queries.column('query_id').to_numpy(), _matrix(queries.column('q')), queries.column('bound').to_numpy(),
                         cands.column('vec_id').to_numpy(), _matrix(cands.column('v')), k)
    return pa.table({'query_id': a, 'vec_id': b, 'score': s})


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col='vec_id',
                 vector_col='embedding', seeds: int = SEEDS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer products over
    all other rows (all, if fewer)."""
    base = vectors.select(F.col(id_col).cast('long').alias('vec_id'), quantised(F.col(vector_col), scale).alias('v'), is_query.alias('is_q'))
    base = base.filter(F.col('v').isNotNull() & F.col('vec_id').isNotNull()).withColumn('d', F.size('v'))
    norm = F.sqrt(F.aggregate('v', F.lit(0.0), lambda acc, x: acc + x * x))
    base = base.withColumn('length', F.floor(F.log(norm + 1) * 20).cast('int'))  # classes of 5 %
    n = base.count()
    rows = int(min(BLOCK_ROWS, max(4096, n // 64)))
    first = base.orderBy(F.desc('length'), 'vec_id').limit(seeds).select('vec_id', 'v').collect()  # ``seeds`` rows
    classes = base.groupBy('d', 'length').agg(F.count(F.lit(1)).alias('n'))
    # classes of one length are cut into blocks; small ones share a block of their dimension
    large = F.col('n') >= rows // 4
    classes = classes.select('d', 'length', F.when(large, F.col('length')).otherwise(-1).alias('cls'), F.when(large, F.ceil(F.col('n') / rows)).otherwise(1).cast('int').alias('cuts'))
    small = base.join(F.broadcast(classes), ['d', 'length'])  # one row per 5 % of length
    cands = small.select('vec_id', 'v', 'd', 'cls', F.pmod(F.xxhash64('vec_id'), F.col('cuts')).cast('int').alias('cut'))
    blocks = classes.select('d', 'cls', F.explode(F.sequence(F.lit(0), F.col('cuts') - 1)).alias('cut')).distinct()

    queries = base.filter('is_q').groupBy('vec_id').agg(F.min('v').alias('q')).select(F.col('vec_id').alias('query_id'), 'q', F.size('q').alias('d'))
    queries = queries.mapInArrow(partial(_seeded, seeds=[(r.vec_id, r.v) for r in first], k=k), 'query_id long, q array<long>, d int, bound double')
    groups = max(1, -(-n // QUERY_ROWS))
    queries = queries.withColumn('part', F.pmod(F.xxhash64('query_id'), F.lit(groups)).cast('int')).join(F.broadcast(blocks), 'd')
    cands = cands.withColumn('part', F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cands = cands.toDF('vec_id', 'v', 'cd', 'ccls', 'ccut', 'cpart')
    got = queries.groupBy('d', 'cls', 'cut', 'part').cogroup(cands.groupBy('cd', 'ccls', 'ccut', 'cpart')).applyInArrow(
        lambda x, y: _block(x, y, k), 'query_id long, vec_id long, score long')
    rank = F.row_number().over(Window.partitionBy('query_id').orderBy(F.desc('score'), 'vec_id'))
    return got.withColumn('rank', rank).filter(F.col('rank') <= k).select('query_id', F.col('rank').cast('int').alias('rank'), 'vec_id', 'score')

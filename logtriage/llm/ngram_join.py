"""N-gram Jaccard join: classes of documents linked by word-shingle similarity.

Documents with equal shingle sets are one set.  Two sets link when their Jaccard
similarity reaches ``percent`` / 100; the join is exact on 64-bit shingle hashes.

Candidates.  The hash range is cut into m parts by a scheme that depends on the size class
of the smaller set.  Linked sets of a scheme differ in at most k elements, so at most k of
the parts differ: they share T = (non-empty parts) - k part signatures at least.  As in
DivideSkip, each set sets its T - 1 longest inverted lists aside; the shortest list that
two linked sets share is kept by both, so no link is lost, and the lists of passages that
many documents hold are the ones set aside.  (A set with T < 1 keeps all its lists and one
list for such sets of its scheme.)

Verification is a T-occurrence search per query set: the inverted lists of its candidates
over its shingles; the short lists are merged, the long ones binary-probed, and candidates
reaching the required overlap are linked.  It runs in two steps, so that large groups of
near copies do not meet pairwise: first each list's members against the member that shares
most lists; then, per list, only pairs of sets not yet in one component.

Edge cases: null or empty text has no shingles and links with nothing; a text with fewer
words than a shingle is one shingle; a null ``doc_id`` counts as larger than every id;
repeated rows each get their row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, give_back, keyed, lean, on_key, renamed, text_slices, written
from .components import components
from .hashing import mix, range_hashes, prefix_sums, words

U = np.uint64
#: Parts beyond k: the more, the more lists a set can leave aside.
SPARE = 8
#: Text per bucket of lists, and signatures that a task gathers before it packs them.
BUCKET_BYTES, GATHERED = 8 << 20, 1 << 18
#: Bits of the map that marks candidate rows.
MARKS = 1 << 24
#: Candidates of a query set that are searched together.
BLOCK = 512


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their offsets."""
    starts, ends, first = words(data, off)
    w = range_hashes(prefix_sums(data, fold_case=True), starts, ends)
    out, sizes = [], np.zeros(len(off), np.int64)
    n = len(w)
    roll = np.zeros(max(n - width + 1, 0), U)
    for j in range(width):
        roll = roll * U(0x9E3779B97F4A7C15) + w[j:n - width + 1 + j] if len(roll) else roll
    roll = mix(roll ^ U(width))
    for i in range(len(off) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            s = np.sort(roll[lo:hi - width + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        elif hi > lo:
            x = np.zeros(1, U)
            for j in range(lo, hi):
                x = x * U(0x9E3779B97F4A7C15) + w[j]
            s = mix(x ^ U(hi - lo))
        else:
            s = w[:0]
        out.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else w[:0]), np.cumsum(sizes)


def fingerprints(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit value per set; 0 for the empty one."""
    sums = np.zeros(len(sets) + 1, U)
    np.cumsum(mix(sets ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    size = np.diff(off)
    return np.where(size > 0, mix(sums[off[1:]] - sums[off[:-1]] + size.astype(U)), U(0)).view(np.int64)


@lru_cache
def size_classes(percent: int) -> np.ndarray:
    """Least sizes of the classes: linked sets are in one class or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def signatures(sets: np.ndarray, off: np.ndarray, percent: int) -> Iterator[tuple]:
    """(set, T, signature) arrays for the scheme of a set's class and for the one below."""
    bounds = size_classes(percent)
    size = np.diff(off)
    cls = np.searchsorted(bounds, size, 'right') - 1
    for back in (0, 1):
        j = cls - back
        use = (size > 0) & (j >= 0)
        k = np.where(use, (bounds[np.maximum(j, 0) + 1] - 1) * (100 - percent) // percent, 0)
        use &= k > 0  # else only equal sets link
        m = k + SPARE + k // 10
        who = np.flatnonzero(use)
        if not len(who):
            continue
        own = np.repeat(np.arange(len(size)), size)
        keep = use[own]
        h, own = sets[keep], own[keep]
        part = ((h >> U(32)) * m[own].astype(U)) >> U(32)
        start = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (own[1:] != own[:-1])))
        total = np.add.reduceat(mix(h + U(0x2545F4914F6CDD1D)), start)
        s_own = own[start]
        sig = mix(total ^ mix((part[start] << U(20)) ^ j[s_own].astype(U) ^ U(0x632BE59BD9B4E019)))
        need = np.bincount(s_own, minlength=len(size)) - k
        odd = np.flatnonzero(use & (need < 1))
        yield (np.concatenate([s_own, odd]), np.maximum(need, 1)[np.concatenate([s_own, odd])],
               np.concatenate([sig, mix(j[odd].astype(U) ^ U(0x8CB92BA72F3D8DD7))]), j[np.concatenate([s_own, odd])])


META = 'doc_id long, th long, n_shingles long, fp long'


@lean
def _meta(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_slices(batch):
            sets, at = shingle_sets(data, off, width)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column('doc_id'), part.column('th'), pa.array(np.diff(at)), pa.array(fingerprints(sets, at))],
                                             ['doc_id', 'th', 'n_shingles', 'fp'])


LISTS = 'bucket int, fps binary, classes binary, needs binary, per binary, sigs binary'


@lean
def _lists(batches: Iterator[pa.RecordBatch], width: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures packed by hash bucket, once per distinct set of a batch."""
    for batch in batches:
        seen: set = set()
        got, size = [], 0
        for _, hi, data, off in text_slices(batch):
            sets, at = shingle_sets(data, off, width)
            fp = fingerprints(sets, at)
            fresh = np.zeros(len(fp), bool)
            for i, x in enumerate(fp.tolist()):
                fresh[i] = x not in seen
                seen.add(x)
            for own, need, sig, j in signatures(sets, at, percent):
                k = fresh[own]
                got.append((fp[own[k]], j[k].astype(np.int16), need[k].astype(np.int32), sig[k]))
                size += len(got[-1][0])
            del sets
            if size >= GATHERED or (got and hi == len(batch)):
                parts = [np.concatenate([g[i] for g in got]) for i in range(4)]
                got, size = [], 0
                yield from _packed_lists(*parts, buckets)


def _packed_lists(fp, j, need, sig, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = (sig >> U(40)) % U(buckets)
    order = np.lexsort((j, fp, bucket))
    fp, j, need, sig, bucket = fp[order], j[order], need[order], sig[order], bucket[order]
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(fp)) if len(fp) else [0]
    rows = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        f, c = fp[lo:hi], j[lo:hi]
        at = np.append(np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (c[1:] != c[:-1]))), hi - lo)
        rec = at[:-1]
        rows.append((int(bucket[lo]), f[rec].tobytes(), c[rec].astype(np.int16).tobytes(), need[lo:hi][rec].astype(np.int32).tobytes(),
                     np.diff(at).astype(np.int32).tobytes(), sig[lo:hi].tobytes()))
    if rows:
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary())
                                          for i, n in enumerate(('bucket', 'fps', 'classes', 'needs', 'per', 'sigs'))})


SHARED = 'fp long, class int, need int, sig long, len long'


def _shared(table: pa.Table) -> pa.Table:
    """A bucket's lists that hold two distinct sets, as (set, class, T, signature, length)."""
    col = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
    per = col('per', np.int32)
    fp, cls, need = (np.repeat(col(n, k), per) for n, k in (('fps', np.int64), ('classes', np.int16), ('needs', np.int32)))
    sig = col('sigs', U)
    order = np.lexsort((fp, sig))
    fp, cls, need, sig = fp[order], cls[order], need[order], sig[order]
    fresh = np.append(True, (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])) if len(sig) else np.zeros(0, bool)
    fp, cls, need, sig = fp[fresh], cls[fresh], need[fresh], sig[fresh]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    n = np.repeat(size, size)
    k = n > 1
    give_back()
    return pa.table({'fp': fp[k], 'class': cls[k].astype(np.int32), 'need': need[k], 'sig': sig[k].view(np.int64), 'len': n[k].astype(np.int64)})


@lean
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets of the rows."""
    for batch in batches:
        for lo, hi, data, off in text_slices(batch):
            sets, at = shingle_sets(data, off, width)
            raw = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(sets)])
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column('doc_id'), part.column('th'), pa.array(fingerprints(sets, at)), raw],
                                             ['doc_id', 'th', 'fp', 'elements'])


def bit_of(doc_id: str, th: str):
    return F.pmod(F.xxhash64(doc_id, th), F.lit(MARKS))


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with a column ``_marked``: whether their bit (column ``bit``) is that of a key.

    The bits are a broadcast table of MARKS / 64 rows at most (whatever the input's size), so
    rows are told apart where they are and no text goes to Python for it.
    """
    bits = (keys.select(bit_of('doc_id', 'th').alias('bit')).groupBy(F.expr('bit div 64').alias('_at'))
            .agg(F.bit_or(F.expr('shiftleft(1L, cast(bit % 64 as int))')).alias('_w')))
    out = rows.join(F.broadcast(bits), F.expr('bit div 64') == F.col('_at'), 'left')
    is_set = F.expr('shiftrightunsigned(_w, cast(bit % 64 as int)) & 1L') == 1
    return out.withColumn('_marked', F.coalesce(is_set, F.lit(False))).drop('_at', '_w')


def candidate_sets(k: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(fp, elements) of the ``nodes`` (doc_id, th), without shuffling the texts.

    A bit map (``marked``) tells which rows may be nodes; the sets of those rows are joined
    with the nodes exactly.
    """
    rows = marked(k.withColumn('bit', bit_of('doc_id', 'th')), nodes).filter('_marked').select('doc_id', 'th', 'text')
    sets = rows.mapInArrow(partial(_sets, width=width), 'doc_id long, th long, fp long, elements binary')
    return on_key(sets, nodes.select('doc_id', 'th'), 'left_semi').dropDuplicates(['doc_id', 'th']).select('fp', 'elements')


def divide_skip(query: np.ndarray, sets: list, percent: int) -> np.ndarray:
    """Flags of the ``sets`` whose Jaccard similarity with ``query`` reaches percent / 100.

    All are sorted distinct arrays.  The required overlap of a set is the least o with
    100 * o >= percent * (|query| + |set| - o).
    """
    size = np.array([len(s) for s in sets])
    need = -(-percent * (len(query) + size) // (100 + percent))
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, own = at[hit], own[hit]
    order = np.lexsort((own, at))
    at, own = at[order], own[order]
    length = np.bincount(at, minlength=len(query))
    first = np.cumsum(length) - length
    # lists set aside: the more, the higher the threshold and the longer the longest list
    least = int(need.min())
    aside = min(int(least / (0.01 * np.log2(max(length.max(), 2)) + 1)), max(least - 1, 0))
    long = np.argsort(-length, kind='stable')[:aside]
    is_long = np.zeros(len(query), bool)
    is_long[long] = True
    count = np.bincount(own[~is_long[at]], minlength=len(sets))
    live = np.flatnonzero(count >= need - aside)
    for q in long:
        lst = own[first[q]:first[q] + length[q]]
        if len(lst):
            p = np.minimum(np.searchsorted(lst, live), len(lst) - 1)
            count[live] += lst[p] == live
    return (count >= need) & (size > 0)


def _search(queries: pa.Table, cands: pa.Table, percent: int) -> pa.Table:
    a, b = [], []
    if len(queries) and len(cands):
        q = np.frombuffer(queries.column('elements')[0].as_buffer(), U)
        ids = cands.column('cand').to_numpy()
        ok = divide_skip(q, [np.frombuffer(x.as_buffer(), U) for x in cands.column('members')], percent)
        b = ids[ok]
        a = np.full(len(b), queries.column('a')[0].as_py())
    return pa.table({'a': pa.array(a, pa.int64()), 'b': pa.array(b, pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; the candidates of one ``a`` are searched in blocks."""
    n = pairs.groupBy('a').agg(F.count(F.lit(1)).alias('n'))
    salted = pairs.join(n, 'a').select('a', 'b', F.pmod(F.xxhash64('b'), F.ceil(F.col('n') / BLOCK)).cast('int').alias('salt'))
    # new names on one side: the two share their inputs, and a cogroup refuses that
    cands = salted.join(sets.toDF('b', 'elements'), 'b').select('a', 'salt', 'b', 'elements').toDF('of', 'part', 'cand', 'members')
    queries = salted.select('a', 'salt').distinct().join(sets.toDF('a', 'elements'), 'a').select('a', 'salt', 'elements')
    return queries.groupBy('a', 'salt').cogroup(cands.groupBy('of', 'part')).applyInArrow(
        lambda x, y: _search(x, y, percent), 'a long, b long')


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, th (hash of the text), n_shingles, component_id.

    ``component_id`` is the least doc_id reachable by links, the row's own included; rows
    without shingles are alone.
    """
    return rooted_classes(docs, width, percent).drop('root')


def rooted_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``jaccard_classes`` plus ``root``, a fingerprint that names the class: unlike
    ``component_id`` it is never null, and never that of another class with the same id.
    Rows without shingles have root 0.
    """
    k = keyed(docs)
    meta = written(k.mapInArrow(partial(_meta, width=width), META), 'sets')
    total = k.agg(F.sum(F.octet_length('text'))).first()[0] or 0
    buckets = int(max(1, total // BUCKET_BYTES))
    lists = k.select('text').mapInArrow(partial(_lists, width=width, percent=percent, buckets=buckets), LISTS)
    shared = written(lists.groupBy('bucket').applyInArrow(_shared, SHARED), 'lists')
    # each set's T - 1 longest lists are set aside
    per_set = shared.groupBy('fp', 'class').agg(F.first('need').alias('need'), F.sum('len').alias('weight'),
                                                F.sort_array(F.collect_list(F.struct('len', 'sig')), asc=False).alias('x'))
    # collect_list is bounded by the parts of one set
    kept = per_set.select('fp', 'weight', F.explode(F.slice('x', F.col('need'), F.size('x'))).alias('x'))
    kept = kept.select('fp', 'weight', F.col('x.sig').alias('sig'))
    several = kept.groupBy('sig').agg(F.min('fp').alias('lo'), F.max('fp').alias('hi')).filter('lo <> hi').select('sig')
    kept = written(kept.join(several, 'sig'), 'kept')

    first = meta.filter('fp <> 0').groupBy('fp').agg(F.min(F.struct(F.col('doc_id').isNull().alias('x'), 'doc_id', 'th')).alias('rep'),
                                                     F.first('n_shingles').alias('n'))
    nodes = written(first.join(kept.select('fp').distinct(), 'fp').select('fp', 'n', 'rep.doc_id', 'rep.th'), 'nodes')
    sets = written(candidate_sets(k, nodes, width), 'elements')
    sized = nodes.select('fp', 'n')

    def close(p: DataFrame) -> DataFrame:
        p = p.join(sized.toDF('a', 'n_a'), 'a').join(sized.toDF('b', 'n_b'), 'b')
        return p.filter(f'100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)').select('a', 'b')

    hub = kept.groupBy('sig').agg(F.max_by('fp', F.struct('weight', 'fp')).alias('a'))
    star = written(close(kept.join(hub, 'sig').filter('a <> fp').select('a', F.col('fp').alias('b')).distinct()), 'star')
    links = written(verified(star, sets, percent), 'links')
    found = components(links)

    c = kept.select('fp', 'sig').distinct().join(found.toDF('fp', 'root'), 'fp', 'left').select('fp', 'sig', F.coalesce('root', 'fp').alias('root'))
    mixed = c.groupBy('sig').agg(F.min('root').alias('lo'), F.max('root').alias('hi')).filter('lo <> hi').select('sig')
    c = written(c.join(mixed, 'sig'), 'mixed')
    left, right = c.toDF('a', 'sig', 'root_a'), c.toDF('b', 'sig', 'root_b')
    cross = left.join(right, 'sig').filter('root_a < root_b').select('a', 'b').distinct()
    done = star.unionByName(star.select(F.col('b').alias('a'), F.col('a').alias('b')))
    cross = written(close(cross.join(done, ['a', 'b'], 'left_anti')), 'cross')
    links = written(links.unionByName(verified(cross, sets, percent)), 'links')
    found = components(links)

    lowest = found.join(nodes.select(F.col('fp').alias('node'), 'doc_id'), 'node').groupBy('root').agg(F.min('doc_id').alias('component_id'))
    classes = found.join(lowest, 'root').select(F.col('node').alias('fp'), 'component_id', 'root')
    alone = first.select('fp', F.col('rep.doc_id').alias('own'))
    classes = alone.join(classes, 'fp', 'left').select('fp', F.coalesce('component_id', 'own').alias('component_id'), F.coalesce('root', 'fp').alias('root'))
    out = meta.filter('fp <> 0').join(classes, 'fp', 'left').select('doc_id', 'th', 'n_shingles', 'component_id', F.coalesce('root', 'fp').alias('root'))
    return out.unionByName(meta.filter('fp = 0').select('doc_id', 'th', 'n_shingles', F.col('doc_id').alias('component_id'), F.col('fp').alias('root')))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near copies stays, the one with the least id; all columns.

    Rows repeated with one id and text are copies too: one stays.  Rows without shingles
    stay.  Of rows with one id but other texts in one class, the least text hash stays.
    """
    cls = written(rooted_classes(docs, width, percent), 'classes')
    named = cls.filter('n_shingles > 0')
    best = named.groupBy('root').agg(F.min(F.struct(F.col('doc_id').isNull().alias('x'), 'doc_id', 'th')).alias('k'),
                                     F.count(F.lit(1)).alias('n')).filter('n > 1').select('root', 'k')
    first = F.col('doc_id').eqNullSafe(F.col('k.doc_id')) & (F.col('th') == F.col('k.th'))
    several = named.join(best, 'root').select('doc_id', 'th', first.alias('first'))
    gone = several.groupBy('doc_id', 'th').agg(F.max('first').alias('first'), F.count(F.lit(1)).alias('n'))
    # left out: the other members of a class, and keys of repeated rows, of which one returns
    gone = written(gone.filter('not first or n > 1'), 'copies')
    rows, _, _ = renamed(docs)
    rows = rows.withColumn('bit', bit_of('_id', '_th'))
    rows = marked(rows, gone)  # rows without a mark stay where they are; the others are joined
    stay, rest = rows.filter('not _marked'), rows.filter('_marked')
    out = by_key(rest, gone.select('doc_id', 'th'), 'left_anti')
    one = by_key(rest, gone.filter('first').select('doc_id', 'th'), 'left_semi').dropDuplicates(['_id', '_th'])
    return stay.unionByName(out).unionByName(one).drop('_id', '_th', 'bit', '_marked').toDF(*docs.columns)

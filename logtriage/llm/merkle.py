"""Merkle manifest of a table: a content-addressed store of digests, proofs by descent.

Every row is a leaf, the SHA-256 of its encoded values.  The leaves of one group are hashed
together ``fanout`` at a time, level by level, to the group's root; the group roots, in the
order of the groups, likewise to the root of the manifest.  A last run may be shorter; even
a single digest is hashed again as long as its tree has other nodes on that level.

* Ranks: leaves are range-partitioned by (group, order) and written; a small table of counts
  by (partition, group) turns places inside a partition into ranks inside a group.
* Store: one record for every ``radix`` = fanout**span nodes, keyed by the digest above them,
  with the lists of children on the levels between.  Equal content is stored once.
* Proofs: requests go down from the root.  A round joins them with the records by digest and
  goes on by the next rank digit to base ``radix``, collecting the unselected children as one
  path segment; requests for leaves of one record travel as one row until they reach it.  At
  the leaf the segments are reversed.  Rounds and written tables grow with the logarithm of
  the rows; every row of every table is bounded by ``radix``.

Edge cases of ``manifest``: nulls are encoded as ``-``, other values as their length in bytes,
``:`` and the value; null ids come first in their group, null groups first of all; rows with
one id are ordered by their digests, and equal rows are leaves of their own with proofs of
their own; rows with a null id are never tampered with; an empty table gives an empty result;
other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes under one record of the store, at most.
RADIX = 256


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts joined."""
    return sha256(''.join(parts).encode()).hexdigest()


def encoded(c: Column) -> Column:
    """``-`` for null, else length in UTF-8 bytes, ``:`` and the value."""
    s = c.cast('string')
    return F.coalesce(F.concat(F.octet_length(s).cast('string'), F.lit(':'), s), F.lit('-'))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def spanned(fanout: int) -> int:
    """Levels that one record covers."""
    span = 1
    while fanout ** (span + 1) <= RADIX:
        span += 1
    return span


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (with a column ``tree``) plus ``pos``, the rank inside its tree from 0, and
    ``n``, the leaves of the tree."""
    s = leaves.repartitionByRange('tree', *order).sortWithinPartitions('tree', *order)
    s = written(s.withColumn('_at', F.monotonically_increasing_id()), 'merkle-sorted')
    s = s.withColumn('_part', F.shiftright('_at', 33))
    counts = s.groupBy('tree', '_part').agg(F.min('_at').alias('_first'), F.count(F.lit(1)).alias('_n'))
    w = Window.partitionBy('tree')  # at most one row for each partition
    before = F.sum('_n').over(w.orderBy('_part').rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col('_n')
    starts = written(counts.select('tree', '_part', '_first', before.alias('_before'), F.sum('_n').over(w).alias('n')), 'merkle-starts')
    return s.join(starts, ['tree', '_part']).withColumn('pos', F.col('_at') - F.col('_first') + F.col('_before')).drop('_at', '_part', '_first', '_before')


def raised(nodes: list[str], n: int, fanout: int, span: int) -> tuple[int, list[list[str]]]:
    """Levels above ``nodes`` of a tree that has ``n`` nodes on theirs, topmost first and the
    nodes themselves last, and the tree's nodes on the topmost: at most ``span`` levels."""
    levels = [nodes]
    while len(levels) <= span and n > 1:
        below = levels[0]
        levels.insert(0, [digest(*below[i:i + fanout]) for i in range(0, len(below), fanout)])
        n = -(-n // fanout)
    return n, levels


_TIER = 'tree string, pos long, n long, digest string, below array<array<string>>'
_TIER_ARROW = pa.schema([('tree', pa.string()), ('pos', pa.int64()), ('n', pa.int64()), ('digest', pa.string()), ('below', pa.list_(pa.list_(pa.string())))])


def _raise(fanout: int, span: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, levels = raised(row['nodes'], row['n'], fanout, span)
                out.append({'tree': row['tree'], 'pos': row['pos'], 'n': n, 'digest': levels[0][0], 'below': levels[1:]})
            yield pa.RecordBatch.from_pylist(out, _TIER_ARROW)
    return run


@dataclass
class Forest:
    """A tree for each value of ``tree``: (tree, pos, n, digest, below) by tier, the lowest
    first; a row with n = 1 is the root of its tree."""
    tiers: list[DataFrame]
    fanout: int
    span: int

    def roots(self) -> DataFrame:
        """(tree, digest, tier)"""
        out = [t.filter('n = 1').select('tree', 'digest', F.lit(k).alias('tier')) for k, t in enumerate(self.tiers)]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]

    def record(self, tier: int) -> DataFrame:
        """The store: (digest, below), equal records once."""
        return self.tiers[tier].filter(F.size('below') > 0).groupBy('digest').agg(F.first('below').alias('below'))


def blocks_of(nodes: DataFrame, radix: int, *more: str) -> DataFrame:
    """Nodes (tree, pos, n, digest and more) gathered by ``radix`` consecutive ranks."""
    items = F.sort_array(F.collect_list(F.struct('pos', 'digest', *more)))
    return nodes.groupBy('tree', F.expr(f'pos div {radix}').alias('block')).agg(F.first('n').alias('n'), items.alias('items'))


def build(blocks: DataFrame, fanout: int = 2) -> Forest:
    """The trees over ``blocks_of`` their leaves."""
    span = spanned(fanout)
    radix, tiers = fanout ** span, []
    while True:
        nodes = blocks.select('tree', F.col('block').alias('pos'), 'n', F.transform('items', lambda x: x['digest']).alias('nodes'))
        tiers.append(written(nodes.mapInArrow(_raise(fanout, span), _TIER), 'merkle-tier'))
        if (tiers[-1].agg(F.max('n')).first()[0] or 0) <= 1:
            return Forest(tiers, fanout, span)
        blocks = blocks_of(tiers[-1].filter('n > 1'), radix)


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[list[str]]:
    """Unselected children on the way down to place ``at`` of the lowest level, topmost first."""
    out = []
    for k, level in enumerate(levels):
        i = at // fanout ** (len(levels) - 1 - k)
        lo = i - i % fanout
        out.append(level[lo:i] + level[i + 1:lo + fanout])
    return out


_ASK = 'tree string, pos long, digest string, path array<array<string>>, start string, base array<array<string>>, base_pos long'
_ASK_ARROW = pa.schema([('tree', pa.string()), ('pos', pa.int64()), ('digest', pa.string()), ('path', pa.list_(pa.list_(pa.string()))),
                        ('start', pa.string()), ('base', pa.list_(pa.list_(pa.string()))), ('base_pos', pa.int64())])


def _descend(fanout: int, radix: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                below = row.pop('below') or []
                out = []
                for i, child in enumerate(below[-1] if below else [row['digest']]):
                    out.append({**row, 'pos': row['pos'] * radix + i, 'digest': child, 'path': row['path'] + siblings(below, i, fanout)})
                yield pa.RecordBatch.from_pylist(out, _ASK_ARROW)
    return run


def requests(forest: Forest, starts: DataFrame) -> DataFrame:
    """Requests for the records of the lowest tier: (tree, pos, digest, path and more), from
    ``starts`` at the roots of the trees (tree, pos = 0, digest, tier, path and more)."""
    radix, asked = forest.fanout ** forest.span, None
    for tier in reversed(range(len(forest.tiers))):
        here = starts.filter(F.col('tier') == tier).drop('tier')
        here = here if asked is None else here.unionByName(asked)
        if tier == 0:
            return here
        asked = written(here.join(forest.record(tier), 'digest').select(*here.columns, 'below').mapInArrow(_descend(forest.fanout, radix), _ASK), 'merkle-asked')


def fold(node: str, path: list[list[str]], pos: int, fanout: int) -> str:
    """The root above ``node``, which stands at rank ``pos``: path from the leaf upwards."""
    for others in path:
        i = pos % fanout
        node = digest(*others[:i], node, *others[i:])
        pos //= fanout
    return node


_PROOF = 'doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, path_length int'
_PROOF_ARROW = pa.schema([('doc_id', pa.int64()), ('leaf', pa.string()), ('subroot', pa.string()), ('proof_sha256', pa.string()),
                          ('folded_root', pa.string()), ('path_length', pa.int32())])


def _prove(fanout: int, radix: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                below, first = row['below'] or [], row['pos'] * radix
                base = row['base'][::-1]
                upper = row['path'][::-1]  # of the tree, above this record
                tail = ''.join(s for level in upper + base for s in level)
                for want in row['items']:
                    at = want['pos'] - first
                    if (below[-1][at] if below else row['digest']) != want['digest']:
                        raise ValueError('a leaf is not where its rank leads')
                    own = siblings(below, at, fanout)[::-1]
                    path = own + upper
                    top = fold(want['bad'] or want['digest'], path, want['pos'], fanout)
                    out.append({'doc_id': want['doc_id'], 'leaf': want['digest'], 'subroot': row['start'],
                                'proof_sha256': digest(*[s for level in own for s in level], tail),
                                'folded_root': fold(top, base, row['base_pos'], fanout), 'path_length': len(path) + len(base)})
            yield pa.RecordBatch.from_pylist(out, _PROOF_ARROW)
    return run


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], tampered: dict[str, Column] | None = None,
             when: Column | None = None, fanout: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``order`` as doc_id, leaf, subroot (root of its group),
    root, proof_sha256 (digest of the siblings from the leaf up), folded_root (recomputed from
    the siblings and the leaf, or where ``when`` holds from the leaf with the ``tampered``
    values), verified (whether that is the root) and path_length."""
    if fanout < 2 or fanout > RADIX:
        raise ValueError(f'fanout must be from 2 to {RADIX}')
    values = [F.col(c) for c in fields]
    bad = F.when(when if when is not None else F.lit(False), leaf_digest(*[(tampered or {}).get(c, F.col(c)) for c in fields]))
    tree = F.coalesce(F.concat(F.lit('1'), F.col(group).cast('string')), F.lit('0'))  # null first, then bytewise
    leaves = docs.select(tree.alias('tree'), F.col(order).cast('long').alias('doc_id'), leaf_digest(*values).alias('digest'), bad.alias('bad'))
    leaves = written(leaves.withColumn('tie', F.monotonically_increasing_id()), 'merkle-leaves')
    radix = fanout ** spanned(fanout)

    wanted = written(blocks_of(ranked(leaves, ['doc_id', 'digest', 'tie']), radix, 'doc_id', 'bad'), 'merkle-wanted')
    forest = build(wanted, fanout)
    subroots = written(forest.roots(), 'merkle-subroots')
    tops = subroots.select(F.lit('').alias('tree'), F.col('tree').alias('name'), 'digest', 'tier')
    tops = written(ranked(tops, ['name']), 'merkle-tops')
    top_blocks = written(blocks_of(tops, radix), 'merkle-top-blocks')
    top = build(top_blocks, fanout)
    root = top.roots().first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _PROOF + ', root string, verified boolean')

    empty = F.array().cast('array<array<string>>')
    starts = top.roots().select('tree', F.lit(0).cast('long').alias('pos'), 'digest', 'tier', empty.alias('path'), F.lit(None).cast('string').alias('start'),
                                empty.alias('base'), F.lit(0).cast('long').alias('base_pos'))
    asked = requests(top, starts)
    found = asked.join(top.record(0), 'digest', 'left').select(*asked.columns, 'below').mapInArrow(_descend(fanout, radix), _ASK)
    names = tops.select(F.col('pos').alias('_pos'), 'name', 'tier')
    starts = found.join(names, F.col('pos') == F.col('_pos')).select(
        F.col('name').alias('tree'), F.lit(0).cast('long').alias('pos'), 'digest', 'tier', empty.alias('path'), F.col('digest').alias('start'),
        F.col('path').alias('base'), F.col('pos').alias('base_pos'))
    asked = requests(forest, written(starts, 'merkle-starts'))
    leafward = asked.join(forest.record(0), 'digest', 'left').select(*asked.columns, 'below')
    items = wanted.select(F.col('tree').alias('_tree'), F.col('block').alias('_block'), 'items')
    rows = leafward.join(items, (F.col('tree') == F.col('_tree')) & (F.col('pos') == F.col('_block')))
    proofs = rows.select('pos', 'digest', 'path', 'start', 'base', 'base_pos', 'below', 'items').mapInArrow(_prove(fanout, radix), _PROOF)
    return proofs.withColumns({'root': F.lit(root.digest), 'verified': F.col('folded_root') == F.lit(root.digest)})

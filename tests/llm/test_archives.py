"""WARC segments, spelling variants and the Merkle manifest against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from logtriage.llm import merkle, oracles, queries, spelling, warc
from logtriage.session import scratch_path, written

from .helpers import LOWER, docs_of, key

SF = '/root/testdata/sf0.001'


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(('name', 'table'), [('op11_warc_segments', 'pages'), ('op12_spelling_variants', 'documents'), ('op13_merkle_manifest', 'documents')])
def test_queries_equal_sql(spark, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert set(got.columns) == set(want.columns)
    assert rows_of(got.select(*want.columns)) == sorted(want.fetchall(), key=str)


# ---------------------------------------------------------------- op11
PAGES = [(5, 'u1', 'é🙂' * 60), (3, 'u2', 'é🙂' * 60), (3, 'u2', 'é🙂' * 60), (None, 'u', 'x' * 120), (9, None, 'x' * 120), (None, None, None), (7, 'u', None),
         (7, 'u', ''), (8, 'a\r\nb: WARC/1.1', 'y' * 99), (10, 'q', 'y' * 99), (11, 'q', '\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n' * 500), (12, 'q', 'WARC/1.1'),
         (13, 'z', 'ß' * 90_000), (14, 'z', 'ß' * 90_000)]


def pages_of(spark, rows):
    extra = 'page_id long, url string, html string, digest string, tie string, id string, value string, first_tie string'
    return written(spark.createDataFrame([(*r, *'aaaaa') for r in rows], extra).repartition(3), 'pages')


def pages_expected(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or '').encode()].append(i)
    out = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, key(i)))
        for k, i in enumerate(ids):
            again = k > 0 and len(body) >= 100
            out.append((i, len(body), sha(body), 'revisit' if again else 'response', ids[0] if again else None, None))
    return sorted(out, key=str)


def test_archives_return_every_page(spark):
    path = warc.write_archives(pages_of(spark, PAGES), scratch_path(spark, 'warc'), segment_bytes=1000, chunk_bytes=77)
    was = spark.conf.get('spark.sql.files.maxPartitionBytes')
    spark.conf.set('spark.sql.files.maxPartitionBytes', '5003')  # version lines and records across splits
    try:
        assert rows_of(warc.resolved(warc.read_payloads(spark, path))) == pages_expected(PAGES)
        records = warc.read_records(spark, path)
        assert records.filter("kind = 'continuation'").count() > 180 and records.filter('problem is not null').isEmpty()
        payloads = {r.page_id: r.payload for r in warc.read_payloads(spark, path).filter("kind = 'response'").collect()}
        assert payloads[13].decode() == 'ß' * 90_000 and payloads[11].decode() == PAGES[10][2]
    finally:
        spark.conf.set('spark.sql.files.maxPartitionBytes', was)


def test_archives_without_rows(spark):
    path = warc.write_archives(pages_of(spark, PAGES).limit(0), scratch_path(spark, 'warc'))
    assert warc.resolved(warc.read_payloads(spark, path)).collect() == []


def test_broken_segments_are_reported(spark):
    rows = [(1, 'u', 'a' * 5000), (2, 'u', 'b' * 5000), (3, 'u', 'c' * 5000), (4, 'u', 'd')]
    records = warc.read_records(spark, warc.write_archives(pages_of(spark, rows), scratch_path(spark, 'warc'), segment_bytes=900))
    origin = {r.page_id: r.record_id for r in records.filter('page_id is not null').collect()}
    own = F.coalesce('origin', 'record_id')
    lost = records.filter(~((own == origin[1]) & F.col('segment').eqNullSafe(3)))
    wrong = lost.withColumn('total', F.when(own == origin[2], F.col('total') + 1).otherwise(F.col('total')))
    twice = wrong.unionByName(wrong.filter(own == origin[3]))
    out = {r.record_id: (r.problem, r.block) for r in warc.reassembled(twice).collect()}
    assert out[origin[1]] == ('segments are missing or repeated', None)
    assert out[origin[2]] == ('the segments do not have the total length', None)
    assert out[origin[3]][0] is None and warc.dechunked(out[origin[3]][1].partition(b'\r\n\r\n')[2]) == b'c' * 5000
    assert out[origin[4]][0] is None and len(out) == 4


def test_chunk_framing():
    for body in (b'', b'x', b'ab' * 9000, b'WARC/1.1' * 3, b'0\r\n\r\n', b'WARC/1.1'):
        framed = warc.chunked(body, 7)
        assert warc.dechunked(framed) == body and b'WARC/1.1' not in framed
    assert warc.dechunked(b'3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n') == b'abc'
    assert warc.dechunked(b'5\r\nabc\r\n0\r\n\r\n') is None and warc.dechunked(b'3\r\nabc\r\n') is None
    assert warc.parsed(b'WARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r')['problem']


# ---------------------------------------------------------------- op12
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def letters(text):
    out = ['']
    for ch in text or '':
        if 'a' <= ch <= 'z' or 'A' <= ch <= 'Z' or 'À' <= ch <= 'ÿ':
            out[-1] += ch.translate(LOWER)
        elif out[-1]:
            out.append('')
    return [w for w in out if w]


def spelling_expected(rows):
    n = Counter()
    for i, text in rows:
        for run in letters(text):
            h = zlib.crc32(f'{"" if i is None else i}:{run}'.encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                n[run] += 1
    return variants_expected({w: c for w, c in n.items() if c >= 2})


def variants_expected(n):
    form, count = {}, {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        count[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n), key=str)


def test_words_and_variants_equal_brute_force(spark):
    rows = [(i, t) for i, t in [(r.doc_id, r.text) for r in docs_of(spark).collect()]]
    extra = [(100 + i, ' '.join(['naïveté', 'naivete', 'façades', 'Façade×s', 'ÉLÉMENTS', 'éléments', 'l’élément', 'transformer', 'transfomer'] * (1 + i % 3))) for i in range(150)]
    rows += extra + [(None, 'transformer ' * 500), (7, 'Ünïted' + 'z' * 200 + ' ' + 'z' * 201)] + [(7, 'z' * 200 + ' ' + 'z' * 201)] * 2
    got = rows_of(spelling.spelling_variants(docs_of(spark, rows)))
    assert got == spelling_expected(rows)
    assert any(r[1] for r in got) and len(got) > 20
    assert spelling.spelling_variants(docs_of(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize('pairs', [1, 50, 10**9])
def test_shared_chunks_are_told_apart(spark, pairs):
    words = {}
    for i in range(300):  # one ending shared by all, one beginning shared by many, and edits of every kind
        w = ''.join('abcd'[(i >> k) % 4] for k in (0, 2, 4, 6)) + 'ations'
        words[w] = 3 + i % 50 * 20
        if i % 5 == 0:
            for x in (w[:i % 10] + 'é' + w[i % 10:], w[:i % 9] + w[i % 9 + 1:], w[:i % 9] + 'z' + w[i % 9 + 1:], w + 's', 's' + w):
                words.setdefault(x, 2)
    words |= {'aaaaaaa': 1000, 'aaaaaaaa': 90, 'aaaaaaaaa': 7, 'a' * 300: 5, 'a' * 301: 50}
    df = spark.createDataFrame(list(words.items()), 'word string, n long')
    found = [(r.a, r.b) for r in spelling.near_pairs(written(df, 'words'), pairs).collect()]
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert rows_of(spelling.variants(df)) == variants_expected(words)


# ---------------------------------------------------------------- op13
def runs_up(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(''.join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def encoded(*values):
    return ''.join('-' if v is None else f'{len(str(v).encode())}:{v}' for v in values)


def manifest_expected(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(((r.doc_id is not None, key(r.doc_id)), sha(encoded(r.doc_id, r.lang, r.n_chars, r.text)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or '').encode()))
    trees = {g: runs_up([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in names}
    top = runs_up([trees[g][-1][0] for g in names], fanout)
    out = []
    for g in names:
        for pos, (_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            bad = r.doc_id is not None and r.doc_id % 3 == 0
            node = sha(encoded(r.doc_id, r.lang, None if r.n_chars is None else r.n_chars + 1, r.text)) if bad else leaf
            proof, levels = '', 0
            for tree, at in ((trees[g], pos), (top, names.index(g))):
                for level in tree[:-1]:
                    lo = at - at % fanout
                    before, after = level[lo:at], level[at + 1:lo + fanout]
                    proof, node, at, levels = proof + ''.join(before + after), sha(''.join([*before, node, *after])), at // fanout, levels + 1
            out.append((r.doc_id, leaf, trees[g][-1][0], sha(proof), node, levels, top[-1][0], node == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(docs, fanout):
    tampered = {'n_chars': F.col('n_chars') + 1}
    return merkle.manifest(docs, 'lang', 'doc_id', ['doc_id', 'lang', 'n_chars', 'text'], tampered, F.col('doc_id') % 3 == 0, fanout)


@pytest.mark.parametrize('fanout', [2, 3, 17])
def test_manifest_equals_brute_force(spark, fanout):
    docs = docs_of(spark)
    many = spark.range(1500).select(F.col('id').alias('doc_id'), F.lit('text').alias('text'), F.when(F.col('id') % 7 == 0, None).when(F.col('id') < 1300, 'de').otherwise(
        F.concat(F.lit('é-'), F.col('id').cast('string'))).alias('lang'), F.lit(None).cast('string').alias('source'), F.lit(4).cast('long').alias('n_chars'))
    same = docs.limit(1).select('doc_id', 'text', 'lang', 'source', 'n_chars').crossJoin(spark.range(700)).drop('id')  # one row, 700 times
    docs = written(docs.unionByName(many.unionByName(same), allowMissingColumns=True), 'docs')
    got = manifest_of(docs, fanout)
    assert rows_of(got) == manifest_expected(docs.collect(), fanout)
    assert got.filter('verified').count() > 1000 and got.filter('not verified').count() > 400


def test_small_manifests(spark):
    docs = docs_of(spark)
    assert manifest_of(docs.limit(0), 2).collect() == []
    one = docs.filter('doc_id = 6')
    (row,) = manifest_of(written(one, 'one'), 2).collect()
    assert row.root == row.subroot == row.leaf and row.proof_sha256 == sha('') and not row.verified and row.path_length == 0


def test_records_are_stored_once(spark):
    leaves = spark.range(4096).select(F.lit('t').alias('tree'), F.col('id').alias('pos'), F.lit(4096).cast('long').alias('n'), F.lit(sha('x')).alias('digest'))
    forest = merkle.build(written(merkle.blocks_of(leaves, 256), 'blocks'))
    assert [t.count() for t in forest.tiers] == [16, 1] and [forest.record(k).count() for k in (0, 1)] == [1, 1]
    assert forest.roots().first().digest == runs_up([sha('x')] * 4096, 2)[-1][0]


def test_crc_of_runs():
    import numpy as np
    text = b'abcXYZ' * 40
    starts, ends = np.array([0, 5, 100, 3]), np.array([7, 90, 100, 4])
    first = np.array([zlib.crc32(f'{i}:'.encode()) for i in range(4)], np.uint32)
    got = spelling.run_hashes(np.frombuffer(text, np.uint8), starts, ends, first)
    assert got.tolist() == [zlib.crc32(f'{i}:'.encode() + text[s:e]) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def test_sql_is_registered():
    assert {oracles.WARC_SQL, oracles.SPELLING_SQL, oracles.MERKLE_SQL} <= set(queries.ORACLES.values())

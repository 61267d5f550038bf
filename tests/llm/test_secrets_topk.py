import hashlib
import re
from collections import Counter

import duckdb
import numpy as np

from logtriage.llm import oracles, secrets, topk
from pyspark.sql import functions as F

from .helpers import awkward_texts, docs_of

WORDS = '|'.join(''.join(f'[{c}{c.upper()}]' for c in w) for w in ('password', 'passwd', 'secret', 'token')) + '|[aA][pP][iI]_?[kK][eE][yY]'
ASSIGN = re.compile(rf'''({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''')
KEY = 'AKIA' + 'ABCDEFGH12345678'
HEX = '0123456789abcdef' * 3


def base(text):
    t = text or ''
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer('AKIA[A-Z0-9]+', t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer('[0-9a-f]+', t) if len(m[0]) >= 32]
    return ','.join(f'{["assign", "access", "hex"][k]}:{s}:{e}' for s, k, e in sorted(spans))


TEXTS = [
    f'é🙂 PassWord: "abcdefgh1" and api_key=short token=abc secret=token:abcdefghij {KEY} x {KEY[:15]} AKIA', f'{HEX}{HEX} {HEX[:31]} z',
    'passwd==abcdefgh secret  :  \'0123456789ab\' apikey=a.b-c_d/e+f=', 'AKIAAKIAAKIAAKIA1 token=' + HEX, 'ſecret=abcdefghijk toKen=abcdefghijk']


def test_base_spans(spark):
    rows = [*awkward_texts(), *[(100 + i, t) for i, t in enumerate(TEXTS)]]
    out = secrets.scan(docs_of(spark, rows)).collect()
    want = Counter((i, hashlib.sha256(base(t).encode()).hexdigest(), base(t).count('assign'), base(t).count('access'), base(t).count('hex')) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in out) == want
    assert secrets.scan(docs_of(spark, [])).collect() == []


def test_weak_parts_need_a_complement(spark):
    weak = 'Zq3xV9kLm2Pw8RtY5uBn'
    far = ' plain words' * 60
    texts = {1: f'see {weak} here', 2: f'client_id = svc_reader and then {weak}', 3: f'client_id = svc_reader{far} {weak}',
             4: f'https://db.example.org/x with {weak}', 5: 'https://db.example.org/x alone', 6: f'login: someone and {HEX}', 7: f'{weak} {weak[::-1]}'}
    out = {r.doc_id: r.spans for r in secrets.scan(docs_of(spark, list(texts.items()))).collect()}
    kinds = {i: sorted(x.split(':')[0] for x in s.split(',') if x) for i, s in out.items()}
    assert kinds == {1: [], 2: ['entropy', 'identity'], 3: [], 4: ['endpoint', 'entropy'], 5: [], 6: ['hex', 'identity'], 7: []}
    s, e = (int(x) for x in out[4].split(',')[1].split(':')[1:])
    assert texts[4][s:e] == weak


def test_redact(spark):
    rows = [(1, f'a token = {HEX} b'), (2, None), (3, 'clean text'), (1, f'a token = {HEX} b'), (None, f'é {KEY}')]
    docs = docs_of(spark, rows)
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert got == Counter([(1, 'a [SECRET] b', 12)] * 2 + [(2, None, None), (3, 'clean text', 10), (None, 'é [SECRET]', 10)])


def vectors(spark, rows):
    return spark.createDataFrame(rows, 'vec_id long, embedding array<float>, label int')


def brute(rows, k=5):
    v = {i: np.floor(np.array(x, np.float32).astype(float) * 256).astype(np.int64) for i, x, _ in rows
         if i is not None and x and None not in x and np.isfinite(np.array(x, float)).all()}
    out = set()
    for q in (q for q in v if q % 50 == 0):
        best = sorted((-int(v[q] @ y), c) for c, y in v.items() if c != q and len(y) == len(v[q]))[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def test_topk_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)], None) for i in range(130)]
    rows += [(200 + i, rows[3][1], 1) for i in range(40)]  # ties
    rows += [(300, None, 0), (301, [1.0, None] * 4, 0), (302, [float('nan')] * 8, 0), (303, [float('inf')] * 8, 0), (304, [], 0),
             (350, [1.0, 2.0], 0), (351, [0.5, 0.5], 0), (400, [0.0] * 8, 0), (None, [9.0] * 8, 0)]
    out = topk.top_products(vectors(spark, rows), F.col('vec_id') % 50 == 0).collect()
    assert {(r.query_id, r['rank'], r.vec_id, r.score) for r in out} == brute(rows) and len(out) == len(brute(rows))
    assert topk.top_products(vectors(spark, []), F.col('vec_id') % 50 == 0).collect() == []


def test_search_prunes_nothing_it_needs():
    rng = np.random.default_rng(0)
    for _ in range(25):
        d = rng.integers(1, 6)
        around = rng.integers(-3, 4, (20, d)) * rng.integers(1, 40, (20, 1))
        p = around[rng.integers(0, 20, 2500)] * rng.integers(1, 6, (2500, 1)) + rng.integers(-1, 2, (2500, d))
        ids = rng.permutation(2500)
        a, b, s = topk.search(ids[:20], p[:20], np.full(20, -np.inf), ids, p, 5)
        all_scores = p[:20] @ p.T
        for i in range(20):
            want = sorted((-all_scores[i, j], ids[j]) for j in range(2500) if ids[j] != ids[i])[:5]
            assert [(-y, x) for z, x, y in zip(a, b, s, strict=True) if z == ids[i]] == want


def test_topk_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)], 0) for i in range(120)]
    path = str(tmp_path / 'embeddings.parquet')
    vectors(spark, rows).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{path}/*.parquet')")
    assert set(con.sql(oracles.TOPK_SQL).fetchall()) == brute(rows)

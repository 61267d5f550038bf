"""The pipeline's stages against what they stand for, and the registered queries."""

import re
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from logtriage.session import TABLES, written

from .helpers import docs_of

SF = '/root/testdata/sf0.001'


def test_every_operator_is_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f'op{n}_') for x in names) == 1
    assert 'pipeline' in names and [n for n, _ in P.STAGES] == ['toxicity', 'ngram_join', 'suffix_dedup', 'secret_scan', 'packing']
    assert 'documents' in TABLES and E.oracle_sql().keys() <= names.keys()


@pytest.fixture(scope='module')
def staged(spark):
    docs = [spark.read.parquet(f'{SF}/documents.parquet')]
    for _, stage in P.STAGES:
        docs.append(stage(spark, docs[-1], SF))
    return docs


def test_stages(staged):
    start, kept, single, cut, clean, packed = staged
    assert all(d.columns == start.columns for d in (kept, single, cut, clean))
    texts = [{r.doc_id: r.text for r in d.collect()} for d in (start, kept, single, cut, clean)]
    assert texts[0].items() >= texts[1].items() >= texts[2].items() and len(texts[1]) > 0.8 * len(texts[0])
    words = re.compile(r'[^\x20\x09-\x0D]+')

    def sets(t):
        w = words.findall(t.lower())
        return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) or {tuple(w)}

    have = {i: sets(t) for i, t in texts[2].items()}
    ids = sorted(have)
    assert not any(len(have[a] & have[b]) >= 0.8 * len(have[a] | have[b]) for a in ids for b in ids if a < b)
    windows = Counter()
    for i, t in texts[3].items():
        assert i in texts[2] and len(t) <= len(texts[2][i])
        windows.update({t[p:p + 60] for p in range(len(t) - 59)} if t == texts[2][i] else ())
    assert all(n == 1 for n in windows.values())
    assert not any(re.search('AKIA[A-Z0-9]{12}|[0-9a-f]{32}', t) for t in texts[4].values())
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(texts[4]) and max(r.offset + r.length for r in pieces) <= 2048


def test_awkward_rows_pass_every_stage(spark):
    """Null, empty, very long and repeated rows, and columns named like the operators' own."""
    start = docs_of(spark)
    docs = start.withColumn('n_bytes', F.lit(7)).withColumn('kept_sha256', F.lit('mine'))
    labels = f'{SF}'
    rows = docs
    for name, stage in P.STAGES[:-1]:
        rows = written(stage(spark, rows, labels), name)
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes, name
        assert all(r.n_bytes == 7 and r.kept_sha256 == 'mine' and r.n_removed == 'x' and r.ids == 'x' for r in rows.collect()), name
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    assert sum(t is None for _, t in texts) == 1 and (4, '') in texts and (5, ' \t\n\r\x0b\x0c ') in texts
    assert sum(i == 8 for i, _ in texts) == 0 and any(i == 1 for i, _ in texts)  # copies of the first text
    assert not any('hunter2hunter2' in (t or '') for _, t in texts)
    packed = P.STAGES[-1][1](spark, rows, labels)
    assert packed.select('doc_id').distinct().count() == rows.select('doc_id').distinct().count()
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, start.limit(0), labels).collect() == [], name
    assert P.STAGES[-1][1](spark, start.limit(0), labels).collect() == []


def test_run_equals_the_stages(spark, staged):
    cols = ['doc_id', 'start', 'length', 'ids_crc32', 'doc_tokens']
    a, b = (sum(r.length for r in d.select(cols).collect()) for d in (P.run(spark, SF), staged[-1]))
    assert a == b

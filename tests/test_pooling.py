"""Mean pooling against a plain loop; what it shuffles."""

from collections import defaultdict

import pytest

from logtriage.operators import encoding as N

VECTORS = [(0, [1.0, 2.0]), (1, [3.0, None, 5.0]), (2, [0.5]), (2, [1.5, 2.5]), (3, None), (4, []), (None, [9.0])]


def plain(tokens):
    total, n, some = defaultdict(float), defaultdict(int), set()
    for doc, token in tokens:
        for t, vector in VECTORS:
            if t is not None and t == token:
                for d, x in enumerate(vector or []):
                    n[doc, d] += 1
                    if x is not None:
                        total[doc, d] += x
                        some.add((doc, d))
    return {k: total[k] / n[k] if k in some else None for k in n}


@pytest.mark.parametrize('numbers', [1_000_000, 0])
@pytest.mark.parametrize('rows', [1024, 3])
def test_pooled_means_equal_a_plain_loop(spark, monkeypatch, numbers, rows):
    monkeypatch.setattr(N, 'BROADCAST_NUMBERS', numbers)
    monkeypatch.setattr(N, 'POOLED_ROWS', rows)
    tokens = [(d if d else None, t) for d in range(9) for t in [*range(d), d, d % 3, None, 77]] + [(20, 1), (21, 1), (21, 1), (22, 3), (23, 4)]
    t, v = spark.createDataFrame(tokens, 'doc_id long, token_id int'), spark.createDataFrame(VECTORS, 'token_id int, vector array<float>')
    out = N.mean_pool(t, v)
    got = {(r.doc_id, r.dim): r.value for r in out.collect()}
    want = plain(tokens)
    assert got.keys() == want.keys() and len(got) == out.count()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) if want[k] is not None else got[k] is None for k in want)
    assert N.mean_pool(t.limit(0), v).collect() == [] and N.mean_pool(t, v.limit(0)).collect() == []


def test_no_row_per_dimension_is_shuffled(spark):
    t, v = spark.createDataFrame([(1, 0), (2, 0)], 'doc_id long, token_id int'), spark.createDataFrame(VECTORS, 'token_id int, vector array<float>')
    plan = N.mean_pool(t, v)._jdf.queryExecution().executedPlan().toString()
    assert 'Generate' in plan and plan.index('Generate') < plan.index('Exchange')  # the root stands first

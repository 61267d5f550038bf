import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from logtriage.llm import ngram_join as J
from logtriage.llm.components import components

from .helpers import LOWER, WORD, awkward_texts, docs_of


def shingles(text, width):
    w = WORD.findall((text or '').translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return Counter((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def varied(seed, n):
    rng = random.Random(seed)
    bases = [[f'w{rng.randrange(5000)}' for _ in range(rng.choice([3, 6, 9, 30, 80, 200]))] for _ in range(12)]
    common = [f'c{i}' for i in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f'x{rng.randrange(50)}'
        if rng.random() < 0.4:
            w += common
        if rng.random() < 0.2:
            w = w[:rng.randrange(1, len(w) + 1)]
        rows.append((i, ' '.join(w)))
    return rows


@pytest.mark.parametrize('width, percent', [(4, 85), (5, 80)])
def test_awkward_rows(spark, width, percent):
    assert got(J.jaccard_classes(docs_of(spark), width, percent)) == brute(awkward_texts(), width, percent)


@pytest.mark.parametrize('seed', range(2))
def test_varied_near_copies(spark, seed):
    rows = varied(seed, 250)
    assert got(J.jaccard_classes(docs_of(spark, rows), 4, 85)) == brute(rows, 4, 85)


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(6, 120))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = rng.integers(0, max(1, int(len(x) * 0.16)) + 1)
        y = np.sort(rng.permutation(x)[drop:]) if drop else x
        extra = rng.integers(0, 3)
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * len(np.union1d(x, y)) or both == len(x) == len(y):
            continue
        found = {}
        for own, need, sig, cls in J.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 85):
            for o, t, s, c in zip(own.tolist(), need.tolist(), sig.tolist(), cls.tolist(), strict=True):
                found.setdefault((o, c), (t, set()))[1].add(s)
        # in some scheme they share as many lists as either needs, so one is kept by both
        assert any(len(found[0, c][1] & found[1, c][1]) >= max(found[0, c][0], found[1, c][0])
                   for c in {c for o, c in found if o == 0} & {c for o, c in found if o == 1})


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        q = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        sets = [np.unique(rng.choice(np.append(q, rng.integers(0, 60, 20).astype(np.uint64)), rng.integers(1, 50))) for _ in range(25)]
        want = [100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s)) for s in sets]
        assert J.divide_skip(q, sets, 80).tolist() == want


def test_keep_first(spark):
    rows = [(5, 'a b c d e f g h'), (3, 'a b c d e f g h'), (3, 'a b c d e f g h'), (9, 'other words here now'), (1, None), (2, ''), (2, ''), (None, 'a b c d e f g h')]
    out = J.keep_first(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, rows[0][1]), (9, rows[3][1]), (1, None), (2, ''), (2, '')])


def test_keep_first_null_and_reused_ids(spark):
    """Unlinked rows stay although they share a null id, or an id with a class of copies."""
    near = ' '.join(f'n{i}' for i in range(60))
    other = ' '.join(f'o{i}' for i in range(60))
    rows = [(None, 'first text that nobody copied at all'), (None, 'second one with other words in every place'),
            (4, 'a lone text under the reused id four'), (4, 'wholly different words stand here instead'),
            (7, near), (8, near + ' tail'), (7, other), (9, other + ' tail'), (None, near + ' end')]
    out = Counter((r.doc_id, r.text) for r in J.keep_first(docs_of(spark, rows)).collect())
    assert out == Counter([*rows[:5], rows[6]])
    assert got(J.jaccard_classes(docs_of(spark, rows))) == brute(rows, 5, 80)


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, 'a long, b long')).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_empty_table(spark):
    assert J.jaccard_classes(docs_of(spark, [])).collect() == []
    assert J.keep_first(docs_of(spark, [])).collect() == []


def test_rows_without_copies_do_not_pass_through_python(spark):
    rows = [(i, t) for i, t in awkward_texts() if t]
    kept = J.keep_first(docs_of(spark, rows), 5, 80)
    assert 'MapInArrow' not in kept._jdf.queryExecution().executedPlan().toString()
    bits = docs_of(spark, rows).select('doc_id', 'text').selectExpr('doc_id', 'xxhash64(text) th').withColumn('bit', J.bit_of('doc_id', 'th'))
    some = bits.filter('doc_id < 8')
    got = J.marked(bits, some).collect()
    want = {r.bit for r in some.collect()}
    assert len(got) == len(rows) and all(r._marked == (r.bit in want) for r in got)
    assert not any(r._marked for r in J.marked(bits, some.limit(0)).collect())

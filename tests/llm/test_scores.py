"""Quality network, toxicity grades, class-based scoring, quality rules."""

import math
import random
from collections import Counter

import numpy as np
import xxhash

from logtriage.llm import class_lm, quality_mil, quality_rules, toxicity
from pyspark.sql import functions as F

from .helpers import LOWER, WORD, awkward_texts, docs_of


def labels_of(spark, rows):
    return spark.createDataFrame(rows, 'doc_id long, quality int, toxic int')


def corpus(n, seed=0):
    """(id, text, good, toxic): junk repeats symbols; toxic texts hold words of a small list."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f'{rng.choice("bcdfgklm")}{rng.choice("aeiou")}{rng.choice("nrst")}{rng.choice(["", "en", "ing", "o"])}' for _ in range(rng.randrange(60, 200))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 12)):
                words[rng.randrange(len(words))] = rng.choice(['blorg', 'Snarf!', 'grumpf,', 'zzyx'])
        out.append((i, ' '.join(words if good else [w + '%%%' for w in words]), good, toxic))
    return out


# ---------------------------------------------------------------- quality network
def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    p = {n: rng.normal(0, 0.3, s) for n, s in quality_mil.SHAPES.items()}
    x, first, y = rng.normal(0, 1, (9, quality_mil.MEASURES + quality_mil.HASHED)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])

    def loss():
        o = quality_mil._forward(p, x, first)[-1]
        return -(y * np.log(o) + (1 - y) * np.log(1 - o)).mean()

    g = quality_mil._gradient(p, x, first, y)
    for n in p:
        i = tuple(rng.integers(0, k) for k in p[n].shape)
        p[n][i] += 1e-5
        up = loss()
        p[n][i] -= 2e-5
        down = loss()
        p[n][i] += 1e-5
        assert abs((up - down) / 2e-5 - g[n][i]) < 1e-6


def test_quality_on_held_out_rows(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], 'doc_id long, text string').repartition(3)
    model = quality_mil.fit(docs, labels_of(spark, [(i, int(g), 0) for i, _, g, _ in rows if i % 3]))
    score = {r.doc_id: r.score for r in quality_mil.score_texts(docs, model).collect()}
    assert sum((score[i] >= 0.5) == g for i, _, g, _ in rows if i % 3 == 0) >= 95


def test_quality_awkward_rows(spark):
    docs = docs_of(spark)
    for model in (None, {n: np.ones(s) * 0.01 for n, s in quality_mil.SHAPES.items()}):
        out = quality_mil.score_texts(docs, model).collect()
        assert len(out) == len(awkward_texts()) and all(0 <= r.score <= 1 for r in out)
    assert quality_mil.fit(docs, labels_of(spark, [(1, 1, 0), (2, None, 0), (None, 1, 1)])) is None
    assert quality_mil.score_texts(docs_of(spark, []), None).collect() == []


def test_passages_of_a_text_do_not_depend_on_its_neighbours():
    texts = [(t or '').encode() for _, t in awkward_texts()]
    data, off = np.frombuffer(b''.join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, first = quality_mil.passages(data, off)
    for i, t in enumerate(texts):
        alone, _ = quality_mil.passages(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.array_equal(alone, x[first[i]:first[i + 1]])


# ---------------------------------------------------------------- toxicity
def test_toxicity_grades(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], 'doc_id long, text string').repartition(3)
    model = toxicity.fit(docs, labels_of(spark, [(i, 1, int(x)) for i, _, _, x in rows if i % 3]))
    assert len(model['thresholds']) >= 2 and (np.diff(model['thresholds']) > 0).all()
    out = {r.doc_id: r for r in toxicity.grade_texts(docs, model).collect()}
    assert sum(out[i].toxic == x for i, _, _, x in rows if i % 3 == 0) >= 0.97 * 134
    level = {i: sum(w.strip('%!,').lower() in ('blorg', 'snarf', 'grumpf', 'zzyx') for w in t.split()) for i, t, *_ in rows}
    mild, severe = (np.mean([out[i].severity for i in level if lo <= level[i] < hi]) for lo, hi in ((1, 5), (8, 99)))
    assert 0.5 < mild < severe
    kept = toxicity.drop_toxic(docs, model)
    assert {r.doc_id for r in kept.collect()} == {i for i in out if not out[i].toxic}


def test_toxicity_awkward_rows(spark):
    docs = docs_of(spark)
    one = toxicity.fit(docs, labels_of(spark, [(1, 1, 1), (2, 1, None), (None, 0, 0)]))
    out = toxicity.grade_texts(docs, one).collect()
    assert len(out) == len(awkward_texts()) and not any(r.toxic for r in out)
    two = toxicity.fit(docs, labels_of(spark, [(1, 1, 1), (2, 1, 0), (3, 1, 0)]))
    assert len(toxicity.grade_texts(docs, two).collect()) == len(awkward_texts())
    kept = toxicity.drop_toxic(docs, one)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.grade_texts(docs_of(spark, []), two).collect() == []


# ---------------------------------------------------------------- class-based scoring
def tokens(text):
    return [*WORD.findall((text or '').translate(LOWER)), None]


def check_lm(rows, out, held):
    train = [tokens(t) for i, t in rows if not held(i)]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    base = Counter((i, len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == base
    assert all(r.score <= 1e-9 and r.perplexity >= 1 for r in out)


def test_lm_awkward_rows(spark):
    docs = docs_of(spark)
    out = class_lm.score_texts(docs, F.col('doc_id') % 7 == 2, top=50, classes=4).collect()
    check_lm(awkward_texts(), out, lambda i: i is not None and i % 7 == 2)
    assert class_lm.score_texts(docs_of(spark, []), F.lit(False)).collect() == []
    none = class_lm.score_texts(docs, F.lit(True)).collect()
    assert len(none) == len(awkward_texts()) and {r.train_tokens for r in none} == {0}


def test_lm_beats_the_base_on_ordered_text(spark):
    rng = random.Random(3)
    verbs, nouns = [f'v{i}' for i in range(30)], [f'n{i}' for i in range(30)]
    rows = [(i, ' '.join(rng.choice(nouns) + ' ' + rng.choice(verbs) for _ in range(30))) for i in range(200)]
    out = class_lm.score_texts(spark.createDataFrame(rows, 'doc_id long, text string'), F.col('doc_id') % 5 == 0, top=100, classes=4).collect()
    check_lm(rows, out, lambda i: i % 5 == 0)
    held = [r for r in out if r.held_out]
    # word order halves the choices: about a factor of two per word
    assert sum(r.score - r.base_score for r in held) > 0.2 * sum(r.n_tokens for r in held)


def test_exchange_separates_classes():
    rng = np.random.default_rng(0)
    big = np.zeros((21, 21))
    big[:10, 10:20] = rng.poisson(20, (10, 10))
    big[10:20, :10] = rng.poisson(20, (10, 10))
    cls = class_lm.exchange(big, 2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10]


def test_step_takes_the_class_of_best_likelihood():
    rng = np.random.default_rng(4)
    x = lambda a: np.where(a > 0, a * np.log(np.maximum(a, 1e-300)), 0).sum()
    k, size = 5, 40
    seen = rng.poisson(1.5, (size, 2 * k)) * rng.integers(0, 2, (size, 2 * k))
    big = rng.poisson(30, (k, k)).astype(float)
    big[k - 1] += seen[:, :k].sum(0)
    big[:, k - 1] += seen[:, k:].sum(0)
    w, j = np.nonzero(seen)
    got = class_lm.step_classes(w, j, seen[w, j], size, big)
    for i in range(size):
        r, l = seen[i, :k], seen[i, k:]
        best = []
        for c in range(k - 1):
            b = big.copy()
            b[k - 1] -= r
            b[:, k - 1] -= l
            b[c] += r
            b[:, c] += l
            row, col = big.sum(1), big.sum(0)
            row[[k - 1, c]] += -r.sum(), r.sum()
            col[[k - 1, c]] += -l.sum(), l.sum()
            best.append(x(b) - x(row) - x(col))
        assert best[got[i]] >= max(best) - 1e-9


def test_words_outside_the_top_are_classed_by_their_neighbours(spark):
    """The spelling of rare nouns and rare verbs tells nothing."""
    rng = random.Random(6)
    nouns, verbs = [f'n{i}' for i in range(10)], [f'v{i}' for i in range(10)]
    rare = rng.sample([f'x{i}' for i in range(100, 340)], 240)
    rare_nouns, rare_verbs = rare[:120], rare[120:]
    pick = lambda often, rare: rng.choice(rare if rng.random() < 0.5 else often)
    rows = [(i, ' '.join(pick(nouns, rare_nouns) + ' ' + pick(verbs, rare_verbs) for _ in range(40))) for i in range(250)]
    out = class_lm.score_texts(spark.createDataFrame(rows, 'doc_id long, text string'), F.col('doc_id') % 5 == 0, top=21, classes=2).collect()
    check_lm(rows, out, lambda i: i % 5 == 0)
    held = [r for r in out if r.held_out]
    # the order of nouns and verbs, rare ones too, is worth a factor of two per word
    assert sum(r.score - r.base_score for r in held) > 0.25 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 9, (10, 10)).astype(float)
    table[:, 9] = 0
    step, known, gap = class_lm.smoothed(table, np.arange(10.0), 4)
    assert np.allclose((10 ** step).sum(1), 1)
    n = table.sum(0)
    assert np.allclose((n * 10 ** known + 10 ** gap)[n > 0], 1)


# ---------------------------------------------------------------- quality rules
def brute_rules(text):
    w = WORD.findall(text or '')
    lines = [x for x in (text or '').split('\n') if WORD.search(x)]
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in '#*$%&|<>' for c in text or ''), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def brute_ratios(rows, targets, buckets):
    """The mean log ratio of each text, with the same hash."""
    def cell(*words):
        seed = 42
        for x in words:
            seed = xxhash.xxh64(x.encode(), seed=seed).intdigest()
        signed = seed - (1 << 64) if seed >> 63 else seed
        return signed % buckets

    grams = [[cell(a) for a in w] + [cell(a, b) for a, b in zip(w, w[1:], strict=False)] for w in (WORD.findall(t or '') for _, t in rows)]
    raw, target = Counter(c for g in grams for c in g), Counter(c for (i, _), g in zip(rows, grams, strict=True) if i in targets for c in g)
    n, m = sum(raw.values()), sum(target.values())
    lr = {c: round((math.log((target[c] + 1) / (m + buckets)) - math.log((raw[c] + 1) / (n + buckets))) * 1e6) if m else 0 for c in raw}
    return [round(sum(lr[c] for c in g) / len(g) / 1e6, 6) if g else None for g in grams]


def test_rules_awkward_rows(spark):
    rows = [*awkward_texts(), (70, 'a b c a b c d\nx\nx\n\nx y'), (71, 'same line here\n' * 30)]
    labels = labels_of(spark, [(1, 1, 0), (10, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)])
    k = quality_rules.keyed(docs_of(spark, rows))
    tables = [sorted(quality_rules.ratio_table(k, quality_rules.target_ids(labels), 512, n).collect()) for n in (0, 10**6)]
    assert tables[0] == tables[1] and tables[0]  # joined by shuffling, and broadcast
    out = quality_rules.judge(docs_of(spark, rows), labels, buckets=512).collect()
    want = Counter((i, *brute_rules(t), x) for (i, t), x in zip(rows, brute_ratios(rows, {1, 10}, 512), strict=True))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.llr) for r in out) == want
    assert all(r.kept == (not r.base_failed and r.llr is not None and r.llr >= quality_rules.THRESHOLD) for r in out)
    assert quality_rules.judge(docs_of(spark, []), labels).collect() == []


def test_rules_drop_junk(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], 'doc_id long, text string')
    out = {r.doc_id: r for r in quality_rules.judge(docs, labels_of(spark, [(i, int(g), 0) for i, _, g, _ in rows if i % 2]), buckets=4096).collect()}
    assert all(out[i].kept == g for i, _, g, _ in rows)
    # a filter on the result must not change or repeat the work
    assert quality_rules.judge(docs, labels_of(spark, [(1, 1, 0)])).filter('n_words > 1000').collect() == []

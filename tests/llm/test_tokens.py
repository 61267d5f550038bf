"""Byte-level BPE (round trips, against the reference tokenizer library) and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from logtriage.llm import bpe, packing, queries

from .helpers import awkward_texts, docs_of

RULES = public_tokenizers.path('byte_bpe_multi_50k.tiktoken'), public_tokenizers.PATTERN
WORDS = public_tokenizers.path('word_bpe_49k.json')


@pytest.fixture(scope='module')
def own():
    return bpe.encoder(*RULES)


@pytest.fixture(scope='module')
def reference(own):
    return tiktoken.Encoding('own', pat_str=RULES[1], mergeable_ranks=own.vocabulary.ranks, special_tokens={})


def test_random_texts_edits_and_appends(own, reference):
    rng = random.Random(4)
    parts = ['the', 'ing', '  ', ' ', '\n', 'é', 'ñ', '123', '%%%', '的', 'x', 'q', '\t', "'s", 'ß', ' ', '🙂', 'aaaa', '\r\n', ' \n ']
    v = own.vocabulary
    for _ in range(600):
        s = ''.join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = np.frombuffer(own.encode(s), np.int32)
        assert ids.tolist() == reference.encode_ordinary(s)
        assert own.decode(ids).tobytes() == s.encode()
        b = s.encode()
        x = bpe.PrefixEncoding(v, b[:len(b) // 2])
        x.append(b[len(b) // 2:])
        assert x.ids() == v.merged(b)
        i = rng.randint(0, len(b))
        j = rng.randint(i, len(b))
        new = rng.choice(parts).encode()
        x.replace(i, j, new)
        assert x.data == b[:i] + new + b[j:] and x.ids() == v.merged(x.data)


def test_edit_recomputes_only_near_it(own):
    data = ('some plain words and more of them ' * 300).encode()
    x = bpe.PrefixEncoding(own.vocabulary, data)
    assert x.replace(5000, 5004, b'zing') < 300
    assert x.ids() == bpe.PrefixEncoding(own.vocabulary, x.data).ids()


def test_encode_decode_rows(spark, reference):
    docs = docs_of(spark)
    out = bpe.decode_ids(bpe.encode_texts(docs, *RULES), *RULES).collect()
    assert len(out) == len(awkward_texts())
    for r in out:
        assert r.ids == reference.encode_ordinary(r.text or '')
        assert bytes(r.decoded) == (r.text or '').encode()
    assert bpe.decode_ids(bpe.encode_texts(docs_of(spark, []), *RULES), *RULES).collect() == []


def check(rows, texts, limits):
    t = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for d, x in texts:
        want[d].append(np.array([*t.encode(x or '', add_special_tokens=False).ids, 1], np.uint32))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, whole in want.items():
        # rows of one id may interleave: every text's ranges must be there, each once
        assert sum(r.length for r in pieces[d]) == sum(map(len, whole))
        for r in pieces[d]:
            assert any(len(w) == r.doc_tokens and zlib.crc32(w[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for w in whole)
        if len(whole) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for own in sequences.values():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.offset)):
            assert (r.offset, r.segment) == (at, k)
            at += r.length
        assert at <= limits[0] and len(own) <= limits[1] and sum(r.loss_tokens for r in own) <= limits[2]
    return sequences


def test_pack_awkward_rows(spark):
    rows = packing.pack_texts(docs_of(spark), WORDS, with_ids=True).collect()
    sequences = check(rows, awkward_texts(), (2048, 64, 2048))
    assert all(zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32 for r in rows)
    assert all(n & (n - 1) == 0 for n in (sum(r.length for r in s) for s in sequences.values()))
    assert packing.pack_texts(docs_of(spark, []), WORDS).collect() == []


@pytest.mark.parametrize('limits', [(64, 3, 64), (64, 64, 20), (32, 2, 9)])
def test_pack_under_three_limits(spark, limits):
    rng = random.Random(2)
    texts = [(i, ' '.join(f'w{rng.randrange(99)}' for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, rng.randrange(30)) for i, t in texts], 'doc_id long, text string, lead int').coalesce(2)
    rows = packing.pack_texts(docs, WORDS, capacity=limits[0], segments=limits[1], loss=limits[2], prompt='lead', waiting=32).collect()
    check(rows, texts, limits)


def test_words_equal_the_unmodified_tokenizer(tmp_path):
    rng = random.Random(7)
    t, w = Tokenizer.from_file(WORDS), packing.tokenizer(WORDS)
    parts = ['The', 'word', 'WORD.', 'l’eau', "don't", "dogs'", 'a$$$', 'x,,', 'Straße!!', 'é', 'e\u0301', 'İstanbul', 'क़', 'ΟΔΟΣ.', '<|startoftext|>', '<|endoftext|>x', '<|endof', '123', '4a', '_b_', '🙂', '的',
             '\t', '\n\n', '\u00a0', '\u2028', '...', "'s", 'ﬁ', '']
    texts = [rng.choice([' ', '', ' ']).join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for lo in range(0, len(texts), 100):
        for text, raw in zip(texts[lo:lo + 100], w.encode(texts[lo:lo + 100]), strict=True):
            assert np.frombuffer(raw, np.int32).tolist() == t.encode(text, add_special_tokens=False).ids, text
    other = public_tokenizers.path('byte_bpe_50k.json')  # parts words otherwise: texts are encoded whole
    o = Tokenizer.from_file(other)
    assert not packing.tokenizer(other).by_word
    assert np.frombuffer(packing.tokenizer(other).encode(['two  words'])[0], np.int32).tolist() == o.encode('two  words', add_special_tokens=False).ids


def plain_fill(pool, limits):
    """The dot-product choice by the definition, over (tokens, free) of the waiting pieces."""
    left, out = list(limits), []
    pool = list(pool)
    while pool and left[0] and left[1]:
        need = [(n, 1, max(0, n - free)) for n, free in pool]
        best, top = None, -1.0
        for i, d in enumerate(need):
            if all(a <= b for a, b in zip(d, left, strict=True)) and (left[1] > 1 or d[0] == left[0]):
                dot = sum(a * b / c ** 2 for a, b, c in zip(d, left, limits, strict=True))
                if dot > top + 1e-12:
                    best, top = i, dot
        if best is None:
            room = [min(n, left[0], free + left[2]) for n, free in pool]
            best = room.index(max(room))
            if not room[best]:
                break
            used = (room[best], 1, max(0, room[best] - pool[best][1]))
        else:
            used = need[best]
        n, free = pool[best]
        last = pool.pop()
        if best < len(pool):
            pool[best] = last
        if used[0] < n:
            pool.append((n - used[0], max(0, free - used[0])))
        out.append(used)
        left = [a - b for a, b in zip(left, used, strict=True)]
    return out


def test_choice_is_the_largest_dot_product():
    rng = random.Random(3)
    for _ in range(300):
        limits = (rng.randrange(20, 80), rng.randrange(1, 6), rng.randrange(10, 60))
        packer = packing.Packer(limits, 64, 0)
        for k in range(rng.randrange(1, 40)):
            n = rng.randrange(1, 30)
            packer._add(packing.Piece(k, 0, np.arange(n, dtype=np.int32), n, rng.randrange(n + 1)))
        want = plain_fill([(len(p.ids), p.free()) for p in packer.pool], limits)
        assert [p.demand() for p in packer._fill(np.array(limits))] == want


def test_loss_limit_binds_on_the_documents(spark):
    """op2_packing: sequences of answers alone stop at the loss limit, and little is padded."""
    rows = queries.op2_packing(spark, '/root/testdata/sf0.1').collect()
    tokens, loss = defaultdict(int), defaultdict(int)
    for r in rows:
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
    limit = packing.INSTRUCTION['loss']
    assert max(loss.values()) == limit < 2048 and sum(v == limit for v in loss.values()) > 100
    padding = sum(2048 - n for n in tokens.values() if n & (n - 1))
    assert padding < 0.01 * sum(tokens.values())


def test_tasks_repeat_alike(spark):
    docs = docs_of(spark).coalesce(2)
    a, b = (sorted(map(str, packing.pack_texts(docs, WORDS).collect())) for _ in range(2))
    assert a == b


def test_halves_of_a_word_are_looked_up_once():
    w = packing.Words(public_tokenizers.path('word_bpe_49k.json'))
    texts = ['Stone, stone. STONE! stone stone?! (stone) sto-ne', 'été, Été. 12, a1. ... é!', '', 'stone,\n stone.  ?!']
    seen = []
    learn = w._learn_words
    w._learn_words = lambda some: (seen.append(set(some)), learn(some))
    got = w.encode(texts)
    assert seen[0] == {'stone'}  # in any case, with any marks behind it
    assert [x.tolist() for x in got] == [w.whole(t).tolist() for t in texts]
    assert [x.tolist() for x in w.encode(texts)] == [x.tolist() for x in got]

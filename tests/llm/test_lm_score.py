import math
import random

import numpy as np
import pytest

from strandflow.llm import lm_score as L

DOCS = "doc_id long, text string, n_tokens long"


def corpus(rng, n):
    """Sentences in which each word tells its neighbours."""
    follow = {"a": "b", "b": "c", "c": "d", "d": "a"}
    for _ in range(n):
        w, words = rng.choice("abcd"), []
        for _ in range(rng.randrange(20, 60)):
            words.append(w if rng.random() < 0.95 else rng.choice("abcdxyz"))
            w = follow[w]
        yield " ".join(words)


def test_gradient():
    rng = np.random.default_rng(0)
    net = L.Network()
    net.__init__(net.flat + rng.normal(0, 0.3, net.flat.shape))
    context, target = rng.integers(0, L.PAD + 1, (4, 50)), rng.integers(0, L.CLASSES, 50)
    g = net.gradient(context, target)
    loss = lambda flat: -float(np.mean(L.Network(flat).log_probs(context, target).astype(np.float64)))
    for i in [*np.argsort(-np.abs(g))[:12], *rng.integers(0, len(g), 5)]:
        step = np.zeros(len(g), np.float32)
        step[i] = 0.05
        assert (loss(net.flat + step) - loss(net.flat - step)) / 0.1 == pytest.approx(g[i], abs=2e-3)


def test_probabilities_sum_to_one():
    net = L.Network()
    context = np.full((4, L.CLASSES), 3)
    assert np.exp(net.log_probs(context, np.arange(L.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_scores_against_brute_force_and_held_out(spark):
    rng = random.Random(1)
    texts = list(corpus(rng, 6000))
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:200]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    known = L.lexicon(L.count_words(docs))
    net = L.train(docs, known)
    coder = L.Coder(known)
    held = list(corpus(rng, 200))
    sizes, sums, _, _ = L.score_batch(net, coder, held)
    # a slow loop, a word at a time
    for text, size, got in list(zip(held, sizes, sums, strict=True))[:20]:
        codes = list(zip(*known.codes(text.encode().split())[:2], strict=True))
        padded = [L.PAD] * 2 + [c for c, _ in codes] + [L.PAD] * 2
        want = 0.0
        for i, (c, share) in enumerate(codes):
            table, bias, out, last = net.parts
            h = np.tanh(sum(table[k][padded[i + 2 + o]] for k, o in enumerate(L.OFFSETS)) + bias)
            z = h @ out + last
            want += share + float(z[c] - np.log(np.exp(z).sum()))
        assert got == pytest.approx(want, abs=1e-2) and size == len(codes)
    # held-out texts score above shuffled ones and above word counts alone
    _, mixed, _, _ = L.score_batch(net, L.Coder(known), shuffled)
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    unigram = sum(math.log(counts[w] / total) for t in held for w in t.split()) / sum(sizes)
    model = sum(sums) / sum(sizes)
    assert model > unigram + 0.5
    assert model > sum(mixed) / sum(len(t.split()) for t in shuffled) + 0.5


def test_every_word_is_a_target(spark):
    for n in range(1, 5):
        docs = spark.createDataFrame([(0, "a b c d"[: 2 * n - 1], 0)], DOCS).coalesce(1)
        known = L.lexicon(L.count_words(docs))
        net, want, coder = L.train(docs, known), L.Network(class_shares=known.class_shares), L.Coder(known)
        padded, _, places, _, _ = coder.batch(["a b c d"[: 2 * n - 1]])
        want.train(L.context_of(padded, places), padded[places])  # one step on all n words
        assert np.allclose(net.flat, want.flat, atol=1e-6)


def test_counts_cover_the_corpus(spark):
    texts = ["b a a", None, "", "A  a\nc\x1cd", "x" * 100000]
    out = {r.h: r.n for r in L.count_words(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS)).collect()}
    assert out == {L.word_hash(w): n for w, n in ((b"a", 4), (b"b", 1), (b"c\x1cd", 1), (b"x" * 100000, 1))}


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "one", 9), (3, "one", 9), (None, "one", 9), (4, "very long " * 100000, 9)]
    out = L.score(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_tokens, r.log_likelihood, r.per_token))
    assert by[1] == by[2] == [(0, 0.0, None)]
    assert len(by[3]) == 2 and len({*by[3], *by[None]}) == 1 and by[4][0][0] == 200000
    assert L.score(spark.createDataFrame([], DOCS)).count() == 0


def test_no_word_loses_its_count(spark, monkeypatch):
    """With few counts in the tasks and the rest joined, scores are as with all: the words' shares are exact, and sum to one."""
    rng = random.Random(3)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice((5, 60, 300))]) for _ in range(rng.randrange(0, 50))) for _ in range(120)]
    texts += texts[:20] + [None, ""]
    rows = [(i if i % 7 else None, t, 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(L, "VOCABULARY", 40)
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    counts = {}
    for t in texts:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    table = L.count_words(docs)
    known = L.lexicon(table)
    assert len(known.hashes) == 40
    top = {L.word_hash(w.encode()) for w, _ in sorted(counts.items(), key=lambda x: (-x[1], L.word_hash(x[0].encode())))[:40]}
    assert {*known.hashes.tolist()} == top
    net = L.train(docs, known)
    words = sorted(counts)
    classes, shares, _, rare = known.codes([w.encode() for w in words])
    shares = shares + np.where(rare, np.log([counts[w] for w in words]), 0)
    context = np.full((4, len(words)), L.PAD)
    assert np.exp(net.log_probs(context, classes) + shares).sum() == pytest.approx(1 - np.exp(net.log_probs(np.full((4, L.CLASSES), L.PAD), np.arange(L.CLASSES)))[[c for c in range(L.CLASSES) if c not in classes]].sum(), abs=1e-3)
    share = dict(zip(words, zip(classes, shares, strict=True), strict=True))
    want = []
    for i, t, _ in rows:
        found = [share[w] for w in (t or "").split()]
        padded = np.array([L.PAD] * 2 + [c for c, _ in found] + [L.PAD] * 2)
        total = 0.0
        for k, (c, s) in enumerate(found):
            at = np.array([k + 2])
            total += s + float(net.log_probs(L.context_of(padded, at), np.array([c]))[0])
        want.append((i, len(found), round(total, 1)))
    got = [(r.doc_id, r.n_tokens, round(r.log_likelihood, 1)) for r in L.score(docs).collect()]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.25


def test_weights_are_summed_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(L, "GATHERED", 2)
    docs = spark.createDataFrame([(i, f"a b c{i}", 0) for i in range(40)], DOCS).repartition(9)
    known = L.lexicon(L.count_words(docs))
    net = L.train(docs, known)
    monkeypatch.setattr(L, "GATHERED", 64)
    assert np.allclose(net.flat, L.train(docs, known).flat, atol=1e-6)


def test_texts_are_coded_once(spark):
    """What is written beside the networks is enough to score the texts."""
    texts = ["b a a", None, "", "A  a\nc\x1cd", "b " * 3000 + "a"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS).coalesce(1)
    known = L.lexicon(L.count_words(docs))
    rows = L.trained(docs, known).collect()
    assert [r.doc_id for r in rows] == [0, 1, 2, 3, 4, None] and [r.total is None for r in rows] == [True] * 5 + [False]
    net = L.train(docs, known)
    want_sizes, want, _, _ = L.score_batch(net, L.Coder(known), texts)
    sizes, sums = L.score_coded(net, [r.classes for r in rows[:5]])
    assert sizes == want_sizes == [3, 0, 0, 3, 3001]
    assert sums + [r.shares for r in rows[:5]] == pytest.approx(want, abs=1e-6)

import random

import numpy as np
import xxhash

from strandflow.llm import graph, simhash

DOCS = "doc_id long, text string, fp long, key string"


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def check(rows, out):
    prints = {t: brute_print(t) for _, t, *_ in rows}
    roots = brute_classes(list(prints.values()))
    least = {}
    for i, t, *_ in rows:
        r = roots[prints[t]]
        least[r] = min([x for x in (i, least.get(r)) if x is not None], default=None)
    want = sorted(((i, f"{prints[t]:016x}", least[roots[prints[t]]]) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want


def near_copies(rng, n, words):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "One two", "one  TWO", "One two three four", "É one two three four\x1cfive"]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [*near_copies(rng, 120, 300), *near_copies(rng, 40, 60), "long " * 100000]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)] + [(None, texts[9], 0, "")] * 2 + [(None, "unnamed text of its own", 0, "")]
    rows += [(5, texts[5], 0, "")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    check(rows, simhash.near_duplicates(docs).collect())


def test_large_groups_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "PIECE", 16)
    rng = random.Random(5)
    rows = [(i, t, 0, "") for i, t in enumerate(near_copies(rng, 200, 120))]
    check(rows, simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())


def test_crowded_keys_meet_in_between(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "PIECE", 4)
    monkeypatch.setattr(simhash, "PIECES", 2)
    rng = random.Random(15)
    rows = [(i, t, 0, "") for i, t in enumerate([*near_copies(rng, 60, 150), *near_copies(rng, 20, 40)])]
    check(rows, simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())


def test_one_of_each(spark):
    rng = random.Random(6)
    texts = [*near_copies(rng, 30, 200), "alone one two three four five", None]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)] + [(0, texts[0], 1, "k")] * 2 + [(None, "no id at all here", 1, "k")] * 2
    docs = spark.createDataFrame(rows, DOCS)
    classes = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(classes) and set(ids) == classes


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_every_close_pair_shares_a_key(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows.append((i, *np.array([a, b], dtype=np.uint64).view(np.int64).tolist()))
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame(rows, "i long, a long, b long")
    for cuts, keys in zip(simhash.CUTS, (15, 35, 70), strict=True):
        blocks = simhash.blocks_of(cuts)
        assert sum(n for _, n in blocks) == 64 and blocks[-1][0] == 0
        a, b = (simhash.block_keys(F.col(c), cuts) for c in "ab")
        assert pairs.where(F.arrays_overlap(a, b)).count() == 200
        assert pairs.select(F.size(F.array_distinct(a)).alias("n")).distinct().collect() == [(keys,)]
    assert [simhash.cuts_for(n) for n in (0, 10**6, 10**8, 10**11)] == [6, 6, 7, 8]


def test_more_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(25)
    rows = [(i, t, 0, "") for i, t in enumerate([*near_copies(rng, 80, 200), *near_copies(rng, 30, 50)])]
    for cuts in simhash.CUTS[1:]:
        monkeypatch.setattr(simhash, "cuts_for", lambda n, cuts=cuts: cuts)
        check(rows, simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(-5, 500)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    root = {x: x for e in chain for x in e}
    for _ in range(200):
        for a, b in chain:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in chain if a == b} - {x for a, b in chain if a != b for x in (a, b)}
    assert out == {k: v for k, v in root.items() if k not in alone}

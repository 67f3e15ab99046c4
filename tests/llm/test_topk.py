import math
import random

import numpy as np
import pytest

from strandflow.llm import topk

ROWS = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=5, single=True):
    as_read = (lambda x: float(np.float32(x))) if single else float
    good = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(as_read(x)) * 256 if abs(x) > 2**43 else math.floor(256 * as_read(x)) for x in v]))
    out = []
    for r, (q, w) in enumerate(good):
        if q is not None and q % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(w, v, strict=True)), i is None, i) for c, (i, v) in enumerate(good) if c != r and len(v) == len(w)]
            scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
            out += [(q, place + 1, i, -s) for place, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "dim", "seed"), [(300, 8, 1), (700, 3, 2), (4, 5, 3), (1, 2, 4)])
def test_brute_force(spark, monkeypatch, n, dim, seed):
    monkeypatch.setattr(topk, "BLOCK", 100)  # several blocks on both sides
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = random.Random(seed)
    common = [rng.gauss(0, 1) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = common if rng.random() < 0.3 else [rng.gauss(0, 1) for _ in range(dim)]
        rows.append((i, v, 0, "clash"))
    rows += [(5000, None, 0, ""), (5050, [None] * dim, 0, ""), (5100, [float("nan")] * dim, 0, ""), (5150, [float("inf")] * dim, 0, ""), (None, common, 0, "")]
    assert collected(topk.top_k(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.5], 0, ""), (0, [0.5, 1.0], 0, ""), (1, [1.0, 1.0], 0, "")]
    got = collected(topk.top_k(spark.createDataFrame(rows, ROWS)))
    assert len(got) == 4
    assert got == brute(rows)


def block(n, dim, seed, spread=60):
    rng = np.random.default_rng(seed)
    vectors = np.floor(rng.normal(size=(n, dim)) * spread)
    return rng, vectors


def check(vectors, rows, queries, query_rows, rank, k=5):
    found, reader = topk.search_block(rows, vectors, query_rows, queries, rank, k)
    for j, w in enumerate(queries):
        scored = sorted((-int(v @ w), int(rank[i]), i) for i, v in enumerate(vectors) if rows[i] != query_rows[j])[:k]
        got = sorted((-s, int(rank[i]), i) for q, i, s, _ in found if q == j)
        assert got == scored
    return found, reader


def test_block_against_brute_force():
    rng, vectors = block(500, 16, 0)
    vectors[100:300] = vectors[7]  # ties beyond any depth
    rank = rng.permutation(500)
    queries = np.floor(rng.normal(size=(40, 16)) * 60)
    queries[:5] = vectors[5:10]
    queries[6] = 0
    check(vectors, np.arange(500), queries, np.concatenate([np.arange(5, 10), np.arange(1000, 1035)]), rank)


def test_only_what_was_read_counts():
    """Lists are read once, from both ends, and reading stops before theirs; a vector that wasn't met adds nothing."""
    rng, vectors = block(2000, 6, 3)
    vectors[:10] += 400  # a few stand out
    queries = np.ones((4, 6))
    found, reader = check(vectors, np.arange(2000), queries, np.arange(5000, 5004), np.arange(2000))
    assert reader.depth == 1000 and reader.entries == 2 * 6 * reader.depth  # the first round was enough
    assert {d for *_, d in found} == {0.5}
    unread = ~reader.met
    assert unread.any() and not reader.seen[unread].any()
    fresh = topk.Reader(vectors)
    fresh.read_to(10)
    assert fresh.met.sum() == fresh.entries == 2 * 6 * 10
    assert set(np.flatnonzero(fresh.met[:, 0])) == set(np.argsort(vectors[:, 0], kind="stable")[-10:])


def test_bounds_hold_at_every_depth():
    rng, vectors = block(300, 5, 4)
    queries = np.floor(rng.normal(size=(7, 5)) * 60)
    reader = topk.Reader(vectors)
    scores = vectors @ queries.T
    for depth in (1, 50, 151, 299, 300):
        reader.read_to(depth)
        lower, upper = reader.bounds(slice(None), *reader.weights(queries))
        assert (lower <= scores).all() and (scores <= upper).all()
    assert (lower == upper).all()


def test_depths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0, "") for i in range(500)]
    got = topk.depths(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 10 and all(0.5 <= r.depth <= 1 for r in got)
    assert min(r.depth for r in got) < 1


def test_large_components_are_exact(spark):
    rows = [(0, [1e7, 1.5], 0, ""), (1, [1e7, 1.5], 0, ""), (2, [1e7, 1.496], 0, ""), (50, [9e6, -1.0], 0, "")]
    kind = "vec_id long, embedding array<double>, label int, score string"
    got = collected(topk.top_k(spark.createDataFrame(rows, kind)))
    assert got == brute(rows, single=False)
    assert any(abs(s) > 2**53 for *_, s in got)
    assert topk.quantised(np.array([[2.0**60, 0.3, -0.3]])).tolist() == [[2**68, 76, -77]]
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1e20], 0, ""), (1, [1e20], 0, "")], kind)).collect()


def test_ragged_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0, ""), (1, [1.0], 0, ""), (2, [0.5, 0.5], 0, ""), (50, [], 0, ""), (51, [], 0, "")]
    assert collected(topk.top_k(spark.createDataFrame(rows, ROWS))) == brute(rows)
    assert topk.top_k(spark.createDataFrame([], ROWS)).count() == 0

import random
from collections import defaultdict

import pytest

from strandflow.llm import mixing

DOCS = "doc_id long, source string, text string, size long, target string"


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return goal
        unit = left / sum(weight[s] for s in rest)
        over = [s for s in rest if unit * weight[s] >= 2 * sizes[s]]
        goal |= {s: unit * weight[s] for s in rest}
        if not over:
            return goal
        for s in over:
            goal[s] = 2.0 * sizes[s]
            capped.add(s)
            left -= goal[s]


def run(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    return mixing.mix(mixing.sized(docs)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()


def rows_of(sizes):
    return [(i, s, "w " * n if n is not None else None, 7, "clash") for i, (s, n) in enumerate(sizes)]


def check(out, rows):
    sizes = defaultdict(int)
    for _, s, text, *_ in rows:
        sizes[s] += len((text or "").split())
    goals = brute_targets(sizes)
    taken, n = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        n[r.source] += 1
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= n[s] if n[s] < 3 else abs(taken[s] - goal) <= 2


def test_random_sources(spark):
    rng = random.Random(4)
    rows = rows_of([(rng.choice(["a", "b", "é", "zz", None, "hot", "hot", "hot"]), rng.randrange(0, 60)) for _ in range(600)])
    out = run(spark, rows)
    assert len(out) == len(rows)
    check(out, rows)
    again = run(spark, rows[::-1])
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_small_sources_and_long_texts(spark):
    check(run(spark, rows := rows_of([("a", 1), ("b", 100000), ("c", 0), ("d", None), (None, 3)])), rows)


def test_equal_ids(spark):
    rows = [(1, "a", "w w w", 0, "")] * 50 + [(None, "b", "w " * 9, 0, "")] * 50
    out = run(spark, rows)
    assert len({(r.source, r.taken) for r in out}) == 2  # rows with equal ids are taken alike
    for r in out:
        assert abs(50 * r.taken - r.target) <= 50


def test_null_ids_of_different_texts_have_hashes_of_their_own(spark):
    rows = [(None, "a", f"x{i}", 0, "") for i in range(900)] + [(1, "b", f"y{i} z", 0, "") for i in range(300)]
    out = run(spark, rows)
    check(out, rows)
    docs = spark.createDataFrame(rows, DOCS)
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns
    by = {r.source: r.n for r in taken.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    goals = {r.source: r.target for r in out}
    assert abs(by["a"] - goals["a"]) <= 1 and abs(2 * by["b"] - goals["b"]) <= 2
    assert {r.text for r in taken.collect()} <= {r[2] for r in rows}


def test_mixed_drops_what_has_no_words(spark):
    docs = spark.createDataFrame([(1, "a", None, 3), (2, "a", " ", 3), (3, None, "x y", 3)], "doc_id long, source string, text string, `n.x` int")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(3, None, "x y", 3)}
    assert mixing.mixed(docs.where("false")).count() == 0


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, rows_of([("a", 0)]))[0].taken == 0

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.functions import scalars
from strandflow.operators import cost, layout, lookup, models


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_range_coder_round_trip(data):
    assert models.decode_bytes(models.code_bytes(data), len(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 65535)), max_size=600))
def test_range_coder_bits(bits):
    coder = models.RangeCoder()
    for b, p in bits:
        coder.encode(b, p)
    decoder = models.RangeDecoder(coder.finish())
    assert [decoder.decode(p) for _, p in bits] == [b for b, _ in bits]


def test_range_coder_meets_the_entropy():
    rng = random.Random(1)
    bits = [int(rng.random() < 0.05) for _ in range(20000)]
    coder, model, want = models.RangeCoder(), models.AdaptiveBit(), 0.0
    for b in bits:
        want -= math.log2(model.p if b else 1 - model.p)
        coder.encode(b, models.fixed(model.p))
        model.update(b)
    assert abs(8 * len(coder.finish()) - want) < 0.01 * want + 64


def test_adaptive_bit_is_the_closed_form():
    rng, m, ones = random.Random(2), models.AdaptiveBit(), 0
    for n in range(121):
        assert abs(m.p - (1 + ones) / (n + 2)) < 1e-9
        b = rng.randrange(2)
        m.update(b)
        ones += b


def test_mixture_beats_its_parts_where_neither_is_enough():
    rng = random.Random(3)
    bits, history = [], 0
    for k in range(6000):
        p = (0.9 if history & 1 else 0.1) if k < 3000 else 0.15
        b = int(rng.random() < p)
        history = b
        bits.append(b)
    zero, two, mixed, refined = models.mixed_costs(np.array(bits))
    assert mixed < min(zero, two) * 1.02 and refined < mixed * 1.05


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"abcd", b"xyz", b"q", b"abcdabcd"]), max_size=200))
def test_lz(parts):
    data = b"".join(parts)
    tokens = models.lz_parse(data)
    assert models.lz_restore(data, tokens) == data
    at = 0
    for place, size, back in tokens:  # against a search from every earlier place
        assert place == at
        prev = data.rfind(data[at : at + 4], 0, at + 3) if len(data) - at >= 4 else -1
        want = 0
        if prev >= 0:
            while want < 259 and at + want < len(data) and data[prev + want] == data[at + want]:
                want += 1
        assert (size, back) == ((want, at - prev) if want else (1, 0))
        at += size
    assert at == len(data)


def test_predictors_learn():
    t = np.arange(3000)
    x = np.sin(t / 7) * 50 + np.random.default_rng(0).normal(0, 1, len(t))
    plain = np.abs(x).mean()
    assert np.abs(models.lms_residuals(x)[500:]).mean() < plain / 4
    assert np.abs(models.rls_residuals(x)[500:]).mean() < plain / 10


def test_scalars(spark):
    xs = [-9, -8, -1, 0, 1, 7, 8, 255, 256, (1 << 40) + 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    x = F.col("x")
    rows = df.select("x", scalars.floor_div(x, 8).alias("d"), scalars.fold(x).alias("f"), scalars.unfold(scalars.fold(x)).alias("u"), scalars.ilog(x).alias("b"), scalars.isqrt(F.abs(x)).alias("r")).collect()
    for r in rows:
        assert r.d == r.x // 8 and r.u == r.x and r.r == math.isqrt(abs(r.x))
        assert r.f == (2 * r.x if r.x >= 0 else -2 * r.x - 1)
        if r.x >= 0:
            assert r.b == r.x.bit_length()
    b = spark.createDataFrame([(bytes([1, 2, 255, 4, 5, 6, 7, 255]),)], "b binary").select(
        scalars.uint_le(F.col("b"), 0, 4).alias("le"), scalars.uint_be(F.col("b"), 0, 4).alias("be"), scalars.uint_le(F.col("b"), 0, 8).alias("q"), scalars.uint_le(F.col("b"), 6, 4).alias("none")
    ).first()
    assert (b.le, b.be, int(b.q), b.none) == (0x04FF0201, 0x0102FF04, 0xFF07060504FF0201, None)
    pairs = [(m, a) for m in (-3, 0, 3) for a in (-2, 0, 2)]
    left, right = scalars.uncouple(F.col("m"), F.col("a"))
    out = spark.createDataFrame(pairs, "m int, a int").select("m", "a", left.alias("l"), right.alias("r")).collect()
    assert {(r.m, r.a): (r.l, r.r) for r in out}[(3, 2)] == (3, 1) and {(r.m, r.a): (r.l, r.r) for r in out}[(-3, 2)] == (-3, -1)
    sizes = spark.createDataFrame([(81, 4), (80, 4), (1000, 3), (1, 2)], "e int, d int").select(scalars.lookup_size(F.col("e"), F.col("d")).alias("n"))
    assert [int(r.n) for r in sizes.collect()] == [3, 2, 10, 1]
    f = spark.createDataFrame([(n,) for n in (0, 1, 5, 20, 21, 1000)], "n long").select("n", cost.log2_factorial(F.col("n")).alias("v")).collect()
    assert all(abs(r.v - math.lgamma(r.n + 1) / math.log(2)) < 1e-8 for r in f)


def test_prefix_sums_and_ranges(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(50)) for k in rng.sample(range(100000), 500)]
    out = {r.k: r.before for r in layout.prefix_sum(spark.createDataFrame(rows, "k long, v long"), "k", "v", width=1000).collect()}
    total = 0
    for k, v in sorted(rows):
        assert out[k] == total
        total += v
    df = spark.createDataFrame([(1, 0, 9), (1, 10, 12), (1, 5, 6), (1, 20, 30), (2, 1, 2)], "g int, lo int, hi int")
    merged = layout.merge_ranges(df, ["g"], "lo", "hi")
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 12), (1, 20, 30), (2, 1, 2)]
    assert [tuple(r) for r in layout.gaps(merged, ["g"]).collect()] == [(1, 13, 19)]


def test_longest_prefix(spark):
    words = lookup.dictionary(spark, [("a",), ("ab",), ("abc",), ("x",)], "prefix string")
    df = spark.createDataFrame([(1, "abd"), (2, "abcz"), (3, "zz"), (4, ""), (5, None)], "i int, s string")
    assert {r.i: r.prefix for r in lookup.longest_prefix(df, "s", words, ["i"]).collect()} == {1: "ab", 2: "abc", 3: None, 4: None, 5: None}

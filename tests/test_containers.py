import math
import random

import pytest
from test_ogg import streams

from strandflow.operators import layout, lookup, models
from strandflow.plans.media import _it
from strandflow.sources import ogg, tracker


def test_pages_from_shapes():
    rng = random.Random(1)
    for packets, raw in streams(rng, 3):
        pages, _ = ogg.parse(raw)
        shapes = ogg.skeletons(pages)
        assert b"".join(ogg.from_skeletons(packets, shapes)) == raw
        with pytest.raises(ValueError, match="too"):
            ogg.from_skeletons(packets[:-1], shapes)
        with pytest.raises(ValueError, match="too many"):
            ogg.from_skeletons([*packets, b"x"], shapes)
        other = b"".join(ogg.under_serial(p, 77) for p in pages)
        assert [(p.serial, p.body) for p in ogg.parse(other)[0]] == [(77, p.body) for p in pages]


def test_header_field_covers_the_header():
    for n, size in ((31, 1084), (15, 600)):
        fields = [tracker.header_field(i, n) for i in range(size + 3)]
        assert None not in fields[:size] and fields[size:] == [None] * 3
        assert fields[20 + 30 * 2 + 22] == ("length", 2, 0) and fields[20 + 30 * n] == ("song_length", -1, 0)


def test_modules_laid_out_anew():
    rng = random.Random(2)
    for key in range(6):
        data = _it(key)
        n = sum(e.state == "PRI" for e in tracker.it_entities(data))
        for _ in range(5):
            moved = tracker.move_it(data, rng.sample(range(n), n))
            a, b = tracker.it_entities(data), tracker.it_entities(moved)
            assert [(e.kind, e.idx, e.state, e.alias_of) for e in a] == [(e.kind, e.idx, e.state, e.alias_of) for e in b]
            assert [data[e.off : e.off + e.len] for e in a if e.state == "PRI"] == [moved[e.off : e.off + e.len] for e in b if e.state == "PRI"]


def test_frequencies_against_a_plain_table():
    rng = random.Random(3)
    table, f = models.FrequencyTable(4, step=10, cap=100), [1] * 4
    for _ in range(500):
        s = min(3, int(rng.expovariate(1)))
        assert table.cost(s) == pytest.approx(-math.log2(f[s] / sum(f)))
        table.update(s)
        f[s] += 10
        if sum(f) > 100:
            f = [1 + (x - 1) // 2 for x in f]


def test_range_lookup_against_a_loop(spark):
    rng = random.Random(4)
    ranges = [(10 * i + rng.randrange(3), 10 * i + rng.randrange(4, 9), f"r{i}") for i in range(200)] + [(-(10**15), -5, "low"), (5000, 10**15, "high"), (7, 3, "none")]
    values = [rng.randrange(-50, 6000) for _ in range(500)] + [None]
    out = lookup.range_lookup(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long"), "v", spark.createDataFrame(ranges, "lo long, hi long, name string"))
    want = sorted(((i, name) for i, v in enumerate(values) for name in ([n for lo, hi, n in ranges if v is not None and lo <= v <= hi] or [None])), key=str)
    assert sorted(((r.id, r.name) for r in out.collect()), key=str) == want


def test_prefix_sums_by_levels(spark):
    rows = [(k, k % 7) for k in random.Random(5).sample(range(5000), 1500)]
    df = spark.createDataFrame(rows, "k long, v long")
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k] = total
        total += v
    for width, levels in ((8, 3), (4096, 1), (3, 0)):
        assert {r.k: r.before for r in layout.prefix_sum(df, "k", "v", width, levels).collect()} == want


def test_copies_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "id long, t string")
    assert {r.id: r.first_id for r in lookup.first_equal(df, [df.t], "id").collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}

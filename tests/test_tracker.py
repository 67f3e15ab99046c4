import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.sources import files, tracker


def make_mod(rng, tag=b"M.K.", patterns=2, samples=((10, 3), (0, 0)), tail=b"", cut=0):
    channels = tracker.tag_channels(tag)
    head = b"title".ljust(20, b"\0")
    for k in range(31):
        n, volume = samples[k] if k < len(samples) else (0, 0)
        head += b"name".ljust(22, b"\0") + (n // 2).to_bytes(2, "big") + bytes([0, volume]) + bytes(4)
    orders = bytes(rng.randrange(patterns) for _ in range(127)) + bytes([patterns - 1])
    head += bytes([128, 127]) + orders + tag
    cells = rng.randbytes(patterns * channels * 4 * 64)
    data = head + cells + rng.randbytes(sum(n for n, _ in samples)) + tail
    return data[: len(data) - cut]


def test_periods(spark):
    assert [tracker.semitone(p) for p in (4095, 3980, 3979, 856, 1)] == [0, 0, 1, 27, 96]
    df = spark.range(0, 4096).select(F.col("id").cast("int").alias("p"), tracker.semitone_expr(F.col("id").cast("int")).alias("s"))
    assert {r.p: r.s for r in df.collect()} == {p: tracker.semitone(p) for p in range(4096)}


def test_mod_layout_and_cells(spark):
    rng = random.Random(1)
    plain, eight, cut = make_mod(rng), make_mod(rng, b"8CHN", 3, tail=b"tail"), make_mod(rng, samples=((100, 1),), cut=30)
    df = spark.createDataFrame([("a", len(plain), plain), ("b", len(eight), eight), ("c", len(cut), cut), ("x", 3, b"abc")], files.SCHEMA)
    head = {r.path: r for r in tracker.headers(df).collect()}
    assert set(head) == {"a", "b", "c"}
    assert (head["a"].channels, head["a"].npatterns, head["a"].tail, head["a"].title, head["a"].tag) == (4, 2, 0, "title", "M.K.")
    assert (head["b"].channels, head["b"].npatterns, head["b"].tail) == (8, 3, 4)
    samples = tracker.samples(df).where("path = 'c' and si = 0").first()
    assert samples.len == 70
    cells = tracker.cells(df).where("path = 'a'").collect()
    assert len(cells) == 2 * 64 * 4
    for c in cells[:50]:
        b = plain[1084 + 4 * c.i : 1088 + 4 * c.i]
        assert (c.period, c.sample, c.effect, c.param) == ((b[0] & 15) << 8 | b[1], b[0] & 0xF0 | b[2] >> 4, b[2] & 15, b[3])
        assert (c.pattern, c.row, c.chan) == (c.i // 256, c.i // 4 % 64, c.i % 4)
        assert c.semitone == (0 if c.period == 0 else 1 + tracker.semitone(c.period))


def test_tags_and_old_modules():
    assert [tracker.tag_channels(t) for t in (b"M.K.", b"6CHN", b"32CH", b"TDZ3", b"abcd", b"0CHN")] == [4, 6, 32, 3, None, None]
    head = b"t".ljust(20, b"\0") + (b"n".ljust(22, b"\0") + (4).to_bytes(2, "big") + bytes([0, 64]) + bytes(4)) * 15
    old = head + bytes([1, 0]) + bytes(128) + bytes(1024 + 120)
    assert tracker.mod_kind(old) == 15 and tracker.mod_layout(old).npatterns == 1
    assert tracker.mod_kind(bytes(700)) == 0


def make_it():
    pattern = tracker.pack_it([(0, 0, 0, 60, 1, None, None, None), (0, 3, 0, 61, 2, 64, 1, 2), (5, 0, 0, None, None, 32, None, None)], 64)
    packed = len(pattern).to_bytes(2, "little") + (64).to_bytes(2, "little") + bytes(4) + pattern
    orders, counts = 2, (1, 3, 3)
    base = 192 + orders + 4 * sum(counts)
    ins, smp = base, base + 554
    pcm = smp + 160
    pat = pcm + 30
    head = bytearray(b"IMPM" + bytes(188))
    for at, v in ((0x20, orders), (0x22, counts[0]), (0x24, counts[1]), (0x26, counts[2])):
        head[at : at + 2] = v.to_bytes(2, "little")

    def sample(flags, n, at):
        h = bytearray(b"IMPS" + bytes(76))
        h[18] = flags
        h[48:52] = n.to_bytes(4, "little")
        h[72:76] = at.to_bytes(4, "little")
        return bytes(h)

    offsets = [ins, smp, smp + 80, smp, pat, 0, 99999]  # third sample header is an alias; patterns: held, none, elsewhere
    table = b"".join(o.to_bytes(4, "little") for o in offsets)
    return bytes(head) + b"\0\1" + table + b"IMPI" + bytes(550) + sample(1, 20, pcm) + sample(3, 5, pcm + 20) + bytes(range(30)) + packed


def test_it_entities_and_patterns(spark):
    data = make_it()
    df = spark.createDataFrame([("a", len(data), data), ("x", 4, b"none")], files.SCHEMA)
    out = {(r.kind, r.idx): (r.state, r.len, r.alias_of) for r in tracker.entities(df).collect()}
    assert out[("instrument", 0)] == ("PRI", 554, None) and out[("sample", 1)] == ("PRI", 80, None)
    assert out[("sample", 2)] == ("ALIAS", 80, 0) and out[("pcm", 2)][0] == "NONE"
    assert out[("pcm", 0)] == ("PRI", 20, None) and out[("pcm", 1)] == ("PRI", 10, None)
    assert out[("pattern", 0)][0] == "PRI" and out[("pattern", 1)][0] == "ZERO" and out[("pattern", 2)][0] == "RAW"
    events = [tuple(r)[1:] for r in tracker.pattern_events(df).orderBy("row", "chan").collect()]
    assert [(e[1], e[2], *e[4:]) for e in events] == [(0, 0, 60, 1, None, None, None), (0, 3, 61, 2, 64, 1, 2), (5, 0, None, None, 32, None, None)]


def test_overlaps_keep_the_first_and_longest():
    E = tracker.Entity
    out = tracker.resolve([E("a", 0, 10, 5), E("a", 1, 10, 20), E("a", 2, 20, 5), E("a", 3, 30, 4), E("a", 4, 0, 4), E("a", 5, 99, 4)], 100)
    assert [e.state for e in out] == ["ALIAS", "PRI", "RAW", "PRI", "ZERO", "RAW"] and out[0].alias_of == 1


def test_s3m_and_xm(spark):
    s3m = bytearray(96) + bytearray((6).to_bytes(2, "little")) + bytearray(160)
    s3m[0x2C:0x30] = b"SCRM"
    s3m[0x24:0x26] = (1).to_bytes(2, "little")
    s3m[96:98] = (7).to_bytes(2, "little")
    pat = bytes([0, 0]) + bytes([32 | 128 | 2, 60, 1, 3, 4]) + b"\0" * 64
    s3m[112 : 112 + len(pat)] = len(pat).to_bytes(2, "little") + pat[2:]
    xm = bytearray(b"Extended Module: " + bytes(43)) + (276).to_bytes(4, "little") + bytes(4) + (2).to_bytes(2, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes(262)
    xm = xm[:336]
    body = bytes([0x83, 49, 1]) + bytes([0x80]) + bytes([1, 2, 3, 4, 5]) + bytes([0x80])
    xm += (9).to_bytes(4, "little") + b"\0" + (2).to_bytes(2, "little") + len(body).to_bytes(2, "little") + body
    ins = bytearray(263)
    ins[:4], ins[27:29], ins[29:33] = (263).to_bytes(4, "little"), (1).to_bytes(2, "little"), (40).to_bytes(4, "little")
    xm += ins + (6).to_bytes(4, "little") + bytes(36) + b"abcdef" + b"rest"
    df = spark.createDataFrame([("s", len(s3m), bytes(s3m)), ("x", len(xm), bytes(xm))], files.SCHEMA)
    chunks = [tuple(r) for r in tracker.chunks(df).orderBy("chunk").collect()]
    assert [c[2] for c in chunks] == ["header", "pattern", "instrument", "sample_header", "sample", "tail"]
    assert sum(c[5] for c in chunks) == len(xm) and chunks[-1][5] == 4
    events = [tuple(r) for r in tracker.pattern_events(df).orderBy("path", "row", "chan").collect()]
    assert events[0][1:] == (0, 0, 2, 160, 60, 1, None, 3, 4)
    assert [e[1:] for e in events[1:]] == [(0, 0, 0, 3, 49, 1, None, None, None), (0, 1, 0, 31, 1, 2, 3, 4, 5)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-128, 127), max_size=300), st.booleans())
def test_compressed_samples(xs, twice):
    assert tracker.decompress(tracker.compress(xs, False, twice), 0, len(xs), False, twice) == xs
    wide = [x * 255 for x in xs]
    assert tracker.decompress(tracker.compress(wide, True, twice), 0, len(wide), True, twice) == wide


def test_width_changes():
    from strandflow.functions.bits import LsbWriter

    w = LsbWriter().write(1 << 8 | 4, 9)  # to width 5
    w.write(3, 5).write((-2) % 32, 5).write(1 << 4, 5).write(6, 3)  # to width 8, since 7 is not below 5
    w.write(100, 8)
    raw = w.bytes()
    assert tracker.decompress(len(raw).to_bytes(2, "little") + raw, 0, 3, False) == [3, 1, 101]


def test_pcm():
    assert tracker.decode_pcm(b"\x01\xff\x80", False) == [1, -1, -128]
    assert tracker.decode_pcm(b"\x80\x81", False, signed=False) == [0, 1]
    assert tracker.decode_pcm(b"\x01\x01\xfe", False, delta=True) == [1, 2, 0]
    assert tracker.decode_pcm(b"\x01\x00\xff\xff", True) == [1, -1]

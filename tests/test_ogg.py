import random

from pyspark.sql import functions as F

from strandflow.functions import checksums
from strandflow.sources import files, ogg


def streams(rng, n=3):
    out = []
    for k in range(n):
        packets = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 254, 255, 256, 510, 700, 3000]))) for _ in range(8)]
        out.append((packets, ogg.build_stream(packets, 100 + k, segments=rng.choice([3, 10, 255]))))
    return out


def test_checksum_vectors():
    assert checksums.crc32c(b"123456789") == 0xE3069283
    assert checksums.ogg_crc(b"123456789") == 0x89A1897F
    for data, want in [(b"\0" * 32, 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C)]:
        assert checksums.crc32c(data) == want
    rng = random.Random(1)
    rows = [bytes(rng.randrange(256) for _ in range(rng.randrange(60))) for _ in range(1200)]
    for kind, one in (("crc32c", checksums.crc32c), ("ogg", checksums.ogg_crc), ("crc16", checksums.crc16)):
        assert checksums.crc_rows(rows, kind).tolist() == [one(r) for r in rows]
    for a, b in zip(rows[:60], rows[60:120], strict=True):
        assert checksums.combine_crc32c(checksums.crc32c(a), checksums.crc32c(b), len(b)) == checksums.crc32c(a + b)


def test_pages_rebuild_exactly():
    rng = random.Random(2)
    for _, raw in streams(rng):
        pages, gaps = ogg.parse(raw)
        assert not gaps and b"".join(map(ogg.rebuild, pages)) == raw


def test_gaps_and_damage():
    rng = random.Random(3)
    raw = b"".join(x for _, x in streams(rng))
    cut = bytearray(b"junk" + raw[:5000] + b"OggS\0garbage" + raw[5000:] + b"tail")
    cut[len(cut) // 2] ^= 0xFF
    data = bytes(cut)
    pages, gaps = ogg.parse(data)
    cover = sorted([(p.at, p.size) for p in pages] + [(src, n) for _, src, n in gaps])
    assert cover[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(cover, cover[1:], strict=False)) and sum(cover[-1]) == len(data)
    clean = b"".join(map(ogg.rebuild, pages))
    out, at = b"", 0
    for place, src, n in gaps:  # gaps go back to their place among the clean bytes
        out += clean[at:place] + data[src : src + n]
        at = place
    assert out + clean[at:] == data


def test_pages_after_eos_are_gaps():
    raw = ogg.build_stream([b"a", b"b"], 1)
    stray = ogg.build_page(0, 5, 1, 9, [1], b"x")
    pages, gaps = ogg.parse(raw + stray + ogg.build_stream([b"c"], 2), after_eos_is_gap=True)
    assert len(gaps) == 1 and gaps[0][2] == len(stray) and len(pages) == 3


def test_tables(spark):
    rng = random.Random(4)
    made = streams(rng)
    copy = ogg.build_stream(made[0][0], 900, segments=10)
    original = ogg.build_stream(made[0][0], 100, segments=10)
    chain = original + made[1][1] + copy + b"junk"
    df = spark.createDataFrame([("a", len(chain), chain), ("b", 0, b""), ("c", 4, b"none")], files.SCHEMA)
    pages = ogg.pages(df)
    packets = {}
    for r in ogg.packets(pages).orderBy("link", "pkt").collect():
        packets.setdefault(r.link, []).append(bytes(r.data))
    assert packets == {1: made[0][0], 2: made[1][0], 3: made[0][0]}
    copies = {r.link: (r.serial, r.rep_of) for r in ogg.link_copies(pages).collect()}
    assert copies == {1: (100, None), 2: (101, None), 3: (900, 1)}
    assert [(r.path, r.len, bytes(r.bytes)) for r in ogg.gaps(df).orderBy("path").collect()] == [("a", 4, b"junk"), ("c", 4, b"none")]
    crc = df.select(checksums.crc32c_udf("content").alias("c")).collect()
    assert crc[0].c == checksums.crc32c(chain) and crc[1].c == 0


def test_sniff(spark):
    it = bytearray(b"IMPM" + b"\0" * 188)
    s3m = bytearray(b"\0" * 96)
    s3m[0x2C:0x30] = b"SCRM"
    mod = bytearray(1084)
    mod[1080:1084] = b"6CHN"
    vorbis = ogg.build_stream([b"\x01vorbis" + b"\0" * 23, b"x"], 1)
    opus = ogg.build_stream([b"OpusHead" + b"\0" * 11, b"x"], 1)
    rows = {"vorbis": vorbis, "opus": opus, "it": bytes(it), "s3m": bytes(s3m), "xm": b"Extended Module: x", "mod": bytes(mod), "sync": b"\xff\xfb\x90\0", "id3": b"ID3\x04", "other": b"OggS", "none": b""}
    df = spark.createDataFrame([(k, len(v), v) for k, v in rows.items()], files.SCHEMA)
    out = {r.path: r.fmt for r in df.select("path", files.sniff(files.peek(F.col("content"), 2048), F.col("length")).alias("fmt")).collect()}
    assert out == {k: {"id3": "mp3", "other": None, "none": None, "sync": None}.get(k, k) for k in rows}


def test_sniff_by_grammar(spark):
    frame = b"\xff\xfb\x90\x40" + bytes(413)
    old = bytearray(b"x".ljust(20, b"\0") + (b"".ljust(22, b"\0") + bytes([0, 2, 0, 64, 0, 0, 0, 1])) * 15 + bytes([1, 120]) + bytes(128) + bytes(1024 + 60))
    tags = {t: bytes(1080) + t.encode() for t in ("FEST", "LARD", "EXO4", "M.K.", "12CN", "TDZ3")}
    rows = {"run": b"junk" * 20 + frame * 8, "sync": b"\xff\xfb\x90\0" + b"x" * 3000, "old": bytes(old), "empty": b"", "null": None, **tags}
    df = spark.createDataFrame([(k, len(v or b""), v) for k, v in rows.items()], files.SCHEMA)
    out = {r.path: r.fmt for r in files.sniffed(df).collect()}
    assert out == {"run": "mp3", "sync": None, "old": "mod", "empty": None, "null": None, "FEST": "mod", "LARD": "mod", "EXO4": None, "M.K.": "mod", "12CN": "mod", "TDZ3": "mod"}


def test_files_written_and_read(spark, tmp_path):
    rows = [(str(i), 3 * i, b"abc" * i) for i in range(1, 20)]  # Spark passes over empty files
    files.write_files(spark.createDataFrame(rows, files.SCHEMA).repartition(4), f"file://{tmp_path}/out")
    got = files.read_files(spark, f"file://{tmp_path}/out", "*.bin").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length, bytes(r.content)) for r in got) == sorted((f"{p}.bin", n, c) for p, n, c in rows)


def test_ogg_checksums_of_long_bodies_are_quick():
    import time

    rng = random.Random(4)
    for n in (0, 1, 2, 7, 300):
        data, crc = rng.randbytes(n), rng.getrandbits(32)
        want = crc
        for b in data:
            want = int(checksums.OGG_TABLE[(want >> 24) ^ b]) ^ (want << 8 & 0xFFFFFFFF)
        assert checksums.ogg_crc(data, crc) == want
    began = time.process_time()
    checksums.ogg_crc(bytes(20 << 20))
    assert time.process_time() - began < 1  # a byte at a time takes several

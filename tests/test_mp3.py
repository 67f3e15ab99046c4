import random

from strandflow.functions.bits import MsbWriter
from strandflow.functions.checksums import crc16
from strandflow.sources import files, mp3


def side_bits(h, begin, part2_3):
    w = MsbWriter()
    w.write(begin, 8 if h.lsf else 9).write(0, (1 if h.channels == 1 else 2) if h.lsf else (5 if h.channels == 1 else 3))
    if not h.lsf:
        w.write(0, 4 * h.channels)
    for _ in range(h.granules):
        for _ in range(h.channels):
            w.write(part2_3, 12).write(17, 9).write(180, 8).write(3, 9 if h.lsf else 4).write(0, 1)
            w.write(5, 5).write(6, 5).write(7, 5).write(2, 4).write(1, 3)
            if not h.lsf:
                w.write(1, 1)
            w.write(0, 1).write(1, 1)
    return w.bytes()


def frame(rng, version=3, bitrate=9, rate=0, mode=1, crc=False, pad=0, part2_3=100, begin=0, free=0):
    head = bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | (not crc), bitrate << 4 | rate << 2 | pad << 1, mode << 6])
    h = mp3.parse_header(head + bytes(40), 0)
    side = side_bits(h, begin, part2_3)
    check = crc16(head[2:] + side).to_bytes(2, "big") if crc else b""
    size = h.frame_bytes(free)
    body = bytes(rng.randrange(0, 200) for _ in range(size - h.head_bytes))
    return head + check + side + body


def test_headers():
    rng = random.Random(1)
    h = mp3.parse_header(frame(rng), 0)
    assert (h.rate, h.bitrate, h.frame_bytes(), h.side_bytes, h.channels, h.granules) == (44100, 128, 417, 32, 2, 2)
    h = mp3.parse_header(frame(rng, version=2, mode=3, bitrate=8), 0)
    assert (h.rate, h.bitrate, h.frame_bytes(), h.side_bytes, h.granules) == (22050, 64, 208, 9, 1)
    for bad in (b"\xff\xfb\xf0\0", b"\xff\xfb\x9c\0", b"\xff\xeb\x90\0", b"\xff\xfd\x90\0", b"\xff\xfb\x90\x02", b"\xfe\xfb\x90\0"):
        assert mp3.parse_header(bad + bytes(500), 0) is None


def test_segments_cover_the_file(spark):
    rng = random.Random(2)
    run = b"".join(frame(rng, crc=i % 2 == 0, pad=i % 3 == 0) for i in range(12))
    other = b"".join(frame(rng, version=2, mode=3, bitrate=8, part2_3=40) for _ in range(8))
    noise = rng.randbytes(5000).replace(b"\xff", b"\xfe")
    tags = b"TAG" + b"\0" * 125
    data = b"ID3 junk " + run + noise + other + tags
    two = frame(rng) + frame(rng) + tags
    short = frame(rng) + frame(rng) + b"not tags"
    df = spark.createDataFrame([("a", len(data), data), ("two", len(two), two), ("short", len(short), short), ("e", 0, b"")], files.SCHEMA)
    out = [tuple(r) for r in mp3.segments(df).orderBy("path", "seg").collect()]
    assert [(r[0], r[4], r[5]) for r in out] == [
        ("a", "RAW", 0), ("a", "RUN", 12), ("a", "STORED", 0), ("a", "RUN", 8), ("a", "RAW", 0), ("short", "RAW", 0), ("two", "RUN", 2), ("two", "RAW", 0),
    ]
    at = 0
    for r in out[:5]:
        assert r[2] == at
        at += r[3]
    assert at == len(data)
    frames = mp3.frames(df).where("path = 'a'").orderBy("frame").collect()
    assert len(frames) == 20 and all(f.crc_ok for f in frames[:12:2]) and frames[1].crc_ok is None
    assert frames[0].payload_bits == 400 and frames[0].payload_at == 0 and frames[0].fits
    granules = mp3.granules(df).where("path = 'a'")
    assert granules.count() == 12 * 4 + 8
    g = granules.where("frame = 0 and gr = 1 and ch = 0").first()
    assert (g.part2_3, g.big_values, g.global_gain, g.table_select, g.region0, g.region1, g.preflag, g.count1) == (100, 17, 180, [5, 6, 7], 2, 1, 1, 1)


def test_reservoir_placement():
    rng = random.Random(3)
    frames = [frame(rng, part2_3=100, begin=b) for b in (0, 300, 0, 500, 0, 0, 0)]
    run = mp3.run_at(b"".join(frames), 0)
    placed = [(start, fits) for *_, start, fits in mp3.placements(b"".join(frames), run)]
    room = 417 - 36
    assert placed[0] == (0, True) and placed[1] == (room - 300, True)
    assert placed[2] == (2 * room, True) and placed[3] == (3 * room - 500, False) and placed[4] == (4 * room, True)


def test_free_format_and_transposition():
    rng = random.Random(4)
    data = b"".join(frame(rng, bitrate=0, free=400, pad=i % 2) for i in range(8))
    run = mp3.run_at(data, 0)
    assert run.free == 400 and len(run.frames) == 8 and mp3.accepted(data, run)
    assert mp3.restore(*mp3.transpose(data, run), free=run.free) == data
    assert mp3.sniff(data) and not mp3.sniff(rng.randbytes(3000))


def test_tags():
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(16)
    assert mp3.tags_only(b"TAG" + bytes(125)) and mp3.tags_only(b"x" * 8 + ape) and not mp3.tags_only(b"x")
    assert mp3.tags_only(b"LYRICSBEGIN" + b"000011" + b"LYRICS200"[:0] + b"") is False
    assert mp3.tags_only(b"LYRICSBEGIN" + b"000011" + b"LYRICS200")

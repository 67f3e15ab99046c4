"""Queries over binary containers built from the documents' texts, and over sequence models."""

from __future__ import annotations

import random
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow import codec
from strandflow.functions import checksums
from strandflow.functions.bits import LsbWriter
from strandflow.operators import coders, models
from strandflow.registry import query
from strandflow.session import materialize, shared_dir, table
from strandflow.sources import archive, files, mp3, ogg, opus, tracker, vorbis_audio


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' bytes, dealt out: a file may have all its rows in one row group, which one task would read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


LOSSLESS = "SELECT doc_id, true AS lossless, strlen(coalesce(text, ''))::BIGINT AS payload FROM documents"


@query("ogg_roundtrip", "SRC13 SRC14 SNK05 SNK06 SET01 SET03 FLT01 FLT02", LOSSLESS)
def ogg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into packets and paged with junk between; parsed, repaired and rebuilt byte by byte."""

    def one(row) -> tuple:
        data = bytes(row.data)
        packets = [data[i : i + 700] for i in range(0, len(data), 700)] or [b""]
        raw = ogg.build_stream(packets, row.doc_id & 0xFFFFFFFF, segments=7)
        damaged = b"junk" + raw[: len(raw) // 2] + b"" + raw[len(raw) // 2 :] + b"OggS"
        pages, gaps = ogg.parse(damaged)
        clean = b"".join(map(ogg.rebuild, pages))
        held, at = b"", 0
        for place, src, n in gaps:
            held += clean[at:place] + damaged[src : src + n]
            at = place
        body = b"".join(p.body for p in pages)
        return row.doc_id, held + clean[at:] == damaged and clean == raw and body == data, len(body)

    return models.map_rows(texts(spark, sf_dir), "doc_id long, lossless boolean, payload long", one)


@query("archive_roundtrip", "SRC33 SNK01 SNK02 SNK03 SNK04 AGG19", LOSSLESS)
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as two streams of an archive, written and read again."""

    def one(row) -> tuple:
        data = bytes(row.data)
        streams = [data[::2], data[1::2]]
        name, back = archive.decode(archive.encode(str(row.doc_id), streams, chunk=1024))
        return row.doc_id, back == streams and name == str(row.doc_id), sum(map(len, back))

    return models.map_rows(texts(spark, sf_dir), "doc_id long, lossless boolean, payload long", one)


@query("range_coder_roundtrip", "MDL01 MDL04 MDL07", LOSSLESS.replace("documents", "benchmark").replace("doc_id", "item_id"))
def range_coder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through the adaptive range coder and back."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))

    def one(row) -> tuple:
        data = bytes(row.data)
        return row.item_id, models.decode_bytes(models.code_bytes(data), len(data)) == data, len(data)

    return models.map_rows(items, "item_id long, lossless boolean, payload long", one)


def _crc_sql(poly: int, reflected: bool) -> tuple[str, str]:
    """(a table by its rule, a step over a byte) of a CRC-32 in SQL."""
    if reflected:
        one = f"CASE WHEN a & 1 = 1 THEN xor(a >> 1, {poly}) ELSE a >> 1 END"
        return f"list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda a, i: {one}, b))", "xor(c >> 8, {t}[(xor(c, b) & 255) + 1])"
    one = f"CASE WHEN a >> 31 = 1 THEN xor((a << 1) & 4294967295, {poly}) ELSE a << 1 END"
    return f"list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda a, i: {one}, b << 24))", "xor((c << 8) & 4294967295, {t}[xor(c >> 24, b) + 1])"


_CASTAGNOLI, _ZIP, _OGG = _crc_sql(0x82F63B78, True), _crc_sql(0xEDB88320, True), _crc_sql(0x04C11DB7, False)
CRC = f"""
WITH t AS (SELECT {_CASTAGNOLI[0]} AS tc, {_ZIP[0]} AS tz, {_OGG[0]} AS tg),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM h)
SELECT doc_id, xor(list_reduce(bytes, lambda c, b: {_CASTAGNOLI[1].format(t='tc')}, 4294967295), 4294967295) AS crc32c,
  list_reduce(bytes, lambda c, b: {_OGG[1].format(t='tg')}, 0::BIGINT) AS ogg_crc,
  xor(list_reduce(bytes, lambda c, b: {_ZIP[1].format(t='tz')}, 4294967295), 4294967295) AS crc32 FROM b, t
"""


@query("crc_checksums", "AGG19 AGG20 STR07", CRC)
def crc_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32C of each text put together from those of its halves, its Ogg checksum, and CRC-32."""
    docs = texts(spark, sf_dir).withColumn("half", F.floor(F.length("data") / 2).cast("int"))
    parts = docs.select(
        "doc_id",
        coders.checksum(spark, "crc32c", F.expr("substring(data, 1, half)")).alias("first"),
        coders.checksum(spark, "crc32c", F.expr("substring(data, half + 1)")).alias("second"),
        (F.length("data") - F.col("half")).alias("size"),
        coders.checksum(spark, "ogg_crc", F.col("data")).alias("ogg_crc"),
        F.crc32("data").alias("crc32"),
    )
    return parts.select("doc_id", checksums.combine_udf("first", "second", "size").alias("crc32c"), "ogg_crc", "crc32")


@query("lz_parse", "JON09")
def lz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy LZ parse of each benchmark text: literals, matches, bytes matched, and whether it restores."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))

    def one(row) -> tuple:
        data = bytes(row.data)
        tokens = models.lz_parse(data)
        matched = [n for _, n, back in tokens if back]
        return row.item_id, len(tokens) - len(matched), len(matched), sum(matched), models.lz_restore(data, tokens) == data

    return models.map_rows(items, "item_id long, literals long, matches long, matched long, lossless boolean", one)


@query("mixer_cost", "MDL02 WIN08")
def mixer_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each user's purchase flags by two count models, their mixture, and that refined."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").cast("int").alias("v"))
    schema = "user_id long, n long, order0 double, order2 double, mixed double, refined double"
    fold = lambda pdf: (len(pdf), *(round(x, 6) for x in models.mixed_costs(pdf["v"].to_numpy())))
    return models.fold_groups(df, ["user_id"], ["ts", "event_id"], schema, fold)


@query("predictor_residuals", "AGG11 AGG12 WIN23")
def predictor_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute residual of each user's values, plain, by LMS and by decayed least squares."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    mean = lambda x: round(float(np.abs(x).mean()), 6)

    def fold(pdf) -> tuple:
        x = pdf["value"].fillna(0.0).to_numpy(np.float64)
        return len(x), mean(x), mean(models.lms_residuals(x)), mean(models.rls_residuals(x))

    return models.fold_groups(df, ["user_id"], ["ts", "event_id"], "user_id long, n long, plain double, lms double, rls double", fold)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' keys, dealt out: a container or a model is made of each."""
    return table(spark, sf_dir, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def built(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """path, length, content: a container built from each supplier's key, in the tasks."""

    def one(row) -> tuple:
        data = build(int(row.s_suppkey))
        return str(row.s_suppkey), len(data), data

    return models.map_rows(keys(spark, sf_dir), "path string, length long, content binary", one)


def _mod(key: int) -> bytes:
    rng = random.Random(key)
    channels, patterns = 4 + key % 3 * 2, 1 + key % 3
    head = f"song {key}".encode().ljust(20, b"\0") + (b"".ljust(22, b"\0") + (key % 50).to_bytes(2, "big") + bytes(6)) * 31
    head += bytes([patterns, 127]) + bytes(range(patterns)).ljust(128, b"\0") + f"{channels}CHN".encode()
    return head + rng.randbytes(channels * 256 * patterns) + rng.randbytes(key % 50 * 62)


MOD_CELLS = """
SELECT s_suppkey::VARCHAR AS path, (4 + s_suppkey % 3 * 2)::INTEGER AS channels, (1 + s_suppkey % 3)::INTEGER AS npatterns,
  (4 + s_suppkey % 3 * 2) * 64 * (1 + s_suppkey % 3) AS cells FROM supplier
"""


@query("mod_cells", "SRC10 SRC11 SRC20 SRC21 AGG07", MOD_CELLS)
def mod_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of known size: channels, patterns and cells that the parser finds."""
    files = built(spark, sf_dir, _mod)
    cells = tracker.cells(files).groupBy("path").agg(F.count("*").alias("cells"))
    return tracker.headers(files).join(cells, "path").select("path", "channels", "npatterns", "cells")


def _mp3(key: int) -> bytes:
    rng = random.Random(key)
    frame = b"\xff\xfb\x90\x40" + bytes(32)
    return bytes(key % 7) + b"".join(frame + bytes(rng.randrange(200) for _ in range(381)) for _ in range(6 + key % 5)) + b"TAG" + bytes(125)


MP3_HEADERS = """
SELECT s_suppkey::VARCHAR AS path, 6 + s_suppkey % 5 AS frames, s_suppkey % 7 AS first_at, (6 + s_suppkey % 5) * 417 AS run_bytes, 44100 AS rate FROM supplier
"""


@query("mp3_headers", "SRC12 SRC16 SRC17 SET04 FLT06 FLT07 FN18", MP3_HEADERS)
def mp3_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame runs between junk and tags."""
    found = mp3.frames(built(spark, sf_dir, _mp3))
    return found.groupBy("path").agg(
        F.count("*").alias("frames"), F.min("at").alias("first_at"), F.sum("frame_bytes").alias("run_bytes"), F.max("rate").alias("rate")
    )


def _it(key: int) -> bytes:
    n = 1 + key % 4
    base = 192 + 4 * (2 * n + 1)
    head = bytearray(b"IMPM" + bytes(188))
    head[0x24:0x26], head[0x26:0x28] = (2 * n).to_bytes(2, "little"), (1).to_bytes(2, "little")
    samples = [base + 80 * i for i in range(n)] * 2  # every sample has an alias
    pattern = base + 80 * n
    table_ = b"".join(x.to_bytes(4, "little") for x in [*samples, pattern])
    return bytes(head) + table_ + (b"IMPS" + bytes(76)) * n + (64).to_bytes(2, "little") + (64).to_bytes(2, "little") + bytes(68)


IT_ENTITIES = """
SELECT s_suppkey::VARCHAR AS path, 1 + s_suppkey % 4 AS held, 1 + s_suppkey % 4 AS aliases, 1::BIGINT AS patterns FROM supplier
"""


@query("it_entities", "SRC09 SRC18 SRC30 JON08 SRT03", IT_ENTITIES)
def it_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample headers that hold their bytes, and aliases of them."""
    e = tracker.entities(built(spark, sf_dir, _it))
    sample, state = F.col("kind") == "sample", F.col("state")
    return e.groupBy("path").agg(
        F.count_if(sample & (state == "PRI")).alias("held"),
        F.count_if(sample & (state == "ALIAS")).alias("aliases"),
        F.count_if((F.col("kind") == "pattern") & (state == "PRI")).alias("patterns"),
    )


def _xm(key: int) -> bytes:
    n = 1 + key % 4
    head = b"Extended Module: ".ljust(60, b"\0") + (276).to_bytes(4, "little") + bytes(4) + (4).to_bytes(2, "little") + n.to_bytes(2, "little")
    head = head.ljust(336, b"\0")
    body = bytes([0x80]) * 8
    return head + ((9).to_bytes(4, "little") + b"\0" + (2).to_bytes(2, "little") + len(body).to_bytes(2, "little") + body) * n + bytes(key % 3)


XM_CHUNKS = """
SELECT s_suppkey::VARCHAR AS path, 1 + s_suppkey % 4 AS patterns, 336 + 17 * (1 + s_suppkey % 4) + s_suppkey % 3 AS bytes, s_suppkey % 3 AS tail FROM supplier
"""


@query("xm_chunks", "SRC19 SRC09", XM_CHUNKS)
def xm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that cover a module, its tail included."""
    c = tracker.chunks(built(spark, sf_dir, _xm))
    tail = F.coalesce(F.sum(F.when(F.col("kind") == "tail", F.col("len"))), F.lit(0))
    return c.groupBy("path").agg(F.count_if(F.col("kind") == "pattern").alias("patterns"), F.sum("len").alias("bytes"), tail.alias("tail"))


def _opus(key: int) -> bytes:
    rng = random.Random(key)
    packets = [opus.build_packet(31 << 3, [rng.randbytes(20 + k % 3) for k in range(1 + key % 3)]) for _ in range(5 + key % 4)]
    return ogg.build_stream([b"OpusHead\x01\x01" + bytes(9), b"OpusTags", *packets], key)


OPUS_TOC = """
SELECT s_suppkey::VARCHAR AS path, 5 + s_suppkey % 4 AS packets, (5 + s_suppkey % 4) * (1 + s_suppkey % 3) AS frames,
  (5 + s_suppkey % 4) * (1 + s_suppkey % 3) * 960 AS samples FROM supplier
"""


@query("opus_toc", "SRC22 SRC23 SRC14 WIN05", OPUS_TOC)
def opus_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of packets of pages: pages and packets by DataFrame operators, frames by the packet grammar."""
    frames = opus.frames(ogg.packets(ogg.pages(built(spark, sf_dir, _opus))))
    return frames.groupBy("path").agg(
        F.countDistinct("pkt").alias("packets"), F.count("*").alias("frames"), F.sum(F.col("frame_48k").cast("long")).alias("samples")
    )


def _chain(key: int) -> bytes:
    packets = [b"\x01head", b"body" * (1 + key % 9)]
    return b"".join(ogg.build_stream(packets if k % 2 else [*packets, b"other"], 10 * key + k) for k in range(2 + key % 4))


LINK_COPIES = """
SELECT s_suppkey::VARCHAR AS path, 2 + s_suppkey % 4 AS links, s_suppkey % 4 AS copies FROM supplier
"""


@query("link_copies", "JON01 JON02 SRC15 SNK07 FLT04", LINK_COPIES)
def link_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a chain that repeat an earlier one under another serial."""
    found = ogg.link_copies(ogg.pages(built(spark, sf_dir, _chain)))
    return found.groupBy("path").agg(F.count("*").alias("links"), F.count("rep_of").alias("copies"))


SNIFF = """
SELECT s_suppkey::VARCHAR AS path, CASE s_suppkey % 8 WHEN 0 THEN 'opus' WHEN 1 THEN 'mod' WHEN 2 THEN 'it' WHEN 3 THEN 'xm' WHEN 4 THEN 'mp3'
  WHEN 6 THEN 'mod' WHEN 7 THEN 's3m' END AS fmt FROM supplier
"""


def _old_mod(key: int) -> bytes:
    """A module of 15 samples, which has no tag."""
    rng = random.Random(key)
    records = [b"".ljust(22, b"\0") + (4 + key % 9).to_bytes(2, "big") + bytes([0, 64, 0, 0, 0, 1])] * 15
    head = f"old {key}".encode().ljust(20, b"\0") + b"".join(records) + bytes([1, 120]) + bytes(128)
    return head + rng.randbytes(1024) + rng.randbytes(15 * 2 * (4 + key % 9))


def _s3m(key: int) -> bytes:
    head = bytearray(96)
    head[0x2C:0x30], head[0x20] = b"SCRM", 2
    return bytes(head) + bytes(2 + key % 5)


@query("sniff_files", "SRC01 SRC06 SRC07 SRC08 SRC09 SRC10 SRC12 FLT12", SNIFF)
def sniff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of files of eight kinds, written to the shared folder and read as binary files; MP3s have junk ahead."""
    kinds = (_opus, _mod, _it, _xm, _mp3, lambda k: b"nothing that is known", _old_mod, _s3m)
    made = built(spark, sf_dir, lambda key: kinds[key % 8](key))
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    files.write_files(made, folder)
    name = F.regexp_extract("path", r"([0-9]+)\.bin$", 1)
    return files.sniffed(files.read_files(spark, folder, "*.bin")).select(name.alias("path"), "fmt")


@query("mp3_transpose", "SNK08 SNK09 FLT07", "SELECT s_suppkey::VARCHAR AS path, true AS lossless, (6 + s_suppkey % 5) * 36 AS head_bytes FROM supplier")
def mp3_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and payloads of runs taken apart and put together again."""

    def one(row) -> tuple:
        data = bytes(row.content)
        run = mp3.scan(data)[1][0]
        heads, payload = mp3.transpose(data, run)
        return row.path, mp3.restore(heads, payload, run.free) == data[run.at : run.end], len(heads)

    return models.map_rows(built(spark, sf_dir, _mp3), "path string, lossless boolean, head_bytes long", one)


@query("it_samples", "SRC31 SNK10", "SELECT s_suppkey::VARCHAR AS path, true AS lossless, true AS canonical, 500 + s_suppkey % 100 AS samples FROM supplier")
def it_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples compressed by both algorithms and patterns packed, each read back."""
    def one(row) -> tuple:
        rng = random.Random(row.s_suppkey)
        xs = [rng.randrange(-128, 128) for _ in range(500 + row.s_suppkey % 100)]
        both = all(tracker.decompress(tracker.compress(xs, False, t), 0, len(xs), False, t) == xs for t in (False, True))
        events = [(r, r % 4, 0, 40 + r % 20, 1 + r % 3, None, 1, r) for r in range(0, 64, 3)]
        packed = tracker.pack_it(events, 64)
        again = list(tracker.unpack_it(packed, 64))
        return str(row.s_suppkey), both, tracker.pack_it(again, 64) == packed, len(xs)

    return models.map_rows(keys(spark, sf_dir), "path string, lossless boolean, canonical boolean, samples long", one)


@query("codec_roundtrip", "SNK04 EXE01 EXE03 EXE04 EXE05 AGG15 AGG17 STR09", "SELECT s_suppkey::VARCHAR AS path, true AS lossless, true AS no_larger, 0::INTEGER AS status FROM supplier")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of three kinds recompressed at a level with models of content, by the cheapest plan of each stream, and restored.

    ``no_larger``: what doesn't get smaller is stored, so that an archive has at most its own heads more.
    """
    kinds = (_opus, _mod, _mp3)
    made = materialize(built(spark, sf_dir, lambda key: kinds[key % 3](key)), "codec-files")
    coded = materialize(codec.encode_files(made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"), level=15), "codec-archives")
    back = codec.decode_files(coded).select("path", F.col("content").alias("again"), F.col("status").alias("decoded"))
    both = made.join(coded.select("path", "coded", "status"), "path").join(back, "path")
    return both.select(
        "path",
        (F.col("content") == F.col("again")).alias("lossless"),
        (F.col("coded") <= F.col("length") + 64).alias("no_larger"),
        F.greatest("status", "decoded").alias("status"),
    )


def _put_book(w: LsbWriter, lengths: list[int]) -> None:
    w.write(0x564342, 24).write(2, 16).write(len(lengths), 24).write(0, 1).write(0, 1)
    for n in lengths:
        w.write(n - 1, 5)
    w.write(0, 4)


def _vorbis(key: int) -> bytes:
    """A link of two channels with one floor, residue, mapping and two modes, and packets of random bits."""
    rng = random.Random(key)
    w = LsbWriter().write(1, 8)
    _put_book(w, [1, 2, 3, 3])
    _put_book(w, [2, 2, 2, 2])
    w.write(0, 6).write(0, 16)
    w.write(0, 6).write(1, 16).write(1, 5).write(0, 4).write(0, 3).write(0, 2).write(1, 8).write(1, 2).write(4, 4).write(5, 4)
    w.write(0, 6).write(2, 16).write(0, 24).write(128, 24).write(15, 24).write(0, 6).write(0, 8).write(1, 3).write(0, 1).write(1, 8)
    w.write(0, 6).write(0, 16).write(0, 1).write(1, 1).write(0, 8).write(0, 1).write(1, 1).write(0, 2).write(0, 8).write(0, 8).write(0, 8)
    w.write(1, 6).write(0, 33).write(0, 8).write(1, 1).write(0, 32).write(0, 8).write(1, 1)
    ident = b"\x01vorbis" + bytes(4) + b"\x02" + (44100).to_bytes(4, "little") + bytes(12) + b"\x65\x01"
    comment = b"\x03vorbis" + bytes(8) + b"\x01"
    audio = [bytes([rng.randrange(128) * 2]) + rng.randbytes(20 + key % 10) for _ in range(4 + key % 5)]
    return ogg.build_stream([ident, comment, b"\x05vorbis" + w.bytes(), *audio], key)


@query("vorbis_symbols", "SRC24 SRC25 SRC34 FN14 MDL08", "SELECT s_suppkey::VARCHAR AS path, 4 + s_suppkey % 5 AS packets, true AS lossless FROM supplier")
def vorbis_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio packets as symbols of their link's grammar; the symbols give back the packets' bits."""
    packets = ogg.packets(ogg.pages(built(spark, sf_dir, _vorbis)))
    symbols = vorbis_audio.symbols(packets)
    heads = packets.where("pkt = 0").select("path", "link", F.col("data").alias("ident"))
    setups = packets.where("pkt = 2").select("path", "link", F.col("data").alias("setup"))
    listed = symbols.groupBy("path", "link", "pkt").agg(
        F.array_sort(F.collect_list(F.struct("seq", "site", "ch", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "book")), "value"))).alias("symbols")
    )
    whole = packets.where("pkt > 2").join(listed, ["path", "link", "pkt"]).join(heads, ["path", "link"]).join(setups, ["path", "link"])

    def one(row) -> tuple:
        g = vorbis_audio.grammar_of(bytes(row.ident), bytes(row.setup))
        found = [(s["site"], s["ch"], s["width"], None if s["book"] < 0 else s["book"], s["value"]) for s in row.symbols]
        bits, n = vorbis_audio.emit(found, g)
        return row.path, bits == int.from_bytes(bytes(row.data), "little") & ((1 << n) - 1)

    checked = models.map_rows(whole.select("path", "data", "symbols", "ident", "setup"), "path string, lossless boolean", one)
    return checked.groupBy("path").agg(F.count("*").alias("packets"), F.every("lossless").alias("lossless"))


@query("symbol_costs", "AGG01 MDL10 SRT02")
def symbol_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit accounting of Vorbis symbols by site: adaptive cost in the context of link, site and book, with a total.

    Values of a book are counted add-one over those it has met and one more, the sums rolled up by site.
    """
    symbols = vorbis_audio.symbols(ogg.packets(ogg.pages(built(spark, sf_dir, _vorbis))))
    context, order = ["path", "link", "site", "ch", "book"], ["pkt", "seq"]
    w = Window.partitionBy(*context).orderBy(*order)
    total = F.row_number().over(w) - 1
    seen = F.row_number().over(Window.partitionBy(*context, "value").orderBy(*order)) - 1
    bits = -F.log2((seen + 1).cast("double") / (total + 256))
    return (
        symbols.withColumn("bits", bits)
        .rollup("site")
        .agg(F.count("*").alias("symbols"), F.round(F.sum("bits") / 8, 6).alias("bytes"), F.round(F.avg("bits"), 6).alias("bits_per_symbol"))
        .select(F.coalesce("site", F.lit("TOTAL")).alias("component"), "symbols", "bytes", "bits_per_symbol")
    )

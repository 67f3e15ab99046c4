"""Queries over context mixing, module models, sample widths, spectra, books and their lookups."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.bits import MsbReader, MsbWriter
from strandflow.operators import coders, context, models, pool
from strandflow.plans.media import _vorbis, built, keys
from strandflow.registry import query
from strandflow.session import table
from strandflow.sources import celt_frame, mp3, mp3_code, mp3_spectra, ogg, opus, opus_code, opus_entropy, tracker, tracker_code, vorbis, vorbis_audio, vorbis_code

SLOTS = """
WITH p AS (SELECT user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '-') AS prev FROM events)
SELECT user_id, prev, event_type, least(count(*), 255)::INTEGER AS n, 1::INTEGER AS slots FROM p GROUP BY 1, 2, 3
"""


@query("hashed_slots", "JON14 FN09", SLOTS)
def hashed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's pairs of event types counted in hashed slots: with room for all, every context keeps one slot and its count."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = pdf.sort_values(["ts", "event_id"])["event_type"].tolist()
        slots, places = context.Slots(8), {}
        for prev, kind in zip(["-", *kinds], kinds, strict=False):
            i = slots.find(context.composite(context.ngram(prev.encode(), len(prev), 8), context.ngram(kind.encode(), len(kind), 8)))
            slots.update(i, 1)
            places.setdefault((prev, kind), set()).add(i)
        rows = [(pdf["user_id"].iloc[0], *k, max(slots.n[i] for i in v), len(v)) for k, v in places.items()]
        return pd.DataFrame(rows, columns=["user_id", "prev", "event_type", "n", "slots"])

    return events.groupBy("user_id").applyInPandas(run, "user_id long, prev string, event_type string, n int, slots int")


HASHED = """
SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) AS triples FROM lineitem GROUP BY 1
"""


@query("context_hashes", "FN09 JON15", HASHED)
def context_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite contexts by hash: as many hashes as contexts."""
    lines = table(spark, sf_dir, "lineitem")
    two, three = context.context_hash(F.col("l_partkey"), F.col("l_suppkey")), context.context_hash(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    return lines.groupBy("l_returnflag").agg(F.countDistinct(two).alias("pairs"), F.countDistinct(three).alias("triples"))


LAST = """
SELECT l_partkey AS key, max(l_orderkey * 8 + l_linenumber) AS last, dense_rank() OVER (ORDER BY l_partkey) AS place FROM lineitem GROUP BY l_partkey
"""


@query("last_per_key", "SRT05", LAST)
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, each with its last position: positions fold before the order is made, in ranges whose sizes place them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    last = lines.groupBy("key").agg(F.max("at").alias("last"))
    from strandflow.operators import layout

    ranked = layout.prefix_sum(last.withColumn("one", F.lit(1)), "key", "one")
    return ranked.select("key", "last", (F.col("before") + 1).alias("place"))


TEXTS = "SELECT item_id, true AS lossless, true AS smaller, strlen(coalesce(text, ''))::BIGINT AS payload FROM benchmark"


@query("mixed_texts", "MDL02 MDL03 MDL05 MDL07", TEXTS)
def mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through the two-layer context mixer and back, each smaller than under the order-1 model."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))

    def one(row) -> tuple:
        data = bytes(row.data)
        coded = context.mixed_bytes(data)
        return row.item_id, context.unmixed_bytes(coded, len(data)) == data, len(coded) <= len(models.code_bytes(data)), len(data)

    return models.map_rows(items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "item_id long, lossless boolean, smaller boolean, payload long", one)


def _ints(values) -> bytes:
    """Numbers as the JVM's models take them."""
    return np.asarray(values, "<i4").tobytes()


def _cells(key: int, channels: int = 4, rows: int = 64) -> bytes:
    rng = random.Random(key)
    riff = [[(rng.randrange(4), rng.choice([0, 428, 381]), rng.choice([0, 12]), rng.choice([0, 64])) for _ in range(channels)] for _ in range(8)]
    odd = lambda: (rng.randrange(32), rng.choice([428, 320, 254]), rng.randrange(16), rng.randrange(256))
    return b"".join(tracker_code.join_cell(*(riff[r % 8][c] if rng.random() < 0.85 else odd())) for r in range(rows) for c in range(channels))


PATTERNS = "SELECT s_suppkey::VARCHAR AS path, true AS lossless, true AS smaller, (256 + 64 * (s_suppkey % 3))::BIGINT AS cells FROM supplier"


@query("mod_patterns", "MDL22 WIN12 WIN13 JON11", PATTERNS)
def mod_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern cells coded by fields in the contexts of rows above and of the channel, and decoded; smaller than deflate makes them."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        channels = 4 + key % 3
        cells = _cells(key, channels)
        return str(key), channels, len(cells) // 4, cells, len(zlib.compress(cells, 9))

    made = models.map_rows(keys(spark, sf_dir), "path string, channels int, n int, data binary, deflated int", one)
    coded = made.withColumn("coded", coders.encode(spark, "patterns", F.col("data"), F.col("n"), F.col("channels")))
    again = coders.decode(spark, "patterns", F.col("coded"), F.col("n"), F.col("channels"))
    return coded.select("path", (again == F.col("data")).alias("lossless"), (F.length("coded") < F.col("deflated")).alias("smaller"), F.col("n").cast("long").alias("cells"))


EVENTS = "SELECT s_suppkey::VARCHAR AS path, true AS lossless, (22 + 64 + 2 * (8 + s_suppkey % 5))::BIGINT AS events FROM supplier"


@query("module_events", "MDL26 SRC30", EVENTS)
def module_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of packed IT, S3M and XM patterns, each unpacked from its bytes, coded and decoded."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        it = list(tracker.unpack_it(tracker.pack_it([(r, r % 4, 0, 40 + (r + key) % 20, 1 + r % 3, None, 1, r) for r in range(0, 64, 3)], 64), 64))
        s3m_raw = b"\0\0" + b"".join(bytes([32 | r % 8, 64 + (r * key) % 12, 1 + r % 3, 0]) for r in range(64))
        s3m = list(tracker.unpack_s3m(s3m_raw))
        xm_raw = b"".join(bytes([0x83, 49 + (r + key) % 12, 1]) for r in range(2 * (8 + key % 5)))
        xm = list(tracker.unpack_xm(xm_raw, 8 + key % 5, 2))
        return str(key), *(x for rows in (it, s3m, xm) for x in (len(rows), tracker_code.pack_events(rows)))

    names = ("it", "s3m", "xm")
    made = models.map_rows(keys(spark, sf_dir), "path string, " + ", ".join(f"{x}_n int, {x} binary" for x in names), one)
    again = [coders.decode(spark, "events", coders.encode(spark, "events", F.col(x), F.col(f"{x}_n")), F.col(f"{x}_n")) == F.col(x) for x in names]
    events = F.col("it_n") + F.col("s3m_n") + F.col("xm_n")
    return made.select("path", (again[0] & again[1] & again[2]).alias("lossless"), events.cast("long").alias("events"))


RECORDS = "SELECT s_suppkey::VARCHAR AS path, true AS lossless, (30 * (5 + s_suppkey % 9))::BIGINT AS bytes FROM supplier"


@query("module_records", "MDL21 MDL25 WIN21", RECORDS)
def module_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header records coded by place, in the contexts of the record before and of their own bytes, and decoded."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        n = 5 + key % 9
        return str(key), n, b"".join(f"sample {key} {i}".encode().ljust(22, b"\0") + (i * 100 + key).to_bytes(2, "big") + bytes([0, 64, 0, 0, 0, 1]) for i in range(n))

    made = models.map_rows(keys(spark, sf_dir), "path string, n int, data binary", one)
    again = coders.decode(spark, "records", coders.encode(spark, "records", F.col("data"), F.col("n"), 30), F.col("n"), 30)
    return made.select("path", (again == F.col("data")).alias("lossless"), F.length("data").cast("long").alias("bytes"))


def _wave(key: int, n: int, bits: int) -> list[int]:
    rng, half = random.Random(key), 1 << bits - 1
    x = v = 0.0
    out = []
    for _ in range(n):
        v = 0.95 * v - 0.02 * x + rng.gauss(0, half / 60)
        x += v
        out.append(min(half - 1, max(-half, round(x))))
    return out


SAMPLES = "SELECT s_suppkey::VARCHAR AS path, true AS lossless, true AS smaller, (400 + s_suppkey % 50)::BIGINT AS samples FROM supplier"


@query("module_samples", "MDL23 MDL24 WIN23", SAMPLES)
def module_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit samples, and 16-bit ones with another channel as reference, by a cascade of sign-LMS predictors, coded and decoded."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        n = 400 + key % 50
        small, left = _wave(key, n, 8), _wave(key + 1, n, 16)
        right = [min(32767, max(-32768, a + b)) for a, b in zip(left, _wave(key + 2, n, 10), strict=True)]
        return str(key), n, _ints(small), _ints(left), _ints(right)

    made = models.map_rows(keys(spark, sf_dir), "path string, n int, small binary, left binary, right binary", one)
    n, left, right = F.col("n"), F.col("left"), F.col("right")
    coded = made.withColumns({"a": coders.encode(spark, "samples", F.col("small"), n, 8), "b": coders.encode(spark, "samples", right, n, 16, left)})
    good = (coders.decode(spark, "samples", F.col("a"), n, 8) == F.col("small")) & (coders.decode(spark, "samples", F.col("b"), n, 16, left) == right)
    alone = F.length(coders.encode(spark, "samples", right, n, 16))
    smaller = (F.length("a") < n) & (F.length("b") < alone)
    return coded.select("path", good.alias("lossless"), smaller.alias("smaller"), n.cast("long").alias("samples"))


VOTES = "SELECT s_suppkey::VARCHAR AS path, true AS same_bytes, true AS voted, 1000 + s_suppkey % 100 AS samples FROM supplier"


@query("width_votes", "AGG16 MDL27 SNK12 SRC31", VOTES)
def width_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed samples of three encoders' habits: the vote names one that gives the bytes again from the samples alone."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        rng, n, wide, twice = random.Random(key), 1000 + key % 100, bool(key & 1), bool(key & 2)
        sizes = [rng.choice([1, 3, 5, 8]) for _ in range(n // 10 + 1)]
        values = [rng.randrange(-(1 << sizes[i // 10] - 1), 1 << sizes[i // 10] - 1) if sizes[i // 10] > 1 else 0 for i in range(n)]
        data = tracker_code.recompress(values, wide, twice, key % 3)
        policy, odd = tracker_code.canonical(data, n, wide, twice)
        again = tracker_code.recompress(tracker.decompress(data, 0, n, wide, twice), wide, twice, policy, odd)
        return str(key), again == data, policy is not None and not odd, n

    return models.map_rows(keys(spark, sf_dir), "path string, same_bytes boolean, voted boolean, samples long", one)


SPECTRA = """
WITH l AS (SELECT s_suppkey, unnest(range(0, 576)) AS i FROM supplier),
v AS (SELECT s_suppkey, i, CASE WHEN i < 40 + s_suppkey % 50 * 4 THEN (s_suppkey * 7 + i * i) % 7 - 3 WHEN i < 300 THEN (s_suppkey + i * i * 3) % 3 - 1 ELSE 0 END AS c FROM l)
SELECT s_suppkey::VARCHAR AS path, sum(abs(c))::BIGINT AS total, count(*) FILTER (WHERE c <> 0) AS lines, (max(i) FILTER (WHERE abs(c) > 1))::INTEGER // 2 + 1 AS big_values,
  true AS exact, true AS cheapest FROM v GROUP BY s_suppkey
"""


@query("mp3_spectra", "SRC29 JON16 JON17 AGG09 AGG10 FLT07", SPECTRA)
def mp3_spectra_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of known lines coded by the cheapest tables of three regions, with scalefactors, and parsed; the payload's estimate is its size."""
    t = mp3_spectra.Tables()

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        lines = [(key * 7 + i * i) % 7 - 3 if i < 40 + key % 50 * 4 else (key + i * i * 3) % 3 - 1 if i < 300 else 0 for i in range(576)]
        g = mp3_spectra.plan(t, lines, 44100)
        raw, bits = mp3_spectra.emit(t, lines, g, 44100)
        factors = [(key + i) % 8 for i in range(11)] + [(key * i) % 4 for i in range(10)]
        choice, w = mp3_spectra.least_choice(factors), MsbWriter()
        size = mp3_spectra.write_scalefactors(w, factors, choice, [0] * 4, True)
        back = mp3_spectra.scalefactors(MsbReader(w.bytes() + b"\0"), choice, [0] * 4, None) == (factors, size)
        again = mp3_spectra.spectrum(t, MsbReader(raw + b"\0\0"), g, 44100, bits)
        exact = back and again == lines and mp3_spectra.payload_estimate(t, lines, g, 44100) == bits
        a, _ = mp3_spectra.regions(44100, 2 * g["big_values"], g["region0"], g["region1"])
        cheapest = all(
            mp3_spectra.region_bits(t, g["table_select"][0], lines[:a]) <= mp3_spectra.region_bits(t, k, lines[:a]) for k in t.pairs
        )
        return str(key), sum(map(abs, again)), sum(v != 0 for v in again), g["big_values"], exact, cheapest

    schema = "path string, total long, lines long, big_values int, exact boolean, cheapest boolean"
    return models.map_rows(keys(spark, sf_dir), schema, one)


@query("book_pool", "JON05 STR10")
def book_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of chains (vectors of a label as code lengths, twenty a link) in a pool of bounded size, with near hits, replacement and decay."""
    lengths = F.transform(F.slice("embedding", 1, 16), lambda x: (F.abs(x) * 12).cast("int"))
    books = table(spark, sf_dir, "embeddings").where("embedding is not null").select(
        F.col("label").cast("long").alias("chain"), F.floor(F.col("vec_id") / 20).alias("link"), F.col("vec_id").alias("seq"), lengths.alias("lengths")
    )
    return pool.pooled(books)


def _comment(key: int) -> bytes:
    text = lambda b: len(b).to_bytes(4, "little") + b
    head = b"\x03vorbis" if key % 2 else b"OpusTags"
    tags = [f"TITLE=song {key}".encode(), b"ARTIST=\xc3\xa9", b"empty="][: key % 4]
    body = head + text(b"maker") + len(tags).to_bytes(4, "little") + b"".join(map(text, tags))
    return body[: -1 - key % 3] if key % 5 == 0 else body + b"\x01"  # every fifth is cut


COMMENTS = """
SELECT s_suppkey::VARCHAR AS path, s_suppkey % 5 <> 0 AS structured, (CASE WHEN s_suppkey % 5 <> 0 THEN least(3, s_suppkey % 4) ELSE -1 END)::INTEGER AS comments FROM supplier
"""


@query("structured_comments", "FLT09 FN22", COMMENTS)
def structured_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which comment packets are well formed, and how many comments those have (-1 for none)."""

    def one(row) -> tuple:
        found = vorbis.parse_comments(bytes(row.content))
        return row.path, found is not None, -1 if found is None else len(found[1])

    return models.map_rows(built(spark, sf_dir, _comment), "path string, structured boolean, comments int", one)


def _paged(key: int) -> bytes:
    """A link whose audio packets have known modes: packets are longer than a page of four segments every third time."""
    packets = [bytes([(key + k) % 2 * 2]) * (30 if k % 3 else 1500) for k in range(6 + key % 7)]
    return ogg.build_stream([b"\x01vorbis" + bytes(20), b"\x03vorbis", b"\x05vorbis", *packets], key, segments=4)


PAGE_SAMPLES = """
WITH p AS (SELECT s_suppkey, unnest(range(0, 6 + s_suppkey % 7)) AS k FROM supplier)
SELECT s_suppkey::VARCHAR AS path, sum(CASE WHEN (s_suppkey + k) % 2 = 1 THEN 1024 ELSE 128 END)::BIGINT AS samples, count(*) AS packets, true AS in_order FROM p GROUP BY 1
"""


@query("page_samples", "WIN04 WIN02", PAGE_SAMPLES)
def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a page: of each audio packet that ends on it, half the block size of the packet's mode; what is continued counts where it ends."""
    pages = ogg.pages(built(spark, sf_dir, _paged))
    ends = ogg.page_samples(pages, {0: 128, 1: 1024})
    return ends.groupBy("path").agg(
        F.sum("samples").alias("samples"), F.sum("audio").alias("packets"), F.every(F.col("samples") >= 0).alias("in_order")
    )


LSF = """
WITH c AS (SELECT DISTINCT p_partkey % 512 AS choice FROM part), h AS (SELECT choice, choice >> 1 AS h FROM c)
SELECT choice,
  CASE WHEN choice < 400 THEN (choice >> 4) // 5 WHEN choice < 500 THEN ((choice - 400) >> 2) // 5 ELSE (choice - 500) // 3 END AS s0,
  CASE WHEN choice < 400 THEN (choice >> 4) % 5 WHEN choice < 500 THEN ((choice - 400) >> 2) % 5 ELSE (choice - 500) % 3 END AS s1,
  CASE WHEN choice < 400 THEN (choice & 15) >> 2 WHEN choice < 500 THEN choice & 3 ELSE 0 END AS s2,
  CASE WHEN choice < 400 THEN choice & 3 ELSE 0 END AS s3,
  CASE WHEN h < 180 THEN h // 36 WHEN h < 244 THEN ((h - 180) & 63) >> 4 ELSE (h - 244) // 3 END AS i0,
  CASE WHEN h < 180 THEN h % 36 // 6 WHEN h < 244 THEN ((h - 180) & 15) >> 2 ELSE (h - 244) % 3 END AS i1,
  CASE WHEN h < 180 THEN h % 36 % 6 WHEN h < 244 THEN (h - 180) & 3 ELSE 0 END AS i2 FROM h
"""


@query("lsf_scalefactors", "FN24", LSF)
def lsf_scalefactors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalefactor lengths of half-rate granules by their choice, with and without intensity stereo."""
    choices = table(spark, sf_dir, "part").select((F.col("p_partkey") % 512).alias("choice")).distinct()
    plain, intensity = (mp3_spectra.lsf_lengths(F.col("choice"), x) for x in (False, True))
    return choices.select("choice", *(c.alias(f"s{k}") for k, c in enumerate(plain)), *(c.alias(f"i{k}") for k, c in enumerate(intensity[:3])))


def _free(key: int) -> bytes:
    """Frames without a bitrate, of a size that only the distance to the next header tells; every other one is padded."""
    size = 150 + key % 60
    frames = [bytes([0xFF, 0xFB, 2 * (k & 1), 0x40]) + bytes(32) + bytes([k + 1]) * (size - 36 + (k & 1)) for k in range(8 + key % 5)]
    return bytes(key % 4) + b"".join(frames)


FREE = """
SELECT s_suppkey::VARCHAR AS path, 8 + s_suppkey % 5 AS frames, s_suppkey % 4 AS first_at, (150 + s_suppkey % 60)::INTEGER AS size, ((8 + s_suppkey % 5) // 2)::BIGINT AS padded FROM supplier
"""


@query("mp3_free_format", "JON19 SRC16", FREE)
def mp3_free_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of free format: frame sizes found by the next header that equals the first in its fixed bits."""
    found = mp3.frames(built(spark, sf_dir, _free))
    return found.groupBy("path").agg(
        F.count("*").alias("frames"), F.min("at").alias("first_at"), F.min("frame_bytes").alias("size"), F.count_if("pad").alias("padded")
    )


def _reservoir(key: int) -> bytes:
    """Frames whose payloads of a known size each begin where the one before ends, so that room is saved up frame by frame."""
    need, out = 300 + key % 40, []
    for k in range(5 + key % 2):
        w = MsbWriter()
        w.write(k * (381 - need), 9)
        w.write(0, 11)
        w.write(need * 8 if need * 8 < 4096 else 4095, 12)
        side = w.bytes().ljust(32, b"\0")
        out.append(b"\xff\xfb\x90\x40" + side + bytes(381))
    return b"".join(out)


RESERVOIR = """
WITH f AS (SELECT s_suppkey, 300 + s_suppkey % 40 AS need, unnest(range(0, 5 + s_suppkey % 2)) AS k FROM supplier)
SELECT s_suppkey::VARCHAR AS path, k AS frame, k * (381 - need) AS main_data_begin, k * need AS payload_at, true AS fits, 381 * (k + 1) - need * (k + 1) AS saved FROM f
"""


@query("mp3_reservoir", "WIN17 SNK08", RESERVOIR)
def mp3_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame's payload lies in the stream of all frames' rooms, whether it fits, and the room that is left for later frames."""
    found = mp3.frames(built(spark, sf_dir, _reservoir))
    room = (F.col("frame") + 1) * 381 - F.col("payload_at") - F.ceil(F.col("payload_bits") / 8)
    return found.select("path", "frame", F.col("main_data_begin").cast("long").alias("main_data_begin"), "payload_at", "fits", room.alias("saved"))


VORBIS_MODEL = "SELECT s_suppkey::VARCHAR AS path, 4 + s_suppkey % 5 AS packets, true AS lossless FROM supplier"


@query("vorbis_model", "MDL08 MDL09", VORBIS_MODEL)
def vorbis_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio packets of links coded by their symbols in the contexts of sites, channels and the packet before, and decoded."""
    packets = ogg.packets(ogg.pages(built(spark, sf_dir, _vorbis)))
    links = packets.groupBy("path", "link").agg(F.transform(F.array_sort(F.collect_list(F.struct("pkt", "data"))), lambda x: x["data"]).alias("packets"))

    def one(row) -> tuple:
        ident, _, setup, *audio = map(bytes, row.packets)
        g = vorbis_audio.grammar_of(ident, setup)
        return row.path, len(audio), vorbis_code.decode_packets(g, vorbis_code.code_packets(g, audio), len(audio)) == audio

    return models.map_rows(links, "path string, packets long, lossless boolean", one)


GRANULE_MODEL = "SELECT s_suppkey::VARCHAR AS path, (2 + s_suppkey % 3)::BIGINT AS granules, true AS lossless FROM supplier"


@query("granule_model", "MDL19 MDL20", GRANULE_MODEL)
def granule_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granules coded by side information and lines, decoded, and their payloads made again bit by bit."""
    t = mp3_spectra.Tables()

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        rng, given = random.Random(key), []
        lines = [rng.choice([0, 0, 1, -1, 2]) if i < 60 else rng.choice([0, 0, 0, 1]) if i < 140 else 0 for i in range(576)]
        for _ in range(2 + key % 3):
            g = mp3_spectra.plan(t, lines, 44100) | {"global_gain": 160, "scalefac": 3}
            given.append((g, *mp3_spectra.emit(t, lines, g, 44100)))
        return str(key), len(given), mp3_code.pack_granules(t, given, 44100), [raw for _, raw, _ in given], [bits for _, _, bits in given]

    def again(row) -> tuple:
        made = mp3_code.unpack_granules(t, bytes(row.back), 44100)
        return row.path, row.n, [(bytes(raw), bits) for _, raw, bits in made] == list(zip(map(bytes, row.payloads), row.bits, strict=True))

    made = models.map_rows(keys(spark, sf_dir), "path string, n int, data binary, payloads array<binary>, bits array<int>", one)
    edges = F.lit(_ints(mp3_spectra.BANDS[44100]))
    back = coders.decode(spark, "granules", coders.encode(spark, "granules", F.col("data"), F.col("n"), None, edges), F.col("n"), None, edges)
    return models.map_rows(made.select("path", "n", "payloads", "bits", back.alias("back")), "path string, granules long, lossless boolean", again)


OPERATIONS = "SELECT s_suppkey::VARCHAR AS path, (40 + s_suppkey % 30)::BIGINT AS operations, true AS values_again, true AS bytes_again, (s_suppkey % 2)::BIGINT AS patches FROM supplier"


@query("opus_operations", "MDL11 MDL12 MDL17 FN17", OPERATIONS)
def opus_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-coded operations of each kind: read from a frame's bytes, replayed to the same bytes or to ones that a patch mends, coded by site and decoded."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        rng, n = random.Random(key), 40 + key % 30
        kinds = [("logp", (2,)), ("icdf", ((200, 100, 20, 0), 8)), ("uint", (1000,)), ("bits", (5,)), ("laplace", (6000, 8000))]
        ops = []
        for i in range(n):
            kind, params = kinds[rng.randrange(5)]
            v = {"logp": rng.randrange(2), "icdf": rng.randrange(4), "uint": rng.randrange(1000), "bits": rng.randrange(32), "laplace": rng.choice([0, 0, 1, -2])}[kind]
            ops.append(opus_entropy.Operation(kind, f"{kind}{i % 3}", params, v))
        frame = bytearray(opus_entropy.replay(ops, 300))
        frame[150] ^= key % 2  # a byte that no operation reads
        d = opus_entropy.Decoder(bytes(frame))
        values = [getattr(d, op.kind)(op.site, *op.params) for op in ops] == [op.value for op in ops]
        patch = opus_entropy.differences(bytes(frame), d.record)
        made = bytearray(opus_entropy.replay(d.record, 300))
        for at, byte in patch:
            made[at] = byte
        shapes, given = opus_entropy.pack_operations(ops)
        return str(key), n, values, made == frame, len(patch), shapes, given

    schema = "path string, operations long, read boolean, bytes_again boolean, patches long, shapes binary, given binary"
    made = models.map_rows(keys(spark, sf_dir), schema, one)
    coded = coders.encode(spark, "operations", F.col("given"), None, None, F.col("shapes"))
    again = coders.decode(spark, "operations", coded, None, None, F.col("shapes")) == F.col("given")
    return made.select("path", "operations", (F.col("read") & again).alias("values_again"), "bytes_again", "patches")


def _celt_tables() -> celt_frame.CeltTables:
    """Tables of the standard's shape, by a rule: the real ones are their caller's."""
    energy = tuple(tuple(tuple((40 + 5 * j + 3 * size, 60 + 4 * j + 20 * intra) for j in range(celt_frame.BANDS)) for intra in range(2)) for size in range(4))
    return celt_frame.CeltTables(energy, tuple(tuple(0 if not q else min(200, 20 * q + max(0, 60 - 4 * j)) for j in range(celt_frame.BANDS)) for q in range(11)))


def _celt_packet(key: int, k: int, tables: celt_frame.CeltTables) -> bytes:
    rng = random.Random(100 * key + k)

    def choose(kind: str, site: str, params: tuple) -> int:
        if kind == "logp":
            return int(site != "silence" and rng.random() < 2.0 ** -params[0])
        if kind == "laplace":
            return rng.choice([0, 0, 1, -1])
        return rng.randrange(len(params[0]) if kind == "icdf" else 1 << params[0] if kind == "bits" else params[0] + (kind != "uint"))

    toc = (16 + (key + k) % 16) << 3 | key % 2 << 2
    size, channels, end = opus_code.celt_shape(toc)
    writer = celt_frame.Writer(choose)
    celt_frame.walk(writer, 50 + key % 40, tables, size, channels, 0, end)
    return opus.build_packet(toc, [writer.finish(50 + key % 40)])


CELT = "SELECT s_suppkey::VARCHAR AS path, 4::BIGINT AS packets, 4 * (50 + s_suppkey % 40) AS frame_bytes, true AS replayed, true AS lossless FROM supplier"


@query("celt_frames", "SRC27 SRC28 MDL12 MDL13 MDL16 MDL17", CELT)
def celt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of CELT read by their grammar: operations that replay to the frames' bytes, and packets coded by them and decoded."""

    def one(row) -> tuple:
        key, tables = int(row.s_suppkey), _celt_tables()
        packets = [_celt_packet(key, k, tables) for k in range(4)]
        replayed, size = True, 0
        for p in packets:
            shape = opus_code.celt_shape(p[0])
            for f in opus.split_packet(p)[0]:
                _, record = celt_frame.parse(f, tables, shape[0], shape[1], 0, shape[2])
                replayed, size = replayed and opus_entropy.replay(record, len(f)) == f, size + len(f)
        back = opus_code.decode_packets(opus_code.code_packets(packets, tables), [(p[0], 1) for p in packets], tables)
        return str(key), len(packets), size, replayed, back == packets

    return models.map_rows(keys(spark, sf_dir), "path string, packets long, frame_bytes long, replayed boolean, lossless boolean", one)

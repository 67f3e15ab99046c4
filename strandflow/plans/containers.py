"""Queries over views of files, pages and their shapes, module layouts, packets of several streams and text fields."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.operators import coders, context, layout, lookup, models, sequence
from strandflow.plans.events import ORDER, USER, events, ordered_fold
from strandflow.plans.media import _chain, _it, _opus, built, keys
from strandflow.registry import query
from strandflow.session import table
from strandflow.sources import mp3, ogg, opus, tracker, vorbis

SPLICE_READS = """
WITH e AS (SELECT o_orderkey, 1 + o_orderkey % 97 AS len FROM orders),
x AS (SELECT o_orderkey, len, coalesce(sum(len) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM e),
p AS (SELECT p_partkey, p_partkey * 61 AS place FROM part)
SELECT p_partkey, place, coalesce(o_orderkey, -1) AS owner, coalesce(place - off, -1) AS inside FROM p LEFT JOIN x ON place >= off AND place < off + len
"""


@query("splice_reads", "SRC03 SRC04 SRC05 SET02", SPLICE_READS)
def splice_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a spliced view by logical offset: the extent that owns each, and the place in it (-1 behind the end)."""
    extents = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 97).alias("len"))
    placed = layout.prefix_sum(extents, "o_orderkey", "len")
    owners = placed.select(F.col("before").alias("lo"), (F.col("before") + F.col("len") - 1).alias("hi"), F.col("o_orderkey").alias("owner"), F.col("before").alias("off"))
    probes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 61).alias("place"))
    inside = F.coalesce(F.col("place") - F.col("off"), F.lit(-1))
    return lookup.range_lookup(probes, "place", owners).select("p_partkey", "place", F.coalesce("owner", F.lit(-1)).alias("owner"), inside.alias("inside"))


SHAPES = "SELECT s_suppkey::VARCHAR AS path, true AS same_bytes, true AS replayed FROM supplier"


@query("page_shapes", "SNK05 SNK06 SNK07 SNK11 JON01", SHAPES)
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made again from packets and page shapes; the copies in a chain made again from the link that they repeat, under their serials; modules laid out anew."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        data = _opus(key)
        pages, _ = ogg.parse(data)
        held, packets = b"", []
        for p in pages:
            at = 0
            for n in p.lace:
                held, at = held + p.body[at : at + n], at + n
                if n < 255:
                    packets.append(held)
                    held = b""
        same = b"".join(ogg.from_skeletons(packets, ogg.skeletons(pages))) == data
        chain = _chain(key)
        links: dict[int, list] = {}
        for p in ogg.parse(chain)[0]:
            links.setdefault(p.serial, []).append(p)
        serials = sorted(links)
        again = b"".join(b"".join(ogg.under_serial(p, s) for p in links[serials[k % 2]]) for k, s in enumerate(serials))
        module = _it(key)
        n = sum(e.state == "PRI" for e in tracker.it_entities(module))
        moved = tracker.move_it(module, list(range(n))[::-1])
        kinds = lambda m: sorted((e.kind, e.idx, e.state, e.alias_of, m[e.off : e.off + e.len] if e.state == "PRI" else b"") for e in tracker.it_entities(m))
        return str(key), same and kinds(moved) == kinds(module), again == chain

    return models.map_rows(keys(spark, sf_dir), "path string, same_bytes boolean, replayed boolean", one)


HEADER_PAGES = """
SELECT s_suppkey::VARCHAR AS path, (2 + s_suppkey % 3)::BIGINT AS headers, (1 + s_suppkey % 4)::BIGINT AS others FROM supplier
"""


def _headed(key: int) -> bytes:
    """Pages of header packets, then pages of audio packets, of which one carries a header packet too."""
    pages = [ogg.build_page(2 if k == 0 else 0, 0, key, k, [4], b"\x01abc") for k in range(2 + key % 3)]
    at = len(pages)
    pages += [ogg.build_page(0, 5, key, at + k, [3, 2] if k else [2, 3], b"\x02ab\x04c" if k else b"\x05c\x02ab") for k in range(1 + key % 4)]
    return b"".join(pages)


@query("header_pages", "FLT03 SRC13", HEADER_PAGES)
def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold header packets only, and others."""
    found = ogg.header_pages(ogg.pages(built(spark, sf_dir, _headed)))
    return found.groupBy("path").agg(F.count_if("headers").alias("headers"), F.count_if(~F.col("headers")).alias("others"))


RESYNC = """
SELECT s_suppkey::VARCHAR AS path, (12 + s_suppkey % 5)::BIGINT AS frames, 2::BIGINT AS runs, (100 + s_suppkey % 400)::BIGINT AS junk FROM supplier
"""


def _broken_run(key: int) -> bytes:
    frame = b"\xff\xfb\x90\x40" + bytes(32) + bytes([7]) * 381
    return frame * 6 + bytes([9]) * (100 + key % 400) + frame * (6 + key % 5)


@query("mp3_resync", "SRC17 SET04 STR05", RESYNC)
def mp3_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames on both sides of damage: reading goes on at the next frame that others follow, what lies between is kept raw."""
    made = built(spark, sf_dir, _broken_run)
    frames = mp3.frames(made).groupBy("path").agg(F.count("*").alias("frames"))
    parts = mp3.segments(made).groupBy("path").agg(F.count_if(F.col("kind") == "RUN").alias("runs"), F.sum(F.when(F.col("kind") != "RUN", F.col("len")).otherwise(0)).alias("junk"))
    return frames.join(parts, "path")


FIELDS = """
WITH f AS (SELECT * FROM (VALUES ('title', 20), ('sample_name', 22 * 31), ('length', 62), ('finetune', 31), ('volume', 31), ('loop', 62), ('loop_length', 62),
  ('song_length', 1), ('restart', 1), ('orders', 128), ('tag', 4)) t(field, n)),
g AS (SELECT * FROM (VALUES ('title', 20), ('sample_name', 22 * 15), ('length', 30), ('finetune', 15), ('volume', 15), ('loop', 30), ('loop_length', 30),
  ('song_length', 1), ('restart', 1), ('orders', 128)) t(field, n))
SELECT 31 AS samples, field, n::BIGINT AS n FROM f UNION ALL SELECT 15, field, n::BIGINT FROM g
"""


@query("header_fields", "SRC21 SRC20", FIELDS)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each byte of a module's header with its field, for both kinds of header."""
    offsets = spark.range(1084).select(F.explode(F.array(F.lit(31), F.lit(15))).alias("samples"), F.col("id").cast("int").alias("offset"))

    def one(row) -> tuple:
        found = tracker.header_field(row.offset, row.samples)
        return row.samples, found[0] if found else None

    named = models.map_rows(offsets, "samples int, field string", one).where("field is not null")
    return named.groupBy("samples", "field").agg(F.count("*").alias("n"))


STREAMS = """
SELECT s_suppkey::VARCHAR AS path, (1 + s_suppkey % 3)::BIGINT AS streams, ((1 + s_suppkey % 3) * (1 + s_suppkey % 2))::BIGINT AS frames, true AS joined FROM supplier
"""


@query("opus_multistream", "SRC23 SRC22", STREAMS)
def opus_multistream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of several streams, all but the last of which tell their own length: split into frames and joined again."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        rng = random.Random(key)
        streams = [(31 << 3, [rng.randbytes(rng.randrange(1, 400)) for _ in range(1 + key % 2)]) for _ in range(1 + key % 3)]
        data = opus.join_streams(streams)
        found = opus.split_streams(data, len(streams))
        return str(key), len(found), sum(len(f) for _, f in found), [f for _, f in found] == [f for _, f in streams] and opus.join_streams(found) == data

    return models.map_rows(keys(spark, sf_dir), "path string, streams long, frames long, joined boolean", one)


REPACKED = "SELECT s_suppkey::VARCHAR AS path, true AS s3m, true AS xm, (64 + 8 * (1 + s_suppkey % 4))::BIGINT AS events FROM supplier"


@query("patterns_repacked", "SNK10 SRC30", REPACKED)
def patterns_repacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3M and XM patterns unpacked and packed again: those in the usual form give their bytes."""

    def one(row) -> tuple:
        key = int(row.s_suppkey)
        rng = random.Random(key)
        s3m = b"".join(bytes([mask | r % 32]) + rng.randbytes(2 * (mask >> 5 & 1) + (mask >> 6 & 1) + 2 * (mask >> 7)) + b"\0" for r in range(64) for mask in (rng.choice([32, 64, 96, 128, 224]),))
        s3m = (len(s3m) + 2).to_bytes(2, "little") + s3m
        rows, masks = 8, [rng.choice([1, 3, 16, 24, 31]) for _ in range(8 * (1 + key % 4))]
        xm = b"".join((b"" if m == 31 else bytes([128 | m])) + bytes(rng.randrange(1, 96) for _ in range(m.bit_count())) for m in masks)
        a, b = list(tracker.unpack_s3m(s3m)), list(tracker.unpack_xm(xm, rows, 1 + key % 4))
        return str(key), tracker.pack_s3m(a) == s3m, tracker.pack_xm(b, rows, 1 + key % 4) == xm, len(a) + len(b)

    return models.map_rows(keys(spark, sf_dir), "path string, s3m boolean, xm boolean, events long", one)


PCM = """
SELECT p_partkey, CASE WHEN a > 127 THEN a - 256 ELSE a END AS signed8, a - 128 AS unsigned8, CASE WHEN le > 32767 THEN le - 65536 ELSE le END AS little16,
  CASE WHEN be > 32767 THEN be - 65536 ELSE be END AS big16, CASE WHEN (a + b) % 256 > 127 THEN (a + b) % 256 - 256 ELSE (a + b) % 256 END AS delta8
FROM (SELECT p_partkey, a, b, a + 256 * b AS le, 256 * a + b AS be FROM (SELECT p_partkey, p_partkey * 37 % 256 AS a, p_size * 41 % 256 AS b FROM part))
"""


@query("pcm_values", "SRC32 SRC05", PCM)
def pcm_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample values of two raw bytes in each layout: signed, unsigned, both byte orders, and differences."""

    def one(row) -> tuple:
        raw = bytes([row.p_partkey * 37 % 256, row.p_size * 41 % 256])
        d = tracker.decode_pcm
        return row.p_partkey, d(raw, False)[0], d(raw, False, signed=False)[0], d(raw, True)[0], d(raw, True, big=True)[0], d(raw, False, delta=True)[1]

    schema = "p_partkey long, signed8 long, unsigned8 long, little16 long, big16 long, delta8 long"
    return models.map_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), schema, one)


NGRAMS = """
WITH g AS (SELECT user_id, event_id, ts, lag(event_type, 2) OVER w AS a, lag(event_type) OVER w AS b, event_type AS c, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(i - lag(i) OVER (PARTITION BY user_id, a, b, c ORDER BY ts, event_id), 0) AS distance FROM g WHERE a IS NOT NULL
"""


@query("ngram_matches", "JON12 JON10 FN09", NGRAMS)
def ngram_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far back a user's last three events stood together before, by a hash of the three that rolls along, checked against them; 0 if never."""
    w = sequence.ordered(USER, ORDER)
    grams = events(spark, sf_dir).select(*USER, *ORDER, F.lag("event_type", 2).over(w).alias("a"), F.lag("event_type").over(w).alias("b"), F.col("event_type").alias("c"), F.row_number().over(w).alias("i"))
    grams = grams.where("a is not null").withColumn("h", context.context_hash(F.col("a"), F.col("b"), F.col("c")))
    same = W.partitionBy(*USER, "h").orderBy(*ORDER)
    held = grams.withColumn("at", F.lag("i").over(same)).withColumn("was", F.lag(F.struct("a", "b", "c")).over(same))
    found = F.when(F.col("was") == F.struct("a", "b", "c"), F.col("i") - F.col("at"))
    return held.select("event_id", F.coalesce(found, F.lit(0)).cast("long").alias("distance"))


NUMBERS = "SELECT user_id, count(*) AS n, true AS lossless FROM events GROUP BY user_id"


@query("coded_numbers", "WIN10 MDL04 WIN01", NUMBERS)
def coded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of a user's values in hundredths as numbers of sign, length and bits, coded and decoded."""
    rows = events(spark, sf_dir).select(*USER, *ORDER, F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("v"))

    listed = ordered_fold(rows, F.col("v"), list, list.append, lambda values: (np.array(values, "<i8").tobytes(),), "data binary")
    n = F.col("n").cast("int")
    again = coders.decode(spark, "numbers", coders.encode(spark, "numbers", F.col("data"), n), n)
    return listed.select("user_id", "n", (again == F.col("data")).alias("lossless"))


@query("frequency_cost", "WIN09 AGG01")
def frequency_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each user's event types under adaptive frequencies that halve at a cap."""
    kinds = ["click", "purchase", "signup", "view"]
    index = F.coalesce(*(F.when(F.col("event_type") == k, i) for i, k in enumerate(kinds)), F.lit(len(kinds)))

    def step(state: list, symbol: int) -> None:
        state[1] += state[0].cost(symbol)
        state[0].update(symbol)

    out = ordered_fold(events(spark, sf_dir), index, lambda: [models.FrequencyTable(5, cap=256), 0.0], step, lambda s: (s[1],), "bits double")
    return out.select("user_id", "n", F.round("bits", 6).alias("bits"))


FIXED = """
SELECT l_orderkey, l_linenumber, floor(log2(l_partkey + 1) * 256 + 1e-6)::BIGINT AS log_fixed, floor(log2(l_partkey + 1) * 4 + 1e-6)::BIGINT AS bucket,
  least(greatest(l_partkey - l_suppkey, -16), 16) AS clamped FROM lineitem
"""


@query("log_buckets", "FN05 FN07 FN08", FIXED)
def log_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms in 1/256, and as buckets of four to an octave."""
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(F.log2(p + 1) * 256 + 1e-6).alias("log_fixed"), F.floor(F.log2(p + 1) * 4 + 1e-6).alias("bucket"),
        F.least(F.greatest(p - F.col("l_suppkey"), F.lit(-16)), F.lit(16)).alias("clamped"),
    )


VENDORS = """
WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'libopus 1.' || s_suppkey WHEN 1 THEN 'Lavc58.' || s_suppkey WHEN 2 THEN 'Lavf60' ELSE 'maker' END AS vendor,
  CASE s_suppkey % 3 WHEN 0 THEN 'Title=a=b' || s_suppkey WHEN 1 THEN 'no sign' ELSE '=empty' END AS comment FROM supplier)
SELECT s_suppkey, CASE WHEN starts_with(vendor, 'libopus') THEN 'libopus' WHEN starts_with(vendor, 'Lav') THEN 'lavc' ELSE 'other' END AS vendor_class,
  CASE WHEN strpos(comment, '=') > 0 THEN upper(substr(comment, 1, strpos(comment, '=') - 1)) END AS key,
  CASE WHEN strpos(comment, '=') > 0 THEN substr(comment, strpos(comment, '=') + 1) END AS value FROM c
"""


@query("comment_fields", "FN20 FN22", VENDORS)
def comment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of encoders by their vendor strings; comments split at their first sign, keys without case."""
    k = F.col("s_suppkey")
    vendor = F.when(k % 4 == 0, F.concat(F.lit("libopus 1."), k)).when(k % 4 == 1, F.concat(F.lit("Lavc58."), k)).when(k % 4 == 2, "Lavf60").otherwise("maker")
    comment = F.when(k % 3 == 0, F.concat(F.lit("Title=a=b"), k)).when(k % 3 == 1, "no sign").otherwise("=empty")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", vendor.alias("vendor"), comment.alias("comment"))
    key, value = vorbis.comment_parts(F.col("comment"))
    return rows.select("s_suppkey", vorbis.vendor_class(F.col("vendor")).alias("vendor_class"), key.alias("key"), value.alias("value"))

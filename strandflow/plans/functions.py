"""Queries over scalar functions and small ordered-sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import bits, celt, scalars
from strandflow.operators import models, sequence
from strandflow.registry import query
from strandflow.session import table

SCALARS = """
SELECT p_partkey, (p_partkey % 256) + 256 * (p_size % 256) AS le16, 256 * (p_partkey % 256) + (p_size % 256) AS be16,
  round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS squashed, round(ln((p_size + 1) / 60.0 / (1 - (p_size + 1) / 60.0)), 6) AS stretched,
  CASE WHEN p_size > 25 THEN CASE WHEN p_partkey % 7 > 3 THEN p_size - 25 ELSE p_size - 25 + p_partkey % 7 - 3 END
    ELSE CASE WHEN p_partkey % 7 > 3 THEN p_size - 25 ELSE p_size - 25 - (p_partkey % 7 - 3) END END AS left_,
  CASE WHEN p_size > 25 THEN CASE WHEN p_partkey % 7 > 3 THEN p_size - 25 - (p_partkey % 7 - 3) ELSE p_size - 25 END
    ELSE CASE WHEN p_partkey % 7 > 3 THEN p_size - 25 + p_partkey % 7 - 3 ELSE p_size - 25 END END AS right_,
  CASE WHEN p_size >= 30 THEN 10 + (p_size - 10) * 3 // 10 ELSE 10 + p_size // 10 END AS banded,
  CASE WHEN p_size % 256 >= 254 THEN 0 ELSE p_size % 16 + 12 * (p_size // 16) + 1 END AS note,
  regexp_replace(p_name, ' ', '_', 'g') || '.sfa' AS out_name
FROM part
"""


@query("scalar_functions", "FN04 FN06 FN11 FN12 FN21 FN23 SRC05 SRC34", SCALARS)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to numbers, logistic functions, stereo uncoupling, pitches and names."""
    key, size = F.col("p_partkey"), F.col("p_size")
    one = lambda x: F.unhex(F.lpad(F.hex(x % 256), 2, "0"))
    data = F.concat(one(key), one(size))
    p = (size + 1) / 60.0
    left, right = scalars.uncouple(size - 25, key % 7 - 3)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.uint_le(data, 0, 2).alias("le16"),
        scalars.uint_be(data, 0, 2).alias("be16"),
        F.round(scalars.squash((size - 25) / 10.0), 6).alias("squashed"),
        F.round(scalars.stretch(p), 6).alias("stretched"),
        left.alias("left_"),
        right.alias("right_"),
        F.when(size >= 30, 10 + F.floor((size - 10) * 3 / 10)).otherwise(10 + F.floor(size / 10)).alias("banded"),
        scalars.s3m_note(size % 256).alias("note"),
        scalars.out_name(F.col("p_name")).alias("out_name"),
    )


EXACT = """
WITH RECURSIVE u AS (  -- vectors of n whole numbers whose magnitudes sum to k, a row of k = 0..6 for each n
    SELECT 0 AS n, [1, 0, 0, 0, 0, 0, 0]::BIGINT[] AS c
    UNION ALL SELECT n + 1, [list_sum(list_transform(range(0, k + 1), lambda j: c[k - j + 1] * CASE WHEN j = 0 THEN 1 ELSE 2 END)) for k in range(0, 7)]::BIGINT[] FROM u WHERE n < 7),
p AS (SELECT p_partkey, p_size, 1 + p_partkey % 7 AS n, 1 + p_size % 6 AS k, p_partkey * 37 % 16384 AS x, p_size - 25 AS v, p_size % 9 AS t FROM part),
q AS (SELECT *, (4096 + x * x) >> 13 AS y FROM p),
r AS (SELECT *, (16384 - 626 * y) >> 15 AS z FROM q),
w AS (SELECT *, (16384 + y * (8277 + z)) >> 15 AS a FROM r),
l AS (  -- steps of the Laplace density: magnitude m begins at low with size
    SELECT 1 AS m, 6000 AS low, ((32768 - 32 - 6000) * (16384 - 8000)) >> 15 AS size
    UNION ALL SELECT m + 1, low + 2 * size + 2, CASE WHEN size > 0 THEN (2 * size * 8000) >> 15 ELSE 0 END FROM l WHERE m < 30)
SELECT w.p_partkey, u.c[w.k + 1] AS vectors, true AS round_trip, (1 + (32767 - y) + ((16384 + y * (-7651 + a)) >> 15))::INTEGER AS cosine,
  (CASE WHEN v = 0 THEN 0 WHEN v < 0 THEN l.low ELSE l.low + l.size + 1 END)::INTEGER AS low,
  (CASE WHEN v = 0 THEN 6000 ELSE greatest(0, least(l.size + 1, 32768 - CASE WHEN v < 0 THEN l.low ELSE l.low + l.size + 1 END)) END)::INTEGER AS width,
  (CASE WHEN t <= 4 THEN t + 1 ELSE 9 - t END)::INTEGER AS triangle
FROM w JOIN u ON u.n = w.n LEFT JOIN l ON l.m = abs(v)
"""


@query("exact_functions", "FN15 FN16 FN17", EXACT)
def exact_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse vectors numbered and back, exact cosines, Laplace and triangular intervals, for each part."""

    def one(row) -> tuple:
        n, k = 1 + row.p_partkey % 7, 1 + row.p_size % 6
        index = row.p_partkey * 7919 % celt.pulse_count(n, k)
        y = celt.pulse_vector(n, k, index)
        angle = row.p_partkey * 37 % 16384
        low, size = celt.laplace_interval(row.p_size - 25, 6000, 8000)
        return (
            row.p_partkey, celt.pulse_count(n, k), celt.pulse_index(y) == index and sum(map(abs, y)) == k,
            celt.exact_cos(angle), low, size, celt.triangular_interval(row.p_size % 9, 8)[1],
        )

    schema = "p_partkey long, vectors long, round_trip boolean, cosine int, low int, width int, triangle int"
    return models.map_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), schema, one)


PACKED = """
SELECT p_partkey, (CASE WHEN p_partkey < 128 THEN 1 WHEN p_partkey < 16384 THEN 2 ELSE 3 END)::INTEGER AS varint_bytes, p_partkey AS value,
  list_sum(list_transform(range(0, 8), lambda i: ((p_size >> i) & 1) << (7 - i)))::INTEGER AS reversed_size FROM part
"""


@query("packed_numbers", "FN25 SRC34", PACKED)
def packed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as varints and back, bits reversed."""

    def one(row) -> tuple:
        raw = bits.put_varint(row.p_partkey)
        return row.p_partkey, len(raw), bits.get_varint(raw)[0], bits.reverse_bits(row.p_size, 8)

    schema = "p_partkey long, varint_bytes int, value long, reversed_size int"
    return models.map_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), schema, one)


POSTS = """
WITH p AS (SELECT l_orderkey AS g, l_partkey AS x, min(l_linenumber) AS i FROM lineitem GROUP BY 1, 2)
SELECT a.g, a.x, a.i, max(b.x) FILTER (WHERE b.x < a.x) AS below, min(b.x) FILTER (WHERE b.x > a.x) AS above,
  count(*) FILTER (WHERE b.x < a.x) AS rank
FROM p a LEFT JOIN p b ON a.g = b.g AND (b.i, b.x) < (a.i, a.x) GROUP BY 1, 2, 3
"""


@query("floor_posts", "SRT04 SET06 SRC24", POSTS)
def floor_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post's nearest neighbours among the posts placed before it in its group."""
    posts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("x")).agg(F.min("l_linenumber").alias("i"))
    before = W.partitionBy("g").orderBy("i", "x").rowsBetween(W.unboundedPreceding, -1)
    held = posts.withColumn("held", F.collect_list("x").over(before))  # a group's posts are few
    lower, upper = F.filter("held", lambda v: v < F.col("x")), F.filter("held", lambda v: v > F.col("x"))
    return held.select(
        "g", "x", "i", F.array_max(lower).alias("below"), F.array_min(upper).alias("above"), F.size(lower).cast("long").alias("rank")
    )


EXTENT = """
SELECT l_orderkey, max(l_linenumber) FILTER (WHERE l_discount <> 0) AS last_nonzero, max(l_linenumber) FILTER (WHERE l_quantity > 25) AS last_large,
  count(*) FILTER (WHERE l_discount = 0) AS zeros FROM lineitem GROUP BY l_orderkey
"""


@query("spectral_extent", "AGG10 FLT07", EXTENT)
def spectral_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of an order that isn't zero, and the last that is large."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_discount") != 0, line)).alias("last_nonzero"),
        F.max(F.when(F.col("l_quantity") > 25, line)).alias("last_large"),
        F.count_if(F.col("l_discount") == 0).alias("zeros"),
    )


LINES = """
WITH m AS (SELECT event_id, user_id, event_type, ts, abs(value) AS x FROM events)
SELECT event_id, round(avg(x) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS same_line,
  round(avg(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) AS neighbours FROM m
"""


@query("line_average", "WIN20 WIN19", LINES)
def line_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes predicted from the same line before, and from neighbouring lines."""
    x = F.abs("value")
    line = sequence.before(["user_id", "event_type"], ["ts", "event_id"])
    near = sequence.ordered(["user_id"], ["ts", "event_id"]).rowsBetween(-2, -1)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.avg(x).over(line), 6).alias("same_line"), F.round(F.avg(x).over(near), 6).alias("neighbours")
    )


CONTEXTS = """
WITH p AS (SELECT user_id, event_type, coalesce(lag(event_type) OVER w, '-') AS prev, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT prev, event_type, -log2((1 + count(*) OVER (PARTITION BY user_id, prev, event_type ORDER BY ts, event_id) - 1)::DOUBLE
    / (5 + count(*) OVER (PARTITION BY user_id, prev ORDER BY ts, event_id) - 1)) AS bits FROM p)
SELECT prev, event_type, count(*) AS n, round(sum(bits), 6) AS bits FROM c GROUP BY prev, event_type
"""


@query("context_cost", "JON15 WIN09", CONTEXTS)
def context_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of event types in the context of the one before, by context: exact slots, no collisions."""
    order = ["ts", "event_id"]
    prev = F.coalesce(F.lag("event_type").over(sequence.ordered(["user_id"], order)), F.lit("-"))
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", prev.alias("prev"))
    seen = F.row_number().over(W.partitionBy("user_id", "prev", "event_type").orderBy(*order)) - 1
    total = F.row_number().over(W.partitionBy("user_id", "prev").orderBy(*order)) - 1
    costed = df.withColumn("bits", -F.log2((1 + seen).cast("double") / (5 + total)))
    return costed.groupBy("prev", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("bits"), 6).alias("bits"))

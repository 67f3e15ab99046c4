"""Mixing sources to target weights by nested hash thresholds.

Every row gets a 36-bit hash of its id and text. Tokens are summed by source and hash bucket; in each source the
first buckets whose sum fits the budget are taken whole, and only the bucket on the boundary is summed
again by the next 12 bits of the hash. After three levels the rows left on the boundary share one hash
value: they're one document, or rows that repeat it, and take the same fraction of their tokens, so each
source meets its target to within a token for each such row. Nothing is sorted, a larger budget takes a superset of a smaller one, and reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.llm.common import join_side, whole_row
from strandflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
LEVEL_BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """36 bits of the md5 of the id and the text's md5, so that null and repeated ids don't share one; nulls hash as empty strings."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 9), 16, 10).cast("long")


def bucket(level: int) -> Column:
    shift = LEVEL_BITS * (LEVELS - 1 - level)
    return F.shiftright("__hash", shift).bitwiseAND((1 << LEVEL_BITS) - 1)


def source_ranks(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank): ranks from 0 by code point, null last, without one task for all sources."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = materialize(
        totals.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "mix-sources"
    )
    parts = ordered.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition of sources
    before = parts.select(
        "__part",
        F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )  # one row for each partition of the small table
    return (
        ordered.withColumn("__part", F.shiftright("__at", 33))
        .transform(lambda df: join_side(df, before, ["__part"]))
        .select("source", "source_size", (F.col("before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, capped at ``cap`` times a source's size.

    The excess over the caps is dealt again by weight: target = min(cap * size, level * weight), where a
    few sums over the sources find the level.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(source_ranks(sizes).withColumn("weight", weight), "mix-ranks")
    total, weight_sum = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight_sum = total or 0, weight_sum or 0
    level = share * total / weight_sum if weight_sum else 0.0
    while True:
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        capped, rest = sources.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            break
        higher = (share * total - (capped or 0)) / rest
        if higher <= level:
            break
        level = higher
    capped_target = F.least((F.col("source_size") * cap).cast("double"), F.lit(float(level)) * F.col("weight"))
    return sources.select("source", "source_size", capped_target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, copies, b0, b1, b2, fraction): rows below (b0, b1, b2) get one more whole copy, those at it a fraction."""
    # a source of no words needs nothing; else whole copies for all rows, and a budget for one more
    state = goals.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("copies"),
        "source_size",
        "target",
    ).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.select("source", "copies", "left")
    edges: list[str] = []
    by_source = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    for level in range(LEVELS):
        rows = sizes
        if edges:
            marks = state.select("source", *edges)
            rows = join_side(sizes, marks, ["source"])
            rows = rows.where(reduce(Column.__and__, (bucket(i) == F.col(e) for i, e in enumerate(edges))))
        sums = rows.groupBy("source", bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(by_source), F.lit(0)))
        sums = join_side(sums, state.select("source", "left"), ["source"])
        at = sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        at = at.select("source", F.col("b").alias(f"b{level}"), "before", F.col("n").alias("edge_size"))
        state = state.drop("edge_size")
        state = join_side(state, at, ["source"], "left")  # a budget that no bucket exceeds has no boundary
        state = state.withColumn("left", F.col("left") - F.coalesce("before", F.lit(0))).drop("before")
        edges.append(f"b{level}")
        state = materialize(state, f"mix-level{level}")
    fraction = F.when(F.col("edge_size") > 0, F.col("left") / F.col("edge_size")).otherwise(0.0)
    return state.select("source", "copies", *edges, fraction.alias("fraction"))


def marks_of(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, b0, b1, b2, fraction): what decides each row."""
    goals = materialize(targets(sizes), "mix-targets")
    return materialize(join_side(goals, thresholds(sizes, goals), ["source"]), "mix-thresholds")


def decide(rows: DataFrame, marks: DataFrame, whole: bool = False) -> DataFrame:
    """``rows`` (source, size, __hash and any others) with source_size, target and taken; ``whole``: rows on a boundary are taken or left, whichever is nearer."""
    joined = join_side(rows, marks, ["source"])
    b = [bucket(i) for i in range(LEVELS)]
    e = [F.col(f"b{i}") for i in range(LEVELS)]
    below = (b[0] < e[0]) | ((b[0] == e[0]) & ((b[1] < e[1]) | ((b[1] == e[1]) & (b[2] < e[2]))))
    at = (b[0] == e[0]) & (b[1] == e[1]) & (b[2] == e[2])
    part = F.when(F.col("fraction") >= 0.5, F.col("size")).otherwise(0) if whole else F.floor(F.col("size") * (F.col("fraction") + 1e-9))
    more = F.when(below, F.col("size")).when(at, part).otherwise(0)
    # a missing edge means that the budget ended on a bucket's border
    more = F.when(e[0].isNull(), 0).otherwise(F.coalesce(more, F.lit(0)))
    taken = F.col("copies") * F.col("size") + more
    return joined.withColumn("taken", taken.cast("long")).drop("copies", "fraction", "b0", "b1", "b2")


def mix(sizes: DataFrame) -> DataFrame:
    """Rows of ``sizes`` (source, size, __hash and any others) with source_size, target and taken.

    Null sources are one source, after all others. Rows of no words take none. Rows with equal ids and texts
    share a hash, so they're taken alike. An empty table gives an empty result.
    """
    return decide(sizes, marks_of(sizes))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, a row for each whole copy: a source misses its target by half its boundary document at most.

    Texts are neither cut nor shuffled. Rows of which nothing is taken go: those without words (null and
    empty texts) among them. Null sources are one source; null ids and repeated rows are mixed like others,
    and rows that repeat an id and a text are taken alike; an empty table gives an empty result.
    """
    marks = marks_of(sized(docs))
    hashed = row_hash(F.col("doc_id"), F.col("text")).alias("__hash")
    rows = docs.select(whole_row(docs).alias("__row"), "source", word_count(F.col("text")).alias("size"), hashed)
    chosen = decide(rows, marks, whole=True).where("taken > 0").select("__row", F.expr("int(taken div size)").alias("__copies"))
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select("__row.*")


def sized(docs: DataFrame) -> DataFrame:
    """Ids, sources and word counts of whole texts, written once: later passes read no text."""
    return materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("__hash")),
        "mix-sizes",
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    2.0::DOUBLE * source_size / CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS filled FROM s),
f AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY filled, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY filled, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(2.0::DOUBLE * source_size,
    coalesce((SELECT min_by(level, filled) FROM f WHERE level <= filled), 0) * weight) AS target FROM w),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM g),
h AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h)
SELECT d.doc_id, d.size, b.source_size, round(b.target, 6) AS target, (b.copies * d.size + CASE
    WHEN c.before + c.n <= b.target - b.copies * b.source_size THEN d.size
    WHEN c.before <= b.target - b.copies * b.source_size AND c.n > 0
      THEN floor(d.size * ((b.target - b.copies * b.source_size - c.before) / c.n + 1e-9)) ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

"""Layouts: chunks, lacing, extents, gaps and prefix sums that need no single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chunks(df: DataFrame, size: Column, chunk: int) -> DataFrame:
    """A row for each chunk: ``chunk_no`` from 0, ``off`` and ``len``; nothing for what is empty."""
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size.cast("long") - 1, F.lit(chunk).cast("long")))
    cut = df.select("*", F.posexplode(starts).alias("chunk_no", "off"))
    return cut.withColumn("len", F.least(F.lit(chunk).cast("long"), size - F.col("off")))


def lacing(size: Column) -> Column:
    """Segment sizes of a packet: 255 as often as it fits, and a last one below 255."""
    return F.concat(F.array_repeat(F.lit(255).cast("long"), F.floor(size / 255).cast("int")), F.array(size % 255))


def prefix_sum(df: DataFrame, key: str, value: str, width: int = 4096, levels: int = 3) -> DataFrame:
    """``before``: sum of ``value`` over all rows of smaller ``key``, by sums of key ranges first.

    Ranges of ``width`` keys are summed apart, ranges of their sums likewise, and only the sums of the last of
    ``levels`` are run over in one order: a row for each ``width ** levels`` keys.
    """
    before = W.unboundedPreceding, -1
    if not levels:
        return df.withColumn("before", F.coalesce(F.sum(value).over(W.orderBy(key).rowsBetween(*before)), F.lit(0)))
    block = f"__block{levels}"
    keyed = df.withColumn(block, F.floor(F.col(key) / width))
    sums = keyed.groupBy(block).agg(F.sum(value).alias(f"__n{levels}"))
    offsets = prefix_sum(sums, block, f"__n{levels}", width, levels - 1).select(block, F.col("before").alias("__offset"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(block).orderBy(key).rowsBetween(*before)), F.lit(0))
    placed = keyed.withColumn("__inside", inside).join(offsets, block)
    return placed.withColumn("before", F.col("__offset") + F.col("__inside")).drop(block, "__inside", "__offset")


def merge_ranges(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """(keys, lo, hi): touching or overlapping ranges merged."""
    w = W.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(lo) > reach + 1), 1).otherwise(0)
    islands = df.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("__island")


def gaps(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, gap_lo, gap_hi) between merged ranges."""
    following = F.lead("lo").over(W.partitionBy(*keys).orderBy("lo"))
    return merged.select(*keys, (F.col("hi") + 1).alias("gap_lo"), (following - 1).alias("gap_hi")).where("gap_hi >= gap_lo")

"""Ordered-sequence operators: differences, islands, last occurrences, histories.

All windows are partitioned by the given keys, so a plan has one exchange on them for any number of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def before(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All earlier rows of the key."""
    return ordered(keys, order).rowsBetween(W.unboundedPreceding, -1)


def up_to(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def delta(value: Column, w: WindowSpec, level: int = 1) -> Column:
    """First or second difference; what lies before the first row counts as zero."""
    one = F.coalesce(F.lag(value, 1).over(w), F.lit(0))
    if level == 1:
        return value - one
    return value - 2 * one + F.coalesce(F.lag(value, 2).over(w), F.lit(0))


def undelta(difference: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.sum(difference).over(up_to(keys, order))


def marker_sessions(df: DataFrame, marker: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``link``: number of marker rows of the key so far; 0 before the first."""
    return df.withColumn("link", F.sum(F.when(marker, 1).otherwise(0)).over(up_to(keys, order)))


def gap_sessions(df: DataFrame, at: str, gap_seconds: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``session``: number of gaps longer than ``gap_seconds`` before the row, from 1."""
    silence = F.timestamp_diff("MICROSECOND", F.lag(at).over(ordered(keys, order)), F.col(at))
    fresh = F.when(silence.isNull() | (silence > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("__fresh", fresh).withColumn("session", F.sum("__fresh").over(up_to(keys, order))).drop("__fresh")


def match_runs(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``run_no`` and ``run_pos``: the island of equal values that the row is in, and its place there, from 1."""
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(ordered(keys, order))), 0).otherwise(1)
    numbered = df.withColumn("__changed", changed).withColumn("run_no", F.sum("__changed").over(up_to(keys, order))).drop("__changed")
    return numbered.withColumn("run_pos", F.row_number().over(ordered([*keys, "run_no"], order)))


def last_occurrence(df: DataFrame, same: Sequence[str], position: str) -> DataFrame:
    """``prev_pos``: the nearest earlier position with the same values (as-of self-join as one window)."""
    return df.withColumn("prev_pos", F.lag(position).over(W.partitionBy(*same).orderBy(position)))


def last_non_null(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.last(value, ignorenulls=True).over(before(keys, order))


def running_max_delta(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Value minus the greatest before it, minus 1; the greatest of nothing is -1."""
    return value - F.coalesce(F.max(value).over(before(keys, order)), F.lit(-1)) - 1


def history_bits(flag: Column, keys: Sequence[str], order: Sequence[str], length: int = 8) -> Column:
    """The last ``length`` flags before the row as a number, the nearest in the lowest bit."""
    w = ordered(keys, order)
    total = F.lit(0)
    for k in range(1, length + 1):
        total = total + F.coalesce(F.lag(flag.cast("int"), k).over(w), F.lit(0)) * (1 << (k - 1))
    return total


def first_match(value: Column, w: WindowSpec, depth: int = 4) -> Column:
    """The least lag up to ``depth`` whose value equals the row's; null if none."""
    return F.coalesce(*(F.when(F.lag(value, k).over(w) == value, k) for k in range(1, depth + 1)))

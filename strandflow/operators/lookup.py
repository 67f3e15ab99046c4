"""Lookups and matches: content equality, dictionaries, nearest keys, ranges, references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes of a dictionary up to which it is broadcast, and the bytes that a number or a flag counts as.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
FIXED_BYTES = 16


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count of its rows and bytes finds it small."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(f"`{c}`")) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string")), F.lit(0))
             if kind in ("string", "binary") or kind.startswith(("array", "struct", "map")) else F.lit(FIXED_BYTES) for c, kind in df.dtypes]
    total = sum(sizes[1:], sizes[0]) if sizes else F.lit(0)
    n, held = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(total)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df


def first_equal(df: DataFrame, content: Sequence[Column], ident: str) -> DataFrame:
    """``first_id``: the least id of the rows of equal content, nulls equal to nulls. Copies fold into one before they are joined."""
    names = [f"__c{i}" for i in range(len(content))]
    keyed = df.withColumns(dict(zip(names, content, strict=True)))
    firsts = keyed.groupBy(*(F.col(n).alias(f"{n}f") for n in names)).agg(F.min(ident).alias("first_id"))
    same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"{n}f")) for n in names))
    return keyed.join(firsts, same).drop(*names, *(f"{n}f" for n in names))


def longest_prefix(df: DataFrame, value: str, prefixes: DataFrame, ident: Sequence[str]) -> DataFrame:
    """``prefix``: the longest of ``prefixes`` (prefix) that ``value`` starts with, by an equi-join on cut lengths.

    The lengths that occur are few; each row meets its own cuts only, so no pair is made for nothing.
    """
    sizes = sorted(r.size for r in prefixes.select(F.length("prefix").alias("size")).distinct().collect())
    if not sizes:
        return df.withColumn("prefix", F.lit(None).cast("string"))
    cuts = F.array(*(F.when(F.length(value) >= n, F.substring(value, 1, n)) for n in sizes))
    cut = df.select(*ident, F.explode(cuts).alias("prefix")).where(F.col("prefix").isNotNull())
    best = cut.join(small(prefixes), "prefix").groupBy(*ident).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return df.join(best, list(ident), "left")


def threshold_index(value: Column, thresholds: Sequence[float]) -> Column:
    """Index of the first of decreasing thresholds that ``value`` exceeds; their number if none."""
    out = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        out = F.when(value > thresholds[i], i).otherwise(out)
    return out


def range_lookup(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """Join the row of ``ranges`` (lo, hi, ...) with lo <= value <= hi.

    Values and ranges meet by buckets, as many as there are ranges over the values that occur, so that no
    value looks at all ranges; a range stands in each bucket that it touches.
    """
    n = ranges.count()
    least, most = df.agg(F.min(value), F.max(value)).first()
    least, most = float(least or 0), float(most or 0)
    width = max((most - least) / max(1, n), 1e-9)

    def bucket(x: Column) -> Column:
        return F.floor((F.least(F.greatest(x.cast("double"), F.lit(least)), F.lit(most)) - least) / width)

    dealt = ranges.where((F.col("lo") <= F.col("hi")) & (F.col("lo") <= most) & (F.col("hi") >= least))
    dealt = dealt.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    meets = (bucket(F.col(value)) == F.col("__bucket")) & (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
    return df.join(small(dealt), meets, "left").drop("lo", "hi", "__bucket")


def references(df: DataFrame, pointer: str, targets: DataFrame, target: str) -> DataFrame:
    """``state`` of a reference: ZERO (0 or null), PRI (the first to hold a target), ALIAS (others of it), RAW (no target)."""
    known = targets.select(F.col(target).alias("__target")).distinct()
    joined = df.join(known, F.col(pointer) == F.col("__target"), "left")
    first = F.row_number().over(W.partitionBy(pointer).orderBy("ref_id")) == 1
    state = (
        F.when(F.coalesce(F.col(pointer), F.lit(0)) == 0, "ZERO")
        .when(F.col("__target").isNull(), "RAW")
        .when(first, "PRI")
        .otherwise("ALIAS")
    )
    return joined.withColumn("state", state).drop("__target")


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dictionary(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)

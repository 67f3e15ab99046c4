"""Queries on orders, line items and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions import scalars
from strandflow.operators import layout, lookup, sequence
from strandflow.registry import query
from strandflow.session import table

#: A total order of an order's lines: order and line number alone repeat.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_SQL = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
ORDER = ["l_orderkey"]


UNDELTA = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM lineitem
"""


@query("undelta_field", "WIN01 AGG08", UNDELTA)
def undelta_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a difference: running sums of an order's quantities."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, *LINE, "l_quantity")
    total = F.round(sequence.undelta(F.col("l_quantity"), ORDER, LINE), 4)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", total.alias("total"))


RUNNING_MAX = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey - coalesce(max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS d FROM lineitem
"""


@query("running_max_delta", "WIN16", RUNNING_MAX)
def running_max_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as differences from the greatest before them."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, *LINE)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sequence.running_max_delta(F.col("l_partkey"), ORDER, LINE).alias("d")
    )


ALPHABET = """
SELECT l_returnflag, count(DISTINCT l_quantity) AS symbols, min(l_quantity) AS least, max(l_quantity) AS most,
  round(count(DISTINCT l_quantity) / (max(l_quantity) - min(l_quantity) + 1), 6) AS coverage,
  quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3
FROM lineitem GROUP BY l_returnflag
"""


@query("alphabet", "AGG03", ALPHABET)
def alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphabet of values by group: distinct symbols, bounds, coverage and exact quartiles.

    Values are counted first, so that the quartiles are of a count for each distinct value.
    """
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return counts.groupBy("l_returnflag").agg(
        F.count("*").alias("symbols"),
        F.min("l_quantity").alias("least"),
        F.max("l_quantity").alias("most"),
        F.round(F.count("*") / (F.max("l_quantity") - F.min("l_quantity") + 1), 6).alias("coverage"),
        *(F.percentile("l_quantity", q, F.col("n")).alias(name) for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))),
    )


GROUP_ALPHABET = """
SELECT p_brand, count(DISTINCT p_size) AS n, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS sizes FROM part GROUP BY p_brand
"""


@query("group_alphabet", "AGG04", GROUP_ALPHABET)
def group_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sizes of each brand."""
    sizes = F.array_sort(F.collect_set(F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(sizes.alias("s")).select(
        "p_brand", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("sizes")
    )


LAYOUT = """
SELECT l_orderkey, count(*) AS n, max(l_linenumber) + 1 AS layout_rows, round(sum(l_quantity), 4) AS quantity,
  round(sum(l_extendedprice * (1 - l_discount)), 5) AS revenue FROM lineitem GROUP BY l_orderkey
"""


@query("sum_max_layout", "AGG07 AGG08 AGG18", LAYOUT)
def sum_max_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an order, and one more than its greatest line number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"),
        (F.max("l_linenumber") + 1).alias("layout_rows"),
        F.round(F.sum("l_quantity"), 4).alias("quantity"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 5).alias("revenue"),
    )


LS_FIT = """
SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(covar_pop(l_extendedprice, l_quantity), 4) AS covariance
FROM lineitem GROUP BY l_returnflag
"""


@query("ls_fit", "AGG11 AGG12", LS_FIT)
def ls_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares by accumulated covariances."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"),
        F.round(F.covar_pop("l_extendedprice", "l_quantity"), 4).alias("covariance"),
    )


LAG_CORRELATION = """
WITH d AS (SELECT epoch_us(date_trunc('day', o_orderdate)) // 86400000000 AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1),
c AS (SELECT k, corr(a.x, b.x) AS r, count(*) AS n FROM range(1, 33) t(k) JOIN d a ON TRUE JOIN d b ON b.day = a.day - k GROUP BY k)
SELECT k::INTEGER AS lag, n, round(r, 6) AS r, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY r DESC, k) AS rank FROM c) WHERE rank <= 4
"""


@query("lag_correlation", "AGG13 SRT06", LAG_CORRELATION)
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best of 32 lags of the daily series: each day meets 32 earlier days, by equality."""
    day = F.floor(scalars.micros(F.col("o_orderdate")) / 86_400_000_000)
    daily = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.sum("o_totalprice").alias("x"))
    shifted = daily.select(F.explode(F.sequence(F.lit(1), F.lit(32))).alias("lag"), "day", "x")
    earlier = daily.select(F.col("day").alias("other"), F.col("x").alias("y"))
    met = shifted.join(earlier, F.col("other") == F.col("day") - F.col("lag"))
    by_lag = met.groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    ranked = by_lag.withColumn("rank", F.row_number().over(W.orderBy(F.desc("r"), "lag")))  # 32 rows
    return ranked.where("rank <= 4").select("lag", "n", F.round("r", 6).alias("r"), "rank")


STEREO_MODE = """
WITH o AS (SELECT date_trunc('day', o_orderdate) AS day, count(*)::DOUBLE AS a FROM orders GROUP BY 1),
l AS (SELECT date_trunc('day', l_shipdate) AS day, count(*)::DOUBLE AS b FROM lineitem GROUP BY 1),
s AS (SELECT o.day, a, b, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM o JOIN l USING (day) WINDOW w AS (ORDER BY o.day)),
m AS (SELECT sum(abs(a - b)) AS diff, sum(abs(db)) AS own, sum(abs(db - da)) AS side FROM s)
SELECT round(own, 4) AS own, round(side, 4) AS side,
  CASE WHEN diff = 0 THEN 'IDENTICAL' WHEN side < 0.7 * own THEN 'DELTA' ELSE 'INDEPENDENT' END AS mode FROM m
"""


@query("stereo_mode", "AGG14 FLT11", STEREO_MODE)
def stereo_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one daily series is coded as itself, as a difference from another, or as the same."""
    a = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("a"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").alias("day")).agg(F.count("*").cast("double").alias("b"))
    w = W.orderBy("day")  # a row for each day
    s = a.join(b, "day").select("day", "a", "b", (F.col("a") - F.lag("a").over(w)).alias("da"), (F.col("b") - F.lag("b").over(w)).alias("db"))
    m = s.agg(
        F.sum(F.abs(F.col("a") - F.col("b"))).alias("diff"),
        F.sum(F.abs("db")).alias("own"),
        F.sum(F.abs(F.col("db") - F.col("da"))).alias("side"),
    )
    mode = F.when(F.col("diff") == 0, "IDENTICAL").when(F.col("side") < 0.7 * F.col("own"), "DELTA").otherwise("INDEPENDENT")
    return m.select(F.round("own", 4).alias("own"), F.round("side", 4).alias("side"), mode.alias("mode"))


PLAN_COST = """
WITH t AS (SELECT o_orderpriority AS class, count(*) AS n, sum(l_quantity) AS q, count(DISTINCT l_partkey) AS parts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
c AS (SELECT class, n, 'flat' AS plan, 8.0 * n AS cost FROM t
  UNION ALL SELECT class, n, 'dictionary', 16.0 * parts + n * log2(parts) + 2 * 0.01 * n FROM t
  UNION ALL SELECT class, n, 'unary', q + 3 * 0.01 * n FROM t)
SELECT class, n, min_by(plan, cost) AS plan, round(min(cost), 4) AS cost FROM c GROUP BY class, n
"""


@query("plan_cost_argmin", "AGG15 SRT07", PLAN_COST)
def plan_cost_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of three codings of each class, dearer ones with a penalty."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("class"))
    t = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("class").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.countDistinct("l_partkey").alias("parts")
    )
    n, parts = F.col("n"), F.col("parts")
    plans = {"flat": 8.0 * n, "dictionary": 16.0 * parts + n * F.log2(parts) + 2 * 0.01 * n, "unary": F.col("q") + 3 * 0.01 * n}
    options = F.array(*(F.struct(c.cast("double").alias("cost"), F.lit(p).alias("plan")) for p, c in plans.items()))
    best = F.array_min(options)
    return t.select("class", "n", best["plan"].alias("plan"), F.round(best["cost"], 4).alias("cost"))


EXTENT_SPLICE = """
WITH e AS (SELECT o_orderkey, 1 + o_orderkey % 97 AS len FROM orders)
SELECT o_orderkey, len, coalesce(sum(len) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM e
"""


@query("extent_splice", "SRC03 SRC04 SET02 SNK11", EXTENT_SPLICE)
def extent_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of extents laid end to end: prefix sums in two levels, no single task over all rows."""
    extents = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 97).alias("len"))
    return layout.prefix_sum(extents, "o_orderkey", "len").select("o_orderkey", "len", F.col("before").alias("off"))


RANGES = """
WITH r AS (SELECT o_custkey, o_orderkey AS lo, o_orderkey + 20 + o_orderkey % 40 AS hi FROM orders),
f AS (SELECT *, CASE WHEN max(hi) OVER w IS NULL OR lo > max(hi) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM r
  WINDOW w AS (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT o_custkey, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY o_custkey, island),
g AS (SELECT o_custkey, hi + 1 AS gap_lo, lead(lo) OVER (PARTITION BY o_custkey ORDER BY lo) - 1 AS gap_hi FROM m)
SELECT * FROM g WHERE gap_hi >= gap_lo
"""


@query("range_gaps", "SET01 SET02 SET03 SRT03", RANGES)
def range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between a customer's merged ranges."""
    lo = F.col("o_orderkey")
    ranges = table(spark, sf_dir, "orders").select("o_custkey", lo.alias("lo"), (lo + 20 + lo % 40).alias("hi"))
    return layout.gaps(layout.merge_ranges(ranges, ["o_custkey"], "lo", "hi"), ["o_custkey"])


SIMILAR = """
WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
k AS (SELECT a.l_orderkey AS o, b.l_orderkey AS e, count(*) AS score FROM p a JOIN p b ON a.l_partkey = b.l_partkey
  AND b.l_orderkey < a.l_orderkey AND b.l_orderkey >= a.l_orderkey - 63 GROUP BY 1, 2)
SELECT o AS l_orderkey, max(score) AS score, max(e) FILTER (WHERE score = best) AS similar_key
FROM (SELECT *, max(score) OVER (PARTITION BY o) AS best FROM k) GROUP BY o
"""


@query("similar_earlier", "JON13 SRT07", SIMILAR)
def similar_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of the 63 order keys before, by parts in common, the nearest of equals.

    Rows meet by part within blocks of 64 keys and the block before, so a common part makes no more pairs
    than two blocks hold.
    """
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    block = F.floor(F.col("l_orderkey") / 64)
    left = pairs.withColumn("block", block)
    right = pairs.select(
        F.col("l_orderkey").alias("earlier"), "l_partkey", F.explode(F.array(block, block + 1)).alias("block")
    )
    near = (F.col("earlier") < F.col("l_orderkey")) & (F.col("earlier") >= F.col("l_orderkey") - 63)
    met = left.join(right, ["block", "l_partkey"]).where(near)
    scored = met.groupBy("l_orderkey", "earlier").agg(F.count("*").alias("score"))
    best = F.max(F.struct("score", "earlier"))
    return scored.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.score", F.col("b.earlier").alias("similar_key"))


ILOG_FOLD = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey = 0 THEN 0 ELSE length(bin(l_partkey)) END::INTEGER AS bits,
  CASE WHEN l_partkey >= l_suppkey THEN 2 * (l_partkey - l_suppkey) ELSE 2 * (l_suppkey - l_partkey) - 1 END AS folded,
  l_partkey % 7 AS digit0, l_partkey // 7 % 7 AS digit1, l_partkey // 49 % 7 AS digit2,
  floor(sqrt(l_partkey))::BIGINT AS root, floor(cbrt(l_partkey) + 1e-9)::BIGINT AS lookups, floor((l_suppkey - l_partkey) / 8.0)::BIGINT AS floor_div
FROM lineitem
"""


@query("ilog_fold", "FN01 FN02 FN03 FN05 FN07 FN08 FN10 FN13 FN14", ILOG_FOLD)
def ilog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer functions: bit length, folded residual, mixed-radix digits, root, floor division."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        scalars.ilog(p).alias("bits"),
        scalars.fold(p - s).alias("folded"),
        *(scalars.digit(p, 7, i).alias(f"digit{i}") for i in range(3)),
        scalars.isqrt(p).alias("root"),
        scalars.lookup_size(p, F.lit(3)).cast("long").alias("lookups"),
        scalars.floor_div(s - p, 8).alias("floor_div"),
    )


RANGE_BUCKET = """
SELECT p_partkey, p_size, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 30 THEN 1 WHEN p_size > 20 THEN 2 WHEN p_size > 10 THEN 3 ELSE 4 END::INTEGER AS bucket,
  CASE WHEN p_retailprice <= 1000 THEN 'low' WHEN p_retailprice <= 1500 THEN 'mid' ELSE 'high' END AS band FROM part
"""


@query("range_bucket", "JON07 FN08", RANGE_BUCKET)
def range_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decreasing thresholds by expression, price bands by range join with a dimension."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    bands = lookup.dictionary(spark, [(-1e18, 1000.0, "low"), (1000.0000001, 1500.0, "mid"), (1500.0000001, 1e18, "high")], "lo double, hi double, band string")
    out = lookup.range_lookup(part, "p_retailprice", bands)
    return out.select("p_partkey", "p_size", lookup.threshold_index(F.col("p_size"), [40, 30, 20, 10]).alias("bucket"), "band")


DICT_EXACT = """
WITH d AS (SELECT * FROM (VALUES ('Brand#11', 0), ('Brand#23', 1), ('Brand#34', 2), ('Brand#55', 3)) t(brand, idx))
SELECT p_brand, coalesce(idx, -1)::INTEGER AS idx, count(*) AS n FROM part LEFT JOIN d ON p_brand = brand GROUP BY 1, 2
"""


@query("dict_exact", "JON03 JON04 JON15 JON16 FLT14", DICT_EXACT)
def dict_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dictionary lookups, hit or miss. Rows are folded by key before the join."""
    words = lookup.dictionary(spark, [("Brand#11", 0), ("Brand#23", 1), ("Brand#34", 2), ("Brand#55", 3)], "p_brand string, idx int")
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.join(lookup.small(words), "p_brand", "left").select("p_brand", F.coalesce("idx", F.lit(-1)).alias("idx"), "n")


ALIAS_REF = """
WITH r AS (SELECT s_suppkey AS ref_id, CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 7 = 0 THEN 1000 + s_suppkey ELSE s_nationkey END AS pointer FROM supplier),
j AS (SELECT r.*, n.n_nationkey, row_number() OVER (PARTITION BY pointer ORDER BY ref_id) AS k FROM r LEFT JOIN nation n ON pointer = n_nationkey)
SELECT ref_id, pointer, CASE WHEN coalesce(pointer, 0) = 0 THEN 'ZERO' WHEN n_nationkey IS NULL THEN 'RAW' WHEN k = 1 THEN 'PRI' ELSE 'ALIAS' END AS state FROM j
"""


@query("alias_ref", "JON08 SRC18", ALIAS_REF)
def alias_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to entities: the first to hold one, its aliases, and pointers to nothing."""
    key = F.col("s_suppkey")
    pointer = F.when(key % 11 == 0, F.lit(0).cast("long")).when(key % 7 == 0, key + 1000).otherwise(F.col("s_nationkey").cast("long"))
    refs = table(spark, sf_dir, "supplier").select(key.alias("ref_id"), pointer.alias("pointer"))
    return lookup.references(refs, "pointer", table(spark, sf_dir, "nation"), "n_nationkey").select("ref_id", "pointer", "state")


REFERENTIAL = """
SELECT 'order_customer' AS rule, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) AS broken
UNION ALL SELECT 'line_part', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey))
UNION ALL SELECT 'line_order', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey))
"""


@query("referential_checks", "FLT08 FLT12", REFERENTIAL)
def referential_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reference is missing, by rule: anti joins on the keys alone."""
    rules = [
        ("order_customer", "orders", "o_custkey", "customer", "c_custkey"),
        ("line_part", "lineitem", "l_partkey", "part", "p_partkey"),
        ("line_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ]
    out = None
    for rule, child, fk, parent, pk in rules:
        keys = table(spark, sf_dir, child).groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
        known = table(spark, sf_dir, parent).select(F.col(pk).alias("k"))
        broken = keys.join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken"))
        row = broken.select(F.lit(rule).alias("rule"), "broken")
        out = row if out is None else out.union(row)
    return out


LEVELS = [(lo, klass, f"{klass.lower()}-{tier}") for tier, lo in enumerate((1, 5, 9, 13, 17)) for klass in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
LEVEL_CONFIG = (
    "WITH grid AS (SELECT * FROM (VALUES "
    + ", ".join(f"({lo}, '{k}', '{c}')" for lo, k, c in LEVELS)
    + ") t(lo, class, config)), c AS (SELECT c_custkey, c_mktsegment, 1 + c_custkey % 20 AS level FROM customer) "
    "SELECT config, count(*) AS n FROM c JOIN grid ON c_mktsegment = class AND level BETWEEN lo AND lo + 3 GROUP BY config"
)


@query("level_config", "EXE03 AGG06", LEVEL_CONFIG)
def level_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration by effort level and class, from a grid of five tiers."""
    grid = lookup.dictionary(spark, LEVELS, "lo int, class string, config string").withColumn("tier", F.floor((F.col("lo") - 1) / 4))
    level = (1 + F.col("c_custkey") % 20).alias("level")
    customers = table(spark, sf_dir, "customer").groupBy("c_mktsegment", level).agg(F.count("*").alias("n"))
    keyed = customers.withColumn("tier", F.floor((F.col("level") - 1) / 4)).withColumnRenamed("c_mktsegment", "class")
    return keyed.join(lookup.small(grid), ["class", "tier"]).groupBy("config").agg(F.sum("n").alias("n"))

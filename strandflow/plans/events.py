"""Queries on the event stream."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandflow.functions import scalars
from strandflow.operators import cost, sequence
from strandflow.operators.models import AdaptiveBit
from strandflow.registry import query
from strandflow.session import table

BIT_ACCOUNTING = """
WITH costs AS (
  SELECT event_type, -log2((1 + seen)::DOUBLE / (5 + total)) AS bits FROM (
    SELECT event_type,
      count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seen,
      count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS total
    FROM events))
SELECT coalesce(event_type, 'TOTAL') AS component, count(*) AS symbols,
  round(sum(bits) / 8, 6) AS bytes, round(sum(bits) / count(*), 6) AS bits_per_symbol
FROM costs GROUP BY ROLLUP (event_type)
"""


@query("bit_accounting", "AGG01 WIN09 SRT02", BIT_ACCOUNTING)
def bit_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive add-one cost of each user's event types, rolled up by type with a grand total."""
    by_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    by_type = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    costs = (
        table(spark, sf_dir, "events")
        .select("user_id", "event_type", "ts", "event_id")
        .withColumn("total", F.row_number().over(by_user) - 1)
        .withColumn("seen", F.row_number().over(by_type) - 1)
        .select("event_type", (-F.log2((F.col("seen") + 1).cast("double") / (F.col("total") + 5))).alias("bits"))
    )
    return (
        costs.rollup("event_type")
        .agg(F.count("*").alias("symbols"), F.sum("bits").alias("bits"))
        .select(
            F.coalesce("event_type", F.lit("TOTAL")).alias("component"),
            "symbols",
            F.round(F.col("bits") / 8, 6).alias("bytes"),
            F.round(F.col("bits") / F.col("symbols"), 6).alias("bits_per_symbol"),
        )
    )


USER, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


ADAPTIVE_BITS = """
WITH RECURSIVE v AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, i, v, 0.5::DOUBLE AS p FROM v WHERE i = 1
  UNION ALL SELECT s.user_id, v.i, v.v, s.p + (s.v - s.p) / (least(s.i - 1, 120) + 3) FROM s JOIN v ON v.user_id = s.user_id AND v.i = s.i + 1)
SELECT user_id, count(*) AS symbols, sum(v)::BIGINT AS ones, round(sum(-log2(CASE WHEN v = 1 THEN p ELSE 1 - p END)), 6) AS bits FROM s GROUP BY user_id
"""


@query("adaptive_bits", "WIN07 WIN10 MDL01", ADAPTIVE_BITS)
def adaptive_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each user's purchase flags under the adaptive bit, which after ``LIMIT`` rows forgets at a fixed rate."""
    return bit_costs(events(spark, sf_dir))


def ordered_fold(df: DataFrame, value: Column, start: Callable[[], Any], step: Callable[[Any, Any], None], done: Callable[[Any], tuple], result: str) -> DataFrame:
    """(user_id, n, and the columns of ``result``) by a fold over each user's ordered values.

    Users are dealt to tasks and sorted there; a task reads its rows as they come and holds one user's state.
    """
    kind = df.schema["user_id"].dataType
    schema = f"user_id {kind.simpleString()}, n long, {result}"

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state, n, key_type = None, None, 0, None
        for batch in it:
            out, key_type = [], batch.schema.field(0).type
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or key != user:
                    if state is not None:
                        out.append((user, n, *done(state)))
                    user, state, n = key, start(), 0
                step(state, x)
                n += 1
            yield rows(key_type, out)
        if state is not None:
            yield rows(key_type, [(user, n, *done(state))])

    def rows(key: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
        kinds = [key, pa.int64(), *({"double": pa.float64(), "binary": pa.binary()}.get(c.split()[1], pa.int64()) for c in result.split(", "))]
        names = [c.split()[0] for c in schema.split(", ")]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ordered = df.select(*USER, *ORDER, value.alias("v")).repartition(*USER).sortWithinPartitions(*USER, *ORDER)
    return ordered.select(*USER, "v").mapInArrow(fold, schema)


def bit_costs(df: DataFrame) -> DataFrame:
    """(user_id, symbols, ones, bits) under an adaptive bit for each user."""

    def step(state: list, bit: int) -> None:
        model = state[0]
        state[2] -= math.log2(model.p if bit else 1 - model.p)
        state[1] += bit
        model.update(bit)

    flag = F.coalesce((F.col("event_type") == "purchase").cast("int"), F.lit(0))
    out = ordered_fold(df, flag, lambda: [AdaptiveBit(), 0, 0.0], step, lambda s: (s[1], s[2]), "ones long, bits double")
    return out.select("user_id", F.col("n").alias("symbols"), "ones", F.round("bits", 6).alias("bits"))


DELTA_FIELD = """
SELECT event_id, user_id, round(value - coalesce(lag(value) OVER w, 0), 6) AS d1,
  round(value - 2 * coalesce(lag(value) OVER w, 0) + coalesce(lag(value, 2) OVER w, 0), 6) AS d2
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


@query("delta_field", "WIN01 SRC32", DELTA_FIELD)
def delta_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second differences of a user's values."""
    w = sequence.ordered(USER, ORDER)
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        F.round(sequence.delta(F.col("value"), w), 6).alias("d1"),
        F.round(sequence.delta(F.col("value"), w, 2), 6).alias("d2"),
    )


SESSION_LINKS = """
WITH l AS (SELECT user_id, event_type,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS link FROM events)
SELECT user_id, link, count(*) AS n, count(DISTINCT event_type) AS kinds FROM l GROUP BY user_id, link
"""


@query("session_links", "WIN06 STR03 SRC14 SRC15 SET05", SESSION_LINKS)
def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that a marker opens, and what each holds."""
    linked = sequence.marker_sessions(events(spark, sf_dir), F.col("event_type") == "signup", USER, ORDER)
    return linked.groupBy("user_id", "link").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))


GAP_SESSIONS = """
WITH f AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f)
SELECT user_id, session, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS span_us FROM s GROUP BY user_id, session
"""


@query("gap_sessions", "STR03", GAP_SESSIONS)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that half an hour of silence ends."""
    found = sequence.gap_sessions(events(spark, sf_dir), "ts", 1800, USER, ORDER)
    return found.groupBy("user_id", "session").agg(
        F.count("*").alias("n"), (F.max(scalars.micros(F.col("ts"))) - F.min(scalars.micros(F.col("ts")))).alias("span_us")
    )


LAST_OCCURRENCE = """
WITH p AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS prev_type, row_number() OVER w AS pos
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, pos, lag(pos) OVER v AS prev_pos, pos - lag(pos) OVER v AS distance
FROM p WINDOW v AS (PARTITION BY user_id, prev_type, event_type ORDER BY pos)
"""


@query("last_occurrence", "JON09 JON10 JON11 JON12", LAST_OCCURRENCE)
def last_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the same pair of event types stood last: an as-of join on a composite key, as a window."""
    w = sequence.ordered(USER, ORDER)
    paired = events(spark, sf_dir).withColumns(
        {"prev_type": F.lag("event_type").over(w), "pos": F.row_number().over(w).cast("long")}
    )
    found = sequence.last_occurrence(paired, ["user_id", "prev_type", "event_type"], "pos")
    return found.select("event_id", "user_id", "pos", "prev_pos", (F.col("pos") - F.col("prev_pos")).alias("distance"))


MATCH_RUNS = """
WITH c AS (SELECT user_id, ts, event_id, event_type,
    CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS changed
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM c)
SELECT user_id, run_no, event_type, count(*) AS run_length FROM r GROUP BY user_id, run_no, event_type
"""


@query("match_runs", "WIN15", MATCH_RUNS)
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of runs of equal event types."""
    runs = sequence.match_runs(events(spark, sf_dir), "event_type", USER, ORDER)
    return runs.groupBy("user_id", "run_no", "event_type").agg(F.count("*").alias("run_length"))


FRAME_PATCH = """
SELECT event_id, user_id, CASE WHEN lag(event_type, 1) OVER w = event_type THEN 1 WHEN lag(event_type, 2) OVER w = event_type THEN 2
  WHEN lag(event_type, 3) OVER w = event_type THEN 3 WHEN lag(event_type, 4) OVER w = event_type THEN 4 END::INTEGER AS hit_lag
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


@query("frame_patch", "JON18", FRAME_PATCH)
def frame_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the four rows before has the same type."""
    w = sequence.ordered(USER, ORDER)
    return events(spark, sf_dir).select("event_id", "user_id", sequence.first_match(F.col("event_type"), w).alias("hit_lag"))


CLASSIFY_STREAM = """
WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS views,
    count(*) FILTER (WHERE event_type = 'click') AS clicks, avg(value) AS mean_value,
    max_by(event_type, ts) AS last_type FROM events GROUP BY user_id)
SELECT user_id, n, last_type, CASE WHEN 2 * views >= n THEN 'VIEWER' WHEN 2 * clicks >= n - views THEN
    CASE WHEN mean_value >= 50 THEN 'CLICK_HIGH' ELSE 'CLICK' END WHEN n >= 10 THEN 'MULTI' ELSE 'MONO' END AS class FROM c
"""


@query("classify_stream", "AGG05 AGG06 EXE03", CLASSIFY_STREAM)
def classify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's class by conditional counts, in order of precedence."""
    kind = F.col("event_type")
    counts = events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "click").alias("clicks"),
        F.avg("value").alias("mean_value"),
        F.max_by("event_type", "ts").alias("last_type"),
    )
    clicking = F.when(F.col("mean_value") >= 50, "CLICK_HIGH").otherwise("CLICK")
    klass = (
        F.when(2 * F.col("views") >= F.col("n"), "VIEWER")
        .when(2 * F.col("clicks") >= F.col("n") - F.col("views"), clicking)
        .when(F.col("n") >= 10, "MULTI")
        .otherwise("MONO")
    )
    return counts.select("user_id", "n", "last_type", klass.alias("class"))


LAST_NONNULL = """
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events)
SELECT event_id, user_id, round(last_value(paid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS last_paid FROM v
"""


@query("last_nonnull", "WIN12 WIN13 WIN18 WIN19 WIN22", LAST_NONNULL)
def last_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the user's last purchase before the row."""
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    df = events(spark, sf_dir).withColumn("paid", paid)
    return df.select("event_id", "user_id", F.round(sequence.last_non_null(F.col("paid"), USER, ORDER), 6).alias("last_paid"))


HISTORY_BITS = (
    "WITH f AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS b FROM events) "
    "SELECT event_id, user_id, ("
    + " + ".join(f"coalesce(lag(b, {k}) OVER w, 0) * {1 << (k - 1)}" for k in range(1, 9))
    + ")::INTEGER AS history FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)


@query("history_bits", "WIN14", HISTORY_BITS)
def history_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight flags before the row as a shift register."""
    flag = F.col("event_type") == "purchase"
    return events(spark, sf_dir).select("event_id", "user_id", sequence.history_bits(flag, USER, ORDER).alias("history"))


RATES = (4, 16, 128)


EWMA = (
    "WITH RECURSIVE v AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "s AS (SELECT user_id, i, " + ", ".join(f"v / {r} AS r{r}" for r in RATES) + " FROM v WHERE i = 1 UNION ALL SELECT s.user_id, v.i, "
    + ", ".join(f"r{r} + (v.v - r{r}) / {r}" for r in RATES)
    + " FROM s JOIN v ON v.user_id = s.user_id AND v.i = s.i + 1) SELECT user_id, max(i) AS n, "
    + ", ".join(f"round(max_by(r{r}, i), 6) AS rate_{r}" for r in RATES)
    + " FROM s GROUP BY user_id"
)


@query("ewma_tracker", "WIN08 WIN11", EWMA)
def ewma_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trackers of a user's values at three rates, folded over the user's ordered values."""

    def step(state: list, x: float) -> None:
        for k, r in enumerate(RATES):
            state[k] += ((x or 0.0) - state[k]) / r

    result = ", ".join(f"rate_{r} double" for r in RATES)
    out = ordered_fold(events(spark, sf_dir), F.col("value"), lambda: [0.0] * len(RATES), step, tuple, result)
    return out.select("user_id", "n", *(F.round(f"rate_{r}", 6).alias(f"rate_{r}") for r in RATES))


PROFILE = """
SELECT event_type AS component, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS least,
  round(max(value), 6) AS most FROM events GROUP BY event_type HAVING count(*) >= 1
"""


@query("component_profile", "SRT02 SNK13", PROFILE)
def component_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a profile dump holds of each component."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("component")).agg(
        F.count("*").alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.round(F.min("value"), 6).alias("least"),
        F.round(F.max("value"), 6).alias("most"),
    )


TUMBLING = """
SELECT epoch_us(ts) // 3600000000 AS hour_no, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1
"""


@query("tumbling_windows", "STR02", TUMBLING)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in fixed windows of an hour."""
    hour = F.floor(scalars.micros(F.col("ts")) / 3_600_000_000)
    return events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min(hour).alias("hour_no")
    ).select("hour_no", "n", "total")

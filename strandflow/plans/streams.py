"""Queries that run as streams over the tables, replayed in micro-batches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.plans.media import texts
from strandflow.registry import query
from strandflow.session import materialize, shared_dir, table
from strandflow.sources import ogg
from strandflow.streaming import stateful

STATEFUL_LINKS = """
WITH l AS (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS link FROM events)
SELECT user_id, link, count(*) AS n FROM l GROUP BY user_id, link
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # the table may be a folder or a file; a glob reads either as a stream
    return stateful.stream_table(spark, f"{sf_dir}/events.parquet*", schema)


@query("stateful_links", "STR04 STR03 STR06", STATEFUL_LINKS)
def stateful_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by marker, with the count kept as each user's state over the micro-batches."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    events = stateful.replay(events, "ts", ["user_id"])
    links = stateful.drain(stateful.marker_links(events, "signup"))
    return links.groupBy("user_id", "link").agg(F.count("*").alias("n"))


STREAM_WINDOWS = """
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 3600000000 AS hour_no, event_type, count(*) AS n FROM events GROUP BY 1, 2
"""


@query("stream_windows", "STR02", STREAM_WINDOWS)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type as an aggregating stream."""
    counts = stateful.windowed_counts(_events(spark, sf_dir).select("ts", "event_type", "value"))
    hour = F.floor(F.unix_micros("window.start") / 3_600_000_000)
    out = stateful.drain(counts.select(hour.alias("hour_no"), "event_type", "n"), "complete")
    return out


@query("stream_pages", "STR01 STR05 STR06 SRC13", "SELECT doc_id::VARCHAR AS path, true AS covered, strlen(coalesce(text, ''))::BIGINT AS body FROM documents")
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as paged streams that arrive in blocks of 4 KiB, out of order, with junk ahead: pages and gaps cover all bytes."""
    docs = texts(spark, sf_dir)
    names = ["path", "block", "data", "last"]

    def blocks(it):
        for pdf in it:
            rows = []
            for doc_id, data in zip(pdf["doc_id"], pdf["data"], strict=True):
                raw = b"junk" + ogg.build_stream([bytes(data)], doc_id & 0xFFFFFFFF, segments=20)
                for at in range(0, len(raw), 4096):
                    rows.append((str(doc_id), at // 4096, raw[at : at + 4096], at + 4096 >= len(raw)))
            yield pd.DataFrame(rows, columns=names)

    cut = materialize(docs.mapInPandas(blocks, "path string, block int, data binary, last boolean"), "blocks")
    # odd blocks come first, so that they wait, in batches of their own
    base = f"{shared_dir(spark)}/arrived-{uuid.uuid4().hex}"
    for part in (1, 0):
        cut.where(F.col("block") % 2 == part).write.parquet(f"{base}/part-{1 - part}")
    # some eight micro-batches, however large the table: each writes the buckets' states anew
    files = max(8, cut.rdd.getNumPartitions() // 4)
    stream = spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/*")
    found = stateful.drain(stateful.page_stream(stream))
    page = F.col("kind") == "page"
    segments = F.floor((F.col("body")) / 255) + 1
    heads = 27 * F.greatest(F.ceil(segments / 20), F.lit(1)) + segments
    sums = found.groupBy("path").agg(
        F.sum("len").alias("all"), F.sum(F.when(page, F.col("len")).otherwise(0)).alias("paged"), F.sum(F.when(~page, F.col("len")).otherwise(0)).alias("gaps")
    )
    sizes = docs.select(F.col("doc_id").cast("string").alias("path"), F.length("data").cast("long").alias("body"))
    covered = (F.col("paged") == heads + F.col("body")) & (F.col("gaps") == 4)
    return sizes.join(sums, "path").select("path", covered.alias("covered"), "body")

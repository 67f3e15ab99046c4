"""Structured Streaming: keyed state over micro-batches, byte streams with carried tails, late rows kept aside."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandflow.session import shared_dir
from strandflow.sources import ogg

LINKS = "user_id long, event_id long, link long"
PAGES = "path string, at long, kind string, len long, serial long, granule long"
#: Buckets of keys that share a state.
BUCKETS = 256


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(table: DataFrame, order: str, keys: list[str], parts: int = 4) -> DataFrame:
    """``table`` as a stream whose micro-batches follow one another in ``order``, whatever files the table has.

    Ranges of the order are written one after the other into the shared folder, the rows of a key in one file
    of a range; a source takes files by their times, so a key's rows arrive in order over the batches. Rows
    without an order come with the first range. A micro-batch takes as many files as a range may have.
    """
    spark = table.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = table.select(at.alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)
    cuts = [float("-inf"), *sorted(cuts), float("inf")]
    for i, (low, high) in enumerate(pairwise(cuts)):
        mine = (at >= low) & (at < high)
        if i == 0:
            mine = mine | at.isNull()
        table.where(mine).repartition(files, *keys).write.parquet(f"{base}/part-{i:05d}")
        if i + 1 < len(cuts) - 1:
            time.sleep(0.01)  # file times tell milliseconds apart
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/*")


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """``rows`` with the bucket of their key: a bucket's keys share a state and a call, as a call costs some milliseconds whatever it does."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def marker_links(events: DataFrame, marker: str, buckets: int = BUCKETS) -> DataFrame:
    """Each event with its user's number of markers so far. The counts are a bucket's state across micro-batches, by user.

    Within a batch a user's events are sorted; over the batches they must come in order (``replay``). One that
    comes after a later one has been counted is late: it has no link (null) and doesn't count.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(x, u): (link, ts, last) for x, u, link, ts, last in zip(*state.get, strict=True)} if state.exists else {}
        batch = pd.concat(list(parts)).sort_values(["nobody", "user", "ts", "event_id"])
        nobody, user, ids = (batch[c].to_numpy() for c in ("nobody", "user", "event_id"))
        at = pd.to_datetime(batch["ts"]).astype("datetime64[us]").astype("int64").to_numpy()
        starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (nobody[1:] != nobody[:-1])])
        sizes = np.diff(np.r_[starts, len(user)])
        keys = list(zip(nobody[starts].tolist(), user[starts].tolist(), strict=True))
        known = np.repeat([k in held for k in keys], sizes)
        before, ts, last = (np.repeat(np.array(x, np.int64), sizes) for x in zip(*(held.get(k, (0, 0, 0)) for k in keys), strict=True))
        late = known & ((at < ts) | ((at == ts) & (ids <= last)))
        marks = np.cumsum((batch["event_type"] == marker).to_numpy(bool) & ~late)
        first = np.r_[0, marks][starts]
        links = before + marks - np.repeat(first, sizes)
        newest = np.maximum.reduceat(np.where(late, -1, np.arange(len(user))), starts)
        for k, i in zip(keys, newest.tolist(), strict=True):
            if i >= 0:
                held[k] = int(links[i]), int(at[i]), int(ids[i])
        state.update(tuple(map(list, zip(*((*k, *v) for k, v in held.items()), strict=True))))
        who = pd.Series(user, dtype="Int64").mask(nobody)
        yield pd.DataFrame({"user_id": who, "event_id": ids, "link": pd.Series(links, dtype="Int64").mask(late)})

    held = "nobody array<boolean>, user array<long>, link array<long>, ts array<long>, event_id array<long>"
    rows = _bucketed(events, "user_id", buckets).select(
        "bucket", F.col("user_id").isNull().alias("nobody"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), "event_id", "ts", "event_type"
    )
    return rows.groupBy("bucket").applyInPandasWithState(run, LINKS, held, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows, closed when the watermark passes."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def page_stream(blocks: DataFrame, keep: int = 1 << 17, buckets: int = BUCKETS) -> DataFrame:
    """Pages and gaps of files that arrive in blocks (path, block: from 0, data, last).

    Blocks may come in any order, over any micro-batches: those ahead of the next wait as state until it comes.
    What may be the start of a page is carried to the next block as well; garbage between pages is emitted
    as gaps, so that pages and gaps cover all bytes. ``keep`` bounds what is carried: no page is longer.
    """

    def forward(path: str, file: list) -> list[tuple]:
        """What the blocks that have come tell of a file (tail, base, following, end, waiting); the file moves on."""
        tail, base, following, end, waiting = file
        ready = []
        while following in waiting:
            ready.append(waiting.pop(following))
            following += 1
        if not ready:
            return []
        data, last = tail + b"".join(ready), 0 <= end < following
        pages, gaps = ogg.parse(data)
        found = sorted([(p.at, p.size, p) for p in pages] + [(src, n, None) for _, src, n in gaps], key=lambda x: x[0])
        cut = len(data)
        if not last and found and found[-1][2] is None:
            start, size, _ = found.pop()
            # the gap's end may be a page that isn't whole yet: keep from its first possible start
            first = data.find(b"OggS", max(start, len(data) - keep))
            cut = first if first >= 0 else max(start, len(data) - 3)
            if cut > start:
                found.append((start, cut - start, None))
        file[:3] = data[cut:], base + cut, following
        return [(path, base + at, "page" if p else "gap", n, p and p.serial, p and p.granule) for at, n, p in found]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files: dict[str, list] = {}
        if state.exists:
            paths, tails, bases, following, ends, owners, numbers, waiting = state.get
            files = {path: [bytes(tail), *rest, {}] for path, tail, *rest in zip(paths, tails, bases, following, ends, strict=True)}
            for owner, number, data in zip(owners, numbers, waiting, strict=True):
                files[paths[owner]][4][number] = bytes(data)
        came: dict[str, list] = {}
        for batch in parts:
            for path, number, data, last in zip(batch["path"], batch["block"], batch["data"], batch["last"], strict=True):
                file = came[path] = files.setdefault(path, [b"", 0, 0, -1, {}])
                file[4][int(number)] = bytes(data)
                if last:
                    file[3] = int(number)
        rows = [row for path, file in came.items() for row in forward(path, file)]
        wait = [(i, number, data) for i, file in enumerate(files.values()) for number, data in file[4].items()]
        held = [list(files), *([file[k] for file in files.values()] for k in range(4)), *([x[k] for x in wait] for k in range(3))]
        state.update(tuple(held))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"serial": "Int64", "granule": "Int64"})

    held = "path array<string>, tail array<binary>, base array<long>, following array<int>, end array<int>, owner array<int>, number array<int>, waiting array<binary>"
    rows = _bucketed(blocks, "path", buckets)
    return rows.groupBy("bucket").applyInPandasWithState(run, PAGES, held, "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Rows and batches of the running streams, for those who wait: register with ``spark.streams.addListener``."""

    def __init__(self, show: Callable[[str], None] = print) -> None:
        self.show, self.rows, self.batches = show, 0, 0

    def onQueryStarted(self, event: Any) -> None:
        self.show(f"started {event.id}")

    def onQueryProgress(self, event: Any) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.show(f"{self.rows} rows in {self.batches} batches")

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.show(f"ended after {self.rows} rows")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, in micro-batches, into the shared folder, and reads the result.

    Batches are written by their number, so that one that is run again replaces itself. In ``complete`` mode
    each batch has the whole result, and the last one's is read.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        done.append(number)

    writer: Any = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    found = f"{base}/out/batch={max(done)}" if mode == "complete" else f"{base}/out"
    return spark.read.schema(stream.schema).parquet(found).select(*stream.columns)

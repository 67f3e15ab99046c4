import random
import time

from strandflow.plans import streams
from strandflow.sources import ogg
from strandflow.streaming import stateful


def test_pages_over_blocks(spark, tmp_path):
    rng = random.Random(1)
    raw = {k: b"junk" * k + ogg.build_stream([rng.randbytes(rng.randrange(900)) for _ in range(20)], k, segments=5) + b"Ogg" for k in (1, 2)}
    schema = "path string, block int, data binary, last boolean"
    size = 700
    blocks = [(str(k), i, data[i * size : (i + 1) * size], (i + 1) * size >= len(data)) for k, data in raw.items() for i in range(-(-len(data) // size))]
    for part in range(3):  # files arrive in order of blocks
        mine = [b for b in blocks if b[1] % 1000 // 5 == part or (part == 2 and b[1] // 5 > 2)]
        if mine:
            spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.stream_table(spark, str(tmp_path / "in"), schema)
    out = stateful.drain(stateful.page_stream(stream)).collect()
    for k, data in raw.items():
        pages, _ = ogg.parse(data)
        mine = sorted((r.at, r.len, r.kind) for r in out if r.path == str(k))
        assert [(at, n) for at, n, kind in mine if kind == "page"] == [(p.at, p.size) for p in pages]
        assert sum(n for _, n, _ in mine) == len(data)
        assert all(a + n == b for (a, n, _), (b, *_) in zip(mine, mine[1:], strict=False))


def test_links_keep_state_over_batches(spark, tmp_path):
    rows = [(u, i, f"2024-01-01 00:{i:02d}:00", "signup" if (i + u) % 4 == 0 else "view") for u in range(3) for i in range(30)]
    schema = "user_id long, event_id long, ts string, event_type string"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = stateful.stream_table(spark, str(tmp_path / "ev"), schema)
    out = {(r.user_id, r.event_id): r.link for r in stateful.drain(stateful.marker_links(stream, "signup")).collect()}
    for u in range(3):
        n = 0
        for i in range(30):
            n += (i + u) % 4 == 0
            assert out[(u, i)] == n


def test_late_events_are_kept_aside(spark, tmp_path):
    schema = "user_id long, event_id long, ts string, event_type string"
    parts = [[(1, 5, "2024-01-05", "signup"), (1, 6, "2024-01-06", "view")], [(1, 2, "2024-01-02", "signup"), (1, 7, "2024-01-07", "signup")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        time.sleep(0.05)
    stream = stateful.stream_table(spark, str(tmp_path / "ev"), schema)
    out = {r.event_id: r.link for r in stateful.drain(stateful.marker_links(stream, "signup")).collect()}
    assert out == {5: 1, 6: 1, 2: None, 7: 2}


def test_tables_of_several_files(spark, tmp_path):
    """The streamed queries don't depend on how a table is cut into files, nor on their order."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    for run in (streams.stateful_links, streams.stream_windows):
        one = sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect()))
        several = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
        assert one == several
    assert sum(r[-1] for r in several) == events.count()


def test_progress(spark, tmp_path):
    said = []
    listener = stateful.Progress(said.append)
    spark.streams.addListener(listener)
    try:
        schema = "user_id long, event_id long, ts string, event_type string"
        spark.createDataFrame([(1, 1, "2024-01-01", "signup"), (1, 2, "2024-01-02", "view")], schema).coalesce(1).write.parquet(str(tmp_path / "ev"))
        stateful.drain(stateful.marker_links(stateful.stream_table(spark, str(tmp_path / "ev"), schema), "signup"))
        for _ in range(100):
            if said and said[-1].startswith("ended"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows == 2 and said[0].startswith("started") and said[-1] == "ended after 2 rows"


def test_keys_share_states(spark, tmp_path):
    """A call and a state for a bucket of keys, not for each key: with a key a call, 50,000 documents took 230 s of CPU."""
    schema = "user_id long, event_id long, ts string, event_type string"
    rows = [(u if u else None, i, f"2024-01-01 00:{i:02d}:00", "signup" if i % 2 else "view") for u in range(40) for i in range(4)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        time.sleep(0.05)
    stream = stateful.stream_table(spark, str(tmp_path / "ev"), schema)
    links = stateful.marker_links(stream, "signup", buckets=3)
    said = []

    def put(batch, number):
        said.extend(map(tuple, batch.collect()))

    q = links.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(said, key=str) == sorted(((u, i, (i + 1) // 2) for u, i, _, _ in rows), key=str)
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 3

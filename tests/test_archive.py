import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.sources import archive


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.lists(st.binary(max_size=3000), max_size=6), st.integers(1, 700))
def test_round_trip(name, streams, chunk):
    assert archive.decode(archive.encode(name, streams, chunk=chunk)) == (name, streams)


def test_chunks_alternate_and_are_stored_if_not_smaller():
    rng = random.Random(1)
    noise = rng.randbytes(3 << 20)
    data = archive.encode("n", [noise, b"a" * (1 << 20)])
    assert archive.decode(data)[1][0] == noise and len(data) < len(noise) + 5000


def test_damage_is_refused():
    rng = random.Random(2)
    data = archive.encode("name", [rng.randbytes(500), b"text " * 200])
    assert archive.decode(data)[0] == "name"
    for at in range(0, len(data), 7):
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        try:
            name, streams = archive.decode(bytes(bad))
        except archive.ArchiveError:
            continue
        assert 7 <= at < 7 + 4 and name != "name"  # only the name itself isn't covered by the checksum
    for cut in (0, 3, 10, len(data) // 2, len(data) - 1):
        with pytest.raises(archive.ArchiveError):
            archive.decode(data[:cut])
    with pytest.raises(archive.ArchiveError, match="after the end"):
        archive.decode(data + b"x")


def test_data_source(spark, tmp_path):
    archive.register(spark)
    rows = [(f"doc{i}", s, bytes([i]) * (100 * s)) for i in range(6) for s in (1, 2)]
    df = spark.createDataFrame(rows, archive.SCHEMA).repartition(3, "name")
    df.write.format("sfarchive").mode("append").save(str(tmp_path / "a"))
    out = spark.read.format("sfarchive").load(str(tmp_path / "a")).collect()
    assert sorted((r.name, r.stream, bytes(r.data)) for r in out) == sorted(rows)
    assert not list((tmp_path / "a").glob("*.tmp"))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mp3_spectra import RATE, spectra
from test_payload_models import operations
from test_tracker_code import module_cells, wave

from strandflow.functions import checksums
from strandflow.operators import coders, context, models
from strandflow.sources import mp3_code, mp3_spectra, opus_entropy
from strandflow.sources import tracker_code as T


def ints(values):
    return np.asarray(values, "<i4").tobytes()


def cases():
    rng = random.Random(7)
    data = b"".join(f"sample {i}".encode().ljust(22, b"\0") + rng.randbytes(8) for i in range(9))
    coder = T.record_coder()
    T.records(coder, data, 9, 30)
    yield "records", data, 9, 30, None, coder.finish()
    for channels in (4, 5):
        cells = module_cells(80, channels, channels)
        yield "patterns", cells, len(cells) // 4, channels, None, T.code_patterns(cells, channels)
    rows = [(r, r % 8, 0 if r % 3 else None, 64 + r % 12, 1, None, rng.choice([1, 4]), r % 3) for r in range(64)]
    for some in (rows, []):
        coder = T.event_coder()
        T.events(coder, some, len(some))
        yield "events", T.pack_events(some), len(some), None, None, coder.finish()
    xs, other = wave(300, 3, 16), wave(300, 4, 16)
    yield "samples", ints(xs), 300, 16, None, T.code_samples(xs, 16)
    yield "samples", ints(xs), 300, 16, ints(other), T.code_samples(xs, 16, other)
    extremes = [127, -128] * 60
    yield "samples", ints(extremes), 120, 8, None, T.code_samples(extremes)
    text = bytes(rng.choice(b"abcabcdd\xff") for _ in range(700))
    for some in (text, b""):
        yield "order1", some, len(some), None, None, models.code_bytes(some)
    numbers, coder, size, last = [rng.randrange(-(10**12), 10**12) * rng.choice([0, 1]) for _ in range(80)], context.SymbolCoder(2), 0, 0
    for v in numbers:
        coder.number("d", v - last, [0, size])
        size, last = (v - last).bit_length(), v
    yield "numbers", np.array(numbers, "<i8").tobytes(), 80, None, None, coder.finish()
    t = mp3_spectra.Tables()
    coder, given = mp3_code.GranuleCoder(t, RATE), []
    for k, lines in enumerate(list(spectra())[:6]):
        g = mp3_spectra.plan(t, lines, RATE) | {"global_gain": 150 + k, "scalefac": k}
        given.append((g, *mp3_spectra.emit(t, lines, g, RATE)))
        coder.granule(*given[-1])
    packed = mp3_code.pack_granules(t, given, RATE)
    assert [x[1:] for x in mp3_code.unpack_granules(t, packed, RATE)] == [x[1:] for x in given]
    yield "granules", packed, 6, None, ints(mp3_spectra.BANDS[RATE]), coder.finish()
    ops = operations(rng, 150)
    coder = opus_entropy.OperationCoder()
    for op in ops:
        coder.value(op.kind, op.site, op.params, op.value)
    shapes, values = opus_entropy.pack_operations(ops)
    yield "operations", values, None, None, shapes, coder.finish()


def test_columns_are_coded_as_the_python_models_code(spark):
    found = list(cases())
    schema = "k int, model string, data binary, a int, b int, c binary, wanted binary"
    df = spark.createDataFrame([(k, *(bytearray(x) if isinstance(x, bytes) else x for x in case)) for k, case in enumerate(found)], schema)
    for model in {case[0] for case in found}:
        mine = df.where(F.col("model") == model).withColumn("coded", coders.encode(spark, model, *map(F.col, ("data", "a", "b", "c"))))
        back = mine.withColumn("back", coders.decode(spark, model, F.col("coded"), *map(F.col, ("a", "b", "c"))))
        for row in back.collect():
            assert bytes(row.coded) == bytes(row.wanted) and bytes(row.back) == bytes(row.data), (model, row.k)


def test_checksums_of_columns(spark):
    rng = random.Random(2)
    rows = [b"", b"123456789", *(rng.randbytes(n) for n in (1, 255, 4099))]
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "data binary")
    found = df.select("data", coders.checksum(spark, "crc32c", F.col("data")).alias("c"), coders.checksum(spark, "ogg_crc", F.col("data")).alias("o")).collect()
    assert [(r.c, r.o) for r in found] == [(checksums.crc32c(bytes(r.data)), checksums.ogg_crc(bytes(r.data))) for r in found]


def test_nothing_is_coded_as_nothing(spark):
    df = spark.createDataFrame([(None,)], "data binary")
    assert df.select(coders.encode(spark, "order1", F.col("data")).alias("x")).first().x is None


@pytest.mark.parametrize("key", [248, 687])
def test_another_channel_helps_short_samples(key):
    from strandflow.plans.coding import _wave

    n = 400 + key % 50
    left = _wave(key + 1, n, 16)
    right = [min(32767, max(-32768, a + b)) for a, b in zip(left, _wave(key + 2, n, 10), strict=True)]
    assert len(T.code_samples(right, 16, left)) < len(T.code_samples(right, 16))

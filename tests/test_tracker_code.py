import random

import pytest

from strandflow.operators import context as C
from strandflow.operators.pool import Pool, pooled
from strandflow.sources import tracker
from strandflow.sources import tracker_code as T


def module_cells(rows, channels, seed):
    rng = random.Random(seed)
    riff = [[(rng.choice([0, 1, 2]), rng.choice([0, 428, 404, 381]), rng.choice([0, 0, 12, 15]), rng.choice([0, 6, 64])) for _ in range(channels)] for _ in range(8)]
    return b"".join(T.join_cell(*(riff[r % 8][c] if rng.random() < 0.9 else (3, 320, 1, 9))) for r in range(rows) for c in range(channels))


def test_cells_and_patterns_round_trip():
    for cell in (bytes(4), b"\x1f\xff\xff\xff", b"\xf0\x01\x02\x03"):
        assert T.join_cell(*T.split_cell(cell)) == cell
    cells = module_cells(192, 4, 1)
    coded = T.code_patterns(cells, 4)
    assert T.decode_patterns(coded, len(cells) // 4, 4) == cells
    assert len(coded) < len(C.mixed_bytes(cells))  # fields in their contexts cost less than bytes
    assert T.decode_patterns(T.code_patterns(b"", 4), 0, 4) == b""


def test_events_of_three_formats_round_trip():
    rng = random.Random(2)
    it = list(tracker.unpack_it(tracker.pack_it([(r, r % 4, 0, 40 + r % 3, 1, None, 1, r % 5) for r in range(0, 64, 2)], 64), 64))
    s3m = [(r, r % 8, 0, 64 + r % 12, 1, None, rng.choice([1, 4]), r % 3) for r in range(64)]
    xm = [(r, c, 31, 49, 1, None, None, 2) for r in range(32) for c in range(2)]
    for rows in (it, s3m, xm, []):
        coder = T.event_coder()
        assert T.events(coder, rows, len(rows)) == rows
        coded = coder.finish()
        assert T.events(T.event_coder(coded), None, len(rows)) == rows
    assert coder.cost is not None


def test_records_round_trip():
    data = b"".join(b"inst".ljust(10, b"\0") + bytes([64, i, 0, 0, 1, 255]) for i in range(20))
    coder = T.record_coder()
    assert T.records(coder, data, 20, 16) == data
    assert T.records(T.record_coder(coder.finish()), None, 20, 16) == data


def wave(n, seed, bits=8):
    rng = random.Random(seed)
    half = 1 << bits - 1
    x, v, out = 0.0, 0.0, []
    for _ in range(n):
        v = 0.95 * v - 0.02 * x + rng.gauss(0, half / 40)
        x += v
        out.append(min(half - 1, max(-half, round(x))))
    return out


def test_samples_round_trip_and_learn():
    xs = wave(1500, 3)
    coded = T.code_samples(xs)
    assert T.decode_samples(coded, len(xs)) == xs
    assert len(coded) < len(xs) * 0.9
    wide = wave(600, 4, 16)
    assert T.decode_samples(T.code_samples(wide, 16), 600, 16) == wide
    extremes = [127, -128] * 40
    assert T.decode_samples(T.code_samples(extremes), 80) == extremes


def test_another_channel_helps():
    left = wave(1200, 5, 16)
    right = [min(32767, max(-32768, x + d)) for x, d in zip(left, wave(1200, 6, 10), strict=True)]
    alone, along = T.code_samples(right, 16), T.code_samples(right, 16, left)
    assert T.decode_samples(along, 1200, 16, left) == right
    assert len(along) < len(alone)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("twice", [False, True])
def test_width_policies(wide, twice):
    bits = 16 if wide else 8
    rng = random.Random(bits + twice)
    values = []
    for _ in range(120):
        size = rng.choice([1, 2, 3, 5, 7, bits])
        values += [rng.randrange(-(1 << size - 1), 1 << size - 1) if size > 1 else 0 for _ in range(rng.randrange(1, 40))]
    for k in range(3):
        data = T.recompress(values, wide, twice, k)
        assert tracker.decompress(data, 0, len(values), wide, twice) == values
        assert len(data) <= len(tracker.compress(values, wide, twice))
        policy, votes, _ = T.policy_votes(data, len(values), wide)
        assert votes[k] and votes[policy] == max(votes)
        got, odd = T.canonical(data, len(values), wide, twice)
        assert not odd and T.recompress(values, wide, twice, got, odd) == data
    # an encoder with habits of its own keeps its widths
    own = tracker.compress(values, wide, twice)
    policy, odd = T.canonical(own, len(values), wide, twice)
    assert policy is None and T.recompress(values, wide, twice, policy, odd) == own


def test_several_blocks_vote():
    rng = random.Random(9)
    values = [rng.randrange(-4, 4) if rng.random() < 0.95 else rng.randrange(-128, 128) for _ in range(0x8000 * 2 + 50)]
    data = T.recompress(values, False, False, 1)
    policy, votes, widths = T.policy_votes(data, len(values), False)
    assert policy == 1 and votes[1] == 3 == len(widths)


def test_least_width_holds():
    for wide, bits, spare in ((False, 8, 4), (True, 16, 8)):
        for d in range(-300, 300):
            if not wide and not -128 <= d < 128:
                continue
            w = T.least_width(d, wide)
            half = 1 << w - 1
            assert w == bits + 1 or ((-half < d < half) if w <= 6 else (-half + spare <= d < half - spare))


def test_mixed_bytes():
    data = b"the cat sat on the mat, the cat ate the rat; " * 12 + bytes(range(40))
    coded = C.mixed_bytes(data)
    assert C.unmixed_bytes(coded, len(data)) == data and len(coded) < 200
    assert C.unmixed_bytes(C.mixed_bytes(b""), 0) == b""


def test_numbers_round_trip():
    xs = [0, 1, -1, 2, 255, -256, 65535, -(1 << 30), 5, 5, 5]
    coder = C.SymbolCoder(2)
    assert [coder.number("n", x, [0, 1]) for x in xs] == xs
    back = C.SymbolCoder(2, (), coder.finish())
    assert [back.number("n", None, [0, 1]) for _ in xs] == xs
    assert coder.cost["n.size"] == pytest.approx(back.cost["n.size"])


def test_slots_against_exact_state():
    slots, exact = C.Slots(4), {}
    rng = random.Random(1)
    common = [C.mix64(i) for i in range(20)]
    for _ in range(3000):
        h = rng.choice(common) if rng.random() < 0.8 else C.mix64(rng.randrange(10**6) + 100)
        i = slots.find(h)
        assert slots.find(h) == i  # found again at once
        bit = int(h % 5 > 1)
        slots.update(i, bit)
        exact.setdefault(h, []).append(bit)
    kept = sum(slots.n[slots.find(h)] > 5 for h in common)
    assert kept >= 15  # what is used often stays, though thousands of others passed through 64 slots
    for h in common:
        i = slots.find(h)
        if slots.n[i] > 5:
            assert (slots.p[i] > 32768) == (h % 5 > 1)


def test_hashes_spread():
    assert len({C.mix64(i) & 0xFFFF for i in range(3000)}) > 2900 and len({C.mix32(i) >> 16 for i in range(3000)}) > 2900
    assert C.composite(1, 2) != C.composite(2, 1) != C.composite(1, 2, 0)
    assert C.ngram(b"xabcd", 5, 4) == C.ngram(b"yyabcd", 6, 4) != C.ngram(b"abcd", 3, 4)


def test_pool():
    p = Pool(2)
    assert p.take((), [1, 2, 3])[1] == "new" and p.take((), [1, 2, 3]) == (0, "near", 0)
    assert p.take((), [1, 2, 4])[:2] == (0, "near")  # a third of a bit a length
    assert p.take((), [9, 9, 9, 9])[1] == "new"  # another shape
    assert p.take((), [5, 6, 7])[:2] == (0, "replaced")  # near enough to take the nearest's place
    assert p.take((1,), [5, 6, 7])[:2] == (0, "replaced")  # no slot of its shape: the least used goes
    p.slots[0].uses, p.slots[1].uses = 3, 0
    p.end_link()
    assert [s.uses for s in p.slots] == [3, 0]
    p.end_link()
    assert [s.uses for s in p.slots] == [2, 0]


def test_pool_over_chains(spark):
    rows = [(c, link, s, [1 + (c + link * s) % 3, 2, 0]) for c in range(3) for link in range(4) for s in range(5)]
    got = sorted(tuple(r) for r in pooled(spark.createDataFrame(rows, "chain long, link long, seq long, lengths array<int>")).collect())
    want = []
    for c in range(3):
        pool, last = Pool(), 0
        for cc, link, s, lengths in rows:
            if cc == c:
                if link != last:
                    pool.end_link()
                last = link
                want.append((c, link, s, *pool.take((), lengths)))
    assert got == sorted(want)

import itertools
import random

import pytest

from strandflow.functions.bits import MsbReader, MsbWriter
from strandflow.sources import mp3_spectra as S

RATE = 44100


def large_table(size, seed):
    """A complete prefix code over pairs below ``size``, at random: what a caller's own tables are."""
    rng = random.Random(seed)
    words = [""]
    while len(words) < size * size:
        w = words.pop(rng.randrange(len(words)))
        words += [w + "0", w + "1"]
    rng.shuffle(words)
    return tuple(tuple(words[i * size : (i + 1) * size]) for i in range(size))


@pytest.mark.parametrize("words", [*([w for row in t for w in row] for t in S.SMALL_PAIRS.values()), S.QUADS, S.Tables().quad(1)])
def test_tables_are_complete_prefix_codes(words):
    assert sum(2.0 ** -len(w) for w in words) == 1
    assert not any(a != b and b.startswith(a) for a, b in itertools.product(words, words))


def spectra():
    rng = random.Random(1)
    for k in range(30):
        lines = [0] * 576
        big, end = rng.choice([(0, 0), (0, 9), (50, 120), (2, 2), (300, 576), (576, 576)])
        top = rng.choice([1, 2, 3])
        for i in range(end):
            lines[i] = rng.randint(-top, top) if i < big else rng.choice([-1, 0, 0, 1])
        yield lines


def test_round_trip():
    t = S.Tables()
    for lines in spectra():
        g = S.plan(t, lines, RATE)
        raw, bits = S.emit(t, lines, g, RATE)
        r = MsbReader(raw + b"\0\0")
        found = list(S.symbols(t, r, g, RATE, bits))
        assert r.at == bits == sum(x[3] for x in found)
        assert S.spectrum(t, MsbReader(raw + b"\0\0"), g, RATE, bits) == lines
        assert S.payload_estimate(t, lines, g, RATE) == bits


def test_large_tables_with_escapes():
    t = S.Tables(S.SMALL_PAIRS | {13: large_table(16, 2), 16: large_table(16, 3)}, {16: 13})
    rng = random.Random(4)
    lines = [rng.choice([0, 1, -3, 14, -15, 16, 8000]) for _ in range(100)] + [0] * 476
    g = S.plan(t, lines, RATE)
    raw, bits = S.emit(t, lines, g, RATE)
    assert 16 in g["table_select"] and S.spectrum(t, MsbReader(raw + b"\0"), g, RATE, bits) == lines
    with pytest.raises(ValueError, match="no table"):
        S.best_table(S.Tables(), [9, 0])


def test_best_table_against_all():
    t = S.Tables()
    rng = random.Random(5)
    for _ in range(50):
        top = rng.randint(0, 3)
        lines = [rng.randint(-top, top) for _ in range(2 * rng.randint(1, 40))]
        table, bits = S.best_table(t, lines)
        costs = {}
        for k, rows in t.pairs.items():
            if max(map(abs, lines)) < len(rows):
                costs[k] = sum(len(rows[abs(a)][abs(b)]) + (a != 0) + (b != 0) for a, b in zip(lines[::2], lines[1::2], strict=True))
        assert (table, bits) == ((0, 0) if not any(lines) else (min(costs, key=lambda k: (costs[k], k)), min(costs.values())))


def test_scalefactors():
    rng = random.Random(6)
    before = None
    for _ in range(20):
        values = [rng.randrange(8) for _ in range(11)] + [rng.randrange(4) for _ in range(10)]
        shared = [rng.randrange(2) for _ in range(4)]
        if before:
            for k, (i, j) in enumerate(((0, 6), (6, 11), (11, 16), (16, 21))):
                if shared[k]:
                    values[i:j] = before[i:j]
        choice = S.least_choice(values)
        w = MsbWriter()
        n = S.write_scalefactors(w, values, choice, shared, before is None)
        assert S.scalefactors(MsbReader(w.bytes() + b"\0"), choice, shared, before) == (values, n)
        before = values
    assert S.least_choice([16] * 21) is None and S.least_choice([0] * 21) == 0


def test_a_plan_costs_each_pair_once(monkeypatch):
    calls = []
    cost = S.pair_bits
    monkeypatch.setattr(S, "pair_bits", lambda t, k, a, b: calls.append(k) or cost(t, k, a, b))
    for t in (S.Tables(), S.Tables(S.SMALL_PAIRS | {7: large_table(6, 2)})):
        for lines in spectra():
            calls.clear()
            g = S.plan(t, lines, RATE)
            assert len(calls) <= len(t.pairs) * 288
            big, best = S.extents(lines)[0], []
            for region0, region1 in itertools.product(range(16), range(8)):
                a, b = S.regions(RATE, big, region0, region1)
                best.append(sum(S.best_table(t, lines[i:j])[1] for i, j in ((0, a), (a, b), (b, big))))
            a, b = S.regions(RATE, big, g["region0"], g["region1"])
            chosen = [S.best_table(t, lines[i:j]) for i, j in ((0, a), (a, b), (b, big))]
            assert [k for k, _ in chosen] == g["table_select"] and sum(x for _, x in chosen) == min(best)

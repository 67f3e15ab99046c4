import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import pytest

from strandflow.llm import packing

DOCS = "doc_id long, text string, start long, length string"


def check(rows, out, window=packing.WINDOW):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


TEXTS = [
    None, "", "   \n", "Hello, World.", "it's we'll x.'s 'S a.b,c", "<|endoftext|> <|STARTOFTEXT|> a<|endoftext|>b", "ÄÖ é é. ̈ x y z\x1cq",
    "ΟΔΟΣ Σ İI ﬁ ½ ² ١٢", "😀👩‍👩‍👧 12.5,3 $%&", "word " * 3000, "x" * 5000, "Ünï.cödé,",
]


def test_round_trip(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "of.", "Xy,", "zq", "tion"]) for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    rows = [(i, t, 5, "clash") for i, t in enumerate(texts)]
    out = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert check(rows, out) == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "a b c", 0, "")] * 3 + [(None, "d e", 0, "")] * 2
    out = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in out if r.start == 0) == [(0, 3)] * 2 + [(7, 4)] * 3
    assert sum(r.length for r in out) == 18


def test_sum_of_squares_level():
    p = packing.Packer(0, window=10)
    for size in (6, 6, 3):
        p.add((size, size), b"\0\0\0\0" * size)
    assert p.counts[6] == 1 and p.counts[9] == 1  # squares: 1 + 1, not 4 + 1 for a new window
    p.add((1, 1), b"\0\0\0\0")
    assert [r[2] for r in p.take()] == [6, 3, 1] and p.counts[6] == 1  # closing a window costs nothing


def brute_sequences(sizes, window):
    """Sum-of-squares placement with the whole sum over again for each choice: the pieces of each sequence in order, and the open windows."""
    done, windows = [], []  # windows: [level, pieces], oldest first
    for name, size in sizes:
        for _ in range(size // window):
            done.append([name])
        size %= window
        if not size:
            continue
        best = None
        for level in range(window - size, -1, -1):  # of equals the fullest
            if level and not any(w[0] == level for w in windows):
                continue
            levels = [w[0] for w in windows] + [level + size]
            if level:
                levels.remove(level)
            cost = sum(levels.count(x) ** 2 for x in set(levels) if x < window)
            if best is None or cost < best[0]:
                best = cost, level
        level = best[1]
        held = windows.pop(max(i for i, w in enumerate(windows) if w[0] == level)) if level else [0, []]
        held = [held[0] + size, [*held[1], name]]
        if held[0] == window:
            done.append(held[1])
        else:
            windows.append(held)
    return done, sorted(windows)


@pytest.mark.parametrize(("window", "largest", "seed"), [(10, 9, 1), (16, 40, 2), (64, 30, 3), (32, 20, 4)])
def test_placement_against_brute_force(window, largest, seed):
    rng = random.Random(seed)
    sizes = [(i, rng.randrange(1, largest + 1)) for i in range(120)]
    packer = packing.Packer(0, window=window)
    for name, size in sizes:
        packer.add((name, size), b"\0\0\0\0" * size)
    done, windows = brute_sequences(sizes, window)
    by = defaultdict(list)
    for r in packer.take():
        by[r[5]].append(r[0])
    assert [by[i] for i in range(len(by))] == done
    assert sorted([level, [p[0][0] for p in held]] for level, stack in packer.open.items() for held in stack) == windows


@pytest.mark.parametrize(("low", "high"), [(1, 64), (33, 44)])
def test_bounded_open_windows(low, high):
    rng = random.Random(3)
    p, size = packing.Packer(0, window=64, max_open=5), 0
    for i in range(500):
        n = rng.randrange(low, high)
        size += n
        p.add((i, n), b"\0\0\0\0" * n)
        assert p.n_open <= 5 and p.n_open == p.counts.sum()
    p.finish()
    rows = p.take()
    assert sum(r[2] for r in rows) == size and p.n_open == 0 and not p.counts.any()
    by, ways = defaultdict(int), defaultdict(set)
    for r in rows:
        assert r[6] == by[r[5]]
        by[r[5]] += r[2]
        ways[r[5]].add(r[7])
    assert all(n & (n - 1) == 0 for n in by.values()) and sorted(by) == list(range(len(by)))
    assert all(len(w) == 1 for w in ways.values()) and set().union(*ways.values()) <= {"whole", "placed", "joined", "cut"}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r[0]].append((r[1], r[2]))
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length


def test_whole_windows_complete_before_cuts():
    p = packing.Packer(0, window=10)
    for size in (7, 6, 4):  # 6 and 4 meet by placement; 7, 2 and 1 at the end, uncut
        p.add((size, size), b"\0\0\0\0" * size)
    assert {r[7] for r in p.take()} == {"placed"}
    for size in (2, 2):
        p.push(size, [((size, size), 0, b"\0\0\0\0" * size)])
    p.finish()
    rows = p.take()
    assert [(r[0], r[2], r[7]) for r in rows] == [(7, 7, "cut"), (2, 2, "cut"), (2, 1, "cut"), (2, 1, "cut")]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0

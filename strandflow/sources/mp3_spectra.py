"""Spectra of MPEG-1 layer III granules: scalefactors, big-value regions, quadruples, and the cost of coding them.

Code tables are a parameter: ``Tables`` holds those of pairs by number, and the two of quadruples. The small
ones stand here; a caller who has the standard's large ones adds them (``Tables(pairs | {7: ...})``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandflow.functions.bits import MsbReader, MsbWriter

LINES = 576
# Fixed values, by the public standard.
#: First lines of scalefactor bands of long blocks, by sampling rate.
BANDS = {
    44100: (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418, 576),
    48000: (0, 4, 8, 12, 16, 20, 24, 30, 36, 42, 50, 60, 72, 88, 106, 128, 156, 190, 230, 276, 330, 384, 576),
    32000: (0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 54, 66, 82, 102, 126, 156, 194, 240, 296, 364, 448, 550, 576),
}
#: Bits of scalefactors in the lower and the upper bands, by the granule's choice.
SCALEFACTOR_BITS = ((0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3))
#: Code words of pairs by table: rows by the first magnitude, columns by the second.
SMALL_PAIRS = {
    1: (("1", "001"), ("01", "000")),
    2: (("1", "010", "000001"), ("011", "001", "00001"), ("00011", "00010", "000000")),
    3: (("11", "10", "000001"), ("001", "01", "00001"), ("00011", "00010", "000000")),
    5: (("1", "010", "000110", "0000101"), ("011", "001", "000100", "0000100"), ("000111", "000101", "0000111", "00000001"), ("0000110", "000001", "0000001", "00000000")),
    6: (("111", "011", "00101", "0000001"), ("110", "10", "0011", "00010"), ("0101", "0100", "00100", "000001"), ("000011", "00011", "000010", "0000000")),
}
#: Code words of quadruples: by the bits v w x y, the first table; the second has their complement in four bits.
QUADS = (
    "1", "0101", "0100", "00101", "0110", "000101", "00100", "000100", "0111", "00011", "00110", "000000", "00111", "000010", "000011", "000001",
)


@dataclass(frozen=True)
class Tables:
    pairs: dict[int, tuple] = field(default_factory=lambda: SMALL_PAIRS)
    #: Bits added to the largest magnitude of a table that has them.
    linbits: dict[int, int] = field(default_factory=dict)

    def quad(self, table: int) -> tuple[str, ...]:
        return tuple(f"{15 - v:04b}" for v in range(16)) if table else QUADS

    def most(self, table: int) -> int:
        """The largest magnitude that a table codes."""
        if not table:
            return 0
        top = len(self.pairs[table]) - 1
        return top + (1 << self.linbits[table]) - 1 if self.linbits.get(table) else top


def pair_bits(t: Tables, table: int, a: int, b: int) -> int:
    """Bits of a pair with its signs and escapes; more than any where the table has no word for it."""
    if not table:
        return 0 if not a and not b else 1 << 20
    if max(abs(a), abs(b)) > t.most(table):
        return 1 << 20
    rows, lin = t.pairs[table], t.linbits.get(table, 0)
    top = len(rows) - 1
    x, y = min(abs(a), top), min(abs(b), top)
    return len(rows[x][y]) + sum((v != 0) + (lin if lin and abs(v) >= top else 0) for v in (a, b))


def region_bits(t: Tables, table: int, lines: list[int]) -> int:
    return sum(pair_bits(t, table, a, b) for a, b in zip(lines[::2], lines[1::2], strict=True))


def best_table(t: Tables, lines: list[int]) -> tuple[int, int]:
    """(table, bits): the cheapest of those that code the region's largest magnitude; 0 for silence, ties to the smallest number."""
    largest = max(map(abs, lines), default=0)
    if not largest:
        return 0, 0
    fits = [(region_bits(t, k, lines), k) for k in sorted(t.pairs) if t.most(k) >= largest]
    if not fits:
        raise ValueError(f"no table holds {largest}")
    bits, table = min(fits)
    return table, bits


def extents(lines: list[int]) -> tuple[int, int]:
    """(end of big values, end of quadruples): lines from the first end on are -1 to 1, from the second on zero."""
    end = LINES
    while end and not lines[end - 1]:
        end -= 1
    big = end
    while big and abs(lines[big - 1]) <= 1:
        big -= 1
    big += big % 2
    return big, min(LINES, big + math.ceil(max(0, end - big) / 4) * 4)


def regions(rate: int, big: int, region0: int, region1: int) -> tuple[int, int]:
    """Ends of the first two regions."""
    bands = BANDS[rate]
    first = min(big, bands[min(22, region0 + 1)])
    return first, min(big, bands[min(22, region0 + region1 + 2)])


def quad_bits(t: Tables, table: int, lines: list[int]) -> int:
    words, total = t.quad(table), 0
    for i in range(0, len(lines), 4):
        four = lines[i : i + 4]
        total += len(words[sum((v != 0) << 3 - k for k, v in enumerate(four))]) + sum(v != 0 for v in four)
    return total


def payload_estimate(t: Tables, lines: list[int], g: dict, rate: int) -> int:
    """Bits of a granule's spectrum: its three regions by their tables, and the quadruples up to the last line that isn't zero."""
    big = 2 * g["big_values"]
    a, b = regions(rate, big, g["region0"], g["region1"])
    cuts = ((0, a), (a, b), (b, big))
    end = max(big, extents(lines)[1])
    while (end - big) % 4:
        end += 1
    return sum(region_bits(t, k, lines[i:j]) for k, (i, j) in zip(g["table_select"], cuts, strict=True)) + quad_bits(t, g["count1"], lines[big:end])


def _region_costs(t: Tables, lines: list[int], big: int) -> Callable[[int, int], tuple[int, int]]:
    """``best_table`` of any region up to ``big``: a pair's bits are summed up once for each table, not for each region that has it."""
    bits_of = cache(lambda k, a, b: pair_bits(t, k, a, b))
    pairs = list(zip(lines[:big:2], lines[1:big:2], strict=True))
    sums = {k: [0, *accumulate(bits_of(k, a, b) for a, b in pairs)] for k in sorted(t.pairs)}

    @cache
    def of(start: int, end: int) -> tuple[int, int]:
        largest = max(map(abs, lines[start:end]), default=0)
        if not largest:
            return 0, 0
        fits = [(total[end // 2] - total[start // 2], k) for k, total in sums.items() if t.most(k) >= largest]
        if not fits:
            raise ValueError(f"no table holds {largest}")
        bits, table = min(fits)
        return table, bits

    return of


def plan(t: Tables, lines: list[int], rate: int) -> dict:
    """Side information of the cheapest coding of a spectrum over all divisions into regions."""
    big, end = extents(lines)
    cheapest = _region_costs(t, lines, big)
    best: tuple[int, dict] | None = None
    for region0 in range(16):
        for region1 in range(8):
            a, b = regions(rate, big, region0, region1)
            found = [cheapest(i, j) for i, j in ((0, a), (a, b), (b, big))]
            bits = sum(x[1] for x in found)
            if best is None or bits < best[0]:
                best = bits, {"big_values": big // 2, "region0": region0, "region1": region1, "table_select": [x[0] for x in found]}
            if a >= big:
                break
        if regions(rate, big, region0, 0)[0] >= big:
            break
    g = best[1]
    quads = [quad_bits(t, k, lines[big:end]) for k in (0, 1)]
    return g | {"count1": quads.index(min(quads)), "block_type": 0, "lines": end}


def emit(t: Tables, lines: list[int], g: dict, rate: int) -> tuple[bytes, int]:
    """(bytes, bits) of a spectrum by its side information."""
    w, n = MsbWriter(), 0

    def put(value: int, size: int) -> None:
        nonlocal n
        if size:
            w.write(value, size)
            n += size

    big = 2 * g["big_values"]
    a, b = regions(rate, big, g["region0"], g["region1"])
    for table, (i, j) in zip(g["table_select"], ((0, a), (a, b), (b, big)), strict=True):
        if not table:
            continue
        rows, lin = t.pairs[table], t.linbits.get(table, 0)
        top = len(rows) - 1
        for k in range(i, j, 2):
            pair = lines[k : k + 2]
            word = rows[min(abs(pair[0]), top)][min(abs(pair[1]), top)]
            put(int(word, 2), len(word))
            for v in pair:
                if lin and abs(v) >= top:
                    put(abs(v) - top, lin)
                if v:
                    put(int(v < 0), 1)
    words = t.quad(g["count1"])
    for k in range(big, g["lines"], 4):
        four = lines[k : k + 4]
        word = words[sum((v != 0) << 3 - i for i, v in enumerate(four))]
        put(int(word, 2), len(word))
        for v in four:
            if v:
                put(int(v < 0), 1)
    return w.bytes(), n


def _decoder(words: dict[str, object]) -> dict[tuple[int, int], object]:
    return {(len(w), int(w, 2)): v for w, v in words.items()}


def symbols(t: Tables, r: MsbReader, g: dict, rate: int, bits: int) -> Iterator[tuple[str, int, object, int]]:
    """(site, first line, symbol, bits) of a spectrum that takes ``bits``: pairs, signs and escapes, then quadruples.

    Quadruples go on as long as bits are left; one that would run over isn't there.
    """
    start = r.at
    big = 2 * g["big_values"]
    a, b = regions(rate, big, g["region0"], g["region1"])

    def word(codes: dict[tuple[int, int], object]) -> tuple[object, int]:
        value = size = 0
        while (size, value) not in codes:
            value, size = value << 1 | r.read(1), size + 1
            if size > 32:
                raise ValueError("no code word")
        return codes[size, value], size

    for number, (table, (i, j)) in enumerate(zip(g["table_select"], ((0, a), (a, b), (b, big)), strict=True)):
        if not table:
            continue
        rows, lin = t.pairs[table], t.linbits.get(table, 0)
        codes = _decoder({w: (x, y) for x, row in enumerate(rows) for y, w in enumerate(row)})
        for k in range(i, j, 2):
            (x, y), size = word(codes)
            yield f"pair{number}", k, (x, y), size
            for line, v in ((k, x), (k + 1, y)):
                more = r.read(lin) if lin and v == len(rows) - 1 else 0
                if lin and v == len(rows) - 1:
                    yield "escape", line, more, lin
                if v:
                    yield "sign", line, (-1 if r.read(1) else 1) * (v + more), 1
    codes = _decoder({w: v for v, w in enumerate(t.quad(g["count1"]))})
    line = big
    while r.at - start < bits and line + 4 <= LINES:
        at = r.at
        v, size = word(codes)
        if r.at + int(v).bit_count() - start > bits:
            r.at = at
            break
        yield "quad", line, v, size
        for k in range(4):
            if v >> 3 - k & 1:
                yield "sign", line + k, -1 if r.read(1) else 1, 1
        line += 4


def spectrum(t: Tables, r: MsbReader, g: dict, rate: int, bits: int) -> list[int]:
    lines = [0] * LINES
    for site, line, value, _ in symbols(t, r, g, rate, bits):
        if site == "sign":
            lines[line] = value
    return lines


def scalefactors(r: MsbReader, choice: int, shared: list[int], before: list[int] | None) -> tuple[list[int], int]:
    """(21 scalefactors of a long block, bits read): four groups of bands, each taken from the granule before where it's shared."""
    low, high = SCALEFACTOR_BITS[choice]
    out: list[int] = []
    read = 0
    for group, (i, j) in enumerate(((0, 6), (6, 11), (11, 16), (16, 21))):
        size = low if j <= 11 else high
        if before is not None and shared[group]:
            out += before[i:j]
            continue
        for _ in range(i, j):
            out.append(r.read(size) if size else 0)
            read += size
    return out, read


def write_scalefactors(w: MsbWriter, values: list[int], choice: int, shared: list[int], first: bool) -> int:
    low, high = SCALEFACTOR_BITS[choice]
    written = 0
    for group, (i, j) in enumerate(((0, 6), (6, 11), (11, 16), (16, 21))):
        size = low if j <= 11 else high
        if first or not shared[group]:
            for v in values[i:j]:
                if size:
                    w.write(v, size)
                written += size
    return written


def least_choice(values: list[int]) -> int | None:
    """The cheapest choice that holds 21 scalefactors, or None."""
    need = [max((v.bit_length() for v in part), default=0) for part in (values[:11], values[11:])]
    fits = [(11 * a + 10 * b, k) for k, (a, b) in enumerate(SCALEFACTOR_BITS) if a >= need[0] and b >= need[1]]
    return min(fits)[1] if fits else None


def lsf_lengths(choice: Column, intensity: bool) -> list[Column]:
    """Bits of the four groups of scalefactors at half sampling rates, by the granule's choice; the last channel of intensity stereo has its own rule."""
    c = choice.cast("long")

    def split(x: Column, *radices: int) -> list[Column]:
        """Mixed-radix digits, the last the fastest; missing groups have none."""
        out, rest = [], x
        for r in reversed(radices):
            out.append(rest % r)
            rest = F.floor(rest / r)
        digits = [rest, *reversed(out)]
        return [*digits, *[F.lit(0).cast("long")] * (4 - len(digits))][:4]

    if intensity:
        half = F.floor(c / 2)
        rules = ((half < 180, split(half, 6, 6)), (half < 244, split((half - 180) % 64, 4, 4)), (F.lit(True), split(half - 244, 3)))
    else:
        rules = ((c < 400, split(c, 5, 4, 4)), (c < 500, split(c - 400, 5, 4)), (F.lit(True), split(c - 500, 3)))
    out = []
    for k in range(4):
        value = F.lit(None).cast("long")
        for when, digits in reversed(rules):
            value = F.when(when, digits[k]).otherwise(value)
        out.append(value)
    return out

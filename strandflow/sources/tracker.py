"""Tracker modules: MOD layout and cells, IT and S3M entities, XM chunks, packed patterns, compressed samples.

Entities are found from the offset tables of a module and classed by who holds the bytes: PRI holds them,
ALIAS points to a holder, RAW points elsewhere, ZERO points nowhere, NONE has no header.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.bits import LsbReader, LsbWriter

ROWS = 64
MAX_PATTERNS = 1024
#: The greatest period below each bucket of semitones; bucket 96 has none.
SEMITONE_EDGES = [
    3979, 3756, 3545, 3346, 3158, 2981, 2813, 2655, 2506, 2366, 2233, 2108,
    1989, 1878, 1772, 1673, 1579, 1490, 1406, 1327, 1253, 1183, 1116, 1054,
    994, 939, 886, 836, 789, 745, 703, 663, 626, 591, 558, 527, 497, 469, 443,
    418, 394, 372, 351, 331, 313, 295, 279, 263, 248, 234, 221, 209, 197, 186,
    175, 165, 156, 147, 139, 131, 124, 117, 110, 104, 98, 93, 87, 82, 78, 73,
    69, 65, 62, 58, 55, 52, 49, 46, 43, 41, 39, 36, 34, 32, 31, 29, 27, 26, 24,
    23, 21, 20, 19, 18, 17, 16,
]
SEMITONES = len(SEMITONE_EDGES)
TOP_PERIOD = 4095

MOD_HEADER = (
    "path string, title string, nsamples int, channels int, tag string, song_len int, restart int, orders array<int>, npatterns int, tail long"
)
MOD_SAMPLES = "path string, si int, at long, len long, name string, finetune int, volume int, loop_at int, loop_len int"
MOD_CELLS = "path string, i long, pattern int, row int, chan int, period int, semitone int, sample int, effect int, param int"
ENTITIES = "path string, fmt string, kind string, idx int, state string, off long, len long, alias_of int"
EVENTS = "path string, pat int, row int, chan int, mask int, note int, ins int, vol int, cmd int, par int"
XM_CHUNKS = "path string, chunk int, kind string, idx int, at long, len long"


def semitone(period: int) -> int:
    """Bucket of a period: the first whose edge it exceeds; ``SEMITONES`` if none."""
    return bisect_right(_RISING, -period)


_RISING = [-e for e in SEMITONE_EDGES]


def semitone_expr(period: Column) -> Column:
    """``semitone`` as an expression."""
    edges = F.array(*(F.lit(e) for e in SEMITONE_EDGES))
    return F.size(F.filter(edges, lambda e: e >= period))


@dataclass
class Mod:
    title: str
    nsamples: int
    channels: int
    tag: str
    song_len: int
    restart: int
    orders: list[int]
    npatterns: int
    samples: list[tuple[int, int, str, int, int, int, int]]
    pattern_at: int
    tail: int


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1")


def tag_channels(tag: bytes) -> int | None:
    from strandflow.sources.files import MOD_TAGS

    t = tag.decode("latin-1")
    if t in MOD_TAGS:
        return MOD_TAGS[t]
    if t[1:] == "CHN" and t[0] in "123456789":
        return int(t[0])
    if t[2:] in ("CH", "CN") and t[:2].isdigit() and t[0] != "0":
        return int(t[:2])
    if t[:3] == "TDZ" and t[3] in "123456789":
        return int(t[3])
    return None


def _records(data: bytes, n: int) -> list[tuple[str, int, int, int, int, int]]:
    out = []
    for k in range(n):
        r = data[20 + 30 * k : 50 + 30 * k]
        u16 = lambda i, r=r: int.from_bytes(r[i : i + 2], "big")
        out.append((_text(r[:22]), 2 * u16(22), r[24], r[25], 2 * u16(26), 2 * u16(28)))
    return out


def mod_kind(data: bytes, size: int | None = None) -> int:
    """31 or 15 samples, 0 if it's no module. ``data``: the file's first bytes, ``size``: that of all."""
    size = len(data) if size is None else size
    if len(data) >= 1084 and tag_channels(data[1080:1084]):
        return 31
    if len(data) < 600:
        return 0
    orders, records = data[472:600], _records(data, 15)
    fine = all(r[2] <= 15 and r[3] <= 64 for r in records) and any(r[1] for r in records)
    plausible = 1 <= data[470] <= 128 and max(orders) <= 63 and fine
    return 15 if plausible and size >= 600 + 1024 * (max(orders) + 1) else 0


def mod_layout(data: bytes) -> Mod | None:
    ns = mod_kind(data)
    if not ns:
        return None
    head = 1084 if ns == 31 else 600
    at = 20 + 30 * ns
    tag = data[1080:1084] if ns == 31 else b""
    channels = tag_channels(tag) if ns == 31 else 4
    orders = list(data[at + 2 : at + 130])
    records = _records(data, ns)
    cells, total = channels * 4 * ROWS, sum(r[1] for r in records)
    room = len(data) - head - total
    patterns = room // cells if room >= 0 and room % cells == 0 and room // cells <= MAX_PATTERNS else max(orders) + 1
    place, samples = head + patterns * cells, []
    for name, size, fine, volume, loop, loop_len in records:
        have = max(0, min(size, len(data) - place))
        samples.append((place, have, name, fine & 15, volume, loop, loop_len))
        place += have
    return Mod(_text(data[:20]), ns, channels, tag.decode("latin-1"), data[at], data[at + 1], orders, patterns, samples, head, len(data) - min(place, len(data)))


def mod_cells(data: bytes, m: Mod) -> Iterator[tuple]:
    raw = data[m.pattern_at : m.pattern_at + m.npatterns * m.channels * 4 * ROWS]
    for i in range(len(raw) // 4):
        b0, b1, b2, b3 = raw[4 * i : 4 * i + 4]
        period = (b0 & 15) << 8 | b1
        row, chan = divmod(i, m.channels)
        pattern, row = divmod(row, ROWS)
        yield i, pattern, row, chan, period, 0 if period == 0 else 1 + semitone(period), b0 & 0xF0 | b2 >> 4, b2 & 15, b3


@dataclass
class Entity:
    kind: str
    idx: int
    off: int
    len: int
    state: str = "RAW"
    alias_of: int | None = None
    flags: dict = field(default_factory=dict)


def _u(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def resolve(entities: list[Entity], size: int) -> list[Entity]:
    """Sets states: of the candidates by offset, then greater length, then order, those that overlap no earlier one hold their bytes."""
    held: dict[int, Entity] = {}
    end = 0
    for e in sorted((e for e in entities if e.state != "NONE" and e.off and e.len > 0 and e.off + e.len <= size), key=lambda e: (e.off, -e.len, entities.index(e))):
        if e.off >= end:
            held[e.off] = e
            e.state = "PRI"
            end = e.off + e.len
    for e in entities:
        if e.state in ("PRI", "NONE"):
            continue
        if not e.off:
            e.state = "ZERO"
        elif e.off in held:
            e.state, e.alias_of = "ALIAS", held[e.off].idx
        else:
            e.state = "RAW"
    return entities


def it_entities(data: bytes) -> list[Entity]:
    orders, ins, smp, pat = (_u(data, at, 2) for at in (0x20, 0x22, 0x24, 0x26))
    table = 192 + orders
    out = [Entity("message", 0, _u(data, 0x38, 4), _u(data, 0x36, 2))] if _u(data, 0x2E, 2) & 1 else []
    for kind, count, skip, size in (("instrument", ins, 0, 554), ("sample", smp, ins, 80)):
        out += [Entity(kind, i, _u(data, table + 4 * (skip + i), 4), size) for i in range(count)]
    for i in range(pat):
        off = _u(data, table + 4 * (ins + smp + i), 4)
        out.append(Entity("pattern", i, off, 8 + _u(data, off, 2) if off and off + 8 <= len(data) else 0))
    resolve(out, len(data))
    for e in [e for e in out if e.kind == "sample"]:
        pcm = Entity("pcm", e.idx, 0, 0)
        if e.state == "PRI":
            h = data[e.off : e.off + 80]
            flags, n = h[18], _u(h, 48, 4)
            pcm.off, pcm.flags = _u(h, 72, 4), {"flags": flags, "convert": h[46], "length": n}
            pcm.len = (n << (flags >> 1 & 1) << (flags >> 2 & 1)) if flags & 1 and not flags & 8 else compressed_size(data, pcm.off, n, flags) if flags & 1 else 0
        else:
            pcm.state = "NONE"
        out.append(pcm)
    return resolve(out, len(data))


def s3m_entities(data: bytes) -> list[Entity]:
    orders, ins, pat = (_u(data, at, 2) for at in (0x20, 0x22, 0x24))
    table = 96 + orders
    out = [Entity("instrument", i, 16 * _u(data, table + 2 * i, 2), 80) for i in range(ins)]
    for i in range(pat):
        off = 16 * _u(data, table + 2 * (ins + i), 2)
        out.append(Entity("pattern", i, off, _u(data, off, 2) if off and off + 2 <= len(data) else 0))
    resolve(out, len(data))
    for e in [e for e in out if e.kind == "instrument"]:
        pcm = Entity("pcm", e.idx, 0, 0)
        if e.state == "PRI" and data[e.off] == 1:
            h = data[e.off : e.off + 80]
            pcm.off, flags = 16 * (h[13] << 16 | _u(h, 14, 2)), h[31]
            pcm.len = _u(h, 16, 4) << (flags >> 1 & 1) << (flags >> 2 & 1)
        else:
            pcm.state = "NONE"
        out.append(pcm)
    return resolve(out, len(data))


def compressed_size(data: bytes, at: int, length: int, flags: int) -> int:
    """Bytes of the blocks of a compressed sample: each has its size before it and up to 32 KiB of samples."""
    start, per_block = at, 0x4000 if flags & 2 else 0x8000
    for _ in range(2 if flags & 4 else 1):
        left = length
        while left > 0:
            if at + 2 > len(data):
                return 0
            at += 2 + _u(data, at, 2)
            left -= per_block
    return at - start


def xm_chunks(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(kind, idx, at, len) from header to tail, as far as the file goes."""
    size = len(data)
    if size < 80 or data[:17] != b"Extended Module: ":
        return
    at = min(size, 60 + _u(data, 60, 4))
    yield "header", 0, 0, at
    for i in range(_u(data, 70, 2)):
        if at + 9 > size:
            break
        end = min(size, at + _u(data, at, 4) + _u(data, at + 7, 2))
        yield "pattern", i, at, end - at
        at = end
    for i in range(_u(data, 72, 2)):
        if at + 29 > size:
            break
        n, head = _u(data, at + 27, 2), min(size, at + _u(data, at, 4))
        yield "instrument", i, at, head - at
        per, at, lengths = _u(data, at + 29, 4) if n else 0, head, []
        for k in range(n):
            if at + per > size or per < 18:
                break
            lengths.append(_u(data, at, 4))
            yield "sample_header", 256 * i + k, at, per
            at += per
        for k, length in enumerate(lengths):
            end = min(size, at + length)
            yield "sample", 256 * i + k, at, end - at
            at = end
    if at < size:
        yield "tail", 0, at, size - at


def unpack_it(data: bytes, rows: int) -> Iterator[tuple]:
    """(row, chan, mask, note, ins, vol, cmd, par) of a packed IT pattern; channels remember masks and values."""
    at, row = 0, 0
    masks, last = [0] * 64, [[None] * 5 for _ in range(64)]
    while row < rows and at < len(data):
        b = data[at]
        at += 1
        if not b:
            row += 1
            continue
        chan = (b - 1) & 63
        if b & 128:
            masks[chan] = data[at]
            at += 1
        mask, got = masks[chan], [None] * 5
        for bit, fields in ((0, (0,)), (1, (1,)), (2, (2,)), (3, (3, 4))):
            if mask >> bit & 1:
                for f in fields:
                    last[chan][f] = data[at]
                    at += 1
            if (mask >> bit | mask >> (bit + 4)) & 1:
                for f in fields:
                    got[f] = last[chan][f]
        yield row, chan, mask, *got


def pack_it(events: list[tuple], rows: int) -> bytes:
    """Each event with its mask, values given in full."""
    out = bytearray()
    by_row: dict[int, list[tuple]] = {}
    for e in events:
        by_row.setdefault(e[0], []).append(e)
    for row in range(rows):
        for _, chan, _, *values in by_row.get(row, []):
            mask = sum(1 << min(f, 3) for f in range(4) if values[f] is not None)
            out += bytes([chan + 1 | 128, mask, *(v for v in values if v is not None)])
        out.append(0)
    return bytes(out)


def unpack_s3m(data: bytes) -> Iterator[tuple]:
    at, row = 2, 0
    while row < ROWS and at < len(data):
        b = data[at]
        at += 1
        if not b:
            row += 1
            continue
        got = [None] * 5
        if b & 32:
            got[0], got[1] = data[at : at + 2]
            at += 2
        if b & 64:
            got[2] = data[at]
            at += 1
        if b & 128:
            got[3], got[4] = data[at : at + 2]
            at += 2
        yield row, b & 31, b & 224, *got


def unpack_xm(data: bytes, rows: int, channels: int) -> Iterator[tuple]:
    at = 0
    for i in range(rows * channels):
        if at >= len(data):
            return
        mask = data[at]
        if mask & 128:
            at += 1
        else:
            mask = 31
        got = []
        for f in range(5):
            if mask >> f & 1:
                got.append(data[at] if at < len(data) else None)
                at += 1
            else:
                got.append(None)
        row, chan = divmod(i, channels)
        if any(x is not None for x in got):
            yield row, chan, mask & 31, *got


def pack_s3m(events: list[tuple]) -> bytes:
    """A packed S3M pattern of events as ``unpack_s3m`` gives them, its size before it."""
    out = bytearray()
    by_row: dict[int, list[tuple]] = {}
    for e in events:
        by_row.setdefault(e[0], []).append(e)
    for row in range(ROWS):
        for _, chan, mask, *v in by_row.get(row, []):
            out.append(chan | mask)
            for bit, fields in ((32, v[:2]), (64, v[2:3]), (128, v[3:])):
                if mask & bit:
                    out += bytes(fields)
        out.append(0)
    return (len(out) + 2).to_bytes(2, "little") + bytes(out)


def pack_xm(events: list[tuple], rows: int, channels: int) -> bytes:
    """A packed XM pattern of events as ``unpack_xm`` gives them: full cells plain, others behind their mask."""
    cells = {(row, chan): (mask, v) for row, chan, mask, *v in events}
    out = bytearray()
    for row in range(rows):
        for chan in range(channels):
            mask, v = cells.get((row, chan), (0, []))
            if mask != 31:
                out.append(128 | mask)
            out += bytes(x for k, x in enumerate(v) if mask >> k & 1)
    return bytes(out)


#: Fields of a MOD header: name and bytes, those of a sample's record and those behind the records (fixed values).
RECORD = (("sample_name", 22), ("length", 2), ("finetune", 1), ("volume", 1), ("loop", 2), ("loop_length", 2))
SONG = (("song_length", 1), ("restart", 1), ("orders", 128), ("tag", 4))


def header_field(offset: int, nsamples: int) -> tuple[str, int, int] | None:
    """(field, sample or -1, byte of the field) at a header offset; None behind the header. Old modules have no tag."""
    if offset < 20:
        return "title", -1, offset
    record, at = divmod(offset - 20, 30)
    if record < nsamples:
        for name, size in RECORD:
            if at < size:
                return name, record, at
            at -= size
    at = offset - 20 - 30 * nsamples
    for name, size in SONG if nsamples == 31 else SONG[:3]:
        if at < size:
            return name, -1, at
        at -= size
    return None


def move_it(data: bytes, order: list[int]) -> bytes:
    """An IT module with its entities laid end to end behind its tables in another order, and all pointers to them patched.

    ``order``: a permutation of the entities that hold bytes of their own (``PRI``), by offset. Bytes between
    entities aren't kept.
    """
    held = sorted((e for e in it_entities(data) if e.state == "PRI"), key=lambda e: (e.off, -e.len))
    orders, ins, smp, pat = (_u(data, at, 2) for at in (0x20, 0x22, 0x24, 0x26))
    table = 192 + orders
    out, moved = bytearray(data[: table + 4 * (ins + smp + pat)]), {}
    for k in order:
        e = held[k]
        moved[e.off] = len(out)
        out += data[e.off : e.off + e.len]
    if _u(data, 0x2E, 2) & 1 and _u(data, 0x38, 4) in moved:
        out[0x38:0x3C] = moved[_u(data, 0x38, 4)].to_bytes(4, "little")
    for i in range(ins + smp + pat):
        at = table + 4 * i
        old = _u(data, at, 4)
        out[at : at + 4] = moved.get(old, old).to_bytes(4, "little")
    for e in held:
        if e.kind == "sample":
            at = moved[e.off] + 72
            old = _u(data, e.off + 72, 4)
            out[at : at + 4] = moved.get(old, old).to_bytes(4, "little")
    return bytes(out)


def decompress(data: bytes, at: int, length: int, wide: bool, twice: bool = False) -> list[int]:
    """Samples of IT 2.14 compression, or with ``twice`` of 2.15, whose values are summed twice."""
    bits, low, block = (16, 4, 0x4000) if wide else (8, 3, 0x8000)
    out: list[int] = []
    half = 1 << (bits - 1)

    def wrap(x: int) -> int:
        return (x + half) % (2 * half) - half

    while len(out) < length:
        size = _u(data, at, 2)
        r = LsbReader(data[at + 2 : at + 2 + size])
        at += 2 + size
        width, one, two = bits + 1, 0, 0
        for _ in range(min(block, length - len(out))):
            while True:
                v = r.read(width)
                if width < 7 and v == 1 << (width - 1):
                    new = r.read(low) + 1
                    width = new if new < width else new + 1
                elif 7 <= width <= bits and 0 < v - ((((1 << bits) - 1) >> (bits + 1 - width)) - bits // 2) <= bits:
                    new = v - ((((1 << bits) - 1) >> (bits + 1 - width)) - bits // 2)
                    width = new if new < width else new + 1
                elif width == bits + 1 and v >> bits:
                    width = (v & 0xFF) + 1
                else:
                    break
            if width <= bits:
                v = v - (1 << width) if v >> (width - 1) else v
            one = wrap(one + v)
            two = wrap(two + one)
            out.append(two if twice else one)
    return out


def compress(samples: list[int], wide: bool, twice: bool = False) -> bytes:
    """A plain encoder: all values at the full width."""
    bits, block = (16, 0x4000) if wide else (8, 0x8000)
    out = b""
    for start in range(0, len(samples), block):
        w, one, two = LsbWriter(), 0, 0
        for x in samples[start : start + block]:
            d = x - (two if twice else one)
            if twice:
                step = d - one
                one, two = d, x
            else:
                step, one = d, x
            w.write(step % (1 << bits), bits + 1)
        raw = w.bytes()
        out += len(raw).to_bytes(2, "little") + raw
    return out


def decode_pcm(raw: bytes, wide: bool, signed: bool = True, big: bool = False, delta: bool = False) -> list[int]:
    """Sample values of raw bytes."""
    size = 2 if wide else 1
    half = 1 << (8 * size - 1)
    out, total = [], 0
    for i in range(0, len(raw) - size + 1, size):
        v = int.from_bytes(raw[i : i + size], "big" if big else "little")
        if delta:
            total = (total + v) % (2 * half)
            v = total
        elif not signed:
            v = (v - half) % (2 * half)
        out.append(v - 2 * half if v >= half else v)
    return out


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame([(path, *r) for r in rows(bytes(content or b""))], columns=names)
                yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def _mod(rows):
    def one(data: bytes) -> Iterator[tuple]:
        m = mod_layout(data)
        return iter(()) if m is None else rows(data, m)

    return one


def headers(files: DataFrame) -> DataFrame:
    row = lambda _, m: [(m.title, m.nsamples, m.channels, m.tag, m.song_len, m.restart, m.orders, m.npatterns, m.tail)]
    return _table(files, MOD_HEADER, _mod(row))


def samples(files: DataFrame) -> DataFrame:
    return _table(files, MOD_SAMPLES, _mod(lambda _, m: ((i, *s) for i, s in enumerate(m.samples))))


def cells(files: DataFrame) -> DataFrame:
    return _table(files, MOD_CELLS, _mod(mod_cells))


def entities(files: DataFrame) -> DataFrame:
    """Entities (``ENTITIES``) of IT and S3M modules."""

    def rows(data: bytes) -> Iterator[tuple]:
        if data[:4] == b"IMPM":
            fmt, found = "it", it_entities(data)
        elif data[0x2C:0x30] == b"SCRM":
            fmt, found = "s3m", s3m_entities(data)
        else:
            return
        for e in found:
            yield fmt, e.kind, e.idx, e.state, e.off, e.len, e.alias_of

    return _table(files, ENTITIES, rows)


def chunks(files: DataFrame) -> DataFrame:
    """Chunks (``XM_CHUNKS``) that cover XM modules."""
    return _table(files, XM_CHUNKS, lambda data: ((i, *c) for i, c in enumerate(xm_chunks(data))))


def pattern_events(files: DataFrame) -> DataFrame:
    """Unpacked pattern entries (``EVENTS``) of IT, S3M and XM modules."""

    def rows(data: bytes) -> Iterator[tuple]:
        if data[:4] == b"IMPM" or data[0x2C:0x30] == b"SCRM":
            it = data[:4] == b"IMPM"
            for e in it_entities(data) if it else s3m_entities(data):
                if e.kind == "pattern" and e.state == "PRI":
                    raw = data[e.off : e.off + e.len]
                    for event in unpack_it(raw[8:], _u(raw, 2, 2)) if it else unpack_s3m(raw):
                        yield e.idx, *event
        elif data[:17] == b"Extended Module: ":
            for kind, idx, at, n in xm_chunks(data):
                if kind == "pattern":
                    head = _u(data, at, 4)
                    for event in unpack_xm(data[at + head : at + n], _u(data, at + 5, 2), _u(data, 68, 2)):
                        yield idx, *event

    return _table(files, EVENTS, rows)

"""MPEG audio layer III: frame headers, side information, runs of frames and their layout.

A file is covered by segments: runs of frames that agree on version, rate and channels, raw bytes between
them, and raw bytes too random to be worth a model. Frames and granules become tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from strandflow.functions.bits import MsbReader
from strandflow.functions.checksums import crc16

#: kbit/s by index for layer III. Fixed values of the standard.
BITRATES_1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
BITRATES_2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
MIN_RUN = 6
#: A raw segment of this many bytes or more and as many bits a byte is stored as it is.
STORED_BYTES = 4096
STORED_BITS = 2022 / 2048 * 8

FRAMES = (
    "path string, frame long, at long, mpeg string, bitrate int, rate int, pad boolean, mode int, mode_ext int, crc boolean, crc_ok boolean, "
    "frame_bytes int, side_bytes int, main_data_begin int, payload_bits int, payload_at long, fits boolean"
)
GRANULES = (
    "path string, frame long, gr int, ch int, part2_3 int, big_values int, global_gain int, scalefac int, block_type int, mixed boolean, "
    "table_select array<int>, subblock_gain array<int>, region0 int, region1 int, preflag int, scale int, count1 int"
)
SEGMENTS = "path string, seg int, at long, len long, kind string, nframes int"


@dataclass(frozen=True)
class Header:
    version: int
    crc: bool
    bitrate_index: int
    rate_index: int
    pad: bool
    mode: int
    mode_ext: int
    emphasis: int

    @property
    def lsf(self) -> bool:
        return self.version != 3

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def rate(self) -> int:
        return RATES[self.version][self.rate_index]

    @property
    def bitrate(self) -> int:
        return (BITRATES_2 if self.lsf else BITRATES_1)[self.bitrate_index]

    @property
    def side_bytes(self) -> int:
        if self.lsf:
            return 9 if self.channels == 1 else 17
        return 17 if self.channels == 1 else 32

    @property
    def head_bytes(self) -> int:
        return 4 + 2 * self.crc + self.side_bytes

    @property
    def granules(self) -> int:
        return 1 if self.lsf else 2

    def frame_bytes(self, free: int = 0) -> int:
        if self.bitrate_index == 0:
            return free + self.pad if free else 0
        return (72 if self.lsf else 144) * self.bitrate * 1000 // self.rate + self.pad

    def same_stream(self, other: Header) -> bool:
        return (self.version, self.rate_index, self.channels) == (other.version, other.rate_index, other.channels)


def parse_header(data: bytes, at: int) -> Header | None:
    """The header at ``at``, None where no layer III frame can start."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer, rate = b1 >> 3 & 3, b1 >> 1 & 3, b2 >> 2 & 3
    if version == 1 or layer != 1 or b2 >> 4 == 15 or rate == 3 or b3 & 3 == 2:
        return None
    h = Header(version, not b1 & 1, b2 >> 4, rate, bool(b2 & 2), b3 >> 6, b3 >> 4 & 3, b3 & 3)
    if h.bitrate_index and h.frame_bytes() < h.head_bytes:
        return None
    return h


def free_size(data: bytes, at: int, h: Header, limit: int = 4096) -> int:
    """Unpadded size of a free-format frame: the distance to the next header of the same stream and no bitrate."""
    for step in range(h.head_bytes, limit):
        other = parse_header(data, at + step)
        if other and other.bitrate_index == 0 and other.same_stream(h):
            return step - h.pad
    return 0


@dataclass
class SideInfo:
    main_data_begin: int
    private: int
    scfsi: list[list[int]]
    granules: list[list[dict]]

    @property
    def bits(self) -> int:
        return sum(g["part2_3"] for gr in self.granules for g in gr)


def parse_side(data: bytes, h: Header) -> SideInfo:
    r = MsbReader(data)
    begin = r.read(8 if h.lsf else 9)
    private = r.read((1 if h.channels == 1 else 2) if h.lsf else (5 if h.channels == 1 else 3))
    scfsi = [] if h.lsf else [[r.read(1) for _ in range(4)] for _ in range(h.channels)]
    granules = []
    for _ in range(h.granules):
        row = []
        for _ in range(h.channels):
            g = {"part2_3": r.read(12), "big_values": r.read(9), "global_gain": r.read(8), "scalefac": r.read(9 if h.lsf else 4)}
            switched = r.read(1)
            if switched:
                g["block_type"], g["mixed"] = r.read(2), bool(r.read(1))
                g["table_select"] = [r.read(5) for _ in range(2)]
                g["subblock_gain"] = [r.read(3) for _ in range(3)]
                g["region0"] = g["region1"] = None
            else:
                g["block_type"], g["mixed"] = 0, False
                g["table_select"] = [r.read(5) for _ in range(3)]
                g["subblock_gain"] = []
                g["region0"], g["region1"] = r.read(4), r.read(3)
            g["preflag"] = None if h.lsf else r.read(1)
            g["scale"], g["count1"] = r.read(1), r.read(1)
            row.append(g)
        granules.append(row)
    return SideInfo(begin, private, scfsi, granules)


@dataclass
class Run:
    at: int
    end: int
    frames: list[tuple[int, Header, int]]  # place, header, bytes
    free: int


def run_at(data: bytes, at: int) -> Run | None:
    """The frames of one stream in a row from ``at``."""
    first = parse_header(data, at)
    if first is None:
        return None
    free = free_size(data, at, first) if first.bitrate_index == 0 else 0
    frames, place = [], at
    while (h := parse_header(data, place)) and h.same_stream(first):
        size = h.frame_bytes(free)
        if size < h.head_bytes or place + size > len(data):
            break
        frames.append((place, h, size))
        place += size
    return Run(at, place, frames, free) if frames else None


def tags_only(rest: bytes) -> bool:
    """Nothing but trailing tags: ID3v1, Lyrics3, APE."""
    while rest:
        if len(rest) >= 128 and rest[-128:-125] == b"TAG":
            rest = rest[:-128]
        elif rest[-9:] == b"LYRICS200" and rest[-15:-9].isdigit() and int(rest[-15:-9]) + 15 <= len(rest):
            rest = rest[: -int(rest[-15:-9]) - 15]
        elif rest[-32:-24] == b"APETAGEX":
            size = int.from_bytes(rest[-20:-16], "little") + (32 if rest[-9] & 0x80 else 0)
            if not 32 <= size <= len(rest):
                return False
            rest = rest[:-size]
        else:
            return False
    return True


def accepted(data: bytes, run: Run) -> bool:
    """Long enough, or all of the file but tags; and some frame's payload lies within the run."""
    enough = len(run.frames) >= MIN_RUN or (run.at == 0 and len(run.frames) >= 2 and tags_only(data[run.end :]))
    return enough and any(fits for *_, fits in placements(data, run))


def placements(data: bytes, run: Run) -> Iterator[tuple[int, Header, int, SideInfo, int, bool]]:
    """(place, header, bytes, side information, payload's first byte in the run's payload stream, whether it fits).

    Payloads lie in the stream of all frames' rooms, each from ``main_data_begin`` bytes before its own room.
    """
    position = end = 0
    for at, h, size in run.frames:
        side = parse_side(data[at + h.head_bytes - h.side_bytes : at + h.head_bytes], h)
        room = size - h.head_bytes
        start, need = position - side.main_data_begin, (side.bits + 7) // 8
        fits = start >= end and start + need <= position + room
        yield at, h, size, side, start, fits
        if fits:
            end = start + need
        position += room


def entropy_bits(data: bytes) -> float:
    n = len(data)
    return sum(c * (math.log2(n) - math.log2(c)) for c in Counter(data).values()) / n if n else 0.0


def scan(data: bytes) -> tuple[list[tuple[int, int, str, int]], list[Run]]:
    """(segments, runs): segments (at, len, kind, frames) cover the file."""
    segments, runs = [], []
    at = raw = 0

    def close(end: int) -> None:
        if end > raw:
            part = data[raw:end]
            stored = len(part) >= STORED_BYTES and entropy_bits(part) >= STORED_BITS
            segments.append((raw, end - raw, "STORED" if stored else "RAW", 0))

    while (at := data.find(b"\xff", at)) >= 0:
        run = run_at(data, at)
        if run and accepted(data, run):
            close(run.at)
            segments.append((run.at, run.end - run.at, "RUN", len(run.frames)))
            runs.append(run)
            at = raw = run.end
        else:
            at += 1
    close(len(data))
    return segments, runs


def sniff(data: bytes, window: int = 65536) -> bool:
    return data[:3] == b"ID3" or any(kind == "RUN" for _, _, kind, _ in scan(data[:window])[0])


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(list(rows(path, bytes(content or b""))), columns=names)
                yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def segments(files: DataFrame) -> DataFrame:
    """Segments (``SEGMENTS``) that cover each file."""
    return _table(files, SEGMENTS, lambda path, data: ((path, i, *s) for i, s in enumerate(scan(data)[0])))


def _frames(path: str, data: bytes) -> Iterator[tuple]:
    number = 0
    for run in scan(data)[1]:
        for at, h, size, side, start, fits in placements(data, run):
            ok = None
            if h.crc:
                ok = crc16(data[at + 2 : at + 4] + data[at + 6 : at + h.head_bytes]) == int.from_bytes(data[at + 4 : at + 6], "big")
            yield (
                path, number, at, VERSIONS[h.version], h.bitrate, h.rate, h.pad, h.mode, h.mode_ext, h.crc, ok,
                size, h.side_bytes, side.main_data_begin, side.bits, start, fits,
            )
            number += 1


def frames(files: DataFrame) -> DataFrame:
    """A row for each frame (``FRAMES``), numbered over a file's runs."""
    return _table(files, FRAMES, _frames)


def _granules(path: str, data: bytes) -> Iterator[tuple]:
    number = 0
    keys = [c.split()[0] for c in GRANULES.split(", ")][4:]
    for run in scan(data)[1]:
        for *_, side, _, _ in placements(data, run):
            for gr, row in enumerate(side.granules):
                for ch, g in enumerate(row):
                    yield (path, number, gr, ch, *(g[k] for k in keys))
            number += 1


def granules(files: DataFrame) -> DataFrame:
    """A row for each granule and channel (``GRANULES``): what the side information says of it."""
    return _table(files, GRANULES, _granules)


def transpose(data: bytes, run: Run) -> tuple[bytes, bytes]:
    """(headers with side information, payload stream) of a run; ``restore`` is the inverse."""
    heads, payload = [], []
    for at, h, size in run.frames:
        heads.append(data[at : at + h.head_bytes])
        payload.append(data[at + h.head_bytes : at + size])
    return b"".join(heads), b"".join(payload)


def restore(heads: bytes, payload: bytes, free: int = 0) -> bytes:
    out, at, place = [], 0, 0
    while at < len(heads):
        h = parse_header(heads, at)
        room = h.frame_bytes(free) - h.head_bytes
        out.append(heads[at : at + h.head_bytes] + payload[place : place + room])
        at += h.head_bytes
        place += room
    return b"".join(out)

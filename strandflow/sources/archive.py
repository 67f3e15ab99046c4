"""A chunked, checksummed archive as a Spark data source.

A file holds one record's streams: a header with the original's length and CRC-32C, then chunks of up to
a mebibyte, each with its stream's number and length, and four zero bytes. Streams are deflated if that
makes them smaller, else stored. Reading refuses files that are cut, damaged or followed by other bytes.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandflow.functions.checksums import crc32c

MAGIC = b"SFAR"
VERSION = 1
CHUNK = 1 << 20
STORED, DEFLATED = 0, 1
SCHEMA = "name string, stream int, data binary"
SUFFIX = ".sfa"


class ArchiveError(ValueError):
    """The archive can't be read; the message tells why."""


def encode(name: str, streams: list[bytes], effort: int = 6, chunk: int = CHUNK) -> bytes:
    """An archive of streams, in order and whole; chunks of the streams alternate."""
    plain = b"".join(streams)
    packed = [zlib.compress(s, effort) for s in streams]
    kinds = [DEFLATED if len(p) < len(s) else STORED for s, p in zip(streams, packed, strict=True)]
    held = [p if k else s for s, p, k in zip(streams, packed, kinds, strict=True)]
    title = name.encode()
    out = [MAGIC, bytes([VERSION]), len(title).to_bytes(2, "little"), title, len(plain).to_bytes(8, "little"), crc32c(plain).to_bytes(4, "little")]
    out += [len(streams).to_bytes(2, "little"), bytes(kinds), b"".join(len(h).to_bytes(8, "little") for h in held)]
    for at in range(0, max(map(len, held), default=0), chunk):
        for i, h in enumerate(held, 1):
            part = h[at : at + chunk]
            if part:
                out += [i.to_bytes(4, "little"), len(part).to_bytes(4, "little"), part]
    return b"".join([*out, b"\0\0\0\0"])


def decode(data: bytes) -> tuple[str, list[bytes]]:
    """(name, streams); ArchiveError if anything is wrong."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ArchiveError("the archive is cut")
        at += n
        return data[at - n : at]

    if take(4) != MAGIC:
        raise ArchiveError("not an archive")
    if take(1)[0] != VERSION:
        raise ArchiveError("another version")
    name = take(int.from_bytes(take(2), "little")).decode("utf-8", "replace")
    size, crc = int.from_bytes(take(8), "little"), int.from_bytes(take(4), "little")
    kinds = list(take(int.from_bytes(take(2), "little")))
    lengths = [int.from_bytes(take(8), "little") for _ in kinds]
    held = [bytearray() for _ in kinds]
    while stream := int.from_bytes(take(4), "little"):
        n = int.from_bytes(take(4), "little")
        if stream > len(held) or not 0 < n <= CHUNK:
            raise ArchiveError("a chunk is damaged")
        held[stream - 1] += take(n)
    if at != len(data):
        raise ArchiveError("bytes after the end")
    if [len(h) for h in held] != lengths:
        raise ArchiveError("a stream's length is wrong")
    try:
        streams = [zlib.decompress(bytes(h)) if k == DEFLATED else bytes(h) for h, k in zip(held, kinds, strict=True)]
    except zlib.error as e:
        raise ArchiveError("a stream is damaged") from e
    plain = b"".join(streams)
    if len(plain) != size or crc32c(plain) != crc:
        raise ArchiveError("the checksum is wrong")
    return name, streams


class _Partition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith(SUFFIX))
        return [_Partition(os.path.join(self.path, n)) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            name, streams = decode(f.read())
        for i, s in enumerate(streams, 1):
            yield name, i, s


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class _Writer(DataSourceWriter):
    """Files are written under temporary names and renamed on commit; a failed job leaves nothing."""

    def __init__(self, path: str, effort: int) -> None:
        self.path, self.effort = path, effort

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        groups: dict[str, list[tuple[int, bytes]]] = {}
        for row in rows:
            groups.setdefault(row.name, []).append((row.stream, bytes(row.data)))
        files = []
        for name, streams in groups.items():
            final = os.path.join(self.path, uuid.uuid4().hex + SUFFIX)
            with open(final + ".tmp", "wb") as f:
                f.write(encode(name, [s for _, s in sorted(streams)], self.effort))
                f.flush()
                os.fsync(f.fileno())
            files.append((final + ".tmp", final))
        return _Message(files)

    def commit(self, messages: list) -> None:
        for m in filter(None, messages):
            for tmp, final in m.files:
                os.rename(tmp, final)

    def abort(self, messages: list) -> None:
        for m in filter(None, messages):
            for tmp, _ in m.files:
                if os.path.exists(tmp):
                    os.remove(tmp)


class ArchiveSource(DataSource):
    """``spark.read.format("sfarchive").load(dir)``; rows of a name must be in one partition to be written.

    The folder must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "sfarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("effort", 6)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)

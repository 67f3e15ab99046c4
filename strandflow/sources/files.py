"""Binary files as a table, and format sniffing as one expression over their first bytes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.functions.scalars import uint_le

SCHEMA = "path string, length long, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, content. Filters on length are pushed down; content is only read where it is used."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``files`` (path, content) as ``folder/path.bin`` through the file system of the folder, each by the task that holds it.

    A file gets its name only when it's whole. The folder must be one that all executors see.
    """
    root = folder.removeprefix("file://")
    if "://" in root:
        raise ValueError(f"files are written to a mounted folder, not to {folder}")

    def put(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        for pdf in rows:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                part = os.path.join(root, f".{path}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(root, f"{path}.bin"))
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def peek(content: Column, n: int = 512) -> Column:
    return F.substring(content, 1, n)


def _at(content: Column, at: int, text: str) -> Column:
    return F.substring(content, at + 1, len(text)) == F.lit(text.encode("latin-1"))


def _ogg(content: Column) -> Column:
    start = 27 + F.coalesce(uint_le(content, 26, 1), F.lit(0))
    payload = F.substring(content, (start + 1).cast("int"), F.lit(8))
    vorbis = F.substring(payload, 1, 7) == F.lit(b"\x01vorbis")
    return F.when(vorbis, "vorbis").when(payload == F.lit(b"OpusHead"), "opus")


def _it(content: Column, size: Column) -> Column:
    orders, ins, smp, pat = (uint_le(content, at, 2) for at in (0x20, 0x22, 0x24, 0x26))
    return _at(content, 0, "IMPM") & (192 + orders + 4 * (ins + smp + pat) <= size)


def _s3m(content: Column, size: Column) -> Column:
    orders, ins, pat = (uint_le(content, at, 2) for at in (0x20, 0x22, 0x24))
    pans = F.when(uint_le(content, 0x35, 1) == 0xFC, 32).otherwise(0)
    return _at(content, 0x2C, "SCRM") & (96 + orders + 2 * (ins + pat) + pans <= size)


#: Module tags of a fixed number of channels (fixed values); numbered families stand beside them.
MOD_TAGS = {
    "M.K.": 4, "M!K!": 4, "M&K!": 4, "FLT4": 4, "N.T.": 4, "FEST": 4, "LARD": 4, "NSMS": 4, "FLT8": 8, "CD81": 8, "OKTA": 8, "OCTA": 8,
}


def mod_channels(tag: Column) -> Column:
    """Channels by tag: fixed ones, and ``6CHN``, ``32CH``, ``32CN`` and ``TDZ3`` kinds; null if it's none."""
    out = F.lit(None).cast("int")
    for name, channels in MOD_TAGS.items():
        out = F.when(tag == name, channels).otherwise(out)
    one, two = F.regexp_extract(tag, "^([1-9])CHN$", 1), F.regexp_extract(tag, "^([1-9][0-9])C[HN]$", 1)
    tdz = F.regexp_extract(tag, "^TDZ([1-9])$", 1)
    return F.coalesce(out, *(F.when(x != "", x.cast("int")) for x in (one, two, tdz)))


def mod_tag(content: Column) -> Column:
    return F.decode(F.substring(content, 1081, 4), "ISO-8859-1")


def sniff(content: Column, size: Column) -> Column:
    """Format by magic numbers: Ogg with its codec, IT, S3M, XM, tagged MOD, MP3 by its tag; else null."""
    ogg = (size >= 28) & _at(content, 0, "OggS")
    return (
        F.when(ogg, _ogg(content))
        .when(_it(content, size), "it")
        .when(_s3m(content, size), "s3m")
        .when(_at(content, 0, "Extended Module: "), "xm")
        .when((size >= 1084) & mod_channels(mod_tag(content)).isNotNull(), "mod")
        .when(_at(content, 0, "ID3"), "mp3")
    )


#: First bytes that decide where there's no magic number, and those that a run of frames may begin in.
PEEK = 1 << 20


@F.pandas_udf(T.StringType())
def _sniff_grammar(contents: pd.Series, sizes: pd.Series) -> pd.Series:
    from strandflow.sources import mp3, tracker

    def one(content: bytes | None, size: int) -> str | None:
        if content is None:
            return None
        data = bytes(content)
        return "mod" if tracker.mod_kind(data, size) else "mp3" if mp3.sniff(data) else None

    return pd.Series([one(c, n) for c, n in zip(contents, sizes, strict=True)], dtype=object)


def sniffed(files: DataFrame) -> DataFrame:
    """``files`` (path, length, content) with ``fmt``: by magic numbers, and where there's none by grammar.

    Only what has no magic number goes to Python, and of it the first ``PEEK`` bytes: modules without a tag are
    known by their 15 sample records and orders, MP3 by a run of frames in its first 64 KiB. Null where nothing
    fits. A null content has no format.
    """
    magic = sniff(peek(F.col("content"), 2048), F.col("length"))
    known = files.withColumn("__magic", magic).withColumn("__ogg", _at(F.col("content"), 0, "OggS"))
    head = F.when(F.col("__magic").isNull() & ~F.coalesce("__ogg", F.lit(False)), peek(F.col("content"), PEEK))
    return known.withColumn("fmt", F.coalesce("__magic", _sniff_grammar(head, F.col("length")))).drop("__magic", "__ogg")

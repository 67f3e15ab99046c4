"""Checksums of media containers: CRC-32C, the Ogg page CRC, the MPEG audio CRC-16, and their combination.

Tables are made from the polynomials. Ogg's CRC is zlib's of turned bytes; the others' batches are hashed a byte position
at a time over all rows of a batch with numpy, so that the cost of Python is shared by the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTAGNOLI_REFLECTED = 0x82F63B78
OGG = 0x04C11DB7
MPEG = 0x8005


def _reflected(poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(poly), table >> 1)
    return table


def _forward(poly: int, bits: int) -> np.ndarray:
    top, mask = np.uint32(1 << (bits - 1)), np.uint32((1 << bits) - 1)
    table = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ np.uint32(poly), table << 1) & mask
    return table


CRC32C_TABLE = _reflected(CASTAGNOLI_REFLECTED)
OGG_TABLE = _forward(OGG, 32)
CRC16_TABLE = _forward(MPEG, 16)


def _padded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    width = int(sizes.max(initial=0))
    data = np.zeros((len(rows), width), np.uint8)
    for i, r in enumerate(rows):
        data[i, : len(r)] = np.frombuffer(r, np.uint8)
    return data, sizes


def crc_rows(rows: Iterable[bytes], kind: str = "crc32c") -> np.ndarray:
    """Checksums of many rows, each byte position of all rows at once; rows are taken by similar length."""
    rows = list(rows)
    if kind == "ogg":
        return np.array([ogg_crc(r) for r in rows], np.uint32)
    out = np.zeros(len(rows), np.uint32)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        data, sizes = _padded([rows[i] for i in part])
        if kind == "crc32c":
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
        else:
            crc = np.full(len(part), 0xFFFF, np.uint32)
        for k in range(data.shape[1]):
            live = sizes > k
            if kind == "crc32c":
                new = CRC32C_TABLE[(crc ^ data[:, k]) & 0xFF] ^ (crc >> 8)
            else:
                new = (CRC16_TABLE[((crc >> 8) ^ data[:, k]) & 0xFF] ^ (crc << np.uint32(8))) & 0xFFFF
            crc = np.where(live, new, crc)
        out[part] = crc ^ np.uint32(0xFFFFFFFF) if kind == "crc32c" else crc
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    table = _LISTS["crc32c"]
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


#: Each byte with its bits the other way round.
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _turned(x: int) -> int:
    return int.from_bytes(x.to_bytes(4, "big").translate(_TURNED), "little")


def ogg_crc(data: bytes, crc: int = 0) -> int:
    """Ogg's polynomial is zlib's with the bits the other way round; zlib inverts what goes in and comes out."""
    return _turned(zlib.crc32(data.translate(_TURNED), _turned(crc) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    table = _LISTS["crc16"]
    for b in data:
        crc = table[(crc >> 8 ^ b) & 0xFF] ^ (crc << 8 & 0xFFFF)
    return crc


_LISTS = {"crc32c": CRC32C_TABLE.tolist(), "crc16": CRC16_TABLE.tolist()}


def _times_matrix(matrix: Sequence[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


@lru_cache(maxsize=None)
def _zeros(power: int) -> tuple[int, ...]:
    """What 2 ** power zero bits do to a CRC-32C, by bit."""
    if not power:
        return (CASTAGNOLI_REFLECTED, *(1 << i for i in range(31)))
    step = _zeros(power - 1)
    return tuple(_times_matrix(step, row) for row in step)


def combine_crc32c(first: int, second: int, second_length: int) -> int:
    """CRC-32C of a concatenation from those of its parts: the first is moved past as many zero bytes by squared steps."""
    bits, power = second_length * 8, 0
    while bits:
        if bits & 1:
            first = _times_matrix(_zeros(power), first)
        bits, power = bits >> 1, power + 1
    return first ^ second


@F.pandas_udf(T.LongType())
def crc32c_udf(data: pd.Series) -> pd.Series:
    return pd.Series(crc_rows(data.map(bytes)).astype(np.int64))


@F.pandas_udf(T.LongType())
def combine_udf(first: pd.Series, second: pd.Series, size: pd.Series) -> pd.Series:
    """CRC-32C of a concatenation from those of its two parts and the second's length."""
    return pd.Series([combine_crc32c(int(a), int(b), int(n)) for a, b, n in zip(first, second, size, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def ogg_crc_udf(data: pd.Series) -> pd.Series:
    return pd.Series(crc_rows(data.map(bytes), "ogg").astype(np.int64))


@F.pandas_udf(T.LongType())
def crc16_udf(data: pd.Series) -> pd.Series:
    return pd.Series(crc_rows(data.map(bytes), "crc16").astype(np.int64))

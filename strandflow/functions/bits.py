"""Bit readers of both orders, and variable-length integers."""

from __future__ import annotations


class MsbReader:
    """Bits from the top of each byte, as MPEG audio and trackers' codes have them."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), at

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError("bits")
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    @property
    def left(self) -> int:
        return self.size - self.at


class LsbReader:
    """Bits from the bottom of each byte, as Vorbis has them."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), at

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError("bits")
        out = self.value >> self.at & ((1 << n) - 1)
        self.at += n
        return out

    def flag(self) -> bool:
        return bool(self.read(1))

    @property
    def left(self) -> int:
        return self.size - self.at


class LsbWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> LsbWriter:
        self.value |= (value & ((1 << n) - 1)) << self.size
        self.size += n
        return self

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


class MsbWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> MsbWriter:
        self.value = self.value << n | (value & ((1 << n) - 1))
        self.size += n
        return self

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")


def put_varint(value: int) -> bytes:
    """Seven bits a byte, lowest first; the top bit tells that more follow."""
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def reverse_bits(value: int, n: int) -> int:
    out = 0
    for _ in range(n):
        out = out << 1 | value & 1
        value >>= 1
    return out

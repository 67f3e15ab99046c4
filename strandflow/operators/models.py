"""Sequence models: predict, account for the cost, update. Each runs as a fold over one key's ordered events.

What a closed form can express is in ``cost``; these need an order, and run as grouped functions, a key in
a task. Costs are -log2 of the probability given to what came.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LIMIT = 120


class AdaptiveBit:
    """Probability of a one, moved by 1 / (n + 3) of the error, n counted up to ``LIMIT``."""

    __slots__ = ("p", "n")

    def __init__(self) -> None:
        self.p, self.n = 0.5, 0

    def update(self, bit: int) -> None:
        self.p += (bit - self.p) / (self.n + 3)
        if self.n < LIMIT:
            self.n += 1


class FrequencyTable:
    """Adaptive frequencies of a small alphabet: a symbol's rises with each use, and all halve towards the prior at a cap."""

    def __init__(self, n: int, step: int = 24, cap: int = 1 << 12) -> None:
        self.f, self.total, self.step, self.cap = [1] * n, n, step, cap

    def cost(self, symbol: int) -> float:
        return -math.log2(self.f[symbol] / self.total)

    def update(self, symbol: int) -> None:
        self.f[symbol] += self.step
        self.total += self.step
        if self.total > self.cap:
            self.f = [1 + (x - 1 >> 1) for x in self.f]
            self.total = sum(self.f)


class RangeCoder:
    """Binary arithmetic coder of 32-bit range with carries; probabilities are of a one in 1/65536."""

    TOP = 1 << 24

    def __init__(self) -> None:
        self.low, self.range, self.cache, self.pending, self.out, self.first = 0, 0xFFFFFFFF, 0, 0, bytearray(), True

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.low > 0xFFFFFFFF:
            carry = self.low >> 32
            if not self.first:
                self.out.append(self.cache + carry & 0xFF)
            self.out += bytes([0xFF + carry & 0xFF]) * self.pending
            self.pending, self.first = 0, False
            self.cache = self.low >> 24 & 0xFF
        else:
            self.pending += 1
        self.low = self.low << 8 & 0xFFFFFFFF

    def encode(self, bit: int, p: int) -> None:
        bound = (self.range >> 16) * p
        if bit:
            self.range = bound
        else:
            self.low += bound
            self.range -= bound
        while self.range < self.TOP:
            self.range = self.range << 8 & 0xFFFFFFFF
            self._shift()

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class RangeDecoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range = data, 4, 0xFFFFFFFF
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def decode(self, p: int) -> int:
        bound = (self.range >> 16) * p
        bit = int(self.code < bound)
        if bit:
            self.range = bound
        else:
            self.code -= bound
            self.range -= bound
        while self.range < RangeCoder.TOP:
            self.range = self.range << 8 & 0xFFFFFFFF
            self.code = self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
        return bit


def fixed(p: float) -> int:
    return min(65535, max(1, round(p * 65536)))


def code_bytes(data: bytes) -> bytes:
    """Order-1 adaptive binary coding of bytes, highest bit first, in the context of the byte before."""
    coder, table, prev = RangeCoder(), {}, 0
    for byte in data:
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            model = table.setdefault((prev, node), AdaptiveBit())
            coder.encode(bit, fixed(model.p))
            model.update(bit)
            node = node << 1 | bit
        prev = byte
    return coder.finish()


def decode_bytes(data: bytes, n: int) -> bytes:
    coder, table, prev, out = RangeDecoder(data), {}, 0, bytearray()
    for _ in range(n):
        node = 1
        while node < 256:
            model = table.setdefault((prev, node), AdaptiveBit())
            bit = coder.decode(fixed(model.p))
            model.update(bit)
            node = node << 1 | bit
        prev = node & 255
        out.append(prev)
    return bytes(out)


class Mixer:
    """Logistic mixing: stretched inputs weighed, squashed, and weights moved along the error."""

    def __init__(self, n: int, rate: float = 0.02) -> None:
        self.w, self.rate = np.full(n, 1.0 / n), rate

    def predict(self, probs: np.ndarray) -> float:
        self.x = np.log(probs / (1 - probs))
        self.p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.w @ self.x)))))
        return self.p

    def update(self, bit: int) -> None:
        self.w += self.rate * (bit - self.p) * self.x


class Apm:
    """Refines a probability by a context: interpolated between buckets of the stretched input."""

    def __init__(self, buckets: int = 24, rate: float = 0.02) -> None:
        self.n, self.rate, self.rows = buckets, rate, {}

    def refine(self, p: float, context: object) -> float:
        row = self.rows.setdefault(context, 1 / (1 + np.exp(-np.linspace(-8, 8, self.n + 1))))
        at = (max(-7.999, min(7.999, math.log(p / (1 - p)))) + 8) * self.n / 16
        self.i, self.f, self.row = int(at), at - int(at), row
        return float(row[self.i] * (1 - self.f) + row[self.i + 1] * self.f)

    def update(self, bit: int) -> None:
        self.row[self.i] += self.rate * (1 - self.f) * (bit - self.row[self.i])
        self.row[self.i + 1] += self.rate * self.f * (bit - self.row[self.i + 1])


def mixed_costs(bits: np.ndarray) -> tuple[float, float, float, float]:
    """Bits spent on a bit sequence by order 0, by order 2, by their mixture, and by that refined."""
    zero, two, mixer, apm = AdaptiveBit(), {}, Mixer(2), Apm()
    total, history = [0.0] * 4, 0
    for bit in bits.tolist():
        model = two.setdefault(history, AdaptiveBit())
        probs = np.clip(np.array([zero.p, model.p]), 1e-6, 1 - 1e-6)
        p = min(1 - 1e-6, max(1e-6, mixer.predict(probs)))
        q = min(1 - 1e-6, max(1e-6, apm.refine(p, history)))
        for k, x in enumerate((*probs, p, (p + q) / 2)):
            total[k] -= math.log2(x if bit else 1 - x)
        for m in (zero, model, mixer, apm):
            m.update(bit)
        history = (history << 1 | bit) & 3
    return tuple(total)


def lz_parse(data: bytes, distance: int = 1 << 16, least: int = 4, most: int = 259) -> list[tuple[int, int, int]]:
    """Greedy parse: (place, length, distance), distance 0 for a literal. A match is with the last place of the same ``least`` bytes."""
    last: dict[bytes, int] = {}
    out, at, end = [], 0, len(data)
    while at < end:
        size = back = 0
        if end - at >= least:
            prev = last.get(data[at : at + least])
            if prev is not None and at - prev <= distance:
                size = least
                while size < most and at + size < end and data[prev + size] == data[at + size]:
                    size += 1
                back = at - prev
        step = size or 1
        out.append((at, step, back))
        for k in range(at, at + step):
            last[data[k : k + least]] = k
        at += step
    return out


def lz_restore(data: bytes, tokens: list[tuple[int, int, int]]) -> bytes:
    """What the tokens give, literals taken from ``data``."""
    out = bytearray()
    for at, size, back in tokens:
        if back:
            for _ in range(size):
                out.append(out[-back])
        else:
            out += data[at : at + 1]
    return bytes(out)


def lms_residuals(x: np.ndarray, taps: int = 8, rate: float = 0.005) -> np.ndarray:
    """Residuals of a normalised least-mean-squares predictor over the last ``taps`` samples."""
    w, out = np.zeros(taps), np.empty(len(x))
    padded = np.concatenate([np.zeros(taps), x])
    for i in range(len(x)):
        past = padded[i : i + taps]
        out[i] = x[i] - w @ past
        w += rate * out[i] * past / (1e-6 + past @ past / taps)
    return out


def rls_residuals(x: np.ndarray, order: int = 4, decay: float = 0.998, every: int = 8, ridge: float = 1e-3) -> np.ndarray:
    """Residuals of least squares over decayed covariances, solved every few samples."""
    a, b, w, out = np.eye(order) * ridge, np.zeros(order), np.zeros(order), np.empty(len(x))
    padded = np.concatenate([np.zeros(order), x])
    for i in range(len(x)):
        past = padded[i : i + order]
        out[i] = x[i] - w @ past
        a, b = decay * a + np.outer(past, past), decay * b + past * x[i]
        if i % every == every - 1:
            w = np.linalg.solve(a + ridge * np.eye(order), b)
    return out


def fold_groups(df: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[pd.DataFrame], tuple]) -> DataFrame:
    """A row for each key from its ordered events."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), *fold(pdf))], columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)


#: Rows of an Arrow batch where each may be a file.
FILES_A_BATCH = 256


def map_rows(df: DataFrame, schema: str, one: Callable[[tuple], tuple]) -> DataFrame:
    """A row for each row: a file, a text or a key with its grammar or model. Batches are kept small."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(setting))
    if now <= 0 or now > FILES_A_BATCH:
        df.sparkSession.conf.set(setting, str(FILES_A_BATCH))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)

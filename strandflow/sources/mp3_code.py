"""A model of granules: side information, scalefactors and spectrum, from which the payload's bits are made again.

A granule's lines are coded by value, not by code word: the contexts are the lines before it, the same lines of
the granule before, and where in the spectrum it lies. The word tables are a parameter, as for reading.
"""

from __future__ import annotations

import numpy as np

from strandflow.functions.bits import MsbReader
from strandflow.operators.context import SymbolCoder, composite
from strandflow.sources import mp3_spectra
from strandflow.sources.mp3_spectra import LINES, Tables

#: Side information and its widths.
SIDE = (("big_values", 9), ("region0", 4), ("region1", 3), ("count1", 1), ("global_gain", 8), ("scalefac", 4))


def lines_of(tables: Tables, rate: int, g: dict, payload: bytes, bits: int) -> tuple[list[int], dict]:
    """(lines, side information with their count) of a granule; ValueError where the payload isn't what the tables make of its lines."""
    lines = mp3_spectra.spectrum(tables, MsbReader(payload + b"\0\0\0\0"), g, rate, bits)
    g = g | {"lines": g.get("lines", max(2 * g["big_values"], mp3_spectra.extents(lines)[1]))}
    if mp3_spectra.emit(tables, lines, g, rate) != (payload, bits):
        raise ValueError("not what the tables make of these lines")
    return lines, g


def pack_granules(tables: Tables, granules: list[tuple[dict, bytes, int]], rate: int) -> bytes:
    """Granules (side information, payload, bits) as the JVM's model takes them."""
    out: list[int] = []
    for g, payload, bits in granules:
        lines, g = lines_of(tables, rate, g, payload, bits)
        out += [*(g.get(name, 0) for name, _ in SIDE), *g["table_select"], g["lines"], *lines]
    return np.array(out, "<i4").tobytes()


def unpack_granules(tables: Tables, data: bytes, rate: int) -> list[tuple[dict, bytes, int]]:
    """(side information, payload, bits) of packed granules, payloads made again from the lines."""
    out = []
    for row in np.frombuffer(data, "<i4").reshape(-1, len(SIDE) + 4 + LINES).tolist():
        k = len(SIDE)
        g = dict(zip((name for name, _ in SIDE), row, strict=False)) | {"table_select": row[k : k + 3], "lines": row[k + 3]}
        out.append((g, *mp3_spectra.emit(tables, row[k + 4 :], g, rate)))
    return out


class GranuleCoder:
    """Codes the granules of a channel one after the other; with ``data`` it decodes them."""

    def __init__(self, tables: Tables, rate: int, data: bytes | None = None) -> None:
        self.tables, self.rate, self.coder = tables, rate, SymbolCoder(5, [32], data)
        self.before = [0] * LINES
        self.side: dict[str, int] = {}

    def granule(self, g: dict | None, payload: bytes | None, bits: int = 0) -> tuple[dict, bytes, int]:
        """(side information, payload, bits) of a granule, given or, with None, decoded.

        ValueError where the payload isn't what the tables make of its lines: such a granule is for its
        caller to keep as it is.
        """
        t, coder = self.tables, self.coder
        lines: list[int] | None = None
        if g is not None:
            lines, g = lines_of(t, self.rate, g, payload, bits)
        out: dict = {}
        for name, width in SIDE:
            old = self.side.get(name, 0)
            contexts = [composite(old), composite(old, out.get("big_values", 0)), composite(1, self.side.get("big_values", 0)), 2, composite(3, *out.values())]
            out[name] = coder.symbol(name, None if g is None else g.get(name, 0), width, contexts)
        select = []
        for k in range(3):
            old = self.side.get(f"table{k}", 0)
            contexts = [composite(k, old), composite(k, *select), composite(k, old, *select), k, composite(k, out["big_values"])]
            select.append(coder.symbol("table", None if g is None else g["table_select"][k], 5, contexts))
        out["table_select"] = select
        old = self.side.get("lines", 0)
        out["lines"] = coder.number("lines", None if g is None else g["lines"] - 2 * out["big_values"], [0, composite(out["big_values"]), composite(old), 1, 2]) + 2 * out["big_values"]
        self.side = {name: out[name] for name, _ in SIDE} | {f"table{k}": v for k, v in enumerate(select)} | {"lines": out["lines"]}
        now = [0] * LINES
        a, b = mp3_spectra.regions(self.rate, 2 * out["big_values"], out["region0"], out["region1"])
        for i in range(out["lines"]):
            table = select[(i >= a) + (i >= b)] if i < 2 * out["big_values"] else -1
            if table == 0:
                continue  # a region of silence
            near = abs(now[i - 1]) * 2 + abs(now[i - 2]) if i > 1 else 0
            past = abs(self.before[i]) * 2 + (abs(self.before[i - 1]) if i else 0) + (abs(self.before[i + 1]) if i + 1 < LINES else 0)
            small, quiet = min(near, 40), min(past, 40)
            contexts = [composite(table, small), composite(table, quiet), composite(table, small, quiet), composite(table, i >> 2), composite(small, quiet, i >> 5)]
            size = coder.number("line", None if lines is None else abs(lines[i]), contexts, [min(31, small)])
            if size and coder.symbol("sign", None if lines is None else int(lines[i] < 0), 1, [0, 1, 2, 3, 4]):
                size = -size
            now[i] = size
        self.before = now
        made = mp3_spectra.emit(t, now, out, self.rate)
        return out, *made

    def finish(self) -> bytes:
        return self.coder.finish()

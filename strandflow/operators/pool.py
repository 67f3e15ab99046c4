"""A bounded pool of code-length books: near lookups by L1 distance, least-used replacement, decay at a link's end."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Slots; 256 times the mean distance of a used length up to which a book is near, and beyond which the least used slot goes.
SLOTS = 32
NEAR = 256
FAR = 4094
#: What an unused length counts as.
UNUSED = 255


@dataclass
class Slot:
    shape: tuple
    lengths: list[int]
    uses: int = 0


@dataclass
class Pool:
    """``take`` finds a book's slot; a book meets only slots of its shape (entries, dimensions and the like)."""

    size: int = SLOTS
    slots: list[Slot] = field(default_factory=list)
    touched: set[int] = field(default_factory=set)

    def take(self, shape: tuple, lengths: list[int]) -> tuple[int, str, int | None]:
        """(slot, ``near``, ``new`` or ``replaced``, distance of the nearest of the shape). Lengths of 0 are unused."""
        used = sum(n > 0 for n in lengths)
        marked = [n or UNUSED for n in lengths] if used < len(lengths) else lengths
        nearest, least = 0, None
        for i, s in enumerate(self.slots):
            if s.shape == (*shape, len(lengths)):
                d = sum(abs(a - b) for a, b in zip(s.lengths, marked, strict=True))
                if least is None or d < least:
                    nearest, least = i, d
        share = None if least is None else least * 256 // used if used else 0 if least == 0 else None
        if share is not None and share <= NEAR:
            self.slots[nearest].uses += 1
            self.touched.add(nearest)
            return nearest, "near", least
        fresh = Slot((*shape, len(lengths)), list(marked))
        if len(self.slots) < self.size:
            self.slots.append(fresh)
            self.touched.add(len(self.slots) - 1)
            return len(self.slots) - 1, "new", least
        if share is None or share > FAR:
            nearest = min(range(len(self.slots)), key=lambda i: (self.slots[i].uses, i))
        fresh.uses = sum(s.uses for i, s in enumerate(self.slots) if i != nearest) >> (self.size >> 1).bit_length()
        self.slots[nearest] = fresh
        self.touched.add(nearest)
        return nearest, "replaced", least

    def end_link(self) -> None:
        """Slots that the link didn't use lose a use."""
        for i, s in enumerate(self.slots):
            if i not in self.touched and s.uses:
                s.uses -= 1
        self.touched.clear()


FOUND = "chain long, link long, seq long, slot int, how string, distance long"


def pooled(books: DataFrame, size: int = SLOTS) -> DataFrame:
    """``FOUND`` for books (chain long, link, seq, lengths array<int>): the pool is a chain's state, held over its links.

    A chain's books are read in order by one task, which holds the pool and no more; chains run apart.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["link", "seq"], kind="stable")
        pool, rows, last = Pool(size), [], None
        for chain, link, seq, lengths in zip(pdf["chain"], pdf["link"], pdf["seq"], pdf["lengths"], strict=True):
            if last is not None and link != last:
                pool.end_link()
            last = link
            slot, how, distance = pool.take((), [int(x) for x in lengths])
            rows.append((chain, link, seq, slot, how, distance))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"distance": "Int64"})

    return books.groupBy("chain").applyInPandas(run, FOUND)

"""Sum-of-squares online packing of tokenised documents into sequences.

Each task packs its own documents as they come, so that no shuffle is needed and a lost task can be run
again alone. What a document holds beyond whole windows goes to the fill level where the sum of squared
counts of partially filled windows grows least; the counts stand in an array by level. Beyond ``MAX_OPEN``
open windows each new one has the fullest completed, and at the task's end all are, fullest first: by the
largest open windows that fit whole, as the level array tells, and what no level fits by a cut from the
emptiest. A last rest is cut into lengths that are powers of two, so that nothing is padded. ``closed`` tells
how a piece's sequence came about: ``whole`` (cut from one document), ``placed`` (filled by placement alone),
``joined`` (completed by whole windows) or ``cut`` (completed by a cut).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm.common import bounded_batches

WINDOW = 2048
END = (1).to_bytes(4, "little")
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and their greatest length in bytes.
CACHE = 600_000
CACHED_BYTES = 64
#: Open windows held in memory, 8 KB each at most.
MAX_OPEN = 8192

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [pa.int64()] * 7 + [pa.string()]
#: Letters, then marks, none of them an apostrophe: a token ends between the two in any case.
LETTER = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
HEAD = re.compile(rb"(" + LETTER + rb"+)([!-&(-/:-@\[-`{-~]*)")
#: Words of letters encoded at once.
TOGETHER = 50


class WordIds:
    """Ids of texts as little-endian bytes, by way of their blank-separated words: no token spans a blank.

    Ids of words met before are remembered, in two generations of which the older is dropped when the
    younger is full. Words of letters are encoded many in a text: each ends with a token that ends words.
    """

    def __init__(self, path: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        # small letters need neither normalising nor the search for tokens within a word
        self.letters = Tokenizer(self.tokenizer.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        for token, i in ids.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def encode_letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        encoded = self.letters.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                raw, before = ids.tobytes(), 0
                for word, stop in zip(group, (4 * stops).tolist(), strict=True):
                    out[word] = raw[before:stop]
                    before = stop
            else:  # words whose tokens don't end where they do
                out.update(zip(group, self.encode([w.decode() for w in group]), strict=True))
        return out

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of new words: those of letters, of letters before marks, and others."""
        heads: dict[bytes, tuple[bytes, bytes]] = {}
        others: list[bytes] = []
        for w in words:
            m = HEAD.fullmatch(w)
            if m:
                heads[w] = m.groups()
            else:
                others.append(w)
        letters = self.encode_letters(list({h for h, _ in heads.values()}))
        marks = list({t for _, t in heads.values() if t})
        tails = dict(zip(marks, self.encode([t.decode() for t in marks]), strict=True))
        tails[b""] = b""
        out = {w: letters[h] + tails[t] for w, (h, t) in heads.items()}
        out.update(zip(others, self.encode([w.decode("utf-8", "replace") for w in others]), strict=True))
        return out

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        split = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            split.append((raw if b"<|" in raw else raw.lower()).split())  # a special token's case counts
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for w in set().union(*split):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        fresh = self.learn(new)
        long = {w: fresh.pop(w) for w in new if len(w) > CACHED_BYTES}
        known.update(fresh)
        for words in split:
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:
                yield b"".join([known[w] if w in known else long[w] for w in words])


_WORKER: dict[str | None, WordIds] = {}


def worker_ids(path: str | None) -> WordIds:
    """The worker's own: tasks that follow one another in a worker share what it remembers."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


class Packer:
    """Places pieces online and returns rows of finished sequences. A piece: (row, start, ids)."""

    def __init__(self, first_id: int, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.counts = np.zeros(window + 1, np.int64)  # partially filled windows by level
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, row: tuple, ids: bytes) -> None:
        """row: (doc_id, tokens of the document)."""
        size = len(ids) // 4
        whole = size - size % self.window
        for at in range(0, whole, self.window):
            self.close([(row, at, ids[4 * at : 4 * (at + self.window)])], "whole")
        if size > whole:
            self.place((row, whole, ids[4 * whole :]), size - whole)

    def place(self, piece: tuple, size: int) -> None:
        n, window = self.counts, self.window
        rise = 2 * n[size:] + 1  # for the level reached, from level 0 on
        rise[-1] = 0  # a full window isn't counted
        change = rise - 2 * n[: window - size + 1] + 1
        change[n[: window - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = rise[0]  # a new window
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        held = self.pop(level) if level else []
        held.append(piece)
        if level + size == window:
            self.close(held, "placed")
            return
        self.push(level + size, held)
        if self.n_open > self.max_open:
            self.complete(self.fullest(window))

    def push(self, level: int, held: list) -> None:
        self.counts[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(held)

    def pop(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def fullest(self, below: int) -> int:
        """The greatest level under ``below`` that has an open window, or 0."""
        levels = np.flatnonzero(self.counts[:below])
        return int(levels[-1]) if len(levels) else 0

    def close(self, pieces: Iterable[tuple], closed: str) -> None:
        offset = 0
        for (doc_id, tokens), start, ids in pieces:
            size = len(ids) // 4
            self.rows.append((doc_id, start, size, zlib.crc32(ids), tokens, self.next_id, offset, closed))
            offset += size
        self.next_id += 1

    def complete(self, level: int) -> None:
        """Fill a window of this level with whole open windows, the largest that fit, then by a cut from the emptiest."""
        held = self.pop(level)
        while level < self.window and (other := self.fullest(self.window - level + 1)):
            held += self.pop(other)
            level += other
        if level < self.window and self.n_open:
            other = int(np.flatnonzero(self.counts)[0])
            left = self.split(self.pop(other), self.window - level, held)
            self.push(other - (self.window - level), left)
            self.close(held, "cut")
        elif level == self.window:
            self.close(held, "joined")
        else:  # the last rest: powers of two
            for b in range(level.bit_length() - 1, -1, -1):
                if level >> b & 1:
                    part: list = []
                    held = self.split(held, 1 << b, part)
                    self.close(part, "cut")

    @staticmethod
    def split(pieces: list[tuple], size: int, into: list) -> list[tuple]:
        """Move ``size`` tokens of pieces into another list; what is left."""
        for i, (row, start, ids) in enumerate(pieces):
            have = len(ids) // 4
            if have > size:
                if size:
                    into.append((row, start, ids[: 4 * size]))
                return [(row, start + size, ids[4 * size :]), *pieces[i + 1 :]]
            into.append((row, start, ids))
            size -= have
        return []

    def finish(self) -> None:
        while level := self.fullest(self.window):
            self.complete(level)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], names=NAMES)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each piece, see ``SCHEMA``. ``path``: the vocabulary, on every executor.

    Null and empty texts have the end token alone. Null ids and repeated rows are packed like others; an
    empty table gives an empty result; documents of many windows are cut into whole ones. Sequence ids hold
    the task's number in their upper bits.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_ids(path)
        packer = Packer(TaskContext.get().partitionId() << 40)
        for batch in it:
            ids = words.batch(batch.column(1).to_pylist())
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                packer.add((doc_id, len(own) // 4 + 1), own + END)
            yield record_batch(packer.take())
        packer.finish()
        yield record_batch(packer.take())

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(batches, SCHEMA)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

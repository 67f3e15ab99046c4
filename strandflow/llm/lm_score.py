"""LM scoring by masked pseudo-likelihood with a bidirectional window network.

All words of the corpus are counted, and they hang on a tree: the commonest words are classes of their own,
other words share classes by their endings, known and rare ones apart. A small network sees the classes of
the two words before and the two after a masked word and predicts its class; from the class to the word goes
the word's exact share of the class's count, whatever word it is. So the probabilities of all words of the
corpus sum to one in every context. Every task trains a copy of the network on all its texts, in which each
word is masked once; the copies, which start alike, are averaged by their number of targets.
A document's score is the sum over all its words of the log-probability of each given its neighbours.

``VOCABULARY`` bounds only which counts the tasks hold: a rare word's count stays in the written table of
counts and is joined to the texts that have the word. What reaches the driver is bounded by ``VOCABULARY``
and by ``GATHERED`` sums of weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import bounded_batches
from strandflow.session import materialize

#: Words whose counts every task holds; the counts of all others, rare ones, are joined.
VOCABULARY = 1 << 16
#: Steps to an octave of counts when the vocabulary's least count is sought.
STEPS = 64
COMMON = 32
SHARED = 16
#: Common words, then shared classes of known words, then of rare ones; the last stands beyond a text's ends.
CLASSES = COMMON + 2 * SHARED
PAD = CLASSES
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 32
BATCH = 256
RATE = 0.02
SEED = 20
#: Words whose codes a worker remembers, and distinct words counted before they are sent on.
CACHE = 400_000
CHUNK = 1 << 12
#: Weights summed in a task at once, and sums that reach the driver at most.
GATHERED = 64
#: A word's class where it's written, and the columns of ``trained``.
CODE = np.dtype("<u2")
CODED = "copy long, classes binary, shares double, rare array<long>, part int, n double, total binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED) - (1 << 63)


def ending_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:], SEED) % SHARED


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, n): hash, ending class and count of each distinct word of all texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            columns = [
                pa.array([word_hash(w) for w in keys], pa.int64()),
                pa.array([ending_class(w) for w in keys], pa.int32()),
                pa.array([counts[w] for w in keys], pa.int64()),
            ]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["h", "ending", "n"])

        for batch in it:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > CACHE:
                yield flush()
        yield flush()

    partial = docs.select("text").mapInArrow(batches, "h long, ending int, n long")
    return partial.groupBy("h", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Known words by sorted hash, with class and log-share; by ending class, what the log-counts of rare words have yet to lose."""

    hashes: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    rare_shares: np.ndarray
    #: Log of each class's share of all words.
    class_shares: np.ndarray

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes, log-shares (of rare words without their log-counts), hashes, and whether rare, of words."""
        rare = np.ones(len(words), bool)
        h = np.array([word_hash(w) for w in words], np.int64)
        ending = np.array([ending_class(w) for w in words], np.int64)
        classes, shares = COMMON + SHARED + ending, self.rare_shares[ending]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            classes, shares = np.where(known, self.classes[at], classes), np.where(known, self.shares[at], shares)
            rare = ~known
        return classes, shares, h, rare


def commonest(counts: DataFrame, limit: int = VOCABULARY) -> list:
    """The ``limit`` commonest words, of equal counts those of the least hashes, commonest first.

    A histogram of counts by size, ``STEPS`` to an octave, tells which steps are in whole; of the step on the
    boundary the first are taken. So no task and not the driver gets more than ``limit`` words.
    """
    size = F.floor(F.log2("n") * STEPS).cast("int")
    histogram = {r.size: r.words for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()}
    words, edge = 0, None
    for step in sorted(histogram, reverse=True):
        if words + histogram[step] > limit:
            edge = step
            break
        words += histogram[step]
    if edge is None:
        return sorted(counts.collect(), key=lambda r: (-r.n, r.h))
    rest = counts.where(size == edge).orderBy(F.desc("n"), "h").limit(limit - words).collect()
    return sorted(counts.where(size > edge).collect() + rest, key=lambda r: (-r.n, r.h))


def lexicon(counts: DataFrame) -> Lexicon:
    """Of ``counts``, as ``count_words`` gives them and written."""
    top = commonest(counts, VOCABULARY)
    h = np.array([r.h for r in top], np.int64)
    n = np.array([r.n for r in top], np.float64)
    classes = np.array([i if i < COMMON else COMMON + r.ending for i, r in enumerate(top)], np.int64)
    mass = np.bincount(classes, weights=n, minlength=CLASSES)
    shares = np.log(n / mass[classes]) if len(top) else n
    total = np.zeros(SHARED)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        total[r.ending] = r.n
    mass[COMMON + SHARED :] = total - np.bincount([r.ending for r in top], weights=n, minlength=SHARED) if top else total
    rare = -np.log(np.maximum(1.0, mass[COMMON + SHARED :]))
    order = np.argsort(h)
    smooth = mass + 1
    return Lexicon(h[order], classes[order], shares[order], rare, np.log(smooth / smooth.sum()))


class Network:
    """Sum of a table row for each neighbour, tanh, and a softmax over classes."""

    def __init__(self, weights: np.ndarray | None = None, class_shares: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(SEED)
        shapes = [(len(OFFSETS), CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
        if weights is None:
            parts = [rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s) for s in shapes]
            if class_shares is not None:  # starts from the counts
                parts[-1] = class_shares
            weights = np.concatenate([p.ravel() for p in parts])
        self.shapes = shapes
        self.flat = weights.astype(np.float32)
        self.parts = self.views(self.flat)
        self.mean, self.square, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.hot = np.zeros((0, 0), np.float32)

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            size = int(np.prod(s))
            out.append(flat[at : at + size].reshape(s))
            at += size
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        table, bias = self.parts[:2]
        total = table[0].take(context[0], axis=0)
        for k in range(1, len(OFFSETS)):
            total += table[k].take(context[k], axis=0)
        total += bias
        return np.tanh(total, out=total)

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Those of a target as a column, less the greatest: what folds over classes then runs along whole rows."""
        logits = self.parts[2].T @ h.T
        logits += self.parts[3][:, None]
        logits -= logits.max(axis=0)
        return logits

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        logits = self.logits(self.hidden(context))
        picked = logits[target, np.arange(len(target))]
        np.exp(logits, out=logits)
        return picked - np.log(logits.sum(axis=0))

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean of minus the log-probabilities."""
        n = len(target)
        rows = np.arange(n)
        h = self.hidden(context)
        p = self.logits(h)
        np.exp(p, out=p)
        p /= p.sum(axis=0) * n
        p[target, rows] -= 1 / n
        dh = p.T @ self.parts[2].T
        slope = h * h
        np.subtract(1, slope, out=slope)
        dh *= slope
        width = self.shapes[0][1]
        if self.hot.shape[1] != n:  # kept between steps, all zeros
            self.hot = np.zeros((len(OFFSETS) * width, n), np.float32)
        ones = (context + width * np.arange(len(OFFSETS))[:, None]) * n + rows
        flat = np.empty_like(self.flat)
        table, bias, out, last = self.views(flat)
        self.hot.ravel()[ones] = 1
        np.matmul(self.hot, dh, out=table.reshape(-1, HIDDEN))
        self.hot.ravel()[ones] = 0
        dh.sum(axis=0, out=bias)
        np.matmul(h.T, p.T, out=out)
        p.sum(axis=1, out=last)
        return flat

    def train(self, context: np.ndarray, target: np.ndarray) -> None:
        g = self.gradient(context, target)
        self.steps += 1
        self.mean *= 0.9
        self.mean += 0.1 * g
        g *= g
        g *= 0.01
        self.square *= 0.99
        self.square += g
        step = np.divide(self.square, 1 - 0.99**self.steps, out=g)
        np.sqrt(step, out=step)
        step += 1e-8
        np.divide(self.mean, step, out=step)
        step *= RATE / (1 - 0.9**self.steps)
        self.flat -= step


class Coder:
    """Class codes and log-shares of texts, two pads between them."""

    def __init__(self, known: Lexicon) -> None:
        self.lexicon = known
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.codes, self.shares = np.zeros(0, np.int64), np.zeros(0)
        self.hashes, self.rare = np.zeros(0, np.int64), np.zeros(0, bool)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
        """(classes with pads, log-shares, places of the words in the first, number of words of each text, rows of the words)."""
        split = [words_of(t) for t in texts]
        if len(self.rows) > CACHE:
            self.clear()
        new = list(set().union(*split) - self.rows.keys()) if split else []
        if new:
            found = self.lexicon.codes(new)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            held = (self.codes, self.shares, self.hashes, self.rare)
            self.codes, self.shares, self.hashes, self.rare = (np.concatenate(x) for x in zip(held, found, strict=True))
        sizes = [len(s) for s in split]
        total = sum(sizes)
        row = self.rows.__getitem__
        rows = np.fromiter((x for s in split for x in map(row, s)), np.int64, total)
        places = np.arange(total) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
        padded = np.full(total + 2 * (len(sizes) + 1), PAD, np.int64)
        padded[places] = self.codes[rows]
        return padded, self.shares[rows], places, sizes, rows


def context_of(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([padded[places + k] for k in OFFSETS])


def text_hash(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), SEED) - (1 << 63)


def trained(docs: DataFrame, known: Lexicon) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) as the network reads it, and behind a task's texts the network that they trained.

    A text's ``classes`` are two bytes a word, ``shares`` is the sum of its words' log-shares, and ``rare``
    has the hashes of its rare words. A network is ``total``, its weights times its number ``n`` of targets.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, coder, seen, id_type = Network(class_shares=known.class_shares), Coder(known), 0, pa.int64()
        for batch in it:
            id_type = batch.schema.field(0).type
            texts = batch.column(1).to_pylist()
            padded, shares, places, sizes, rows = coder.batch(texts)
            for at in range(0, len(places), BATCH):
                part = places[at : at + BATCH]
                net.train(context_of(padded, part), padded[part])
            seen += len(places)
            classes, rare = padded[places].astype(CODE), coder.rare[rows]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            hashes = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(rare)])[ends], pa.int32()), pa.array(coder.hashes[rows[rare]], pa.int64())
            )
            yield coded_rows(
                batch.column(0),
                pa.array([text_hash(t) for t in texts], pa.int64()),
                pa.array([classes[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                pa.array(sums_between(shares, ends), pa.float64()),
                hashes,
            )
        total = (net.flat.astype(np.float64) * seen).tobytes()
        yield coded_rows(pa.nulls(1, id_type), part=TaskContext.get().partitionId(), n=float(seen), total=total)

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {CODED}")


def coded_rows(ids: pa.Array, *columns: pa.Array, **network: float | bytes) -> pa.RecordBatch:
    """A batch of ``trained``: ``columns`` of texts, or the fields of a network."""
    kinds = {"copy": pa.int64(), "classes": pa.binary(), "shares": pa.float64(), "rare": pa.list_(pa.int64()), "part": pa.int32(), "n": pa.float64(), "total": pa.binary()}
    given = dict(zip(kinds, columns, strict=False)) | {k: pa.array([v], kinds[k]) for k, v in network.items()}
    arrays = [ids, *(given.get(k, pa.nulls(len(ids), kind)) for k, kind in kinds.items())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *kinds])


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values from each end to before the next."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[ends[1:]] - sums[ends[:-1]]


def averaged(coded: DataFrame, tasks: int, known: Lexicon) -> Network:
    """The average of the networks in ``coded``, as ``trained`` gives them in ``tasks`` tasks, weighted by their number of targets.

    Weights are summed up a tree: ``GATHERED`` in a task, then ``GATHERED`` of those sums, until few are left.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        totals = pdf.sort_values("part")["total"]  # the same order again in a run after a loss
        total = np.sum([np.frombuffer(t, np.float64) for t in totals], axis=0)
        return pd.DataFrame({"part": [int(pdf["part"].min()) // GATHERED], "n": [pdf["n"].sum()], "total": [total.tobytes()]})

    sums, left = coded.where("total is not null").select("part", "n", "total"), tasks
    while True:
        sums = sums.groupBy(F.floor(F.col("part") / GATHERED).alias("of")).applyInPandas(add, "part int, n double, total binary")
        left = -(-left // GATHERED)
        if left <= GATHERED:
            break
    rows = sums.collect()
    n = sum(r.n for r in rows)
    if not n:
        return Network(class_shares=known.class_shares)
    return Network(sum(np.frombuffer(r.total, np.float64) for r in sorted(rows, key=lambda r: r.part)) / n)


def train(docs: DataFrame, known: Lexicon) -> Network:
    """The average of the networks that the tasks train."""
    return averaged(trained(docs, known), docs.rdd.getNumPartitions(), known)


def log_prob_sums(net: Network, padded: np.ndarray, places: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The sum of the log-probabilities of the classes of each text."""
    logs = np.zeros(len(places))
    for at in range(0, len(places), CHUNK):
        part = places[at : at + CHUNK]
        logs[at : at + CHUNK] = net.log_probs(context_of(padded, part), padded[part])
    return sums_between(logs, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def score_batch(net: Network, coder: Coder, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(words, log-likelihood but for the log-counts of rare words, number of rare words, of each text; hashes of the rare words).

    The texts needn't be of the corpus.
    """
    padded, shares, places, sizes, rows = coder.batch(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    rare = coder.rare[rows]
    sums = log_prob_sums(net, padded, places, sizes) + sums_between(shares, ends)
    return sizes, sums, np.diff(np.concatenate([[0], np.cumsum(rare)])[ends]), coder.hashes[rows[rare]]


def score_coded(net: Network, classes: list[bytes]) -> tuple[list[int], np.ndarray]:
    """(words, log-probability of the classes) of each text, given its ``classes``."""
    gap = np.full(2, PAD, CODE).tobytes()
    padded = np.frombuffer(gap + b"".join(c + gap for c in classes), CODE).astype(np.int64)
    sizes = [len(c) // 2 for c in classes]
    return sizes, log_prob_sums(net, padded, np.flatnonzero(padded != PAD), sizes)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and per_token (its mean) for each row of ``docs`` (doc_id, text).

    A null or empty text has no tokens, log-likelihood 0 and null per_token. Null ids and repeated rows are
    kept, a row each; an empty table gives an empty result. Texts are read whole, whatever their length,
    once for the counts and once more for their classes, which are written.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    counts = materialize(count_words(docs), "lm-counts")
    known = lexicon(counts)
    coded = materialize(trained(docs, known), "lm-coded")
    net = averaged(coded, docs.rdd.getNumPartitions(), known)
    shipped = spark.sparkContext.broadcast(net.flat)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Network(shipped.value)
        for batch in it:
            sizes, sums = score_coded(scorer, batch.column(2).to_pylist())
            sums += batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "copy", "n_tokens", "sum"]
            )

    texts = coded.where("total is null")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copy long, n_tokens long, sum double"
    scored = texts.select("doc_id", "copy", "classes", "shares").mapInArrow(batches, schema)
    # the log-counts of a text's rare words; copies of a text have theirs once
    words = texts.where(F.size("rare") > 0).groupBy("copy").agg(F.first("rare").alias("rare")).select("copy", F.explode("rare").alias("h"))
    found = words.join(counts.select("h", F.ln("n").alias("more")), "h").groupBy(F.col("copy").alias("__copy")).agg(F.sum("more").alias("more"))
    whole = scored.join(found, F.col("copy") == F.col("__copy"), "left")
    total = F.col("sum") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 6))
    return whole.select("doc_id", "n_tokens", F.round(total, 3).alias("log_likelihood"), mean.alias("per_token"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

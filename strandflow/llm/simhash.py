"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints have 64 bits. They are cut into six blocks or more; two fingerprints that differ in 4 bits or
fewer differ in 4 blocks at most, so they agree on all others and meet under the key of those: one of 15 keys
of two blocks in six, of 35 of three in seven, of 70 of four in eight. The more fingerprints there are, the
more blocks are cut, so that keys have few however large the corpus. Exact copies are folded first: only
distinct fingerprints meet. Where few share a key they are joined and their Hamming
distance is checked. Where many do, the group is cut into pieces of bounded size, every pair of pieces is
searched in a task of its own, and only links that join parts not yet joined are returned, so that a group
of copies gives a number of links in proportion to its size. Where so many do that even pairs of pieces
would be too many, fingerprints meet in the numbers between them, which is linear in their number.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.common import bounded_batches, whole_row
from strandflow.llm.graph import components
from strandflow.session import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Numbers of blocks that fingerprints may be cut into, and fingerprints to a key, if keys were even, up to which fewer blocks do.
CUTS = (6, 7, 8)
EVEN = 64
#: Fingerprints under a key up to which they are joined; beyond, they are searched piece by piece.
FEW = 32
#: Fingerprints in a piece, and pieces of a key up to which each meets each.
PIECE = 4096
PIECES = 256
CHUNK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as an unsigned number; a text of no words, or null, has zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts, ends = (stops - sizes)[: 1 - SHINGLE].tolist(), stops[SHINGLE - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        hashes = np.array([hash64(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(starts))
    return int.from_bytes(bits.tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint_of(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def blocks_of(cuts: int) -> list[tuple[int, int]]:
    """(shift, bits) of that many blocks, the wider ones first."""
    out, top = [], 64
    for i in range(cuts):
        bits = 64 // cuts + (i < 64 % cuts)
        top -= bits
        out.append((top, bits))
    return out


def cuts_for(fingerprints: int) -> int:
    """The least number of blocks whose keys are expected to have few fingerprints each."""
    for cuts in CUTS[:-1]:
        if fingerprints >> sum(bits for _, bits in blocks_of(cuts)[DISTANCE:]) <= EVEN:
            return cuts
    return CUTS[-1]


def block_keys(fp: Column, cuts: int = CUTS[0]) -> Column:
    """The keys: the number of the choice of ``cuts`` - ``DISTANCE`` blocks, then those blocks."""
    blocks = blocks_of(cuts)
    cut = [F.shiftrightunsigned(fp, shift).bitwiseAND((1 << bits) - 1) for shift, bits in blocks]
    keys = []
    for k, chosen in enumerate(combinations(range(cuts), cuts - DISTANCE)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, blocks[i][1]) + cut[i]
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join all that are linked, one fewer than each component has members. Memory is linear."""
    links: list[tuple[int, int]] = []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(np.bitwise_xor(rest, queue[-1])) <= distance
            top = queue.pop()
            found = rest[near]
            if len(found):
                rest = rest[~near]
                links += [(int(top), int(x)) for x in found]
                queue.extend(found)
    return links


def search(pdf: pd.DataFrame) -> pd.DataFrame:
    fps = np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
    links = np.array(forest(fps), dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def links(fps: DataFrame, cuts: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints (fp), enough to join all those linked by chains of links."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), cuts or cuts_for(fps.count()))).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(counts, "key"), "simhash-keys")
    few = met.where(F.col("n") <= FEW).select("key", "fp")
    other = few.select(F.col("key").alias("__key"), F.col("fp").alias("__fp"))
    near = (F.col("fp") < F.col("__fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("__fp"))) <= DISTANCE)
    joined = few.join(other, (F.col("key") == F.col("__key")) & near).select(F.col("fp").alias("a"), F.col("__fp").alias("b"))
    crowded = met.where(F.col("n") > PIECE * PIECES).select("fp").distinct()
    pieces = F.ceil(F.col("n") / PIECE).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    many = met.where(F.col("n").between(FEW + 1, PIECE * PIECES)).withColumn("pieces", pieces).withColumn("mine", mine)
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    grouped = many.groupBy("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    searched = grouped.applyInPandas(lambda pdf: search(pdf), "a long, b long")
    return joined.union(searched).union(stars(crowded))


def stars(fps: DataFrame) -> DataFrame:
    """Links of fingerprints (fp) that meet in a number between them, in a number of rows linear in theirs.

    Two that differ in 4 bits or fewer have a number that differs from each in 2 or fewer; and two that meet
    in such a number differ in 4 or fewer. So each sends itself to all numbers that near, and those that meet
    in one are linked to the least of them.
    """
    one = "transform(sequence(0, 64), i -> if(i < 64, shiftleft(1L, i), 0L))"  # a bit, or none
    masks = F.expr(f"array_distinct(flatten(transform({one}, a -> transform({one}, b -> a ^ b))))")
    sent = fps.select("fp", F.explode(masks).alias("mask"))
    sent = sent.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("between"))
    least = sent.groupBy("between").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    return sent.join(least, "between").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, fp and a hash of the text, written once."""
    bounded_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", fingerprint("text").alias("fp"), F.xxhash64("text").alias("copy")), "simhash-prints")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, first) for the distinct fingerprints of ``fps``: the class's first row is that of the smallest id, null last."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")
    distinct = materialize(fps.groupBy("fp").agg(F.min(row).alias("first")), "simhash-distinct")
    roots = materialize(components(links(distinct.select("fp"))), "simhash-roots")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(least, "root").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like others. Null ids are kept and name no
    component unless it has no other id (then null). Repeated rows are kept, a row each. An empty table
    gives an empty result.
    """
    fps = prints(docs)
    return fps.join(classes(fps), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id; of repeated rows one.

    Null and empty texts are a class like others. A row without an id stays only where its class has no id;
    all columns stay as they are; an empty table gives an empty result.
    """
    fps = prints(docs)
    keep = classes(fps).select(F.col("first.doc_id").alias("__id"), F.col("first.copy").alias("__copy")).distinct()
    keep = materialize(keep, "simhash-keep")
    marked = docs.select(whole_row(docs).alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__copy"))
    kept = marked.join(keep, same, "left_semi")
    repeated = fps.groupBy("doc_id", "copy").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"))
    if repeated.isEmpty():
        return kept.select("__row.*")
    repeated = materialize(repeated, "simhash-repeated")
    once = kept.join(repeated, same, "left_semi").groupBy("__doc", "__text").agg(F.first("__row").alias("__row"))
    return kept.join(repeated, same, "left_anti").select("__row.*").union(once.select("__row.*"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact top-k search by no-random-access aggregation.

Vectors and queries are dealt into blocks by hash, and each pair of blocks is searched in a task of its own.
In a block each component is a list of its vectors sorted by that component, which a query reads from the
end that its sign favours. All lists are read to the same depth, in rounds, and what has been read stands in
``Reader``: nothing else of a vector is ever looked at. A vector's score lies between what was read of it
plus the worst, and plus the best, that each list in which it wasn't met yet may still hold. Vectors whose
upper bound lies below the k-th best lower bound are outsiders for good; when the rest have been met in
every list their scores are final and the query stops. At the lists' ends all bounds have met, so that
reading on is the only way to a result. Queries of a block read together: the bounds of all vectors are
matrix products, and once few vectors are left to a query it looks at those alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.session import materialize

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Vectors in a block, queries in a block, and queries whose bounds for all vectors are held at once.
BLOCK = 8192
QUERY_BLOCK = 32768
TOGETHER = 256
#: Vectors in a block at least, where more blocks would only serve more tasks.
LEAST_BLOCK = 1024
#: What each round leaves unread of what the one before left.
LEFT = 0.6
#: A query looks at its own few vectors when no more than this share of a block is left.
FEW = 1 / 16
#: Products and sums of doubles are exact below.
EXACT = 2**51

FOUND = "query_row long, query_id long, unnamed boolean, vec_id long, score long, depth double"


def taking_part(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, x: components as doubles, dim) of the vectors that take part, written once.

    Null vectors and those with null or non-finite components take no part. ``row`` tells repeated ids apart.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.size("embedding").alias("dim"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): doubles, or Python's integers where doubles couldn't hold them all."""
    if not x.size or np.abs(x).max() < 2.0**43:
        return np.floor(x * SCALE)
    scaled = [math.floor(v * SCALE) if abs(v) < 2.0**43 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(scaled, dtype=object).reshape(x.shape)


def exact_together(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every sum of products stays exact, else both as Python's integers."""
    if vectors.size and queries.size and vectors.shape[1] * int(np.abs(vectors).max()) * int(np.abs(queries).max()) >= EXACT:
        as_int = np.vectorize(int, otypes=[object])
        return as_int(vectors), as_int(queries)
    return vectors.astype(np.float64), queries.astype(np.float64)


class Reader:
    """The sorted lists of a block, and what reading from their tops (first half) and bottoms has met."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.n, self.dim = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.lists = np.take_along_axis(vectors, self.order, axis=0)
        self.depth = 0
        self.entries = 0
        zero = vectors[:0].sum() if vectors.dtype != object else 0
        self.met = np.zeros((self.n, 2 * self.dim), bool)
        self.seen = np.full((self.n, 2 * self.dim), zero, vectors.dtype)

    def read_to(self, depth: int) -> None:
        """Read the next entries of each list, from both ends."""
        n, dim = self.n, self.dim
        column = np.arange(dim)[None, :]
        for half, part in ((0, slice(n - depth, n - self.depth)), (dim, slice(self.depth, depth))):
            rows = self.order[part]
            self.seen[rows, column + half] = self.lists[part]
            self.met[rows, column + half] = True
            self.entries += rows.size
        self.depth = depth

    def weights(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query and side: its weights, and the most and least that a list may add to a vector not met in it."""
        n, t = self.n, self.depth
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        top, bottom = self.lists[min(n - 1, n - t)], self.lists[max(0, t - 1)]
        best = np.hstack([up * top, down * bottom])
        worst = np.hstack([up * self.lists[0], down * self.lists[n - 1]])
        return np.hstack([up, down]), best, worst

    def bounds(self, rows, w: np.ndarray, best: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of ``rows`` for queries by column."""
        seen, unmet = self.seen[rows], ~self.met[rows]
        if seen.dtype != object:
            unmet = unmet.astype(np.float64)
        read = seen @ w.T
        return read + unmet @ worst.T, read + unmet @ best.T


def _kth(lower: np.ndarray, k: int):
    """The k-th best, or None where there are fewer than k."""
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else None


def search_block(rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, rank: np.ndarray, k: int = K):
    """((query, vector, score, depth) by place, the reader): each query's best k, its own row left out.

    Of equal scores those with the smallest ``rank`` come first. ``depth``: share of the lists read.
    """
    vectors, queries = exact_together(vectors, queries)
    reader = Reader(vectors)
    n, out = reader.n, []
    everyone = np.arange(n)
    dense, few = list(range(len(queries))), {}

    def finish(j: int, left: np.ndarray, scores: np.ndarray) -> None:
        order = sorted(range(len(left)), key=lambda i: (-scores[i], rank[left[i]]))[:k]
        out.extend((j, int(left[i]), int(scores[i]), reader.depth / n) for i in order)

    def settled(j: int, left: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray | None:
        """The vectors that may still qualify, or None when their scores are final."""
        kth = _kth(lower, k)
        stay = upper >= kth if kth is not None else np.ones(len(left), bool)
        if (lower[stay] == upper[stay]).all():
            finish(j, left[stay], lower[stay])
            return None
        return left[stay]

    while (dense or few) and n:
        reader.read_to(n - int((n - reader.depth) * LEFT) if reader.depth else max(1, n // 2))
        going: list[int] = []
        for at in range(0, len(dense), TOGETHER):
            group = dense[at : at + TOGETHER]
            lower, upper = reader.bounds(slice(None), *reader.weights(queries[group]))
            for c, j in enumerate(group):
                others = everyone[rows != query_rows[j]]
                left = settled(j, others, lower[others, c], upper[others, c])
                if left is not None:
                    if len(left) <= max(k, n * FEW):
                        few[j] = left
                    else:
                        going.append(j)
        dense = going
        fresh = {j for j in few}
        for j in sorted(fresh):
            lower, upper = reader.bounds(few[j], *reader.weights(queries[j : j + 1]))
            left = settled(j, few[j], lower[:, 0], upper[:, 0])
            if left is None:
                del few[j]
            else:
                few[j] = left
    return out, reader


def search(left: pd.DataFrame, right: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """left: a block of vectors; right: a block of queries."""
    found: list[tuple] = []
    if len(left) and len(right):
        vectors, queries = (quantised(np.array(side["x"].tolist(), dtype=np.float64).reshape(len(side), -1)) for side in (left, right))
        rows, query_rows = left["row"].to_numpy(np.int64), right["row"].to_numpy(np.int64)
        ids, unnamed = left["id"].to_numpy(np.int64), left["unnamed"].to_numpy(bool)
        rank = np.empty(len(left), np.int64)
        rank[np.lexsort((rows, ids, unnamed))] = np.arange(len(left))
        query_ids = right["id"].to_numpy(np.int64)
        for j, i, score, depth in search_block(rows, vectors, query_rows, queries, rank, k)[0]:
            if not -(2**63) <= score < 2**63:
                raise OverflowError(f"the score of vectors {query_ids[j]} and {ids[i]} doesn't fit a long: {score}")
            found.append((query_rows[j], query_ids[j], unnamed[i], ids[i], score, depth))
    return pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])


def found_in_blocks(vectors: DataFrame, k: int = K) -> DataFrame:
    """``FOUND`` for each query and block of vectors: the block's best k and the share of its lists that was read.

    A task holds a block of ``BLOCK`` vectors and one of ``QUERY_BLOCK`` queries, so each vector is sent
    once for each ``QUERY_BLOCK`` queries.
    """
    rows = taking_part(vectors)
    asked = F.col("vec_id") % QUERY_EVERY == 0
    n, n_asked = rows.agg(F.count("*"), F.count_if(asked)).first()
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / BLOCK), min(tasks, n // LEAST_BLOCK))
    query_blocks = max(1, math.ceil(n_asked / QUERY_BLOCK))
    named = rows.select("row", F.coalesce("vec_id", F.lit(0)).cast("long").alias("id"), F.col("vec_id").isNull().alias("unnamed"), "x", "dim")

    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.withColumn(mine, F.pmod(F.xxhash64("row"), F.lit(own)).cast("int")).withColumn(theirs, each)

    keys = ["dim", "block", "query_block"]
    left = dealt(named, blocks, query_blocks, "block", "query_block").groupBy(*keys)
    queries = named.where(~F.col("unnamed") & (F.col("id") % QUERY_EVERY == 0))
    queries = queries.select(*(F.col(c).alias(f"{c}_") for c in queries.columns)).toDF(*queries.columns)  # columns of its own
    right = dealt(queries, query_blocks, blocks, "query_block", "block").groupBy(*keys)

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search(vectors, queries, k)

    return left.cogroup(right).applyInPandas(run, FOUND)


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose id is divisible by 50, over all other rows.

    Every row but the query's own is a candidate: rows that repeat an id or a vector, and rows without an id
    (null vec_id, last of equal scores). A query id that repeats is asked once for each row. Vectors meet
    only those of their length. Fewer candidates than k give all. Scores are exact at any size; one that
    doesn't fit a long is an error. An empty table gives an empty result.
    """
    found = found_in_blocks(vectors, k).withColumn("vec_id", F.when(~F.col("unnamed"), F.col("vec_id")))
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def depths(vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, depth): the greatest share of the lists that a query's row read in any block until its scores were final."""
    return found_in_blocks(vectors, k).groupBy("query_row").agg(F.first("query_id").alias("query_id"), F.max("depth").alias("depth")).drop("query_row")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH parts AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM parts q JOIN parts c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

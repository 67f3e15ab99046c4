"""Information cost of symbols under adaptive models, and entropies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions.histograms import character_counts
from strandflow.operators.sequence import before

#: Rows of a context after which the adaptive bit stops counting and forgets at a fixed rate.
COUNT_LIMIT = 121


def adaptive_bit_cost(flag: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Bits to code ``flag`` by the adaptive probability (1 + ones before) / (rows before + 2)."""
    w = before(keys, order)
    ones = F.coalesce(F.sum(flag.cast("int")).over(w), F.lit(0))
    seen = F.count(F.lit(1)).over(w)
    hits = F.when(flag, 1 + ones).otherwise(1 + seen - ones)
    return -F.log2(hits.cast("double") / (seen + 2))


def adaptive_symbol_cost(df: DataFrame, symbol: str, keys: Sequence[str], order: Sequence[str], alphabet: int) -> DataFrame:
    """``bits``: cost of each symbol by add-one counts of the key's earlier symbols."""
    total = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    seen = F.row_number().over(W.partitionBy(*keys, symbol).orderBy(*order)) - 1
    return df.withColumn("bits", -F.log2((seen + 1).cast("double") / (total + alphabet)))


def entropy_of_counts(n: Column, total: Column) -> Column:
    """A symbol's part of the order-0 entropy in bits."""
    p = n.cast("double") / total
    return -p * F.log2(p)


def characters(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, ch, n): characters by code point, counted within each row before anything is shuffled."""
    counts = df.select(*keys, F.explode(character_counts(text)).alias("x"))
    return counts.groupBy(*keys, F.col("x.ch").alias("ch")).agg(F.sum("x.n").alias("n"))


def log2_factorial(n: Column) -> Column:
    """log2(n!), by a table up to 20 and Stirling's series beyond (error below 1e-10)."""
    table, total = [0.0], 0.0
    for i in range(1, 21):
        total += math.log2(i)
        table.append(total)
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.element_at(F.array(*(F.lit(v) for v in table)), (F.least(n, F.lit(20)) + 1).cast("int"))
    return F.when(n <= 20, small).otherwise(series / math.log(2))

"""Quality rules with risk-controlled thresholds.

Each text gets a fixed score of badness from counts of its whole text. In each stratum (language) the
labelled documents, none of which shaped the score, test cutoffs from the safest down: a cutoff holds if
the exact binomial test shows, at level ``DELTA`` shared among the strata (Bonferroni) and spent once in
each by the fixed order of its tests, that at most ``ALPHA`` of good documents reach it. The test needs
independent draws, so rows that repeat an id count once, and so do documents of the same text. Of the
cutoffs that hold, the one with the best balance of bad over good documents is used; a stratum with too few
labels to prove anything (ln(level) / ln(1 - ``ALPHA``) good texts, 299 for one stratum, 436 for four)
rejects nothing by score.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.common import bounded_batches, join_side, whole_row
from strandflow.session import materialize

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: At most this share of good documents may be rejected by score, with this chance of a mistake in any stratum.
ALPHA = 0.01
DELTA = 0.05
#: A good document rejected weighs as many bad ones kept.
GOOD_WEIGHT = 10
#: Steps of the score.
BINS = 1000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("score", T.IntegerType())])


def features_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score); null counts as no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    chars = len(text) - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = repeat_words(words)
    if not n:
        return 0, 0, symbols, 0, 0, BINS
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shares = (
        min(1.0, symbols / n),
        repeated / n,
        dup / lines,
        upper / chars if n > 3 else 0.0,
        min(1.0, max(0.0, chars / n - 12) / 12),  # words too long on average
    )
    return n, chars, symbols, dup, repeated, round(BINS * max(shares))


def repeat_words(words: list[bytes]) -> int:
    """Words within a 3-word window that occurs twice or more in the text, its first occurrence included."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered = 0
    end = 0  # words before are decided
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


@F.pandas_udf(FEATURES)
def features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(t) for t in texts], columns=FEATURES.names)


# called non-deterministic so that no filter is pushed below it, which would count every text twice
features = features.asNondeterministic()


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n draws with chance p, exactly but for rounding."""
    if k >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    for i in range(k, 0, -1):  # terms below k, relative to that of k
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(min(0.0, log_term + math.log(total))))


def best_cutoff(good: dict[int, int], bad: dict[int, int], delta: float, alpha: float = ALPHA) -> int | None:
    """The cutoff for one stratum from counts by score; scores at or above it are rejected. None: nothing is proven."""
    n = sum(good.values())
    best, best_gain = None, 0
    rejected_good = rejected_bad = 0
    for cutoff in range(BINS, 0, -1):  # fixed order: the first failure ends the tests
        rejected_good += good.get(cutoff, 0)
        rejected_bad += bad.get(cutoff, 0)
        if not n or rejected_good >= alpha * n or binomial_tail(rejected_good, n, alpha) > delta:
            break
        gain = rejected_bad - GOOD_WEIGHT * rejected_good
        if gain > best_gain:
            best, best_gain = cutoff, gain
    return best


def cutoffs(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, cutoff) from ``scored`` (doc_id, stratum, score, copy: a hash of the text) and ``labels`` (doc_id, quality).

    Documents labelled twice count as good if any label says so; labels without quality or id are left out. A
    labelled document counts once however many rows it has (with the worst score of them), and a text once in
    its stratum however many documents have it (as good if any is). Without labels there is no row.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    documents = scored.join(marks, "doc_id").groupBy("doc_id").agg(F.max(F.struct("score", "copy", "stratum", "quality")).alias("d")).select("d.*")
    texts = documents.groupBy("stratum", "copy", "score").agg(F.max("quality").alias("quality"))
    counts = texts.groupBy("stratum", "score", "quality").agg(F.count("*").alias("n"))
    counts = materialize(counts, "quality-counts")
    strata = max(1, counts.select("stratum").distinct().count())
    delta = DELTA / strata

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        by = [{int(s): int(n) for s, n, q in zip(pdf.score, pdf.n, pdf.quality, strict=True) if (q > 0) == want} for want in (True, False)]
        cutoff = best_cutoff(*by, delta)
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "cutoff": [cutoff]}).astype({"cutoff": "Int32"})

    # at most BINS + 1 scores and two labels a stratum
    return materialize(counts.groupBy("stratum").applyInPandas(choose, "stratum string, cutoff int"), "quality-cutoffs")


def scores(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").alias("stratum"), F.xxhash64("text").alias("copy"), features("text").alias("f"))
    return rows.select("doc_id", "stratum", "copy", "f.*")


def kept() -> Column:
    return ~base_failed() & ~F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang): counts, score, cutoff, base_failed and kept.

    A null or empty text has no words and fails; a null language is a stratum of its own; null ids and
    repeated rows are kept, a row each. Without labels no score rejects. An empty table gives an empty result.
    """
    found = materialize(scores(docs), "quality-features")
    out = join_side(found, cutoffs(found, labels), ["stratum"], "left")
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), kept().alias("kept"), "score", "cutoff")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, all their columns as they are.

    Null and empty texts go, having no words; null ids and repeated rows are judged by their text like others;
    without labels only the fixed rules reject; an empty table gives an empty result. Texts aren't shuffled:
    the counts are made a second time.
    """
    marks = cutoffs(scores(docs).select("doc_id", "stratum", "copy", "score"), labels)
    rows = docs.select(whole_row(docs).alias("__row"), F.col("lang").alias("stratum"), features("text").alias("f"))
    judged = join_side(rows.select("__row", "stratum", "f.*"), marks, ["stratum"], "left")
    return judged.where(kept()).select("__row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Secret scans: fixed key patterns, and sliding-window entropy over candidate strings.

The entropy of each window of a candidate is kept by incremental counts, an array by character: as the
window moves by a character, one count falls and one rises, and the sum of count * log2(count) changes by
two table steps. A candidate's class is the smallest alphabet that holds it (digits, hex, letters, base64).
Windows above the class's threshold make it a secret, unless the allow-list clears the candidate. Patterns
repeat characters only, never groups of them, so that time is in proportion to a text's length and the
stack doesn't grow with it. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import SPAN, bound, chunks_of, cut, folded, located, whole_row

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind: (pattern, group whose length counts, least length), in the order that breaks ties of start.
BASE_KINDS = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Class: (all characters are of, bits that some window must reach). Log2 of the window is 4.32.
CLASSES = {
    "digits": (r"^[0-9]+$", 3.2),
    "hex": (r"^[0-9a-fA-F]+$", 2.9),
    "letters": (r"^[A-Za-z]+$", 4.0),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.6),
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets whatever their entropy: those whose parts between separators all are words
#: (of one case or capitalised, shorter than a window) or numbers of dates, and those that fit a pattern.
SEPARATORS = r"[-_/+=]+"
WORD = rf"[A-Z]?[a-z]{{1,{WINDOW - 2}}}|[A-Z]{{1,{WINDOW - 1}}}"
DATE_PART = "(?:19|20)[0-9]{2}|0?[1-9]|[12][0-9]|3[01]"
CLEAR_PART = rf"^(?:{WORD}|{DATE_PART})?$"
ALLOW = (
    r"(?i)example|placeholder|changeme|your[-_]?(?:key|token|secret)",
    r"(.)\1{7,}",  # long runs of a character
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # UUIDs
)

MARKER = "[SECRET]"


#: What a count's term c * log2(c) counts as, so that sums are whole numbers and don't drift.
UNIT = 1 << 40


def max_window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any ``window`` characters in a row, by incremental counts.

    Strings shorter than the window give 0. Characters are those of ``ALPHABET``.
    """
    terms = F.array(*(F.lit(round(UNIT * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 2)))

    def rise(n: Column) -> Column:
        """What the sum grows by as a count of n becomes n + 1."""
        return F.get(terms, n + 1) - F.get(terms, n)

    def step(acc: Column, x: Column) -> Column:
        n, enters, leaves = acc["n"], x["enters"], x["leaves"]
        change = rise(F.get(n, enters)) - F.when(leaves >= 0, rise(F.get(n, leaves) - 1)).otherwise(0)
        moved = F.transform(n, lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        same = enters == leaves
        return bound(
            F.when(same, acc["s"]).otherwise(acc["s"] + change),
            lambda s: F.struct(
                F.when(same, n).otherwise(moved).alias("n"), s.alias("s"), F.when(x["i"] >= window - 1, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least")
            ),
        )

    def run(codes: Column) -> Column:
        items = F.transform(
            codes,
            lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("leaves"), i.alias("i")),
        )
        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("least"))
        return F.aggregate(items, start, step, lambda acc: F.coalesce(F.lit(math.log2(window)) - acc["least"] / float(UNIT * window), F.lit(0.0)))

    return bound(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), run)


def cleared(candidate: Column) -> Column:
    """Whether the allow-list clears a candidate."""
    found = F.forall(F.split(candidate, SEPARATORS), lambda part: part.rlike(CLEAR_PART))
    for pattern in ALLOW:
        found = found | candidate.rlike(pattern)
    return found


def entropy_spans(text: Column, kind: int) -> Column:
    """Spans of candidates that the allow-list doesn't clear and whose entropy reaches their class's threshold."""
    found = located(text, CANDIDATE, 0, 0, kind, words=True)

    def secret(span: Column) -> Column:
        word = span["word"]
        threshold = F.lit(99.0)
        for pattern, bits in reversed(CLASSES.values()):
            threshold = F.when(word.rlike(pattern), bits).otherwise(threshold)
        return F.when(cleared(word), False).otherwise(max_window_entropy(word) >= threshold)

    bare = F.transform(F.filter(found, secret), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return bare.cast(SPAN)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` as __row, with __text, base and added: arrays of spans by start, then kind."""
    none = F.array().cast(SPAN)
    text = F.coalesce("text", F.lit(""))
    base = {
        name: F.when(F.contains(F.col("__text"), F.lit("AKIA")) if name == "access" else F.col("__text").rlike(pattern),
                     located(F.col("__text"), pattern, group, least, i)).otherwise(none)
        for i, (name, (pattern, group, least)) in enumerate(BASE_KINDS.items())
    }
    base["entropy"] = F.when(F.col("__text").rlike(CANDIDATE), entropy_spans(F.col("__text"), len(BASE_KINDS))).otherwise(none)
    rows = docs.select(whole_row(docs).alias("__row"), text.alias("__text"))
    spans = rows.select("__row", "__text", *(c.alias(n) for n, c in base.items()))
    ordered = F.array_sort(F.concat(*BASE_KINDS))
    spans = spans.withColumn("base", ordered)
    # by start, base kinds first: a candidate is covered if some base span so far ends no earlier
    both = F.array_sort(F.concat("base", "entropy"))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        base = x["kind"] < len(BASE_KINDS)
        fresh = ~base & (x["end"] > reach)
        return F.when(base, F.greatest(reach, x["end"])).otherwise(reach), F.when(fresh, F.array(x)).otherwise(none)

    some = (F.size("entropy") > 0) & (F.size("base") > 0)
    return spans.withColumn("added", F.when(some, folded(both, F.lit(0), step, SPAN)).otherwise(F.col("entropy")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text).

    A null text counts as empty, and one without secrets has zero counts, the hash of the empty string and
    empty spans. Repeated rows and null ids are kept, a row each; an empty table gives an empty result; texts
    and candidates may be of any length. ``spans`` has the base kinds and ``entropy`` for candidates that no base span covers.
    """
    names = [*BASE_KINDS, "entropy"]
    listed = with_spans(docs.select("doc_id", "text"))

    def joined(col: Column) -> Column:
        kinds = F.array(*(F.lit(n) for n in names))
        return F.array_join(
            F.transform(col, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ","
        )

    return listed.select(
        F.col("__row.doc_id").alias("doc_id"),
        *(F.size(n).cast("long").alias(f"n_{n}") for n in BASE_KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """``docs`` with each secret in the text, and each run of overlapping ones, replaced by ``marker``.

    Texts without secrets, and nulls, stay as they are, however long; ``n_chars`` follows the text where there
    is one. Null ids and repeated rows are kept, a row each; an empty table gives an empty result.
    """
    found = with_spans(docs).withColumn("all", F.array_sort(F.concat("base", "added")))

    def redacted(chunks: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            fresh = (x["start"] >= at) & ((x["start"] > 0) | (at == 0))
            piece = F.when(fresh, F.array(cut(chunks, at, x["start"]), F.lit(marker))).otherwise(F.array().cast("array<string>"))
            return F.greatest(at, x["end"]), piece

        end = F.array_max(F.transform("all", lambda x: x["end"]))
        return F.concat(F.array_join(folded(F.col("all"), F.lit(0), step, "array<string>"), ""), cut(chunks, end, F.length("__text")))

    clean = F.when(F.size("all") > 0, bound(chunks_of(F.col("__text")), redacted)).otherwise(F.col("__row.text"))
    cleaned = found.select("__row", clean.alias("__clean"))
    return cleaned.select(*(_cleaned(c, docs) for c in docs.columns))


def _cleaned(name: str, docs: DataFrame) -> Column:
    if name == "text":
        return F.col("__clean").alias(name)
    kept = F.col("__row").getField(name)
    if name == "n_chars":
        kept = F.when(F.col("__clean").eqNullSafe(F.col("__row.text")), kept).otherwise(F.length("__clean").cast(docs.schema[name].dataType))
    return kept.alias(name)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

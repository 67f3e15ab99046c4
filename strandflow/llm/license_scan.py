"""License scans: Aho-Corasick over normalised words, and licence expressions by a shunting-yard parser.

A text's words are lower-cased and joined by single blanks, so that one automaton finds phrases across
punctuation and line ends, and word numbers are counts of blanks. Notice phrases give labels. Behind each
identifier tag that the automaton meets, up to the next, the expression in the original text is parsed:
``with`` binds closest, then ``and``, then ``or``; parentheses group. An expression's licences become labels
by family, as notices give them (``apache`` for Apache-2.0), and its score is how freely the text may be
used: the least of what ``and`` joins, the greatest of what ``or`` joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm.common import bounded_batches

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The method's further notices: phrase of words: label.
NOTICES = {
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "bsl",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc0": "cc0",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
    "unlicense org": "unlicense",
}
TAG = "spdx license identifier"
#: How freely a text under a licence may be used, by label; identifiers take their longest prefix here.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0,
    "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache": 0.9, "bsl": 0.9, "zlib": 0.9, "cc-by": 0.8, "cc": 0.5,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2,
    "proprietary": 0.0,
}
UNKNOWN = 0.1
#: What an exception (``with``) adds.
EXCEPTION = 0.1
RANK = {"or": 1, "and": 2, "with": 3}

WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"[()\n]|[A-Za-z0-9][A-Za-z0-9.+:_-]*")


def family(licence: str) -> str:
    """The label of an identifier: its longest prefix in ``FREEDOM``, else itself in lower case."""
    whole = name = licence.lower().removesuffix("-only").removesuffix("-or-later").rstrip("+")
    while name:
        if name in FREEDOM:
            return name
        name = name.rpartition("-")[0]
    return whole


def freedom(licence: str) -> float:
    return FREEDOM.get(family(licence), UNKNOWN)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard. The longest well-formed start is taken; a bracket that doesn't close is closed at its end.

    An expression ends with its line unless an operand is due or a bracket open; on the lines after its first
    only licences of a known family are taken, as other words are prose.
    """
    out: list[str] = []
    held: list[str] = []
    operand_due, first_line = True, True
    for m in TOKEN.finditer(expression):
        token = m[0]
        op = token.lower()
        if token == "\n":
            if not operand_due and "(" not in held:
                break
            first_line = False
        elif op in RANK:
            if operand_due:
                break
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[op]:
                out.append(held.pop())
            held.append(op)
            operand_due = True
        elif token == "(":
            if not operand_due:
                break
            held.append(token)
        elif token == ")":
            if operand_due or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand_due or not (first_line or (held and held[-1] == "with") or family(token) in FREEDOM):
                break
            out.append(token)
            operand_due = False
    if operand_due:  # an operator without its right side, and brackets opened after it, count for nothing
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [h for h in reversed(held) if h != "("]
    return out


def evaluate(postfix: list[str]) -> tuple[list[str], float]:
    """(labels of the licences, score) of an expression; nothing parsed: none and 0."""
    stack: list[float] = []
    names: list[str] = []
    for i, token in enumerate(postfix):
        if token in RANK and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(min(1.0, left + EXCEPTION))
            else:
                stack.append(min(left, right) if token == "and" else max(left, right))
        else:
            stack.append(freedom(token))
            if not (i + 1 < len(postfix) and postfix[i + 1] == "with"):  # an exception is no licence
                names.append(family(token))
    return names, (stack[-1] if stack else 0.0)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in ((0, BASE_PHRASES), (1, NOTICES), (2, {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan_text(text: str | None, found) -> tuple[int, int, int | None, int | None, str, str, float, list[str]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    blanked = raw.translate(WORD_BYTES)
    words = [w for w in blanked.split(b" ") if w]
    joined = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    tags: list[int] = []  # numbers of their first words
    at = word = 0
    hits = sorted((end - size + 1, kind, label) for end, (kind, label, size) in found.iter(joined))
    for start, kind, label in hits:
        if kind == 1:
            more.add(label)
            continue
        word += joined.count(" ", at, start)
        at = start
        if kind == 0:
            starts.append(word)
            base.add(label)
        else:
            tags.append(word)
    scores = [freedom(x) for x in base | more]
    expressions: list[str] = []
    if tags:
        spans = [m.span() for m in WORD.finditer(blanked)]
        for tag, after in zip(tags, [*tags[1:], len(spans)], strict=True):
            end = spans[after][0] if after < len(spans) else len(raw)
            postfix = to_postfix(raw[spans[tag + len(TAG.split()) - 1][1] : end].decode("utf-8", "replace"))
            names, score = evaluate(postfix)
            if names:
                more.update(names)
                scores.append(score)
                expressions.append(" ".join(postfix))
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | more)),
        min(scores, default=0.0),
        expressions,
    )


SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,
score double, expressions array<string>"""
FIELDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())),
]


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), see ``SCHEMA``; ``expressions`` are in postfix order.

    A null text counts as empty: no words, no labels, score 0. A text's score is the least over its notices
    and expressions. A tag with no licence behind it gives none. Null ids and repeated rows are kept; an
    empty table gives an empty result; work grows in proportion to a text's length.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in it:
            rows = [(i, *scan_text(t, found)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS]
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(batches, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, labels string"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    hits = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    None, "", "MIT License", "the mit\nLICENSE, apache-license mit license mit license", "GNU General Public License GENERAL PUBLIC LICENSE",
    "permit license mitlicense mit licenses", "émit license mit license é", "\x00mit\x7flicense\x01",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nbody",
    "Licensed under CC BY-NC 4.0.", "Ａmit license İmit license",
]


def test_brute_force(spark):
    rng = random.Random(1)
    vocab = ["mit", "license", "Apache", "general", "public", "License", "x", "é"]
    texts = TEXTS + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "--", ""]) for _ in range(300)) for _ in range(20)]
    texts += ["word " * 100000 + "mit license"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, TEXTS[3], None)] * 2
    out = L.scan(spark.createDataFrame(rows, DOCS)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    for r in out:
        assert 0 <= r.score <= 1 and {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}
    tagged = next(r for r in out if r.doc_id == 8)
    assert tagged.labels == "apache,gpl,mit" and tagged.score == 0.9


def test_shunting_yard():
    assert L.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert L.to_postfix("a and (b or c") == ["a", "b", "c", "or", "and"]
    assert L.to_postfix("a and") == ["a"] and L.to_postfix("") == [] and L.to_postfix("and b") == []
    assert L.to_postfix("MIT */") == ["MIT"]
    assert run("MIT AND GPL-3.0-or-later") == (["mit", "gpl"], 0.4)
    assert run("MIT OR GPL-3.0+")[1] == 0.9 and run("Weird-1.0") == (["weird-1.0"], L.UNKNOWN)
    assert run("(" * 50000 + "MIT" + ")" * 50000) == (["mit"], 0.9)


def run(expression):
    return L.evaluate(L.to_postfix(expression))


@pytest.mark.parametrize(("text", "labels", "expressions"), [
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0", "apache,mit", ["MIT", "Apache-2.0"]),
    ("spdx_license_identifier MIT\nand so on", "mit", ["MIT"]),
    ("/* SPDX-License-Identifier:\n * GPL-2.0-only */", "gpl", ["GPL-2.0-only"]),
    ("SPDX-License-Identifier:\n\nThis file is not licensed", "", []),
    ("SPDX-License-Identifier: (MIT OR\n# Apache-2.0)\nnext", "apache,mit", ["MIT Apache-2.0 or"]),
    ("é SPDX License Identifier = BSD-3-Clause and\nISC\nand MIT", "bsd,isc", ["BSD-3-Clause ISC and"]),
    ("SPDX-License-Identifier SPDX-License-Identifier: MIT", "mit", ["MIT"]),
    ("end SPDX-License-Identifier", "", []),
    ("SPDX-License-Identifier: Weird-1.0", "weird-1.0", ["Weird-1.0"]),
])
def test_every_tag(text, labels, expressions):
    row = L.scan_text(text, L.automaton())
    assert (row[5], row[7]) == (labels, expressions)


def test_long_texts_of_tags():
    row = L.scan_text("SPDX-License-Identifier: MIT " * 50000, L.automaton())
    assert row[5] == "mit" and len(row[7]) == 50000


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["MIT", "GPL-2.0-only", "CC0-1.0", "X"]), lambda x: st.tuples(x, st.sampled_from(["and", "or"]), x), max_leaves=9))
def test_expressions_against_trees(tree):
    def score(t):
        return L.freedom(t) if isinstance(t, str) else (min if t[1] == "and" else max)(score(t[0]), score(t[2]))

    def text(t):
        return t if isinstance(t, str) else f"({text(t[0])} {t[1].upper()} {text(t[2])})"

    assert run(text(tree))[1] == score(tree)


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0

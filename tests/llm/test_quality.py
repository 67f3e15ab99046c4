import math
import random
import re

import pytest

from strandflow.llm import quality

DOCS = "doc_id long, text string, lang string, score int, stratum string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [
    None, "", " \n\t", "a b c a b c", "x x x x x x", "line one\nline one\n\n \nline one ", "é ß 😀 #|<>&", "\x1ca\x0bb\x85c",
    "a b a b a b a c d e " * 3, "p q r s t u v w x y z " * 5 + "end",
]


def test_counts(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(40)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rows = [(i, t, None, 3, "clash") for i, t in enumerate(texts)] + [(None, TEXTS[4], "en", 3, "")] * 2
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(spark.createDataFrame(rows, DOCS), labels).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert all(r.kept == (not r.base_failed) for r in out)  # without labels nothing is proven


def test_very_long_text():
    n, _, _, _, repeated, _ = quality.features_of("very long " * 200000)
    assert n == repeated == 400000


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 40, 0.05), (12, 300, 0.05), (40, 40, 0.3), (7, 2000, 0.01)])
def test_binomial(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoff_is_proven():
    assert quality.best_cutoff({0: 100}, {900: 50}, 0.01) is None  # 100 good ones can't prove 1 % at that level
    assert quality.best_cutoff({0: 1000}, {900: 50, 700: 10}, 0.01) == 700
    cut = quality.best_cutoff({0: 1000, 650: 200}, {900: 50, 600: 100}, 0.01)
    assert cut == 900
    assert quality.best_cutoff({}, {900: 5}, 0.01) is None


def test_false_rejections_stay_limited(spark):
    rng = random.Random(9)
    wrong = 0
    for _ in range(200):
        good = {}
        for _ in range(1500):
            s = min(1000, int(rng.expovariate(1 / 150)))
            good[s] = good.get(s, 0) + 1
        cut = quality.best_cutoff(good, {s: 40 for s in range(300, 1001, 20)}, 0.05)
        if cut is not None and math.exp(-cut / 150) > quality.ALPHA:
            wrong += 1
    assert wrong <= 0.05 * 200 + 8


def test_method_rejects_by_stratum(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    junk = lambda: " ".join(f"w{rng.randrange(10**6)}###" for _ in range(60))
    rows, labels = [], []
    for i in range(2000):
        rows.append((i, plain() if i % 4 else junk(), "en", 0, ""))
        labels.append((i, int(i % 4 > 0), 0))
    rows += [(5000 + i, junk(), "xx", 0, "") for i in range(20)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judge(docs, marks).collect()
    assert all(r.kept == (r.doc_id % 4 > 0 or r.doc_id >= 5000) for r in out)
    kept = quality.good_documents(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)


def test_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(spark.createDataFrame([], DOCS), labels).count() == 0


def test_repeats_prove_nothing(spark):
    """A guarantee needs different good texts: neither rows nor copies that repeat one count again."""
    rng = random.Random(3)
    long = lambda i: " ".join(f"w{i}x{rng.randrange(10**6)}" for _ in range(60))
    bad = "#$% " * 60
    one = long(0)
    labels = "doc_id long, quality int, toxic int"
    rows = [(1, one, "en", 0, "")] * 600 + [(2, bad, "en", 0, "")]
    out = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], labels)).collect()
    assert {r.cutoff for r in out} == {None}
    rows = [(i, one, "en", 0, "") for i in range(600)] + [(1000, bad, "en", 0, "")]
    marks = [(i, 1, 0) for i in range(600)] + [(1000, 0, 0)]
    out = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, labels)).collect()
    assert {r.cutoff for r in out} == {None}
    noisy = "# " * 30 + " ".join(f"a{i}" for i in range(90))  # passes the fixed rules; a third of its words repeat
    rows = [(i, long(i), "en", 0, "") for i in range(299)] + [(1000, noisy, "en", 0, "")]
    marks = [(i, 1, 0) for i in range(299)] + [(1000, 0, 0)]
    out = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, labels)).collect()
    assert {r.cutoff for r in out} != {None} and not next(r.kept for r in out if r.doc_id == 1000)
    # one fewer isn't enough
    out = quality.judge(spark.createDataFrame(rows[1:], DOCS), spark.createDataFrame(marks, labels)).collect()
    assert {r.cutoff for r in out} == {None}


def test_good_documents_keep_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, "short", "en", "b"), (None, None, None, None)], "doc_id long, text string, lang string, `a.b` string")
    out = quality.good_documents(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, text, "en", "a")]

import hmac
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandflow.llm import pii

DOCS = "doc_id long, text string, copy string, kind string"
EMAIL = r"[a-z.]+\.[0-9]+@[a-z0-9]+\.example\.com"


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def run(spark, texts, ids=None):
    rows = [(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    out = pii.replace(spark.createDataFrame(rows, DOCS), "key").collect()
    assert len(out) == len(rows)
    return {r.doc_id: r for r in out}


def test_formats(spark):
    out = run(spark, [
        None, "", "Nothing to see, v1.2.3.", "mail ab.12@mail7.example.com!", "MAIL AB.12@MAIL7.EXAMPLE.COM and ab.12@mail7.example.com",
        "call +1 (784) 555-8120 or 784-555-8120 or (784) 555 8120.", "ip 42.144.35.254, 10.1.2.3 and 999.1.1.1", "card 4111 1111 1111 1111 4111111111111111 4041894974608795",
        "ssn 123-45-6789", "Mr. John Smith met Mrs. Smith and Frau Anna Maria Müller. MR JOHN",
        "Господин Иван Петров и Госпожа Петров", "é😀 Sr. Núñez 😀",
    ])
    assert out[0].text is None and out[1].text == "" and out[2].text == "Nothing to see, v1.2.3."
    assert re.fullmatch(r"mail [a-z]{2}\.[0-9]{2}@[a-z]{4}[0-9]\.example\.com!", out[3].text) and "ab.12" not in out[3].text
    a = re.search(EMAIL, out[3].text)[0]
    assert out[4].text == f"MAIL {a.upper()} and {a}"
    m = re.fullmatch(r"call \+1 \((\d{3})\) 555-(\d{4}) or (\d{3})-555-(\d{4}) or \((\d{3})\) 555 (\d{4})\.", out[5].text)
    assert m[1] == m[3] == m[5] != "784" and m[2] == m[4] == m[6]
    m = re.fullmatch(r"ip (\d+(?:\.\d+){3}), 10((?:\.\d+){3}) and 999\.1\.1\.1", out[6].text)
    assert m and m[1] != "42.144.35.254" and all(int(x) < 256 for x in m[1].split("."))
    _, a, b, c, d, e, f = out[7].text.split()
    assert a + b + c + d == e != "4111111111111111" and luhn(e) and e[0] == f[0] == "4" and luhn(f) == luhn("4041894974608795")
    assert re.fullmatch(r"ssn 9\d\d-\d\d-\d{4}", out[8].text)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and Frau (\w+) (\w+) (\w+)\. MR (\w+)", out[9].text)
    assert m[2] == m[3] and m[7] == m[1].upper() and {m[i] for i in range(1, 7)}.isdisjoint({"John", "Smith", "Anna", "Maria", "Müller"})
    assert m[4].endswith(tuple(pii.ENDINGS["latin"]["given-f"])) and m[1].endswith(tuple(pii.ENDINGS["latin"]["given-m"]))
    m = re.fullmatch(r"Господин ([А-я]+) ([А-я]+) и Госпожа ([А-я]+)", out[10].text)
    assert m[2] == m[3] != "Петров"
    assert out[11].text.startswith("é😀 Sr. ") and out[11].text.endswith(" 😀") and "Núñez" not in out[11].text
    assert out[9].n_mentions == 4 and out[9].kinds == "given-f,given-m,surname"


def test_collisions_are_drawn_again(spark, monkeypatch):
    # a generator with few values makes rounds necessary
    def few(kind, norm, attempt, key):
        return F.concat(F.lit("s"), (F.pmod(F.xxhash64(norm, attempt), F.lit(300) + 300 * attempt)).cast("string"))

    monkeypatch.setattr(pii, "surrogate", few)
    names = [f"s{i}" for i in range(40)] + [f"x{i}" for i in range(160)]
    out = pii.assign(spark.createDataFrame([("k", n) for n in names], "kind string, norm string"), "key").collect()
    made = [r.surrogate for r in out]
    assert sorted(r.norm for r in out) == sorted(names)
    assert len(set(made)) == len(made) and not {*made} & {*names}


def test_more_entities_than_a_shape_has_surrogates(spark):
    mails = [f"{c}@d{i}.com" for c in "abcdefghijklmnopqrstuvwxyz" for i in range(3)] + [f"_@x{i}.com" for i in range(5)]
    out = run(spark, [" ".join(mails)])[0].text.split()
    assert len({*out}) == len(mails) and not {*out} & {*mails}
    assert all(re.fullmatch(r"[a-z_][a-z0-9]*@example\.com", x) for x in out)


def test_growth_keeps_formats(spark):
    cases = [("phone", "7845558120"), ("ssn", "123456789"), ("card", "4111111111111111"), ("ip", "192.168.3.4"), ("ip", "8.8.8.8"), ("surname", "Smith")]
    df = spark.createDataFrame([(k, n, a) for k, n in cases for a in (2, 3, 5)], "kind string, norm string, attempt int")
    got = {(r.kind, r.norm, r.attempt): r.s for r in df.withColumn("s", pii.surrogate(*map(F.col, df.columns), "key")).collect()}
    for kind, n in (("phone", 10), ("ssn", 9), ("card", 16)):
        norm = dict(cases)[kind]
        assert [len(got[kind, norm, a]) for a in (2, 3, 5)] == [n, n + 2, n + 6]
    assert all(luhn(got["card", "4111111111111111", a]) for a in (2, 3, 5))
    assert got["ip", "192.168.3.4", 2].startswith("192.168.") and got["ip", "192.168.3.4", 3].startswith("10.")
    assert all(re.fullmatch(r"2001:db8(:[0-9a-f]{4}){6}", got["ip", x, 5]) for x in ("192.168.3.4", "8.8.8.8"))
    assert len({got["surname", "Smith", a] for a in (2, 3, 5)}) == 3
    row = spark.range(1).select(pii.formatted(F.lit("phone"), F.lit("+1 (784) 555-8120"), F.lit("7845558120"), F.lit("203555444499")).alias("x"))
    assert row.first().x == "+1 (203) 555-444499"


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in pii.replace(docs, "key").collect()}
    found = [EMAIL, r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<!\d)4\d{15}(?!\d)"]
    maps = defaultdict(dict)
    changed = 0
    for i, text in before.items():
        if out[i].n_mentions == 0:
            assert out[i].text == text
        for p in found:
            a, b = re.findall(p, text), re.findall(p, out[i].text)
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                changed += 1
                assert x != y and maps[p].setdefault(x, y) == y
    assert changed > 50
    for m in maps.values():
        assert len({*m.values()}) == len(m) and not {*m.values()} & m.keys()


def test_repeated_null_and_long(spark):
    long = "word " * 50000 + "call 212-555-0100 now"
    rows = [(1, "a@b.example.org", "", "")] * 3 + [(None, "a@b.example.org", "", "")] * 2 + [(1, "10.0.0.1", "", ""), (2, long, "", ""), (3, "x" * 200000 + "@", "", "")]
    out = pii.replace(spark.createDataFrame(rows, DOCS), "key").collect()
    assert len(out) == len(rows) and len({r.text for r in out if "@" in r.text and r.doc_id != 3}) == 1
    assert "212-555-0100" not in next(r.text for r in out if r.doc_id == 2)
    assert pii.replace(spark.createDataFrame([], DOCS), "key").count() == 0


def test_names_are_found_again_without_titles(spark):
    out = run(spark, [
        "Mr John Smith came. Later Smith said that JOHN SMITH's car, John's and Smithson's, wasn't Johnny's. smith",
        "dr x. Mrs\nO'Brien-Lee and MRS. O'BRIEN-LEE'S; 10 ms The end. MS Miller. mr Miller",
        "Smith alone, no title",
    ])
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Later (\w+) said that (\w+) (\w+)'s car, (\w+)'s and Smithson's, wasn't Johnny's\. smith", out[0].text)
    assert m[2] == m[3] and (m[4], m[5]) == (m[1].upper(), m[2].upper()) and m[6] == m[1] and {m[1], m[2]}.isdisjoint({"John", "Smith"})
    m = re.fullmatch(r"dr x\. Mrs\n(\w+) and MRS\. (\w+)'S; 10 ms The end\. MS (\w+)\. mr (\w+)", out[1].text)
    assert m[2] == m[1].upper() and m[3] == m[4] != "Miller"
    assert out[2].text == "Smith alone, no title"


def test_titles_that_tell_no_gender(spark):
    out = run(spark, [
        "Dr Smith came, Smith went. DR. JANE SMITH, Prof. Ada Lee and Professor\nLee", "Herr Dr. Müller und Prof Dr Weber", "Доктор Иван Петров, Петров", "Δρ. Νίκος",
        "a doctor Monday, the professor London, Drive In, Profane Things, sir Galahad", "Mr John Hill and Dr John Hill",
    ])
    m = re.fullmatch(r"Dr (\w+) came, (\w+) went\. DR\. (\w+) (\w+), Prof\. (\w+) (\w+) and Professor\n(\w+)", out[0].text)
    assert m[1] == m[2] != "Smith" and m[4] == m[1].upper() and m[6] == m[7] != "Lee" and m[3] != "JANE" and m[5] != "Ada"
    assert m[5].endswith(tuple(pii.ENDINGS["latin"]["given"])) and out[0].kinds == "given,surname" and out[0].n_mentions == 4
    m = re.fullmatch(r"Herr Dr\. (\w+) und Prof Dr (\w+)", out[1].text)
    assert m and {m[1], m[2]}.isdisjoint({"Müller", "Weber"})
    m = re.fullmatch(r"Доктор ([А-я]+) ([А-я]+), ([А-я]+)", out[2].text)
    assert m[1] != "Иван" and m[2] == m[3] != "Петров"
    assert out[3].text.startswith("Δρ. ") and "Νίκος" not in out[3].text
    assert out[4].n_mentions == 0 and out[4].text.startswith("a doctor Monday, the professor London")
    m = re.fullmatch(r"Mr (\w+) (\w+) and Dr (\w+) (\w+)", out[5].text)
    assert m[1] == m[3] != "John" and m[2] == m[4] != "Hill"


def iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_accounts(spark):
    out = run(spark, ["pay DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 or DE88370400440532013000", "DE89370400440532013000 FX12ABCD1234EFGH"])
    m = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d), (GB\d\d[A-Z]{4}\d{14}) or DE88370400440532013000", out[0].text)
    assert iban(m[1].replace(" ", "")) and iban(m[2]) and out[0].n_mentions == 2 and out[0].kinds == "iban"
    assert out[1].text == m[1].replace(" ", "") + " FX12ABCD1234EFGH"  # what fails its check is no account


def test_keys(spark):
    docs = spark.createDataFrame([(1, "a.b@c.example.org and 10.2.3.4", "", "")], DOCS)
    one, again, other = (pii.replace(docs, k).first().text for k in ("k1", "k1", "k" * 100))
    assert one == again != other
    got = spark.range(1).select(pii.hmac_sha256("k" * 100, F.lit("mé")).alias("long"), pii.hmac_sha256("k", F.lit("")).alias("short")).first()
    assert got.long == hmac.new(b"k" * 100, "mé".encode(), "sha256").hexdigest() and got.short == hmac.new(b"k", b"", "sha256").hexdigest()


def test_shapes_that_run_out(spark):
    """Rounds end where a shape has fewer surrogates than entities, or one only."""
    assert run(spark, ["mail -@example.com now", "x _@example.org"])[0].text != "mail -@example.com now"
    mails = [f"{'abcdefghij'[i % 10]}@x{i}.com" for i in range(1000)]
    out = run(spark, [" ".join(mails[i::4]) for i in range(4)])
    made = [w for r in out.values() for w in r.text.split()]
    assert len({*made}) == 1000 and not {*made} & {*mails}


def test_more_names_than_syllables_make(spark):
    names = spark.range(200_000).select(F.lit("surname").alias("kind"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("norm"))
    out = pii.assign(names, "key")
    assert out.count() == out.select("surrogate").distinct().count() == 200_000


def test_very_long_texts(spark):
    """Neither the stack nor the time for a character grows with the text."""
    texts = [
        "x@" + "a." * 1_000_000 + "com", "x@" + "a" * 1_000_000 + ".com", ("a" * 500 + "@") * 2000, "Mr " + "A" * 500_000, "Mr " * 200_000,
        "".join(f"u{i}@h{i}.org " for i in range(20_000)), "1" * 500_000 + " 1-" * 200_000, "Mr Smith " + "and Smith " * 50_000, "AB12 " * 100_000,
    ]
    out = run(spark, texts)
    assert [out[i].n_mentions for i in (0, 1, 4, 5, 6, 7, 8)] == [0, 1, 0, 20_000, 0, 1, 0]
    assert "Smith" not in out[7].text and len({*out[5].text.split()}) == 20_000 and not {*out[5].text.split()} & {*texts[5].split()}
    assert all(out[i].text == texts[i] for i in (0, 6, 8))


#: Detection over again, as plainly as can be: kind and pattern, tried in this order at each place.
WORD = r"(?!(?:mr|mrs|frau)(?![A-Za-z]))(?-i:[A-Z])[A-Za-z'-]*"
PLAIN = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"),
    ("card", r"(?<!\d)[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?!\d)"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"),
    ("name", rf"(?<![A-Za-z0-9])(?i:(?:Mr|Mrs|Frau)(?:\.\s*|\s+){WORD}(?: {WORD}){{0,2}})"),
]


def plain_mentions(text):
    at, found = 0, []
    while at < len(text):
        hits = [(m.start(), i, kind, m[0]) for i, (kind, p) in enumerate(PLAIN) if (m := re.compile(p, re.A).search(text, at))]
        if not hits:
            break
        start, _, kind, raw = min(hits)
        found.append((start, kind, raw))
        at = start + len(raw)
    return found


def plain_replacement(text, made):
    """``text`` with the surrogates of ``made`` (kind, norm), by a walk over its mentions and its words."""
    found = plain_mentions(text)
    named = {}
    for _, kind, raw in found:
        if kind == "name":
            words = re.findall(r"[A-Za-z][A-Za-z'-]*", raw)[1:]
            for i, w in enumerate(words):
                w = re.sub(r"'[sS]?$|-+$", "", w).capitalize()
                k = "surname" if i == len(words) - 1 else "given-m" if raw.startswith("Mr") and not raw.startswith("Mrs") else "given-f"
                named.setdefault(w, []).append(k)
    named = {w: made[min(ks, key=pii.NAME_KINDS.index), w] for w, ks in named.items()}

    def rename(part, skip):
        def sub(m):
            word = re.sub(r"'[sS]?$|-+$", "", m[0])
            new = named.get(word.capitalize()) if m[0][0].isupper() and not (skip and m.start() == 0) else None
            return m[0] if new is None else (new.upper() if word.isupper() and len(word) > 1 else new) + m[0][len(word) :]

        return re.sub(r"[A-Za-z][A-Za-z'-]*", sub, part)

    out, at = [], 0
    for start, kind, raw in found:
        out.append(rename(text[at:start], False))
        digits = re.sub(r"\D", "", raw)
        if kind == "name":
            out.append(rename(raw, True))
        elif kind == "email":
            new = made[kind, raw.lower()]
            out.append(new.upper() if raw.isupper() else new)
        elif kind == "ip":
            out.append(made[kind, raw])
        else:
            norm = digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
            new, left = list(made[kind, norm]), len(digits) - len(norm)
            put = []
            for c in raw:
                if c.isdigit() and left:
                    left -= 1
                    put.append(c)
                else:
                    put.append(new.pop(0) if c.isdigit() else c)
            out.append("".join(put + new))
        at = start + len(raw)
    return "".join(out) + rename(text[at:], False)


def test_brute_force(spark):
    rng = random.Random(6)
    things = [
        lambda: f"{rng.choice('abc')}{rng.randrange(30)}@{rng.choice(['m.example.com', 'X.org', 'a-b.co.uk'])}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10000):04}", lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04}",
        lambda: f"4{rng.randrange(10**15):015}", lambda: f"{rng.choice(['Mr', 'Mrs', 'Frau', 'Mr.'])} {rng.choice(NAMES)}", lambda: f"Mr {rng.choice(NAMES)} {rng.choice(NAMES)}'s",
        lambda: rng.choice(NAMES), lambda: rng.choice(NAMES).upper(), lambda: rng.choice(["and", "the", "x@", "1.2.3", "Mr", "@", "555-1234", "a.b.", "-"]),
    ]
    texts = ["".join(rng.choice(things)() + rng.choice([" ", "\n", ", ", " and ", "  "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    entities = set()
    for t in texts:
        for _, kind, raw in plain_mentions(t):
            digits = re.sub(r"\D", "", raw)
            if kind == "name":
                words = re.findall(r"[A-Za-z][A-Za-z'-]*", raw)[1:]
                male = raw.startswith("Mr") and not raw.startswith("Mrs")
                entities |= {("surname" if i == len(words) - 1 else "given-m" if male else "given-f", re.sub(r"'[sS]?$|-+$", "", w).capitalize()) for i, w in enumerate(words)}
            else:
                norm = {"email": raw.lower(), "ip": raw}.get(kind, digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits)
                entities.add((kind, norm))
    made = {(r.kind, r.norm): r.surrogate for r in pii.assign(spark.createDataFrame(sorted(entities), "kind string, norm string"), "key").collect()}
    got = {r.doc_id: r.text for r in pii.replace(docs, "key").collect()}
    assert got == {i: plain_replacement(t, made) for i, t in enumerate(texts)}
    assert sum(got[i] != t for i, t in enumerate(texts)) > 100


NAMES = ["John", "Smith", "Anna", "O'Brien", "Lee-Hill", "Brown"]

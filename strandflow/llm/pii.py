"""Surrogates for personal data: keyed, of the same type, gender, script and format.

One alternation finds e-mail addresses, phone numbers, IP addresses, card numbers, social security numbers,
account numbers (IBAN) and titled names, and cuts a text into mentions and the gaps between them. Where a
text names somebody by title, later mentions of those names alone are found in its gaps. Mentions are
normalised to entities, so that an entity has one surrogate wherever and however it's written. Surrogates
come from HMACs under the caller's key; in rounds, those that two entities share, or that are themselves an
entity of the corpus, are drawn again for all but one, until every entity has its own. After ``GRACE``
rounds surrogates get longer with each round, so no shape runs out of them.
Only texts with mentions are shuffled. Patterns repeat groups a bounded number of times, and texts are put
together from their pieces, so that stack and time hold on texts of any length. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import bound
from strandflow.session import discard, materialize

#: The setting that holds the key of ``op3_pii_surrogates``.
KEY_SETTING = "spark.strandflow.pii.key"
#: Draws in an entity's own shape, beyond which surrogates grow.
GRACE = 3
ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyz0123456789"

#: A domain has at most 127 labels.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9])"
)
MALE = r"Mr|Sir|Herr|Señor|Sr|Monsieur|Господин|Κύριος"
FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Sra|Dra|Madame|Mme|Mlle|Госпожа|Κυρία"
#: Titles that tell no gender.
NEUTRAL = r"Dr|Prof|Doctor|Professor|Doktor|Docteur|Professeur|Profesor|Доктор|Профессор|Δρ"
TITLE = f"{MALE}|{FEMALE}|{NEUTRAL}"
#: Titles stand as they are, in capitals or in small letters, but for those that are units or words then.
SMALL = r"(?!(?-i:ms|sr|sir|miss|doctor|professor|doktor|docteur|professeur|profesor|доктор|профессор)(?!\p{L}))"
NAME_WORD = rf"(?!(?iu:{TITLE})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'-]*+"  # and no title
NAME = rf"(?<![\p{{L}}\p{{N}}]){SMALL}(?iu:{TITLE})(?:\.\s*+|\s++){NAME_WORD}(?:\x20{NAME_WORD}){{0,2}}"
ANY = "|".join((EMAIL, IBAN, IP, SSN, CARD, PHONE, NAME))
#: A word, as names are looked up in gaps and mentions.
TOKEN = r"[\p{L}][\p{L}'-]*+"

#: What every titled name holds, in small letters.
TITLES = ("mr", "ms", "miss", "sir", "herr", "frau", "señor", "sr", "monsieur", "madame", "mme", "mlle", "dr", "prof", "doctor", "doktor", "docteur", "госп", "доктор", "профессор", "κύρι", "κυρί", "δρ")

#: Syllables and endings of made-up names by script.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "go", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "so", "ta", "te", "va"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "ка", "ко", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "но", "по", "ра", "ре", "ро", "са", "се", "со", "та", "те", "ти", "фа", "ха", "шу"],
    "greek": ["βα", "γα", "γε", "δα", "δε", "δο", "θα", "θε", "κα", "κε", "κο", "λα", "λε", "λι", "λο", "μα", "με", "μι", "μο", "να", "νε", "νι", "πα", "πε", "ρα", "ρε", "ρο", "σα", "σε", "τα", "τε", "φι"],
}
ENDINGS = {
    "latin": {"given-m": ["n", "s", "rd", "k"], "given-f": ["na", "la", "ra", "sa"], "given": ["ry", "lie", "ny", "xis"], "surname": ["ck", "ller", "nd", "rsen"]},
    "cyrillic": {"given-m": ["н", "р", "с", "м"], "given-f": ["на", "ра", "ля", "ша"], "given": ["ня", "ся", "лли", "ри"], "surname": ["в", "ко", "нь", "ц"]},
    "greek": {"given-m": ["ς", "ρος", "νος", "λος"], "given-f": ["να", "ρα", "λη", "σα"], "given": ["ι", "ω", "νι", "ρυ"], "surname": ["δης", "κης", "λος", "ρας"]},
}
NAME_KINDS = ("given-m", "given-f", "given", "surname")


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.split(text, "")


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex, of a string column."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def _bytes(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """64 keyed bytes in hex."""
    seed = F.concat_ws("|", kind, attempt.cast("string"), norm)
    return F.concat(*(hmac_sha256(key, F.concat(F.lit(half), seed)) for half in "01"))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(stream: Column, i: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (_byte(stream, i) % len(values) + 1).cast("int"))


def _shaped(text: Column, stream: Column, offset: int) -> Column:
    """Letters become letters and digits digits; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i + offset)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(F.lit(97) + b % 26)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _more(stream: Column, grow: Column, values: str) -> Column:
    """Two further characters for each round of growth."""
    return F.array_join(F.transform(F.array_repeat(F.lit(0), grow * 2), lambda _, i: _pick(stream, 63 - i, [*values])), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), weight), F.lit(0), lambda a, x: a + x)


def _email(norm: Column, stream: Column, grow: Column) -> Column:
    local = F.substring_index(norm, "@", 1)
    domain = F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    last_two = F.substring_index(domain, ".", -2)
    sub = F.substring(domain, F.lit(1), F.length(domain) - F.length(last_two))
    own = F.substring_index(last_two, ".", 1)
    reserved = F.when(tld.isin("com", "net", "org"), F.lit("example")).otherwise(_shaped(own, stream, 48))
    return F.concat(_shaped(local, stream, 0), _more(stream, grow, ALPHANUMERIC), F.lit("@"), _shaped(sub, stream, 32), reserved, F.lit("."), tld)


def _phone(norm: Column, stream: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        first = i.isin(0, 3)
        kept = (F.substring(norm, 4, 3) == "555") & i.between(3, 5)  # an exchange that serves examples
        return F.when(kept, c).when(first, (b % 8 + 2).cast("string")).otherwise((b % 10).cast("string"))

    return F.array_join(F.transform(_chars(norm), one), "")


def _card(norm: Column, stream: Column, grow: Column) -> Column:
    body = F.array_join(
        F.transform(_chars(F.expr("substring(norm, 1, length(norm) - 1)")), lambda c, i: F.when(i == 0, c).otherwise((_byte(stream, i) % 10).cast("string"))), ""
    )
    body = F.concat(body, _more(stream, grow, ALPHANUMERIC[26:]))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    valid = luhn_sum(norm) % 10 == 0  # a number that passes the check gets one that does
    return F.concat(body, F.when(valid, check).otherwise((check + 1) % 10).cast("string"))


def mod97(text: Column) -> Column:
    """The number that a text of digits and capitals writes, letters as 10 to 35, modulo 97."""

    def add(left: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter < 10, (left * 10 + F.ascii(c) - 48) % 97).otherwise((left * 100 + letter) % 97)

    return F.aggregate(_chars(text), F.lit(0), add)


def _iban_fits(norm: Column) -> Column:
    return mod97(F.concat(F.substring(norm, 5, 64), F.substring(norm, 1, 4))) == 1


def _iban(norm: Column, stream: Column, grow: Column) -> Column:
    """The country stays, digits become digits and letters letters, and the check digits fit."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).otherwise(F.char(F.lit(65) + b % 26))

    country = F.substring(norm, 1, 2)
    body = F.concat(F.array_join(F.transform(_chars(F.substring(norm, 5, 64)), one), ""), _more(stream, grow, ALPHANUMERIC[26:]))
    check = F.lit(98) - mod97(F.concat(body, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _ip(norm: Column, stream: Column, grow: Column) -> Column:
    """A private address has one of its block, then one of 10.0.0.0/8; at last all are of 2001:db8::/32, which holds more than there are."""
    octets = F.split(norm, r"\.")
    private = norm.rlike(r"^(?:10|127)\.")
    private_two = norm.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        kept = (private & (i == 0)) | (private_two & (i < 2))
        wider = private_two & (grow > 0) & (i == 0)
        return F.when(wider, "10").when(kept & (private | (grow == 0)), c).when(i == 0, (b % 116 + 11).cast("string")).when(i == 3, (b % 254 + 1).cast("string")).otherwise(b.cast("string"))

    groups = F.array(*(F.substring(stream, 4 * i + 1, 4) for i in range(6)))
    return F.when(grow > 2, F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))).otherwise(F.array_join(F.transform(octets, one), "."))


def _name(kind: Column, norm: Column, stream: Column, grow: Column) -> Column:
    def of(script: str) -> Column:
        parts = [_pick(stream, F.lit(i), SYLLABLES[script]) for i in range(3)]
        ending = F.lit("")
        for k in NAME_KINDS:
            ending = F.when(kind == k, _pick(stream, F.lit(3), ENDINGS[script][k])).otherwise(ending)
        more = F.array_join(F.transform(F.array_repeat(F.lit(0), grow), lambda _, i: _pick(stream, i + 4, SYLLABLES[script])), "")
        return F.initcap(F.concat(*parts, more, ending))

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    return bound(_bytes(key, kind, norm, attempt), lambda s: _surrogate(kind, norm, attempt, s))


def _surrogate(kind: Column, norm: Column, attempt: Column, s: Column) -> Column:
    grow = F.greatest(attempt - (GRACE - 1), F.lit(0))
    digits = _more(s, grow, ALPHANUMERIC[26:])
    ssn = F.concat(F.lit("9"), F.substring(_shaped(norm, s, 0), 2, 8), digits)  # no such number is given out
    return (
        F.when(kind == "email", _email(norm, s, grow))
        .when(kind == "phone", F.concat(_phone(norm, s), digits))
        .when(kind == "ip", _ip(norm, s, grow))
        .when(kind == "card", _card(norm, s, grow))
        .when(kind == "ssn", ssn)
        .when(kind == "iban", _iban(norm, s, grow))
        .otherwise(_name(kind, norm, s, grow))
    )


def name_norm(word: Column) -> Column:
    """A name's norm: capitalised, without an owner's ending."""
    return F.initcap(F.regexp_replace(word, r"'(?:[sS])?$|-+$", ""))


def name_rest(word: Column) -> Column:
    """What ``name_norm`` leaves off."""
    return F.regexp_extract(word, r"('(?:[sS])?|-+)$", 0)


def parts_of(raw: Column) -> Column:
    """The entities of a mention: kind and norm; norm is null where check digits tell that it's none."""

    def whole(pattern: str) -> Column:
        return raw.rlike(rf"^(?:{pattern})$")

    def one(kind: str, norm: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), norm.alias("norm")))

    digits = _digits(raw)
    given = F.when(raw.rlike(rf"^(?iu:{FEMALE})(?![\p{{L}}])"), "given-f").when(raw.rlike(rf"^(?iu:{NEUTRAL})(?![\p{{L}}])"), "given").otherwise("given-m")
    words = F.slice(F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0)), 2, 3)
    names = bound(words, lambda ws: F.transform(ws, lambda w, i: F.struct(F.when(i == F.size(ws) - 1, "surname").otherwise(given).alias("kind"), name_norm(w).alias("norm"))))
    return (
        F.when(F.contains(raw, F.lit("@")), one("email", F.lower(raw)))
        .when(whole(IP), one("ip", raw))
        .when(whole(SSN), one("ssn", digits))
        .when(whole(CARD), one("card", digits))
        .when(whole(IBAN), bound(F.regexp_replace(raw, " ", ""), lambda n: one("iban", F.when(_iban_fits(n), n))))
        .when(whole(PHONE), one("phone", F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).otherwise(digits)))
        .otherwise(names)
    )


def pieces_of(text: Column) -> Column:
    """The text as gaps, each with the mention behind it (``raw``, and its ``parts``; the last gap has none)."""
    raws = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    pairs = F.arrays_zip(F.split(text, ANY).alias("gap"), raws.alias("raw"))
    return F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["raw"].alias("raw"), F.when(x["raw"].isNotNull(), parts_of(x["raw"])).alias("parts")))


def has_mention(text: Column) -> Column:
    """Whether any pattern fits; each is tried only where the characters that it needs are there."""
    small = F.lower(text)
    titled = F.contains(small, F.lit(TITLES[0]))
    for t in TITLES[1:]:
        titled = titled | F.contains(small, F.lit(t))
    numbers = "|".join((IP, SSN, CARD, PHONE))
    found = (
        (F.contains(text, F.lit("@")) & text.rlike(EMAIL))
        | (text.rlike(r"[0-9][0-9.]") & text.rlike(numbers))
        | text.rlike(IBAN)
        | (titled & text.rlike(NAME))
    )
    return F.coalesce(found, F.lit(False))


def formatted(kind: Column, raw: Column, norm: Column, made: Column) -> Column:
    """The surrogate written as the mention was: digits (of accounts, letters too) in their places, those beyond at its end, capitals where all were."""
    account = kind == "iban"
    surplus = F.when(account, 0).otherwise(F.length(_digits(raw)) - F.length(norm))  # a country code that the entity is written with or without
    begin = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        own = F.when(account, c.rlike("[0-9A-Z]")).otherwise(c.rlike("[0-9]"))
        put = F.when(own & (acc["n"] >= surplus), F.substring(made, acc["n"] - surplus + 1, F.lit(1))).otherwise(c)
        return F.struct((acc["n"] + F.when(own, 1).otherwise(0)).alias("n"), F.concat(acc["out"], put).alias("out"))

    digits = F.aggregate(_chars(raw), begin, step, lambda acc: acc["out"])
    digits = F.concat(digits, F.substring(made, F.length(norm) + 1, F.length(made)))
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), digits).when(upper, F.upper(made)).otherwise(made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate): each entity its own, and none that of the corpus. ``entities``: distinct (kind, norm).

    Each round keeps one entity of those that drew a surrogate that is free. Rounds end: from ``GRACE`` on the
    space of surrogates of any shape grows many times over with each, while those without one only get fewer.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = entities.select("kind", F.col("norm").alias("surrogate"))
    pending = entities.withColumn("attempt", F.lit(0))
    done: list[DataFrame] = []
    while True:
        drawn = pending.repartition(tasks, "kind", "norm").withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        drawn = materialize(drawn, "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))  # one of those that drew it
        kept = materialize(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "norm", "surrogate"), "pii-kept")
        done.append(kept)
        taken = taken.union(kept.select("kind", "surrogate"))
        pending = drawn.join(kept.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        pending = materialize(pending, "pii-pending")
        discard(drawn)
        if pending.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.union(d)
            return out


def rewritten(pieces: Column, made: Column, names: Column) -> Column:
    """The text of ``pieces``, each mention with the surrogate of its place in ``made``; ``names``: (kind, norm, made) of the text's names."""

    def renamed(text: Column, title: bool, maps: list[Column]) -> Column:
        """Words that are names of the text, replaced; the first word of a titled mention stays."""

        def name(word: Column, i: Column) -> Column:
            norm = name_norm(word)
            found = F.when(word.rlike(r"^\p{Lu}"), F.coalesce(*(F.try_element_at(m, norm) for m in maps)))
            new = F.concat(formatted(F.lit("surname"), F.regexp_replace(word, r"'[sS]$", ""), norm, found), name_rest(word))
            return F.coalesce(F.when(i > 0, new) if title else new, word)

        words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), name)
        pairs = F.arrays_zip(F.split(text, TOKEN).alias("gap"), words.alias("word"))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(p["word"], F.lit("")))), "")

    def written(maps: list[Column]) -> Column:
        def one(piece: Column, i: Column) -> Column:
            raw, part = piece["raw"], F.get(piece["parts"], F.lit(0))
            mention = F.when(part["kind"].isin(*NAME_KINDS), renamed(raw, True, maps)).otherwise(formatted(part["kind"], raw, part["norm"], F.get(made, i)["made"]))
            gap = F.when(F.size(names) > 0, renamed(piece["gap"], False, maps)).otherwise(piece["gap"])
            return F.concat(gap, F.coalesce(mention, raw, F.lit("")))

        return F.array_join(F.transform(pieces, one), "")

    def with_maps(maps: list[Column], kinds: tuple[str, ...]) -> Column:
        if not kinds:
            return written(maps)
        own = F.filter(names, lambda e: e["kind"] == kinds[0])
        return bound(F.map_from_entries(F.transform(own, lambda e: F.struct(e["norm"], e["made"]))), lambda m: with_maps([*maps, m], kinds[1:]))

    return with_maps([], NAME_KINDS)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_mentions and kinds for each row of ``docs`` (doc_id, text).

    ``key`` decides the surrogates: with the same key and corpus they're the same again. It stands in the
    query's plan, so event logs and the UI need the key's protection. Null texts stay null; texts without
    mentions stay as they are, and texts may be of any length. Null ids and repeated rows are kept, a row
    each; an empty table gives an empty result. ``n_mentions`` counts those that the patterns find, without
    the names alone that were found through them; a word that is a given name and a surname of a text has
    the surrogate of the first.
    """
    rows = docs.select("doc_id", "text")
    hit = has_mention(F.col("text"))
    found = rows.where(hit).select("doc_id", F.xxhash64("text").alias("copy"), pieces_of(F.col("text")).alias("pieces"))
    found = materialize(found, "pii-pieces")
    mentions = found.select("doc_id", "copy", F.posexplode("pieces").alias("at", "piece")).where("piece.raw is not null")
    parts = mentions.select("doc_id", "copy", "at", F.posexplode("piece.parts").alias("part", "e")).select("doc_id", "copy", "at", "part", "e.kind", "e.norm")
    entities = parts.where("norm is not null").select("kind", "norm").distinct()
    named = assign(materialize(entities, "pii-entities"), key).withColumnRenamed("surrogate", "made")
    pairs = parts.join(named, ["kind", "norm"], "left")
    # sets, as rows may repeat: the first parts of all mentions in order, and the names
    first = F.collect_set(F.when(F.col("part") == 0, F.struct("at", "kind", "made")))
    names = F.collect_set(F.when(F.col("kind").isin(*NAME_KINDS), F.struct("kind", "norm", "made")))
    lists = pairs.groupBy(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).agg(F.array_sort(first).alias("made"), names.alias("names"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("copy") == F.col("__copy"))
    kinds = F.array_union(F.transform(F.filter("made", lambda e: e["made"].isNotNull()), lambda e: e["kind"]), F.transform("names", lambda e: e["kind"]))
    changed = found.join(lists, same).select(
        "doc_id",
        rewritten(F.col("pieces"), F.col("made"), F.col("names")).alias("text"),
        F.size(F.filter("made", lambda e: e["made"].isNotNull())).cast("long").alias("n_mentions"),
        F.array_join(F.array_sort(kinds), ",").alias("kinds"),
    )
    rest = rows.where(~hit).select("doc_id", "text", F.lit(0).cast("long").alias("n_mentions"), F.lit("").alias("kinds"))
    return rest.union(changed)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``KEY_SETTING``; where it's unset, one drawn for this run, and lost with it."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)

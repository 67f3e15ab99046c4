"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression together with the literal tokens that any URL it matches must hold. The
tokens of the table's URLs that occur in rules are counted, each rule is filed under its rarest token, and
a URL's own tokens fetch the candidate rules. Only those run their regular expression on the URL. Patterns
repeat characters only, never groups, and try few starts, so that time and stack hold on URLs of any length.
Rules are a table: ``SITE_RULES`` and ``PATTERN_RULES`` are the default, and a caller may bring millions.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import ascii_lower, join_side
from strandflow.session import materialize

#: What splits a URL into tokens.
BREAKS = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: A site rule gives the verdict ahead of all pattern rules; the longest wins.
    site: bool


def site_rule(verdict: str, name: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    quoted = "".join(f"\\{c}" if c in r".+*?()[]{}|^$\-" else c for c in name)
    tokens = tuple(t for t in _tokens(name) if t)
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{quoted}", tokens, True)


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text).split()


SITE_RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)
#: The method's rules for URLs that no site rule fits: if any blocks, the verdict is block, else allow.
PATTERN_RULES = (
    Rule("adult-host", "block", r"^(?:[^/]*[.-])?adult[.-]", ("adult",), False),
    Rule("casino-host", "block", r"^(?:[^/]*[.-])?casino[.-]", ("casino",), False),
    Rule("porn-host", "block", r"^(?:[^/]*[.-])?porn[.-]", ("porn",), False),
    Rule("xxx-host", "block", r"^(?=[^/]*+/)(?:[^/]*[.-])?xxx[./-]", ("xxx",), False),
    Rule("phishing-host", "block", r"^(?:[^/]*[.-])?phishing[.-]", ("phishing",), False),
    Rule("gambling-host", "block", r"^(?:[^/]*[.-])?gambling[.-]", ("gambling",), False),
    Rule("download-exe", "block", r"(?s)^(?>.*/download/).*[^/]\.exe\z", ("download", "exe"), False),
    Rule("ad-server", "block", r"^(?=[^/]*+/banners/)(?:[^/]*\.)?ads\.", ("ads", "banners"), False),
)

RULE_SCHEMA = "rule string, rule_verdict string, pattern string, tokens array<string>, site boolean"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). No ``://`` or null: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Literal rules as rows of ``RULE_SCHEMA``, made by the JVM."""
    fields = ", ".join(c.replace(" ", ": ", 1) for c in RULE_SCHEMA.split(", "))
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("rule_verdict"), F.lit(r.pattern).alias("pattern"),
            F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"), F.lit(r.site).alias("site"),
        )
        for r in rules
    ]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*rows).cast(f"array<struct<{fields}>>")).alias("r")).select("r.*")


def judge(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule for each row of ``pages`` (page_id, url).

    ``rules``: a table of ``RULE_SCHEMA`` or literal rules; rules with a null or no token are left out.
    Null ids, null or empty URLs and repeated rows are kept, a row each; a URL that no rule fits is
    allowed. URLs may be of any length. An empty table gives an empty result; without rules all are allowed.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    targets = parts.select("target").distinct()
    tokens = targets.select("target", F.explode(F.array_distinct(F.split("target", BREAKS))).alias("token"))
    index = rule_index(rules, parts.select(F.explode(F.array_distinct(F.split("target", BREAKS))).alias("token")))
    candidates = join_side(tokens, index, ["token"])
    fits = candidates.where(F.expr("target rlike pattern"))
    site = F.max(F.when(F.col("site"), F.struct(F.length("rule").alias("size"), "rule", "rule_verdict")))
    blocked = F.min(F.when(~F.col("site") & (F.col("rule_verdict") == "block"), F.col("rule")))
    found = fits.groupBy("target").agg(site.alias("s"), blocked.alias("pattern_rule"))
    found = found.select(F.col("target").alias("__target"), "s", "pattern_rule")
    verdict = (
        F.when(F.col("s").isNotNull(), F.col("s.rule_verdict")).when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    )
    return parts.join(found, F.col("target") == F.col("__target"), "left").select(
        "page_id", "host", "path", F.col("s.rule").alias("rule"), verdict.alias("verdict"), "pattern_rule"
    )


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, rule, rule_verdict, pattern, site): each rule under that of its tokens which ``tokens`` holds least often."""
    listed = rules.withColumn("token", F.explode("tokens")).drop("tokens").where("token is not null")
    known = listed.select("token").distinct().withColumn("__known", F.lit(True))
    counts = join_side(tokens, known, ["token"]).groupBy("token").agg(F.count("*").alias("n"))
    ranked = join_side(listed, counts, ["token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_rule = ranked.groupBy("rule", "rule_verdict", "pattern", "site").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return materialize(by_rule.select("token", "rule", "rule_verdict", "pattern", "site"), "url-rules")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN regexp_matches(host || path, '(?s)/download/.*[^/][.]exe$') THEN 'download-exe' END AS p1,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.])?ads[.][^/]*/banners/') THEN 'ad-server' END AS p2,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?adult[.-]') THEN 'adult-host' END AS p3,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?casino[.-]') THEN 'casino-host' END AS p4,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?phishing[.-]') THEN 'phishing-host' END AS p5,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?porn[.-]') THEN 'porn-host' END AS p6,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?xxx([.-][^/]*)?/') THEN 'xxx-host' END AS p7,
    CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?gambling[.-]') THEN 'gambling-host' END AS p8
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN coalesce(p1, p2, p3, p4, p5, p6, p7, p8) IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  least(p1, p2, p3, p4, p5, p6, p7, p8) AS pattern_rule
FROM judged
"""

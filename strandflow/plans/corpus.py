"""Queries on documents, pages, conversations, embeddings and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandflow.functions.histograms import context_counts
from strandflow.operators import cost, layout, lookup, sequence
from strandflow.registry import query
from strandflow.session import table

SEQ_RESIDUAL = """
SELECT conv_id, turn, turn - coalesce(lag(turn) OVER w, 0) - 1 AS residual, coalesce(turn = lag(turn) OVER w + 1, false) AS follows,
  turn - 2 * coalesce(lag(turn) OVER w, 0) + coalesce(lag(turn, 2) OVER w, 0) AS d2
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""


@query("seq_residual", "WIN02 WIN03 MDL28 WIN21", SEQ_RESIDUAL)
def seq_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers as residuals of the number before."""
    w = sequence.ordered(["conv_id"], ["turn"])
    t, prev = F.col("turn"), F.lag("turn").over(w)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        (sequence.delta(t, w) - 1).alias("residual"),
        F.coalesce(t == prev + 1, F.lit(False)).alias("follows"),
        sequence.delta(t, w, 2).alias("d2"),
    )


LACE = """
WITH s AS (SELECT doc_id, n_chars, unnest(generate_series(0, n_chars // 255)) AS seg FROM documents)
SELECT doc_id, n_chars, count(*) AS segments, sum(CASE WHEN seg = n_chars // 255 THEN n_chars % 255 ELSE 255 END)::BIGINT AS total,
  count(*) FILTER (WHERE seg < n_chars // 255) AS whole FROM s GROUP BY doc_id, n_chars
"""


@query("lace_packets", "WIN05 SNK05 SNK06", LACE)
def lace_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets cut into lacing segments, and put together again from them."""
    cut = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.posexplode(layout.lacing(F.col("n_chars"))).alias("seg", "size"))
    return cut.groupBy("doc_id", "n_chars").agg(
        F.count("*").alias("segments"), F.sum("size").alias("total"), F.count_if(F.col("size") == 255).alias("whole")
    )


CHUNKS = """
WITH c AS (SELECT doc_id, source, n_chars, unnest(range(0, n_chars, 1024)) AS off FROM documents)
SELECT doc_id, source, (off // 1024)::INTEGER AS chunk_no, off, least(1024, n_chars - off) AS len FROM c
"""


@query("chunk_layout", "SNK01 SNK02 AGG18 SRC33", CHUNKS)
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1024 characters of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return layout.chunks(docs, F.col("n_chars"), 1024).select("doc_id", "source", F.col("chunk_no"), "off", "len")


DEDUP = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars, md5(text)) AS first_doc,
  doc_id = min(doc_id) OVER (PARTITION BY n_chars, md5(text)) AS is_rep FROM documents
"""


@query("dedup_exact", "JON01 SNK07", DEDUP)
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of the same content. Only hashes are shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("content"))
    out = lookup.first_equal(docs, [F.col("n_chars"), F.col("content")], "doc_id")
    return out.select("doc_id", F.col("first_id").alias("first_doc"), (F.col("doc_id") == F.col("first_id")).alias("is_rep"))


DEDUP_HEADER = """
WITH e AS (SELECT doc_id, substr(text, 1, 64) AS head, min(doc_id) OVER (PARTITION BY n_chars, md5(text)) AS first_doc FROM documents),
k AS (SELECT doc_id, head FROM e WHERE doc_id = first_doc)
SELECT doc_id, min(doc_id) OVER (PARTITION BY head) AS first_head FROM k
"""


@query("dedup_header", "JON02 FLT03", DEDUP_HEADER)
def dedup_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among documents that aren't copies, the first with the same opening."""
    head = F.xxhash64(F.substring("text", 1, 64))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("content"), head.alias("head"))
    firsts = docs.groupBy("n_chars", "content").agg(F.min_by(F.struct("doc_id", "head"), "doc_id").alias("d")).select("d.doc_id", "d.head")
    return lookup.first_equal(firsts, [F.col("head")], "doc_id").select("doc_id", F.col("first_id").alias("first_head"))


MULTIPLICITY = """
SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS kinds, count(*) - count(DISTINCT md5(text)) AS surplus FROM documents GROUP BY source
"""


@query("dup_multiplicity", "FLT04 SET06", MULTIPLICITY)
def dup_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against distinct texts by source; copies fold before the second grouping, so a hot source spreads."""
    kinds = table(spark, sf_dir, "documents").groupBy("source", F.md5("text").alias("content")).agg(F.count("*").alias("n"))
    return kinds.groupBy("source").agg(F.sum("n").alias("n"), F.count("content").alias("kinds")).select(
        "source", "n", "kinds", (F.col("n") - F.col("kinds")).alias("surplus")
    )


PREFIXES = ["http://", "https://", "https://m.", "http://m.", "https://www.", "http://blog.", "https://blog.thth"]
DICT_PREFIX = (
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PREFIXES) + ") t(prefix)), "
    "j AS (SELECT page_id, max_by(prefix, length(prefix)) AS prefix FROM pages JOIN p ON starts_with(url, prefix) GROUP BY page_id) "
    "SELECT pages.page_id, prefix, CASE WHEN starts_with(url, 'https://m.') OR starts_with(url, 'http://m.') THEN 'mobile' "
    "WHEN starts_with(url, 'https://www.') OR starts_with(url, 'http://www.') THEN 'www' ELSE 'other' END AS vendor "
    "FROM pages LEFT JOIN j USING (page_id)"
)


@query("dict_prefix", "JON06 FN20 FN22", DICT_PREFIX)
def dict_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest dictionary prefix of each URL, and its vendor class."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    words = lookup.dictionary(spark, [(p,) for p in PREFIXES], "prefix string")
    found = lookup.longest_prefix(pages, "url", words, ["page_id"])
    vendor = (
        F.when(F.col("url").rlike("^https?://m[.]"), "mobile").when(F.col("url").rlike("^https?://www[.]"), "www").otherwise("other")
    )
    return found.select("page_id", "prefix", vendor.alias("vendor"))


NEAREST = """
WITH v AS (SELECT vec_id, label, embedding FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS near_id,
    list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS dist
  FROM v a JOIN v b ON a.label = b.label AND b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - 63)
SELECT vec_id, min_by(near_id, dist) AS near_id, round(min(dist), 4) AS dist FROM d GROUP BY vec_id
"""


@query("nearest_l1", "", NEAREST)
def nearest_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by L1 of the same label's vectors among the 63 ids before; the pool of books, which outlives a window, is ``book_pool``."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    block = F.floor(F.col("vec_id") / 64)
    left = v.withColumn("block", block)
    right = v.select(F.col("vec_id").alias("near_id"), "label", F.col("embedding").alias("other"), F.explode(F.array(block, block + 1)).alias("block"))
    near = (F.col("near_id") < F.col("vec_id")) & (F.col("near_id") >= F.col("vec_id") - 63)
    met = left.join(right, ["label", "block"]).where(near).withColumn("dist", lookup.l1(F.col("embedding"), F.col("other")))
    return met.groupBy("vec_id").agg(F.min_by("near_id", "dist").alias("near_id"), F.round(F.min("dist"), 4).alias("dist"))


ENTROPY = """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents),
n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY doc_id, ch),
t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM n)
SELECT doc_id, max(total)::BIGINT AS chars, count(*) AS symbols, round(sum(-n / total * log2(n / total)), 6) AS bits,
  sum(-n / total * log2(n / total)) >= 8 * 2022 / 2048 AND max(total) >= 4096 AS incompressible FROM t GROUP BY doc_id
"""


@query("byte_entropy", "AGG02 FLT05", ENTROPY)
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-0 entropy of each text's characters. A text's own characters are counted in its task."""
    n = cost.characters(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")
    # sum n, then sum n log n: the entropy needs no second pass over the counts
    x = n.groupBy("doc_id").agg(
        F.sum("n").alias("chars"), F.count("*").alias("symbols"), F.sum(F.col("n") * F.log2("n")).alias("nlogn")
    )
    bits = F.log2("chars") - F.col("nlogn") / F.col("chars")
    bits = F.when(bits < 0, 0.0).otherwise(bits)
    big = (bits >= 8 * 2022 / 2048) & (F.col("chars") >= 4096)
    return x.select("doc_id", "chars", "symbols", (F.round(bits, 6) + 0.0).alias("bits"), big.alias("incompressible"))


BASE64 = """
SELECT item_id, base64(encode(text)) AS b64, text = decode(from_base64(base64(encode(text)))) AS canonical, length(base64(encode(text))) % 4 = 0 AS quads FROM benchmark
"""


@query("base64_rt", "FN19 FLT10", BASE64)
def base64_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 and back, and whether it is canonical."""
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        b64.alias("b64"),
        (F.decode(F.unbase64(b64), "UTF-8") == F.col("text")).alias("canonical"),
        (F.length(b64) % 4 == 0).alias("quads"),
    )


SCHEDULE = """
WITH j AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place,
    sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents)
SELECT doc_id, place, (coalesce(before, 0) // 100000)::BIGINT AS wave FROM j
"""


@query("job_schedule", "SRT01 EXE01 EXE02", SCHEDULE)
def job_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs, largest first, in waves by the work before them: sizes are summed first, then jobs of a size ranked.

    Ranks come from counts of ranges of ids within a size, so that a common size spreads over tasks. Jobs
    of unknown size come last, without a wave.
    """
    jobs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("block", F.floor(F.col("doc_id") / 4096))
    counts = jobs.groupBy("n_chars", "block").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("n_chars").agg(F.sum("n").alias("n"))
    larger = W.orderBy(F.desc_nulls_last("n_chars")).rowsBetween(W.unboundedPreceding, -1)  # a row for each size
    ahead = sizes.select(
        F.col("n_chars").alias("size"),
        F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("jobs_ahead"),
        F.coalesce(F.sum(F.col("n") * F.col("n_chars")).over(larger), F.lit(0)).alias("work_ahead"),
    )
    earlier = W.partitionBy("n_chars").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.select(F.col("n_chars").alias("size"), F.col("block").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("same_ahead"))
    blocks = blocks.alias("b").join(ahead.alias("a"), F.col("b.size").eqNullSafe(F.col("a.size"))).select("b.*", "jobs_ahead", "work_ahead")
    inside = F.row_number().over(W.partitionBy("n_chars", "block").orderBy("doc_id"))
    placed = jobs.withColumn("inside", inside).join(blocks, F.col("n_chars").eqNullSafe(F.col("size")) & F.col("block").eqNullSafe(F.col("of")))
    rank = F.col("same_ahead") + F.col("inside")
    before = F.col("work_ahead") + (rank - 1) * F.col("n_chars")
    return placed.select("doc_id", (F.col("jobs_ahead") + rank).alias("place"), F.floor(before / 100000).alias("wave"))


STATUS = """
WITH s AS (SELECT source, CASE WHEN n_chars = 0 THEN 4 WHEN n_chars > 20000 THEN 3 WHEN n_chars > 10000 THEN 2 WHEN n_chars < 20 THEN 1 ELSE 0 END AS status FROM documents)
SELECT source, count(*) AS jobs, max(status)::INTEGER AS status, count(*) FILTER (WHERE status <> 0) AS failed FROM s GROUP BY ROLLUP (source)
"""


@query("batch_status", "AGG17 EXE05 SRT08 FLT12", STATUS)
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit status of a batch: the greatest of its jobs, by source and in all."""
    n = F.col("n_chars")
    status = F.when(n == 0, 4).when(n > 20000, 3).when(n > 10000, 2).when(n < 20, 1).otherwise(0)
    rows = table(spark, sf_dir, "documents").select("source", status.alias("status"))
    return rows.rollup("source").agg(
        F.count("*").alias("jobs"), F.max("status").alias("status"), F.count_if(F.col("status") != 0).alias("failed")
    )


KRAFT = """
WITH c AS (SELECT source, unnest(string_split(text, '')) AS ch FROM documents),
n AS (SELECT source, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY source, ch),
l AS (SELECT source, ceil(-log2(n / sum(n) OVER (PARTITION BY source))) AS len FROM n)
SELECT source, count(*) AS symbols, max(len)::BIGINT AS longest, round(sum(pow(2, -len)), 9) AS kraft, sum(pow(2, -len)) <= 1 AS decodable FROM l GROUP BY source
"""


@query("kraft_check", "FLT15 AGG21 JON16", KRAFT)
def kraft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of each source's characters, and whether they make a prefix code."""
    n = cost.characters(table(spark, sf_dir, "documents").select("source", "text"), ["source"], "text")
    total = F.sum("n").over(W.partitionBy("source"))  # rows are distinct characters
    lengths = n.select("source", F.ceil(-F.log2(F.col("n") / total)).alias("len"))
    mass = F.sum(F.pow(F.lit(2.0), -F.col("len")))
    return lengths.groupBy("source").agg(
        F.count("*").alias("symbols"), F.max("len").alias("longest"), F.round(mass, 9).alias("kraft"), (mass <= 1).alias("decodable")
    )


COUNT_MODEL = """
WITH l AS (SELECT doc_id, list_filter(string_split(text, ''), lambda c: c <> '') AS chars FROM documents),
c AS (SELECT doc_id, unnest(list_zip(range(1, len(chars) + 1), chars, [NULL::VARCHAR] || chars)) AS x FROM l),
p AS (SELECT doc_id, x[1] AS i, x[2] AS ch, CASE WHEN x[3] IS NULL THEN 0 WHEN regexp_matches(x[3], '[a-z]') THEN 1
    WHEN regexp_matches(x[3], '[A-Z0-9]') THEN 2 ELSE 3 END AS class FROM c WHERE x[2] IS NOT NULL),
n AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, class, ch ORDER BY i) - 1 AS seen, count(*) OVER (PARTITION BY doc_id, class ORDER BY i) - 1 AS total FROM p)
SELECT doc_id, count(*) AS chars, round(sum(-log2((1 + seen) / (256 + total))), 4) AS bits FROM n GROUP BY doc_id
"""


@query("count_model_cost", "MDL06 MDL28 MDL04 WIN09 WIN10", COUNT_MODEL)
def count_model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each text by an adaptive count of characters in the context of the class before.

    With add-one counts the order of a context's characters doesn't matter: a character met n times costs
    the product 1 * 2 * .. * n, over the product of the totals. So the cost needs counts alone: nothing is
    sorted, and a text's pairs are counted in its task.
    """
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.explode(context_counts("text")).alias("x"))
    counts = pairs.groupBy("doc_id", F.col("x.class").alias("class"), F.col("x.ch").alias("ch")).agg(F.sum("x.n").alias("n"))
    contexts = counts.groupBy("doc_id", "class").agg(F.sum("n").alias("n"), F.sum(cost.log2_factorial(F.col("n"))).alias("saved"))
    bits = cost.log2_factorial(F.col("n") + 255) - cost.log2_factorial(F.lit(255)) - F.col("saved")
    return contexts.groupBy("doc_id").agg(F.sum("n").alias("chars"), F.round(F.sum(bits), 4).alias("bits"))

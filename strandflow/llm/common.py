"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a side table up to which it is broadcast; beyond, the join is shuffled and AQE splits hot keys.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 16 << 20
#: Rows in an Arrow batch: whole texts can be long.
ARROW_ROWS = 1024

SPAN = "array<struct<start:int,kind:int,end:int>>"
WORD_SPAN = "array<struct<start:int,kind:int,end:int,word:string>>"
#: Items of an array that are folded into one block of its result.
FOLD_BLOCK = 256
#: Characters in a chunk of a text that is cut in many places.
CHUNK = 1024

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in df.columns))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def join_side(big: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a side table, by broadcast only if a count of its rows and of its strings' bytes finds it small; keys compare null-safely."""
    held = [F.coalesce(F.sum(F.octet_length(quoted(c))), F.lit(0)) for c, kind in side.dtypes if kind in ("string", "binary")]
    rows, *held = side.limit(BROADCAST_ROWS + 1).agg(F.count("*"), *held).first()
    small = rows <= BROADCAST_ROWS and sum(held) <= BROADCAST_BYTES
    keyed = side.select(*(F.col(c).alias(f"__side_{c}") for c in on), *(c for c in side.columns if c not in on))
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__side_{c}"))
        condition = same if condition is None else condition & same
    joined = big.join(F.broadcast(keyed) if small else keyed, condition, how)
    return joined.drop(*(f"__side_{c}" for c in on))


def folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` emits over an array, in order: it takes the state and an item, and gives the state and an array to add.

    Arrays grow in blocks of ``FOLD_BLOCK`` items, which are put together at the end, so that what is copied
    on the way stays short however many items there are. ``kind``: type of the array.
    """
    empty = F.array().cast(kind)

    def inner(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], out).alias("out"))

    def run(bound: Column) -> Column:
        last = F.floor((F.size(bound) - 1) / FOLD_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(bound, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))

        def outer(acc: Column, block: Column) -> Column:
            done = F.aggregate(block, F.struct(acc["state"].alias("state"), empty.alias("out")), inner)
            # bound to a name, so that a block is folded once
            return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(bound) > 0, F.aggregate(blocks, begin, outer, lambda acc: F.flatten(acc["out"]))).otherwise(empty)

    # bound to a name, so that the items are made once
    return F.transform(F.array(items), run)[0]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, within lambdas too."""
    return F.transform(F.array(value), use)[0]


def chunks_of(text: Column) -> Column:
    """The text in chunks of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end`` of a text in chunks, without reading it from its beginning."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * CHUNK + 1, end - start)).otherwise("")


def located(text: Column, pattern: str, group: int, least: int, kind: int, words: bool = False) -> Column:
    """Spans of all leftmost matches; start and end count code points. ``group`` must have ``least`` characters.

    With ``words`` each span has its ``word`` too: a substring by place would read the text from its start
    each time.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    sized = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind_of = WORD_SPAN if words else SPAN

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *[x["whole"].alias("word")] * words)
        return end, F.when(F.length(x["sized"]) >= least, F.array(span)).otherwise(F.array().cast(kind_of))

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), sized.alias("sized"))
    return folded(rows, F.lit(0), step, kind_of)

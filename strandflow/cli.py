"""``python -m strandflow.cli e|d [-1 .. -20] [-b] [-j N] IN... [OUT]``: encode or decode files.

One file: IN and OUT. With ``-b`` many, each to IN.sfr, or from it; files run side by side as Spark tasks,
and the exit status is the greatest of theirs.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from strandflow import codec

SUFFIX = ".sfr"


def parse(argv: list[str]) -> argparse.Namespace:
    levels = [a for a in argv if re.fullmatch(r"-[0-9]+", a)]
    parser = argparse.ArgumentParser(prog="strandflow", description=__doc__)
    parser.add_argument("verb", choices=["e", "d"])
    parser.add_argument("-b", "--batch", action="store_true")
    parser.add_argument("-j", "--jobs", type=int, default=None)
    parser.add_argument("files", nargs="+")
    args = parser.parse_args([a for a in argv if a not in levels])
    args.level = int(levels[-1][1:]) if levels else codec.DEFAULT_LEVEL
    if args.level not in codec.LEVELS:
        parser.error(f"no level {args.level}")
    if not args.batch and len(args.files) != 2:
        parser.error("an input and an output are needed")
    return args


def put(path: str, data: bytes) -> None:
    """Write under another name first, so that a failure leaves nothing."""
    temporary = f"{path}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


def one(verb: str, source: str, target: str, level: int) -> tuple[int, str]:
    try:
        if os.path.exists(target) and os.path.samefile(source, target):
            return codec.USAGE, "input and output are the same file"
        with open(source, "rb") as f:
            data = f.read()
    except OSError as e:
        return codec.INPUT, f"{source}: {e.strerror}"
    try:
        out = codec.encode(data, level) if verb == "e" else codec.decode(data)
    except codec.CodecError as e:
        return codec.DAMAGED, f"{source}: {e}"
    try:
        put(target, out)
    except OSError as e:
        return codec.SYSTEM, f"{target}: {e.strerror}"
    return codec.DONE, ""


def target_of(verb: str, source: str) -> str:
    return source + SUFFIX if verb == "e" else source.removesuffix(SUFFIX) if source.endswith(SUFFIX) else source + ".out"


def jobs_for(sizes: list[int], cores: int, memory: int, fixed: int = 72 << 20) -> int:
    """Files at once: as many as cores, and as memory holds of the fixed part and three times the largest."""
    largest = max(sizes, default=0)
    return max(1, min(cores, len(sizes), memory // (fixed + 3 * largest)))


def batch(verb: str, sources: list[str], level: int, jobs: int | None) -> int:
    from strandflow.session import build_session, ship

    sizes = {s: os.path.getsize(s) if os.path.exists(s) else 0 for s in sources}
    order = sorted(sources, key=lambda s: (-sizes[s], sources.index(s)))
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    n = jobs or jobs_for(list(sizes.values()), os.cpu_count() or 1, memory)
    spark = build_session(cores=str(n))
    ship(spark)
    rows = spark.createDataFrame([(s,) for s in order], "source string").repartition(len(order))

    def run(it):
        for pdf in it:
            out = [(s, *one(verb, s, target_of(verb, s), level)) for s in pdf["source"]]
            yield pdf.assign(status=[o[1] for o in out], message=[o[2] for o in out])

    worst = codec.DONE
    for r in rows.mapInPandas(run, "source string, status int, message string").collect():
        if r.status:
            print(r.message, file=sys.stderr)
        worst = max(worst, r.status if 0 <= r.status <= codec.SYSTEM else codec.SYSTEM)
    return worst


def main(argv: list[str] | None = None) -> int:
    try:
        args = parse(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return codec.USAGE if e.code else codec.DONE
    if args.batch:
        return batch(args.verb, args.files, args.level, args.jobs)
    status, message = one(args.verb, *args.files, args.level)
    if status:
        print(message, file=sys.stderr)
    return status


if __name__ == "__main__":
    sys.exit(main())

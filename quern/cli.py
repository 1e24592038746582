"""A command line over one home: index, reindex, search, dupes, tag, labels."""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions.text import age, human_size, tilde
from quern.operators.tags import parent_of
from quern.plans.lang import DEFAULT_DISTANCE, ParseError
from quern.sources.files import rules_file


def shown(hits: DataFrame, home: str, now: int) -> DataFrame:
    """(text) of hits, one a row, as they are printed: kind, name, folder, age, size and tags, and the line."""
    folder = tilde(parent_of(F.col("path")), home)
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), " ")
    details = F.concat_ws(" · ", age(F.lit(now) - F.col("mtime")), F.when(F.col("size").isNotNull(), human_size(F.col("size"))), F.when(tags != "", tags))
    first = F.concat(F.rpad("kind", 8, " "), "name", F.lit("  "), folder, F.lit("  ·  "), details)
    return hits.select(F.concat_ws("\n        ", first, "line").alias("text"))


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quern", description="Find files by words and filters.")
    out.add_argument("--home", default=os.path.expanduser("~"))
    verbs = out.add_subparsers(dest="verb", required=True)
    verbs.add_parser("index", help="scan the home")
    again = verbs.add_parser("reindex", help="read files or folders anew")
    again.add_argument("paths", nargs="+")
    find = verbs.add_parser("search", aliases=["s"], help="words and filters, like kind:pdf or modified:30d")
    find.add_argument("query", nargs="+")
    dupes = verbs.add_parser("dupes", help="files that are copies, or look or are named like it")
    for kind in ("same", "looks", "names"):
        dupes.add_argument(f"--{kind}", action="store_true")
    dupes.add_argument("--distance", type=int, default=DEFAULT_DISTANCE)
    dupes.add_argument("filters", nargs="*")
    tag = verbs.add_parser("tag", help="list a file's tags, or +tag and -tag")
    tag.add_argument("path")
    tag.add_argument("changes", nargs=argparse.REMAINDER)
    return out


def wanted_dupes(args) -> str:
    """The filter that the command's switches stand for."""
    kinds = [k for k in ("same", "names") if getattr(args, k)] + ([f"looks<{args.distance}"] if args.looks else [])
    return "dupes:" + ",".join(kinds or ["same", "names", f"looks<{args.distance}"])


def run(argv: list[str], engine: Engine, say: Callable[[str], None] = print, now: int | None = None) -> int:
    """Do what the arguments say with an engine; returns the exit code."""
    args, now = arguments().parse_args(argv), int(time.time()) if now is None else now
    try:
        if args.verb in ("index", "reindex"):
            for path in getattr(args, "paths", []):
                engine.forget(os.path.abspath(path))
            told = engine.scan(args.home, rules_file(f"{args.home}/.config/quern/ignore"))
            say(", ".join(f"{n} {what}" for what, n in told.items()))
        elif args.verb in ("search", "s"):
            rows = [r["text"] for r in shown(engine.search(" ".join(args.query), now), engine.home, now).toLocalIterator()]
            say("\n".join(rows) if rows else "Nothing found.")
        elif args.verb == "dupes":
            query = " ".join([wanted_dupes(args), *args.filters])
            rows = list(engine.search(query, now).toLocalIterator())
            for r in rows:
                say(f"{'' if ' · ' in r['caption'] else '    '}{r['caption']}  {r['path']}")
            spare = engine.duplicates(query, now).agg(F.sum("wasted").alias("n"), F.count("*").alias("groups"))
            row = spare.select("groups", human_size(F.coalesce("n", F.lit(0))).alias("spare")).first()
            say(f"{row['groups']} groups, {row['spare']} spare")
        else:
            path = os.path.abspath(args.path)
            for change in args.changes:
                if change[:1] not in "+-" or len(change) < 2:
                    raise ValueError(f"{change!r} is no change: use +tag or -tag")
                engine.tag(path, change[1:], change[0] == "+")
            say(" ".join(f"#{t}" for t in engine.tags(path)) or "No tags.")
    except (ParseError, ValueError) as e:
        say(str(e))
        return 2
    return 0


def main() -> int:
    import sys

    spark = SparkSession.builder.appName("quern").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    home = arguments().parse_args().home
    if sys.argv[1:2] != ["index"]:
        engine.scan(home, rules_file(f"{home}/.config/quern/ignore"))
    return run(sys.argv[1:], engine)


if __name__ == "__main__":
    raise SystemExit(main())

"""Quality rules in DataFrame functions: counts of each text, and cross-document line frequency.

Lines are normalised and hashed, and for each host the documents that hold a line are counted. A line
that more than the host's limit of documents hold is boilerplate; it is removed, and a document that has
too little left is rejected.

Copies, exact or near, are one document in that count, or a group of copies would make boilerplate of its
own text. Each document has signatures: of a sample of its 5-word windows that the text itself chooses,
the least by some fixed orders, three orders a signature. A document that shares one with an earlier
document of its host is counted with that one. Documents that share nine tenths of their windows share
a signature nearly always, those that share half of them in about half of all cases.

Pages that are little but a menu are near copies by that measure. They differ from copies in where they
differ: whole lines around the same block. So a line that the limit of documents hold, copies and all, is
boilerplate too if its block stands in changing company: lines that most documents hold next to each other
are one block, and neither the line before a block nor the one after it is the same in most documents.

Texts are read once; all else works on a table of numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import components

from .common import WORD, Scratch, spaced

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A window is sampled if its first word's length is a multiple of this.
SAMPLED = 6
BANDS, ORDERS = 6, 3
#: Numbers that a window's hash is compared with in each order, 60 bits as the hashes.
POINTS = [[int(x) for x in row] for row in np.random.default_rng(4).integers(0, 1 << 60, (BANDS, ORDERS))]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _normal(line: Column) -> Column:
    """Lower case, digits alike, no white space at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), r"[\x09\x0B-\x0D]", " "))


def _hash(text: Column) -> Column:
    """60 bits of a text, which SQL elsewhere has as well."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_counts(df: DataFrame, text: str, signatures: bool = False) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of its whole texts, and
    ``_signatures`` if asked for.

    Stages are separate projections, each reading arrays that the one below has made. Their names begin
    with ``_q_``, as no input's should. Write the result before filtering by it, as ``judged`` does: a
    condition would be moved below the arrays and make them anew for each of their elements.
    """
    own = spaced(F.col(text))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    out = df.withColumns({"_q_words": F.array_remove(F.split(own, " "), ""), "_q_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.coalesce(F.size("_q_words").cast("long"), F.lit(0).cast("long")),
            "word_chars": F.coalesce(F.length(F.array_join("_q_words", "")).cast("long"), F.lit(0).cast("long")),
            "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit(f"[{SYMBOLS}]")).cast("long"), F.lit(0).cast("long")),
            "n_dup_lines": F.coalesce((F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"), F.lit(0).cast("long")),
            "_q_hashes": F.transform("_q_words", lambda x: F.xxhash64(x)),
        }
    )
    word = lambda i, k: F.get(F.expr("_q_hashes"), i + k)
    starts = F.slice("_q_hashes", 1, F.greatest(F.size("_q_hashes") - 4, F.lit(0)))
    out = out.withColumn("_q_windows", F.transform(starts, lambda x, i: F.xxhash64(x, *(word(i, k) for k in range(1, 5)))))
    # Few texts repeat a window; only theirs are looked at further, hashes with places in order, so that
    # equal windows stand side by side.
    repeats = F.size("_q_windows") != F.size(F.array_distinct("_q_windows"))
    out = out.withColumn("_q_sorted", F.when(repeats, F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get(F.expr("_q_sorted"), i - 1)["h"] == x["h"]) | (F.get(F.expr("_q_sorted"), i + 1)["h"] == x["h"])
    out = out.withColumn("_q_places", F.sort_array(F.transform(F.filter("_q_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    # Each repeated window covers 5 words, less what the next one covers too.
    covered = F.aggregate("_q_places", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"].cast("long"))
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    if signatures:
        places = F.sequence(F.lit(1), F.size("_q_words") - 4)
        chosen = F.filter(places, lambda i: F.length(F.get(F.expr("_q_words"), i - 1)) % SAMPLED == 0)
        out = out.withColumn("_q_at", F.when(F.size("_q_words") >= 5, F.when(F.size(chosen) > 0, chosen).otherwise(places)))
        windows = F.transform("_q_at", lambda i: _hash(F.array_join(F.slice(F.expr("_q_words"), i, 5), " ")))
        whole = F.array(_hash(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        out = out.withColumn("_q_sample", F.coalesce(windows, whole))
        bands = [F.xxhash64(*(F.array_min(F.transform("_q_sample", _towards(p))) for p in points)) for points in POINTS]
        out = out.withColumn("_signatures", F.array(*bands))
    return out.drop("_q_words", "_q_lines", "_q_hashes", "_q_windows", "_q_sorted", "_q_places", "_q_at", "_q_sample")


def _towards(point: int):
    """An order of hashes: by their difference, bit by bit, from a point."""
    return lambda x: x.bitwiseXOR(F.lit(point))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is broadcast while it has at most so many rows, of a few numbers each."""
    return F.broadcast(df) if df.count() <= rows else df


def boilerplate(told: DataFrame, scratch: Scratch, min_docs: int, share: float, broadcast_rows: int) -> DataFrame:
    """(_host, line), written: boilerplate lines of ``told`` (_host, _text, _signatures, _lines). The limit is
    ``min_docs`` documents, or ``share`` of the host's distinct texts where that is more.

    Counts are summed on each side of the shuffle first, so a line that a third of all documents share
    reaches a task as one row a partition.
    """
    bucket = told.select("_host", "_text", F.posexplode("_signatures").alias("band", "signature"))
    # A document is counted if it is the first in all of its buckets.
    firsts = bucket.groupBy("_host", "band", "signature").agg(F.min("_text").alias("_text"))
    counted = scratch.table(firsts.groupBy("_host", "_text").agg(F.count("*").alias("n")).where(F.col("n") == BANDS).select("_host", "_text"))
    texts = told.select("_host", "_text").distinct().groupBy("_host").agg(F.count("*").alias("n"))
    limits = texts.select("_host", F.greatest(F.lit(min_docs), F.ceil(F.col("n") * share)).alias("limit"))
    lines = told.select("_host", "_text", F.posexplode("_lines").alias("i", "l")).select("_host", "_text", "i", "l.line", "l.before", "l.after")
    # Only lines in so many rows can be in so many documents.
    often = scratch.table(lines.groupBy("_host", "line").count().where(F.col("count") >= min_docs).select("_host", "line"))
    held = lines.join(_small(often, broadcast_rows), ["_host", "line"])
    # A line counts once a document however often it stands there, with its first company.
    once = held.groupBy("_host", "line", "_text").agg(F.min(F.struct("i", "before", "after")).alias("l"))
    once = scratch.table(once.select("_host", "line", "_text", "l.before", "l.after"))
    total = once.join(_small(counted, broadcast_rows), ["_host", "_text"], "left_semi").groupBy("_host", "line").agg(F.count("*").alias("different"))
    for side in ("before", "after"):
        by = once.groupBy("_host", "line", side).agg(F.count("*").alias("n")).groupBy("_host", "line")
        by = by.agg(F.sum("n").alias("docs"), F.max(F.struct("n", side)).alias("most"))
        mate = F.when(2 * F.col("most.n") > F.col("docs"), F.col(f"most.{side}")).alias(side)
        by = by.select("_host", "line", *(["docs"] if side == "before" else []), mate)
        total = by.join(total, ["_host", "line"], "left")
    total = total.join(limits, "_host").where("docs >= limit")
    node = lambda line: F.xxhash64("_host", line)
    changing = F.col("before").isNull() | F.col("after").isNull()
    total = scratch.table(total.select("_host", "line", node("line").alias("node"), (F.coalesce("different", F.lit(0)) >= F.col("limit")).alias("above"), changing.alias("changing"), *(F.when(F.col(x).isNotNull(), node(x)).alias(x) for x in ("before", "after"))))
    ahead = total.where("after is not null").select(F.col("node").alias("a"), F.col("after").alias("b"))
    links = ahead.join(total.where("before is not null").select(F.col("before").alias("a"), F.col("node").alias("b")), ["a", "b"])
    blocks = total.join(components(links, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
    loose = blocks.groupBy("component").agg(F.max("changing").alias("loose")).where("loose").select("component")
    found = blocks.join(loose, "component", "left_semi").unionByName(blocks.where("above"))
    return scratch.table(found.select("_host", "line").distinct())


def judged(df: DataFrame, doc_id: str, text: str, host: str, min_docs: int = 10, share: float = 0.001, left: float = 0.3, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, _k, _k2, counts, n_boilerplate_words, base_failed, kept) of every row; _k and _k2 name its
    id, host and text.

    base_failed: under 10 words, or over 20 % of them in repeated 5-word windows. kept is false if that
    holds, or if less than ``left`` of the words stay when the host's boilerplate lines go. A null text has
    no words and no lines; a null host is a host of its own. Rows with equal id, host and text get equal
    results; none is dropped. An empty table gives an empty one. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_body"), F.col(host).cast("string").alias("_source"))
    names = {"_k": F.xxhash64("doc_id", "_source", "_body"), "_k2": F.xxhash64(F.lit(7), "doc_id", "_source", "_body")}
    rows = rows.withColumns(names | {"_host": F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")), "_text": _hash(F.coalesce("_body", F.lit("")))})
    rows = rows.withColumn("_own", F.filter(F.transform(F.split("_body", "\n"), _normal), lambda x: x != ""))
    rows = rows.withColumn("_ids", F.transform("_own", lambda x: F.xxhash64(x)))
    mate = lambda x, i, by: F.coalesce(F.get(F.expr("_ids"), i + by), F.xxhash64(x, i))  # noqa: E731  (no line there: where it stands)
    words = lambda i: F.size(F.array_remove(F.split(F.get(F.expr("_own"), i), " "), ""))
    lines = F.transform("_ids", lambda x, i: F.struct(x.alias("line"), mate(x, i, -1).alias("before"), mate(x, i, 1).alias("after"), words(i).alias("words")))
    told = with_counts(rows.withColumn("_lines", lines), "_body", True)
    told = scratch.table(told.drop("_body", "_source", "_own", "_ids").withColumn("_row", F.monotonically_increasing_id()))
    frequent = boilerplate(told, scratch, min_docs, share, broadcast_rows)
    hit = told.select("_row", "_host", F.explode("_lines").alias("l")).select("_row", "_host", "l.line", "l.words")
    gone = hit.join(_small(frequent, broadcast_rows), ["_host", "line"]).groupBy("_row").agg(F.sum("words").alias("n_boilerplate_words"))
    gone = scratch.table(gone)
    out = told.select("doc_id", "_k", "_k2", "_row", *COUNTS).join(_small(gone, broadcast_rows), "_row", "left")
    out = out.withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0).cast("long"))).drop("_row")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_boilerplate_words")) < left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def good(df: DataFrame, doc_id: str, text: str, host: str, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The rows of ``df`` that ``judged`` keeps, as they are. Those that go are the smaller side of the join,
    and are broadcast while they are few. Other columns, whatever their names, are untouched."""
    scratch = Scratch(df.sparkSession)
    told = judged(df, doc_id, text, host, broadcast_rows=broadcast_rows, **options)
    goes = _small(scratch.table(told.where("not kept").select("_k", "_k2").distinct()), broadcast_rows).alias("goes")
    own = [F.col(f"rows.`{c}`") for c in (doc_id, host, text)]
    own[1], own[2] = own[1].cast("string"), own[2].cast("string")
    same = (F.xxhash64(*own) == F.col("goes._k")) & (F.xxhash64(F.lit(7), *own) == F.col("goes._k2"))
    return df.alias("rows").join(goes, same, "left_anti")

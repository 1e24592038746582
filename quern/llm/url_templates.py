"""URL filters: rules by host and path, and a path-template tree judged by labelled purity.

DataFrame functions only. Per host the tree grows a segment at a time, until no template can split. A
segment stays literal under its parent if it is neither a number nor in few rows; all others become a
wildcard. Literal branches of one parent whose rates of bad labels do not differ significantly merge
into one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules`` are part of the
    configuration: (host and path as one string, verdict); of equally long ones the first counts."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _joined(rows: DataFrame, side: DataFrame, on: list[str], broadcast_rows: int) -> DataFrame:
    """Left join; the side is broadcast while it has ``broadcast_rows`` at most, else shuffled."""
    small = side.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(side) if small else side, on, "left")


def templates(df: DataFrame, key: str, host: str, path: str, bad: str, scratch: Scratch, depth: int = 4, min_count: int = 20, z: float = 1.96, broadcast_rows: int = 100_000) -> DataFrame:
    """(key, _template, _bad) of every row. ``bad`` is 1, 0 or null (no label).

    A segment is literal where it has at least ``min_count`` rows, whatever its share. From ``depth``
    segments on, a template grows while it can split: while it has ``min_count`` rows that go on, and
    labels of both kinds among them. What is behind is one wildcard, ``**``.
    """
    segments = F.array_remove(F.split(F.col(path), "/"), "")
    rows = df.select(key, F.col(host).alias("_template"), segments.alias("_segments"), F.col(bad).cast("int").alias("_bad"))
    level, done = 0, []
    while True:
        if level >= depth:
            rows = scratch.table(rows)
            more = F.size("_segments") > level
            split = rows.where(more).groupBy("_template").agg(F.count("*").alias("n"), F.min("_bad").alias("least"), F.max("_bad").alias("most"))
            split = scratch.table(split.where((F.col("n") >= min_count) & (F.col("least") < F.col("most"))).select("_template", F.lit(True).alias("_grows")))
            rows = _joined(rows, split, ["_template"], broadcast_rows).withColumn("_grows", F.coalesce("_grows", F.lit(False)) & more)
            rest = F.when(more, "/**").otherwise("")
            done.append(rows.where("not _grows").select(key, F.concat("_template", rest).alias("_template"), "_bad"))
            if not split.limit(1).count():
                break
            rows = rows.where("_grows").drop("_grows")
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level)))
        counts = rows.where("_segment is not null").groupBy("_template", "_segment").agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.sum("_bad").alias("bads"))
        number = F.col("_segment").rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$|^[0-9a-fA-F-]{16,}$")
        literal = scratch.table(merged(scratch.table(counts.where(~number & (F.col("n") >= min_count))), z))
        rows = _joined(rows, literal, ["_template", "_segment"], broadcast_rows)
        step = F.when(F.col("_segment").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("_branch", F.lit("*"))))
        rows = rows.select(key, F.concat("_template", step).alias("_template"), "_segments", "_bad")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def merged(own: DataFrame, z: float, named: int = 20) -> DataFrame:
    """(_template, _segment, _branch): in the order of their bad rates, segments join a branch while
    their rate differs from the whole branch's by less than ``z`` standard errors of the pooled rate;
    ``z`` widens with the segments that are tested, as chance sets some of many apart.

    Segments with equal labels are one step, so a parent's steps grow far slower than its segments.
    A branch is named by its segments, one of over ``named`` by the first and the number of others.
    """
    own = own.withColumn("bads", F.coalesce("bads", F.lit(0))).withColumn("_rate", (F.col("bads") + 1) / (F.col("labelled") + 2))
    alike = own.groupBy("_template", "_rate", "labelled", "bads").agg(F.count("*").alias("k"))
    steps = alike.groupBy("_template").agg(F.sort_array(F.collect_list(F.struct("_rate", "labelled", "bads", "k"))).alias("steps"), F.sum("k").alias("all"))
    wide = F.sqrt(F.lit(z * z) + 2 * F.log(F.col("all")))

    def step(a: Column, x: Column) -> Column:
        pooled = (x["bads"] + a["b"] + 1) / (x["labelled"] + a["l"] + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / (x["labelled"] + 1) + 1 / (a["l"] + 1)))
        new = (F.size(a["starts"]) == 0) | (x["_rate"] - (a["b"] + 1) / (a["l"] + 2) >= wide * error)
        l, b = x["labelled"] * x["k"], x["bads"] * x["k"]
        starts = F.when(new, F.concat(a["starts"], F.array(x["_rate"]))).otherwise(a["starts"])
        return F.struct(F.when(new, l).otherwise(a["l"] + l).alias("l"), F.when(new, b).otherwise(a["b"] + b).alias("b"), starts.alias("starts"))

    zero = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"), F.expr("cast(array() as array<double>)").alias("starts"))
    starts = steps.select("_template", F.aggregate("steps", zero, step, lambda a: a["starts"]).alias("_starts"))
    rows = own.join(starts, "_template").select("_template", "_segment", F.size(F.filter("_starts", lambda s: s <= F.col("_rate"))).alias("_group"))
    names = rows.groupBy("_template", "_group").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("_segment")).alias("of"))
    name = F.when(F.col("n") <= named, F.array_join("of", "|")).otherwise(F.concat(F.get("of", F.lit(0)), F.lit("|+"), (F.col("n") - 1).cast("string")))
    return rows.join(names.select("_template", "_group", name.alias("_branch")), ["_template", "_group"]).select("_template", "_segment", "_branch")


def judge(df: DataFrame, key: str, url: str, labels: DataFrame, rules: list[tuple[str, str]], least_good: float = 0.5, weight: float = 10.0, broadcast_rows: int = 100_000, **options) -> DataFrame:
    """(key, host, path, rule, verdict, template, good_share) of every row of ``df``.

    ``labels`` has (key, bad) with bad 1 or 0, at most one row a key. Where no rule fits, a template
    is blocked if its share of good labels, smoothed towards that of all labels as if ``weight``
    labels more had shown it, is below ``least_good``. Without any label nothing is. Null urls and
    those without ``://`` have an empty host and path and form one template. Keys identify rows;
    rows that repeat one have equal results if they are equal. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    marked = labels.select(F.col(key).alias("_key"), F.col("bad").cast("int").alias("bad"))
    rows = rows.join(marked, "_key", "left")
    unit = scratch.table(rows.groupBy("_key", "host", "path").agg(F.max("bad").alias("bad"), F.count("*").alias("_rows")).withColumn("_id", F.xxhash64("_key", "host", "path")))
    told = scratch.table(templates(unit, "_id", "host", "path", "bad", scratch, broadcast_rows=broadcast_rows, **options))
    totals = told.agg(F.count("_bad"), F.sum("_bad")).first()
    prior = 1 - (totals[1] or 0) / totals[0] if totals[0] else 1.0
    purity = told.groupBy("_template").agg(((F.count("_bad") - F.coalesce(F.sum("_bad"), F.lit(0)) + weight * prior) / (F.count("_bad") + weight)).alias("good_share"))
    out = _joined(told.select("_id", "_template"), purity, ["_template"], broadcast_rows).join(unit, "_id")
    ruled = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled["verdict"], F.when(F.col("good_share") < least_good, "block").otherwise("allow"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return out.select(F.col("_key").alias(key), "host", "path", ruled["rule"].alias("rule"), verdict.alias("verdict"), F.col("_template").alias("template"), "good_share")

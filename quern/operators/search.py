"""Filters, full-text ranking, nearest neighbours and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import dot, tokens_of
from quern.operators.index import Index
from quern.plans.lang import DEFAULT_LIMIT, Query

WEEK = 604_800.0
FUSE = 60
NEAREST = 400


def within_column(path: Column, q: Query) -> Column:
    out = F.lit(False)
    for w in q.within:
        if w.path is not None:
            out |= (path >= w.path + "/") & (path < w.path + "0")
        else:
            folder = "".join("\\" + c if c in "%_\\" else c for c in w.folder)
            out |= path.ilike(f"%/{folder}/%")
    return out


def filters(files: DataFrame, q: Query, tags: DataFrame | None = None, file_tags: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The files that a query's filters leave; words are matched elsewhere, exclusions here, by ``index``."""
    c = F.col
    if not (q.kinds or q.exts or q.within):
        files = files.where(c("project_id").isNull())
    if q.kinds:
        files = files.where(c("kind").isin(list(q.kinds)))
    if q.exts:
        files = files.where(c("ext").isin(list(q.exts)))
    if q.within:
        files = files.where(within_column(c("path"), q))
    for op, column, value in (("__ge__", "mtime", q.modified_after), ("__lt__", "mtime", q.modified_before), ("__gt__", "size", q.size_above), ("__lt__", "size", q.size_below)):
        if value is not None:
            files = files.where(getattr(c(column), op)(value))
    for wanted in q.tags:
        files = tagged(files, wanted, tags, file_tags)
    if q.exclude:
        files = files.join(index.without(q.exclude), "id", "left_anti")
    return files


def tagged(files: DataFrame, wanted: tuple[str, ...], tags: DataFrame, file_tags: DataFrame | None = None) -> DataFrame:
    """Files with one of ``wanted``: of the file itself, or of its content and not removed by hand."""
    own = tags.where(F.col("tag").isin(list(wanted)))
    off = own.where("source = 'removed'").select("hash", "tag").distinct()
    on = own.where("source <> 'removed'").select("hash", "tag").distinct().join(off, ["hash", "tag"], "left_anti").select("hash").distinct()
    by_content = files.join(on, "hash", "left_semi")
    if file_tags is None:
        return by_content
    by_file = files.join(file_tags.where(F.col("tag").isin(list(wanted))).select("id").distinct(), "id", "left_semi")
    return by_file.unionByName(by_content.join(by_file.select("id"), "id", "left_anti"))


def boosted(score: Column, project: Column, mtime: Column, now: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(now) - mtime)
    return score * F.when(project.isNull(), 1.0).otherwise(0.3) * (1 + 1 / (1 + age / WEEK))


def search_words(files: DataFrame, q: Query, now: int, index: Index, tags: DataFrame | None = None, file_tags: DataFrame | None = None) -> DataFrame:
    """The query's best files by words, or the newest if it has none."""
    terms = [t for t in q.terms if tokens_of(t.text)]
    left, limit = filters(files, q, tags, file_tags, index), q.limit or DEFAULT_LIMIT
    if not terms:
        return left.orderBy(F.col("project_id").isNotNull(), F.desc("mtime"), "id").limit(limit)
    found = left.join(index.ranked(terms), "id").withColumn("rank_score", boosted(F.col("score"), F.col("project_id"), F.col("mtime"), now))
    return found.orderBy(F.desc("by_name"), "rank_score", "id").limit(limit)


def nearest(vectors: DataFrame, query: list[float], k: int = NEAREST, least: float = 0.0) -> DataFrame:
    """The ``k`` vectors with the largest dot product with ``query``, ``least`` at least."""
    scored = vectors.withColumn("score", dot(F.col("vector"), F.array(*map(F.lit, query))))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)


def best_of_group(hits: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def fuse(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """(key, fused): reciprocal ranks of two rankings (key, rank), both of bounded length, summed."""
    both = first.select(key, "rank").unionByName(second.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (FUSE + F.col("rank"))).alias("fused"))

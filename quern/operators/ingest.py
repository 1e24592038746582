"""Incremental maintenance of the catalogue: changes, merges, forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATCHED = ["kind", "size", "mtime", "mtime_ns", "ctime_ns", "level", "project", "project_id", "text_limit"]


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of either snapshot with ``state``: new, gone, changed or same."""
    columns = [c for c in WATCHED if c in old.columns and c in new.columns]
    a = old.select("path", F.struct(*columns).alias("_old"))
    b = new.select("path", F.struct(*columns).alias("_new"))
    both = a.join(b, "path", "full_outer")
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(same, "same").otherwise("changed")
    return both.select("path", state.alias("state"))


def under(path: Column, folder: str) -> Column:
    return (path == folder) | ((path >= folder + "/") & (path < folder + "0"))


def outside(files: DataFrame, folders: list[str]) -> DataFrame:
    """Files that are in none of the folders, which a model elsewhere must not see."""
    for folder in folders:
        files = files.where(~under(F.col("path"), folder))
    return files


def pending(files: DataFrame, embedded: DataFrame, policy: str) -> DataFrame:
    """Contents that the model has not seen under this policy, one row each."""
    done = embedded.where(F.col("policy") == policy).select("hash").distinct()
    return files.where("hash is not null").groupBy("hash").agg(F.min("kind").alias("kind")).join(done, "hash", "left_anti")


def merged(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The next snapshot: fresh rows, and old ones whose key is not among them."""
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def collected(cache: DataFrame, files: DataFrame, now: int, keep_seconds: int = 30 * 86_400) -> DataFrame:
    """A cache by hash after one sweep: used rows are unmarked, unused marked, long unused dropped."""
    used = files.select("hash").distinct().withColumn("_used", F.lit(True))
    rows = cache.join(used, "hash", "left")
    since = F.when(F.col("_used"), F.lit(None).cast("long")).otherwise(F.coalesce("unused_since", F.lit(now)))
    return rows.withColumn("unused_since", since).drop("_used").where(F.col("unused_since").isNull() | (F.col("unused_since") > now - keep_seconds))


def unread(readable: DataFrame, contents: DataFrame, limit: int) -> DataFrame:
    """(hash, path, ext): one file of each content whose text is not kept for ``limit``. Copies, and files
    that were moved or touched, are not read again; a text that was cut at another limit is."""
    have = contents.where(F.col("text_limit") == limit).select("hash")
    rows = readable.where("hash is not null").join(have, "hash", "left_anti")
    return rows.groupBy("hash").agg(F.min(F.struct("path", "ext")).alias("of")).select("hash", "of.path", "of.ext")


def next_scan(files: DataFrame) -> DataFrame:
    """(scan_id): the number of the scan that comes next."""
    return files.agg((F.coalesce(F.max("scan_id"), F.lit(0)) + 1).alias("scan_id"))


def scan_counts(states: DataFrame) -> DataFrame:
    """One row of how many paths are new, changed, the same and gone, and how many files there are."""
    n = {k: F.sum((F.col("state") == k).cast("long")) for k in ("new", "changed", "same", "gone")}
    counts = [F.coalesce(v, F.lit(0)).alias(k) for k, v in n.items()]
    return states.agg(*counts, F.coalesce(F.sum((F.col("state") != "gone").cast("long")), F.lit(0)).alias("files"))


def swept(files: DataFrame, scan_id: int) -> DataFrame:
    """Files that a finished scan has touched; the others are gone."""
    return files.where(F.col("scan_id") == scan_id)


def forgotten_tags(tags: DataFrame, hashes: DataFrame) -> DataFrame:
    """``tags`` without what was learnt of ``hashes``; what was given or taken off by hand stays."""
    hand = F.col("source").isin("manual", "removed")
    return tags.where(hand).unionByName(tags.where(~hand).join(hashes, "hash", "left_anti"))


def forgotten(files: DataFrame, folder: str) -> DataFrame:
    """``files`` with those in ``folder`` marked as never read, so the next scan reads them anew."""
    inside = under(F.col("path"), folder)
    return files.withColumn("mtime_ns", F.when(inside, F.lit(-1).cast("long")).otherwise(F.col("mtime_ns")))


def unused_frames(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(name) of frame folders, named by a content's hash, of contents that no file has any more. Names
    that are no hash are left alone."""
    known = files.where("hash is not null").select(F.lower("hash").alias("name")).distinct()
    return frames.where(F.col("name").rlike("^[0-9a-f]{64}$")).join(known, "name", "left_anti").select("name")


def queue(files: DataFrame, outputs: DataFrame, processor: str, version: int, kinds: list[str], least: int = 2) -> DataFrame:
    """(path, hash, kind, mtime): files that a processor has yet to see, the newest first. A file without
    a hash counts as unseen until it has one."""
    done = outputs.where((F.col("processor") == processor) & (F.col("version") == version)).select("hash").distinct()
    rows = files.where((F.col("level") >= least) & F.col("kind").isin(kinds))
    return rows.join(done, "hash", "left_anti").select("path", "hash", "kind", "mtime").orderBy(F.desc("mtime"), "path")


def upserted(cache: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``cache`` with the rows of ``fresh`` in place of those with the same key."""
    return cache.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)

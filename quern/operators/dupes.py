"""Duplicates: the same content, look-alike fingerprints and copy names.

Groups are rows of sums, and their files are rows of their own, so no group is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import human_size, plain_name
from quern.operators.graph import components
from quern.sources.scratch import Scratch

MIN_SIZE = 16 * 1024
#: Order of the kinds of likeness among equally wasteful groups, and how a group is introduced.
LIKENESS = {"same": (0, "Same content", "Copy of "), "looks": (1, "Look alike", "Looks like "), "names": (2, "Same name", "Named like ")}


def median_bits(values: Column) -> Column:
    """64 values as a 64-bit number: bit 63 - i is set where value i is above the median."""
    own = F.transform(values, lambda x: x.cast("double"))
    ordered = F.sort_array(own)
    median = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2
    binary = F.array_join(F.transform(own, lambda x: F.when(x > median, "1").otherwise("0")), "")
    high, low = F.conv(F.substring(binary, 1, 32), 2, 10).cast("long"), F.conv(F.substring(binary, 33, 32), 2, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def groups_of(members: DataFrame, likeness: str) -> DataFrame:
    """(likeness, key, n, wasted, first): the groups of more than one file among ``members`` (key, id,
    path, name, mtime, size), with the bytes beyond the largest and the oldest file."""
    first = F.min(F.struct("mtime", "path", "name")).alias("first")
    out = members.groupBy("key").agg(F.count("*").alias("n"), (F.sum(F.coalesce("size", F.lit(0))) - F.max(F.coalesce("size", F.lit(0)))).alias("wasted"), first)
    return out.where("n > 1").withColumn("likeness", F.lit(likeness))


def _members(files: DataFrame, key: Column) -> DataFrame:
    return files.select(key.cast("string").alias("key"), "id", "path", "name", "mtime", "size")


def same(files: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Files of equal content, by ``key``. Sizes come first: only files that share one need a hash."""
    big = files.where(F.col("size") >= min_size)
    shared = big.groupBy("size").count().where("count > 1").select("size")
    return _members(big.join(shared, "size", "left_semi").where("hash is not null"), F.col("hash"))


def names(files: DataFrame) -> DataFrame:
    """Files whose names are alike without copy marks: one has a mark, and contents are not all one."""
    rows = files.withColumn("plain", plain_name(F.col("name")))
    told = rows.groupBy("plain").agg(F.max(F.col("plain") != F.lower("name")).alias("marked"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.count("hash").alias("hashed"), F.count("*").alias("all"))
    kept = told.where("all > 1 and marked and not (hashed = all and low = high)").select("plain")
    return _members(rows.join(kept, "plain", "left_semi"), F.col("plain"))


def similar_length(a: Column, b: Column) -> Column:
    """Lengths in seconds that differ by 2 at most, or by 2 % of the longer; one that is unknown fits all."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(2.0), 0.02 * F.greatest(a, b)), F.lit(True))


def alike_pairs(prints: DataFrame, most: int) -> DataFrame:
    """(a, b, algo, distance) of fingerprints that differ in ``most`` bits at most, of two contents if
    ``prints`` has a hash, and of similar length if it has a duration.

    Of most + 1 bands of bits one must agree, so bands are joined instead of all pairs. Equal prints
    are one row with a representative until the end, so a picture that many files show is one.
    """
    bands = most + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    extra = [c for c in ("hash", "duration") if c in prints.columns]
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.shiftleft("bits", 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i]).alias("v")) for i in range(bands)))
    cut = prints.select("id", "algo", "bits", *extra, F.explode(parts).alias("band"))
    a, b = (cut.toDF(x, "algo", f"{x}_bits", *(f"{x}_{c}" for c in extra), "band") for x in "ab")
    met = a.join(b, ["algo", "band"]).where("a < b")
    if "hash" in extra:
        met = met.where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
    if "duration" in extra:
        met = met.where(similar_length(F.col("a_duration"), F.col("b_duration")))
    met = met.select("a", "b", "algo", "a_bits", "b_bits").distinct()
    return met.withColumn("distance", F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))).where(F.col("distance") <= most).select("a", "b", "algo", "distance")


def looks(prints: DataFrame, most: int) -> DataFrame:
    """(id, component, bits): connected look-alikes, with the largest distance of a link inside."""
    pairs = alike_pairs(prints, most)
    scratch = Scratch(prints.sparkSession)
    pairs = scratch.table(pairs)
    found = scratch.table(components(pairs, scratch))
    worst = pairs.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("distance").alias("bits"))
    return found.join(worst, "component").select(F.col("node").alias("id"), "component", "bits")


def look_alikes(files: DataFrame, prints: DataFrame, most: int, min_size: int = MIN_SIZE) -> DataFrame:
    """Files whose pictures look alike, by ``key``; ``prints`` is (hash, algo, bits, duration). Links are
    found between contents, and every file of a content is a member."""
    big = files.where(F.col("size") >= min_size)
    own = prints.where("bits is not null").join(big.select("hash"), "hash", "left_semi")
    own = own.select(F.xxhash64("hash", "algo").alias("id"), "hash", "algo", "bits", "duration").distinct()
    found = looks(own, most).join(own.select("id", "hash"), "id").select("hash", "component")
    return _members(big.join(found, "hash"), F.col("component"))


def similar_to(prints: DataFrame, probe: DataFrame, most: int) -> DataFrame:
    """Prints (id, algo, bits, hash, duration) near those of ``probe``, a row of the same columns,
    nearest first: equal contents are at 0, and lengths are similar."""
    own = F.broadcast(probe.limit(1).select("algo", *(F.col(c).alias(f"_{c}") for c in ("id", "bits", "hash", "duration"))))
    near = prints.join(own, "algo").where("id <> _id")
    apart = F.when(F.col("hash") == F.col("_hash"), 0).otherwise(F.bit_count(F.col("bits").bitwiseXOR(F.col("_bits"))))
    near = near.withColumn("distance", apart).where((F.col("distance") <= most) & similar_length(F.col("duration"), F.col("_duration")))
    return near.select("id", "algo", "distance").orderBy("distance", "id")


def similar_files(files: DataFrame, prints: DataFrame, path: str, most: int) -> DataFrame:
    """Files that look like the one at ``path``, nearest first; without a print of it, its exact copies,
    the oldest first. ``files`` is (id, path, hash, mtime, ...); adds distance."""
    own = files.where(F.col("path") == path).select("hash", F.col("id").alias("_mine")).limit(1)
    printed = files.select("id", "hash").join(prints.where("bits is not null"), "hash")
    probe = printed.join(F.broadcast(own.withColumnRenamed("hash", "_own")), F.col("id") == F.col("_mine")).drop("_own", "_mine")
    if probe.limit(1).count():
        near = similar_to(printed.select("id", "algo", "bits", "hash", "duration"), probe.orderBy("algo").select("id", "algo", "bits", "hash", "duration"), most)
        return files.join(near.select("id", "distance"), "id").orderBy("distance", "path")
    copies = files.join(F.broadcast(own), "hash").where("id <> _mine").drop("_mine")
    return copies.withColumn("distance", F.lit(0)).orderBy("mtime", "path").select(*files.columns, "distance")


def all_groups(parts: dict[str, DataFrame]) -> DataFrame:
    """Groups of several kinds (likeness to its members), with ``rank`` of the kinds' order."""
    out = None
    for likeness, members in parts.items():
        own = groups_of(members, likeness).withColumn("rank", F.lit(LIKENESS[likeness][0]))
        out = own if out is None else out.unionByName(own)
    return out


def flattened(parts: dict[str, DataFrame], limit: int) -> DataFrame:
    """Files of whole groups, the most wasteful first, until ``limit`` files are shown, with a caption.

    ``limit`` bounds the groups, so their order is settled on few rows; their files are joined to them.
    """
    top = all_groups(parts).orderBy(F.desc("wasted"), "rank", "first.path").limit(limit)
    order = Window.orderBy(F.desc("wasted"), "rank", "first.path")
    kept = top.withColumn("group_rank", F.row_number().over(order))
    before = F.sum("n").over(Window.orderBy("group_rank").rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < limit)
    out = None
    for likeness, members in parts.items():
        rows = members.join(F.broadcast(kept.where(F.col("likeness") == likeness)), "key")
        out = rows if out is None else out.unionByName(rows)
    intro, copy = (F.create_map(*(F.lit(x) for k, v in LIKENESS.items() for x in (k, v[i]))) for i in (1, 2))
    head = F.concat(intro[F.col("likeness")], F.lit(" · "), F.col("n").cast("string"), F.lit(" files · "), human_size(F.col("wasted")), F.lit(" spare"))
    caption = F.when(F.col("path") == F.col("first.path"), head).otherwise(F.concat(copy[F.col("likeness")], F.col("first.name")))
    return out.select("likeness", "wasted", "group_rank", "path", "mtime", caption.alias("caption")).orderBy("group_rank", "mtime", "path")

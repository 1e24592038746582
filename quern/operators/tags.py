"""Tags: by rules, of files, of contents by processors and by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import clean_tag

# How names of screenshots are written, and the languages that files of a project tell.
SCREENSHOTS = ["screenshot", "screen shot", "螢幕截圖", "截圖", "スクリーンショット"]
LANGUAGES = {
    "Cargo.toml": "rust", "package.json": "javascript", "tsconfig.json": "typescript", "pyproject.toml": "python", "requirements.txt": "python",
    "go.mod": "go", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "kotlin", "composer.json": "php",
    "Gemfile": "ruby", "pubspec.yaml": "dart", "deno.json": "typescript", "CMakeLists.txt": "c++",
}


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def by_rule(files: DataFrame) -> DataFrame:
    """(id, tag) of files (id, path, name, kind): screenshots by name or folder, and the languages of
    projects by the files that lie in them."""
    low, folder = F.lower("name"), F.lower(F.element_at(F.split(parent_of(F.col("path")), "/"), -1))
    shot = F.contains(folder, F.lit("screenshot"))
    for s in SCREENSHOTS:
        shot |= F.contains(low, F.lit(s))
    shots = files.where((F.col("kind") == "image") & shot).select("id", F.lit("screenshot").alias("tag"))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    inside = files.where(F.col("name").isin(list(LANGUAGES))).select(parent_of(F.col("path")).alias("path"), language[F.col("name")].alias("tag"))
    projects = files.where("kind = 'project'").select("id", "path").join(inside, "path").select("id", "tag").distinct()
    return shots.unionByName(projects)


def carried(values: Column) -> Column:
    """The tags in a file's own comma-separated list, cleaned."""
    return F.array_distinct(F.filter(F.transform(F.split(values, ","), clean_tag), lambda t: t != ""))


def by_processors(outputs: DataFrame) -> DataFrame:
    """(hash, tag, source, score) of what processors said: tags and labels of outputs without an error."""
    ok = outputs.where("error is null")
    lists = [ok.select("hash", F.explode(F.coalesce(c, F.array().cast("array<string>"))).alias("tag"), F.lit(source).alias("source")) for c, source in (("tags", "plugin"), ("labels", "plugin-label"))]
    rows = lists[0].unionByName(lists[1]).withColumn("tag", clean_tag(F.col("tag"))).where("tag <> ''").distinct()
    return rows.withColumn("score", F.lit(1.0))


def in_force(content: DataFrame) -> DataFrame:
    """(hash, tag) that hold for contents: given by anything, and not taken off by hand."""
    off = content.where("source = 'removed'").select("hash", "tag")
    return content.where("source <> 'removed'").select("hash", "tag").distinct().join(off, ["hash", "tag"], "left_anti")


def of_files(files: DataFrame, content: DataFrame, file_tags: DataFrame | None = None) -> DataFrame:
    """(id, tags): of the file itself and of its content, but for those that were taken off its content."""
    rows = files.select("id", "hash").join(in_force(content), "hash").select("id", "tag")
    if file_tags is not None:
        off = files.select("id", "hash").join(content.where("source = 'removed'").select("hash", "tag"), "hash").select("id", "tag")
        rows = rows.union(file_tags.select("id", "tag").join(files.select("id"), "id", "left_semi")).distinct().join(off, ["id", "tag"], "left_anti")
    return rows.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def set_by_hand(content: DataFrame, given: DataFrame, on: bool) -> DataFrame:
    """``content`` with the tags of ``given`` (hash, tag) given by hand, or taken off; either clears the other."""
    rows = given.select("hash", clean_tag(F.col("tag")).alias("tag")).where("tag <> ''").distinct()
    rest = content.where("source not in ('manual', 'removed')")
    mine = content.where("source in ('manual', 'removed')").join(rows, ["hash", "tag"], "left_anti")
    new = rows.withColumn("source", F.lit("manual" if on else "removed"))
    return rest.unionByName(mine).unionByName(new, allowMissingColumns=True)


def manual_counts(content: DataFrame) -> DataFrame:
    """(tag, n) of tags given by hand, the commonest first."""
    return content.where("source = 'manual'").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def suggested(content: DataFrame, labels: list[str], prefix: str, have: list[str], limit: int = 5) -> DataFrame:
    """(tag) to offer while one is typed: those given by hand, the commonest first, then labels; tags
    that begin with ``prefix`` and are not among ``have``."""
    spark = content.sparkSession
    own = manual_counts(content).select("tag", F.lit(0).alias("rank"), F.col("n"))
    more = spark.createDataFrame([(name, 1, -i) for i, name in enumerate(labels)], "tag string, rank int, n long")
    both = own.unionByName(more).where(F.startswith("tag", F.lit(prefix.strip().lstrip("#").lower())) & ~F.col("tag").isin(list(have)))
    return both.groupBy("tag").agg(F.min("rank").alias("rank"), F.max("n").alias("n")).orderBy("rank", F.desc("n"), "tag").limit(limit).select("tag")

"""What processors say about contents, as text that is searched with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def said(outputs: DataFrame) -> DataFrame:
    """(hash, text): texts and tags of a content's outputs, in the order of the processors' ids; contents
    without any are left out. Outputs are (hash, processor, text, tags, error)."""
    tags = F.array_join("tags", ", ")
    parts = F.filter(F.array("text", tags), lambda t: t.isNotNull() & (F.trim(t) != ""))
    rows = outputs.where("error is null").select("hash", F.struct("processor", parts.alias("parts")).alias("of"))
    whole = rows.groupBy("hash").agg(F.sort_array(F.collect_list("of")).alias("of"))
    text = F.array_join(F.flatten(F.transform("of", lambda x: x["parts"])), "\n")
    return whole.select("hash", text.alias("text")).where("text <> ''")


def next_extras(extras: DataFrame, outputs: DataFrame, touched: DataFrame) -> DataFrame:
    """(hash, text, version) after ``touched`` contents (hash) were processed: a version rises when the
    text is another, and a content of which nothing is said any more goes."""
    fresh = said(outputs.join(touched.select("hash").distinct(), "hash", "left_semi")).withColumnRenamed("text", "_new")
    old = extras.select("hash", F.col("text").alias("_old"), "version", F.lit(True).alias("_had"))
    rows = old.join(touched.select("hash", F.lit(True).alias("_touched")).distinct(), "hash", "full_outer").join(fresh, "hash", "left")
    text = F.when(F.col("_touched"), F.col("_new")).otherwise(F.col("_old"))
    version = F.when(F.col("_had").isNull(), 1).when(F.col("_touched") & (F.col("_new") != F.col("_old")), F.col("version") + 1).otherwise(F.col("version"))
    return rows.select("hash", text.alias("text"), version.cast("long").alias("version")).where("text is not null")


def changed_hashes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(hash) of contents whose extra text is another than before: their files are indexed again."""
    a, b = before.select("hash", F.col("text").alias("_a")), after.select("hash", F.col("text").alias("_b"))
    return a.join(b, "hash", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("hash")


def policy(limit: Column, version: Column) -> Column:
    """With what a content's text was made: the limit of its reading and the version of what was said."""
    return F.concat(limit.cast("string"), F.lit("/"), F.coalesce(version, F.lit(0)).cast("string"))


def full_texts(contents: DataFrame, extras: DataFrame) -> DataFrame:
    """(hash, text, policy) of contents (hash, text, text_limit): their text and what was said about
    them, and contents of which only something was said."""
    own = contents.select("hash", F.col("text").alias("_own"), "text_limit").join(extras.select("hash", F.col("text").alias("_said"), "version"), "hash", "left")
    text = F.trim(F.concat(F.coalesce("_own", F.lit("")), F.coalesce(F.concat(F.lit("\n"), F.col("_said")), F.lit(""))))
    both = own.select("hash", text.alias("text"), policy(F.col("text_limit"), F.col("version")).alias("policy"))
    only = extras.join(contents.select("hash"), "hash", "left_anti").select("hash", "text", policy(F.lit(0), F.col("version")).alias("policy"))
    return both.unionByName(only).where("text <> ''")


def with_full_text(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``files`` with the full text of their contents, null where there is none."""
    return files.drop("text").join(texts.select("hash", "text"), "hash", "left")

"""From raw documents to packed sequences: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, and each works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, n_words, spaced, table
from quern.llm.mixing import mix
from quern.llm.ngram_join import link
from quern.llm.packing import Limits, pack
from quern.llm.quality import good
from quern.llm.toxicity import labelled, toxicity

#: Sides of at most so many rows, of a few numbers each, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 400_000


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def free(name: str, docs: DataFrame) -> str:
    """``name`` with underscores in front until no column of ``docs`` has it, in any case."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep lines of their own when the boilerplate of their source
    goes. Null texts and those of few words go, null sources are one source, equal rows go or stay
    together, an empty table gives an empty one, and other columns, whatever their names, are untouched."""
    return good(docs, "doc_id", "text", "source")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. Null and empty texts stay, equal texts go or stay together,
    an empty table gives an empty one, and other columns, whatever their names, are untouched."""
    train = labelled(docs, table(spark, sf_dir, "labels"))
    score = free("_toxicity", docs)
    return toxicity(docs, "text", train, score).where(F.col(score) < 0.5).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one that names it; documents without words all stay.

    Documents link whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Null ids
    name a component only if it has no other, rows that repeat an id and a text are one document, and
    of several texts with the id that names a component one stays. An empty table gives no rows;
    other columns, whatever their names, are untouched.
    """
    scratch = Scratch(spark)
    found = scratch.table(link(docs, "doc_id", "text", n=5, percent=80))
    worded = found.where("n_shingles > 0").select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.col("k2").alias("_k2"), "c", F.col("component_id").alias("_named"))
    stays = worded.where(F.col("_d").eqNullSafe(F.col("_named"))).groupBy("_d", "c").agg(F.min(F.struct("_k", "_k2")).alias("_first"))
    stays = stays.select("_d", "_first._k", "_first._k2")
    text = lambda a, b: (a["_k"] == b["_k"]) & (a["_k2"] == b["_k2"]) & a["_d"].eqNullSafe(b["_d"])
    rows = worded.select("_d", "_k", "_k2").distinct()
    goes = scratch.table(rows.alias("x").join(stays.alias("y"), text({c: F.col(f"x.{c}") for c in rows.columns}, {c: F.col(f"y.{c}") for c in rows.columns}), "left_anti"))
    own = {"_d": F.col("d.doc_id"), "_k": F.xxhash64("d.text"), "_k2": F.xxhash64(F.lit(7), "d.text")}
    kept = docs.alias("d").join(_side(goes).alias("g"), text(own, {c: F.col(f"g.{c}") for c in goes.columns}), "left_anti")
    if worded.groupBy("_d", "_k", "_k2").count().where("count > 1").limit(1).count():
        words = n_words(F.col("text")) > 0
        kept = kept.where(words).dropDuplicates(["doc_id", "text"]).unionAll(kept.where(~words))
    return kept


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix by weights 1, 2, 3, repeating, takes: a row for each time it takes of a
    document, with the whole text, or the taken words if it takes a part; n_chars follows the text.

    Documents without words are taken whole never, as there is nothing of them to take. Null ids and
    sources take part like others; rows that repeat an id, text and source are one stream of words each,
    and equal ones follow each other. An empty table gives an empty one; other columns are untouched.
    """
    scratch = Scratch(spark)
    keys = {"_d": F.col("doc_id"), "_k": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(7), "text"), "_s": F.col("source")}
    own = docs.select(*(v.alias(k) for k, v in keys.items()), n_words(F.col("text")).alias("_size"))
    mixed = mix(own.withColumnsRenamed({"_s": "source", "_size": "size", "_d": "doc_id"}), "doc_id", "source", "size", [1.0, 2.0, 3.0], scratch)
    at = ["_source", "_chunk", "_place"]
    taken = mixed.pieces.groupBy(*at, "epoch").agg(F.min("from").alias("from"), F.sum("length").alias("length"))
    taken = mixed.rows.select(*at, "doc_id", "_k", "_k2", "source", "size").join(taken, at)
    taken = scratch.table(taken.select(F.col("doc_id").alias("_d"), "_k", "_k2", F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("from").alias("_from"), F.col("length").alias("_length")))
    once = docs
    if own.groupBy("_d", "_k", "_k2", "_s").count().where("count > 1").limit(1).count():
        once = docs.dropDuplicates(["doc_id", "text", "source"])
    row = {"_d": F.col("rows.doc_id"), "_k": F.xxhash64("rows.text"), "_k2": F.xxhash64(F.lit(7), "rows.text"), "_s": F.col("rows.source")}
    same = F.lit(True)
    for k, v in row.items():
        same &= v.eqNullSafe(F.col(f"taken.{k}"))
    rows = once.alias("rows").join(_side(taken).alias("taken"), same)
    words = F.array_remove(F.split(spaced(F.col("rows.text")), " "), "")
    part = F.array_join(F.slice(words, (F.col("taken._from") + 1).cast("int"), F.col("taken._length").cast("int")), " ")
    text = F.when(F.col("taken._length") < F.col("taken._size"), part).otherwise(F.col("rows.text"))
    shown = {"text": text}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(shown[c].alias(c) if c in shown else F.col(f"rows.`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens. A null or empty text is its end
    token alone, repeated rows are packed each for itself, an empty table gives no rows, and other columns
    are not read."""
    return pack(docs, "doc_id", "text", "byte_bpe_50k.json", Limits(1024, 256, 1024))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxic_documents", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Models, components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next one."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

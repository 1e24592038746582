"""Catalogue tables derived from the driver's tables, so that every operator has an input.

All are deterministic; ``NOW`` stands for the clock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.model import kind_of, level_of
from quern.operators.index import Index
from quern.sources.scratch import exists, scratch_root

START = 1_704_067_200
NOW = START + 400 * 86_400
HOME = "/home/u"
EXTENSIONS = ["txt", "md", "csv", "sh", "pdf", "png", "rs", "toml"]


#: Where the index of a session's tables is.
_INDEXES: dict[tuple[str, str], str] = {}


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self, text: bool = False) -> DataFrame:
        d = self.table("documents")
        ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int"))
        name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_"), F.col("lang"), F.when(F.col("doc_id") % 10 == 0, " (1)").otherwise(""), F.lit("."), ext)
        out = d.select(
            F.col("doc_id").alias("id"), name.alias("name"), ext.alias("ext"),
            F.concat(F.lit(HOME + "/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
            F.octet_length("text").cast("long").alias("size"), (F.lit(START) + 3600 * F.col("doc_id")).alias("mtime"),
            F.sha2("text", 256).alias("hash"), F.when(F.col("source") == "src7", F.lit(-1).cast("long")).alias("project_id"), "text",
        )
        out = out.withColumn("kind", kind_of(F.col("name"), F.col("ext"), F.col("project_id").isNotNull()))
        out = out.withColumn("level", level_of(F.col("kind")))
        return out if text else out.drop("text")

    def index(self) -> Index:
        """The stored index of all files, built by the first query of a session that needs it."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _INDEXES or not exists(self.spark, f"{_INDEXES[key]}/sizes/_SUCCESS"):
            _INDEXES[key] = f"{scratch_root(self.spark)}/quern-index-{uuid.uuid4().hex}"
            return Index.build(self.files(True), _INDEXES[key], HOME)
        return Index.load(self.spark, _INDEXES[key])

    def tags(self) -> DataFrame:
        """(hash, tag, source); where copies disagree, a removal wins over a manual tag."""
        rows = self.table("labels").join(self.table("documents").select("doc_id", F.sha2("text", 256).alias("hash")), "doc_id")
        good = F.when(F.col("quality") == 1, F.struct(F.lit("quality").alias("tag"), F.lit("manual").alias("source")))
        off = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.struct(F.lit("quality").alias("tag"), F.lit("removed").alias("source")))
        toxic = F.when(F.col("toxic") == 1, F.struct(F.lit("toxic").alias("tag"), F.lit("plugin").alias("source")))
        all_ = rows.select("hash", F.explode(F.array_compact(F.array(good, off, toxic))).alias("t")).select("hash", "t.*").distinct()
        removed = all_.where("source = 'removed'").select("hash", "tag")
        manual = all_.where("source = 'manual'").join(removed, ["hash", "tag"], "left_anti")
        return all_.where("source <> 'manual'").unionByName(manual)

    def vectors(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 4).cast("string")).alias("hash"), (F.col("vec_id") % 4).alias("chunk"), "vec_id", F.col("embedding").alias("vector"))

    def prints(self) -> DataFrame:
        """(id, algo, bits): bit i of a picture is set where its value is above the median."""
        from quern.operators.dupes import median_bits

        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.floor(F.col("vec_id") / 4).cast("string")).alias("hash"), F.when(F.col("vec_id") % 2 == 1, (F.col("vec_id") % 50) * 2.0).alias("duration"), F.when(F.col("vec_id") % 2 == 0, "phash").otherwise("phash-video").alias("algo"), median_bits(F.col("embedding")).alias("bits"))

    def outputs(self) -> DataFrame:
        """What two processors said about some contents, with errors, blanks and repeated tags."""
        d = self.table("documents")
        k, h = F.col("doc_id"), F.sha2("text", 256).alias("hash")
        tags = F.array(F.concat(F.lit(" Lang "), F.col("lang")), F.concat(F.lit("#lang "), F.col("lang")), F.lit(" "))
        one = d.where("doc_id % 4 <> 1").select(h, F.lit("describe").alias("processor"), F.concat(F.lit("seen in "), "source").alias("text"), F.when(k % 8 < 4, tags).otherwise(F.array().cast("array<string>")).alias("tags"), F.array(F.col("source")).alias("labels"), F.when(k % 10 == 0, "cannot").alias("error"))
        two = d.where("doc_id % 3 = 0").select(h, F.lit("alt").alias("processor"), F.when(k % 2 == 0, F.col("lang")).otherwise(" ").alias("text"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("error"))
        both = one.unionByName(two)
        # One output for a content and processor, as a cache has it.
        return both.groupBy("hash", "processor").agg(F.min(F.struct("error", "text", "tags", "labels")).alias("o")).select("hash", "processor", "o.text", "o.tags", "o.labels", "o.error")

    def history(self) -> DataFrame:
        p = self.table("pages")
        return p.select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (1 + F.col("page_id") % 17).alias("visit_count"), (F.col("page_id") % 3).alias("typed_count"), F.col("page_id").alias("last_visit_time"), (F.col("page_id") % 3).alias("profile"))

    def processes(self) -> DataFrame:
        c = self.table("customer")
        parent = F.floor(F.col("c_custkey") / 3)
        return c.select(F.col("c_custkey").alias("pid"), F.when(parent > 0, parent).alias("parent"), F.col("c_name").alias("name"), F.abs("c_acctbal").alias("cpu"), F.floor(F.abs("c_acctbal") * 1000).alias("memory"))

    def rates(self) -> DataFrame:
        n = self.table("nation")
        return n.select(F.upper("n_name").alias("code"), (1 + F.col("n_nationkey") / 10).alias("rate"))


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def duck_files() -> str:
    """The same catalogue in SQL: CTE ``f`` of files with text."""
    from quern import model as M

    kinds = " ".join(f"WHEN ext IN ({_list(e)}) THEN " + ("CASE WHEN project_id IS NOT NULL THEN 'code' ELSE 'script' END" if k == "script" else f"'{k}'") for k, e in M.EXTS.items())
    key = " OR ".join([f"lower(name) IN ({_list(M.KEY_NAMES)})", f"ext IN ({_list(M.KEY_EXTS)})", *(f"starts_with(lower(name), '{p}')" for p in M.KEY_PREFIXES)])
    levels = " ".join(f"WHEN kind = '{k}' THEN {n}" for k, n in M.LEVELS.items())
    return f"""WITH f0 AS (SELECT doc_id AS id, ([{_list(EXTENSIONS)}])[doc_id % 8 + 1] AS ext, lang, source, text FROM documents),
f1 AS (SELECT *, 'doc' || id || '_' || lang || CASE WHEN id % 10 = 0 THEN ' (1)' ELSE '' END || '.' || ext AS name FROM f0),
f2 AS (SELECT id, name, ext, '{HOME}/' || source || '/' || lang || '/' || name AS path, CAST(strlen(text) AS BIGINT) AS size, {START} + 3600 * id AS mtime, sha256(text) AS hash, CASE WHEN source = 'src7' THEN -1 END AS project_id, text FROM f1),
f3 AS (SELECT *, CASE WHEN ext IN ({_list(M.ENV_TEMPLATES)}) AND starts_with(lower(name), '.env.') THEN 'config' WHEN {key} THEN 'key' {kinds} ELSE 'other' END AS kind FROM f2),
f AS (SELECT *, CASE {levels} ELSE 1 END AS level FROM f3)"""


DUCK_OUTPUTS = """o0 AS (SELECT sha256(text) AS hash, 'describe' AS processor, 'seen in ' || source AS text, CASE WHEN doc_id % 8 < 4 THEN ['lang-' || lang, 'lang-' || lang] ELSE [] END AS tags, [' Lang ' || lang, '#lang ' || lang, ' '] AS raw, [source] AS labels, CASE WHEN doc_id % 10 = 0 THEN 'cannot' END AS error FROM documents WHERE doc_id % 4 <> 1
 UNION ALL SELECT sha256(text), 'alt', CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END, [], [], [], NULL FROM documents WHERE doc_id % 3 = 0),
o1 AS (SELECT *, row_number() OVER (PARTITION BY hash, processor ORDER BY error NULLS FIRST, text, len(tags), labels) AS r FROM o0), o AS (SELECT * FROM o1 WHERE r = 1)"""

DUCK_TAGS = """t0 AS (SELECT DISTINCT sha256(d.text) AS hash, u.tag AS tag, u.source AS source FROM labels l JOIN documents d USING (doc_id),
 LATERAL (SELECT 'quality' AS tag, 'manual' AS source WHERE l.quality = 1 UNION ALL SELECT 'quality', 'removed' WHERE l.quality = 0 AND l.toxic = 0 UNION ALL SELECT 'toxic', 'plugin' WHERE l.toxic = 1) u),
t AS (SELECT * FROM t0 a WHERE a.source <> 'manual' OR NOT EXISTS (SELECT 1 FROM t0 b WHERE b.hash = a.hash AND b.tag = a.tag AND b.source = 'removed'))"""

"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .common import Scratch, held_out, n_words, table
from .html_crf import main_text
from .langid import identify
from .mixing import Mix, mix
from .ngram_join import link
from .packing import Limits, pack
from .quality import BANDS, COUNTS, POINTS, SAMPLED, judged
from .token_count import token_counts
from .toxicity import labelled, toxicity
from .url_templates import judge

#: The rules of the url query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id 100 divides, among all others."""
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def mixed(docs: DataFrame, weights: list[float]) -> Mix:
    """The mix of (doc_id, source, size) with each row's target."""
    return mix(docs, "doc_id", "source", "size", weights, Scratch(docs.sparkSession))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 1, 2, 3, repeating, takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    own = mixed(docs, [1.0, 2.0, 3.0])
    at = ["_source", "_chunk", "_place"]
    taken = own.pieces.groupBy(*at).agg(F.sum("length").alias("taken"))
    told = spark.createDataFrame([(i, p.size, p.target) for i, p in enumerate(own.plans)], "_source int, source_size long, target double")
    out = own.rows.join(taken, at, "left").join(F.broadcast(told) if len(own.plans) <= 100_000 else told, "_source")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85."""
    return link(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and line-frequency verdict of every document; its host is its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judged(docs, "doc_id", "text", "source").select("doc_id", *COUNTS, "base_failed", "kept", "n_boilerplate_words")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, "text", labelled(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by ``piece_bpe_32k.model``, and whether they pass 4096."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, "text", "piece_bpe_32k.model")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, else by its template. A page shows the document whose number its
    path ends with; that document's quality label is the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    number = F.regexp_extract("url", r"://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:\.[A-Za-z]+)?/?(?:[?#]|$)", 1)
    shown = pages.select("page_id", F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("doc_id"))
    bad = shown.join(labels, "doc_id").groupBy("page_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return judge(pages, "page_id", "url", bad, URL_RULES)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, "html").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of ``byte_bpe_50k.json`` and id 0, in sequences of at most 1024."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k.json", Limits(1024, 256, 1024))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull())
    found = identify(docs, train, "doc_id", "text", "lang")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_multi_index, op2_mixing, op3_ngram_join, op4_quality_rules, op5_toxicity, op6_token_counts, op7_url_filters, op8_main_text, op9_packing, op10_language_id)}


#: Quality rules in SQL: the same counts, signatures and verdicts, with lines and windows themselves in
#: place of their hashes where only equality counts.
_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_SIGNATURES = ", ".join(f"[{', '.join(f'list_min(list_transform(g, lambda x: xor(x, {p}::BIGINT)))' for p in points)}]" for points in POINTS)
QUALITY_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS spaced FROM documents),
w AS (SELECT *, list_filter(string_split(spaced, ' '), lambda x: x <> '') AS ws,
 list_filter(string_split(text, chr(10)), lambda x: trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '') AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, step)) AS n FROM (SELECT doc_id, i - lag(i, 1, i - 5) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM r) GROUP BY doc_id),
a AS (SELECT source, {_HASH.format("coalesce(text, '')")} AS t, ws, CASE WHEN len(ws) >= 5 THEN CASE WHEN len(list_filter(range(1, len(ws) - 3), lambda i: length(ws[i]) % {SAMPLED} = 0)) > 0 THEN list_filter(range(1, len(ws) - 3), lambda i: length(ws[i]) % {SAMPLED} = 0) ELSE range(1, len(ws) - 3) END END AS chosen FROM w),
h AS (SELECT source, t, CASE WHEN chosen IS NULL THEN [t] ELSE list_transform(chosen, lambda i: {_HASH.format("array_to_string(ws[i:i + 4], ' ')")}) END AS g FROM a),
s AS (SELECT source, t, unnest([{_SIGNATURES}]) AS s, unnest(range({BANDS})) AS band FROM h),
e AS (SELECT source, t FROM (SELECT source, band, s, min(t) AS t FROM s GROUP BY ALL) GROUP BY ALL HAVING count(*) = {BANDS}),
m AS (SELECT source, greatest(10, ceil(count(DISTINCT t) * 0.001)) AS most FROM h GROUP BY source),
n AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(translate(lower(x), '0123456789' || chr(9) || chr(13) || chr(11) || chr(12), '0000000000    '))), lambda x: x <> '') AS ns FROM d),
l AS (SELECT doc_id, source, {_HASH.format("coalesce(text, '')")} AS t, i, ns[i] AS line, CASE WHEN i > 1 THEN ns[i - 1] ELSE chr(1) || i || ns[i] END AS before, CASE WHEN i < len(ns) THEN ns[i + 1] ELSE chr(1) || i || ns[i] END AS after FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM n)),
o AS (SELECT source, line, t, arg_min(before, i) AS before, arg_min(after, i) AS after FROM l GROUP BY source, line, t),
q AS (SELECT source, line, count(*) AS docs FROM o GROUP BY source, line),
j AS (SELECT q.*, (SELECT max(before) FROM (SELECT before FROM o WHERE o.source IS NOT DISTINCT FROM q.source AND o.line = q.line GROUP BY before HAVING 2 * count(*) > q.docs)) AS before, (SELECT max(after) FROM (SELECT after FROM o WHERE o.source IS NOT DISTINCT FROM q.source AND o.line = q.line GROUP BY after HAVING 2 * count(*) > q.docs)) AS after FROM q JOIN m ON m.source IS NOT DISTINCT FROM q.source WHERE q.docs >= m.most),
y AS (SELECT a.source, a.line AS up, b.line AS down FROM j a JOIN j b ON a.source IS NOT DISTINCT FROM b.source AND a.after = b.line AND b.before = a.line),
z AS (SELECT source, line FROM j WHERE before IS NULL OR after IS NULL UNION SELECT z.source, CASE WHEN y.up = z.line THEN y.down ELSE y.up END FROM z JOIN y ON y.source IS NOT DISTINCT FROM z.source AND (y.up = z.line OR y.down = z.line)),
k AS (SELECT o.source, o.line FROM o JOIN e ON e.source IS NOT DISTINCT FROM o.source AND e.t = o.t JOIN m ON m.source IS NOT DISTINCT FROM o.source GROUP BY o.source, o.line, m.most HAVING count(*) >= m.most),
f AS (SELECT source, line FROM z UNION SELECT source, line FROM k),
x AS (SELECT l.doc_id, sum(len(list_filter(string_split(l.line, ' '), lambda x: x <> ''))) AS gone FROM l JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.line = l.line GROUP BY l.doc_id),
t AS (SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(length(replace(spaced, ' ', '')), 0) AS word_chars, coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS n_symbols,
 coalesce(len(ls) - len(list_distinct(ls)), 0) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_boilerplate_words FROM w LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM t)
SELECT *, NOT base_failed AND NOT n_words - n_boilerplate_words < 0.3 * n_words AS kept FROM v"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": QUALITY_SQL}

"""Registered queries of the engine's operators, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import dupes as D
from quern.operators import extras as E
from quern.operators import search as S
from quern.operators import tags as G
from quern.plans.fixtures import DUCK_OUTPUTS, DUCK_TAGS, HOME, NOW, START, Fixtures, duck_files
from quern.plans.lang import parse
from quern.sources.scratch import scratch_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FILES = duck_files()


def duck_words(x: str) -> str:
    cjk = "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in (("3040", "30FF"), ("3400", "4DBF"), ("4E00", "9FFF"), ("AC00", "D7AF"), ("F900", "FAFF"), ("20000", "2FA1F")))
    for pattern, to in ((f"([{cjk}])", " \\1 "), ("[^\\p{L}\\p{N}]+", " "), ("(\\p{Ll})(\\p{Lu})", "\\1 \\2"), ("(\\p{N})(\\p{L})", "\\1 \\2"), ("(\\p{L})(\\p{N})", "\\1 \\2"), (" +", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


def duck_tokens(x: str, split: bool = True) -> str:
    x = f"strip_accents(lower({duck_words(x)}))" if split else f"regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return register


def asked(text: str, now: int = NOW):
    return parse(text, now, HOME)


# Text and catalogue


@query(f"{FILES} SELECT id, {duck_words('name')} AS name_words, {duck_words('text')} AS body_words FROM f")
def words_tokens(x: Fixtures) -> DataFrame:
    return x.files(True).select("id", T.words(F.col("name")).alias("name_words"), T.words(F.col("text")).alias("body_words"))


@query(f"{FILES} SELECT kind, level, count(*) AS n, sum(size) AS bytes FROM f GROUP BY ALL")
def kind_classify(x: Fixtures) -> DataFrame:
    return x.files().groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"""{FILES} SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) ELSE printf('%.1f MB', size / 1048576.0) END AS human FROM f""")
def human_size(x: Fixtures) -> DataFrame:
    return x.files().select("id", T.human_size(F.col("size")).alias("human"))


@query(f"""{FILES}, g AS (SELECT id, {NOW} - mtime AS s FROM f) SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 2592000 THEN (s // 86400) || 'd' WHEN s < 31536000 THEN (s // 2592000) || 'mo' ELSE (s // 31536000) || 'y' END AS age FROM g""")
def age_bucket(x: Fixtures) -> DataFrame:
    return x.files().select("id", T.age(F.lit(NOW) - F.col("mtime")).alias("age"))


@query("SELECT p_partkey AS id, regexp_replace(trim(lower(regexp_replace(trim(' #' || p_type || ' '), '^#+', ''))), '\\s+', '-', 'g') AS tag FROM part")
def clean_tag(x: Fixtures) -> DataFrame:
    return x.table("part").select(F.col("p_partkey").alias("id"), T.clean_tag(F.concat(F.lit(" #"), "p_type", F.lit(" "))).alias("tag"))


@query(f"{FILES} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(name, '^(.+)\\.[^.]*$', '\\1'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')) AS passage FROM f")
def name_passage(x: Fixtures) -> DataFrame:
    return x.files().select("id", T.name_passage(F.col("name")).alias("passage"))


@query("""WITH l AS (SELECT doc_id, trim(regexp_replace(u.line, '\\s+', ' ', 'g')) AS line, u.i AS i FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u),
m AS (SELECT doc_id, arg_min(line, i) AS line FROM l WHERE line <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(m.line) > 160 THEN substr(m.line, 1, 160) || '…' ELSE m.line END AS line FROM documents d LEFT JOIN m USING (doc_id)""")
def first_line(x: Fixtures) -> DataFrame:
    return x.table("documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', '') AS shown FROM pages")
def display_url(x: Fixtures) -> DataFrame:
    return x.table("pages").select("page_id", T.display_url(F.col("url")).alias("shown"))


# Filters: the query text goes through the parser


def filter_query(name: str, text: str, where: str, now: int = NOW) -> None:
    def run(x: Fixtures) -> DataFrame:
        q = asked(text, now)
        return S.filters(x.files(), q, x.tags(), index=x.index() if q.exclude else None).select("id", "path", "kind", "size", "mtime")

    run.__name__ = name
    query(f"{FILES}, {DUCK_TAGS} SELECT id, path, kind, size, mtime FROM f WHERE {where}")(run)


def duck_tagged(*tags: str) -> str:
    own = ", ".join(f"'{t}'" for t in tags)
    return f"hash IN (SELECT hash FROM t WHERE tag IN ({own}) AND source <> 'removed' AND (hash, tag) NOT IN (SELECT (hash, tag) FROM t WHERE source = 'removed'))"


ROOT = "project_id IS NULL"
filter_query("hide_projects", "anything", ROOT)
filter_query("filter_kind", "kind:pdf,images", "kind IN ('pdf', 'image')")
filter_query("filter_ext", "ext:.MD,csv", "ext IN ('md', 'csv')")
filter_query("filter_in_path", "in:~/src3", "path >= '/home/u/src3/' AND path < '/home/u/src30'")
filter_query("filter_in_folder", "in:SRC3/en", "path ILIKE '%/src3/en/%'")
filter_query("filter_modified", "modified:380d", f"{ROOT} AND mtime >= {NOW - 380 * 86400}")
filter_query("filter_modified_older", "modified:>380d", f"{ROOT} AND mtime < {NOW - 380 * 86400}")
filter_query("filter_after_before", "after:2024-01-10 before:2024-01-20", f"{ROOT} AND mtime >= 1704844800 AND mtime < 1705708800")
filter_query("filter_size", "size:4kb size:<20kb", f"{ROOT} AND size > 4096 AND size < 20480")
filter_query("filter_tag_any", "tag:quality,toxic", f"{ROOT} AND {duck_tagged('quality', 'toxic')}")
filter_query("filter_tag_all", "tag:quality tag:toxic", f"{ROOT} AND {duck_tagged('quality')} AND {duck_tagged('toxic')}")
filter_query("filter_exclude_word", "-src3 -pdf", f"{ROOT} AND NOT regexp_matches(path, 'src3\\d*(/|$)') AND ext <> 'pdf'")
filter_query("natural_last_week", "documents from last week", f"kind = 'doc' AND mtime >= {START + 5 * 86400}", START + 12 * 86400)
filter_query("natural_last_month", "pdfs from last 13 months", "kind = 'pdf' AND mtime >= epoch(TIMESTAMP '2025-02-04 00:00:00' - INTERVAL 13 MONTH)")
filter_query("natural_bigger_than", "documents bigger than 10 kb", "size > 10240 AND kind = 'doc'")


@query(f"{FILES} SELECT id, path FROM f WHERE {ROOT} ORDER BY mtime DESC, id LIMIT 20")
def browse_newest(x: Fixtures) -> DataFrame:
    return S.search_words(x.files(), asked(""), NOW, None).select("id", "path")


# Full text

INDEX = f"""{FILES}, ix AS (SELECT id, 0 AS field, list_concat({duck_tokens('name', False)}, {duck_tokens('name')}) AS l FROM f UNION ALL SELECT id, 1, {duck_tokens("regexp_replace(substr(path, 9), '/[^/]*$', '')")} FROM f UNION ALL SELECT id, 2, {duck_tokens('text')} FROM f),
tk AS (SELECT id, field, unnest(l) AS token, generate_subscripts(l, 1) AS place FROM ix), sz AS (SELECT id, sum(len(l)) AS d FROM ix GROUP BY id)"""


def duck_bm25(*terms: tuple[str, bool, str], limit: bool = False) -> str:
    """BM25 in SQL for terms as they must be read: (words, whether the last is whole, fields searched)."""
    ctes, score, found = [], "", ""
    for i, (words, exact, fields) in enumerate(terms):
        own = words.split()
        joins = "".join(f" JOIN tk w{k} ON w{k}.id = w0.id AND w{k}.field = w0.field AND w{k}.place = w0.place + {k}" for k in range(1, len(own)))
        where = " AND ".join(f"w{k}.token = '{w}'" if exact or k < len(own) - 1 else f"w{k}.token LIKE '{w}%'" for k, w in enumerate(own))
        ctes.append(f"h{i} AS (SELECT w0.id AS id, sum(CASE w0.field WHEN 0 THEN 10.0 ELSE 1.0 END) AS f, bool_or(w0.field < 2) AS named FROM tk w0{joins} WHERE w0.field IN ({fields}) AND {where} GROUP BY w0.id)")
        score += f" - greatest(ln(((SELECT count(*) FROM sz) - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * h{i}.f * 2.2 / (h{i}.f + 1.2 * (0.25 + 0.75 * d / (SELECT avg(d) FROM sz)))"
        found += f" JOIN h{i} USING (id) CROSS JOIN (SELECT count(*) AS n{i} FROM h{i})"
    named = " AND ".join(f"h{i}.named" for i in range(len(terms)))
    out = f"{INDEX}, {', '.join(ctes)}, z AS (SELECT id, f.project_id, f.mtime, 0{score} AS score, {named} AS by_name FROM sz JOIN f USING (id){found})"
    if not limit:
        return f"{out} SELECT id, round(score, 6) AS score, by_name FROM z"
    boost = f"score * CASE WHEN project_id IS NULL THEN 1.0 ELSE 0.3 END * (1 + 1 / (1 + greatest(0, {NOW} - mtime) / 604800.0))"
    return f"{out}, y AS (SELECT *, {boost} AS b FROM z WHERE {ROOT}) SELECT id, round(b, 6) AS rank_score, by_name FROM y ORDER BY by_name DESC, b, id LIMIT 20"


def fts_query(name: str, text: str, *terms: tuple[str, bool, str]) -> None:
    def run(x: Fixtures) -> DataFrame:
        return x.index().ranked(list(asked(text).terms)).select("id", F.round("score", 6).alias("score"), "by_name")

    run.__name__ = name
    query(duck_bm25(*terms))(run)


fts_query("fts_prefix", "ertion", ("ertion", False, "0, 1, 2"))
fts_query("fts_exact_phrase", '"of the"', ("of the", True, "0, 1, 2"))
fts_query("fts_prefix_phrase", "the-the", ("the the", False, "0, 1, 2"))
fts_query("fts_name_only", "name:doc", ("doc", False, "0"))
fts_query("fts_raw_name", "name:DOC1", ("doc 1", False, "0"))
fts_query("fts_whole_name", '"doc12"', ("doc 12", True, "0, 1, 2"))
fts_query("fts_and_terms", "the src1", ("the", False, "0, 1, 2"), ("src 1", False, "0, 1, 2"))
fts_query("fts_short_word", "en", ("en", False, "0, 1"))
fts_query("fts_bm25", "reth anti", ("reth", False, "0, 1, 2"), ("anti", False, "0, 1, 2"))


@query(duck_bm25(("that", False, "0, 1, 2"), ("with", False, "0, 1, 2"), limit=True))
def fts_ranked_boosted(x: Fixtures) -> DataFrame:
    return S.search_words(x.files(), asked("that with"), NOW, x.index()).select("id", F.round("rank_score", 6).alias("rank_score"), "by_name")


@query(f"{INDEX} SELECT token, count(DISTINCT id) AS files, count(*) AS places FROM tk WHERE field = 2 GROUP BY token")
def fts_postings_stats(x: Fixtures) -> DataFrame:
    return x.index().counts()


@query(f"""{INDEX}, c AS (SELECT * FROM tk WHERE id % 3 <> 0) SELECT token, field, id, place - 1 AS place FROM c WHERE field < 2""")
def fts_index_refresh(x: Fixtures) -> DataFrame:
    """The stored postings of names and folders after a third of the files went and some were read anew."""
    f = x.files(True)
    path = f"{scratch_root(x.spark)}/quern-index-{uuid.uuid4().hex}"
    fresh = x.index().refreshed(f.where("id % 3 = 1 and id % 5 = 0"), f.where("id % 3 = 0"), path, HOME)
    return fresh.postings.where("field < 2").select("token", "field", "id", "place")


# Vectors

PROBE = [((i * 37) % 64 - 32) / 150.0 for i in range(64)]
DUCK_DOT = f"list_inner_product(CAST(embedding AS DOUBLE[]), {PROBE}::DOUBLE[])"


@query(f"SELECT vec_id, round({DUCK_DOT}, 6) AS score FROM embeddings ORDER BY {DUCK_DOT} DESC, vec_id LIMIT 20")
def knn_topk(x: Fixtures) -> DataFrame:
    return S.nearest(x.vectors(), PROBE, 20, -9.0).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH h AS (SELECT vec_id, 'v' || (vec_id // 4) AS hash, {DUCK_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 400) SELECT hash, arg_max(vec_id, score) AS vec_id, round(max(score), 6) AS score FROM h GROUP BY hash""")
def knn_per_file_best(x: Fixtures) -> DataFrame:
    hits = S.nearest(x.vectors(), PROBE, 400, -9.0)
    return S.best_of_group(hits, "hash").select("hash", "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH h AS (SELECT vec_id, label, {DUCK_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100) SELECT vec_id, round(score, 6) AS score FROM h WHERE label < 3""")
def knn_filtered_after_topk(x: Fixtures) -> DataFrame:
    hits = S.nearest(x.vectors(), PROBE, 100, -9.0)
    return hits.join(x.table("embeddings").where("label < 3").select("vec_id"), "vec_id", "left_semi").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {DUCK_DOT} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_fusion(x: Fixtures) -> DataFrame:
    v = x.vectors()
    a = S.nearest(v, PROBE, 50, -9.0).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    b = v.withColumn("score", F.get("vector", F.lit(0))).orderBy(F.desc("score"), "vec_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return S.fuse(a.withColumnRenamed("vec_id", "id"), b.withColumnRenamed("vec_id", "id")).select("id", F.round("fused", 9).alias("fused"))


# Duplicates


def dupes_query(name: str, min_size: int) -> None:
    def run(x: Fixtures) -> DataFrame:
        return D.groups_of(D.same(x.files(), min_size), "same").select(F.col("key").alias("hash"), "n", "wasted", F.col("first.path").alias("first"))

    run.__name__ = name
    query(f"{FILES} SELECT hash, count(*) AS n, sum(size) - max(size) AS wasted, arg_min(path, (mtime, path)) AS first FROM f WHERE size >= {min_size} GROUP BY hash HAVING count(*) > 1")(run)


dupes_query("dupes_same", 16 * 1024)
dupes_query("dupes_same_small", 1)


@query(f"{FILES} SELECT hash, id FROM f WHERE size >= 1 AND size IN (SELECT size FROM f GROUP BY size HAVING count(*) > 1)")
def dupes_candidates(x: Fixtures) -> DataFrame:
    """The files that must be hashed, as others share their size."""
    return D.same(x.files(), 1).select(F.col("key").alias("hash"), "id")


#: Copy marks in SQL, and names that have one of many kinds.
MARKS = ["", " (1)", " - Copy", " copy", "_copy", "-copy", " copy 2", " (12) copy", "的副本"]
DUCK_MARK = r"( \([0-9]+\)| - copy| copy [0-9]*| copy|_copy|-copy|的副本| 副本)"
DUCK_MARKED = f"""{FILES}, p AS (SELECT id, path, mtime, size, hash, 'Report' || (id // 40) || ([{', '.join(f"'{m}'" for m in MARKS)}])[id % 9 + 1] || '.' || ext AS name, ext FROM f),
g0 AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[.][a-z]+$', ''), '{DUCK_MARK}( |{DUCK_MARK})*$', '') || '.' || ext AS plain FROM p)"""


def marked_files(x: Fixtures) -> DataFrame:
    mark = F.get(F.array(*map(F.lit, MARKS)), (F.col("id") % 9).cast("int"))
    name = F.concat(F.lit("Report"), F.floor(F.col("id") / 40).cast("string"), mark, F.lit("."), "ext")
    return x.files().withColumn("name", name)


@query(f"{DUCK_MARKED} SELECT id, plain FROM g0")
def plain_name(x: Fixtures) -> DataFrame:
    return marked_files(x).select("id", T.plain_name(F.col("name")).alias("plain"))


@query(f"""{DUCK_MARKED} SELECT plain, count(*) AS n, sum(size) - max(size) AS wasted FROM g0 GROUP BY plain HAVING count(*) > 1 AND bool_or(plain <> lower(name)) AND count(DISTINCT hash) > 1""")
def dupes_names(x: Fixtures) -> DataFrame:
    return D.groups_of(D.names(marked_files(x)), "names").select(F.col("key").alias("plain"), "n", "wasted")


@query(f"{FILES} SELECT count(*) AS groups, sum(w) AS wasted FROM (SELECT sum(size) - max(size) AS w FROM f GROUP BY hash HAVING count(*) > 1)")
def wasted_total(x: Fixtures) -> DataFrame:
    return D.groups_of(D.same(x.files(), 1), "same").agg(F.count("*").alias("groups"), F.sum("wasted").alias("wasted"))


@query(f"""{DUCK_MARKED}, m AS (SELECT 'same' AS likeness, 0 AS rank, hash AS key, path, name, mtime, size FROM p UNION ALL
 SELECT 'names', 2, plain, path, name, mtime, size FROM g0 WHERE plain IN (SELECT plain FROM g0 GROUP BY plain HAVING bool_or(plain <> lower(name)) AND count(DISTINCT hash) > 1)),
g AS (SELECT likeness, rank, key, count(*) AS n, sum(size) - max(size) AS wasted, arg_min(path, (mtime, path)) AS first, arg_min(name, (mtime, path)) AS first_name FROM m WHERE size >= 1 GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY wasted DESC, rank, first) AS group_rank FROM g), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY group_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT c.likeness, c.wasted, c.group_rank, m.path, m.mtime, CASE WHEN m.path <> c.first THEN CASE c.likeness WHEN 'same' THEN 'Copy of ' ELSE 'Named like ' END || c.first_name
 ELSE CASE c.likeness WHEN 'same' THEN 'Same content' ELSE 'Same name' END || ' · ' || c.n || ' files · ' || CASE WHEN c.wasted < 1024 THEN c.wasted || ' B' WHEN c.wasted < 1048576 THEN printf('%.1f KB', c.wasted / 1024.0) ELSE printf('%.1f MB', c.wasted / 1048576.0) END || ' spare' END AS caption
FROM c JOIN m ON m.key = c.key AND m.likeness = c.likeness WHERE c.before < 15""")
def dupes_flatten_limit(x: Fixtures) -> DataFrame:
    files = marked_files(x)
    return D.flattened({"same": D.same(files, 1), "names": D.names(files)}, 15)


DUCK_BITS = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'phash' ELSE 'phash-video' END AS algo, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT *, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS med FROM e),
b AS (SELECT id, algo, CAST(list_aggregate(list_transform(v, lambda x: CASE WHEN x > med THEN '1' ELSE '0' END), 'string_agg', '') AS BIT) AS raw FROM m), pr AS (SELECT id, algo, CAST(raw AS BIGINT) AS bits, 'v' || (id // 4) AS hash, CASE WHEN id % 2 = 1 THEN (id % 50) * 2.0 END AS duration FROM b)"""
DUCK_ALIKE = "a.algo = b.algo AND a.hash <> b.hash AND coalesce(abs(a.duration - b.duration) <= greatest(2, 0.02 * greatest(a.duration, b.duration)), true)"


@query(f"{DUCK_BITS} SELECT id, algo, bits FROM pr")
def phash_bits(x: Fixtures) -> DataFrame:
    return x.prints().select("id", "algo", "bits")


@query(f"{DUCK_BITS} SELECT bit_count(xor(a.bits, b.bits)) AS distance, count(*) AS n FROM pr a JOIN pr b ON {DUCK_ALIKE} AND a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 18 GROUP BY 1")
def hamming_histogram(x: Fixtures) -> DataFrame:
    return D.alike_pairs(x.prints(), 18).groupBy("distance").agg(F.count("*").alias("n"))


@query(f"""{DUCK_BITS.replace("WITH e", "WITH RECURSIVE e")}, ed AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.bits, b.bits)) AS d FROM pr a JOIN pr b ON {DUCK_ALIKE} AND a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 20),
u AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node), w AS (SELECT c.component, max(ed.d) AS bits FROM ed JOIN c ON c.node = ed.a GROUP BY 1) SELECT c.node AS id, component, bits FROM c JOIN w USING (component)""")
def dupes_looks(x: Fixtures) -> DataFrame:
    return D.looks(x.prints(), 20)


@query(f"""{DUCK_BITS} SELECT b.id, b.algo, CASE WHEN a.hash = b.hash THEN 0 ELSE bit_count(xor(a.bits, b.bits)) END AS distance FROM pr a JOIN pr b ON a.algo = b.algo AND a.id = 4 AND b.id <> 4
 AND (a.hash = b.hash OR bit_count(xor(a.bits, b.bits)) <= 24) AND coalesce(abs(a.duration - b.duration) <= greatest(2, 0.02 * greatest(a.duration, b.duration)), true)""")
def similar_to(x: Fixtures) -> DataFrame:
    p = x.prints()
    return D.similar_to(p, p.where("id = 4"), 24)


@query(f"{FILES}, me AS (SELECT hash, id FROM f WHERE id = (SELECT min(id) FROM f WHERE hash IN (SELECT hash FROM f GROUP BY hash HAVING count(*) > 1))) SELECT f.id, 0 AS distance FROM f JOIN me USING (hash) WHERE f.id <> me.id")
def similar_copies(x: Fixtures) -> DataFrame:
    """Without fingerprints, what is similar to a file are its exact copies."""
    f = x.files()
    path = f.join(f.groupBy("hash").count().where("count > 1"), "hash").orderBy("id").first()["path"]
    return D.similar_files(f, x.prints().select("hash", "algo", "bits", "duration"), path, 8).select("id", "distance")


@query(f"""{DUCK_BITS}, a AS (SELECT *, unnest(range(0, 10)) AS i FROM (SELECT id, 20.0 * (id % 7) AS base FROM pr)) SELECT id, i, abs(base - (base + i / 2.0)) <= greatest(2, 0.02 * greatest(base, base + i / 2.0)) AS same FROM a""")
def similar_length(x: Fixtures) -> DataFrame:
    a = x.prints().select("id", (20.0 * (F.col("id") % 7)).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("i"))
    return a.select("id", "i", D.similar_length(F.col("base"), F.col("base") + F.col("i") / 2.0).alias("same"))


# Tags


FILE_TAGS = "ft AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'quality' ELSE 'starred' END AS tag FROM f WHERE id % 3 = 0)"


def file_tags(x: Fixtures) -> DataFrame:
    return x.files().where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "quality").otherwise("starred").alias("tag"))


@query(f"""{FILES}, {DUCK_TAGS}, {FILE_TAGS}, g AS (SELECT f.id, t.tag FROM f JOIN t USING (hash) WHERE t.source <> 'removed' UNION SELECT id, tag FROM ft), r AS (SELECT f.id, t.tag FROM f JOIN t USING (hash) WHERE t.source = 'removed')
SELECT id, list(tag ORDER BY tag) AS tags FROM (SELECT * FROM g EXCEPT SELECT * FROM r) GROUP BY id""")
def tags_of_file(x: Fixtures) -> DataFrame:
    return G.of_files(x.files(), x.tags(), file_tags(x))


@query(f"""{FILES}, {DUCK_TAGS}, {FILE_TAGS} SELECT id FROM f WHERE {ROOT} AND (id IN (SELECT id FROM ft WHERE tag = 'quality') OR {duck_tagged('quality')})""")
def filter_tag_of_file(x: Fixtures) -> DataFrame:
    """A tag of the file itself matches even where it was taken off its content."""
    return S.filters(x.files(), asked("tag:quality"), x.tags(), file_tags(x)).select("id")


@query(f"WITH {DUCK_TAGS} SELECT tag, count(*) AS n FROM t WHERE source = 'manual' GROUP BY tag")
def manual_tag_counts(x: Fixtures) -> DataFrame:
    return G.manual_counts(x.tags())


@query(f"""{FILES}, {DUCK_TAGS}, s AS (SELECT DISTINCT hash FROM f WHERE id % 5 = 0) SELECT hash, tag, source FROM t WHERE NOT (tag = 'quality' AND source IN ('manual', 'removed') AND hash IN (SELECT hash FROM s)) UNION ALL SELECT hash, 'quality', 'removed' FROM s""")
def tag_by_hand(x: Fixtures) -> DataFrame:
    return G.set_by_hand(x.tags(), x.files().where("id % 5 = 0").select("hash", F.lit(" #Quality ").alias("tag")), False).select("hash", "tag", "source")


@query(f"""{FILES}, n AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Screenshot ' || id || '.png' WHEN id % 7 = 1 THEN '截圖' || id || '.png' ELSE 'p' || id || '.png' END AS name, CASE WHEN id % 5 = 0 THEN 'My Screenshots' ELSE 'pics' END AS folder FROM f),
p AS (SELECT id, ['Cargo.toml', 'package.json', 'deno.json', 'notes.txt', 'build.gradle.kts'][id % 5 + 1] AS marker FROM f)
SELECT id, 'screenshot' AS tag FROM n WHERE id % 7 < 2 OR id % 5 = 0 UNION ALL
SELECT -1 - id % 10, unnest(CASE WHEN id % 5 = 0 THEN ['rust'] WHEN id % 5 = 1 THEN ['javascript'] WHEN id % 5 = 2 THEN ['typescript'] WHEN id % 5 = 4 THEN ['kotlin'] ELSE [] END) FROM (SELECT DISTINCT id % 10 AS id FROM p)""")
def tags_by_rule(x: Fixtures) -> DataFrame:
    k = F.col("id")
    f = x.files().select("id")
    name = F.when(k % 7 == 0, F.concat(F.lit("Screenshot "), k.cast("string"), F.lit(".png"))).when(k % 7 == 1, F.concat(F.lit("截圖"), k.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("p"), k.cast("string"), F.lit(".png")))
    folder = F.when(k % 5 == 0, "/home/u/My Screenshots/").otherwise("/home/u/pics/")
    pictures = f.select("id", F.concat(folder, name).alias("path"), name.alias("name"), F.lit("image").alias("kind"))
    place = F.concat(F.lit("/home/u/code/p"), (k % 10).cast("string"))
    marker = F.get(F.array(*map(F.lit, ["Cargo.toml", "package.json", "deno.json", "notes.txt", "build.gradle.kts"])), (k % 5).cast("int"))
    inside = f.select((k + 1_000_000_000).alias("id"), F.concat(place, F.lit("/"), marker).alias("path"), marker.alias("name"), F.lit("code").alias("kind"))
    projects = f.select((-1 - k % 10).alias("id"), place.alias("path"), F.concat(F.lit("p"), (k % 10).cast("string")).alias("name"), F.lit("project").alias("kind")).distinct()
    return G.by_rule(pictures.unionByName(inside).unionByName(projects))


@query(f"""WITH {DUCK_OUTPUTS} SELECT DISTINCT hash, tag, source, 1.0::DOUBLE AS score FROM (SELECT hash, unnest(tags) AS tag, 'plugin' AS source FROM o WHERE error IS NULL UNION ALL SELECT hash, unnest(labels), 'plugin-label' FROM o WHERE error IS NULL)""")
def tags_by_processors(x: Fixtures) -> DataFrame:
    return G.by_processors(x.outputs())


@query(f"""WITH {DUCK_TAGS} SELECT tag FROM (SELECT tag, 0 AS rank, count(*) AS n FROM t WHERE source = 'manual' GROUP BY tag UNION ALL SELECT * FROM (VALUES ('quarterly', 1, 0), ('quote', 1, -1), ('receipt', 1, -2)) AS l(tag, rank, n)) WHERE starts_with(tag, 'qu') AND tag <> 'quote' ORDER BY rank, n DESC, tag LIMIT 5""")
def tags_suggested(x: Fixtures) -> DataFrame:
    return G.suggested(x.tags(), ["quarterly", "quote", "receipt"], "#QU", ["quote"])


@query(f"SELECT doc_id, list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: regexp_replace(trim(lower(regexp_replace(trim(x), '^#+', ''))), '\\s+', '-', 'g')), lambda x: x <> '')) AS tags FROM (SELECT doc_id, ' Work,, #' || lang || ' Docs ,work' AS s FROM documents)".replace("list_distinct(", "list_sort(list_distinct(").replace("lambda x: x <> ''))", "lambda x: x <> '')))"))
def tags_carried(x: Fixtures) -> DataFrame:
    raw = F.concat(F.lit(" Work,, #"), "lang", F.lit(" Docs ,work"))
    return x.table("documents").select("doc_id", F.sort_array(G.carried(raw)).alias("tags"))


# What processors say


DUCK_SAID = f"""{DUCK_OUTPUTS}, sx AS (SELECT hash, processor, list_filter([text, array_to_string([t for t in raw if len(tags) > 0], ', ')], lambda x: trim(x) <> '') AS parts FROM o WHERE error IS NULL),
sd AS (SELECT hash, array_to_string(flatten(list(parts ORDER BY processor)), chr(10)) AS text FROM sx GROUP BY hash HAVING len(flatten(list(parts))) > 0)"""
DUCK_OLD = "ex AS (SELECT sha256(text) AS hash, CASE WHEN doc_id % 12 = 0 THEN 'old' ELSE 'seen in ' || source END AS text, 3 AS version FROM (SELECT DISTINCT ON (sha256(text)) * FROM documents ORDER BY sha256(text), doc_id) WHERE doc_id % 6 = 0)"


def old_extras(x: Fixtures) -> DataFrame:
    d = x.table("documents").withColumn("hash", F.sha2("text", 256))
    once = d.groupBy("hash").agg(F.min(F.struct("doc_id", "source")).alias("d")).select("hash", "d.doc_id", "d.source").where("doc_id % 6 = 0")
    return once.select("hash", F.when(F.col("doc_id") % 12 == 0, "old").otherwise(F.concat(F.lit("seen in "), "source")).alias("text"), F.lit(3).cast("long").alias("version"))


@query(f"WITH {DUCK_SAID} SELECT hash, text FROM sd")
def extras_said(x: Fixtures) -> DataFrame:
    return E.said(x.outputs())


@query(f"""WITH {DUCK_SAID}, {DUCK_OLD}, th AS (SELECT DISTINCT hash FROM o), a AS (SELECT coalesce(ex.hash, th.hash) AS hash, ex.text AS old, ex.version, th.hash IS NOT NULL AS touched, sd.text AS new FROM ex FULL JOIN th ON th.hash = ex.hash LEFT JOIN sd ON sd.hash = coalesce(ex.hash, th.hash))
SELECT hash, CASE WHEN touched THEN new ELSE old END AS text, CASE WHEN version IS NULL THEN 1 WHEN touched AND new <> old THEN version + 1 ELSE version END AS version FROM a WHERE CASE WHEN touched THEN new ELSE old END IS NOT NULL""")
def extras_upsert(x: Fixtures) -> DataFrame:
    return E.next_extras(old_extras(x), x.outputs(), x.outputs().select("hash"))


@query(f"WITH {DUCK_SAID}, {DUCK_OLD} SELECT coalesce(ex.hash, sd.hash) AS hash FROM ex FULL JOIN sd ON ex.hash = sd.hash WHERE ex.text IS DISTINCT FROM sd.text")
def extras_changed(x: Fixtures) -> DataFrame:
    """Contents whose files are indexed again."""
    return E.changed_hashes(old_extras(x), E.said(x.outputs()))


@query(f"""WITH {DUCK_OLD}, ct AS (SELECT DISTINCT sha256(text) AS hash, text, 65536 AS text_limit FROM documents WHERE doc_id % 4 <> 0)
SELECT hash, full_text, policy FROM (SELECT ct.hash, trim(coalesce(ct.text, '') || coalesce(chr(10) || ex.text, ''), ' ') AS full_text, ct.text_limit || '/' || coalesce(ex.version, 0) AS policy FROM ct LEFT JOIN ex USING (hash) UNION ALL SELECT hash, text, '0/' || version FROM ex WHERE hash NOT IN (SELECT hash FROM ct)) WHERE full_text <> ''""")
def full_texts(x: Fixtures) -> DataFrame:
    contents = x.files(True).where("id % 4 <> 0").select("hash", "text", F.lit(65536).alias("text_limit")).distinct()
    return E.full_texts(contents, old_extras(x)).withColumnRenamed("text", "full_text")


# Labels

LABELLED = [[((i * (k + 3) * 7) % 64 - 32) / 150.0 for i in range(64)] for k in range(4)]


@query(f"""WITH l AS (SELECT * FROM (VALUES {", ".join(f"('label{k}', {v}::DOUBLE[])" for k, v in enumerate(LABELLED))}) AS l(name, q)),
s AS (SELECT 'v' || (vec_id // 4) AS hash, l.name AS label, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings, l),
r AS (SELECT *, row_number() OVER (PARTITION BY hash, label ORDER BY d DESC) AS i FROM s), m AS (SELECT hash, label, avg(d) AS score FROM r WHERE i <= 3 GROUP BY ALL),
n AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS next FROM m WINDOW w AS (PARTITION BY hash ORDER BY score DESC, label)) SELECT hash, label, round(score, 6) AS score FROM n WHERE i = 1 AND score >= 0.15 AND score - next >= 0.03""")
def label_by_meaning(x: Fixtures) -> DataFrame:
    from quern.operators.labels import by_description

    return by_description(x.vectors(), {f"label{k}": v for k, v in enumerate(LABELLED)}, 0.15).select("hash", "label", F.round("score", 6).alias("score"))


# Providers


@query("""WITH h AS (SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 1 + page_id % 17 AS visits, page_id % 3 AS typed, page_id % 3 AS profile FROM pages), k AS (SELECT *, visits + 2 * typed AS score FROM h WHERE contains(lower(title), 'the') OR contains(lower(url), 'the')),
p AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, id DESC) AS r FROM k) SELECT id, url, score FROM p WHERE r <= 60 ORDER BY score DESC, id DESC LIMIT 20""")
def history_search(x: Fixtures) -> DataFrame:
    from quern.operators.providers import history

    return history(x.history(), ["the"], 20).select("id", "url", "score")


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS pid, CASE WHEN c_custkey // 3 > 0 THEN c_custkey // 3 END AS parent, floor(abs(c_acctbal) * 1000) AS memory FROM customer), a AS (SELECT pid, pid AS top FROM p UNION ALL SELECT a.pid, p.parent FROM a JOIN p ON p.pid = a.top WHERE p.parent IS NOT NULL)
SELECT a.top AS pid, count(*) AS processes, sum(p.memory) AS memory FROM a JOIN p ON p.pid = a.pid GROUP BY a.top""")
def process_tree(x: Fixtures) -> DataFrame:
    from quern.operators.providers import subtree_totals

    return subtree_totals(x.processes()).select("pid", "processes", "memory")


# Maintenance and streams


@query(f"""{FILES}, o AS (SELECT * FROM f WHERE id % 5 <> 0), n AS (SELECT id, path, CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END AS size, mtime FROM f WHERE id % 11 <> 0)
SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN o.size IS DISTINCT FROM n.size OR o.mtime IS DISTINCT FROM n.mtime THEN 'changed' ELSE 'same' END AS state FROM o FULL OUTER JOIN n USING (path)""")
def scan_diff(x: Fixtures) -> DataFrame:
    from quern.operators.ingest import changes

    f = x.files()
    return changes(f.where("id % 5 <> 0"), f.where("id % 11 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))).select("path", "state")


@query(f"{FILES} SELECT id, path FROM f WHERE NOT (path = '/home/u/src3' OR (path >= '/home/u/src3/' AND path < '/home/u/src30'))")
def private_exclusion(x: Fixtures) -> DataFrame:
    from quern.operators.ingest import outside

    return outside(x.files(), ["/home/u/src3"]).select("id", "path")


@query()
def chunk_ranges(x: Fixtures) -> DataFrame:
    from quern.functions.passages import chunk_ranges

    return x.table("documents").select("doc_id", F.posexplode(chunk_ranges(F.col("text"))).alias("chunk", "range")).select("doc_id", "chunk", "range.start", "range.end")


def duck_line(text: str, *wanted: str) -> str:
    """The answering line in SQL."""
    hits = lambda x: " + ".join(f"CAST(contains(' ' || lower({duck_words(x)}), ' {w}') AS INT)" for w in wanted)
    return f"""l AS (SELECT id, u.line, u.i FROM ({text}), LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u),
b AS (SELECT id, arg_min(line, (-n, i)) AS line, max(n) AS n FROM (SELECT *, {hits('line')} AS n FROM l) GROUP BY id),
p AS (SELECT id, n, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS p FROM b),
q AS (SELECT id, n, p, CASE WHEN length(array_to_string(p, ' ')) > 160 THEN greatest(list_position(list_transform(p, lambda x: {hits('x')} > 0), true) - 4, 0) ELSE 0 END AS skip FROM p),
s AS (SELECT id, n, CASE WHEN skip > 0 THEN '… ' ELSE '' END || array_to_string(p[skip + 1:], ' ') AS line FROM q) SELECT id, CASE WHEN n > 0 THEN CASE WHEN length(line) > 160 THEN line[:160] || '…' ELSE line END END AS line FROM s"""


@query(f"{FILES}, {duck_line('SELECT id, text FROM f', 'that', 'with')}")
def fts_snippet(x: Fixtures) -> DataFrame:
    from quern.functions.passages import snippet

    return x.files(True).select("id", snippet(F.col("text"), ["that", "with"]).alias("line"))


@query("""WITH v AS (SELECT 'v' || (vec_id // 4) AS hash, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT hash, i, sum(x) AS x FROM v GROUP BY ALL),
m AS (SELECT hash, i, x / sqrt(sum(x * x) OVER (PARTITION BY hash)) AS x FROM s), t AS (SELECT DISTINCT 'v' || (vec_id // 4) AS hash, 'label' || label AS label FROM embeddings WHERE label < 4 AND vec_id % 10 = 0),
e AS (SELECT * FROM t WHERE label IN (SELECT label FROM t GROUP BY label HAVING count(*) > 1)), c0 AS (SELECT label, i, sum(x) AS x FROM e JOIN m USING (hash) GROUP BY ALL), c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM c0),
d AS (SELECT m.hash, c.label, sum(m.x * c.x) AS d FROM m JOIN c USING (i) GROUP BY ALL), r AS (SELECT label, min(d) AS radius FROM d JOIN e USING (hash, label) GROUP BY label) SELECT hash, label, round(d, 6) AS score FROM d JOIN r USING (label) WHERE d >= greatest(radius, 0.3) - 1e-12""")
def label_by_example(x: Fixtures) -> DataFrame:
    from quern.operators.labels import by_example

    e = x.table("embeddings").where("label < 4 and vec_id % 10 = 0")
    tags = e.select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 4).cast("string")).alias("hash"), F.concat(F.lit("label"), "label").alias("tag"), F.lit("manual").alias("source")).distinct()
    return by_example(x.vectors(), tags, 0.3).select("hash", "label", F.round("score", 6).alias("score"))


def policy_of(limit: int, version: int) -> str:
    """What a content was read with; another limit or version makes its vectors stale."""
    return f"lines-1/{limit}/{version}"


@query(f"{FILES} SELECT hash, min(kind) AS kind FROM f WHERE hash NOT IN (SELECT hash FROM f WHERE id % 3 = 0) GROUP BY hash")
def pending_embeddings(x: Fixtures) -> DataFrame:
    from quern.operators.ingest import pending

    policy = policy_of(65_536, 0)
    done = x.files().where("id % 3 = 0").select("hash", F.lit(policy).alias("policy"))
    return pending(x.files(), done, policy).select("hash", "kind")


@query(f"""{FILES}, c AS (SELECT DISTINCT hash, CASE WHEN id % 2 = 0 THEN 100 END AS unused FROM f WHERE id % 10 <> 0 AND hash NOT IN (SELECT hash FROM f GROUP BY hash HAVING count(*) > 1)),
l AS (SELECT DISTINCT hash FROM f WHERE id % 4 <> 0) SELECT hash, CASE WHEN hash IN (SELECT hash FROM l) THEN NULL ELSE coalesce(unused, {NOW}) END AS unused_since FROM c WHERE hash IN (SELECT hash FROM l) OR coalesce(unused, {NOW}) > {NOW} - 2592000""")
def cache_gc_sweep(x: Fixtures) -> DataFrame:
    from quern.operators.ingest import collected

    f = x.files()
    once = f.groupBy("hash").count().where("count = 1").select("hash")
    cache = f.where("id % 10 <> 0").join(once, "hash", "left_semi").select("hash", F.when(F.col("id") % 2 == 0, F.lit(100).cast("long")).alias("unused_since"))
    return collected(cache, f.where("id % 4 <> 0"), NOW).select("hash", "unused_since")


from quern.plans import lists, upkeep  # noqa: E402, F401  (they register theirs)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

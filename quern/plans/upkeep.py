"""Registered queries of ingestion, meaning, fingerprints and streams, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import passages as A
from quern.functions.fingerprint import with_phash
from quern.operators import dupes as D
from quern.operators import ingest as I
from quern.operators import meaning as M
from quern.plans.fixtures import DUCK_OUTPUTS, HOME, Fixtures
from quern.plans.queries import DUCK_DOT, FILES, PROBE, duck_line, query
from quern.streaming import watch as W
from quern.streaming.debounce import capped_batches, quiet_runs

# Ingestion

TWO_SCANS = f"""{FILES}, o AS (SELECT *, 65536 AS text_limit FROM f WHERE id % 5 <> 0), n AS (SELECT *, CASE WHEN id % 13 = 0 THEN 4096 ELSE 65536 END AS text_limit, CASE WHEN id % 7 = 0 THEN mtime + 1 ELSE mtime END AS m2 FROM f WHERE id % 11 <> 0),
st AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN o.mtime <> n.m2 OR o.text_limit <> n.text_limit THEN 'changed' ELSE 'same' END AS state FROM o FULL OUTER JOIN n USING (path))"""


def two_scans(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    f = x.files()
    old = f.where("id % 5 <> 0").withColumn("text_limit", F.lit(65536))
    new = f.where("id % 11 <> 0").withColumn("text_limit", F.when(F.col("id") % 13 == 0, 4096).otherwise(65536)).withColumn("mtime", F.when(F.col("id") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return old, new


@query(f"{TWO_SCANS} SELECT path, state FROM st")
def scan_text_limit(x: Fixtures) -> DataFrame:
    """A file that is read with another limit than before is a changed one."""
    return I.changes(*two_scans(x)).select("path", "state")


@query(f"{TWO_SCANS} SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'same') AS same, count(*) FILTER (state = 'gone') AS gone, count(*) FILTER (state <> 'gone') AS files FROM st")
def scan_counts(x: Fixtures) -> DataFrame:
    return I.scan_counts(I.changes(*two_scans(x)))


@query(f"{TWO_SCANS} SELECT id, path, size FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT id, path, size + 1 FROM n")
def scan_merge(x: Fixtures) -> DataFrame:
    old, new = two_scans(x)
    return I.merged(old.select("id", "path", "size"), new.select("id", "path", (F.col("size") + 1).alias("size")), "path")


@query(f"{FILES}, s AS (SELECT id, id % 4 AS scan_id FROM f) SELECT id FROM s WHERE scan_id = 3")
def scan_sweep(x: Fixtures) -> DataFrame:
    return I.swept(x.files().select("id", (F.col("id") % 4).alias("scan_id")), 3).select("id")


@query(f"{FILES} SELECT max(id % 4) + 1 AS scan_id FROM f")
def scan_next(x: Fixtures) -> DataFrame:
    return I.next_scan(x.files().select((F.col("id") % 4).alias("scan_id")))


@query(f"{FILES}, c AS (SELECT DISTINCT hash FROM f WHERE id % 3 = 0 AND id % 2 = 0) SELECT hash, min(path) AS path FROM f WHERE level >= 2 AND hash NOT IN (SELECT hash FROM c) GROUP BY hash")
def contents_unread(x: Fixtures) -> DataFrame:
    """One file of each content that must be read; those kept at another limit are read again."""
    f = x.files()
    kept = f.where("id % 3 = 0").groupBy("hash").agg(F.max(F.when(F.col("id") % 2 == 0, 65536).otherwise(1024)).alias("text_limit"))
    return I.unread(f.where("level >= 2"), kept, 65536).select("hash", "path")


@query(f"{FILES} SELECT id, CASE WHEN path >= '/home/u/src3/' AND path < '/home/u/src30' THEN -1 ELSE mtime * 1000000000 END AS mtime_ns FROM f")
def forget_marks(x: Fixtures) -> DataFrame:
    return I.forgotten(x.files().withColumn("mtime_ns", F.col("mtime") * 1_000_000_000), "/home/u/src3").select("id", "mtime_ns")


@query(f"{FILES}, fr AS (SELECT DISTINCT CASE WHEN id % 9 = 0 THEN 'cache' || id ELSE hash END AS name, id FROM f WHERE id % 2 = 0), l AS (SELECT hash FROM f WHERE id % 3 <> 0) SELECT DISTINCT name FROM fr WHERE name NOT LIKE 'cache%' AND name NOT IN (SELECT hash FROM l)")
def frames_unused(x: Fixtures) -> DataFrame:
    f = x.files()
    frames = f.where("id % 2 = 0").select(F.when(F.col("id") % 9 == 0, F.concat(F.lit("cache"), F.col("id").cast("string"))).otherwise(F.col("hash")).alias("name")).distinct()
    return I.unused_frames(frames, f.where("id % 3 <> 0"))


@query(f"{FILES.replace('WITH', 'WITH ' + DUCK_OUTPUTS + ',', 1)} SELECT path, mtime FROM f WHERE level >= 2 AND kind IN ('doc', 'pdf') AND hash NOT IN (SELECT hash FROM o WHERE processor = 'describe')")
def processor_queue(x: Fixtures) -> DataFrame:
    return I.queue(x.files(), x.outputs().withColumn("version", F.lit(1)), "describe", 1, ["doc", "pdf"]).select("path", "mtime")


@query(f"{FILES.replace('WITH', 'WITH ' + DUCK_OUTPUTS + ',', 1)} SELECT hash, processor, CASE WHEN hash IN (SELECT hash FROM f WHERE id % 5 = 0) AND processor = 'alt' THEN 'anew' ELSE text END AS text FROM o UNION ALL SELECT DISTINCT hash, 'alt', 'anew' FROM f WHERE id % 5 = 0 AND hash NOT IN (SELECT hash FROM o WHERE processor = 'alt')")
def outputs_upsert(x: Fixtures) -> DataFrame:
    fresh = x.files().where("id % 5 = 0").select("hash", F.lit("alt").alias("processor"), F.lit("anew").alias("text")).distinct()
    return I.upserted(x.outputs().select("hash", "processor", "text"), fresh, ["hash", "processor"])


# Meaning


@query(f"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'sheet' ELSE 'doc' END AS kind, unnest([0, 400]) AS start FROM documents WHERE strlen(text) = length(text) AND length(text) > 800)
SELECT doc_id, start, CASE WHEN kind = 'sheet' AND start > 0 THEN string_split(text, chr(10))[1] || chr(10) ELSE '' END || trim(substr(text, start + 1, 300)) AS passage FROM d""")
def passages_read(x: Fixtures) -> DataFrame:
    d = x.table("documents").where("octet_length(text) = length(text) and length(text) > 800")
    kind = F.when(F.col("doc_id") % 2 == 0, "sheet").otherwise("doc").alias("kind")
    chunks = d.select("doc_id", "text", kind, F.explode(F.array(F.lit(0), F.lit(400))).alias("start")).withColumn("end", F.col("start") + 300)
    return M.passages(chunks).select("doc_id", "start", "passage")


@query(f"WITH d AS (SELECT doc_id AS id, substr(text, 101, 500) AS text FROM documents WHERE strlen(text) = length(text)), {duck_line('SELECT id, text FROM d', 'that', 'with').rpartition(' SELECT id, CASE')[0]}, fl AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1] AS first FROM d) SELECT s.id, CASE WHEN n > 0 THEN CASE WHEN length(line) > 160 THEN line[:160] || '…' ELSE line END WHEN length(first) > 160 THEN first[:160] || '…' ELSE first END AS line FROM s JOIN fl USING (id)")
def meaning_snippet(x: Fixtures) -> DataFrame:
    d = x.table("documents").where("octet_length(text) = length(text)")
    return d.select(F.col("doc_id").alias("id"), A.chunk_line(F.col("text"), F.lit(100), F.lit(600), ["that", "with"]).alias("line"))


NAMES = f"{FILES}, nm AS (SELECT DISTINCT name FROM f WHERE id % 3 = 0)"


@query(f"{NAMES}, em AS (SELECT hash, '65536/' || (id % 2) AS policy FROM f WHERE id % 4 = 0) SELECT (SELECT count(DISTINCT name) FROM f WHERE level >= 3 AND name NOT IN (SELECT name FROM nm)) AS names, (SELECT count(DISTINCT hash) FROM f WHERE level >= 3 AND NOT EXISTS (SELECT 1 FROM em WHERE em.hash = f.hash AND em.policy = '65536/0')) AS files")
def pending_counts(x: Fixtures) -> DataFrame:
    f = x.files()
    texts = f.select("hash", F.lit("65536/0").alias("policy")).distinct()
    embedded = f.where("id % 4 = 0").select(F.lit("m").alias("model"), "hash", F.concat(F.lit("lines-1/65536/"), (F.col("id") % 2).cast("string")).alias("policy"))
    names = f.where("id % 3 = 0").select(F.lit("m").alias("model"), "name")
    return M.pending_counts(f, texts, embedded, names, "m")


@query(f"{NAMES} SELECT DISTINCT name FROM f WHERE level >= 3 AND name NOT IN (SELECT name FROM nm)")
def pending_names(x: Fixtures) -> DataFrame:
    f = x.files()
    return M.pending_names(f, f.where("id % 3 = 0").select(F.lit("m").alias("model"), "name"), "m")


@query(f"""WITH v AS (SELECT vec_id, 'v' || (vec_id // 4) AS hash, {DUCK_DOT} AS score FROM embeddings), a AS (SELECT vec_id, hash, NULL AS name, vec_id % 4 AS start, score FROM v WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, NULL, 'n' || vec_id, NULL, score FROM v WHERE vec_id % 3 = 0),
h AS (SELECT * FROM a WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 400), f AS (SELECT vec_id AS id, 'v' || (vec_id % 500) AS hash, 'n' || (vec_id * 2 % 900) AS name, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 3 END AS level FROM embeddings),
m AS (SELECT f.id, h.score, h.start FROM f JOIN h ON h.hash = f.hash WHERE level >= 3 UNION ALL SELECT f.id, h.score, NULL FROM f JOIN h ON h.name = f.name WHERE level >= 3) SELECT id, round(max(score), 6) AS score, arg_max(coalesce(start, -1), score) AS start FROM m GROUP BY id""")
def meaning_files(x: Fixtures) -> DataFrame:
    """Files by the best of their text's chunks and their name."""
    v = x.vectors()
    k = F.col("vec_id")
    chunks = v.where(k % 3 != 0).select("hash", F.col("chunk").cast("int").alias("start"), (F.col("chunk") + 1).cast("int").alias("end"), "vector")
    names = v.where(k % 3 == 0).select(F.concat(F.lit("n"), k.cast("string")).alias("name"), "vector")
    files = v.select(k.alias("id"), F.concat(F.lit("v"), (k % 500).cast("string")).alias("hash"), F.concat(F.lit("n"), (k * 2 % 900).cast("string")).alias("name"), F.when(k % 5 == 0, 2).otherwise(3).alias("level"))
    return M.near_files(files, chunks, names, PROBE, 0.1).select("id", F.round("score", 6).alias("score"), F.coalesce("start", F.lit(-1)).alias("start"))


@query(f"{FILES} SELECT vec_id FROM embeddings WHERE vec_id // 4 IN (SELECT id FROM f WHERE id % 3 = 0)")
def vectors_collected(x: Fixtures) -> DataFrame:
    texts = x.files().where("id % 3 = 0").select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("hash"))
    v = x.vectors()
    return M.collected(v, v.select("hash"), x.files().select("name"), texts, x.files())[0].select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0")
def vectors_of_model(x: Fixtures) -> DataFrame:
    """Vectors of another length, from an older model, take no part."""
    v = x.vectors().withColumn("vector", F.when(F.col("vec_id") % 4 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector")))
    return M.of_model(v, 64).select("vec_id")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e) SELECT vec_id, round(v[1] / s, 6) AS first, round((v[1] / s + v[1]) / 2, 6) AS mean FROM n""")
def vector_unit_mean(x: Fixtures) -> DataFrame:
    v = x.vectors().select("vec_id", F.transform("vector", lambda y: y.cast("double")).alias("v")).withColumn("u", M.unit(F.col("v")))
    return v.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get(M.mean([F.col("u"), F.col("v")]), F.lit(0)), 6).alias("mean"))


# Fingerprints of pictures: the outer product of two vectors, whose frequencies are products.

COSINES = ", ".join(f"({k}, {[math.cos(math.pi / 64 * (i + 0.5) * k) for i in range(64)]}::DOUBLE[])" for k in range(8))


@query(f"""WITH c AS (SELECT * FROM (VALUES {COSINES}) AS c(k, w)), d AS (SELECT vec_id, k, list_inner_product(CAST(embedding AS DOUBLE[]), w) AS x, list_inner_product(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + i * i / 4096.0), w) AS y FROM embeddings, c),
q AS (SELECT a.vec_id, a.k * 8 + b.k AS i, a.x * b.y AS v FROM d a JOIN d b USING (vec_id)), m AS (SELECT vec_id, (list_sort(list(v))[32] + list_sort(list(v))[33]) / 2 AS med FROM q GROUP BY vec_id)
SELECT vec_id, string_agg(CASE WHEN v > med THEN '1' ELSE '0' END, '' ORDER BY i)::BIT::BIGINT AS bits FROM q JOIN m USING (vec_id) GROUP BY vec_id""")
def phash_pictures(x: Fixtures) -> DataFrame:
    e = x.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    grey = F.flatten(F.transform("v", lambda a: F.transform(F.col("v"), lambda b, i: a * (b + (i + 1) * (i + 1) / 4096.0))))
    return with_phash(e.select("vec_id", grey.alias("grey")), "grey")


@query(f"""{FILES}, pt AS (SELECT vec_id // 4 AS id, vec_id % 2 = 0 AS even, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT count(*) AS groups, sum(n) AS files FROM (SELECT count(*) AS n FROM f WHERE id % 50 < 3 GROUP BY id // 50 HAVING count(*) > 1)""")
def dupes_look_alikes(x: Fixtures) -> DataFrame:
    """Groups of files whose pictures differ in a bit: three in each fifty have near prints."""
    f = x.files().withColumn("hash", F.concat(F.lit("h"), F.col("id").cast("string"))).withColumn("size", F.lit(20_000).cast("long"))
    k = F.col("id")
    bits = F.when(k % 50 < 3, F.xxhash64(F.floor(k / 50)).bitwiseXOR(F.pow(F.lit(2.0), k % 50).cast("long"))).otherwise(F.xxhash64(k + 1_000_000))
    prints = f.select("hash", F.lit("phash").alias("algo"), bits.alias("bits"), F.lit(None).cast("double").alias("duration"))
    return D.groups_of(D.look_alikes(f, prints, 2), "looks").agg(F.count("*").alias("groups"), F.sum("n").alias("files"))


# Streams, as tables

DUCK_WATCH = "e AS (SELECT event_id, epoch_us(ts) AS t, user_id, CASE event_type WHEN 'click' THEN 'metadata' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' ELSE CASE WHEN event_id % 50 = 0 THEN 'overflow' ELSE 'create' END END AS kind, '/home/u/d' || (user_id % 40) AS folder FROM events)"


def changes(x: Fixtures) -> DataFrame:
    k = F.when(F.col("event_type") == "click", "metadata").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write").when(F.col("event_id") % 50 == 0, "overflow").otherwise("create")
    path = F.concat(F.lit("/home/u/d"), (F.col("user_id") % 40).cast("string"), F.lit("/f"), F.col("event_id").cast("string"))
    return x.table("events").select("event_id", "user_id", "ts", k.alias("kind"), path.alias("path"))


def folders(x: Fixtures) -> DataFrame:
    return x.spark.range(20).select(F.concat(F.lit(HOME + "/d"), F.col("id").cast("string")).alias("folder"))


@query(f"WITH {DUCK_WATCH} SELECT event_id, kind FROM e WHERE kind = 'overflow' OR (kind IN ('write', 'create') AND user_id % 40 < 20)")
def events_that_matter(x: Fixtures) -> DataFrame:
    return W.matters(changes(x), folders(x)).select("event_id", "kind")


@query(f"""WITH {DUCK_WATCH}, m AS (SELECT t, event_id FROM e WHERE kind = 'overflow' OR (kind IN ('write', 'create') AND user_id % 40 < 20)),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) < 300000000 THEN 0 ELSE 1 END AS new FROM m), b AS (SELECT *, sum(new) OVER (ORDER BY t, event_id) AS batch FROM g) SELECT min(t) // 1000000 AS opened, max(t) // 1000000 + 300 AS due, count(*) AS events FROM b GROUP BY batch""")
def debounce_quiet(x: Fixtures) -> DataFrame:
    return quiet_runs(W.matters(changes(x), folders(x)), 300)


@query(f"""WITH RECURSIVE {DUCK_WATCH}, m AS (SELECT user_id::VARCHAR AS key, t // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e WHERE kind = 'overflow' OR (kind IN ('write', 'create') AND user_id % 40 < 20)),
w AS (SELECT key, i, t, t AS first, t AS last, 1 AS n, 1 AS batch FROM m WHERE i = 1 UNION ALL SELECT m.key, m.i, m.t, CASE WHEN m.t < least(w.last + 86400, w.first + 259200) THEN w.first ELSE m.t END, m.t, CASE WHEN m.t < least(w.last + 86400, w.first + 259200) THEN w.n + 1 ELSE 1 END, CASE WHEN m.t < least(w.last + 86400, w.first + 259200) THEN w.batch ELSE w.batch + 1 END FROM w JOIN m ON m.key = w.key AND m.i = w.i + 1)
SELECT key, min(first) AS opened, least(max(last) + 86400, min(first) + 259200) AS due, count(*) AS events FROM w GROUP BY key, batch""")
def debounce_capped(x: Fixtures) -> DataFrame:
    return capped_batches(W.matters(changes(x), folders(x)), "user_id", 86_400, 3 * 86_400)


@query("WITH s AS (SELECT DISTINCT source || '/' || lang AS p, doc_id FROM documents) SELECT DISTINCT '/home/u/' || p AS folder FROM s WHERE doc_id % 2 = 0 EXCEPT SELECT '/home/u/' || p FROM s WHERE doc_id % 7 = 0")
def folders_appeared(x: Fixtures) -> DataFrame:
    d = x.table("documents").select("doc_id", F.concat(F.lit(HOME + "/"), "source", F.lit("/"), "lang").alias("folder"))
    return W.appeared(d.where("doc_id % 2 = 0").select("folder").distinct(), d.where("doc_id % 7 = 0").select("folder").distinct())


@query("SELECT DISTINCT '/home/u/' || source AS folder FROM documents WHERE source <> 'src3' UNION SELECT '/home/u'")
def folders_watched(x: Fixtures) -> DataFrame:
    d = x.table("documents").select(F.concat(F.lit(HOME + "/"), "source").alias("path")).distinct()
    return W.watched(d, HOME, HOME + "/src3")


@query("SELECT user_id % 20 AS plugin, arg_max(event_id, event_id) AS query FROM events GROUP BY 1")
def latest_queries(x: Fixtures) -> DataFrame:
    return W.latest(x.table("events").select((F.col("user_id") % 20).alias("plugin"), F.col("event_id").alias("seq"), F.col("event_id").alias("query")))

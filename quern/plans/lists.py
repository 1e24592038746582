"""Registered queries of lists, display forms, sums, units, money and dates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import calculator as K
from quern.functions import clock as C
from quern.functions import shown as H
from quern.operators import providers as P
from quern.plans.fixtures import Fixtures
from quern.plans.queries import query

# Browsers

DUCK_PAGES = """h AS (SELECT page_id AS id, CASE WHEN page_id % 10 = 3 THEN 'ftp://x/' || page_id ELSE url END AS url, CASE WHEN page_id % 9 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, 1 + page_id % 17 AS visits, page_id % 3 AS typed, page_id AS last, 'p' || (page_id % 3) AS profile, page_id % 11 = 0 AS hidden FROM pages),
hh AS (SELECT * FROM h UNION ALL SELECT id, url || '#top', title, visits, typed, last, profile, hidden FROM h WHERE id % 4 = 0),
m AS (SELECT title || ' ' || (id % 5) AS title, CASE WHEN id % 2 = 0 THEN url ELSE url || '/' || (id % 7) END AS url, profile FROM h WHERE id % 6 = 0 UNION ALL SELECT 'Again ' || title, url, 'p9' FROM h WHERE id % 18 = 0)"""


def pages(x: Fixtures) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 10 == 3, F.concat(F.lit("ftp://x/"), k.cast("string"))).otherwise(F.col("url"))
    title = F.when(k % 9 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return x.table("pages").select(k.alias("id"), url.alias("url"), title.alias("title"), (1 + k % 17).alias("visit_count"), (k % 3).alias("typed_count"), k.alias("last_visit_time"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("profile"), (k % 11 == 0).alias("hidden"))


def visits(x: Fixtures) -> DataFrame:
    h = pages(x)
    return h.unionByName(h.where("id % 4 = 0").withColumn("url", F.concat("url", F.lit("#top"))))


def marks(x: Fixtures) -> DataFrame:
    h, k = pages(x), F.col("id")
    own = h.where(k % 6 == 0).select(F.concat("title", F.lit(" "), (k % 5).cast("string")).alias("title"), F.when(k % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/"), (k % 7).cast("string"))).alias("url"), "profile")
    return own.unionByName(h.where(k % 18 == 0).select(F.concat(F.lit("Again "), "title").alias("title"), "url", F.lit("p9").alias("profile")))


def duck_words(words: str) -> str:
    return " AND ".join(f"(contains(lower(title), '{w}') OR contains(lower(url), '{w}'))" for w in words.split())


def duck_browsed(words: str, limit: int) -> str:
    first = f"NOT starts_with(lower(title), '{words.split()[0]}'), strlen(url), profile, url, title"
    return f"""WITH {DUCK_PAGES}, b0 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {first}) AS r FROM m WHERE {duck_words(words)}), b AS (SELECT title, url, profile, row_number() OVER (ORDER BY {first}) AS place FROM b0 WHERE r = 1 QUALIFY place <= {limit}),
k0 AS (SELECT *, visits + 2 * typed AS score, row_number() OVER (PARTITION BY profile ORDER BY visits + 2 * typed DESC, last DESC, url) AS r FROM hh WHERE NOT hidden AND url LIKE 'http%' AND {duck_words(words)} QUALIFY r <= {3 * limit}),
k1 AS (SELECT *, CASE WHEN title = '' THEN 1 ELSE row_number() OVER (PARTITION BY profile, title ORDER BY score DESC, profile, r) END AS t, row_number() OVER (PARTITION BY url ORDER BY score DESC, profile, r) AS u FROM k0),
k AS (SELECT title, url, profile, {limit} + row_number() OVER (ORDER BY score DESC, profile, r) AS place FROM k1 WHERE t = 1 AND u = 1 AND url NOT IN (SELECT url FROM b))
SELECT title, url, profile, place, bookmark FROM (SELECT *, true AS bookmark FROM b UNION ALL SELECT *, false FROM k) ORDER BY place LIMIT {limit}"""


@query(duck_browsed("the", 6))
def browser_search(x: Fixtures) -> DataFrame:
    return P.browsed(marks(x).dropDuplicates(), visits(x), "The", 6)


@query(duck_browsed("http", 40))
def browser_search_long(x: Fixtures) -> DataFrame:
    return P.browsed(marks(x).dropDuplicates(), visits(x), "http", 40)


@query(f"WITH {DUCK_PAGES}, r AS (SELECT DISTINCT * FROM m WHERE {duck_words('the')}), o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY NOT starts_with(lower(title), 'the'), strlen(url), profile, url, title) AS r FROM r) SELECT title, url, profile FROM o WHERE r = 1 ORDER BY NOT starts_with(lower(title), 'the'), strlen(url), profile, url, title LIMIT 10")
def bookmarks_ranked(x: Fixtures) -> DataFrame:
    return P.bookmarks(marks(x).dropDuplicates(), ["the"], 10).select("title", "url", "profile")


@query("SELECT page_id, regexp_replace(lower('Chrome-' || url), '[^a-z0-9]', '-', 'g') AS key FROM pages")
def profile_key(x: Fixtures) -> DataFrame:
    return x.table("pages").select("page_id", P.profile_key(F.lit("Chrome"), F.col("url")).alias("key"))


# Processes

DUCK_PROCESSES = "p AS (SELECT c_custkey AS pid, CASE WHEN c_custkey // 3 > 0 THEN c_custkey // 3 END AS parent, c_name AS name, CAST(abs(c_acctbal) AS DOUBLE) AS cpu, CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) AS memory FROM customer)"


def duck_tree(where: str, limit: int) -> str:
    return f"""WITH RECURSIVE {DUCK_PROCESSES}, a AS (SELECT pid, pid AS top FROM p UNION ALL SELECT a.pid, p.parent FROM a JOIN p ON p.pid = a.top WHERE p.parent IS NOT NULL),
t AS (SELECT a.top AS pid, sum(p.cpu) AS cpu, sum(p.memory) AS memory, count(*) - 1 AS below FROM a JOIN p ON p.pid = a.pid GROUP BY a.top),
s AS (SELECT p.pid, p.parent, p.name, t.cpu, t.memory, t.below FROM p JOIN t USING (pid) WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN parent IN (SELECT pid FROM s) THEN parent END ORDER BY cpu DESC, memory DESC, pid) AS rank, parent IS NULL OR parent NOT IN (SELECT pid FROM s) AS root FROM s),
w AS (SELECT pid, name, cpu, memory, below, [rank] AS path FROM r WHERE root UNION ALL SELECT r.pid, r.name, r.cpu, r.memory, r.below, list_append(w.path, r.rank) FROM w JOIN r ON r.parent = w.pid AND NOT r.root)
SELECT row_number() OVER (ORDER BY path) AS place, len(path) - 1 AS depth, pid, name, round(cpu, 4) AS cpu, memory, below FROM w ORDER BY path LIMIT {limit}"""


def tree(x: Fixtures, words: list[str] | None, limit: int) -> DataFrame:
    p = x.processes().withColumn("memory", F.col("memory").cast("long")).withColumn("cpu", F.col("cpu").cast("double"))
    return P.process_tree(p, words, limit).withColumn("cpu", F.round("cpu", 4))


@query(duck_tree("t.cpu >= 0.5 OR t.memory >= 104857600", 50))
def process_tree_order(x: Fixtures) -> DataFrame:
    return tree(x, None, 50)


@query(duck_tree("p.pid IN (SELECT a.pid FROM a JOIN p q ON q.pid = a.top WHERE q.name LIKE '%0017%') OR p.pid IN (SELECT a.top FROM a JOIN p q ON q.pid = a.pid WHERE q.name LIKE '%0017%')", 40))
def process_tree_words(x: Fixtures) -> DataFrame:
    return tree(x, ["0017"], 40)


@query("SELECT c_custkey AS pid, c_name AS name, CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) AS memory FROM customer ORDER BY memory DESC, name LIMIT 20")
def process_top_memory(x: Fixtures) -> DataFrame:
    return P.by_memory(x.processes()).select("pid", "name", F.col("memory").cast("long").alias("memory"))


# Ports and services

DUCK_PORTS = """s AS (SELECT 1000 + s_suppkey % 50 AS port, CASE WHEN s_suppkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, s_nationkey AS pid, 'prog' || (s_nationkey % 3) AS name, CASE s_suppkey % 4 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '127.0.0.53' ELSE '10.0.0.' || (s_suppkey % 4) END AS address FROM supplier),
g AS (SELECT port, protocol, pid, min(name) AS name, list(DISTINCT address ORDER BY address) AS a FROM s GROUP BY ALL),
o AS (SELECT port, protocol, pid, CASE WHEN list_contains(a, '0.0.0.0') THEN 'every network' WHEN a = ['127.0.0.1'] THEN 'this computer only' ELSE array_to_string(a, ', ') END AS reach, name FROM g)"""


def sockets(x: Fixtures) -> DataFrame:
    k = F.col("s_suppkey")
    address = F.when(k % 4 == 0, "0.0.0.0").when(k % 4 == 1, "127.0.0.1").when(k % 4 == 2, "127.0.0.53").otherwise(F.concat(F.lit("10.0.0."), (k % 4).cast("string")))
    return x.table("supplier").select((1000 + k % 50).alias("port"), F.when(k % 2 == 0, "tcp").otherwise("udp").alias("protocol"), F.col("s_nationkey").alias("pid"), F.concat(F.lit("prog"), (F.col("s_nationkey") % 3).cast("string")).alias("name"), address.alias("address"))


@query(f"WITH {DUCK_PORTS} SELECT port, protocol, pid, reach FROM o ORDER BY port, protocol, pid LIMIT 50")
def ports_merge(x: Fixtures) -> DataFrame:
    return P.ports(sockets(x)).select("port", "protocol", "pid", "reach")


@query(f"WITH {DUCK_PORTS} SELECT port, protocol, pid, reach FROM o WHERE port::VARCHAR LIKE '102%' AND protocol = 'tcp' AND name LIKE '%prog1%' ORDER BY port, protocol, pid LIMIT 50")
def ports_filter(x: Fixtures) -> DataFrame:
    return P.ports(sockets(x), "102 TCP Prog1").select("port", "protocol", "pid", "reach")


DUCK_UNITS = """l AS (SELECT s_suppkey AS k, 'unit' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '@.service' WHEN s_suppkey % 7 = 1 THEN '@.service.d' ELSE '.service' END AS unit, ['active', 'activating', 'failed', 'reloading', 'dead'][s_suppkey % 5 + 1] AS state, ['enabled', 'disabled', 'static'][s_suppkey % 3 + 1] AS file FROM supplier),
v AS (SELECT unit, k % 2 = 0 AND state IN ('active', 'activating', 'reloading', 'deactivating') AS active, CASE WHEN k % 5 = 3 THEN '' ELSE file END AS file FROM l WHERE NOT ends_with(unit, '@.service') AND (k % 2 = 0 OR k % 5 <> 3))"""


def units(x: Fixtures) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("unit"), k.cast("string"), F.when(k % 7 == 0, "@.service").when(k % 7 == 1, "@.service.d").otherwise(".service"))
    u = x.table("supplier").select(k, name.alias("unit"), F.get(F.array(*map(F.lit, ["active", "activating", "failed", "reloading", "dead"])), (k % 5).cast("int")).alias("active"), F.get(F.array(*map(F.lit, ["enabled", "disabled", "static"])), (k % 3).cast("int")).alias("state"))
    return P.services(u.where(k % 2 == 0).select("unit", "active"), u.where(k % 5 != 3).select("unit", "state"))


@query(f"WITH {DUCK_UNITS} SELECT unit, active, file FROM v")
def services_merge(x: Fixtures) -> DataFrame:
    return units(x).select("unit", "active", "file")


@query(f"WITH {DUCK_UNITS} SELECT unit, active FROM v WHERE contains(unit, 'unit1') ORDER BY active DESC, unit LIMIT 50")
def services_listed(x: Fixtures) -> DataFrame:
    return P.listed(units(x), ["unit"], "UNIT1").select("unit", "active")


@query(f"WITH {DUCK_UNITS} SELECT unit, list_filter([CASE WHEN NOT active THEN 'Start' END, CASE WHEN active THEN 'Stop' END, CASE WHEN active THEN 'Restart' END, CASE WHEN file = 'disabled' THEN 'Enable' END, CASE WHEN file = 'enabled' THEN 'Disable' END, 'Show logs'], lambda x: x IS NOT NULL) AS verbs FROM v")
def service_verbs(x: Fixtures) -> DataFrame:
    return units(x).select("unit", P.verbs(F.col("active"), F.col("file")).alias("verbs"))


# Apps, commands, copies, sections


def app_entries(x: Fixtures) -> DataFrame:
    k = F.col("p_partkey")
    return x.table("part").select((k % 3).alias("dir_rank"), F.concat(F.lit("app"), F.floor(k / 2).cast("string")).alias("id"), F.initcap("p_name").alias("name"), F.split("p_type", " ").alias("other_names"))


DUCK_APPS = r"""p AS (SELECT p_partkey AS k, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, string_split(p_type, ' ') AS others FROM part),
s AS (SELECT *, row_number() OVER (PARTITION BY k // 2 ORDER BY k % 3) AS r FROM p), e AS (SELECT k, name, list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w, list_filter(regexp_split_to_array(lower(array_to_string(others, ' ')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS o FROM s WHERE r = 1)"""


def duck_apps(q: str, limit: int) -> str:
    begin = lambda c: " AND ".join(f"len(list_filter({c}, lambda w: starts_with(w, '{t}'))) > 0" for t in q.split())
    short = f"len(w) > 1 AND starts_with(array_to_string(list_transform(w, lambda x: x[1]), ''), '{q}')" if " " not in q else "false"
    return f"WITH {DUCK_APPS}, k AS (SELECT k, name, CASE WHEN starts_with(lower(name), '{q}') THEN 0 WHEN {begin('w')} THEN 1 WHEN {short} THEN 2 WHEN {begin('o')} THEN 3 END AS rank FROM e) SELECT name, rank FROM k WHERE rank IS NOT NULL ORDER BY rank, strlen(name), name LIMIT {limit}"


@query(duck_apps("sr", 25))
def apps_ranked(x: Fixtures) -> DataFrame:
    return P.apps(P.shadowed(app_entries(x)), "SR", 25).select("name", "rank")


@query(duck_apps("ri sm", 25))
def apps_by_words(x: Fixtures) -> DataFrame:
    return P.apps(P.shadowed(app_entries(x)), " ri SM", 25).select("name", "rank")


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey % 3) AS r FROM part) SELECT 'app' || (p_partkey // 2) AS id, p_partkey % 3 AS dir_rank FROM p WHERE r = 1")
def apps_shadowed(x: Fixtures) -> DataFrame:
    return P.shadowed(app_entries(x)).select("id", "dir_rank")


@query("SELECT * FROM (VALUES ('Sleep', NULL), ('Shut down', 'shut down now')) AS t(title, fills) WHERE title = 'Shut down'")
def system_commands(x: Fixtures) -> DataFrame:
    return P.commands(x.spark, "Shut")


@query("SELECT 'Restart' AS title, NULL::VARCHAR AS fills")
def system_commands_sure(x: Fixtures) -> DataFrame:
    return P.commands(x.spark, "restart NOW")


DUCK_COPIES = "c AS (SELECT CASE WHEN turn = 2 THEN ' ' WHEN conv_id % 50 = 1 THEN repeat(text, 3000) ELSE text END AS text, conv_id * 1000000 + turn * 1000 AS copied FROM conversations), k AS (SELECT text, max(copied) AS copied FROM c WHERE trim(text) <> '' AND strlen(text) <= 262144 GROUP BY text ORDER BY copied DESC, text LIMIT 200)"


def conversation_copies(x: Fixtures) -> DataFrame:
    text = F.when(F.col("turn") == 2, " ").when(F.col("conv_id") % 50 == 1, F.repeat("text", F.lit(3000))).otherwise(F.col("text"))
    return x.table("conversations").select(text.alias("text"), (F.col("conv_id") * 1_000_000 + F.col("turn") * 1_000).alias("copied"))


@query(f"WITH {DUCK_COPIES} SELECT text, copied FROM k")
def clipboard_kept(x: Fixtures) -> DataFrame:
    return P.remembered(conversation_copies(x))


@query(f"WITH {DUCK_COPIES} SELECT text, copied FROM k WHERE contains(lower(text), 'a') AND contains(lower(text), 'th') ORDER BY copied DESC, text LIMIT 50")
def clipboard_recent(x: Fixtures) -> DataFrame:
    return P.copies(P.remembered(conversation_copies(x)), "TH a")


@query(f"WITH {DUCK_COPIES} SELECT text, copied FROM k WHERE copied <> (SELECT max(copied) FROM k)")
def clipboard_forget(x: Fixtures) -> DataFrame:
    kept = P.remembered(conversation_copies(x))
    return P.forgotten_copy(kept, kept.agg(F.max("copied")).first()[0])


@query("""WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'top' ELSE 'bottom' END AS position FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY id) - 1 AS n FROM p) SELECT id, CASE WHEN position = 'top' THEN least(11 + n, 19) ELSE 30 + n END AS rank FROM r""")
def section_ranks(x: Fixtures) -> DataFrame:
    s = x.table("supplier")
    return P.section_ranks(s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "top").otherwise("bottom").alias("position"), F.col("s_suppkey").alias("at"))).select("id", "rank")


@query("SELECT 20 AS rank, n_nationkey AS place, n_name AS title FROM nation UNION ALL SELECT 0, r_regionkey, r_name FROM region")
def result_page(x: Fixtures) -> DataFrame:
    nations = x.table("nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("title"))
    regions = x.table("region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("title"))
    return P.page([(P.FILES, nations), (P.KEYWORDS, regions)])


@query("SELECT 'o' || (s_nationkey % 4) AS owner, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0")
def store_not_installed(x: Fixtures) -> DataFrame:
    s = x.table("supplier").select("s_suppkey", F.concat(F.lit("o"), (F.col("s_nationkey") % 4).cast("string")).alias("owner"), F.col("s_name").alias("name"))
    return P.not_installed(s.drop("s_suppkey"), s.where("s_suppkey % 3 = 0").select("owner", "name"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'installed' ELSE 'bundled' END AS origin FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 2 = 0")
def plugins_all(x: Fixtures) -> DataFrame:
    n = x.table("nation").select(F.col("n_nationkey").alias("id"))
    return P.all_plugins(n.where("id % 2 = 0").withColumn("origin", F.lit("bundled")), n.where("id % 4 = 0").withColumn("origin", F.lit("installed")))


@query("SELECT count(DISTINCT s_nationkey) AS workspaces FROM supplier")
def window_spaces(x: Fixtures) -> DataFrame:
    return P.spaces(x.table("supplier").select(F.col("s_nationkey").alias("workspace")))


# Display forms


@query("""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, greatest(0, 600000000 - conv_id * 1000000 - turn * 1000) // 60000 AS m, len(string_split(trim(text, ' ' || chr(10) || chr(9)), chr(10))) AS n FROM conversations),
a AS (SELECT *, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || ' h ago' ELSE (m // 1440) || ' d ago' END AS ago FROM l)
SELECT conv_id, turn, CASE WHEN length(coalesce(l[1], '')) > 200 THEN l[1][:200] || '…' ELSE coalesce(l[1], '') END AS title, CASE WHEN n > 1 THEN ago || ' · ' || n || ' lines' ELSE ago END AS subtitle FROM a""")
def copies_shown(x: Fixtures) -> DataFrame:
    age = 600_000_000 - F.col("conv_id") * 1_000_000 - F.col("turn") * 1_000
    return x.table("conversations").select("conv_id", "turn", H.title(F.col("text")).alias("title"), H.subtitle(F.col("text"), age).alias("subtitle"))


@query("""WITH s AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders) SELECT k, CASE WHEN s < 120 THEN s || ' s' WHEN s < 7200 THEN (s // 60) || ' min' WHEN s < 172800 THEN (s // 3600) || ' h' ELSE (s // 86400) || ' d' END AS ttl,
CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm' WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'm' ELSE s || 's' END AS span FROM s""")
def spans_shown(x: Fixtures) -> DataFrame:
    s = x.table("orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("s"))
    return s.select("k", H.ttl(F.col("s")).alias("ttl"), H.span(F.col("s")).alias("span"))


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice * 8192 / 1048576 >= 1024 THEN printf('%.1f GB', round_even(CAST(floor(o_totalprice) AS DOUBLE) * 8192 / 1048576 / 1024, 1)) ELSE printf('%.0f MB', round_even(CAST(floor(o_totalprice) AS DOUBLE) * 8192 / 1048576, 0)) END AS size FROM orders")
def memory_shown(x: Fixtures) -> DataFrame:
    return x.table("orders").select(F.col("o_orderkey").alias("k"), H.memory(F.floor("o_totalprice") * 8192).alias("size"))


@query("SELECT c_custkey AS k, upper(c_name[1]) || c_name[2:] AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name[:15] || '-helper' ELSE c_name[:15] END AS program FROM customer")
def names_shown(x: Fixtures) -> DataFrame:
    short = F.substring("c_name", 1, 15)
    path = F.concat(F.lit("/usr/bin/"), F.when(F.col("c_custkey") % 2 == 0, F.concat(short, F.lit("-helper"))).otherwise("x"))
    return x.table("customer").select(F.col("c_custkey").alias("k"), H.capital(F.col("c_name")).alias("name"), H.program_name(short, path).alias("program"))


DUCK_REPOSITORIES = ["'https://github.com/o' || k || '/name.git'", "'http://www.github.com/o' || k || '/n_' || k || '/'", "'o' || k || '/n' || k", "'github.com/o' || k || '/n/tree/main'", "'github.com/o' || k || '/n/issues'", "'o' || k", "'../n' || k", "'o' || k || '/a b'"]


@query(f"WITH p AS (SELECT p_partkey AS k FROM part), t AS (SELECT k, CASE k % 8 {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(DUCK_REPOSITORIES))} END AS text FROM p) SELECT k, CASE WHEN k % 8 < 4 THEN 'o' || k END AS owner, CASE k % 8 WHEN 0 THEN 'name' WHEN 1 THEN 'n_' || k WHEN 2 THEN 'n' || k WHEN 3 THEN 'n' END AS name FROM t")
def repositories(x: Fixtures) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    forms = [("https://github.com/o", "/name.git"), ("http://www.github.com/o", F.concat(F.lit("/n_"), k, F.lit("/"))), ("o", F.concat(F.lit("/n"), k)), ("github.com/o", "/n/tree/main"), ("github.com/o", "/n/issues"), ("o", ""), ("../n", ""), ("o", "/a b")]
    text = F.lit(None).cast("string")
    for i, (a, b) in enumerate(forms):
        text = F.when(F.col("p_partkey") % 8 == i, F.concat(F.lit(a), k, F.lit(b) if isinstance(b, str) else b)).otherwise(text)
    found = H.repository(text)
    return x.table("part").select(F.col("p_partkey").alias("k"), found["owner"].alias("owner"), found["name"].alias("name"))


@query("SELECT doc_id, upper(sha256(text)) AS hex, sha256(text) AS back, regexp_replace(lower(source || ' ' || chr(9) || upper(lang)), '\\s+', '', 'g') AS squashed FROM documents")
def hex_and_squash(x: Fixtures) -> DataFrame:
    raw = H.from_hex(F.sha2("text", 256))
    return x.table("documents").select("doc_id", F.upper(H.to_hex(raw)).alias("hex"), H.to_hex(H.from_hex(F.upper(F.sha2("text", 256)))).alias("back"), H.squashed(F.concat("source", F.lit(" \t"), F.upper("lang"))).alias("squashed"))


@query("SELECT o_orderkey AS k, CASE WHEN c IN ('-0.00') THEN '0.00' ELSE c END AS shown, regexp_matches(strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') AS day FROM (SELECT *, format('{:,.2f}', CASE WHEN o_orderkey % 5 = 0 THEN -0.001 WHEN o_orderkey % 5 = 1 THEN -CAST(o_totalprice AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END) AS c FROM orders)")
def numbers_grouped(x: Fixtures) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    value = F.when(k % 5 == 0, -0.001).when(k % 5 == 1, -price).otherwise(price)
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 3 == 0, "x").otherwise(""))
    return x.table("orders").select(k.alias("k"), H.grouped(value, 2).alias("shown"), H.is_day(day).alias("day"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_totalprice AS DOUBLE) END AS amount, CASE WHEN o_orderkey % 3 < 2 THEN 'EUR' END AS unit FROM orders")
def amounts_split(x: Fixtures) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("approx. "), price, F.lit(" EUR"))).when(k % 3 == 1, F.concat(price, F.lit(" EUR"))).otherwise("EUR")
    found = H.amount(text)
    return x.table("orders").select(k.alias("k"), found["amount"].alias("amount"), found["unit"].alias("unit"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN array_to_string(list_slice(list_filter(regexp_split_to_array(replace(replace(text, '\"', ''), chr(92), ''), '\\s+'), lambda x: x <> ''), 1, 20), ' ') END AS text, CASE WHEN doc_id % 3 < 2 THEN [lang, 'x'] END AS tags, CASE WHEN doc_id % 3 < 2 THEN list_filter([source], lambda s: s IN ('src1', 'src2')) END AS labels FROM documents")
def answers_read(x: Fixtures) -> DataFrame:
    bare = F.replace(F.replace("text", F.lit('"'), F.lit("")), F.lit("\\"), F.lit(""))
    said = F.to_json(F.struct(bare.alias("text"), F.array(F.concat(F.lit(" "), F.upper("lang")), F.lit("x"), F.lit("X ")).alias("tags"), F.array("source").alias("labels")))
    k = F.col("doc_id") % 3
    found = H.described(F.when(k == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(k == 1, said).otherwise("no json"), ["src1", "src2"])
    return x.table("documents").select("doc_id", found["text"].alias("text"), found["tags"].alias("tags"), found["labels"].alias("labels"))


# Sums, units, money


@query("""WITH r AS (SELECT upper(n_name) AS code, 1 + n_nationkey / 10.0 AS rate FROM nation UNION ALL SELECT 'JPY', 151.5 UNION ALL SELECT 'KWD', 0.3) SELECT a.code AS source, b.code AS target, round(100 / a.rate * b.rate, CASE b.code WHEN 'JPY' THEN 0 WHEN 'KWD' THEN 3 ELSE 2 END) AS result FROM r a JOIN r b ON a.code <> b.code""")
def currency_convert(x: Fixtures) -> DataFrame:
    r = x.rates().select("code", F.col("rate").cast("double").alias("rate")).unionByName(x.spark.createDataFrame([("JPY", 151.5), ("KWD", 0.3)], "code string, rate double"))
    amounts = r.select(F.lit(100.0).alias("amount"), F.col("code").alias("source")).crossJoin(F.broadcast(r.select(F.col("code").alias("target")))).where("source <> target")
    return K.exchanged(amounts, r).select("source", "target", "result")


DUCK_CONVERSIONS = [("km", "mile", "amount * 1000 / 1609.344"), ("pounds", "kg", "amount * 0.45359237"), ("f", "c", "(amount - 32) * 5 / 9"), ("hours", "min", "amount * 60"), ("kg", "mile", "NULL"), ("Mb", "kib", "amount * 1000000 / 1024")]


@query(f"SELECT k, round(result, 6) AS result FROM (SELECT o_orderkey AS k, CASE o_orderkey % 6 {' '.join(f'WHEN {i} THEN {c[2]}' for i, c in enumerate(DUCK_CONVERSIONS))} END AS result FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS amount FROM orders))")
def units_convert(x: Fixtures) -> DataFrame:
    pick = lambda j: F.get(F.array(*(F.lit(c[j].lower().removesuffix("s") if len(c[j]) > 2 else c[j].lower()) for c in DUCK_CONVERSIONS)), (F.col("o_orderkey") % 6).cast("int"))
    amounts = x.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("amount"), pick(0).alias("source"), pick(1).alias("target"))
    return K.converted(amounts, K.units(x.spark)).select("k", F.round("result", 6).alias("result"))


# Dates


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey % 15 - 7 AS n FROM orders) SELECT k, strftime(CASE k % 4 WHEN 0 THEN d + to_days(CAST(n AS INTEGER)) WHEN 1 THEN d + to_days(CAST(n * 7 AS INTEGER)) WHEN 2 THEN d + to_months(CAST(n AS INTEGER)) ELSE d + to_months(CAST(n * 12 AS INTEGER)) END, '%Y-%m-%d') AS day FROM o""")
def date_shift(x: Fixtures) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.get(F.array(*map(F.lit, ["day", "week", "month", "year"])), (k % 4).cast("int"))
    return x.table("orders").select(k.alias("k"), F.date_format(C.added(F.to_date("o_orderdate"), k % 15 - 7, unit), "yyyy-MM-dd").alias("day"))


@query("""WITH o AS (SELECT o_orderkey AS k, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') AS n FROM orders) SELECT k, n || CASE WHEN abs(n) = 1 THEN ' day' ELSE ' days' END AS days, CASE WHEN abs(n) // 7 = 0 THEN '' ELSE (abs(n) // 7) || CASE WHEN abs(n) // 7 = 1 THEN ' week' ELSE ' weeks' END || CASE abs(n) % 7 WHEN 0 THEN '' WHEN 1 THEN ' and 1 day' ELSE ' and ' || (abs(n) % 7) || ' days' END END AS weeks FROM o""")
def days_between(x: Fixtures) -> DataFrame:
    n = F.date_diff(F.lit("1996-06-30").cast("date"), F.to_date("o_orderdate"))
    return x.table("orders").select(F.col("o_orderkey").alias("k"), C.days_text(n).alias("days"), C.weeks_text(n).alias("weeks"))


@query("SELECT event_id, strftime(timezone('Asia/Kolkata', timezone('UTC', CAST(ts AS TIMESTAMP))), '%Y-%m-%d %H:%M') AS there FROM events")
def time_elsewhere(x: Fixtures) -> DataFrame:
    return x.table("events").select("event_id", F.date_format(C.zoned(F.col("ts"), "UTC", "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("there"))


@query("""WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 53 - 24) * 1800 AS s FROM supplier) SELECT k, CASE WHEN s = 0 THEN 'UTC' ELSE 'UTC' || CASE WHEN s < 0 THEN '-' ELSE '+' END || (abs(s) // 3600) || CASE WHEN abs(s) % 3600 > 0 THEN ':' || lpad((abs(s) % 3600 // 60)::VARCHAR, 2, '0') ELSE '' END END AS shown FROM s""")
def offsets_shown(x: Fixtures) -> DataFrame:
    s = (F.col("s_suppkey") % 53 - 24) * 1800
    return x.table("supplier").select(F.col("s_suppkey").alias("k"), C.offset_column(s).alias("shown"))

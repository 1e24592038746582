"""List providers as DataFrame functions: browsers, processes, ports, services, apps, commands, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.shown import slug
from quern.sources.scratch import Scratch

LEAST_QUERY, MOST_ROWS = 2, 50
# How many copies are kept, and how long one may be; what counts as running; what a tree
# of processes leaves out without a query; system commands with other words for them.
KEPT_COPIES, LONGEST_COPY = 200, 256 * 1024
RUNNING = ["active", "activating", "reloading", "deactivating"]
IDLE_CPU, SMALL_MEMORY = 0.5, 100 * 1024 * 1024
MANAGERS = ["systemd", "init", "launchd"]
COMMANDS = [("Lock", ["lock screen"], False), ("Sleep", ["suspend"], False), ("Restart", ["reboot"], True), ("Shut down", ["shutdown", "power off", "turn off"], True), ("Log out", ["logout", "sign out"], True), ("Empty trash", ["trash"], False)]
CONFIRM = "now"
#: Ranks of a result page's sections: keywords, plug-ins on top, files, the other plug-ins.
KEYWORDS, TOP, FILES, BOTTOM = 0, 11, 20, 30


def words_of(query: str) -> list[str]:
    return query.lower().split()


def long_enough(query: str) -> bool:
    """Whether a query has the characters that a list needs to be searched."""
    return len("".join(query.split())) >= LEAST_QUERY


def after_keyword(query: str, keyword: str) -> str | None:
    """The query behind a plug-in's keyword and white space; None if it does not begin so."""
    head, rest = query[: len(keyword)], query[len(keyword) :]
    return rest.lstrip() if head == keyword and rest[:1].isspace() else None


def all_words(columns: list[str], words: list[str]) -> Column:
    """Every word stands somewhere in one of the columns, in any case."""
    out = F.lit(True)
    for w in words:
        one = F.lit(False)
        for c in columns:
            one |= F.contains(F.lower(c), F.lit(w.lower()))
        out &= F.coalesce(one, F.lit(False))
    return out


# Browsers


def history(urls: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Visited pages with the words, the most used first; each profile gives 3 * limit at most."""
    rows = urls.where(all_words(["title", "url"], words)).withColumn("score", F.col("visit_count") + 2 * F.col("typed_count"))
    by = Window.partitionBy("profile").orderBy(F.desc("score"), F.desc("last_visit_time"))
    rows = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= 3 * limit).drop("_r")
    return rows.orderBy(F.desc("score"), F.desc("last_visit_time")).limit(limit)


def bookmarks(marks: DataFrame, words: list[str], limit: int) -> DataFrame:
    """(title, url, profile, place): bookmarks with the words, those whose title begins with the first word
    before the others, short addresses first; an address once."""
    first = ~F.startswith(F.lower("title"), F.lit(words[0])) if words else F.lit(False)
    order = [first, F.octet_length("url"), F.col("profile"), F.col("url"), F.col("title")]
    rows = marks.where(all_words(["title", "url"], words))
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("_r = 1")
    top = once.orderBy(*order).limit(limit)
    return top.select("title", "url", "profile", F.row_number().over(Window.orderBy(*order)).alias("place"))


def browsed(marks: DataFrame, urls: DataFrame, query: str, limit: int) -> DataFrame:
    """(place, title, url, profile, bookmark): bookmarks, then pages of the history that are no bookmark
    shown, an address once and a title once a profile, ``limit`` in all."""
    words = words_of(query) if long_enough(query) else None
    marks, urls = (marks, urls) if words is not None else (marks.limit(0), urls.limit(0))
    own = bookmarks(marks, words or [], limit)
    # Each profile gives few pages, so what follows is on small tables.
    pages = urls.where("not hidden and url like 'http%'").where(all_words(["title", "url"], words or []))
    pages = pages.withColumn("score", F.col("visit_count") + 2 * F.col("typed_count"))
    by = Window.partitionBy("profile").orderBy(F.desc("score"), F.desc("last_visit_time"), "url")
    pages = pages.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= 3 * limit)
    order = [F.desc("score"), F.col("profile"), F.col("_r")]
    titled = F.row_number().over(Window.partitionBy("profile", "title").orderBy(*order))
    pages = pages.withColumn("_title", F.when(F.coalesce("title", F.lit("")) != "", titled).otherwise(F.lit(1)))
    pages = pages.withColumn("_url", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("_title = 1 and _url = 1")
    pages = pages.join(F.broadcast(own.select("url")), "url", "left_anti")
    shown = pages.select(F.coalesce("title", F.lit("")).alias("title"), "url", "profile", (F.lit(limit) + F.row_number().over(Window.orderBy(*order))).alias("place"), F.lit(False).alias("bookmark"))
    both = own.withColumn("bookmark", F.lit(True)).unionByName(shown)
    return both.orderBy("place").limit(limit)


def profile_key(browser: Column, folder: Column) -> Column:
    """A profile's name in the settings."""
    return slug(browser, folder)


# Processes


def subtree_totals(processes: DataFrame) -> DataFrame:
    """(pid, processes, cpu, memory) of every process with all below it.

    Ancestor pairs double their reach each round, so rounds grow with the logarithm of the depth.
    """
    scratch = Scratch(processes.sparkSession)
    up = scratch.table(processes.where("parent is not null").join(processes.select(F.col("pid").alias("parent")), "parent", "left_semi").select("pid", F.col("parent").alias("top"), F.lit(1).alias("d")))
    reach, all_ = 1, up
    while True:
        far = all_.where(F.col("d") == reach).select(F.col("pid").alias("top"), F.col("top").alias("_t"), F.col("d").alias("_d"))
        more = scratch.table(all_.join(far, "top").select("pid", F.col("_t").alias("top"), (F.col("d") + F.col("_d")).alias("d")).where(F.col("d") > reach))
        if not more.limit(1).count():
            break
        all_, reach = scratch.table(all_.unionByName(more)), reach * 2
    pairs = all_.select("pid", "top").unionByName(processes.select("pid", F.col("pid").alias("top")))
    return pairs.join(processes, "pid").groupBy("top").agg(F.count("*").alias("processes"), F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory")).withColumnRenamed("top", "pid")


def by_memory(processes: DataFrame, words: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Processes with the words in their name, the largest first."""
    return processes.where(all_words(["name"], words or [])).orderBy(F.desc("memory"), "name", "pid").limit(limit)


def process_tree(processes: DataFrame, words: list[str] | None = None, limit: int = MOST_ROWS) -> DataFrame:
    """(place, depth, pid, name, cpu, memory, below): the tree in the order in which it is read, the busiest
    first under each parent, ``limit`` rows. cpu and memory are those of a process and all below it.

    Without words idle and small subtrees are left out; with words, what neither matches, stands below a
    match, nor has one below. A process's place is its ancestors' ranks, compared one after the other:
    paths grow a level a round, and a row whose path begins behind ``limit`` others is cut with all below.
    """
    scratch = Scratch(processes.sparkSession)
    # Programs that start and watch all others are no one's parent here.
    processes = scratch.table(processes.where(~F.col("name").isin(MANAGERS)))
    totals = subtree_totals(processes)
    rows = processes.select("pid", "parent", "name", *(["command"] if "command" in processes.columns else [F.lit("").alias("command")]))
    rows = scratch.table(rows.join(totals, "pid").withColumn("below", F.col("processes") - 1))
    if words:
        hit = all_words(["name", "command"], words) | all_words_equal(F.col("pid"), words)
        hits = rows.where(hit).select("pid")
        shown = scratch.table(_closure(rows, hits, up=True).union(_closure(rows, hits, up=False)).distinct())
        rows = rows.join(shown, "pid", "left_semi")
    else:
        rows = rows.where((F.col("cpu") >= IDLE_CPU) | (F.col("memory") >= SMALL_MEMORY))
    rows = scratch.table(rows)
    known = rows.select(F.col("pid").alias("parent"))
    order = [F.desc("cpu"), F.desc("memory"), F.col("pid")]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("parent").orderBy(*order))).where(F.col("_rank") <= limit)
    orphans = rows.join(known, "parent", "left_anti")
    roots = orphans.withColumn("_rank", F.row_number().over(Window.orderBy(*order))).where(F.col("_rank") <= limit)
    level = roots.withColumn("path", F.array("_rank")).drop("_rank")
    done = level = scratch.table(level)
    while level.limit(1).count():
        # Of each level no more than ``limit`` rows can be shown.
        level = level.orderBy("path").limit(limit)
        below = ranked.join(F.broadcast(level.select(F.col("pid").alias("parent"), F.col("path").alias("_path"))), "parent")
        level = scratch.table(below.withColumn("path", F.concat("_path", F.array("_rank"))).drop("_rank", "_path").select(done.columns))
        done = done.unionByName(level)
    top = done.orderBy("path").limit(limit)
    place = F.row_number().over(Window.orderBy("path"))
    return top.select(place.alias("place"), (F.size("path") - 1).alias("depth"), "pid", "name", "cpu", "memory", "below").orderBy("place")


def all_words_equal(number: Column, words: list[str]) -> Column:
    """Whether every word is the number."""
    out = F.lit(bool(words))
    for w in words:
        out &= number.cast("string") == w
    return out


def _closure(rows: DataFrame, found: DataFrame, up: bool) -> DataFrame:
    """(pid) of ``found`` and all above or below, a level a round."""
    scratch = Scratch(rows.sparkSession)
    out = level = scratch.table(found.select("pid").distinct())
    while True:
        if up:
            near = rows.join(level, "pid", "left_semi").select(F.col("parent").alias("pid")).where("pid is not null").join(rows.select("pid"), "pid", "left_semi")
        else:
            near = rows.join(level.withColumnRenamed("pid", "parent"), "parent", "left_semi").select("pid")
        level = scratch.table(near.distinct().join(out, "pid", "left_anti"))
        if not level.limit(1).count():
            return out
        out = scratch.table(out.unionByName(level))


# Ports and services


def reach(addresses: Column) -> Column:
    """Who can reach a port."""
    everywhere = F.exists(addresses, lambda a: a.isin("0.0.0.0", "::"))
    here = F.forall(addresses, lambda a: a.isin("127.0.0.1", "::1"))
    return F.when(everywhere, "every network").when(here, "this computer only").otherwise(F.array_join(addresses, ", "))


def ports(sockets: DataFrame, query: str = "", limit: int = MOST_ROWS) -> DataFrame:
    """Listening sockets by (port, protocol, pid), with their distinct addresses and reach, lowest first.
    A number in the query begins the port's; any other word is in the program's name or is its protocol."""
    out = sockets.groupBy("port", "protocol", "pid").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("address")).alias("addresses"))
    for w in words_of(query):
        number = w.isascii() and w.isdigit()
        out = out.where(F.startswith(F.col("port").cast("string"), F.lit(w)) if number else F.contains(F.lower("name"), F.lit(w)) | (F.lower("protocol") == w))
    return out.withColumn("reach", reach(F.col("addresses"))).orderBy("port", "protocol", "pid").limit(limit)


def services(loaded: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, active, file, ...): loaded units with the state of their files, those only on disk as not
    running; templates, which can't run by themselves, are left out. Running ones first."""
    both = loaded.join(files.withColumnRenamed("state", "file"), "unit", "full_outer")
    both = both.withColumn("active", F.coalesce(F.col("active").isin(RUNNING), F.lit(False))).withColumn("file", F.coalesce("file", F.lit("")))
    return both.where(~F.endswith("unit", F.lit("@.service"))).orderBy(F.desc("active"), "unit")


def listed(rows: DataFrame, columns: list[str], query: str, limit: int = MOST_ROWS) -> DataFrame:
    """Rows with every word of the query, in the order they come, ``limit`` at most."""
    return rows.where(all_words(columns, words_of(query))).limit(limit)


def verbs(active: Column, file: Column) -> Column:
    """What can be done with a service as it is."""
    fits = {"Start": ~active, "Stop": active, "Restart": active, "Enable": file == "disabled", "Disable": file == "enabled", "Show logs": F.lit(True)}
    return F.array_compact(F.array(*(F.when(fit, verb) for verb, fit in fits.items())))


# Apps and commands


def shadowed(entries: DataFrame) -> DataFrame:
    """Of desktop entries (dir_rank, id, ...) with one id, that of the first folder."""
    by = Window.partitionBy("id").orderBy("dir_rank")
    return entries.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def _any_begins(words: Column, start: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(start)))


def apps(entries: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Apps (name, other_names) that a query names, with rank: 0 for the start of the name, 1 where every
    word begins one of the name's, 2 for its initials, 3 where every word begins one of the other names'."""
    q, typed = query.strip().lower(), query.lower().split()
    split = lambda x: F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = split(F.col("name"))
    others = split(F.array_join("other_names", " ")) if "other_names" in entries.columns else F.array().cast("array<string>")

    def begin(words: Column) -> Column:
        out = F.lit(True)
        for t in typed:
            out &= _any_begins(words, t)
        return out

    initials = F.array_join(F.transform(own, lambda w: F.substring(w, 1, 1)), "")
    short = F.lit(len(typed) == 1) & (F.length(initials) > 1) & F.startswith(initials, F.lit(q))
    rank = F.when(F.startswith(F.lower("name"), F.lit(q)), 0).when(begin(own), 1).when(short, 2).when(begin(others), 3)
    rows = entries if len(q) >= LEAST_QUERY else entries.limit(0)
    return rows.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.octet_length("name"), "name").limit(limit)


def commands(spark, query: str) -> DataFrame:
    """(title, fills): system commands that the query begins, one with lasting effect only filled in until
    its title and the word ``now`` were typed."""
    q = query.strip().lower()
    sure = q.endswith(" " + CONFIRM)
    asked = q.removesuffix(" " + CONFIRM).strip() if sure else q
    rows = [(t, t.lower(), [t.lower(), *w], d) for t, w, d in COMMANDS] if len(asked) >= LEAST_QUERY else []
    table = spark.createDataFrame(rows, "title string, name string, words array<string>, drastic boolean")
    found = table.where(F.exists("words", lambda w: F.startswith(w, F.lit(asked))))
    fill = F.col("drastic") & ~(F.lit(sure) & F.startswith("name", F.lit(asked)))
    return found.select("title", F.when(fill, F.concat("name", F.lit(" " + CONFIRM))).alias("fills"))


# Copies and sections


def remembered(copies: DataFrame) -> DataFrame:
    """(text, copied): the newest copy of each text that is neither blank nor too long, the newest first, as
    many as are kept."""
    ok = copies.where((F.regexp_replace("text", r"(?U)\s+", "") != "") & (F.octet_length("text") <= LONGEST_COPY))
    return ok.groupBy("text").agg(F.max("copied").alias("copied")).orderBy(F.desc("copied"), "text").limit(KEPT_COPIES)


def forgotten_copy(copies: DataFrame, copied: int | None = None) -> DataFrame:
    """``copies`` without the one made at a time, or none of them."""
    return copies.limit(0) if copied is None else copies.where(F.col("copied") != copied)


def copies(kept: DataFrame, query: str, limit: int = MOST_ROWS) -> DataFrame:
    """Kept copies with every word of the query, the newest first."""
    return kept.where(all_words(["text"], words_of(query))).orderBy(F.desc("copied"), "text").limit(limit)


def section_ranks(plugins: DataFrame) -> DataFrame:
    """``plugins`` (id, position, at) with the rank of their section: those on top stand between keywords
    and files, in their order and at most nine apart, the others behind the files."""
    nth = F.row_number().over(Window.partitionBy("position").orderBy("at", "id")) - 1
    return plugins.withColumn("rank", F.when(F.col("position") == "top", F.least(F.lit(TOP) + nth, F.lit(FILES - 1))).otherwise(F.lit(BOTTOM) + nth))


def page(sections: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows of sections (place, title) as one page, in the order of the sections' ranks."""
    out = None
    for rank, rows in sections:
        own = rows.select(F.lit(rank).alias("rank"), "place", "title")
        out = own if out is None else out.unionByName(own)
    return out.orderBy("rank", "place")


def not_installed(listings: DataFrame, installed: DataFrame) -> DataFrame:
    """Listings of a marketplace that are not installed yet, by (owner, name)."""
    return listings.join(installed, ["owner", "name"], "left_anti")


def all_plugins(bundled: DataFrame, installed: DataFrame) -> DataFrame:
    """Installed plug-ins, and bundled ones of which none with the same id is installed."""
    return bundled.join(installed.select("id"), "id", "left_anti").unionByName(installed, allowMissingColumns=True)


def spaces(windows: DataFrame) -> DataFrame:
    """One row of how many distinct workspaces the windows are on."""
    return windows.agg(F.count_distinct("workspace").alias("workspaces"))

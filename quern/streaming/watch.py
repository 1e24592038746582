"""From change events to scans: what counts, when a scan is due, and loops over micro-batches.

Streams keep state by key; the same rules over a table are in ``quern.streaming.debounce``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed, wait
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.providers import remembered
from quern.operators.tags import parent_of

# Quiet seconds before a scan, the most to wait, and minutes between scans in any case.
QUIET, MOST_WAIT, RESCAN_MINUTES = 1, 10, 5
#: Kinds of events that change what is indexed; reads and metadata do not.
CHANGES = ["create", "remove", "write", "rename"]
BATCHES = "key string, opened timestamp, due timestamp, events long"


def watched(folders: DataFrame, home: str, data: str) -> DataFrame:
    """(folder) to watch: those of the catalogue and the home itself, but none in the index's own folder."""
    every = folders.select(F.col("path").alias("folder")).union(folders.sparkSession.createDataFrame([(home,)], "folder string")).distinct()
    return every.where(~((F.col("folder") == data) | F.startswith("folder", F.lit(data + "/"))))


def matters(events: DataFrame, folders: DataFrame) -> DataFrame:
    """Events (kind, path, ts) that may change the index: changes right in a watched folder (folder), and
    ``overflow``, after which events are missing and everything is looked at."""
    changes = events.where(F.col("kind").isin(CHANGES)).withColumn("_folder", parent_of(F.col("path")))
    inside = changes.join(folders.select(F.col("folder").alias("_folder")), "_folder", "left_semi").drop("_folder")
    return inside.unionByName(events.where("kind = 'overflow'"))


def appeared(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(folder) that a scan found and the last did not have: files may have come before it was watched, so
    one more scan is due if there is any. The first scan knows none and asks for no other."""
    return scanned.join(known, "folder", "left_anti") if known.limit(1).count() else scanned.limit(0)


def due_batches(events: DataFrame, key: str, quiet: float = QUIET, most: float = MOST_WAIT) -> DataFrame:
    """(key, opened, due, events): batches of a stream of events (with a watermark on ``ts``), each closed
    ``quiet`` seconds after its last event or ``most`` after its first, whichever comes first.

    State is one open batch a key. Events of a micro-batch are taken in time order; a batch that no later
    event closes is closed when the watermark passes its due time.
    """

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        first = last = None
        n = 0
        if state.exists:
            first, last, n = state.get
        due = lambda: min(last + quiet, first + most)

        def close() -> None:
            out.append((keys[0], pd.Timestamp(first, unit="s"), pd.Timestamp(due(), unit="s"), n))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            times = sorted(t for p in parts for t in p["t"])
            for t in times:
                if n and t >= due():
                    close()
                    n = 0
                first, last, n = (first if n else t), t, n + 1
            state.update((float(first), float(last), int(n)))
            now = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(due() * 1000), now + 1))
        yield pd.DataFrame(out, columns=["key", "opened", "due", "events"]).astype({"events": "int64"})

    rows = events.select(F.col(key).cast("string").alias("key"), "ts", (F.unix_micros(F.col("ts")) / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(step, BATCHES, "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def rescans(wakes: DataFrame, scan: Callable[[], Any], minutes: float = RESCAN_MINUTES) -> DataStreamWriter:
    """A stream that scans every so many minutes and whenever ``wakes`` has rows; wakes that queue up while
    a scan runs are one more scan. Start it with ``start()``."""

    def run(rows: DataFrame, number: int) -> None:
        scan()

    return wakes.writeStream.foreachBatch(run).trigger(processingTime=f"{round(minutes * 60)} seconds")


def scanned(engine, root: str, rules: list[str] | None = None, most: int = 3) -> int:
    """Scan until no folder is new, ``most`` times; returns how often. Folders that appear while a scan
    runs may have had files before they were watched."""
    known = engine.folders().select(F.col("path").alias("folder")) if not engine.is_empty() else None
    for n in range(1, most + 1):
        engine.scan(root, rules)
        found = engine.folders().select(F.col("path").alias("folder"))
        if known is None or not appeared(found, known).limit(1).count():
            return n
        known = found
    return most


def latest(queries: DataFrame) -> DataFrame:
    """(plugin, query): of queries (plugin, seq, query) that wait, the newest of each plug-in; it never
    works through those that were typed past."""
    return queries.groupBy("plugin").agg(F.max_by("query", "seq").alias("query"))


def answers(queries: DataFrame, ask: Callable[[str, str], Any], seconds: float = 0.1) -> DataStreamWriter:
    """A stream that asks plug-ins the newest query of each micro-batch."""

    def run(rows: DataFrame, number: int) -> None:
        for r in latest(rows).toLocalIterator():  # a row a plug-in
            ask(r["plugin"], r["query"])

    return queries.writeStream.foreachBatch(run).trigger(processingTime=f"{round(seconds * 1000)} milliseconds")


def progressive(sections: dict[str, Callable[[], list]], first: float = 0.05) -> Iterator[dict[str, list]]:
    """Answers as they come: all that are there within ``first`` seconds together, then each for itself.
    Sections without rows are left out."""
    with ThreadPoolExecutor(max(1, len(sections))) as pool:
        running = {pool.submit(f): name for name, f in sections.items()}
        done, late = wait(running, timeout=first)
        yield {running[f]: rows for f in running if f in done and (rows := f.result())}
        for f in as_completed(late):
            if rows := f.result():
                yield {running[f]: rows}


def learn(engine, embedder, processors: list, labels: dict[str, str], private: list[str] | None = None) -> dict[str, int]:
    """One round after a scan: vectors of what is new, what processors say of it, vectors of that, labels."""
    told = {"embedded": engine.embed(embedder, private)["texts"]}
    told["processed"] = sum(engine.process(p, private)["done"] for p in processors)
    told["embedded"] += engine.embed(embedder, private)["texts"] if told["processed"] else 0
    engine.learn_labels(embedder, labels)
    return told


def learner(scans: DataFrame, engine, embedder, processors: list, labels: dict[str, str], seconds: float = 1) -> DataStreamWriter:
    """A stream of finished scans that learns after each micro-batch of them."""

    def run(rows: DataFrame, number: int) -> None:
        learn(engine, embedder, processors, labels)

    return scans.writeStream.foreachBatch(run).trigger(processingTime=f"{round(seconds * 1000)} milliseconds")


def recorder(copied: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], Any]) -> DataStreamWriter:
    """A stream of copies (text, copied) that are kept: each micro-batch is merged with those there."""

    def run(rows: DataFrame, number: int) -> None:
        save(remembered(load().select("text", "copied").unionByName(rows.select("text", "copied"))))

    return copied.writeStream.foreachBatch(run)

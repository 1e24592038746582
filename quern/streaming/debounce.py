"""Batches of change events, each closed by a quiet time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quiet_batches(events: DataFrame, quiet: int, *keys: str) -> DataFrame:
    """(keys, opened, due, events): runs of events with less than ``quiet`` seconds between them.

    The same plan serves a batch and, with a key and a watermark on ``ts``, a stream: session windows
    keep one open batch a key as state.
    """
    by = events.groupBy(*keys, F.session_window("ts", f"{quiet} seconds").alias("w"))
    out = by.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))
    return out.select(*keys, F.unix_timestamp("first").alias("opened"), (F.unix_timestamp("last") + quiet).alias("due"), "events")


def quiet_runs(events: DataFrame, quiet: int, span: int | None = None) -> DataFrame:
    """(opened, due, events): ``quiet_batches`` of all events of a table, without a key.

    Events of one moment are one row. Runs are found within spans of time, each in a task of its own; then
    only a span's first and last run, two rows a span, are compared with their neighbours and joined.
    """
    span = span or 1000 * quiet
    moments = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    moments = moments.withColumn("s", F.floor(F.col("t") / (span * 1_000_000)))
    order = Window.partitionBy("s").orderBy("t")
    new = F.coalesce(F.col("t") - F.lag("t").over(order) >= quiet * 1_000_000, F.lit(True))
    runs = moments.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    runs = runs.groupBy("s", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("n").alias("n"))
    ends = runs.groupBy("s").agg(F.max("run").alias("runs"))
    runs = runs.join(ends, "s")
    edge = (F.col("run") == 1) | (F.col("run") == F.col("runs"))
    along = Window.orderBy("first")
    apart = F.coalesce(F.col("first") - F.lag("last").over(along) >= quiet * 1_000_000, F.lit(True))
    joined = runs.where(edge).withColumn("apart", apart).withColumn("chain", F.sum(F.col("apart").cast("long")).over(along))
    joined = joined.groupBy("chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    out = joined.select("first", "last", "n").unionByName(runs.where(~edge).select("first", "last", "n"))
    seconds = lambda c: F.floor(F.col(c) / 1_000_000)
    return out.select(seconds("first").alias("opened"), (seconds("last") + quiet).alias("due"), F.col("n").alias("events"))


def capped_batches(events: DataFrame, key: str, quiet: int, most: int) -> DataFrame:
    """(key, opened, due, events) with batches that also close ``most`` seconds after they open.

    A batch opens at its first event and is due ``quiet`` seconds after its last, or ``most`` after its
    first; an event before that joins it. This order-dependent fold runs by key, in time order, keeping
    one open batch: rows stream through sorted partitions, and no key's events are gathered.
    """
    import pyarrow as pa

    def fold(batches):
        now, out = None, []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now and now[0] == k and t < min(now[2] + quiet, now[1] + most):
                    now = (k, now[1], t, now[3] + 1)
                else:
                    if now:
                        out.append(now)
                    now = (k, t, t, 1)
            yield _batch(pa, out, quiet, most)
            out = []
        yield _batch(pa, [now] if now else [], quiet, most)

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_timestamp("ts").alias("t"))
    rows = rows.repartition("key").sortWithinPartitions("key", "t")
    return rows.mapInArrow(fold, "key string, opened long, due long, events long")


def _batch(pa, rows, quiet: int, most: int):
    columns = [[r[0] for r in rows], [r[1] for r in rows], [min(r[2] + quiet, r[1] + most) for r in rows], [r[3] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "opened", "due", "events"])

"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule asks for the source into whose share the i-th golden-ratio point falls, so
every stretch of the schedule holds the sources in proportion. A slot's rank among those of its
source is the number of the block it gets: each source's rows, in a hash's order, form one stream of
tokens that starts anew when it ends, cut into blocks of equal length. A source whose target is few
such blocks has shorter ones of its own, which make up its target exactly, spread evenly over the slots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The golden ratio's fractional part times 2 ** 32, rounded to an odd number: slot i's point is
#: i times this, modulo 2 ** 32.
GOLDEN = 2654435769
POINTS = 1 << 32


@dataclass(frozen=True)
class Plan:
    source: str | None
    size: int
    target: float
    low: int = 0
    high: int = 0


def targets(sizes: list[tuple[str | None, int]], weights: list[float], most: float = 3.0) -> list[Plan]:
    """Sources by code point, null last, with weights repeating; their targets sum to all sizes.

    A target above ``most`` times its source's size stops there, and what it leaves is shared by
    weight among the others, until none is above.
    """
    own = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    w = {i: weights[i % len(weights)] for i in range(len(own))}
    total, fixed = sum(n for _, n in own), {}
    while True:
        free = [i for i in w if i not in fixed]
        share = (total - sum(fixed.values())) / sum(w[i] for i in free) if free else 0.0
        over = [i for i in free if share * w[i] > most * own[i][1]]
        if not over:
            break
        fixed |= {i: most * own[i][1] for i in over}
    plans, before = [], 0.0
    for i, (source, size) in enumerate(own):
        target = fixed.get(i, share * w[i] if i in free else 0.0)
        low = round(before / total * POINTS) if total else 0
        before += target
        plans.append(Plan(source, size, target, low, round(before / total * POINTS) if total else 0))
    return plans


def _ranked(df: DataFrame, by: str, amount: Column, total: str, order: list, scratch: Scratch, chunk: str) -> DataFrame:
    """``df`` (written) with ``total``: the sum of ``amount`` over the rows of its group before it.

    Sums by chunk are summed first, so no task sees more than one chunk of a group.
    """
    sums = df.groupBy(by, chunk).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inside.join(sums, [by, chunk]).withColumn(total, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")


@dataclass
class Mix:
    """rows: every input row with _source (its source's number), size and start in its stream.
    pieces: (slot, block, _source, _chunk, _place, epoch, start, length): what slots take of rows.
    A slot holds one block of ``block`` tokens, and shorter ones of sources with small targets."""

    rows: DataFrame
    pieces: DataFrame
    plans: list[Plan]
    block: int


def mix(df: DataFrame, key: str, source: str, size: str, weights: list[float], scratch: Scratch, most: float = 3.0, blocks: int = 1 << 20, seed: int = 1, fine: int = 1024, broadcast_rows: int = 100_000) -> Mix:
    """Mix rows of (key, source, size) to the targets of ``targets``.

    A block has the smallest length for which all tokens make ``blocks`` blocks at most. A source with
    a target below ``fine`` blocks takes exactly that target, in ``fine`` shorter blocks at most; the
    schedule leaves others off theirs by a few of their ``fine`` or more blocks. Rows are cut
    where blocks end, and a source's stream starts anew up to ``most`` times. Rows of size 0 and null
    keys take part like others; equal rows follow each other. All is set by the rows themselves, so
    reruns agree. The driver reads a row a source; tables of sources are broadcast while they have
    ``broadcast_rows`` at most.
    """
    spark = df.sparkSession
    totals = df.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n"), F.count("*").alias("rows")).collect()
    plans = targets([(r["s"], int(r["n"] or 0)) for r in totals], weights, most)
    total, rows = sum(p.size for p in plans), sum(r["rows"] for r in totals)
    block = max(1, -(-total // blocks))
    number = {p.source: i for i, p in enumerate(plans)}
    side = (lambda x: F.broadcast(x)) if len(plans) <= broadcast_rows else (lambda x: x)
    names = spark.createDataFrame([(i, s) for s, i in number.items()], "_source int, _name string")
    # About as many chunks as rows in each: both levels of every running sum grow as a square root.
    chunks = max(1, math.isqrt(rows))
    # All columns set the order, so rows that share a key, or have none, are spread too.
    h = F.xxhash64(F.lit(seed), F.col(key), *(F.col(f"`{c}`") for c in df.columns if c not in (key, source)))
    numbered = df.join(side(names), F.col(source).cast("string").eqNullSafe(F.col("_name"))).drop("_name")
    # Chunks split the hash's range evenly, in its order.
    numbered = numbered.withColumn("_h", h).withColumn("_chunk", F.floor((F.shiftrightunsigned("_h", 33) * chunks) / F.lit(1 << 31)).cast("int"))
    place = Window.partitionBy("_source", "_chunk").orderBy("_order", key, size)
    numbered = numbered.withColumn("_order", F.shiftrightunsigned("_h", 1))
    stream = scratch.table(numbered.withColumn("_place", F.row_number().over(place)))
    placed = scratch.table(_ranked(stream, "_source", F.col(size), "start", ["_place"], scratch, "_chunk").drop("_h", "_order"))

    # Sources of few blocks are not drawn: chance would give them no slot, or one too many.
    large = [i for i, p in enumerate(plans) if p.target >= fine * block]
    wide = sum(plans[i].target for i in large)
    slots = math.ceil(wide / block)
    exact = {i: n for i, p in enumerate(plans) if i not in set(large) and (n := round(p.target))}
    slot = spark.range(slots).withColumnRenamed("id", "slot")
    # i * GOLDEN mod 2 ** 32 in two halves, so that no product leaves 64 bits at any number of slots.
    low = F.pmod(F.col("slot"), F.lit(POINTS))
    point = F.pmod(F.pmod(F.shiftright(low, 16) * GOLDEN, F.lit(1 << 16)) * (1 << 16) + F.pmod(low, F.lit(1 << 16)) * GOLDEN, F.lit(POINTS))
    drawn = slot.withColumn("point", point)
    highs = [round(sum(plans[i].target for i in large[: n + 1]) / wide * POINTS) for n in range(len(large))]
    ids = large
    which = F.lit(None).cast("int")
    if len(ids) <= 64:
        for i, high in reversed(list(zip(ids, highs))):
            which = F.when(F.col("point") < high, i).otherwise(which)
        drawn = drawn.withColumn("_source", which)
    else:

        @F.pandas_udf("int")
        def find(points):  # a binary search in a table with a row a source
            return pd.Series(np.asarray(ids)[np.searchsorted(highs, points.to_numpy(), side="right")])

        drawn = drawn.withColumn("_source", find("point"))
    drawn = drawn.withColumn("_run", F.floor(F.col("slot") / max(1, math.isqrt(slots))).cast("int")).select("slot", "_source", "_run")
    ranked = _ranked(drawn, "_source", F.lit(1), "block", ["slot"], scratch, "_run").select("slot", "_source", "block")

    own = {i: -(-n // fine) for i, n in exact.items()}
    few = spark.createDataFrame([(i, -(-n // own[i])) for i, n in exact.items()], "_source int, _blocks long")
    few = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    few = few.select(F.floor((2 * F.col("block") + 1) * (slots or fine) / (2 * F.col("_blocks"))).alias("slot"), "_source", "block")
    ranked = ranked.unionByName(few)

    # What a source's slots take of its stream: blocks 0, 1, ... of the stream written ``most`` times.
    sizes = spark.createDataFrame([(i, p.size, own.get(i, block), exact.get(i, int(most * p.size))) for i, p in enumerate(plans)], "_source int, _size long, _block long, _stop long")
    taken = ranked.groupBy("_source").agg(F.max("block").alias("_last")).join(side(sizes), "_source")
    epochs = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    again = placed.where(F.col(size) > 0).join(side(taken), "_source").withColumn("epoch", F.explode(epochs))
    begin = (F.col("start") + F.col("epoch") * F.col("_size")).alias("_begin")
    again = again.select("_source", "_chunk", "_place", "epoch", begin, F.col(size).alias("_n"), "_last", "_block", "_stop")
    end = F.least(F.col("_begin") + F.col("_n"), F.col("_stop"))
    again = again.withColumn("_end", end).where("_end > _begin").withColumn("_first", F.floor(F.col("_begin") / F.col("_block"))).where("_first <= _last")
    held = F.sequence(F.col("_first"), F.least(F.floor((F.col("_end") - 1) / F.col("_block")), F.col("_last")))
    cut = again.withColumn("block", F.explode(held))
    a, b = F.greatest(F.col("_begin"), F.col("block") * F.col("_block")), F.least(F.col("_end"), (F.col("block") + 1) * F.col("_block"))
    cut = cut.select("_source", "_chunk", "_place", "epoch", "block", (a - F.col("_begin")).alias("from"), (b - a).alias("length"))
    pieces = ranked.join(cut, ["_source", "block"])
    return Mix(placed, pieces, plans, block)

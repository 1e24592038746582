"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; a cell is a pair of codes. A query takes
the cells in the order of the summed distances of its halves to the two centroids, by a heap over
both sorted lists, until they hold enough vectors, and all of these are reranked by exact distance.
How many are enough is measured: for a bounded set of probe vectors the true neighbours are found by
brute force, in blocks over all vectors, and the target share of them must lie in the cells taken.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass
class Index:
    """books: the halves' centroids; order, counts: codes of each non-empty cell (as one number) with
    its vectors; block: which block a cell's vectors are in; parts: into how many a block is split."""

    books: tuple[np.ndarray, np.ndarray]
    counts: dict[int, int]
    block: dict[int, int]
    parts: dict[int, int]
    enough: int = 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        half = self.books[0].shape[1]
        a, b = (_nearest(part, book) for part, book in zip((x[:, :half], x[:, half:]), self.books))
        return a.astype(np.int64) * len(self.books[1]) + b

    def cells(self, q: np.ndarray) -> Iterator[tuple[int, float]]:
        """Non-empty cells with their summed distances, in the order of these: the walk over both sorted lists, which merges the sums of each
        of the first list's centroids, opened when the one before it has given its nearest."""
        d = self.distances(q)
        orders = [np.argsort(x, kind="stable") for x in d]
        (a, b), (da, db) = [o.tolist() for o in orders], [x[o].tolist() for x, o in zip(d, orders)]
        width, counts, last = len(b), self.counts, len(b) - 1
        rows = [x * width for x in a]
        heap = [(da[0] + db[0], 0, 0)]
        while heap:
            far, i, j = heap[0]
            if j < last:
                heapq.heapreplace(heap, (da[i] + db[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if not j and i + 1 < len(rows):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            cell = rows[i] + b[j]
            if cell in counts:
                yield cell, far

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of a query's halves to the centroids."""
        half = self.books[0].shape[1]
        return tuple(((book - part) ** 2).sum(axis=1) for part, book in zip((q[:half], q[half:]), self.books))

    def reach(self, q: np.ndarray) -> tuple[set[int], float]:
        """Blocks of the cells that hold enough vectors, nearest cells first, and how far the last one is."""
        out, held, far = set(), 0, 0.0
        for cell, far in self.cells(q):
            out.add(self.block[cell])
            held += self.counts[cell]
            if held >= self.enough:
                break
        return out, far


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        out[i : i + 4096] = ((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    book = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, book)
        n = np.bincount(at, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, at, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    a = batch.column(column)
    n = batch.num_rows
    return np.asarray(a.flatten(), dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences, so that equal vectors are at 0."""
    out = np.empty((len(q), len(x)))
    for i in range(len(q)):
        d = x - q[i]
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): those that take part, v in double. Null keys, and vectors that are null, empty, zero
    or hold null or non-finite components, do not; nor do those of another length than the most
    frequent one (the smaller, if two are as frequent)."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def search(df: DataFrame, key: str, vector: str, is_query, k: int = 10, target: float = 0.95, least: int = 1000, sample: int = 20_000, probes: int = 200, block_rows: int = 4096, query_rows: int = 4096, max_codes: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query among all other rows.

    ``is_query`` is a condition on ``id``. Ties go to the smaller id. The codebooks are fitted on at
    most ``sample`` distinct vectors chosen by hash; every vector is in the index. Equal vectors are
    held once, with their k + 1 smallest ids, which is all that any list can name, so a vector that a
    third of all rows share costs no more than another. ``probes`` vectors are compared with all
    others, a block at a time, to set how many candidates a query reranks for a recall of ``target``; it
    reranks ``least`` at least, so small tables are searched whole. Rows that repeat an id with the same
    vector count once; an id with several vectors is as many rows, and a list names no row of its query's
    id. No vectors give no rows.

    A task holds one part of a block's vectors and of the queries that visit it, some ``block_rows`` and
    ``query_rows``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = vectors(df, key, vector).withColumn("h", F.xxhash64("v"))
    # In the order of ids within equal vectors; the first k + 1 of each partition go on.
    by = Window.partitionBy("h", "v").orderBy("id")
    firsts = rows.dropDuplicates(["id", "h"]).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    distinct = scratch.table(firsts.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("u", F.xxhash64("v", F.get("ids", F.lit(0)))))
    total = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sampled = np.array([r["v"] for r in distinct.select("u", "v").orderBy("u", "v").limit(sample).collect()])
    # Cells of few vectors each; a walk over many small cells prunes more than one over few large ones.
    codes = int(min(max_codes, max(2, min(math.sqrt(total), total / 8))))
    half = sampled.shape[1] // 2
    books = (_kmeans(sampled[:, :half], codes), _kmeans(sampled[:, half:], codes))
    shared = spark.sparkContext.broadcast(books)  # max_codes rows of a vector's length

    @F.arrow_udf("long")
    def cell_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, {}, {}, {})
        for v in batches:
            x = np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1)
            yield pa.array(index.codes(x) if len(v) else [], pa.int64())

    coded = scratch.table(distinct.withColumn("cell", cell_of("v")))
    counts = {int(r["cell"]): int(r["n"]) for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # max_codes ** 2 at most
    block, parts, at, held = {}, {}, 0, 0
    for cell in sorted(counts):
        if held and held + counts[cell] > block_rows:
            at, held = at + 1, 0
        block[cell] = at
        held += counts[cell]
        parts[at] = max(1, -(-held // block_rows))
    index = Index(books, counts, block, parts)
    index.enough = max(least, _enough(coded, index, k, target, probes))
    sent = spark.sparkContext.broadcast(index)

    # Queries are distinct vectors too; their ids come back at the end.
    asked = rows.where(is_query).select("h", "v", "id").dropDuplicates(["id", "h"])
    queries = scratch.table(asked.select("h", "v").distinct().withColumn("q", F.xxhash64("v")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            q, v = batch.column(0).to_pylist(), _rows(batch, 1)
            out = [[], [], [], []]
            for i in range(len(q)):
                blocks, far = index.reach(v[i])
                for b in blocks:
                    for part in range(index.parts[b]):
                        for column, x in zip(out, (b, part, i, far)):
                            column.append(x)
            at = pa.array(out[2], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(out[3], pa.float64())], names=["block", "part", "q", "v", "far"])

    visits = queries.select("q", "v").repartition(spark.sparkContext.defaultParallelism).mapInArrow(visit, "block long, part int, q long, v array<double>, far double")

    @F.arrow_udf("struct<block: long, part: int>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = sent.value
        for cell, u in batches:
            cells = cell.to_pylist()
            b = [index.block[c] for c in cells]
            p = [x % index.parts[y] for x, y in zip(u.to_pylist(), b)]
            yield pa.StructArray.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int32())], names=["block", "part"])

    # Queries of a part that many visit are dealt to several tasks, and its vectors go to each of these.
    visits = scratch.table(visits)
    deals = visits.groupBy("block", "part").agg(F.ceil(F.count("*") / query_rows).alias("deals"))
    visits = visits.join(deals, ["block", "part"]).withColumn("deal", F.pmod("q", F.col("deals"))).drop("deals")
    held = coded.withColumn("at", place("cell", "u")).select("at.block", "at.part", "cell", "v", "ids")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")
    held = held.join(deals, ["block", "part"]).select("block", "part", each, "cell", "v", "ids")

    def rerank(_, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(own):
            index = sent.value
            x, ids = np.stack(own["v"].to_numpy()), own["ids"].to_numpy()
            one, two = np.divmod(own["cell"].to_numpy(), len(index.books[1]))
            for q, v, far in zip(asked["q"], asked["v"], asked["far"]):
                a, b = index.distances(np.asarray(v))
                pick = np.flatnonzero(a[one] + b[two] <= far)  # the cells that the walk came to
                if not len(pick):
                    continue
                d = distances(v[None, :], x[pick])[0]
                # All vectors as near as the (k + 1)-th: ties are settled by id later.
                edge = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
                near = np.flatnonzero(d <= edge)
                pairs = sorted((d[j], int(i)) for j in near for i in ids[pick[j]])[: k + 1]
                out += [(q, i, s) for s, i in pairs]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    grouped = visits.groupBy("block", "part", "deal").cogroup(held.groupBy("block", "part", "deal"))
    found = grouped.applyInPandas(rerank, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    own = asked.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q")).join(lists, "q")
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(near).alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "near.vec_id", "near.score")


def _enough(coded: DataFrame, index: Index, k: int, target: float, probes: int) -> int:
    """Candidates a query must rerank so that ``target`` of the probes' true neighbours are among them."""
    chosen = coded.select("u", "v").orderBy(F.xxhash64("u"), "u").limit(probes).collect()
    q = np.array([r["v"] for r in chosen])
    sent = coded.sparkSession.sparkContext.broadcast(q)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.asarray(batch.column(0))
            x = _rows(batch, 1)
            for i in range(0, len(x), 2048):
                d = distances(sent.value, x[i : i + 2048])
                c = np.broadcast_to(cells[i : i + 2048], d.shape)
                if best:
                    d, c = np.concatenate((best[0], d), axis=1), np.concatenate((best[1], c), axis=1)
                o = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
                best = np.take_along_axis(d, o, 1), np.take_along_axis(c, o, 1)
        if best:
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sent.value)), n)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["i", "d", "cell"])

    got = coded.select("cell", "v").mapInArrow(near, "i long, d double, cell long")
    top = Window.partitionBy("i").orderBy("d", "cell")
    true = got.withColumn("r", F.row_number().over(top)).where((F.col("r") > 1) & (F.col("r") <= k + 1)).select("i", "cell").toPandas()
    need = []
    for i, cells in true.groupby("i")["cell"]:
        wanted, held = cells.tolist(), 0
        for cell, _ in index.cells(q[int(i)]):
            held += index.counts[cell]
            need += [held] * wanted.count(cell)
    need.sort()
    return need[min(len(need) - 1, math.ceil(target * len(need)) - 1)] if need else 1

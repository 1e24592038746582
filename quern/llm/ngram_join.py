"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Documents with equal n-gram sets are one class (by 128 bits of a hash of the set).
2. N-grams are put in one order for all, rare ones first; a class's prefix is the part of its set in
   which it must meet any class that it links to (n less the overlap that the size demands, plus 1).
   The prefixes' columns of the matrix are the blocks; each has a hub, the class with the fewest
   n-grams of its own.
3. The product is accumulated in folded columns: a class's whole set is kept as the parities of its
   n-grams in two to four bins an n-gram, and again folded to 4,096 bins at most (its sketch). Two rows'
   bins that differ are n-grams that only one of them has, so the overlap has an upper bound, and a pair
   whose bound is below what the sizes demand is discarded, by sketches first, then by all bins. Few
   others are not links; their overlaps are counted over whole sets.
4. Every class meets the hubs of its blocks. Only what did not link to a hub (loose) meets the other
   classes of its size that share a block with that hub, in tiles of sketches that one task multiplies in numpy:
   pairs of a tile are never rows, only those that the bound leaves are. As Jaccard distance is a
   metric, pairs whose distances to the hub differ by more than 1 - percent / 100 are left out, and so
   are those of one component. So no link between components is lost, and a group of n copies costs
   about n counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import components

from .common import Scratch, arrays
from .wordids import ngram_sets


#: 64-bit numbers of parities that meet in tiles; only larger sets have more, which are kept besides.
SKETCH = 64


def _least_overlap(n, percent: int):
    """The overlap that a link of a set of n n-grams needs, whatever the other's size."""
    return -(-percent * n // 100)


def frequent(docs: DataFrame, n: int, scratch: Scratch, most: int = 1_000_000, run: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that repeat, with about their documents: those that three documents hold within some
    ``run`` of n-grams. They only set the order, for which any numbers give whole results; the least
    count doubles until ``most`` are left, so the table is bounded (12 MB)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k[c > 2].view(np.int64)), pa.array(c[c > 2], pa.int64())], names=["g", "n"])

        held, size = [], 0
        for batch in batches:
            for own in ngram_sets(batch.column(0), n):
                held.append(own)
                size += len(own)
                if size >= run:
                    yield flush()
                    size = 0
        yield flush()

    found = scratch.table(docs.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))
    least = 3
    while (kept := found.where(F.col("n") >= least)).count() > most:
        least *= 2
    g, often = arrays(kept.select("g", "n"))
    scratch.drop(found)
    order = np.argsort(g := g.view(np.uint64))
    return g[order], often[order].astype(np.uint32)


def _bins(size: int) -> int:
    """Bins of a set: the power of two that is at least twice its size."""
    return max(64, 1 << (2 * size - 1).bit_length()) if size else 64


def folded(own: np.ndarray) -> bytes:
    """Of each bin (the low bits of an n-gram), whether an odd number of the set's n-grams is in it."""
    m = _bins(len(own))
    odd = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _halved(rows: np.ndarray) -> np.ndarray:
    """The parities in half as many bins; rows of 64-bit numbers."""
    half = rows.shape[-1] // 2
    if half:
        return rows[..., :half] ^ rows[..., half:]
    return (rows ^ (rows >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def sketch(bins: bytes, most: int = SKETCH) -> bytes:
    """The parities in at most ``most`` 64-bit numbers."""
    rows = np.frombuffer(bins, np.uint64)
    while len(rows) > most:
        rows = _halved(rows)
    return rows.tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the n-grams that only one of two sets has, from their parities."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = _halved(a)
    while len(b) > len(a):
        b = _halved(b)
    return int(np.bitwise_count(a ^ b).sum())


def _told(docs: DataFrame, n: int, percent: int, table, hot: int) -> DataFrame:
    """(doc_id, k, k2, n, c, bins, sketch, prefix, hot_from, rare): k and k2 name the text, c the class; from
    hot_from on, the prefix's n-grams are in over ``hot`` documents; rare is the share of it, in
    thousandths, that no frequent n-gram fills. A copy's own words come first in its prefix, so of a
    group of copies the one that they all stem from, which is nearest to each, has the least of them."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        names = ["doc_id", "k", "k2", "n", "c", "bins", "sketch", "prefix", "hot_from", "rare"]
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                sizes, classes, bins, prefixes, hots, rares = [], [], [], [], [], []
                for own in ngram_sets(batch.column(3), n):
                    size = len(own)
                    sizes.append(size)
                    classes.append(xxhash.xxh3_128_digest(own.tobytes()))
                    bins.append(folded(own))
                    count = np.zeros(size, np.uint32)
                    if len(common) and size:
                        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        known = common[at] == own
                        count[known] = counts[at[known]]
                    take = size - _least_overlap(size, percent) + 1 if size else 0
                    order = np.argsort(count, kind="stable")[:take]  # own is in order already
                    prefixes.append(own[order].view(np.int64))
                    hots.append(int((count[order] <= hot).sum()))
                    rares.append(int(1000 * (count[order] == 0).sum() / take) if take else 0)
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                values = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
                made = [pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array([x if len(x) > 8 * SKETCH else None for x in bins], pa.binary()), pa.array(map(sketch, bins), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(hots, pa.int32()), pa.array(rares, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k", "k2", "text").mapInArrow(run, f"doc_id {kind}, k long, k2 long, n long, c binary, bins binary, sketch binary, prefix array<long>, hot_from int, rare int")


def _numbered(told: DataFrame) -> DataFrame:
    """``told`` with 64-bit numbers for the 128-bit classes: a hash under which no two of them are one."""
    for seed in range(100):
        out = told.withColumn("c", F.xxhash64(F.lit(seed), "c"))
        both = told.select(F.xxhash64(F.lit(seed), "c").alias("x"), "c").distinct().groupBy("x").count()
        if not both.where("count > 1").limit(1).count():
            return out
    raise RuntimeError("no numbers without collisions")


def _possible(nx: Column, ny: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of these sizes that share the n-grams at places i and j can link."""
    overlap = F.least(i, j) + 1 + F.least(nx - i, ny - j) - 1
    return (F.least(nx, ny) * 100 >= percent * F.greatest(nx, ny)) & (overlap * (100 + percent) >= percent * (nx + ny))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, column: str) -> DataFrame:
    """Those of ``pairs`` (a, b) of classes whose parities (``column``) leave room for the overlap of a link."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.coalesce(column, "sketch").alias(f"bins{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "binsa", "binsb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(i)) for i in (2, 3))
            far = np.array([apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            # overlap <= (na + nb - far) / 2 must be at least percent / (100 + percent) of na + nb
            ok = (na + nb - far) * (100 + percent) >= 2 * percent * (na + nb)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return met.mapInArrow(keep, "a long, b long")


def _overlaps(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, scratch: Scratch, chunk: int = 500, broadcast_rows: int = 200_000) -> DataFrame:
    """``pairs`` (a, b) of classes, written, with the overlap of their whole sets.

    A task reads a's set once and then the sets of up to about ``chunk`` b, one by one; a class with
    more partners is dealt to several tasks.
    """
    ends = pairs.select(F.col("a").alias("c")).unionAll(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = scratch.table(ends.join(classes, "c").select("k", "k2", "c"))
    side = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = [], []
                for c, own in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1), n)):
                    if c not in seen:
                        seen.add(c)
                        out[0].append(c)
                        out[1].append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["c", "own"])

    held = docs.select("k", "k2", "text").join(side(wanted), ["k", "k2"]).select("c", "text").mapInArrow(sets, "c long, own binary")
    # Where each set is needed: as a hub in all parts of its pairs, as a member in one.
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    members = pairs.select("a", "b").join(parts, "a").select(F.col("b").alias("c"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    hubs = parts.select(F.col("a").alias("c"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    places = scratch.table(hubs.unionAll(members))
    rows = held.join(side(places), "c").select("a", "part", "b", "own")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, last = None, None, None
        for batch in batches:
            out = [], [], []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b is None:
                    hub, own = a, np.frombuffer(x.as_py(), np.uint64)
                elif hub == a and (a, b) != last:  # a text read by several tasks comes more than once
                    other = np.frombuffer(x.as_py(), np.uint64)
                    less, more = (own, other) if len(own) < len(other) else (other, own)
                    at = np.minimum(np.searchsorted(more, less), len(more) - 1)
                    for column, value in zip(out, (a, b, int((more[at] == less).sum()))):
                        column.append(value)
                    last = (a, b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "overlap"])

    out = scratch.table(rows.select("a", "b", "own").mapInArrow(count, "a long, b long, overlap long"))
    for x in (wanted, places):
        scratch.drop(x)
    return out


class _Tile:
    """Rows of one hub that meet: loose ones (probes) with others (targets)."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rows: tuple[list, list] = ([], [])

    def add(self, probe: bool, row: tuple) -> None:
        self.rows[probe].append(row)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs (smaller, larger) of different components that bounds do not rule out."""
        targets, p = sorted(self.rows[0], key=lambda r: r[1]), self.percent
        if not targets or not self.rows[1]:
            return
        n = np.array([r[1] for r in targets])
        number: dict[int, int] = {}
        part = np.array([number.setdefault(r[2], len(number)) for r in targets])
        loose = np.array([r[3] for r in targets])
        far = np.array([np.nan if r[4] is None else r[4] for r in targets])
        words = np.array([len(r[5]) // 8 for r in targets])
        levels: dict[int, tuple[int, np.ndarray]] = {}  # of each length: the first target, and rows folded to it
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)  # sizes are in order, so these stand together
            levels[w] = int(at[0]), np.frombuffer(b"".join(targets[i][5] for i in at), np.uint64).reshape(len(at), w)
        for b, size, component, _, distance, bins in self.rows[1]:
            own = np.frombuffer(bins, np.uint64)
            low, high = np.searchsorted(n, -(-p * size // 100)), np.searchsorted(n, 100 * size // p, side="right")
            for w, (first, table) in levels.items():
                a, z = max(low, first), min(high, first + len(table))
                if a >= z:
                    continue
                pick = np.arange(a, z)[part[a:z] != number.get(component, -1)]
                if distance is not None:
                    pick = pick[~(np.abs(far[pick] - distance) > 1 - p / 100 + 1e-9)]
                if not len(pick):
                    continue
                rows, x = table[pick - first], own
                while rows.shape[1] > len(x):
                    rows = _halved(rows)
                while len(x) > rows.shape[1]:
                    x = _halved(x)
                other = np.bitwise_count(rows ^ x).sum(axis=1, dtype=np.int64)
                for i in pick[(size + n[pick] - other) * (100 + p) >= 2 * p * (size + n[pick])].tolist():
                    if not loose[i] or targets[i][0] < b:
                        yield min(b, targets[i][0]), max(b, targets[i][0])


def _tiles(open_: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) that sketches leave among the rows (hub, size, b, n, component, linked, distance,
    sketch) of each hub and size.

    Loose rows and all rows of a group are dealt to tiles of about ``most`` of each, so a task's memory is
    bounded; a tile's rows come sorted by tile and the pairs stay inside the task."""
    sizes = open_.groupBy("hub", "size").agg(F.ceil(F.sum((~F.col("linked")).cast("long")) / most).alias("_l"), F.ceil(F.count("*") / most).alias("_t"))
    rows = open_.join(sizes, ["hub", "size"])
    h = F.xxhash64("b")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    payload = ["b", "n", "component", "linked", "distance", "sketch"]
    probes = rows.where("not linked").select("hub", "size", F.pmod(h, F.col("_l")).alias("i"), each(F.col("_t")).alias("j"), F.lit(True).alias("probe"), *payload)
    targets = rows.select("hub", "size", each(F.col("_l")).alias("i"), F.pmod(h, F.col("_t")).alias("j"), F.lit(False).alias("probe"), *payload)
    dealt = probes.unionAll(targets).repartition("hub", "size", "i", "j").sortWithinPartitions("hub", "size", "i", "j")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, _Tile(percent)

        def out() -> pa.RecordBatch:
            found = list(tile.pairs())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, probe, *row in zip(zip(*(batch.column(i).to_pylist() for i in range(4))), *(batch.column(i).to_pylist() for i in range(4, 11))):
                if key != now:
                    if now is not None:
                        yield out()
                    now, tile = key, _Tile(percent)
                row[3] = not row[3]
                tile.add(probe, tuple(row))
        if now is not None:
            yield out()

    return dealt.select("hub", "size", "i", "j", "probe", *payload).mapInArrow(multiply, "a long, b long").distinct()


def link(df: DataFrame, doc_id: str, text: str, n: int = 4, percent: int = 85, hot: int = 2000, tile: int = 4096) -> DataFrame:
    """(doc_id, k, k2, n_shingles, c, component_id) of every row: k and k2 name its text, c its set's class.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct
    word n-grams; component_id is the smallest doc_id that links lead to, its own included. A null
    text, or one without words, has an empty set and links with nothing, not even its like. Rows
    with equal sets link, rows that repeat a doc_id too; a null doc_id is never the smallest unless
    its component has no other. An empty table gives no rows. Other columns are not read, so their
    names may be any.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    own = F.col(text)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(own).alias("k"), F.xxhash64(F.lit(7), own).alias("k2"), own.cast("string").alias("text"))
    told = _numbered(scratch.table(_told(docs, n, percent, frequent(docs, n, scratch), hot)))
    filled = told.where("n > 0")
    first = F.min(F.struct("k", "k2"))
    classes = filled.groupBy("c").agg(F.min("doc_id").alias("label"), first.alias("k"), F.min("n").cast("int").alias("n"), F.min("bins").alias("bins"), F.min("sketch").alias("sketch"))
    classes = scratch.table(classes.select("c", "label", "k.k", "k.k2", "n", "bins", "sketch"))
    posted = filled.select("c", F.col("n").cast("int").alias("n"), "rare", "hot_from", F.posexplode("prefix").alias("i", "g"))
    least = [F.min(x).alias(x) for x in ("n", "i", "rare")]
    member = F.struct("rare", "c", "n", "i")
    # Common blocks are few and have many rows: sums and a small table. The others are dealt by block,
    # and copies, which are of one class, fall away there.
    by = Window.partitionBy("g")
    cold = posted.where("i < hot_from").select("g", "c", "n", "i", "rare").repartition("g").groupBy("g", "c").agg(*least)
    cold = cold.withColumn("size", F.count("*").over(by)).where("size > 1").withColumn("hub", F.min(member).over(by))
    warm = posted.where("i >= hot_from").groupBy("g", "c").agg(*least)
    tops = warm.groupBy("g").agg(F.count("*").alias("size"), F.min(member).alias("hub")).where("size > 1")
    # In a block, only what has a size that another member's allows can link to one other than the hub.
    # The nearest sizes tell it.
    cold = cold.where("c <> hub.c")
    sized = Window.partitionBy("g").orderBy("n")
    nearest = F.greatest(F.lag("n").over(sized) / F.col("n"), F.col("n") / F.lead("n").over(sized))
    cold = cold.withColumn("more", F.coalesce(nearest >= percent / 100 - 1e-9, F.lit(False)))
    columns = ["hub", "c", "n", "i", "more"]
    warm = warm.join(tops, "g").where("c <> hub.c").withColumn("more", F.col("size") > 2)
    blocks = cold.select(*columns).unionAll(warm.select(*columns))
    fits = _possible(F.col("hub.n"), F.col("n"), F.col("hub.i"), F.col("i"), percent)
    # One row for a class and a hub, however many blocks they share.
    met = blocks.select(F.col("hub.c").alias("hub"), F.col("c").alias("b"), fits.alias("fits"), "more")
    met = scratch.table(met.groupBy("hub", "b").agg(F.max("fits").alias("fits"), F.max("more").alias("more")))
    pairs = scratch.table(_likely(met.where("fits").select(F.col("hub").alias("a"), "b"), classes, percent, "sketch"))
    pairs = scratch.table(_likely(pairs, classes, percent, "bins"))
    sizes = classes.select("c", "n")
    firsts = scratch.table(_measured(_overlaps(pairs, classes, docs, n, scratch), sizes, percent))
    found = scratch.table(components(firsts.where("linked").select("a", "b"), scratch))

    named = found.withColumnRenamed("node", "b")
    far = met.where("more").select("hub", "b").join(firsts.select(F.col("a").alias("hub"), "b", "linked", "distance"), ["hub", "b"], "left")
    far = far.withColumn("linked", F.coalesce("linked", F.lit(False))).join(named, "b", "left").join(sizes.withColumnRenamed("c", "b"), "b")
    # Sizes in steps of the least ratio of a link: sets that link are of one step or of two that adjoin,
    # so a row is in the group of its step and in that of the next.
    step = F.floor(F.log("n") / np.log(1 / (percent / 100 - 0.001))).cast("int")
    far = scratch.table(far.select("hub", "b", "linked", "distance", F.coalesce("component", "b").alias("component"), "n", F.explode(F.array(step, step + 1)).alias("size")))
    # Groups with a loose member, and members of more than one component.
    wide = far.groupBy("hub", "size").agg(F.min("linked").alias("all"), F.min("component").alias("x"), F.max("component").alias("y")).where("not all and x <> y").select("hub", "size")
    open_ = scratch.table(far.join(wide, ["hub", "size"]).join(classes.select(F.col("c").alias("b"), "sketch"), "b"))
    rest = scratch.table(_likely(_tiles(open_, percent, tile), classes, percent, "bins"))
    if rest.limit(1).count():
        second = _measured(_overlaps(rest, classes, docs, n, scratch), sizes, percent)
        more = second.where("linked").select("a", "b")
        found = scratch.table(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), scratch))
    for x in (met, pairs, far, open_, rest):
        scratch.drop(x)
    part = classes.select("c", "label").join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = part.groupBy("component").agg(F.min("label").alias("component_id"))
    final = part.join(smallest, "component").select("c", "component_id")
    out = told.select("doc_id", "k", "k2", F.col("n").alias("n_shingles"), "c").join(final, "c", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k", "k2", "n_shingles", "c", own.alias("component_id"))


def _measured(counted: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    both = counted.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    union = F.col("na") + F.col("nb") - F.col("overlap")
    return both.select("a", "b", (100 * F.col("overlap") >= percent * union).alias("linked"), (1 - F.col("overlap") / union).alias("distance"))

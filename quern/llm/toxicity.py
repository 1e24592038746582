"""Toxicity by class-conditional Kneser-Ney models of words and word pairs.

Each class has a bigram model. Its absolute discounts are in proportion to the class's size, so both
classes see at the same resolution, and what is discounted goes to counts that both share: of pairs,
and below them continuation counts (after how many words a word stands). An expression too rare to
pass the discount in either class is thus scored by the shared counts alone and says nothing, and so
is one whose counts differ from the shared ones by no more than chance would.
A text's evidence is its length-normalised log-likelihood difference, over the whole text and over
its most toxic stretch; a logistic function of both, fitted on labelled rows that the counts have
not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrays
from .wordids import FACTORS, LETTERS, mixed, word_hashes

#: Words of a stretch, and words that are added to every length so that one word is no proof.
STRETCH, PRIOR = 24, 4


def _ids(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words: runs of letters, A-Z folded."""
    for _, words, ends in word_hashes(texts, LETTERS):
        yield from np.split(words, ends[:-1])


def _once(keys: np.ndarray) -> np.ndarray:
    """A document counts an expression once, so long or repetitive ones weigh no more than others."""
    return np.unique(keys)


def _summed(keys: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
    """Counts by key and class of one batch."""
    parts = []
    for c in (0, 1):
        own = [k for k, x in zip(keys, classes) if x == c]
        k, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, np.uint64), np.empty(0, np.int64))
        parts.append((k, n * (c == 0), n * (c == 1)))
    k, n0, n1 = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], names=["k", "n0", "n1"])


def _counts(train: DataFrame, keys_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield _summed([_once(keys_of(x)) for x in _ids(part.column(0))], part.column(1).to_pylist())

    got = train.select("text", "label").mapInArrow(run, "k long, n0 long, n1 long")
    return got.groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _sure(gain: np.ndarray, seen: np.ndarray, expected: np.ndarray, z: float = 3.0) -> np.ndarray:
    """``gain`` shrunk to nothing where the count is within ``z`` deviations of what the shared counts expect."""
    surprise = 2 * (seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)) - (seen - expected))
    return gain * np.maximum(1 - z * z / np.maximum(surprise, 1e-9), 0)


def _evidence(gains: np.ndarray) -> tuple[float, float]:
    """Of a whole text, and of its most toxic stretch."""
    if not len(gains):
        return 0.0, 0.0
    whole = float(gains.sum()) / (len(gains) + PRIOR)
    if len(gains) <= STRETCH:
        return whole, float(gains.sum()) / (STRETCH + PRIOR)
    run = np.concatenate(([0.0], np.cumsum(gains)))
    return whole, float((run[STRETCH:] - run[:-STRETCH]).max()) / (STRETCH + PRIOR)


def _logistic(evidence: np.ndarray, label: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the logistic function by Newton steps with a slight ridge."""
    x = np.column_stack((np.ones(len(label)), evidence))
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3) * len(label) / 100
        w += np.linalg.solve(h, x.T @ (label - p) - 1e-3 * w * len(label) / 100)
    return w


class Model:
    """Tables of the words and pairs that pass the discount in a class, and the scoring by them."""

    def __init__(self, words, n, totals, pairs, m, discounts, continuation):
        order = np.argsort(words)
        self.words, n = words[order], n[order].astype(float)
        size = len(words)
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        shared = (continuation[order] + 1.0) / (continuation.sum() + size) if size else np.empty(0)
        first, second = (rank[pairs // max(size, 1)], rank[pairs % max(size, 1)]) if size else (pairs, pairs)
        keys = first * size + second
        by = np.argsort(keys)
        self.pairs, first, second, m = keys[by], first[by], second[by], m[by].astype(float)
        pooled = n.sum(axis=1) / max(sum(totals), 1)
        together = m.sum(axis=1) / np.maximum(n.sum(axis=1)[first], 1)
        p, high = [], []
        for c in (0, 1):
            d, total = discounts[c], max(totals[c], 1)
            p.append((np.maximum(n[:, c] - d, 0) + np.minimum(n[:, c], d).sum() * shared) / total + 1e-12)
            over = np.maximum(m[:, c] - d, 0) / np.maximum(n[first, c], 1)
            taken = np.bincount(first, over, minlength=size)[:size] if size else np.empty(0)
            # Both classes back off to the same pair counts, with the class's own taste for the word.
            high.append(over + np.maximum(1 - taken, 0)[first] * together * (p[c] / pooled)[second] + 1e-12)
        ratio = [x / pooled for x in p]
        self.word_gain = _sure(np.log(p[1] / p[0]), n[:, 1], n.sum(axis=1) * totals[1] / max(sum(totals), 1))
        # A pair adds to its second word what counts of the pair show beyond that word's own ratio.
        own = self.word_gain[second]
        expected = [totals[c] * ratio[c][second] for c in (0, 1)]
        expected = m.sum(axis=1) * expected[1] / np.maximum(expected[0] + expected[1], 1e-12)
        self.pair_gain = own + _sure(np.log(high[1] / high[0]) - own, m[:, 1], expected)
        self.weights = np.array([-3.0, 1.0, 1.0])

    def gains(self, ids: np.ndarray) -> np.ndarray:
        """Log-likelihood differences of the words of a text, in order."""
        out = np.zeros(len(ids))
        if not len(ids) or not len(self.words):
            return out
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        known = self.words[at] == ids
        out[known] = self.word_gain[at[known]]
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both) and len(self.pairs):
            key = at[both - 1] * len(self.words) + at[both]
            j = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[j] == key
            out[both[hit]] = self.pair_gain[j[hit]]
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """A row for each text."""
        return np.array([_evidence(self.gains(x)) for x in _ids(texts)]).reshape(-1, 2)

    def scores(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(weights[0] + self.evidence(texts) @ weights[1:], -30, 30)))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * FACTORS[0] + b * FACTORS[1])


class _Filter:
    """A Bloom filter of at most ``most_bits``, made by the executors: ``holds`` is true of every hash that
    is in the table and of few others."""

    def __init__(self, keys: DataFrame, hashed, count: int, most_bits: int = 1 << 28):
        size = 64
        while size < min(12 * count, most_bits):
            size *= 2
        self.size = size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.sort(np.concatenate(_spots(hashed(*(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)), size)))
                slot, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
                new = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
                bits = np.bitwise_or.reduceat(bit, new) if len(new) else bit
                yield pa.RecordBatch.from_arrays([pa.array(slot[new].view(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

        got = keys.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
        slot, bits = arrays(got)
        self.bits = np.zeros(size // 64, np.uint64)
        self.bits[slot] = bits.view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in _spots(h, self.size):
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _spots(h: np.ndarray, size: int) -> list[np.ndarray]:
    step = mixed(h) | np.uint64(1)
    return [(h + np.uint64(i) * step) & np.uint64(size - 1) for i in range(4)]


def _commonest(df: DataFrame, n: str, most: int) -> tuple[DataFrame, bool]:
    """Rows of the highest ``n``, at most ``most``, and whether these are all."""
    least = 1
    while (common := df.where(F.col(n) >= least)).count() > most:
        least *= 2
    return common, least == 1


def _lists(values: list[np.ndarray | None], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in values]))).astype(np.int32)
    flat = np.concatenate([x for x in values if x is not None] or [np.empty(0)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind), mask=pa.array([x is None for x in values], pa.bool_()))


class Tables:
    """The same model where it is too large to broadcast: gains of words (k, gain) and of pairs (a, b,
    gain) are tables. The ``most`` commonest words and pairs are looked up where the texts are read, and
    filters tell which others the tables have; only these become rows, which are joined. So the rows
    on disk are of rare expressions, not of all places of all texts.

    ``pairs`` are those of ``words`` with their counts (a, b, n0, n1), counted here if not given."""

    def __init__(self, counted: DataFrame, words: DataFrame, totals: list[int], discounts: list[float], most: int, scratch: Scratch, pairs: DataFrame | None = None):
        self.scratch, self.weights = scratch, np.array([-3.0, 1.0, 1.0])
        every, spans = max(sum(totals), 1), [max(t, 1) for t in totals]
        words = scratch.table(words)
        if pairs is None:
            pairs = _pair_counts(counted)
            for side in ("a", "b"):
                pairs = pairs.join(words.select(F.col("k").alias(side)), side, "left_semi")
            pairs = scratch.table(pairs)
        after = pairs.groupBy(F.col("b").alias("k")).agg(F.count("*").alias("after"))
        words = scratch.table(words.join(after, "k", "left").withColumn("after", F.coalesce("after", F.lit(0))))
        size, behind, *lost = words.agg(F.count("*"), F.sum("after"), *(F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(discounts[c]))) for c in (0, 1))).first()
        both, shared = F.col("n0") + F.col("n1"), (F.col("after") + 1.0) / float((behind or 0) + (size or 1))
        p = [(F.greatest(F.col(f"n{c}") - discounts[c], F.lit(0.0)) + float(lost[c] or 0) * shared) / spans[c] + 1e-12 for c in (0, 1)]
        words = words.select("k", "n0", "n1", (both / every).alias("pooled"), p[0].alias("p0"), p[1].alias("p1"))
        self.words = words.withColumn("gain", _sure_column(F.log(F.col("p1") / F.col("p0")), F.col("n1"), both * float(totals[1]) / every))
        self.words = scratch.table(self.words.withColumn("n", both))

        kept = pairs.where((F.col("n0") > discounts[0]) | (F.col("n1") > discounts[1])).select("a", "b", F.col("n0").alias("m0"), F.col("n1").alias("m1"))
        first = self.words.select(F.col("k").alias("a"), "n0", "n1")
        second = self.words.select(F.col("k").alias("b"), (F.col("p0") / F.col("pooled")).alias("r0"), (F.col("p1") / F.col("pooled")).alias("r1"), F.col("gain").alias("own"))
        kept = kept.join(first, "a")
        kept = kept.withColumns({f"over{c}": F.greatest(F.col(f"m{c}") - discounts[c], F.lit(0.0)) / F.greatest(F.col(f"n{c}"), F.lit(1)) for c in (0, 1)})
        kept = scratch.table(kept.join(second, "b"))
        taken = kept.groupBy("a").agg(F.sum("over0").alias("taken0"), F.sum("over1").alias("taken1"))
        m = F.col("m0") + F.col("m1")
        together = m / F.greatest(F.col("n0") + F.col("n1"), F.lit(1))
        high = [F.col(f"over{c}") + F.greatest(1 - F.col(f"taken{c}"), F.lit(0.0)) * together * F.col(f"r{c}") + 1e-12 for c in (0, 1)]
        expected = [float(totals[c]) * F.col(f"r{c}") for c in (0, 1)]
        expected = m * expected[1] / F.greatest(expected[0] + expected[1], F.lit(1e-12))
        gain = F.col("own") + _sure_column(F.log(high[1] / high[0]) - F.col("own"), F.col("m1"), expected)
        self.pairs = scratch.table(kept.join(taken, "a").select("a", "b", gain.alias("gain"), m.alias("m")))
        scratch.drop(kept)
        common, all_words = _commonest(self.words, "n", most)
        k, own = arrays(common.select("k", "gain"))
        order = np.argsort(k := k.view(np.uint64))
        told = [k[order], own[order]]
        common, all_pairs = _commonest(self.pairs, "m", most)
        a, b, own = arrays(common.select("a", "b", "gain"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        order = np.argsort(h := _pair_hash(a, b))
        told += [h[order], a[order], b[order], own[order]]
        told.append(None if all_words else _Filter(self.words.select("k"), mixed, size))
        told.append(None if all_pairs else _Filter(self.pairs.select("a", "b"), _pair_hash, self.pairs.count()))
        self.all_words, self.common = all_words, counted.sparkSession.sparkContext.broadcast(tuple(told))

    def evidence(self, texts: DataFrame) -> DataFrame:
        """(_t, _u, a, b), written: evidence of each distinct text of ``texts`` (text) by two hashes of
        it. Texts without any are left out: theirs is 0."""
        common = self.common
        fields = {"_t": pa.int64(), "_u": pa.int64(), "n": pa.int32(), "a": pa.int64(), "b": pa.int64(), "spots": pa.list_(pa.int32()), "gains": pa.list_(pa.float64()), "x": pa.float64(), "y": pa.float64()}

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of a text that the commonest expressions settle, its evidence (x, y); of another, what they give
            (spots and gains), and a row for each distinct pair that is to be looked up: the word b after a
            (null at the start), its places, and the word's own gain if known."""
            known, gains, hashes, firsts, seconds, pair_gains, rare_words, rare_pairs = common.value
            for batch in batches:
                rows: list[tuple] = []
                for t, u, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _ids(batch.column(2))):
                    if not len(ids):
                        continue
                    own, hit = np.zeros(len(ids)), np.zeros(len(ids), bool)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                        hit = known[at] == ids
                        own[hit] = gains[at[hit]]
                    sought = ~hit & rare_words.holds(mixed(ids)) if rare_words else np.zeros(len(ids), bool)
                    found, a, b = own.copy(), ids[:-1], ids[1:]
                    h = _pair_hash(a, b)
                    there = np.zeros(len(h), bool)
                    if len(hashes) and len(h):
                        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        there = (firsts[at] == a) & (seconds[at] == b)
                        found[1:][there] = pair_gains[at[there]]
                    sought[1:] &= ~there
                    if rare_pairs:
                        sought[1:] |= ~there & rare_pairs.holds(h)
                    if not sought.any():
                        if found.any():
                            rows.append((t, u, len(ids), None, None, None, None, *_evidence(found)))
                        continue
                    found[sought] = 0
                    if len(at := np.flatnonzero(found)):
                        rows.append((t, u, len(ids), None, None, at, found[at], None, None))
                    places = np.flatnonzero(sought)
                    before, after, start = ids[np.maximum(places - 1, 0)], ids[places], places == 0
                    order = np.lexsort((places, after, before, start))
                    x, y, z = before[order], after[order], start[order]
                    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))))
                    for spots in np.split(places[order], new[1:]):
                        i = int(spots[0])
                        rows.append((t, u, len(ids), int(ids[i - 1].view(np.int64)) if i else None, int(ids[i].view(np.int64)), spots, own[i : i + 1] if hit[i] else None, None, None))
                columns = [list(x) for x in zip(*rows)] or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([_lists(c, k.value_type) if pa.types.is_list(k) else pa.array(c, k) for c, k in zip(columns, fields.values())], names=list(fields))

        told = texts.where("text is not null").select(*_text_keys(F.col("text")), "text")
        found = self.scratch.table(told.mapInArrow(places, "_t long, _u long, n int, a long, b long, spots array<int>, gains array<double>, x double, y double"))
        settled = found.where("x is not null").select("_t", "_u", F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        rows = found.where("x is null").drop("x", "y").dropDuplicates(["_t", "_u", "a", "b"])  # copies come once
        rows = self.scratch.table(rows.withColumn("own", F.when(F.col("b").isNotNull(), F.col("gains")[0])))
        given, sought = rows.where("b is null"), rows.where("b is not null")
        if not self.all_words:
            rare = sought.where("own is null").drop("own").join(self.words.select(F.col("k").alias("b"), F.col("gain").alias("own")), "b", "left")
            sought = sought.where("own is not null").unionByName(rare.select(*sought.columns))
        sought = sought.join(self.pairs.select("a", "b", "gain"), ["a", "b"], "left").withColumn("gain", F.coalesce("gain", "own", F.lit(0.0))).where("gain <> 0")
        both = given.select("_t", "_u", "n", "spots", "gains").unionAll(sought.select("_t", "_u", "n", "spots", F.array("gain")))
        both = both.groupBy("_t", "_u").agg(F.first("n").alias("n"), F.collect_list(F.struct("spots", "gains")).alias("of"))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for n, of in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    gains = np.zeros(n)
                    for x in of:
                        gains[x["spots"]] = x["gains"]
                    out.append(_evidence(gains))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], pa.float64()) for i in (0, 1))], names=["_t", "_u", "a", "b"])

        out = self.scratch.table(settled.unionAll(both.mapInArrow(summed, "_t long, _u long, a double, b double")))
        for x in (found, rows):
            self.scratch.drop(x)
        return out

    def scores(self, df: DataFrame, text: str, column: str, broadcast_rows: int = 400_000) -> DataFrame:
        own = F.col(text).cast("string")
        w = [float(x) for x in self.weights]
        told = self.evidence(df.select(own.alias("text")))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), w[0] + w[1] * F.col("a") + w[2] * F.col("b")))))
        told = told.select("_t", "_u", score.alias("_score"))
        start = 1 / (1 + np.exp(-np.clip(w[0], -30, 30)))
        small = told.limit(broadcast_rows + 1).count() <= broadcast_rows
        columns = [c for c in df.columns if c != column]
        rows = df.withColumns(dict(zip(("_t", "_u"), _text_keys(own)))).join(F.broadcast(told) if small else told, ["_t", "_u"], "left")
        score = F.coalesce("_score", F.lit(float(start))).alias(column)
        return rows.select(*([score if c == column else F.col(f"`{c}`") for c in df.columns] if column in df.columns else [*(F.col(f"`{c}`") for c in columns), score]))


def _text_keys(text) -> list:
    return [F.xxhash64(text).alias("_t"), F.xxhash64(F.lit(7), text).alias("_u")]


def _sure_column(gain, seen, expected, z: float = 3.0):
    """``_sure`` of columns."""
    seen = seen.cast("double")
    surprise = 2 * (seen * F.log(F.greatest(seen, F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9))) - (seen - expected))
    return gain * F.greatest(1 - z * z / F.greatest(surprise, F.lit(1e-9)), F.lit(0.0))


def _pair_counts(train: DataFrame) -> DataFrame:
    """(a, b, n0, n1): documents of each class that hold word b right after word a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, label in zip(_ids(batch.column(0)), batch.column(1).to_pylist()):
                pairs = np.unique(np.rec.fromarrays((ids[:-1], ids[1:]), names="a,b"))
                rows = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs["a"]).view(np.int64)), pa.array(np.ascontiguousarray(pairs["b"]).view(np.int64)), pa.array([int(label == 0)] * rows, pa.int64()), pa.array([int(label == 1)] * rows, pa.int64())], names=["a", "b", "n0", "n1"])

    got = train.select("text", "label").mapInArrow(run, "a long, b long, n0 long, n1 long")
    return got.groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(train: DataFrame, scratch: Scratch, discount: float = 1.5, most: int = 1_000_000, calibration_rows: int = 20_000) -> Model | Tables | None:
    """The model of ``train`` (key, text, label 0/1, calibrate): counts cover every row that is not
    to calibrate; of those that are, the first ``calibration_rows`` by hash fit the logistic function.

    ``discount`` is in counts of the smaller class. If at most ``most`` words and as many pairs pass
    it, the model is broadcast; a larger one stays in tables and is joined (see ``Tables``), with the
    same scores. Pairs are counted by ranks of words while these are four times as many at most. Returns None if a class has no words.
    """
    counted = train.where("not calibrate")
    words = scratch.table(_counts(counted, lambda ids: ids).where("n0 + n1 > 1"))
    totals = [int(x or 0) for x in words.agg(F.sum("n0"), F.sum("n1")).first()]
    if min(totals) == 0:
        return None
    share = [t / min(totals) for t in totals]

    discounts = [discount * s for s in share]
    passing = (F.col("n0") > discounts[0]) | (F.col("n1") > discounts[1])
    rows = train.where("calibrate")
    ids = rows.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(calibration_rows).select("key").distinct()
    rows = rows.join(F.broadcast(ids), "key", "left_semi")

    def calibrated(model, seen: DataFrame):
        seen = seen.select("key", "label", "a", "b").toArrow().sort_by([(x, "ascending") for x in ("key", "a", "b", "label")])
        label, *evidence = (seen.column(x).to_numpy().astype(float) for x in ("label", "a", "b"))
        if len(np.unique(label)) == 2:
            model.weights = _logistic(np.column_stack(evidence), label)
        return model

    def in_tables(pairs: DataFrame | None = None) -> Tables:
        model = Tables(counted, kept, totals, discounts, most, scratch, pairs)
        seen = rows.select("key", "label", "text", *_text_keys(F.col("text"))).join(model.evidence(rows.select("text")), ["_t", "_u"], "left")
        return calibrated(model, seen.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ("a", "b")}))

    kept = words.where(passing)
    size = kept.limit(4 * most + 1).count()
    if size > 4 * most:
        return in_tables()
    vocabulary = np.sort(arrays(kept.select("k"))[0].view(np.uint64))
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)  # 8 bytes a word

    def pairs_of(ids: np.ndarray) -> np.ndarray:
        known = shared.value
        if len(ids) < 2 or not len(known):
            return np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        ok = known[at] == ids
        both = ok[1:] & ok[:-1]
        return (at[:-1][both] * size + at[1:][both]).astype(np.uint64)

    pairs = scratch.table(_counts(counted, pairs_of))
    kept_pairs = pairs.where(passing)
    if size > most or kept_pairs.limit(most + 1).count() > most:

        def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                k = np.asarray(batch.column(0))
                yield pa.RecordBatch.from_arrays([*(pa.array(known[x].view(np.int64)) for x in (k // max(size, 1), k % max(size, 1))), batch.column(1), batch.column(2)], names=["a", "b", "n0", "n1"])

        return in_tables(pairs.mapInArrow(spelled, "a long, b long, n0 long, n1 long"))
    before, count = arrays(pairs.groupBy((F.col("k") % max(size, 1)).alias("w")).count())
    continuation = np.zeros(size)
    continuation[before] = count
    k, *n = arrays(kept.select("k", "n0", "n1"))
    n = np.column_stack(n)[np.argsort(k.view(np.uint64))]
    k, *m = arrays(kept_pairs.select("k", "n0", "n1"))
    model = Model(vocabulary, n, totals, k, np.column_stack(m), discounts, continuation)
    sent = model.sent = words.sparkSession.sparkContext.broadcast(model)  # of at most `most` words and pairs

    @F.arrow_udf("struct<a double, b double>")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = sent.value.evidence(batch)
            yield pa.StructArray.from_arrays([pa.array(got[:, i], pa.float64()) for i in (0, 1)], names=["a", "b"])

    return calibrated(model, rows.select("key", "label", evidence("text").alias("e")).select("key", "label", "e.a", "e.b"))


def toxicity(df: DataFrame, text: str, train: DataFrame, column: str = "score", **options) -> DataFrame:
    """``df`` with the score (0 to 1) of every whole text, by a model of ``train`` (see ``fit``).

    A null or empty text has no evidence and scores as low as the logistic function's start. If a
    class has no labelled words, every score is 0. Rows stay as they are, repeated ones included; a
    column of that name is replaced.
    """
    scratch = Scratch(df.sparkSession)
    model = fit(train, scratch, **options)
    if model is None:
        return df.withColumn(column, F.lit(0.0))
    if isinstance(model, Tables):
        return model.scores(df, text, column)
    sent, weights = model.sent, model.weights

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.scores(batch, weights), pa.float64())

    return df.withColumn(column, score(F.col(text).cast("string")))


def labelled(docs: DataFrame, labels: DataFrame, fold: DataFrame | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows to learn from (key, text, label, calibrate): documents with a toxic label, not held out.

    ``crc32(key as text) mod 5`` sets the fold: 0 is held out, 1 calibrates, the others are counted.
    A document labelled both ways is toxic. Labels are broadcast while they are ``broadcast_rows`` at
    most (12 bytes each), and joined by a shuffle beyond that.
    """
    fold = F.crc32(F.col("key").cast("string").cast("binary")) % 5
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").cast("int").alias("label"))
    own = own.where(fold != 0)
    if own.limit(broadcast_rows + 1).count() <= broadcast_rows:
        own = F.broadcast(own)
    joined = docs.select(F.col("doc_id").alias("key"), "text").join(own, "key")
    return joined.select("key", "text", "label", (fold == 1).alias("calibrate"))

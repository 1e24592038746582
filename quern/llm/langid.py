"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads a word's bytes, with a space on either side, forwards and backwards, and labels
every position with language probabilities. A document's probabilities are the mean over all
positions of the whole text. Words are the network's sequences, so a distinct word is run once.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, small_batches

#: Longer words are read in overlapping stretches of at most so many bytes.
STRETCH = 24
#: Words that a Python worker remembers.
CACHE = 600_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Both directions side by side: the leading axis of all parameters is the direction."""

    def __init__(self, n_labels: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "w": r.normal(0, 0.3, (2, 256, 3 * hidden)),  # of each byte, for update, reset and new state
            "u": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
            "v": r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, n_labels)),
            "c": np.zeros(n_labels),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (words, positions) of bytes. States (directions, positions, words, hidden)."""
        n, steps = x.shape
        k, w, u = self.hidden, self.p["w"], self.p["u"]
        h = np.zeros((2, n, k), np.float32)
        out, kept = np.empty((2, steps, n, k), np.float32), []
        for t in range(steps):
            a = np.stack((w[0][x[:, t]], w[1][x[:, steps - 1 - t]]))
            b = np.matmul(h, u)
            zr = _sigmoid(a[..., : 2 * k] + b[..., : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            new = np.tanh(a[..., 2 * k :] + r * b[..., 2 * k :])
            if keep:
                kept.append((h, z, r, new, b[..., 2 * k :]))
            h = new + z * (h - new)
            out[0, t], out[1, steps - 1 - t] = h[0], h[1]
        return out, kept

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (positions, words, labels) at every byte but the two spaces."""
        out, _ = self._states(x, False)
        return self._labels(np.concatenate((out[0], out[1]), axis=-1)[1:-1])

    def _labels(self, both: np.ndarray) -> np.ndarray:
        y = both @ self.p["v"] + self.p["c"]
        y = np.exp(y - y.max(axis=-1, keepdims=True))
        return y / y.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the positions and its gradient, through time."""
        k, (n, steps) = self.hidden, x.shape
        out, kept = self._states(x, True)
        both = np.concatenate((out[0], out[1]), axis=-1)
        y = self._labels(both[1:-1])
        at = np.arange(n)
        loss = -np.log(np.maximum(y[:, at, label], 1e-9)).mean()
        y[:, at, label] -= 1
        y /= y.shape[0] * n
        g = {"v": np.einsum("tnh,tnl->hl", both[1:-1], y), "c": y.sum((0, 1))}
        dh_out = np.zeros_like(both)
        dh_out[1:-1] = y @ self.p["v"].T
        g["u"], da_all = np.zeros_like(self.p["u"]), np.empty((2, steps, n, 3 * k), np.float32)
        dh = np.zeros((2, n, k), np.float32)
        for t in reversed(range(steps)):
            h, z, r, new, b = kept[t]
            dh = dh + np.stack((dh_out[t, :, :k], dh_out[steps - 1 - t, :, k:]))
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * b * r * (1 - r)
            da = np.concatenate((dz, dr, dnew), axis=-1)
            db = np.concatenate((dz, dr, dnew * r), axis=-1)
            da_all[0, t], da_all[1, steps - 1 - t] = da[0], da[1]
            g["u"] += np.matmul(h.transpose(0, 2, 1), db)
            dh = dh * z + np.matmul(db, self.p["u"].transpose(0, 2, 1))
        one = (x.T.reshape(-1)[None, :] == np.arange(256)[:, None]).astype(np.float32)
        g["w"] = np.stack([one @ da_all[i].reshape(-1, 3 * k) for i in (0, 1)])
        return float(loss), g

    def train(self, words: list[bytes], labels: np.ndarray, steps: int = 300, batch: int = 512, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over batches of words of one length each, lengths drawn by their share."""
        r = np.random.default_rng(seed)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        lengths = sorted(by)
        share = np.array([len(by[n]) * n for n in lengths], float)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for s in range(1, steps + 1):
            own = by[lengths[r.choice(len(lengths), p=share / share.sum())]]
            pick = r.choice(own, min(batch, len(own)), replace=False)
            _, g = self.gradients(padded([words[i] for i in pick]), labels[pick])
            now = rate * min(1, s / 20) * (1 - 0.9 * s / steps)
            for k, x in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                x -= now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)


def padded(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of bytes, with a space on either side."""
    x = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    side = np.full((len(words), 1), 32, np.uint8)
    return np.concatenate((side, x, side), axis=1)


def words_of(raw: bytes) -> list[bytes]:
    words = raw.translate(LETTERS).split()
    if words and len(max(words, key=len)) > STRETCH:
        words = [part for w in words for part in ([w] if len(w) <= STRETCH else _stretches(w))]
    return words


def _stretches(word: bytes) -> list[bytes]:
    """A long word in stretches of whole characters, each beginning with the last third of the one before,
    so that every position has context before it."""
    heads = np.flatnonzero(np.frombuffer(word, np.uint8) & 0xC0 != 0x80).tolist() + [len(word)]
    out, start = [], 0
    while start < len(heads) - 1:
        end = bisect_right(heads, heads[start] + STRETCH) - 1
        end = max(end, start + 1)
        out.append(word[heads[start] : heads[end]])
        if end == len(heads) - 1:
            break
        start = max(start + 1, end - (end - start) // 3)
    return out


class Scorer:
    """Pooled probabilities of texts; remembers each word's sum over its positions."""

    def __init__(self, model: BiGRU, labels: list[str]):
        self.model, self.labels = model, labels
        self.at: dict[bytes, int] = {}
        self.sums = np.zeros((1024, len(labels) + 1))

    def _learn(self, new: list[bytes]) -> None:
        base = len(self.at)
        while base + len(new) > len(self.sums):
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
        new.sort(key=len)
        start = 0
        while start < len(new):
            n = len(new[start])
            end = start + 1
            while end < len(new) and end - start < 4096 and len(new[end]) == n:
                end += 1
            part = new[start:end]
            self.sums[base + start : base + end, :-1] = self.model.positions(padded(part)).sum(axis=0)
            self.sums[base + start : base + end, -1] = n
            start = end
        self.at.update((w, base + i) for i, w in enumerate(new))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.at) > CACHE:
            self.at.clear()
        cut = [words_of(x.encode("utf-8", "surrogatepass")) if x else [] for x in texts]
        self._learn(list(set().union(*cut) - self.at.keys()))
        at, sums, names, scores = self.at, self.sums, [], []
        for text, words in zip(texts, cut):
            if not words or not has_letter(text):
                names.append("und")
                scores.append(0.0)
                continue
            total = sums[[at[w] for w in words]].sum(axis=0)
            i = int(total[:-1].argmax())
            names.append(self.labels[i])
            scores.append(float(min(1.0, total[i] / total[-1])))
        return names, scores


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def sample_words(df: DataFrame, text: str, lang: str, key: str, rows: int, words: int) -> tuple[list[bytes], list[str]]:
    """At most ``words`` distinct words of each of ``rows`` labelled rows, in the order of a hash."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                own = sorted(set(words_of(raw.encode("utf-8", "surrogatepass"))), key=lambda w: (zlib.crc32(w), w))
                out.append(b" ".join(own[:words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["k", "lang", "words"])

    chosen = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"))
    chosen = chosen.where("k is not null and t is not null and lang is not null")
    ids = chosen.select("k", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(rows).select("k").distinct()
    got = chosen.join(F.broadcast(ids), "k", "left_semi").select("k", "t", "lang").mapInArrow(pick, f"k {chosen.schema['k'].dataType.simpleString()}, lang string, words binary")
    found = sorted((r["k"], r["lang"], bytes(r["words"])) for r in got.distinct().collect())
    pairs = [(w, lang) for _, lang, ws in found for w in ws.split()]
    return [w for w, _ in pairs], [lang for _, lang in pairs]


def identify(df: DataFrame, train: DataFrame, key: str, text: str, lang: str, rows: int = 3000, words: int = 48, steps: int = 300) -> DataFrame:
    """``df`` with lang_pred and score (0 to 1) of every whole text.

    The network learns from a bounded sample of ``train``: ``words`` distinct words of each of
    ``rows`` rows with key, text and language, chosen by hash. A text that is null or without a
    letter gets ``und`` and 0; so does every text if there is nothing to learn from. Rows stay as
    they are; columns of those names are replaced. Equal probabilities go to the smaller language.
    """
    small_batches(df.sparkSession)
    found, names = sample_words(train, text, lang, key, rows, words)
    labels = sorted(set(names))
    if not labels:
        return df.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    number = {n: i for i, n in enumerate(labels)}
    model = BiGRU(len(labels))
    model.train(found, np.array([number[n] for n in names]), steps)
    shared = df.sparkSession.sparkContext.broadcast((model, labels))  # some 50 kB, by the network's shape
    name = uuid.uuid4().hex
    kind = "struct<lang_pred string, score double>"

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(name, shared)
        for batch in batches:
            names, scores = [], []
            for i in range(0, len(batch), 1000):
                a, b = scorer.score(batch.slice(i, 1000).to_pylist())
                names += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    name = f"_{name}"  # as no input's column
    out = df.withColumn(name, predict(F.col(text).cast("string")))
    return out.select(*rest, F.col(f"{name}.lang_pred"), F.col(f"{name}.score"))


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, shared) -> Scorer:
    """One scorer for a worker and model: its words stay known from task to task."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*shared.value)
    return _scorers[name]

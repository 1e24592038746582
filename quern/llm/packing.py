"""Packing of tokenised examples into sequences by vector bin packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .units import ByteEncoder

_encoders: dict[str, ByteEncoder] = {}


def _encoder(file: str) -> ByteEncoder:
    if file not in _encoders:
        _encoders[file] = ByteEncoder(file)
    return _encoders[file]


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most, all at once."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


class Packer:
    """Fills one sequence at a time from a pool of waiting pieces.

    Of the pieces that fit, the one goes in whose needs (tokens, segments, loss-bearing tokens, each
    as a share of its limit) have the largest dot product with what the sequence has left. When none
    fits whole and ``cut`` is set, the longest piece gives its head to the gap, and its tail waits on.
    The pool is bounded, so memory does not depend on the input.
    """

    def __init__(self, limits: Limits, cut: bool = True, pool: int = 512):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.needs = np.zeros((2 * pool, 3))
        self.items: list[tuple] = []  # (key, start, length, loss)
        self.sequence = 0

    def add(self, key, n: int, loss_from: int = 0) -> Iterator[tuple]:
        """Places of the pieces that this example's arrival settles: (key, start, length, sequence, offset)."""
        size, start = self.limits.tokens, 0
        while n - start >= size and self.limits.loss_tokens >= size:
            yield key, start, size, self.sequence, 0
            self.sequence += 1
            start += size
        while start < n:
            length = min(n - start, size)
            loss = max(0, start + length - max(start, loss_from))
            if loss > self.limits.loss_tokens:
                length -= loss - self.limits.loss_tokens
                loss = self.limits.loss_tokens
            self._wait(key, start, length, loss)
            start += length
            while len(self.items) >= self.pool:
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill()

    def _wait(self, key, start: int, length: int, loss: int) -> None:
        self.needs[len(self.items)] = length, 1, loss
        self.items.append((key, start, length, loss))

    def _take(self, i: int) -> tuple:
        last = len(self.items) - 1
        item, self.items[i] = self.items[i], self.items[last]
        self.needs[i] = self.needs[last]
        self.items.pop()
        return item

    def _fill(self) -> Iterator[tuple]:
        left, offset = self.most.copy(), 0
        while self.items and left.min() > 0:
            needs = self.needs[: len(self.items)]
            fits = (needs <= left).all(axis=1)
            if fits.any():
                gain = np.where(fits, (needs / self.most) @ (left / self.most), -1)
                key, start, length, loss = self._take(int(gain.argmax()))
            elif self.cut:
                key, start, length, loss = self._take(int(needs[:, 0].argmax()))
                # Loss-bearing tokens stand at the end, so a head has what its tail cannot hold.
                head = int(min(left[0], length - loss + left[2], length))
                head_loss = max(0, loss - (length - head))
                self._wait(key, start + head, length - head, loss - head_loss)
                length, loss = head, head_loss
            else:
                break
            yield key, start, length, self.sequence, offset
            offset += length
            left -= (length, 1, loss)
        self.sequence += 1


def pack(df: DataFrame, doc_id: str, text: str, file: str, limits: Limits = Limits(), cut: bool = True, end_id: int = 0, loss_from: str | None = None) -> DataFrame:
    """One row a piece: where tokens [start, start + length) of a row stand in which sequence.

    A row's tokens are the ids of its text by ``file`` (null: none), then ``end_id``; those from
    ``loss_from`` on (a column; all, if not given) bear loss. Every token lies in exactly one piece.
    Sequence ids are distinct over the whole result. Each input partition fills sequences of its own
    as rows stream by, so nothing is shuffled, no key or long text gathers rows, and a lost task is
    redone alone; a partition leaves one sequence short at most. Repeated rows are packed each for
    itself. An empty table gives no rows. Other columns are not read.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(file).encode
        tail = int(end_id).to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 40
        packer = Packer(limits, cut)
        ids: dict[int, list] = {}  # of rows with pieces still to be placed: [bytes, tokens unplaced, id]
        out: list[tuple] = []

        def settle(places) -> None:
            for key, start, length, sequence, offset in places:
                row = ids[key]
                crc = zlib.crc32(memoryview(row[0])[4 * start : 4 * (start + length)])
                out.append((row[2], start, length, crc, len(row[0]) // 4, first + sequence, offset))
                row[1] -= length
                if not row[1]:
                    del ids[key]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type] + [pa.int64()] * 6)], names=names)

        key = 0
        for batch in batches:
            losses = batch.column(2).to_pylist() if loss_from else [0] * batch.num_rows
            for i, (x, loss) in enumerate(zip(batch.column(0).to_pylist(), losses)):
                row = encode(batch.column(1)[i].as_py() or "") + tail
                ids[key] = [row, len(row) // 4, x]
                settle(packer.add(key, len(row) // 4, loss or 0))
                key += 1
                if len(out) >= 20_000:
                    yield flush()
        settle(packer.finish())
        yield flush()

    kind = df.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    picked = [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")]
    if loss_from:
        picked.append(F.col(loss_from).cast("long").alias("loss_from"))
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:])
    return df.select(*picked).mapInArrow(run, schema)

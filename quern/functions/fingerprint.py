"""Perceptual fingerprints of pictures: the signs of the lowest frequencies against their median."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SIZE, LOW, GRID, WIDTH = 64, 8, 5, 160
GREY = np.array([0.299, 0.587, 0.114])


@cache
def _cosines(n: int, k: int) -> np.ndarray:
    """The first ``k`` rows of the type-II cosine transform of ``n`` values."""
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


def low_frequencies(grey: np.ndarray) -> np.ndarray:
    """The lowest 8 x 8 frequencies of a picture of 64 x 64 greys, row by row."""
    c = _cosines(SIZE, LOW)
    return (c @ np.asarray(grey, float).reshape(SIZE, SIZE) @ c.T).ravel()


def _weights(source: int, target: int) -> np.ndarray:
    """A triangle filter that makes ``target`` values of ``source``: rows sum to 1."""
    scale = source / target
    reach = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs((np.arange(source) + 0.5)[None, :] - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resized(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture (height, width, ...) at another size."""
    picture = np.asarray(picture, float)
    return np.einsum("yh,hw...,xw->yx...", _weights(picture.shape[0], height), picture, _weights(picture.shape[1], width))


def grey_square(picture: np.ndarray) -> np.ndarray:
    """64 x 64 greys of a picture in colour (height, width, 3) or grey."""
    small = resized(picture, SIZE, SIZE)
    return np.round(small) @ GREY if small.ndim == 3 else small


def sprite(frames: list[np.ndarray]) -> np.ndarray:
    """25 frames of a video in a grid, each 160 wide and as high as the first then is."""
    if len(frames) != GRID * GRID:
        raise ValueError(f"a grid has {GRID * GRID} frames, not {len(frames)}")
    height = max(1, round(frames[0].shape[0] * WIDTH / frames[0].shape[1]))
    small = [resized(f, WIDTH, height) for f in frames]
    return np.concatenate([np.concatenate(small[i : i + GRID], axis=1) for i in range(0, len(small), GRID)])


def bits_of(low: np.ndarray) -> int:
    """A bit for each frequency that is above their median, the first the highest; as a signed number."""
    order = np.sort(low)
    bits = int("".join("1" if x > (order[31] + order[32]) / 2 else "0" for x in low), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(picture: np.ndarray) -> int:
    """The 64-bit fingerprint of one picture."""
    return bits_of(low_frequencies(grey_square(picture)))


def with_phash(pictures: DataFrame, grey: str, column: str = "bits") -> DataFrame:
    """``pictures`` with the 64-bit fingerprint of an array of 64 x 64 greys in place of it; null for arrays
    of another length. A picture at a time is in memory beside its batch."""
    rest = [c for c in pictures.columns if c != grey]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column(len(rest))
            bits = [bits_of(low_frequencies(np.array(x.as_py(), float))) if x.is_valid and len(x.as_py()) == SIZE * SIZE else None for x in pixels]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits, pa.int64())], names=[*rest, column])

    rows = pictures.select(*rest, F.col(grey).cast("array<double>").alias(grey))
    return rows.mapInArrow(run, StructType([*(pictures.schema[c] for c in rest), StructField(column, LongType())]))

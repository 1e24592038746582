"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .units import PieceCounter

_models: dict[str, PieceCounter] = {}


def _model(file: str) -> PieceCounter:
    """One model and one cache of units for a Python worker, which serves many tasks."""
    if file not in _models:
        _models[file] = PieceCounter(file)
    return _models[file]


def by_bytes(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of a string column with about ``most`` bytes of text each; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    batch = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield column.slice(a, b - a)


def token_counts(df: DataFrame, text: str, file: str, column: str = "n_tokens", batch_bytes: int = 2 << 20) -> DataFrame:
    """``df`` with the number of ids of each whole text, as sentencepiece gives them for ``file``.

    No begin or end ids are counted. A null or empty text has none. Texts reach the encoder in
    batches of about ``batch_bytes``, cut at boundaries that no id spans, however long they are.
    Rows stay as they are, repeated ones included; a column of that name is replaced.
    """

    small_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(file)
        for batch in batches:
            out: list[int] = []
            for part in by_bytes(batch, batch_bytes):
                out += model.count([x or "" for x in part.to_pylist()])
            yield pa.array(out, pa.int64())

    return df.withColumn(column, count(F.col(text)))

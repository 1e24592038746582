"""What the training-data operators share: held-out rows, word counts, file look-up."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import scratch

#: Rows and bytes of texts that pass between Spark and Python at once. Spark's own default is 10,000 rows,
#: of which long texts make hundreds of MB on either side.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(4 << 20))}
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: One byte each: lower-case letters stay, A-Z fold, every other ASCII byte becomes a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python, unless the session has set its own."""
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key, None) in (default, None):
            spark.conf.set(key, value)


class Scratch(scratch.Scratch):
    """Tables in the shared folder, for operators whose texts go to Python."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        small_batches(spark)


def arrays(df: DataFrame) -> list[np.ndarray]:
    """Columns of numbers without nulls, whole, on the driver. They come as Arrow batches: by ``toPandas`` each row
    is pickled in the driver's JVM and becomes objects in its Python, which is most of the memory of both."""
    got = df.toArrow()
    return [got.column(i).to_numpy() for i in range(got.num_columns)]


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of all documents that no model learns from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def spaced(text: Column) -> Column:
    """A text with one space for each character of white space. (``translate`` looks every character up and
    takes some five times as long.)"""
    return F.regexp_replace(text, r"[\x09-\x0D]", " ")


def n_words(text: Column) -> Column:
    """Words of a text; none of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def vocabulary_file(name: str) -> str:
    """A tokenizer's file: a path as it is, else the name of one that the installed package has."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

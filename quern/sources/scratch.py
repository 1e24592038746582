"""Tables in the shared checkpoint folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Set while a table is written: Spark deletes the shuffle files of the plan when it has run, not when the
#: driver happens to collect its garbage, which may be half an hour and many tables later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between collections of the driver's garbage: plans, broadcasts and shuffles that are done with.
COLLECT_S = 5
_collected = time.monotonic()


def _collect(spark: SparkSession) -> None:
    """Release what finished plans hold; otherwise the driver's heap grows to its limit first."""
    global _collected
    if time.monotonic() - _collected >= COLLECT_S:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


class Scratch:
    """Numbered Parquet tables in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/quern-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        _collect(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

import os
import time

from pyspark.sql import functions as F

from quern.sources import scratch


def shuffles(spark) -> int:
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(name.startswith("shuffle_") for top in root for _, _, names in os.walk(top) for name in names)


def test_a_table_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    before, own = shuffles(spark), spark.conf.get(scratch.CLEANUP, None)
    kept = scratch.Scratch(spark)
    for i in range(3):
        out = kept.table(spark.range(1000).groupBy((F.col("id") % (7 + i)).alias("k")).count())
    deadline = time.time() + 20
    while shuffles(spark) > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffles(spark) <= before and out.count() == 9
    assert spark.conf.get(scratch.CLEANUP, None) == own

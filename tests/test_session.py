import os
import time

from pyspark.sql import functions as F

from weir.session import bound_batches, settle

BATCH, CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for d in dirs for _, _, names in os.walk(str(d)) for x in names if x.startswith("shuffle_")}


def test_what_is_settled_leaves_no_shuffle_files(spark):
    was = spark.conf.get(CLEANUP, None)
    before = shuffled(spark)
    out = settle(spark.range(100_000).withColumn("k", F.col("id") % 100).groupBy("k").applyInArrow(lambda t: t, "id long, k long"), "t")
    until = time.time() + 10
    while shuffled(spark) - before and time.time() < until:  # executors delete in the background
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert out.count() == 100_000 and spark.conf.get(CLEANUP, None) == was


def test_batches_are_bounded_where_the_user_sets_nothing(spark):
    was = spark.conf.get(BATCH, None)
    try:
        spark.conf.unset(BATCH)
        bound_batches(spark)
        assert spark.conf.get(BATCH) == "4m"
        spark.conf.set(BATCH, "64m")
        bound_batches(spark)
        assert spark.conf.get(BATCH) == "64m"
    finally:
        spark.conf.unset(BATCH) if was is None else spark.conf.set(BATCH, was)

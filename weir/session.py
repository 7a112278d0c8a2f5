"""Session defaults and the shared scratch area."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weir", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; conf overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes of an Arrow batch, where the session sets none: long texts make batches of few rows.
BATCH_BYTES = "4m"
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, which bounds what a task holds of its rows on both sides of an exchange with Python.

    A value set by the user stays: get() with None as default gives None for an option that is not set.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """An option of the session for the jobs that run inside; then it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where both are one process may it be unset: then one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weir-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, columns stay prunable.

    The shuffle files of the write go when it ends, so that what is settled is on disk once; else they stay until the
    driver happens to collect its garbage. Where the user set that option, it stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weir/{uuid.uuid4().hex}-{tag}"
    with setting(spark, _CLEANUP, spark.conf.get(_CLEANUP, None) or "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables. Only for those that no plan still to be run reads, lost executors' work included."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins and shuffle partition
# counts from runtime statistics, so one configuration serves sf0.001 and a
# cluster-size run; the broadcast threshold is Spark's own size check.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vendorlytics", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("VL_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", conf["spark.sql.session.timeZone"])
    return spark


_LOCAL_CKPT: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to shared storage and we only read it. When it is
    unset, a local master gets a scratch folder, once per application; any
    other master raises, as executors would write to their own disks.
    """
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_CKPT:
            _LOCAL_CKPT[app] = tempfile.mkdtemp(prefix="vl-ckpt-")
        conf_dir = _LOCAL_CKPT[app]
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


# a query's shuffle files go when it ends, not when the driver happens to collect its garbage
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession):
    """Inside, every query's shuffle files go as soon as it has ended."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: cuts the lineage (a lost executor re-reads files instead of
    recomputing the plan) and computes the input a single time, unlike
    ``DataFrame.checkpoint()`` which evaluates it twice."""
    return materialize_lots(df.sparkSession, lambda _: df, 1, name)


def materialize_lots(spark: SparkSession, make: Callable[[int], DataFrame], lots: int, name: str) -> DataFrame:
    """``make(0)`` to ``make(lots - 1)`` as one table, see ``materialize``.
    They are written one after the other, so that only one lot's shuffle files
    are there at a time (in ``released``)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for i in range(lots):
        make(i).write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

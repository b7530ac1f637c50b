"""Versioned table snapshots (S5): the sink of the change-set jobs.

A change-set job computes the new table from the old one; the result is
written as a new version folder. A version counts once its commit marker
(``_SUCCESS``, the last file that Spark writes) is there; readers take the
newest version that has one, so they see either the old or the new table,
never a half-written one. Old versions stay for audit and rollback. A retried
job names its version and rewrites the same folder: while that runs, the
folder has no marker and readers get the version before.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version; None if the folder does not exist or
    holds none. Other read errors are raised."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path = path_of(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return max((int(n[2:]) for n in names
                if re.fullmatch(r"v=[0-9]+", n) and fs.exists(path_of(f"{root}/{n}/_SUCCESS"))), default=None)


def write_version(df: DataFrame, root: str, version: int | None = None,
                  partition_by: list[str] | None = None) -> int:
    """Write ``df`` as version ``version`` (default: current + 1; a retry
    passes the version it wrote). Returns the version written."""
    if version is None:
        cur = current_version(df.sparkSession, root)
        version = 0 if cur is None else cur + 1
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{root}/v={version}")
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no snapshot version under {root}")
    return spark.read.parquet(f"{root}/v={v}")

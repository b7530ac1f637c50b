"""One commit for several tables of a change-set job.

A job such as the sale registration changes more than one table. Each table's
new snapshot is written as a version folder of its own
(``<root>/_versions/<table>/v=N``) and, last, a manifest ``<root>/_commits/c=N`` that names the version of every
table of the root. Readers resolve all tables by one manifest, so they see
either all of a job's tables or none; versions that no manifest names (of a job
that died) are never read. A manifest is a folder that counts once Spark's
marker is in it, with one row a table: its size is the number of tables, not
of rows. A retried job names its commit and replaces the folder's content;
until the marker is back, readers get the commit before.

One writer at a time: two jobs that commit at once would both build on the
same manifest. The second is refused if it names the commit it read
(``expected``) and another has come since.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vendorlytics.sources.snapshots import current_version, write_version

SCHEMA = "tabla string, version long"


def folder(root: str, table: str) -> str:
    return f"{root}/_versions/{table}"


def _commits(spark: SparkSession, root: str) -> list[int]:
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path = path_of(f"{root}/_commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names
                  if re.fullmatch(r"c=[0-9]+", n) and fs.exists(path_of(f"{root}/_commits/{n}/_SUCCESS")))


def current_commit(spark: SparkSession, root: str) -> int | None:
    """The newest complete commit; None if the root has none."""
    return max(_commits(spark, root), default=None)


def versions(spark: SparkSession, root: str, commit: int | None = None) -> dict[str, int]:
    """Version of every table in a commit (default: the newest)."""
    commit = current_commit(spark, root) if commit is None else commit
    if commit is None:
        return {}
    rows = spark.read.schema(SCHEMA).json(f"{root}/_commits/c={commit}").collect()  # one row a table
    return {r["tabla"]: r["version"] for r in rows}


def read_table(spark: SparkSession, root: str, table: str, commit: int | None = None) -> DataFrame:
    known = versions(spark, root, commit)
    if table not in known:
        raise FileNotFoundError(f"no commit under {root} names the table {table}")
    return spark.read.parquet(f"{folder(root, table)}/v={known[table]}")


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], commit: int | None = None,
                  expected: int | None = None) -> int:
    """Write ``tables`` (name -> new snapshot) as one commit; returns its
    number. The other tables keep their versions. ``commit`` names the commit
    that a retry replaces, ``expected`` the one the snapshots were computed
    from."""
    done = _commits(spark, root)
    newest = done[-1] if done else None
    if expected is not None and newest != expected and not (commit is not None and newest == commit):
        raise RuntimeError(f"commit {newest} came after {expected}, which the tables were computed from")
    number = commit if commit is not None else (-1 if newest is None else newest) + 1
    before = [c for c in done if c < number]
    named = versions(spark, root, before[-1]) if before else {}
    for name, df in tables.items():
        last = max(named.get(name, -1), -1 if (v := current_version(spark, folder(root, name))) is None else v)
        named[name] = write_version(df, folder(root, name), last + 1)
    rows = sorted(named.items())
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").json(f"{root}/_commits/c={number}")
    return number

"""Run one job and write its result.

    python -m vendorlytics.run <query> --tables DIR [--fixture] --out DIR [--format parquet]
    python -m vendorlytics.run <job> --tables DIR [--requests DIR] --commit

``--tables`` is either a folder of application tables (one parquet folder per
table: usuarios, ventas, inventario_vendedor, ...) or, with ``--fixture``,
the driver's test folder. The first form writes the query's result with the
DataFrame writer; parameters have the reference's values. The second form is
for change-set jobs: the tables that the job changes are written as new
versions and become visible together (``sources.commits``). ``--requests`` is
a parquet folder of requests, ordered by its column ``seq``. Nothing is
collected to the driver.
"""

from __future__ import annotations

import argparse
import importlib

from vendorlytics.plans.new_tables import JOBS
from vendorlytics.registry import MODULES
from vendorlytics.session import get_session
from vendorlytics.sources.commits import commit_tables
from vendorlytics.sources.tables import FixtureTables, SnapshotTables


def jobs() -> dict:
    out = {}
    for plan, _ in MODULES:
        out.update(importlib.import_module(plan).QUERIES)
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("query", choices=sorted(jobs()))
    ap.add_argument("--tables", required=True)
    ap.add_argument("--fixture", action="store_true", help="tables are the driver's test parquet files")
    ap.add_argument("--out", help="folder of the result; with --commit, root of the commits (default: --tables)")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--master", default=None)
    ap.add_argument("--requests", help="parquet folder of the job's requests")
    ap.add_argument("--commit", action="store_true", help="write the job's new tables as one commit")
    a = ap.parse_args(argv)
    if (a.commit or a.requests) and a.query not in JOBS:
        ap.error(f"{a.query} changes no tables; jobs that do: {', '.join(sorted(JOBS))}")
    if not a.commit and (a.requests or not a.out):
        ap.error("--requests goes with --commit; without it, --out names the result's folder")
    if a.fixture and a.commit and not a.out:
        ap.error("the test tables stay as they are: name --out")
    spark = get_session(a.master)
    t = FixtureTables(spark, a.tables) if a.fixture else SnapshotTables(spark, a.tables)
    if not a.commit:
        jobs()[a.query](t).write.mode("overwrite").format(a.format).save(a.out)
        return
    req = spark.read.parquet(a.requests) if a.requests else None
    new = JOBS[a.query](t, req)
    root = (a.out or a.tables).rstrip("/")
    same = not a.fixture and root == t.root
    commit_tables(spark, root, {SnapshotTables.NAMES[k]: df for k, df in new.items()}, expected=t.commit if same else None)


if __name__ == "__main__":
    main()

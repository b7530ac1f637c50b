"""Real-deployment path: application tables stored as snapshot folders."""

import tempfile

from tests.conftest import SMALL
from vendorlytics.plans import kpis, reads
from vendorlytics.run import main
from vendorlytics.sources.tables import FixtureTables, SnapshotTables


def test_snapshot_tables_give_the_same_answers(spark):
    fx = FixtureTables(spark, SMALL)
    root = tempfile.mkdtemp(prefix="vl-snap-")
    for method, folder in SnapshotTables.NAMES.items():
        if hasattr(fx, method):
            getattr(fx, method)().write.mode("overwrite").parquet(f"{root}/{folder}")
    snap = SnapshotTables(spark, root)
    for fn in (kpis.sales_summary, kpis.top_products, reads.vendor_inventory):
        a = sorted(map(tuple, fn(fx).collect()))
        b = sorted(map(tuple, fn(snap).collect()))
        assert a == b


def test_runner_writes_result(spark):
    out = tempfile.mkdtemp(prefix="vl-out-") + "/summary"
    main(["sales_summary", "--tables", SMALL, "--fixture", "--out", out])
    assert spark.read.parquet(out).count() > 0


def test_versioned_snapshot_sink(spark):
    from vendorlytics.plans.changes_inventory import patch_inventory
    from vendorlytics.sources.snapshots import current_version, read_current, write_version
    fx = FixtureTables(spark, SMALL)
    root = tempfile.mkdtemp(prefix="vl-ver-") + "/inventario_vendedor"
    assert current_version(spark, root) is None
    assert write_version(fx.inventory(), root) == 0
    _, new = patch_inventory(fx, snapshot=read_current(spark, root))
    assert write_version(new, root) == 1
    assert read_current(spark, root).count() == fx.inventory().count()
    # A retried job rewrites the same version.
    assert write_version(new, root, version=1) == 1 and current_version(spark, root) == 1

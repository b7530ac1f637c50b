"""S1 readers, S2 sketches and the dashboard's rollup."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vendorlytics.plans import kpis, reads
from vendorlytics.plans.profile import column_sketches, merge_profiles, profile_report
from vendorlytics.sources.readers import SourceTables, TableSource, check_jdbc, read_table
from vendorlytics.sources.tables import FixtureTables

USED = ["users", "products", "inventory", "sales", "categories", "clients"]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("fmt", ["csv", "orc", "json"])
def test_reads_from_other_formats(spark, fmt):
    fx, root, sources = FixtureTables(spark, SMALL), tempfile.mkdtemp(prefix="vl-src-"), {}
    for name in USED:
        df = getattr(fx, name)()
        out = df
        if fmt == "csv":
            out = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        # the source calls its key otherwise
        out = out.withColumnRenamed("id", "clave")
        out.write.format(fmt).options(**({"header": "true", "escape": '"'} if fmt == "csv" else {})).save(f"{root}/{name}")
        sources[name] = TableSource(fmt, path=f"{root}/{name}", schema=df.schema, columns={"id": "clave"})
    t = SourceTables(spark, sources, root)
    for fn in (kpis.sales_summary, kpis.top_products, reads.vendor_inventory, reads.sales_history_page, reads.client_list):
        assert rows(fn(t)) == rows(fn(fx)), fn.__name__


def test_mapped_columns_and_sources_that_raise(spark):
    root = tempfile.mkdtemp(prefix="vl-src-") + "/t"
    spark.createDataFrame([(1, "a")], "id long, nombre string").write.parquet(root)
    schema = spark.createDataFrame([], "id long, sku string").schema
    with pytest.raises(ValueError, match="dbtable"):
        read_table(spark, TableSource("jdbc", {"url": "jdbc:x"}))
    renamed = read_table(spark, TableSource(path=root, schema=schema, columns={"sku": "nombre"}))
    assert [tuple(r) for r in renamed.collect()] == [(1, "a")] and renamed.columns == ["id", "sku"]


def test_jdbc_options():
    parts = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    check_jdbc({"url": "jdbc:x", "dbtable": "ventas", **parts})
    for bad in ({"dbtable": "t"}, {"url": "u"}, {"url": "u", "dbtable": "t", "query": "q"},
                {"url": "u", "dbtable": "t", "numPartitions": "4"}, {"url": "u", "query": "q", **parts}):
        with pytest.raises(ValueError):
            check_jdbc(bad)


def test_profile_of_batches_adds_up(spark):
    fx = FixtureTables(spark, SMALL)
    for name in ("users", "products", "sales"):
        df = getattr(fx, name)()
        key = F.xxhash64("id") % 2 == 0
        whole = {r["column_name"]: r for r in profile_report(column_sketches(df, name)).collect()}
        both = merge_profiles(column_sketches(df.where(key), name), column_sketches(df.where(~key), name))
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
        assert len(whole) == len(df.columns)
        for r in profile_report(both).collect():
            # a union of sketches is read by another estimator than one sketch
            got, one = r.asDict(), whole[r["column_name"]].asDict()
            for estimate in (got.pop("distinct_estimate"), one.pop("distinct_estimate")):
                assert abs(estimate - exact[r["column_name"]]) <= 0.08 * exact[r["column_name"]] + 1
            assert got == one and got["row_count"] == df.count()
    assert whole["fecha"]["max_length"] is None and whole["fecha"]["data_type"] == "timestamp_ntz"
    empty = profile_report(column_sketches(fx.users().limit(0), "users")).first()
    assert (empty["row_count"], empty["null_count"], empty["distinct_estimate"]) == (0, 0, 0)


def test_dashboard_from_rollups_of_batches(spark):
    fx = FixtureTables(spark, SMALL)
    sales = fx.sales()
    old = F.xxhash64("id") % 3 > 0
    merged = kpis.merge_rollups(kpis.sales_rollup(sales.where(old)), kpis.sales_rollup(sales.where(~old)))
    assert rows(kpis.vendor_dashboard(fx, rollup=merged)) == rows(kpis.vendor_dashboard(fx))

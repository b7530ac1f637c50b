"""Physical-plan checks: the scale rules hold in what Spark actually runs."""

import pytest

from tests.conftest import SMALL, FakeTables
from vendorlytics import registry
from vendorlytics.plans import kpis, repair
from vendorlytics.sources.tables import FixtureTables

QUERIES = registry.queries()
STREAMING = {"billing_stream_state", "rate_limit_stream"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
PYTHON = ["MapInArrow", "MapInPandas", "FlatMapGroups"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan: str) -> list[str]:
    """Window specs without PARTITION BY (they run in a single task): their
    first item is a sort order or the frame itself."""
    bad = []
    for part in plan.split("windowspecdefinition(")[1:]:
        first = part.split(", ")[0]
        if " ASC" in first or " DESC" in first or first.startswith("specifiedwindowframe"):
            bad.append(first)
    return bad


def test_detector_sees_an_unpartitioned_window(spark):
    from pyspark.sql import Window, functions as F
    df = spark.range(5).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert unpartitioned_windows(plan_of(df))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_cross_join_row_udf_or_global_window(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"
    assert not unpartitioned_windows(plan), f"{name} has a window without PARTITION BY"


@pytest.mark.parametrize("name", ["stock_ledger", "stock_ledger_final", "sale_register", "instalment_ledger", "instalment_sale_state"])
def test_folds_run_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not any(op in plan for op in PYTHON)


def test_topk_is_limited_before_the_shuffle(spark):
    t = FixtureTables(spark, SMALL)
    for df in (kpis.recent_sales(t), kpis.top_products(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan


def test_vendor_filter_reaches_the_scan(spark):
    t = FixtureTables(spark, SMALL)
    plan = plan_of(kpis.sales_summary(t, vendor_id=5))
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,5)" in plan or "EqualTo(l_suppkey,5)" in plan


def test_constraints_read_every_table_once(spark):
    """Four application tables come from lineitem (one of them with a second
    use of part for its price), and nothing is joined but the report's names."""
    df = QUERIES["constraint_violations"](spark, SMALL)
    plan = plan_of(df)
    per_table = {x: plan.count(f"{x}.parquet") for x in ("lineitem", "orders", "customer", "supplier")}
    assert per_table["lineitem"] == 4 and per_table["orders"] == per_table["customer"] == 1
    kinds = {r["tipo"] for r in df.where("violaciones > 0").collect()}
    assert kinds == {"unique", "foreign_key", "not_null"}


def test_constraint_keys_hold_numbers_not_names(spark):
    """A key's row in the aggregation has the constraint's number; hand rows
    of every kind of check are counted right."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = FakeTables(
        spark,
        inventory_raw=df([(1, 7, 1), (1, 7, None), (1, 8, 2), (2, None, 2), (2, None, 2)], "vendedor_id int, producto_maestro_id int, stock int"),
        products=df([(7, "a", 1), (9, "a", 5), (10, None, None), (11, None, 5)], "id int, sku string, categoria_id int"),
        users=df([("A@x", "s"), ("a@X", "t"), (None, "s")], "email string, store_slug string"),
        sales=df([(1, 70, 5), (2, 71, None), (3, 71, 6)], "id int, inventario_id int, clienta_id int"),
        inventory=df([(70,)], "id int"), clients=df([(5, None)], "id int, nombre string"), categories=df([(1,)], "id int"),
        instalments=df([(1, 5), (9, None), (9, None), (None, 1)], "venta_id int, monto int"))
    out = repair.constraint_violations(t)
    aggregates = [line for line in plan_of(out).splitlines() if "Aggregate" in line and "clave" in line]
    assert aggregates and all("n_restriccion" in line for line in aggregates)
    assert {r["restriccion"]: r["violaciones"] for r in out.collect()} == {
        "inventario_vendedor_vendedor_producto_unico": 1, "catalogo_maestro_sku_unico": 1, "usuarios_email_unico": 1,
        "usuarios_store_slug_unico": 1, "ventas_inventario_fk": 2, "ventas_clienta_fk": 1, "abonos_venta_fk": 2,
        "catalogo_categoria_fk": 2, "inventario_producto_fk": 1, "clientas_nombre_not_null": 1, "inventario_stock_not_null": 1,
        "abonos_monto_not_null": 2}

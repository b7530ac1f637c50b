"""Properties from SURVEY section 5 on the sf0.001 fixture."""

from pyspark.sql import functions as F

from tests.conftest import SMALL, FakeTables
from vendorlytics.plans import repair
from vendorlytics.plans.changes_sales import apply_instalments
from vendorlytics.sources.tables import FixtureTables


def test_dedup_keeps_stock_and_sales_and_is_idempotent(spark):
    t = FixtureTables(spark, SMALL)
    raw = t.inventory_raw()
    once = repair.dedup_inventory(t)
    total = lambda df: df.agg(F.sum(F.coalesce("stock", F.lit(0)))).first()[0]
    assert total(once) == total(raw)
    assert once.groupBy("vendedor_id", "producto_maestro_id").count().where("count > 1").count() == 0
    # Every sale still points at an existing row after repointing.
    repointed = repair.dedup_repoint_sales(t)
    assert repointed.count() == t.sales().count()
    assert repointed.join(once, repointed.inventario_id == once.id, "left_anti").count() == 0
    # Running the dedup on its own output changes nothing.
    twice = repair.dedup_inventory(FakeTables(spark, inventory_raw=once))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_instalment_balances_never_negative(spark):
    t = FixtureTables(spark, SMALL)
    out, sales = apply_instalments(t)
    assert out.count() == t.read("lineitem").count()
    assert sales.where("saldo_restante < 0").count() == 0
    start = t.sale_balances().select("venta_id", F.col("saldo_restante").alias("s0"))
    paid = out.where("aceptada").groupBy("venta_id").agg(F.sum("monto").alias("p"))
    check = start.join(sales, "venta_id").join(paid, "venta_id", "left") \
        .where(F.col("s0") != F.col("saldo_restante") + F.coalesce("p", F.lit(0)))
    assert check.count() == 0


def test_instalment_reasons_on_text_keys(spark):
    sales = spark.createDataFrame(
        [("a", "v1", "c1", "50", "EN_ABONOS"), ("b", "v1", None, "0", "PAGADO"), ("z", "v2", "c2", "9", "EN_ABONOS")],
        "venta_id string, vendedor_id string, clienta_id string, saldo string, estado_pago string") \
        .withColumn("saldo_restante", F.col("saldo").cast("decimal(18,2)")).drop("saldo")
    asked = [(1, "a", "v1", "30"), (2, "a", "v1", "30"), (3, "a", "v2", "1"), (4, "a", "v1", "0"), (5, "a", "v1", None),
             (6, "a", "v1", "20"), (7, "a", "v1", "5"), (8, "b", "v1", "1"), (9, "q", "v1", "1"), (10, None, "v1", "1")]
    req = spark.createDataFrame(asked, "llegada int, venta_id string, vendedor_id string, m string") \
        .withColumn("monto", F.col("m").cast("decimal(18,2)")).drop("m")
    out, new = apply_instalments(None, req, sales, ["llegada"])
    assert {r["llegada"]: r["motivo"] for r in out.collect()} == {
        1: None, 2: "excede_saldo", 3: "venta_no_encontrada", 4: "monto_invalido", 5: "monto_invalido", 6: None,
        7: "venta_pagada", 8: "venta_pagada", 9: "venta_no_encontrada", 10: "monto_invalido"}
    assert {r["venta_id"]: (float(r["saldo_restante"]), r["estado_pago"]) for r in new.collect()} == {
        "a": (0.0, "PAGADO"), "b": (0.0, "PAGADO"), "z": (9.0, "EN_ABONOS")}

"""Golden cases for the edge rules listed in FIXTURES.md."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import FakeTables
from vendorlytics.functions.formats import digits_only, month_label, slugify
from vendorlytics.plans import billing, kpis, repair
from vendorlytics.plans.changes_accounts import client_patch
from vendorlytics.plans.changes_inventory import patch_catalog
from vendorlytics.plans.changes_sales import split_payment


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_payment_split(spark):
    req = spark.createDataFrame(
        [(1, 1, Decimal("100.00"), Decimal("0.00"), True), (2, 1, Decimal("100.00"), Decimal("100.00"), True),
         (3, 1, Decimal("100.00"), Decimal("120.00"), True)],
        "k int, cantidad int, precio_unitario decimal(18,2), anticipo decimal(18,2), en_abonos boolean") \
        .withColumn("clienta_id", F.lit(5)).withColumn("motivo", F.lit(None).cast("string"))
    out = {r["k"]: r for r in split_payment(req).collect()}
    assert (out[1]["estado_pago"], out[1]["saldo_restante"], out[1]["motivo"]) == ("EN_ABONOS", Decimal("100.00"), None)
    assert (out[2]["estado_pago"], out[2]["saldo_restante"], out[2]["motivo"]) == ("PAGADO", Decimal("0.00"), None)
    assert out[3]["motivo"] == "anticipo_excede"


def test_advance_without_credit_is_paid(spark):
    req = spark.createDataFrame([(1, Decimal("100.00"), Decimal("20.00"), False, 9)],
                                "cantidad int, precio_unitario decimal(18,2), anticipo decimal(18,2), "
                                "en_abonos boolean, clienta_id int").withColumn("motivo", F.lit(None).cast("string"))
    r = one(split_payment(req))
    assert (r["estado_pago"], r["saldo_restante"], r["anticipo_num"]) == ("PAGADO", Decimal("0.00"), Decimal("20.00"))


def test_slug_and_phone(spark):
    df = spark.createDataFrame([("  Joyería--Luz! ", "+52 (55) 1")], "s string, p string")
    r = one(df.select(slugify(F.col("s")).alias("s"), digits_only(F.col("p")).alias("p")))
    assert (r["s"], r["p"]) == ("joyer-a-luz", "52551")


def test_month_label_is_padded(spark):
    r = one(spark.range(1).select(month_label(F.lit(dt.date(2001, 5, 1))).alias("m")))
    assert r["m"] == "May      "


def test_low_stock_rules_differ(spark):
    inv = spark.createDataFrame([(i, 1, i, s, Decimal("1.00")) for i, s in enumerate([0, 3, 4, 5])],
                                "id long, vendedor_id long, producto_maestro_id long, stock int, "
                                "precio_personalizado decimal(18,2)")
    users = spark.createDataFrame([(1,)], "id long")
    t = FakeTables(spark, inventory=inv, users=users)
    assert one(kpis.low_stock_count(t))["productos_criticos"] == 3
    assert one(kpis.stock_alert_count(t))["count"] == 1


def test_sku_history(spark):
    prod = spark.createDataFrame(
        [(1, "B", ["A"], "n", None, None, 1, 1, None), (2, "A", None, "n", None, None, 1, 1, None)],
        "id long, sku string, skus_anteriores array<string>, nombre string, descripcion string, "
        "precio_sugerido decimal(18,2), categoria_id int, marca_id int, creado_por long")
    req = spark.createDataFrame([(1, 1, "A"), (2, 2, "B")], "id long, seq long, sku string").select(
        "id", "seq", "sku", F.lit(None).cast("string").alias("nombre"), F.lit(None).cast("string").alias("descripcion"),
        F.lit(None).cast("decimal(18,2)").alias("precio_sugerido"), F.lit(None).cast("string").alias("ruta_imagen"),
        F.lit(1).alias("categoria_id"), F.lit(None).cast("int").alias("marca_id"))
    cats = spark.createDataFrame([(1, "c")], "id int, nombre string")
    t = FakeTables(spark, products=prod, categories=cats)
    out = {r["id"]: r for r in patch_catalog(t, req).collect()}
    # Product 1 takes SKU A while product 2 still holds it: refused.
    assert out[1]["resultado"] == "sku_duplicado"
    # Product 2 moves A -> B while product 1 holds B: refused too.
    assert out[2]["resultado"] == "sku_duplicado"
    # History rule itself on a free SKU: sku B, history [A], new A -> [B].
    prod2 = prod.where("id = 1")
    t2 = FakeTables(spark, products=prod2, categories=cats)
    r = one(patch_catalog(t2, req.where("id = 1")))
    assert (r["resultado"], r["skus_anteriores"]) == ("ok", ["B"])
    prod3 = spark.createDataFrame([(3, "A", None, "n", None, None, 1, 1, None)], prod.schema)
    req3 = req.where("id = 2").withColumn("id", F.lit(3).cast("long"))
    r = one(patch_catalog(FakeTables(spark, products=prod3, categories=cats), req3))
    assert r["skus_anteriores"] == ["A"]


def test_client_patch_details_default(spark):
    clients = spark.createDataFrame([(1, 7, "Ana", Decimal("0"), dt.date(2024, 1, 1))],
                                    "id long, vendedor_id long, nombre string, saldo_pendiente decimal(18,2), "
                                    "fecha_proximo_pago date")
    req = spark.createDataFrame([(1, 1, 7, None, None, None)],
                                "id long, seq long, vendedor_id long, nombre string, fecha_proximo_pago date, "
                                "detalles string")
    r = one(client_patch(FakeTables(spark, clients=clients), req))
    assert (r["nombre"], r["detalles"], r["fecha_proximo_pago"]) == ("Ana", "{}", None)


def test_json_logo_merge(spark):
    df = spark.createDataFrame([('{"a":{"x":1},"logo":"old"}',)], "j string")
    r = one(df.select(repair.merge_json_key(F.col("j"), "logo", F.lit("new")).alias("m")))
    import json
    assert json.loads(r["m"]) == {"a": {"x": 1}, "logo": "new"}


def test_dedup_stock_sum(spark):
    raw = spark.createDataFrame([(3, 1, 1, 2), (5, 1, 1, None), (9, 1, 1, 5)],
                                "id long, vendedor_id long, producto_maestro_id long, stock int")
    r = one(repair.survivors(raw))
    assert (r["superviviente"], r["stock"]) == (3, 7)


def _user(spark, sub="sub_1", fin=None):
    return spark.createDataFrame([(1, "a@x.com", "pendiente", None, fin, sub, "cus_1")],
                                 "id long, email string, suscripcion_estado string, suscripcion_plan string, "
                                 "suscripcion_fin date, stripe_subscription_id string, stripe_customer_id string")


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, type string, object string")


def _fold(spark, users, events):
    pays = spark.createDataFrame([], "id long, usuario_id long, estado string, creado_en timestamp_ntz")
    ev_users = spark.createDataFrame([(1,)], "user_id long")
    t = FakeTables(spark, users=users, payments=pays, events=ev_users)
    return one(billing.subscription_fold(t, events=events, users=users, payments=pays))


def test_paid_without_period_end_adds_a_month(spark):
    ev = _events(spark, [(1, dt.datetime(2024, 1, 31, 10, 0), 1, "invoice.payment_succeeded",
                          '{"customer":"cus_1","lines":{"data":[{"subscription":"sub_1"}]}}')])
    r = _fold(spark, _user(spark), ev)
    assert (r["estado"], r["fin"], r["plan"]) == ("activa", dt.datetime(2024, 2, 29, 10, 0), "mini")


def test_deleted_for_replaced_subscription_has_no_effect(spark):
    ev = _events(spark, [(1, dt.datetime(2024, 1, 5), 1, "customer.subscription.deleted", '{"id":"sub_old"}')])
    users = _user(spark, sub="sub_new")
    r = _fold(spark, users, ev)
    assert r["estado"] == "pendiente"


def test_sku_moves_in_arrival_order(spark):
    prod = spark.createDataFrame(
        [(1, "B", None, "n", None, None, 1, 1, None), (2, "A", None, "n", None, None, 1, 1, None)],
        "id long, sku string, skus_anteriores array<string>, nombre string, descripcion string, "
        "precio_sugerido decimal(18,2), categoria_id int, marca_id int, creado_por long")
    # Product 2 (seq 1) moves A -> C, then product 1 (seq 2) takes the freed A.
    req = spark.createDataFrame([(2, 1, "C"), (1, 2, "A")], "id long, seq long, sku string").select(
        "id", "seq", "sku", F.lit(None).cast("string").alias("nombre"), F.lit(None).cast("string").alias("descripcion"),
        F.lit(None).cast("decimal(18,2)").alias("precio_sugerido"), F.lit(None).cast("string").alias("ruta_imagen"),
        F.lit(1).alias("categoria_id"), F.lit(None).cast("int").alias("marca_id"))
    cats = spark.createDataFrame([(1, "c")], "id int, nombre string")
    out = {r["id"]: r for r in patch_catalog(FakeTables(spark, products=prod, categories=cats), req).collect()}
    assert (out[2]["resultado"], out[1]["resultado"]) == ("ok", "ok")
    assert (out[1]["skus_anteriores"], out[2]["skus_anteriores"]) == (["B"], ["A"])

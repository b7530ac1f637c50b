"""Loaders for the application tables.

``Tables`` exposes the application tables (users, products, inventory,
sales, clients, ...) as DataFrames. Two bindings exist:

* ``FixtureTables`` derives them from the driver's TPC-H-style parquet
  tables with integer arithmetic on the base keys (the bindings are listed in
  FIXTURES.md and mirrored in SQL by ``sources.oracle_views``);
* ``SnapshotTables`` reads real snapshots, one parquet directory per table.

Every method returns a lazy DataFrame, so Catalyst prunes columns and pushes
filters into the parquet scan of whichever base table feeds it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.sources.commits import current_commit, folder, versions

MONEY = "decimal(18,2)"

# Fixed values of the fixture binding (FIXTURES.md, "Constants").
AS_OF = dt.date(2001, 8, 1)
FIN_BASE = dt.date(2001, 6, 1)
CATEGORY_IDS = [("ECONOMY", 1), ("SMALL", 2), ("MEDIUM", 3), ("STANDARD", 4), ("LARGE", 5)]


def _s(c) -> F.Column:
    return c.cast("string")


class Tables:
    """Interface: one method per application table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


class SnapshotTables(Tables):
    """Real deployment: one parquet directory per application table. Tables
    that a commit under the root names (``sources.commits``) are read at its
    versions; the commit is looked up once, so that all tables of one object
    belong together."""

    NAMES = {
        "users": "usuarios", "roles": "usuario_roles", "categories": "categorias",
        "products": "catalogo_maestro", "inventory": "inventario_vendedor",
        "sales": "ventas", "clients": "clientas", "instalments": "abonos",
        "payments": "pagos", "push": "push_subscriptions",
    }

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.commit = current_commit(spark, self.root)
        self.versions = versions(spark, self.root, self.commit)

    def read(self, name: str) -> DataFrame:
        table = self.NAMES.get(name, name)
        if table in self.versions:
            return self.spark.read.parquet(f"{folder(self.root, table)}/v={self.versions[table]}")
        return self.spark.read.parquet(f"{self.root}/{table}")

    def __getattr__(self, name):
        if name in self.NAMES:
            return lambda: self.read(name)
        raise AttributeError(name)

    def inventory_raw(self) -> DataFrame:
        """Before the unique constraint the raw table is the table itself."""
        return self.read("inventory")

    def sale_balances(self) -> DataFrame:
        """All sales with owner, client, balance and payment state: the
        instalment ledger's snapshot."""
        return self.read("sales").select(F.col("id").alias("venta_id"), "vendedor_id", "clienta_id",
                                         "saldo_restante", "estado_pago")

    def billing(self) -> DataFrame:
        """Stored webhook events (event_id, ts, user_id, type, object)."""
        return self.read("billing_events")


class FixtureTables(Tables):
    """Application tables derived from the driver's parquet tables."""

    # -- vendors --------------------------------------------------------
    def users(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(
            k.alias("id"),
            F.col("s_name").alias("nombre"),
            F.when(k % 10 == 1, F.concat(F.lit("VENDOR"), _s(k - 1), F.lit("@EXAMPLE.COM")))
             .otherwise(F.concat(F.lit("vendor"), _s(k), F.lit("@example.com"))).alias("email"),
            (F.col("s_nationkey") + 1).alias("marca_id"),
            F.when(k % 5 == 0, "mini").when(k % 5 == 1, "pro").when(k % 5 == 2, "avanzado")
             .when(k % 5 == 3, "ninguno").alias("suscripcion_plan"),
            F.when(k % 4 == 0, "pendiente").when(k % 4 == 1, "activa").when(k % 4 == 2, "pago_fallido")
             .otherwise("cancelada").alias("suscripcion_estado"),
            F.when(k % 3 == 0, F.lit(None).cast("date"))
             .otherwise(F.date_add(F.lit(FIN_BASE), (k % 120).cast("int"))).alias("suscripcion_fin"),
            F.concat(F.lit("store-"), _s(k)).alias("store_slug"),
            F.when(k % 6 == 0, F.lit('{"accent_color":"#18181b","logo":"data:image/png;base64,'
                                     'iVBORw0KGgo=","social":{"instagram":"x"}}'))
             .otherwise(F.lit("{}")).alias("personalizacion"),
            F.when(k % 8 == 7, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("cus_"), _s(k))).alias("stripe_customer_id"),
            F.when(k % 3 == 2, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("sub_"), _s(k))).alias("stripe_subscription_id"),
        )

    def roles(self) -> DataFrame:
        k = F.col("s_suppkey")
        return (self.read("supplier").where(k % 9 != 8)
                .select(k.alias("usuario_id"),
                        F.when(k % 10 == 0, 1).otherwise(2).alias("rol_id")))

    # -- catalog --------------------------------------------------------
    @staticmethod
    def _category_id(col) -> F.Column:
        expr = None
        for name, cid in CATEGORY_IDS:
            expr = F.when(col == name, cid) if expr is None else expr.when(col == name, cid)
        return expr

    def categories(self) -> DataFrame:
        t = F.col("p_type")
        return (self.read("part").where(t != "PROMO")
                .select(self._category_id(t).otherwise(6).alias("id"), t.alias("nombre"))
                .distinct())

    def products(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.read("part").select(
            k.alias("id"),
            F.concat(F.lit("SKU-"), _s(k)).alias("sku"),
            F.col("p_name").alias("nombre"),
            F.when(k % 4 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("descripcion"),
            F.when(k % 50 == 7, F.lit(None).cast(MONEY))
             .otherwise(F.col("p_retailprice").cast(MONEY)).alias("precio_sugerido"),
            F.when(k % 40 == 0, F.lit("data:image/jpeg;base64,/9j/4AAQ"))
             .otherwise(F.concat(F.lit("https://cdn.example/"), _s(k), F.lit(".jpg"))).alias("ruta_imagen"),
            self._category_id(F.col("p_type")).alias("categoria_id"),
            F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("marca_id"),
            (F.col("p_size") % 10 != 0).alias("estado"),
            F.when(F.col("p_size") % 10 == 0, k % 10).alias("creado_por"),
            F.when(k % 3 == 0, F.array(F.concat(F.lit("OLD-"), _s(k)))).alias("skus_anteriores"),
        )

    # -- inventory ------------------------------------------------------
    def inventory(self) -> DataFrame:
        # Aggregate lineitem first (map-side partial aggregation), then join
        # the part price: p_partkey is unique, so max(price) is the price.
        agg = (self.read("lineitem")
               .groupBy("l_suppkey", "l_partkey")
               .agg(F.sum(F.col("l_quantity").cast("int")).alias("q")))
        part = self.read("part").select("p_partkey", "p_retailprice")
        return (agg.join(part, agg.l_partkey == part.p_partkey)
                .select((F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("id"),
                        F.col("l_suppkey").alias("vendedor_id"),
                        F.col("l_partkey").alias("producto_maestro_id"),
                        (F.col("q") % 12).cast("int").alias("stock"),
                        (F.col("p_retailprice").cast(MONEY) * F.lit(1.2).cast("decimal(3,1)"))
                        .cast(MONEY).alias("precio_personalizado")))

    def inventory_raw(self) -> DataFrame:
        o, s, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
        return (self.read("lineitem").groupBy("l_orderkey", "l_suppkey", "l_partkey")
                .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("q"))
                .select(((o * 100000 + s) * 1000000 + p).alias("id"),
                        s.alias("vendedor_id"), p.alias("producto_maestro_id"),
                        F.when(o % 25 == 0, F.lit(None).cast("int")).otherwise(F.col("q")).alias("stock")))

    # -- sales ----------------------------------------------------------
    def sales(self) -> DataFrame:
        li = self.read("lineitem")
        orders = self.read("orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus")
        o, s, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
        price = F.col("l_extendedprice").cast(MONEY)
        credit = (F.col("o_orderstatus") == "O") & (F.col("l_linenumber") % 5 != 0)
        return (li.join(orders, li.l_orderkey == orders.o_orderkey)
                .select(((o * 100000 + s) * 1000000 + p).alias("id"),
                        s.alias("vendedor_id"),
                        (s * 1000000 + p).alias("inventario_id"),
                        F.col("l_quantity").cast("int").alias("cantidad"),
                        price.alias("precio_total"),
                        F.col("o_orderdate").alias("fecha"),
                        F.when(F.col("l_linenumber") % 5 == 0, F.lit(None).cast("bigint"))
                         .otherwise(F.col("o_custkey")).alias("clienta_id"),
                        F.when(credit, "EN_ABONOS").otherwise("PAGADO").alias("estado_pago"),
                        F.when(credit, price - (price * F.col("l_discount").cast("decimal(4,2)")).cast(MONEY))
                         .otherwise(F.lit(0).cast(MONEY)).cast(MONEY).alias("saldo_restante")))

    def instalments(self) -> DataFrame:
        """Every third line has an instalment; one order in 200 names a sale
        that doesn't exist, one line in 50 has no amount."""
        o = F.col("l_orderkey")
        sale = (o * 100000 + F.col("l_suppkey")) * 1000000 + F.col("l_partkey")
        return (self.read("lineitem").where(F.col("l_linenumber") % 3 == 0)
                .select((sale * 10 + F.col("l_linenumber")).alias("id"), F.when(o % 200 == 0, -sale).otherwise(sale).alias("venta_id"),
                        F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice").cast(MONEY)).alias("monto"),
                        F.col("l_shipdate").alias("fecha")))

    def clients(self) -> DataFrame:
        n_vendors = self.read("supplier").select(F.count(F.lit(1))).scalar()
        k = F.col("c_custkey")
        return self.read("customer").select(
            k.alias("id"),
            (k % n_vendors).alias("vendedor_id"),
            F.col("c_name").alias("nombre"),
            F.col("c_acctbal").cast(MONEY).alias("saldo_pendiente"),
            F.when(k % 11 == 0, F.lit(None).cast("date"))
             .otherwise(F.date_add(F.lit(FIN_BASE), (k % 120).cast("int"))).alias("fecha_proximo_pago"))

    def push(self) -> DataFrame:
        k = F.col("s_suppkey")
        return (self.read("supplier").where(k % 2 == 0)
                .select((k * 10 + 1).alias("id"), k.alias("vendedor_id"),
                        F.concat(F.lit('{"endpoint":"https://push.example/'), _s(k), F.lit('"}'))
                        .alias("subscription")))

    def sale_balances(self) -> DataFrame:
        n_vendors = self.read("supplier").select(F.count(F.lit(1))).scalar()
        is_open = F.col("o_orderstatus") == "O"
        return self.read("orders").select(
            F.col("o_orderkey").alias("venta_id"), (F.col("o_custkey") % n_vendors).alias("vendedor_id"),
            F.col("o_custkey").alias("clienta_id"),
            F.when(is_open, F.col("o_totalprice")).otherwise(F.lit(0)).cast(MONEY).alias("saldo_restante"),
            F.when(is_open, "EN_ABONOS").otherwise("PAGADO").alias("estado_pago"))

    # -- billing --------------------------------------------------------
    def payments(self) -> DataFrame:
        e = F.col("event_id")
        return (self.read("events").where(F.col("event_type") == "signup")
                .select(e.alias("id"), F.col("user_id").alias("usuario_id"),
                        F.when(e % 4 == 0, "renovacion").otherwise("suscripcion_inicial").alias("tipo"),
                        F.lit(29900).alias("monto"), F.lit("pendiente").alias("estado"),
                        F.col("ts").alias("creado_en")))

    def billing(self) -> DataFrame:
        e, u, t = F.col("event_id"), _s(F.col("user_id")), F.col("event_type")
        cus, sub = F.concat(F.lit("cus_"), u), F.concat(F.lit("sub_"), u)
        invoice_flat = F.concat(
            F.lit('{"customer":"'), cus, F.lit('","parent":{"subscription_details":{"subscription":"'), sub,
            F.lit('"}},"lines":{"data":[{"period":{"end":'), _s(F.lit(1704067200) + e * 3600),
            F.lit('},"price":{"id":"price_pro"}}]}}'))
        invoice_obj = F.concat(
            F.lit('{"customer":{"id":"cus_'), F.when(e % 10 == 3, _s(F.col("user_id") + 1)).otherwise(u),
            F.lit('"},"lines":{"data":[{"subscription":null},{"subscription":"'),
            F.when(e % 10 == 5, F.lit("subx_")).otherwise(F.lit("sub_")), u, F.lit('"}]}}'))
        pay_status = F.when(e % 3 == 0, "paid").when(e % 3 == 1, "unpaid").otherwise("no_payment_required")
        checkout = F.concat(
            F.lit('{"customer":"'), cus, F.lit('","subscription":"'), sub, F.lit('","payment_status":"'),
            pay_status, F.lit('","metadata":{"pago_id":"'), _s(e), F.lit('","price_id":"price_adv"}}'))
        sub_status = (F.when(e % 6 == 0, "active").when(e % 6 == 1, "past_due").when(e % 6 == 2, "paused")
                      .when(e % 6 == 3, "unpaid").when(e % 6 == 4, "canceled").otherwise("trialing"))
        subscription = F.concat(F.lit('{"id":"'), sub, F.lit('","status":"'), sub_status, F.lit('"}'))
        invoice = t.isin("purchase", "error")
        return self.read("events").select(
            "event_id", "ts", "user_id",
            F.when(t == "signup", "checkout.session.completed")
             .when(t == "purchase", "invoice.payment_succeeded")
             .when(t == "error", "invoice.payment_failed")
             .when(t == "view", "customer.subscription.updated")
             .otherwise("customer.subscription.deleted").alias("type"),
            F.when(invoice & (e % 2 == 0), invoice_flat).when(invoice, invoice_obj)
             .when(t == "signup", checkout).otherwise(subscription).alias("object"))


def fixture_tables(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return FixtureTables(spark, sf_dir)

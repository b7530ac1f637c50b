"""Change tables (one row per request) derived from the driver's tables.

Each binding follows FIXTURES.md "Change-table bindings"; the same rows are
built in SQL by ``plans.oracle_changes``. ``SEQ`` is the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.sources.tables import MONEY, Tables

SEQ = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]


def req_id(cols=SEQ) -> F.Column:
    """Exact request identity: the full SEQ tuple rendered as text."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def sale_requests(t: Tables, lot: int = 0, lots: int = 1) -> DataFrame:
    """One sale request per lineitem row; those of one of ``lots`` lots
    of orders, if there are several."""
    li = t.read("lineitem")
    o = t.read("orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus")
    if lots > 1:
        li, o = (df.where(F.pmod(F.xxhash64(F.col(k).cast("long")), F.lit(lots)) == lot) for df, k in ((li, "l_orderkey"), (o, "o_orderkey")))
    k, s, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    sid = (k * 100000 + s) * 1000000 + p
    total = F.col("l_extendedprice").cast(MONEY)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        *SEQ,
        s.alias("vendedor_id"), (s * 1000000 + p).alias("inventario_id"),
        F.when(sid % 50 == 0, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("cantidad"),
        F.when(sid % 60 == 0, F.lit(None).cast(MONEY))
         .otherwise((F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("decimal(18,0)")
                     * F.lit(0.01).cast("decimal(3,2)")).cast(MONEY)).alias("precio_unitario"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias("clienta_id"),
        F.when(F.col("l_linenumber") == 7, total * 2)
         .otherwise((F.col("l_tax").cast("decimal(4,2)") * total).cast(MONEY)).cast(MONEY).alias("anticipo"),
        (F.col("o_orderstatus") == "O").alias("en_abonos"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.to_date("o_orderdate"), 30)).alias("fecha_proximo_pago"))


def stock_changes(t: Tables) -> DataFrame:
    """Every lineitem row takes l_quantity units of item l_partkey."""
    return t.read("lineitem").select(*SEQ, F.col("l_partkey").alias("item"),
                                     F.col("l_quantity").cast("int").alias("cant"))


def instalment_requests(t: Tables) -> DataFrame:
    """One instalment per lineitem row of every order, amount = extended
    price. Line 6 is sent by another vendor, line 7 names an unknown sale;
    line 5 has amount 0 or NULL for every second order."""
    li = t.read("lineitem")
    sales = t.sale_balances().select("venta_id", F.col("vendedor_id").alias("dueno"))
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    zero, missing = (line == 5) & (k % 4 == 0), (line == 5) & (k % 4 == 2)
    return li.join(sales, li.l_orderkey == sales.venta_id).select(
        *SEQ, F.when(line == 6, F.col("dueno") + 1).otherwise(F.col("dueno")).alias("vendedor_id"),
        F.when(line == 7, -k).otherwise(k).alias("venta_id"),
        F.when(zero, F.lit(0)).when(missing, F.lit(None)).otherwise(F.col("l_extendedprice"))
        .cast(MONEY).alias("monto"))


def admission_requests(t: Tables) -> DataFrame:
    """Every lineitem row asks to add part l_partkey to vendor l_suppkey's
    inventory (distinct pairs plus repeats), in SEQ order."""
    return t.read("lineitem").select(
        *SEQ, F.col("l_suppkey").alias("vendedor_id"),
        F.col("l_partkey").alias("producto_maestro_id"), F.col("l_quantity").cast("int").alias("stock"),
        F.col("l_extendedprice").cast(MONEY).alias("precio_personalizado"))


def custom_item_requests(t: Tables) -> DataFrame:
    """Own items; SKUs repeat across orders ('CUS-' || orderkey % 5000),
    a name is missing for one order in 97."""
    k = F.col("l_orderkey")
    return t.read("lineitem").select(
        *SEQ, req_id().alias("req_id"), F.col("l_suppkey").alias("vendedor_id"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Pieza "), k.cast("string")))
        .alias("nombre"),
        F.concat(F.lit("CUS-"), (k % 5000).cast("string")).alias("sku"),
        F.col("l_quantity").cast("int").alias("stock"),
        F.col("l_extendedprice").cast(MONEY).alias("precio_personalizado"))


def own_item_requests(t: Tables) -> DataFrame:
    """W8 from parts: seven vendors, SKUs repeat, one in fifty is in the
    catalog, one in 97 lacks a name."""
    k = F.col("p_partkey")
    return t.read("part").select(
        k.alias("seq"), k.alias("req_id"), (k % 7).alias("vendedor_id"),
        F.when(k % 97 != 0, F.col("p_name")).alias("nombre"),
        F.when(k % 50 == 0, F.concat(F.lit("SKU-"), k.cast("string")))
         .otherwise(F.concat(F.lit("CUS-"), (k % 600).cast("string"))).alias("sku"),
        F.col("p_size").alias("stock"), F.col("p_retailprice").cast(MONEY).alias("precio_personalizado"))


def sku_move_requests(t: Tables) -> DataFrame:
    """W13 with collisions: each product asks for a SKU three further on,
    which is free only if its holder moved before; every fifth asks for a new
    one, every eleventh sends an unknown category. From the last id down, so
    that some holders have moved and some haven't."""
    k = F.col("p_partkey")
    return t.read("part").select(
        k.alias("id"), F.when(k % 2 == 0, -k).otherwise(k).alias("seq"),
        F.when(k % 5 == 0, F.concat(F.lit("NEW-"), (k % 50).cast("string")))
         .otherwise(F.concat(F.lit("SKU-"), (k + 3).cast("string"))).alias("sku"),
        F.when(k % 4 == 1, F.concat(F.col("p_name"), F.lit(" v2"))).alias("nombre"), F.lit(None).cast("string").alias("descripcion"),
        F.lit(None).cast(MONEY).alias("precio_sugerido"), F.lit(None).cast("string").alias("ruta_imagen"),
        F.when(k % 11 == 0, F.lit(99)).when(k % 3 == 0, F.lit(2)).cast("int").alias("categoria_id"), F.lit(None).cast("int").alias("marca_id"))


def slug_requests(t: Tables) -> DataFrame:
    """W11, several requests a user: every customer row asks for one of 60
    names for user (key % 45), one in 13 without a phone."""
    k = F.col("c_custkey")
    return t.read("customer").select(
        (k % 45).alias("id"), k.alias("seq"), F.concat(F.lit("Tienda "), ((k * 7) % 60).cast("string")).alias("store_slug"),
        F.when(k % 13 != 0, F.concat(F.lit("+52 "), k.cast("string"))).alias("telefono"),
        F.when(k % 4 == 0, F.concat(F.lit('{"n":'), k.cast("string"), F.lit("}"))).alias("personalizacion"))


def sku_chain_requests(t: Tables) -> DataFrame:
    """W13, several requests a product: every customer row patches product
    key % 300, with one of 400 SKUs (most of them held by a product), or none,
    or an unknown category."""
    k = F.col("c_custkey")
    return t.read("customer").select(
        (k % 300).alias("id"), k.alias("seq"),
        F.when(k % 9 != 0, F.concat(F.lit("SKU-"), ((k * 11) % 400).cast("string"))).alias("sku"),
        F.when(k % 6 == 1, F.concat(F.lit("Pieza "), k.cast("string"))).alias("nombre"), F.lit(None).cast("string").alias("descripcion"),
        F.when(k % 10 == 3, k.cast(MONEY)).alias("precio_sugerido"), F.lit(None).cast("string").alias("ruta_imagen"),
        F.when(k % 17 == 0, F.lit(99)).when(k % 4 == 0, F.lit(2)).cast("int").alias("categoria_id"), F.lit(None).cast("int").alias("marca_id"))


def arrival(req: DataFrame) -> list[str]:
    """The columns that order a job's requests: ``seq``, or the fixture's."""
    return ["seq"] if "seq" in req.columns else SEQ


def inventory_patch_requests(t: Tables) -> DataFrame:
    """Stock or price edits of item (l_suppkey, l_partkey); line 6 is
    sent by another vendor (not the owner)."""
    k, s, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    even = k % 2 == 0
    return t.read("lineitem").select(
        *SEQ, (s * 1000000 + p).alias("id"),
        F.when(F.col("l_linenumber") == 6, s + 1).otherwise(s).alias("vendedor_id"),
        F.when(even, F.lit(None).cast("int")).otherwise(F.col("l_quantity").cast("int")).alias("stock"),
        F.when(even, F.col("l_extendedprice").cast(MONEY)).otherwise(F.lit(None).cast(MONEY))
        .alias("precio_personalizado"))

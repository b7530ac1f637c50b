"""Sale registration and instalments as batch change-set jobs.

One request = one row. The reference's transaction per request becomes, for
the whole batch: validation (W1) -> payment split and client check (W3),
both of which roll back in the reference, so they run *before* stock is
consumed -> the ordered stock fold (W2) -> instalments (W4) and client
balances (W5). Amounts are decimals; folds run on integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.functions.formats import money
from vendorlytics.operators.fold import LOT_ROWS, greedy_consume
from vendorlytics.sources.requests import SEQ, instalment_requests, sale_requests, stock_changes
from vendorlytics.session import discard, materialize, materialize_lots, released
from vendorlytics.sources.tables import MONEY, Tables

START_STOCK = 300
IDENT = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]


# -- W1 -------------------------------------------------------------------
def validate_sales(req: DataFrame) -> DataFrame:
    """Reason is NULL for a valid request. ``Number(null)`` is 0 in the
    reference, so a NULL unit price passes as 0."""
    bad_qty = F.col("inventario_id").isNull() | F.col("cantidad").isNull() | (F.col("cantidad") <= 0)
    bad_price = F.coalesce(F.col("precio_unitario"), F.lit(0)) < 0
    return req.withColumn("motivo", F.when(bad_qty, "cantidad_invalida").when(bad_price, "precio_invalido"))


def sale_validate(t: Tables) -> DataFrame:
    return validate_sales(sale_requests(t)).select(*IDENT, "motivo")


# -- W3 -------------------------------------------------------------------
def split_payment(req: DataFrame) -> DataFrame:
    """Total, payment state and balance; anticipo > total on a credit
    sale is refused."""
    total = (F.col("cantidad") * F.coalesce(F.col("precio_unitario"), F.lit(0).cast(MONEY))).cast(MONEY)
    adv = F.coalesce(F.col("anticipo"), F.lit(0).cast(MONEY))
    credit = F.col("clienta_id").isNotNull() & F.coalesce(F.col("en_abonos"), F.lit(False))
    partial = credit & (adv < total)
    return req.withColumns({
        "total": total,
        "anticipo_num": adv,
        "estado_pago": F.when(partial, "EN_ABONOS").otherwise("PAGADO"),
        "saldo_restante": F.when(partial, total - adv).otherwise(F.lit(0)).cast(MONEY),
        "motivo": F.coalesce(F.col("motivo"), F.when(credit & (adv > total), F.lit("anticipo_excede"))),
    })


def sale_payment_split(t: Tables) -> DataFrame:
    s = split_payment(validate_sales(sale_requests(t)).where(F.col("motivo").isNull()))
    return s.select(*IDENT, money("total").alias("total"), "estado_pago",
                    money("saldo_restante").alias("saldo_restante"), "motivo")


# -- W2 -------------------------------------------------------------------
def stock_ledger_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    ch = stock_changes(t)
    start = ch.select("item").distinct().withColumn("stock", F.lit(START_STOCK))
    return greedy_consume(ch, start, ["item"], SEQ, "cant", "stock", carry=["cant"])


def stock_ledger(t: Tables) -> DataFrame:
    """W2 on the fixture: start stock 300 per part, lineitem rows in SEQ."""
    rows, _ = stock_ledger_rows(t)
    return rows.select(*IDENT, "item", "cant", "accepted")


def stock_ledger_final(t: Tables) -> DataFrame:
    _, final = stock_ledger_rows(t)
    return final


# -- the whole registration -------------------------------------------------
def _client_checked(r: DataFrame, clients: DataFrame) -> DataFrame:
    """Refuses sales to unknown clients. Only the clients asked for that are
    unknown (or stored more than once: each is a match) meet the requests, so
    these aren't dealt out by client."""
    n = clients.groupBy(F.col("id").alias("clienta_id")).agg(F.count(F.lit(1)).alias("__n"))
    asked = r.select("clienta_id").where("clienta_id IS NOT NULL").distinct().join(n, "clienta_id", "left")
    odd = materialize(asked.select("clienta_id", F.coalesce("__n", F.lit(0)).alias("__n")).where("__n <> 1"), "sale-clients")
    if odd.isEmpty():
        return r
    r = r.join(odd, "clienta_id", "left").withColumn(
        "motivo", F.coalesce(F.col("motivo"), F.when(F.col("__n") == 0, F.lit("clienta_no_existe"))))
    if not odd.where("__n > 1").isEmpty():
        r = r.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("__n", F.lit(1)), F.lit(1)).cast("int")))).drop("__copy")
    return r.drop("__n")


def register_sales(t: Tables, req: DataFrame | None = None, inventory: DataFrame | None = None,
                   clients: DataFrame | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """W1 -> W3 + client check -> W2. Returns (requests with outcome, new
    inventory stock per item).

    ``keep`` names the columns of the requests that are wanted beside those
    that decide and order them (all, if None): no other is written or dealt
    out. The requests are joined once, and dealt out by item in the fold's lots."""
    with released(t.spark):
        lots = max(1, -(-t.read("lineitem").count() // LOT_ROWS)) if req is None else 1
        inventory = inventory if inventory is not None else materialize(t.inventory(), "sale-inventory")
        clients = clients if clients is not None else t.clients()
        key = ["inventario_id", "vendedor_id"]

        def split(i: int) -> DataFrame:
            r = split_payment(validate_sales(req if req is not None else sale_requests(t, i, lots)))
            return r if keep is None else r.select(*dict.fromkeys([*key, *SEQ, "cantidad", "clienta_id", "motivo", *keep]))

        whole = materialize_lots(t.spark, split, lots, "sale-requests")
        r = _client_checked(whole, clients)
        if keep is not None and "clienta_id" not in keep:
            r = r.drop("clienta_id")
        refused = materialize(r.where(F.col("motivo").isNotNull()), "sale-refused")
        ok = r.where(F.col("motivo").isNull())
        start = inventory.select(F.col("id").alias("inventario_id"), "vendedor_id", "stock")
        rows, final = greedy_consume(ok, start, key, SEQ, "cantidad", "stock",
                                     carry=[c for c in r.columns if c not in key + SEQ])
        discard(whole)  # the fold has its rows, the others are in refused
    folded = rows.withColumn("motivo", F.when(F.col("accepted").isNull(), F.lit("no_pertenece"))
                             .when(~F.col("accepted"), F.lit("sin_stock"))).drop("accepted")
    out = refused.unionByName(folded).withColumn("aceptada", F.col("motivo").isNull())
    new_stock = inventory.join(final.withColumnRenamed("stock", "nuevo_stock")
                               .withColumnRenamed("inventario_id", "id"), ["id", "vendedor_id"], "left") \
        .withColumn("stock", F.coalesce("nuevo_stock", "stock").cast("int")).drop("nuevo_stock")
    return out, new_stock


def _registered(t: Tables, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``register_sales`` with few columns of the requests and the inventory."""
    with released(t.spark):
        inventory = materialize(t.inventory().select("id", "vendedor_id", "stock"), "sale-inventory")
    return register_sales(t, inventory=inventory, keep=keep)


def sale_register(t: Tables) -> DataFrame:
    out, _ = _registered(t, ["estado_pago", "saldo_restante"])
    return out.select(*IDENT, "aceptada", "motivo", "estado_pago", money("saldo_restante").alias("saldo_restante"))


def sale_register_stock(t: Tables) -> DataFrame:
    _, inv = _registered(t, [])
    return inv.select("id", "vendedor_id", "stock")


# -- W4 / W5 --------------------------------------------------------------
def first_instalments(t: Tables) -> DataFrame:
    """An instalment whenever the accepted sale has a client and an
    advance > 0, also when it was not a credit sale."""
    out, _ = _registered(t, ["clienta_id", "anticipo_num"])
    a = out.where(F.col("aceptada") & F.col("clienta_id").isNotNull() & (F.col("anticipo_num") > 0))
    return a.select(*IDENT, "clienta_id", money("anticipo_num").alias("monto"))


def client_balance_apply(t: Tables) -> DataFrame:
    """Client balance += new sale balances; next payment date = last
    non-NULL date sent, in arrival order, else unchanged."""
    out, _ = _registered(t, ["clienta_id", "saldo_restante", "fecha_proximo_pago"])
    a = out.where(F.col("aceptada") & F.col("clienta_id").isNotNull())
    seq = F.struct(*[F.col(c) for c in SEQ])
    d = a.groupBy("clienta_id").agg(
        F.sum("saldo_restante").alias("delta"),
        F.max_by("fecha_proximo_pago", F.when(F.col("fecha_proximo_pago").isNotNull(), seq)).alias("fecha"))
    c = t.clients()
    j = c.join(d, c.id == d.clienta_id, "left")
    return j.select("id", "vendedor_id",
                    money(F.col("saldo_pendiente") + F.coalesce("delta", F.lit(0))).alias("saldo_pendiente"),
                    F.coalesce("fecha", "fecha_proximo_pago").alias("fecha_proximo_pago"))


# -- W6 -------------------------------------------------------------------
def apply_instalments(t: Tables, req: DataFrame | None = None, sales: DataFrame | None = None,
                      seq: list[str] = SEQ) -> tuple[DataFrame, DataFrame]:
    """Returns (every request with outcome, new sale snapshot).

    Checked in the reference's order: amount missing or <= 0 (or no sale
    named), sale unknown or another vendor's, sale already paid, amount above
    the balance. A refused request counts as ``venta_pagada`` once the
    balance has reached 0, that is, after the accepted request that emptied
    it. Balances fold in cents, per sale, in arrival order (``seq``)."""
    req = req if req is not None else instalment_requests(t)
    sales = sales if sales is not None else t.sale_balances()
    known = sales.select("venta_id", "vendedor_id", F.lit(True).alias("__known"),
                         ((F.col("estado_pago") == "PAGADO") | (F.col("saldo_restante") <= 0)).alias("__paid"))
    bad = F.col("monto").isNull() | F.col("venta_id").isNull() | (F.col("monto") <= 0)
    r = req.join(known, ["venta_id", "vendedor_id"], "left").withColumn(
        "motivo", F.when(bad, "monto_invalido").when(F.col("__known").isNull(), "venta_no_encontrada")
        .when(F.col("__paid"), "venta_pagada")).drop("__known", "__paid")
    r = materialize(r, "instalment-requests")
    ch = r.where(F.col("motivo").isNull()).withColumn("cents", (F.col("monto") * 100).cast("long"))
    start = sales.select("venta_id", (F.col("saldo_restante") * 100).cast("long").alias("cents"))
    rows, final = greedy_consume(ch, start, ["venta_id"], seq, "cents", "cents", carry=["vendedor_id", "monto"])
    order = F.struct(*[F.col(c) for c in seq])
    emptied = rows.where("accepted").groupBy("venta_id").agg(F.max(order).alias("__last")) \
        .join(final.where("cents <= 0").select("venta_id"), "venta_id")
    folded = rows.join(emptied, "venta_id", "left").withColumn(
        "motivo", F.when(F.col("accepted"), F.lit(None).cast("string"))
        .when(order > F.col("__last"), "venta_pagada").otherwise("excede_saldo"))
    cols = [*seq, "vendedor_id", "venta_id", "monto", "motivo"]
    out = r.where(F.col("motivo").isNotNull()).select(*cols).unionByName(folded.select(*cols)) \
        .withColumn("aceptada", F.col("motivo").isNull())
    left = (F.col("cents") / 100).cast(MONEY)
    changed = left != F.col("saldo_restante")
    new_sales = sales.join(final, "venta_id", "left").withColumns({
        "estado_pago": F.when(changed, F.when(F.col("cents") <= 0, "PAGADO").otherwise("EN_ABONOS"))
        .otherwise(F.col("estado_pago")),
        "saldo_restante": F.when(changed, left).otherwise(F.col("saldo_restante"))}).drop("cents")
    return out, new_sales


def instalment_ledger(t: Tables) -> DataFrame:
    out, _ = apply_instalments(t)
    return out.select(*IDENT, "vendedor_id", "venta_id", money("monto").alias("monto"), "aceptada", "motivo")


def instalment_rows(t: Tables) -> DataFrame:
    """The accepted requests as new rows of the instalment table."""
    out, _ = apply_instalments(t)
    return out.where("aceptada").select("venta_id", money("monto").alias("monto"))


def instalment_sale_state(t: Tables) -> DataFrame:
    _, sales = apply_instalments(t)
    return sales.select("venta_id", "vendedor_id", "clienta_id", money("saldo_restante").alias("saldo_restante"),
                        "estado_pago")


def instalment_client_balance(t: Tables) -> DataFrame:
    """Each client's balance falls by the instalments accepted."""
    out, _ = apply_instalments(t)
    paid = out.where(F.col("aceptada")) \
        .join(t.sale_balances().select("venta_id", "clienta_id"), "venta_id") \
        .groupBy("clienta_id").agg(F.sum("monto").alias("pagado"))
    c = t.clients()
    j = c.join(paid, c.id == paid.clienta_id, "left")
    return j.select("id", money(F.col("saldo_pendiente") - F.coalesce("pagado", F.lit(0))).alias("saldo_pendiente"))


QUERIES = {
    "sale_validate": sale_validate,
    "sale_payment_split": sale_payment_split,
    "stock_ledger": stock_ledger,
    "stock_ledger_final": stock_ledger_final,
    "sale_register": sale_register,
    "sale_register_stock": sale_register_stock,
    "first_instalments": first_instalments,
    "client_balance_apply": client_balance_apply,
    "instalment_ledger": instalment_ledger,
    "instalment_rows": instalment_rows,
    "instalment_sale_state": instalment_sale_state,
    "instalment_client_balance": instalment_client_balance,
}

"""Inventory and catalog change-set jobs.

Each job takes a snapshot and a batch of requests (arrival order = SEQ or
the id) and returns the outcome per request; the new snapshot is the
snapshot with the accepted changes applied. Reason precedence follows the
order of checks in the reference handlers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.functions.formats import money
from vendorlytics.operators.admission import fixpoint, quota_fill, quota_ok, seq_struct, unique_claims
from vendorlytics.session import materialize, materialize_lots, released
from vendorlytics.sources.requests import admission_requests, arrival, custom_item_requests, inventory_patch_requests
from vendorlytics.sources.tables import MONEY, Tables

# Plan quota of the reference.
ITEM_QUOTA = 50
QUOTA_PLAN = "mini"
IDENT = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
LOT_ROWS = 64_000_000  # requests and snapshot rows that are dealt out by id at a time
HELD_IDS = 4_000_000  # ids that go to every task


def _empty_inventory(t: Tables) -> DataFrame:
    return t.inventory().where(F.lit(False))


def _vendor_plans(t: Tables) -> DataFrame:
    return t.users().select(F.col("id").alias("vendedor_id"), F.col("marca_id").alias("v_marca"),
                            F.coalesce("suscripcion_plan", F.lit(QUOTA_PLAN)).alias("plan"),
                            F.lit(True).alias("v_known"))


def _slots(t: Tables, snapshot: DataFrame, quota: int) -> DataFrame:
    """vendor -> limited flag and free slots (quota - items held)."""
    held = snapshot.groupBy("vendedor_id").agg(F.count(F.lit(1)).alias("held"))
    v = _vendor_plans(t).join(held, "vendedor_id", "left")
    return v.select("vendedor_id", "v_marca", "plan", "v_known", (F.col("plan") == QUOTA_PLAN).alias("limited"),
                    (F.lit(quota) - F.coalesce("held", F.lit(0))).alias("cap"))


# -- W7 -------------------------------------------------------------------
def admit_inventory(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None,
                    quota: int = ITEM_QUOTA, seq: list[str] | None = None) -> DataFrame:
    """Add catalog items to vendors' inventories.

    Checks in order: vendor exists (401); quota of plan 'mini' (403); item of
    the vendor's brand or created by the vendor (403); (vendor, item) not
    held yet (409). Only accepted requests use quota slots, so the accepted
    ones are the first ``cap`` candidates of each vendor, where a candidate
    is the first permitted request of a pair not in the snapshot.
    """
    req = req if req is not None else admission_requests(t)
    SEQ = seq or arrival(req)
    snapshot = snapshot if snapshot is not None else _empty_inventory(t)
    prod = t.products().select(F.col("id").alias("producto_maestro_id"), F.col("marca_id").alias("p_marca"),
                               "creado_por")
    r = (req.join(_slots(t, snapshot, quota), "vendedor_id", "left").join(prod, "producto_maestro_id", "left"))
    allowed = F.coalesce((F.col("p_marca") == F.col("v_marca")) | (F.col("creado_por") == F.col("vendedor_id")),
                         F.lit(False))
    held = snapshot.select("vendedor_id", "producto_maestro_id", F.lit(True).alias("held_pair"))
    r = r.withColumn("allowed", allowed & F.col("v_known").isNotNull()).join(
        held, ["vendedor_id", "producto_maestro_id"], "left")
    pair_first = (r.where(F.col("allowed") & F.col("held_pair").isNull())
                  .groupBy("vendedor_id", "producto_maestro_id").agg(F.min(seq_struct(SEQ)).alias("first_seq")))
    r = r.join(pair_first, ["vendedor_id", "producto_maestro_id"], "left")
    r = r.withColumn("candidate", F.coalesce(seq_struct(SEQ) == F.col("first_seq"), F.lit(False)))
    fill = quota_fill(r.where(F.col("candidate") & F.col("limited") & (F.col("cap") > 0)),
                      "vendedor_id", SEQ, "cap", quota)
    r = r.join(fill, "vendedor_id", "left")
    qok = quota_ok(F.col("limited"), F.col("cap"), F.col("fill"), SEQ)
    result = (F.when(F.col("v_known").isNull(), "vendedor_no_encontrado")
              .when(~qok, "cuota").when(~F.col("allowed"), "sin_permiso")
              .when(~F.col("candidate"), "duplicado").otherwise("ok"))
    return r.withColumn("resultado", result)


def inventory_admission(t: Tables) -> DataFrame:
    return admit_inventory(t).select(*IDENT, "vendedor_id", "producto_maestro_id", "resultado")


# -- W8 -------------------------------------------------------------------
def submit_custom_items(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None,
                        quota: int = ITEM_QUOTA, seq: list[str] | None = None) -> DataFrame:
    """Vendors create their own (pending) items.

    Checks: required fields (400); quota (403); SKU unique across the
    catalog and the items accepted earlier in the batch (409). The SKU rule
    couples vendors (a refused SKU uses no quota slot, a quota refusal frees
    the SKU), so outcomes are solved by ``fixpoint``, among the requests that
    may be accepted at all (``_sku_candidates``). What these take, a row a SKU
    and a row a vendor, then decides every request; no request is written.
    """
    req = req if req is not None else custom_item_requests(t)
    SEQ = seq or arrival(req)
    snapshot = snapshot if snapshot is not None else _empty_inventory(t)
    valid = (F.col("nombre").isNotNull() & (F.col("nombre") != "") & F.col("sku").isNotNull()
             & (F.col("sku") != "") & F.col("stock").isNotNull() & F.col("precio_personalizado").isNotNull())
    catalog = t.products().select("sku", F.lit(True).alias("in_catalog"))
    slots = _slots(t, snapshot, quota).select("vendedor_id", "limited", "cap")
    base = (req.where("req_id IS NOT NULL").withColumn("valid", valid).join(catalog, "sku", "left")
            .join(slots, "vendedor_id", "left")
            .withColumn("limited", F.coalesce("limited", F.lit(True)))
            .withColumn("cap", F.coalesce("cap", F.lit(quota)))
            .withColumn("__seq", seq_struct(SEQ))
            .select(*req.columns, "__seq", "valid", F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"), "limited", "cap"))
    cands = materialize(_sku_candidates(base, SEQ), "custom-items")

    def taken(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the accepted requests take: SKU -> first, vendor -> last slot."""
        acc = cands.join(flags.where("ok"), "req_id")
        return (acc.groupBy("sku").agg(F.min("__seq").alias("sku_first")),
                quota_fill(acc.where(F.col("limited") & (F.col("cap") > 0)), "vendedor_id", SEQ, "cap", quota))

    def decided(df: DataFrame, first_sku: DataFrame, fill: DataFrame) -> DataFrame:
        sku_free = ~F.col("in_catalog") & (F.col("sku_first").isNull() | (F.col("sku_first") >= F.col("__seq")))
        qok = quota_ok(F.col("limited"), F.col("cap"), F.col("fill"), SEQ)
        return df.join(first_sku, "sku", "left").join(fill, "vendedor_id", "left").withColumn("qok", qok) \
            .withColumn("ok", F.col("valid") & F.col("qok") & sku_free)

    # Start: every candidate, ignoring quota and the other candidates.
    flags = fixpoint(lambda flags: decided(cands, *taken(flags)).select("req_id", "ok"), cands.select("req_id", F.lit(True).alias("ok")), "req_id")
    first_sku, fill = (materialize(x, "custom-taken") for x in taken(flags))
    result = (F.when(~F.col("valid"), "datos_faltantes").when(~F.col("qok"), "cuota")
              .when(~F.col("ok"), "sku_duplicado").otherwise("ok"))
    out = decided(base, first_sku, fill).withColumn("resultado", result).drop("qok")
    # A request sent several times has each of its rows as often (and used as
    # many slots). Such requests are found by a hash of their ids.
    code = F.xxhash64("req_id").alias("code")
    again = materialize(base.select(code).groupBy("code").count().where("count > 1").select("code"), "custom-repeats")
    if again.isEmpty():
        return out
    copies = base.select("req_id", code).join(again, "code", "left_semi").groupBy("req_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = out.join(materialize(copies, "custom-copies"), "req_id", "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("copies", F.lit(1).cast("bigint"))))).drop("copy", "copies")


def _sku_candidates(base: DataFrame, seq: list[str]) -> DataFrame:
    """The requests that may be accepted, in the columns that decide.

    A vendor without a quota gets a SKU as soon as it is asked for, if nobody
    has it: whoever asks after the first of these is refused. Of a vendor's
    requests for one SKU only the first counts: where it is refused, for the
    SKU or for the quota, the later ones are too."""
    cols = ["req_id", "sku", "vendedor_id", "limited", "cap", "valid", "in_catalog", "__seq", *seq]
    cols = list(dict.fromkeys(cols))
    hope = base.where(F.col("valid") & ~F.col("in_catalog") & (~F.col("limited") | (F.col("cap") > 0))).select(*cols)
    free = ~F.col("limited") | F.col("vendedor_id").isNull()  # nobody counts the slots of a NULL vendor
    sure = materialize(hope.where(free).groupBy("sku").agg(F.min("__seq").alias("sure")), "custom-sure")
    near = materialize(hope.join(sure, "sku", "left").where(F.col("sure").isNull() | (F.col("__seq") <= F.col("sure"))).drop("sure"), "custom-near")
    first = near.where(~free).groupBy("vendedor_id", "sku").agg(F.min("__seq").alias("first"))
    bound = near.where(~free).join(first, ["vendedor_id", "sku"]).where(F.col("__seq") == F.col("first")).select(*cols)
    return near.where(free).unionByName(bound)


def custom_item_submit(t: Tables) -> DataFrame:
    return submit_custom_items(t).select(*IDENT, "vendedor_id", "sku", "resultado")


# -- W9 -------------------------------------------------------------------
def patch_inventory(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None):
    """COALESCE(new, old) for stock and price, owner only (else 404).
    Several edits of one item: the last non-NULL value of each column wins."""
    req = req if req is not None else inventory_patch_requests(t)
    SEQ = arrival(req)
    ident = IDENT if SEQ != ["seq"] else SEQ
    snap = snapshot if snapshot is not None else t.inventory()
    owned = snap.select("id", "vendedor_id", F.lit(True).alias("owned"))
    r = req.join(owned, ["id", "vendedor_id"], "left")
    outcome = r.select(*ident, "id", "vendedor_id",
                       F.when(F.col("owned").isNull(), "no_encontrado").otherwise("ok").alias("resultado"))
    seq = seq_struct(SEQ)
    upd = r.where(F.col("owned")).groupBy("id").agg(
        F.max_by("stock", F.when(F.col("stock").isNotNull(), seq)).alias("new_stock"),
        F.max_by("precio_personalizado", F.when(F.col("precio_personalizado").isNotNull(), seq)).alias("new_price"))
    new = snap.join(upd, "id", "left").select(
        "id", "vendedor_id", "producto_maestro_id", F.coalesce("new_stock", "stock").alias("stock"),
        F.coalesce("new_price", "precio_personalizado").alias("precio_personalizado"))
    return outcome, new


def inventory_patch(t: Tables) -> DataFrame:
    _, new = patch_inventory(t)
    return new.select("id", "vendedor_id", "producto_maestro_id", "stock",
                      money("precio_personalizado").alias("precio_personalizado"))


def inventory_patch_outcome(t: Tables) -> DataFrame:
    outcome, _ = patch_inventory(t)
    return outcome


# -- W10 ------------------------------------------------------------------
def delete_snapshot(t: Tables) -> DataFrame:
    """Fixture: v_inventory plus unsold (vendor, part) pairs.

    Pairs are many more than inventory rows, so they aren't shuffled: the ids
    that could be in the inventory (those of a vendor and a part that pair up)
    go to the tasks that make the pairs."""
    s = t.read("supplier").select("s_suppkey", (F.col("s_suppkey") % 97).alias("m"))
    p = t.read("part").select("p_partkey", "p_retailprice", (F.col("p_partkey") % 97).alias("m"))
    with released(t.spark):
        inv = materialize(t.inventory(), "delete-inventory")
    span = t.read("part").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    # an id may be that of several vendors, if parts have keys above a million
    vendors, part = F.expr("sequence((id - hi) div 1000000 - 1, (id - lo) div 1000000 + 1)"), lambda v: F.col("id") - v * 1000000
    pairs = F.exists(vendors, lambda v: part(v).between(F.col("lo"), F.col("hi")) & (v % 97 == part(v) % 97))
    near = materialize(inv.select("id").crossJoin(F.broadcast(span)).where(pairs).select("id").distinct(), "delete-held")
    near = F.broadcast(near) if near.count() <= HELD_IDS else near
    tasks = 8 * t.spark.sparkContext.defaultParallelism  # a part makes many pairs, so its file's splits are too few
    extra = (p.repartition(tasks).join(F.broadcast(s), "m").select((F.col("s_suppkey") * 1000000 + F.col("p_partkey")).alias("id"),
                                   F.col("s_suppkey").alias("vendedor_id"),
                                   F.col("p_partkey").alias("producto_maestro_id"), F.lit(1).alias("stock"),
                                   F.col("p_retailprice").cast(MONEY).alias("precio_personalizado"))
             .join(near, "id", "left_anti"))
    return inv.unionByName(extra)


def _first_requests(req: DataFrame) -> DataFrame:
    """Requests with ``first_seq``, the first one for their (id, vendor); those
    without an id or a vendor name nothing and are left out."""
    same = Window.partitionBy("id", "vendedor_id")
    return req.where("id IS NOT NULL AND vendedor_id IS NOT NULL").withColumn("first_seq", F.min("seq").over(same))


def _with_sales(sold: DataFrame, req: DataFrame) -> DataFrame:
    return req.join(sold, "id", "left").withColumn("ventas", F.coalesce("ventas", F.lit(0)))


def _with_owned(r: DataFrame, owned: DataFrame, how: str) -> DataFrame:
    """``r`` and the snapshot's rows of the same id and vendor. Joined by the
    id, the vendor compared: so the requests, which come by their ids, aren't
    dealt out anew."""
    o = owned.select(F.col("id").alias("o_id"), F.col("vendedor_id").alias("o_vendor"), "producto_maestro_id", F.lit(True).alias("owned"))
    same = (F.col("id") == F.col("o_id")) & (F.col("vendedor_id") <= F.col("o_vendor")) & (F.col("vendedor_id") >= F.col("o_vendor"))
    return r.join(o, same, how).drop("o_id", "o_vendor")


def _result() -> F.Column:
    return (F.when(F.col("ventas") > 0, "tiene_ventas")
            .when(F.col("owned").isNull() | (F.col("seq") != F.col("first_seq")), "no_encontrado")
            .otherwise("eliminado"))


def _outcomes(t: Tables, req: DataFrame, snap: DataFrame, keep: list[str] | None = None, lot_rows: int = LOT_ROWS) -> DataFrame:
    """Every request with its outcome. One shuffle of the requests and
    one of the snapshot, by id; where they are many, in lots of ids one after
    the other, so that the shuffle files are those of one lot."""
    rows = 2 * snap.count() if req is None else req.count() + snap.count()
    req = req if req is not None else _all_rows(snap)
    sold = t.sales().groupBy(F.col("inventario_id").alias("id")).agg(F.count(F.lit(1)).alias("ventas"))
    alike = len({df.schema["id"].dataType for df in (req, snap, sold)}) == 1  # else an id's hashes differ
    lots = max(1, -(-rows // lot_rows)) if alike else 1

    def lot(i: int, sold: DataFrame) -> DataFrame:
        mine = F.lit(True) if lots == 1 else F.pmod(F.xxhash64("id"), F.lit(lots)) == i
        r = _first_requests(_with_sales(sold.where(mine), req.where(mine)))
        out = _with_owned(r, snap.where(mine), "left").withColumn("resultado", _result())
        return out.select(*keep) if keep else out

    if lots == 1:
        return lot(0, sold)
    with released(t.spark):
        sold = materialize(sold, "delete-sold")
        return materialize_lots(t.spark, lambda i: lot(i, sold), lots, "delete-outcomes")


def _all_rows(snap: DataFrame) -> DataFrame:
    """Fixture: every vendor asks to delete every item, in order of the ids."""
    return snap.select("id", "vendedor_id", F.col("id").alias("seq"))


def _deleted(t: Tables, req: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot's ``rows`` that are deleted, and when. Only requests
    and sales of their ids are looked at."""
    ids = materialize(rows.select("id").distinct(), "delete-ids")
    sold = t.sales().select(F.col("inventario_id").alias("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("ventas"))
    r = _first_requests(_with_sales(sold, req.join(ids, "id", "left_semi")))
    return _with_owned(r, rows, "inner").withColumn("resultado", _result()).where("resultado = 'eliminado'")


def _removed(t: Tables, req: DataFrame, snap: DataFrame, most: int = HELD_IDS // 4) -> DataFrame:
    """W10, product cleanup: the creator's deletion must be the last deletion
    of a pending product and leave no row behind.

    So a product stays where its creator deletes no row of it, which the
    creators' rows alone tell. The rows of the others are matched with the
    requests; are they more than ``most``, some of each product first: a
    product of which anything is deleted after the creator's row stays too."""
    item, creator = "producto_maestro_id", F.col("vendedor_id") == F.col("creado_por")
    with released(t.spark):
        prod = materialize(t.products().where(~F.col("estado")).select(F.col("id").alias(item), "creado_por"), "delete-pending")
        own = prod.select(item, F.col("creado_por").alias("vendedor_id"))
        snap = snap.select("id", "vendedor_id", item)
        held = materialize(snap.join(own, [item, "vendedor_id"], "left_semi"), "delete-own")
        last = materialize(_deleted(t, req, held).join(prod, item).where(creator).groupBy(item, "creado_por").agg(F.max("seq").alias("creator_del")), "delete-last")
        pending = materialize(snap.join(last.select(item).distinct(), item, "left_semi"), "delete-rows")
        if pending.count() > most:
            some = Window.partitionBy(item).orderBy(F.xxhash64("id"))
            first = pending.withColumn("n", F.row_number().over(some)).where(F.col("n") <= max(1, most // last.count())).drop("n")
            later = _deleted(t, req, first).select(item, "seq").join(last, item).where("seq > creator_del").select(item, "creado_por").distinct()
            last = materialize(last.join(materialize(later, "delete-later"), [item, "creado_por"], "left_anti"), "delete-last")
            pending = materialize(pending.join(last.select(item).distinct(), item, "left_semi"), "delete-rows")
        rows = pending.groupBy(item).agg(F.count(F.lit(1)).alias("n_rows"))
        dels = _deleted(t, req, pending).join(prod, item).groupBy(item, "creado_por").agg(
            F.count(F.lit(1)).alias("n_del"), F.max("seq").alias("last_del"),
            F.max(F.when(creator, F.col("seq"))).alias("creator_del"))
        removed = dels.join(rows, item).where(
            (F.col("n_del") == F.col("n_rows")) & (F.col("creator_del") == F.col("last_del")))
        return materialize(removed.select(F.col(item).alias("id"), "creado_por"), "delete-removed")


def delete_inventory(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None):
    """Delete inventory items; refused (409) while sales reference the
    item; then drop the product when it is pending, created by the deleting
    vendor, and no inventory row references it any more.

    Requests (id, vendedor_id, seq). Returns (outcome, new inventory,
    removed products)."""
    snap = snapshot if snapshot is not None else delete_snapshot(t)
    out = _outcomes(t, req, snap)
    new_inv = snap.join(out.where("resultado = 'eliminado'").select("id"), "id", "left_anti")
    return out, new_inv, _removed(t, req if req is not None else _all_rows(snap), snap)


def inventory_delete(t: Tables) -> DataFrame:
    out = _outcomes(t, None, delete_snapshot(t), ["id", "vendedor_id", "resultado", "ventas"])
    return out.select("id", "vendedor_id", "resultado", F.col("ventas").cast("bigint").alias("ventas"))


def inventory_delete_products(t: Tables) -> DataFrame:
    snap = delete_snapshot(t)
    return _removed(t, _all_rows(snap), snap)


# -- W12 ------------------------------------------------------------------
def catalog_create_requests(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.read("part").select(
        k.alias("seq"), F.concat(F.lit("SKU-"), (k + 1000).cast("string")).alias("sku"),
        F.col("p_name").alias("nombre"), F.col("p_retailprice").cast(MONEY).alias("precio_sugerido"),
        (k % 8).cast("int").alias("categoria_id"), (k % 27).cast("int").alias("marca_id"))


def create_catalog_items(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Admin-created (approved) items. The unique SKU is checked at
    insert time, the foreign keys (category, brand) at statement end, so a
    SKU clash wins over a bad key; a request refused by a key leaves its SKU
    free for later requests."""
    req = req if req is not None else catalog_create_requests(t)
    prod = t.products()
    cats = t.categories().select(F.col("id").alias("categoria_id"), F.lit(True).alias("cat_ok"))
    brands = prod.select(F.col("marca_id")).distinct().withColumn("brand_ok", F.lit(True))
    taken = prod.select("sku", F.lit(True).alias("in_catalog"))
    r = req.join(cats, "categoria_id", "left").join(brands, "marca_id", "left").join(taken, "sku", "left")
    fk_ok = (F.col("categoria_id").isNull() | F.col("cat_ok").isNotNull()) & \
            (F.col("marca_id").isNull() | F.col("brand_ok").isNotNull())
    r = r.withColumn("fk_ok", fk_ok)
    winners = r.where(F.col("in_catalog").isNull() & F.col("fk_ok")).groupBy("sku").agg(F.min("seq").alias("win"))
    r = r.join(winners, "sku", "left")
    result = (F.when(F.col("in_catalog").isNotNull() | (F.col("win") < F.col("seq")), "sku_duplicado")
              .when(~F.col("fk_ok"), "fk_invalida").otherwise("ok"))
    return r.withColumn("resultado", result)


def catalog_create(t: Tables) -> DataFrame:
    return create_catalog_items(t).select("seq", "sku", "categoria_id", "marca_id", "resultado")


# -- W13 ------------------------------------------------------------------
def catalog_patch_requests(t: Tables) -> DataFrame:
    p = t.products()
    m = F.col("id") % 4
    return p.select(
        F.col("id"), F.col("id").alias("seq"),
        F.when(m == 0, F.concat(F.lit("NEW-"), F.col("id").cast("string"))).when(m == 1, F.col("sku"))
         .when(m == 2, F.concat(F.lit("OLD-"), F.col("id").cast("string"))).alias("sku"),
        F.when(m == 1, F.concat(F.col("nombre"), F.lit(" v2"))).alias("nombre"),
        F.when(m == 3, F.lit("Editada")).alias("descripcion"),
        F.lit(None).cast(MONEY).alias("precio_sugerido"), F.lit(None).cast("string").alias("ruta_imagen"),
        F.when(m != 3, F.col("categoria_id")).alias("categoria_id"), F.lit(None).cast("int").alias("marca_id"))


def decide_patches(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """W13, every request with its outcome. The unique check (at update)
    precedes the category key (statement end); SKUs move between products in
    arrival order (``unique_claims``), a product may have any number of
    requests. A request without a SKU keeps the product's."""
    req = req if req is not None else catalog_patch_requests(t)
    p = t.products()
    cats = t.categories().select(F.col("id").alias("categoria_id"), F.lit(True).alias("cat_ok"))
    r = req.join(p.select("id", F.lit(True).alias("found")), "id", "left").join(cats, "categoria_id", "left")
    exists = F.col("found").isNotNull()
    fk_ok = F.col("categoria_id").isNull() | F.col("cat_ok").isNotNull()
    base = r.select(F.col("seq").alias("req"), F.col("id").alias("owner"), "seq", F.col("sku").alias("value"),
                    exists.alias("pre_ok"), fk_ok.alias("post_ok"))
    holders = p.select(F.col("id").alias("h_owner"), F.col("sku").alias("h_value"))
    r = r.join(unique_claims(base, holders).withColumnRenamed("req", "seq").drop("ok"), "seq", "left")
    result = (F.when(~exists, "no_encontrada").when(F.col("blocked"), "sku_duplicado")
              .when(~fk_ok, "fk_invalida").otherwise("ok"))
    return r.withColumn("resultado", result).select(*req.columns, "resultado")


def patched_catalog(t: Tables, decided: DataFrame) -> DataFrame:
    """The new products. COALESCE edits: the last value sent wins by
    column, except categoria_id: the last request's, NULL included. A changed
    SKU moves the old one into the history, request by request."""
    p, seq = t.products(), F.col("seq")
    ok = decided.where("resultado = 'ok'")
    plain = ["nombre", "descripcion", "precio_sugerido", "ruta_imagen", "marca_id"]
    edits = ok.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(f"n_{c}") for c in plain],
        F.max_by("categoria_id", seq).alias("n_categoria_id"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("sku").isNotNull(), F.struct("seq", "sku")))), lambda x: x["sku"]).alias("n_skus"),
        F.lit(True).alias("hit"))
    j = p.join(edits, "id", "left")

    def move(acc, new):
        moved = acc["sku"].isNotNull() & (acc["sku"] != new)
        kept = F.array_remove(F.array_append(F.coalesce(acc["old"], F.array().cast("array<string>")), acc["sku"]), new)
        return F.struct(new.alias("sku"), F.when(moved, kept).otherwise(acc["old"]).alias("old"))

    skus = F.aggregate(F.coalesce("n_skus", F.array().cast("array<string>")),
                       F.struct(F.col("sku"), F.col("skus_anteriores").alias("old")), move)
    new = {c: F.coalesce(f"n_{c}", c) for c in plain} | {
        "categoria_id": F.when(F.col("hit"), F.col("n_categoria_id")).otherwise(F.col("categoria_id")),
        "sku": F.col("moved.sku"), "skus_anteriores": F.col("moved.old")}
    j = j.withColumn("moved", skus)
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in p.columns])


def patch_catalog(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Every request's outcome and what its product is after the batch."""
    decided = materialize(decide_patches(t, req), "patches")
    after = patched_catalog(t, decided)
    return decided.select("id", "resultado").join(after, "id", "left").select("id", "resultado", *[c for c in after.columns if c != "id"])


def catalog_patch(t: Tables) -> DataFrame:
    d = patch_catalog(t)
    return d.select("id", "resultado", "sku", "nombre", "descripcion", money("precio_sugerido").alias("precio_sugerido"),
                    "categoria_id", "marca_id", "skus_anteriores")


# -- W14 / W15 ------------------------------------------------------------
def pending_requests(t: Tables) -> DataFrame:
    """Fixture: approve / reject every pending item."""
    return t.products().where(~F.col("estado")).select("id")


def catalog_approve(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """404 if absent, 400 without category, else approved."""
    req = req if req is not None else pending_requests(t)
    p = t.products().select("id", "categoria_id", F.lit(True).alias("found"))
    r = req.join(p, "id", "left")
    return r.select("id", F.when(F.col("found").isNull(), "no_encontrada")
                    .when(F.col("categoria_id").isNull(), "sin_categoria").otherwise("aprobada").alias("resultado"))


def catalog_reject(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Only pending items; their inventory rows go first, then the item."""
    req = req if req is not None else pending_requests(t)
    pend = t.products().where(~F.col("estado")).select("id", F.lit(True).alias("pending"))
    r = req.join(pend, "id", "left")
    inv = t.inventory().groupBy(F.col("producto_maestro_id").alias("id")).agg(F.count(F.lit(1)).alias("n_inv"))
    r = r.join(inv, "id", "left")
    return r.select("id", F.when(F.col("pending").isNull(), "no_encontrada").otherwise("rechazada").alias("resultado"),
                    F.when(F.col("pending").isNotNull(), F.coalesce("n_inv", F.lit(0))).otherwise(0)
                    .cast("bigint").alias("inventario_borrado"))


QUERIES = {
    "inventory_admission": inventory_admission,
    "custom_item_submit": custom_item_submit,
    "inventory_patch": inventory_patch,
    "inventory_patch_outcome": inventory_patch_outcome,
    "inventory_delete": inventory_delete,
    "inventory_delete_products": inventory_delete_products,
    "catalog_create": catalog_create,
    "catalog_patch": catalog_patch,
    "catalog_approve": catalog_approve,
    "catalog_reject": catalog_reject,
}

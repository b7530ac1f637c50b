"""New snapshots of the change-set jobs' tables.

Each job decides its requests (``changes_*``) and gives here the tables that
it changes, whole: old rows as they were, changed and new rows, without those
deleted. Refused requests leave no trace in them. ``JOBS`` maps a job to its
tables; ``sources.commits`` writes a job's tables as one commit.

New rows have ids that follow from their business key, so that a rerun gives
the same ids: the SHA-256 as text, or 60 bits of it for tables with integer
ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.functions.formats import money
from vendorlytics.plans import changes_accounts as accounts
from vendorlytics.plans import changes_inventory as inventory
from vendorlytics.session import materialize
from vendorlytics.sources.requests import own_item_requests, sku_chain_requests, sku_move_requests, slug_requests
from vendorlytics.sources.tables import MONEY, Tables


def row_id(table: DataFrame, *keys: Column) -> Column:
    """Id of a new row of ``table``, of the type of its ids."""
    digest = F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256)
    if isinstance(table.schema["id"].dataType, T.StringType):
        return digest
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def grown(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with new rows; columns that ``rows`` lacks are NULL."""
    cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in table.schema.fields]
    return table.unionByName(rows.select(*cols))


def admitted_inventory(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None) -> dict[str, DataFrame]:
    """W7."""
    old = snapshot if snapshot is not None else t.inventory()
    ok = inventory.admit_inventory(t, req, old).where("resultado = 'ok'")
    return {"inventory": grown(old, ok.withColumn("id", row_id(old, F.col("vendedor_id"), F.col("producto_maestro_id"))))}


def custom_items(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None) -> dict[str, DataFrame]:
    """A pending product of the vendor's brand without a category, and
    the vendor's inventory row of it."""
    products, old = t.products(), snapshot if snapshot is not None else t.inventory()
    ok = inventory.submit_custom_items(t, req, old).where("resultado = 'ok'")
    brand = t.users().select(F.col("id").alias("vendedor_id"), "marca_id")
    ok = ok.drop("id", "marca_id").join(brand, "vendedor_id", "left").withColumn("producto_maestro_id", row_id(products, F.col("sku")))
    image = F.col("imagen_url") if "imagen_url" in ok.columns else F.lit(None).cast("string")
    new = ok.select(F.col("producto_maestro_id").alias("id"), "sku", "nombre", F.when(image != "", image).alias("ruta_imagen"),
                    F.col("precio_personalizado").alias("precio_sugerido"), "marca_id", F.lit(False).alias("estado"),
                    F.col("vendedor_id").alias("creado_por"))
    held = ok.withColumn("id", row_id(old, F.col("vendedor_id"), F.col("producto_maestro_id")))
    return {"products": grown(products, new), "inventory": grown(old, held)}


def patched_inventory(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """W9."""
    return {"inventory": inventory.patch_inventory(t, req, t.inventory())[1]}


def deleted_inventory(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None) -> dict[str, DataFrame]:
    """The inventory rows go, and products that nobody holds any more."""
    old = snapshot if snapshot is not None else t.inventory()
    _, left, gone = inventory.delete_inventory(t, req, old)
    return {"inventory": left, "products": t.products().join(gone.select("id"), "id", "left_anti")}


def store_settings(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """Slug and phone of the last accepted request, name and settings as
    last sent."""
    done = accounts.apply_store_settings(t, req).where("resultado = 'ok'")
    users, seq = t.users(), F.col("seq")
    last = {c: F.max_by(c, seq) for c in ("store_slug", "telefono") if c in users.columns}
    last |= {c: F.max_by(c, F.when(F.col(c).isNotNull(), seq)) for c in ("store_name", "personalizacion") if c in users.columns and c in done.columns}
    edits = done.groupBy("id").agg(*[e.alias(f"n_{c}") for c, e in last.items()])
    j = users.join(edits, "id", "left")  # an accepted slug and phone are never NULL
    return {"users": j.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in last else F.col(c) for c in users.columns])}


def created_products(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """Approved from the start."""
    old = t.products()
    ok = inventory.create_catalog_items(t, req).where("resultado = 'ok'")
    return {"products": grown(old, ok.withColumn("id", row_id(old, F.col("sku"))).withColumn("estado", F.lit(True)))}


def patched_products(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """W13."""
    return {"products": inventory.patched_catalog(t, materialize(inventory.decide_patches(t, req), "patches"))}


def approved_products(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """W14."""
    done = inventory.catalog_approve(t, req).where("resultado = 'aprobada'").select("id").distinct().withColumn("hit", F.lit(True))
    old = t.products()
    return {"products": old.join(done, "id", "left").withColumn("estado", F.coalesce("hit", "estado")).select(*old.columns)}


def rejected_products(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pending products go, and all inventory rows of them."""
    gone = inventory.catalog_reject(t, req).where("resultado = 'rechazada'").select("id").distinct()
    return {"products": t.products().join(gone, "id", "left_anti"),
            "inventory": t.inventory().join(gone.withColumnRenamed("id", "producto_maestro_id"), "producto_maestro_id", "left_anti")
            .select(*t.inventory().columns)}


def _accounts(t: Tables, ok: DataFrame) -> dict[str, DataFrame]:
    users, roles = t.users(), t.roles()
    ok = ok.withColumn("id", row_id(users, F.col("email")))
    return {"users": grown(users, ok), "roles": grown(roles, ok.withColumn("usuario_id", F.col("id")))}


def registered_users(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """W16, self sign-up: a pending account of brand 1, role 2."""
    ok = accounts.decide_registrations(t, req).where("resultado = 'ok'")
    return _accounts(t, ok.select(F.trim("nombre").alias("nombre"), F.col("correo").alias("email"), F.lit(1).alias("marca_id"),
                                  F.lit(2).alias("rol_id"), F.lit("pendiente").alias("suscripcion_estado")))


def created_users(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """W16, by an admin."""
    ok = accounts.decide_admin_users(t, req).where("resultado = 'ok'")
    return _accounts(t, ok.select("nombre", "email", F.when(F.col("rol_id") != 1, F.col("rol_id") - 1).alias("marca_id"), "rol_id"))


def admitted_clients(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None) -> dict[str, DataFrame]:
    """A client without a balance; settings {} unless sent."""
    old = snapshot if snapshot is not None else t.clients()
    ok = accounts.decide_clients(t, req, old).where("resultado = 'ok'")
    new = ok.withColumn("id", row_id(old, F.col("vendedor_id"), F.col("nombre"), F.col("seq"))) \
        .withColumn("saldo_pendiente", F.lit(0).cast(MONEY)).withColumn("detalles", F.coalesce("detalles", F.lit("{}")))
    return {"clients": grown(old, new)}


def deleted_clients(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """The client goes, her sales stay without her."""
    gone = accounts.client_delete(t, req).where("resultado = 'eliminada'").select("id").distinct()
    sales = t.sales()
    unlinked = sales.join(gone.select(F.col("id").alias("clienta_id"), F.lit(True).alias("gone")), "clienta_id", "left")
    return {"clients": t.clients().join(gone, "id", "left_anti"),
            "sales": unlinked.withColumn("clienta_id", F.when(F.col("gone").isNull(), F.col("clienta_id"))).select(*sales.columns)}


def subscribed(t: Tables, req: DataFrame | None = None) -> dict[str, DataFrame]:
    """W21."""
    old = t.push()
    ok = accounts.push_subscribe(t, req).where("resultado = 'insertada'")
    return {"push": grown(old, ok.select(row_id(old, F.col("vendedor_id"), F.col("endpoint")).alias("id"), "vendedor_id",
                                         F.to_json(F.struct("endpoint")).alias("subscription")))}


JOBS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "inventory_admission": admitted_inventory, "custom_item_submit": custom_items, "inventory_patch": patched_inventory,
    "inventory_delete": deleted_inventory, "store_settings_apply": store_settings, "catalog_create": created_products,
    "catalog_patch": patched_products, "catalog_approve": approved_products, "catalog_reject": rejected_products,
    "user_register": registered_users, "user_create": created_users, "client_admission": admitted_clients,
    "client_delete": deleted_clients, "push_subscribe": subscribed,
}


def _products(df: DataFrame) -> DataFrame:
    return df.select("id", "sku", "nombre", "descripcion", money("precio_sugerido").alias("precio_sugerido"), "ruta_imagen", "categoria_id",
                     "marca_id", "estado", "creado_por", "skus_anteriores")


def _inventory(df: DataFrame) -> DataFrame:
    return df.select("id", "vendedor_id", "producto_maestro_id", "stock", money("precio_personalizado").alias("precio_personalizado"))


def _users(df: DataFrame) -> DataFrame:
    return df.select("id", "nombre", "email", "marca_id", "suscripcion_estado", "store_slug", "personalizacion")


def _clients(df: DataFrame) -> DataFrame:
    return df.select("id", "vendedor_id", "nombre", money("saldo_pendiente").alias("saldo_pendiente"), "fecha_proximo_pago")


def _none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


# Fixture: admissions start from empty tables (vendors hold more than the
# quota already); own items and SKU moves have requests with every outcome.
QUERIES = {
    "inventory_admission_table": lambda t: _inventory(admitted_inventory(t, snapshot=_none(t.inventory()))["inventory"]),
    "custom_item_outcome": lambda t: inventory.submit_custom_items(t, own_item_requests(t), _none(t.inventory()), seq=["seq"])
    .select("seq", "vendedor_id", "sku", "resultado"),
    "custom_item_products_table": lambda t: _products(custom_items(t, own_item_requests(t), _none(t.inventory()))["products"]),
    "custom_item_inventory_table": lambda t: _inventory(custom_items(t, own_item_requests(t), _none(t.inventory()))["inventory"]),
    "store_settings_users_table": lambda t: _users(store_settings(t)["users"]),
    "catalog_create_table": lambda t: _products(created_products(t)["products"]),
    "store_settings_repeats": lambda t: accounts.apply_store_settings(t, slug_requests(t)).select("id", "seq", "resultado", "store_slug"),
    "store_settings_repeats_table": lambda t: _users(store_settings(t, slug_requests(t))["users"]),
    "catalog_move_outcome": lambda t: inventory.patch_catalog(t, sku_move_requests(t)).select("id", "resultado", "sku"),
    "catalog_repeats_outcome": lambda t: inventory.decide_patches(t, sku_chain_requests(t)).select("seq", "id", "sku", "resultado"),
    "catalog_repeats_table": lambda t: _products(patched_products(t, sku_chain_requests(t))["products"]),
    "catalog_patch_table": lambda t: _products(patched_products(t, sku_move_requests(t))["products"]),
    "catalog_approve_table": lambda t: _products(approved_products(t)["products"]),
    "catalog_reject_table": lambda t: _products(rejected_products(t)["products"]),
    "catalog_reject_inventory_table": lambda t: _inventory(rejected_products(t)["inventory"]),
    "user_register_table": lambda t: _users(registered_users(t)["users"]),
    "user_register_roles_table": lambda t: registered_users(t)["roles"],
    "user_create_table": lambda t: _users(created_users(t)["users"]),
    "user_create_roles_table": lambda t: created_users(t)["roles"],
    "client_admission_table": lambda t: _clients(admitted_clients(t, snapshot=_none(t.clients()))["clients"]),
    "client_delete_table": lambda t: _clients(deleted_clients(t)["clients"]),
    "client_delete_sales_table": lambda t: deleted_clients(t)["sales"].select("id", "vendedor_id", "clienta_id"),
    "push_subscribe_table": lambda t: subscribed(t)["push"],
}

"""Migration and repair jobs: dedup, constraint report, schema
evolution, embedded-image extraction.

Dedup uses an aggregate + equi-join instead of ``MIN(id) OVER (PARTITION BY
...)``: the aggregate is combined map-side, and a hot (vendor, product)
group is split by AQE's skew join rather than buffered in one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.sources.tables import Tables

KEY = ["vendedor_id", "producto_maestro_id"]

# Fixed values (migration scripts).
LEGACY_RENAMES = {
    "usuarios": {"conekta_customer_id": "stripe_customer_id",
                 "conekta_subscription_id": "stripe_subscription_id"},
    "pagos": {"conekta_order_id": "stripe_session_id",
              "conekta_checkout_id": "stripe_payment_intent_id"},
}
DROPPED = {"usuarios": ["activo"], "pagos": []}
ADDED_DEFAULTS = {"usuarios": {"personalizacion": "{}", "suscripcion_plan": "ninguno"}, "pagos": {}}
DATA_URI = r"^data:(image/\w+);base64,(.+)$"
FOLDERS = {"catalogo_maestro": "migration/joyas", "usuarios": "migration/logos"}
PUBLIC_URL = "https://assets.example"


# -- M1-M4 ----------------------------------------------------------------
def survivors(inv_raw: DataFrame) -> DataFrame:
    """(vendor, product) -> surviving id (the smallest) and summed stock."""
    return inv_raw.groupBy(*KEY).agg(
        F.min("id").alias("superviviente"),
        F.sum(F.coalesce(F.col("stock"), F.lit(0))).cast("int").alias("stock"))


def dedup_survivors(t: Tables) -> DataFrame:
    """M1: every raw inventory row with its group's survivor id."""
    raw = t.inventory_raw()
    s = survivors(raw).select(*KEY, "superviviente")
    return raw.join(s, KEY).select("id", *KEY, "superviviente")


def sales_on_raw_inventory(t: Tables) -> DataFrame:
    """Fixture for M2: each sale points to the raw row with its own id."""
    return t.sales().select("id", F.col("id").alias("inventario_id"))


def dedup_repoint_sales(t: Tables, sales: DataFrame | None = None) -> DataFrame:
    """M2: sales of duplicate rows now point to the survivor."""
    s = sales if sales is not None else sales_on_raw_inventory(t)
    m = dedup_survivors(t).where(F.col("id") != F.col("superviviente")) \
        .select(F.col("id").alias("inventario_id"), "superviviente")
    return (s.join(m, "inventario_id", "left")
            .select("id", F.coalesce("superviviente", "inventario_id").alias("inventario_id")))


def dedup_stock_sum(t: Tables) -> DataFrame:
    """M3: survivor stock = sum of COALESCE(stock, 0) over its group."""
    return survivors(t.inventory_raw()).select("superviviente", "stock")


def dedup_inventory(t: Tables) -> DataFrame:
    """M4: the deduplicated inventory (unique per vendor and product): the
    surviving rows with all their columns, stock replaced by the sum."""
    raw = t.inventory_raw()
    total = survivors(raw).select(F.col("superviviente").alias("id"), "stock")
    return raw.drop("stock").join(total, "id").select(*raw.columns)


# -- M5 -------------------------------------------------------------------
def _keys(df: DataFrame, *checks) -> DataFrame:
    """One pass over ``df``: an entry for each check (number of the
    constraint, whether the row is a parent, key); rows whose key is NULL have
    none. A number is all of a name that the aggregation holds per key."""
    entries = F.array(*[F.struct(F.lit(NUMBERS[name]).cast("tinyint").alias("n_restriccion"), F.lit(parent).alias("madre"),
                                 key.cast("string").alias("clave")) for name, parent, key in checks])
    return df.select(F.explode(entries).alias("e")).select("e.*").where("clave IS NOT NULL")


def _unique(name: str, *cols):
    key = F.col(cols[0]) if len(cols) == 1 else F.concat(*[x for c in cols for x in (F.col(c).cast("string"), F.lit("|"))])
    return name, False, key


def _child(name: str, col: str):
    return name, False, F.col(col)


def _parent(name: str, col: str = "id"):
    return name, True, F.col(col)


def _not_null(name: str, col: str):
    return name, False, F.when(F.col(col).isNull(), F.lit(""))


def constraint_violations(t: Tables) -> DataFrame:
    """M5: one row per constraint with the number of violations.

    Every table is read once and gives its keys for all constraints that it
    takes part in; one aggregation by (constraint, key), combined before the
    shuffle, then says which keys are there twice, which children have no
    parent, and how many values are missing. As in the reference's database,
    NULLs are no duplicates and refer to nothing."""
    parts = [
        _keys(t.inventory_raw(), _unique("inventario_vendedor_vendedor_producto_unico", *KEY),
              _child("inventario_producto_fk", "producto_maestro_id"), _not_null("inventario_stock_not_null", "stock")),
        _keys(t.products(), _unique("catalogo_maestro_sku_unico", "sku"), _child("catalogo_categoria_fk", "categoria_id"),
              _parent("inventario_producto_fk")),
        _keys(t.users().withColumn("correo", F.lower("email")), _unique("usuarios_email_unico", "correo"),
              _unique("usuarios_store_slug_unico", "store_slug")),
        _keys(t.sales(), _child("ventas_inventario_fk", "inventario_id"), _child("ventas_clienta_fk", "clienta_id"), _parent("abonos_venta_fk")),
        _keys(t.inventory(), _parent("ventas_inventario_fk")),
        _keys(t.clients(), _parent("ventas_clienta_fk"), _not_null("clientas_nombre_not_null", "nombre")),
        _keys(t.categories(), _parent("catalogo_categoria_fk")),
        _keys(t.instalments(), _child("abonos_venta_fk", "venta_id"), _not_null("abonos_monto_not_null", "monto")),
    ]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)

    by_key = keys.groupBy("n_restriccion", "clave").agg(F.count_if(~F.col("madre")).alias("n"), F.max("madre").alias("madre"))
    unique = F.col("n_restriccion").isin([NUMBERS[name] for name, kind in CONSTRAINTS if kind == "unique"])
    found = by_key.groupBy("n_restriccion").agg(F.sum(
        F.when(unique, (F.col("n") > 1).cast("bigint")).when(F.col("madre"), 0).otherwise(F.col("n"))).alias("violaciones"))
    names = t.spark.createDataFrame([(NUMBERS[name], name, kind) for name, kind in CONSTRAINTS], "n_restriccion tinyint, restriccion string, tipo string")
    return names.join(found, "n_restriccion", "left").select("restriccion", "tipo", F.coalesce("violaciones", F.lit(0)).cast("bigint").alias("violaciones"))


# Every constraint has its row, also one without keys.
CONSTRAINTS = [
    ("inventario_vendedor_vendedor_producto_unico", "unique"), ("catalogo_maestro_sku_unico", "unique"), ("usuarios_email_unico", "unique"),
    ("usuarios_store_slug_unico", "unique"), ("ventas_inventario_fk", "foreign_key"), ("ventas_clienta_fk", "foreign_key"),
    ("abonos_venta_fk", "foreign_key"), ("catalogo_categoria_fk", "foreign_key"), ("inventario_producto_fk", "foreign_key"),
    ("clientas_nombre_not_null", "not_null"), ("inventario_stock_not_null", "not_null"), ("abonos_monto_not_null", "not_null")]
NUMBERS = {name: i for i, (name, _) in enumerate(CONSTRAINTS)}


# -- M6 -------------------------------------------------------------------
def legacy_users(t: Tables) -> DataFrame:
    """Fixture: the users table before the migrations (legacy billing ids,
    ``activo`` flag, no personalizacion / plan columns)."""
    u = t.users()
    return u.select("id", "nombre", "email", "marca_id", "suscripcion_estado", "suscripcion_fin", "store_slug",
                    F.col("stripe_customer_id").alias("conekta_customer_id"),
                    F.col("stripe_subscription_id").alias("conekta_subscription_id"),
                    (F.col("suscripcion_estado") != "pendiente").alias("activo"))


def evolve(df: DataFrame, table: str) -> DataFrame:
    """Apply the schema migrations to a snapshot of ``table``: rename the
    legacy billing columns and reset them to NULL, drop obsolete columns,
    add missing columns with their defaults (ADD COLUMN IF NOT EXISTS)."""
    renames = {k: v for k, v in LEGACY_RENAMES[table].items() if k in df.columns}
    df = df.withColumnsRenamed(renames)
    df = df.withColumns({new: F.lit(None).cast("string") for new in renames.values()})
    df = df.drop(*DROPPED[table])
    missing = {c: F.lit(v) for c, v in ADDED_DEFAULTS[table].items() if c not in df.columns}
    return df.withColumns(missing)


def schema_evolve(t: Tables) -> DataFrame:
    """M6 on the users table."""
    return evolve(legacy_users(t), "usuarios")


# -- M7 / M8 --------------------------------------------------------------
def _image_sources(t: Tables) -> DataFrame:
    p = t.products().select(F.lit("catalogo_maestro").alias("tabla"), "id", "nombre",
                            F.col("ruta_imagen").alias("valor"))
    u = t.users().select(F.lit("usuarios").alias("tabla"), "id", "nombre",
                         F.get_json_object("personalizacion", "$.logo").alias("valor"))
    return p.unionByName(u)


def data_uri_audit(t: Tables) -> DataFrame:
    """M7: rows still holding embedded base64 images (catalog image, logo)."""
    s = _image_sources(t).where(F.col("valor").like("data:image%"))
    preview = F.when(F.col("tabla") == "catalogo_maestro", F.left("valor", F.lit(50))).otherwise(F.col("valor"))
    return s.select("tabla", "id", "nombre", preview.alias("preview"))


def data_uri_counts(t: Tables) -> DataFrame:
    """M7 check: embedded images left per table (0 after M8)."""
    s = _image_sources(t)
    return s.groupBy("tabla").agg(F.count_if(F.col("valor").like("data:image%")).alias("pendientes"))


def data_uri_objects(t: Tables, public_url: str = PUBLIC_URL) -> DataFrame:
    """M8: parse each embedded image, decode it, name it by content hash.

    Columns: tabla, id, mime, bytes, storage_key, url. The key uses the
    SHA-256 of the bytes instead of a random id, so reruns are idempotent.
    """
    s = _image_sources(t).where(F.col("valor").like("data:image%"))
    mime = F.regexp_extract("valor", DATA_URI, 1)
    payload = F.regexp_extract("valor", DATA_URI, 2)
    parsed = s.where(F.col("valor").rlike(DATA_URI)).select("tabla", "id", mime.alias("mime"),
                                                             F.try_to_binary(payload, F.lit("base64")).alias("bytes"))
    ext = F.regexp_replace(F.split_part("mime", F.lit("/"), F.lit(2)), "jpeg", "jpg")
    folder = F.when(F.col("tabla") == "catalogo_maestro", F.lit(FOLDERS["catalogo_maestro"])) \
        .otherwise(F.lit(FOLDERS["usuarios"]))
    key = F.concat(folder, F.lit("/"), F.sha2("bytes", 256), F.lit("."), ext)
    return parsed.withColumn("storage_key", key) \
        .withColumn("url", F.concat(F.lit(public_url.rstrip("/") + "/"), F.col("storage_key")))


def merge_json_key(json_col, key: str, value) -> F.Column:
    """Shallow ``jsonb || jsonb_build_object(key, value)``: replace or add
    one top-level key, other keys and nested values unchanged."""
    m = F.from_json(json_col, "map<string,variant>")
    kept = F.map_filter(m, lambda k, v: k != F.lit(key))
    added = F.create_map(F.lit(key), value.cast("variant"))
    return F.to_json(F.map_concat(kept, added))


def data_uri_extract(t: Tables, public_url: str = PUBLIC_URL) -> DataFrame:
    """M8 result: per migrated row, the object written and the new value."""
    o = data_uri_objects(t, public_url)
    u = t.users().select(F.lit("usuarios").alias("tabla"), "id", "personalizacion")
    j = o.join(u, ["tabla", "id"], "left")
    merged = merge_json_key(F.col("personalizacion"), "logo", F.col("url"))
    new_value = F.when(F.col("tabla") == "usuarios", merged).otherwise(F.col("url"))
    return j.select("tabla", "id", "mime", F.octet_length("bytes").alias("n_bytes"), "storage_key", "url",
                    new_value.alias("nuevo_valor"))


def data_uri_extract_check(t: Tables) -> DataFrame:
    """M8 projected for the SQL oracle (JSON compared through its fields)."""
    d = data_uri_extract(t)
    return d.select("tabla", "id", "mime", "n_bytes", "storage_key", "url",
                    F.when(F.col("tabla") == "usuarios", F.get_json_object("nuevo_valor", "$.logo"))
                    .otherwise(F.col("nuevo_valor")).alias("logo"),
                    F.get_json_object("nuevo_valor", "$.accent_color").alias("accent_color"),
                    F.get_json_object("nuevo_valor", "$.social.instagram").alias("instagram"))


def write_objects(objects: DataFrame, path: str) -> None:
    """Sink for M8: (storage_key, mime, bytes) as parquet, no network upload."""
    objects.select("storage_key", "mime", "bytes").write.mode("overwrite").parquet(path)


QUERIES = {
    "dedup_survivors": dedup_survivors,
    "dedup_repoint_sales": dedup_repoint_sales,
    "dedup_stock_sum": dedup_stock_sum,
    "dedup_inventory": dedup_inventory,
    "constraint_violations": constraint_violations,
    "schema_evolve": schema_evolve,
    "data_uri_audit": data_uri_audit,
    "data_uri_counts": data_uri_counts,
    "data_uri_extract": data_uri_extract_check,
}

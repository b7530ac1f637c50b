"""DuckDB oracle SQL for the read queries (with the registered parameters)."""

from vendorlytics.plans.reads import DEFAULT_DESCRIPTION, PUSH_BODY, PUSH_TITLE, PUSH_URL

_SP = """v_sales v JOIN v_inventory iv ON v.inventario_id = iv.id
 JOIN v_products cm ON iv.producto_maestro_id = cm.id"""

_CAT_COLS = """cm.id, cm.sku, CAST(to_json(cm.skus_anteriores) AS VARCHAR) AS skus_anteriores, cm.nombre, cm.descripcion, cm.ruta_imagen,
 CAST(cm.precio_sugerido AS DOUBLE) AS precio_sugerido, cm.marca_id, cm.categoria_id"""

# The catalog with its category names.
_SHELF = """shelf AS (SELECT p.*, k.nombre AS categoria FROM v_products p LEFT JOIN v_categories k ON k.id = p.categoria_id)"""
_SHELF_COLS = """shelf.id, shelf.sku, CAST(to_json(shelf.skus_anteriores) AS VARCHAR) AS skus_anteriores, shelf.nombre, shelf.descripcion,
 shelf.ruta_imagen, CAST(shelf.precio_sugerido AS DOUBLE) AS precio_sugerido, shelf.marca_id, shelf.categoria_id"""

_DUE = "saldo_pendiente > 0 AND fecha_proximo_pago <= DATE '2001-08-01'"


def _profile(table: str, view: str, cols: list[str]) -> str:
    parts = [f"SELECT '{table}' AS table_name, '{c}' AS column_name, {i} AS ordinal_position, "
             f"COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(DISTINCT {c}) AS distinct_count FROM {view}"
             for i, c in enumerate(cols, 1)]
    return "\nUNION ALL ".join(parts)


_PROFILE_COLS = {
    "users": ("v_users", ["id", "nombre", "email", "marca_id", "suscripcion_plan", "suscripcion_estado",
                          "suscripcion_fin", "store_slug", "personalizacion", "stripe_customer_id",
                          "stripe_subscription_id"]),
    "roles": ("v_roles", ["usuario_id", "rol_id"]),
    "categories": ("v_categories", ["id", "nombre"]),
    "products": ("v_products", ["id", "sku", "nombre", "descripcion", "precio_sugerido", "ruta_imagen",
                                "categoria_id", "marca_id", "estado", "creado_por", "skus_anteriores"]),
    "inventory": ("v_inventory", ["id", "vendedor_id", "producto_maestro_id", "stock", "precio_personalizado"]),
    "sales": ("v_sales", ["id", "vendedor_id", "inventario_id", "cantidad", "precio_total", "fecha", "clienta_id",
                          "estado_pago", "saldo_restante"]),
    "clients": ("v_clients", ["id", "vendedor_id", "nombre", "saldo_pendiente", "fecha_proximo_pago"]),
    "push": ("v_push", ["id", "vendedor_id", "subscription"]),
    "payments": ("v_payments", ["id", "usuario_id", "tipo", "monto", "estado", "creado_en"]),
}

ORACLES = {
    "schema_profile": "\nUNION ALL ".join(_profile(k, v, c) for k, (v, c) in _PROFILE_COLS.items()),

    "sales_export": f"""SELECT v.vendedor_id, v.id AS venta_id, v.cantidad, CAST(v.precio_total AS DOUBLE) AS precio_total,
 v.fecha, cm.nombre AS producto_nombre, cm.sku FROM {_SP}""",

    "sales_history_page": f"""SELECT vendedor_id, ord, venta_id, cantidad, precio_total, fecha, producto_nombre, sku,
 ruta_imagen, total_count, CAST(ceil(total_count / 50.0) AS INTEGER) AS total_pages FROM (
 SELECT v.vendedor_id, v.id AS venta_id, v.cantidad, CAST(v.precio_total AS DOUBLE) AS precio_total, v.fecha,
  cm.nombre AS producto_nombre, cm.sku, cm.ruta_imagen,
  CAST(row_number() OVER (PARTITION BY v.vendedor_id ORDER BY v.fecha DESC, v.id DESC) AS INTEGER) AS ord,
  COUNT(*) OVER (PARTITION BY v.vendedor_id) AS total_count
 FROM {_SP}) WHERE ord BETWEEN 51 AND 100""",

    "catalog_search": f"""WITH hits AS (SELECT * FROM v_products cm WHERE cm.estado = true
  AND (LOWER(cm.nombre) LIKE '%old-1%' OR LOWER(cm.sku) LIKE '%old-1%'
       OR COALESCE(list_bool_or(list_transform(cm.skus_anteriores, lambda s: LOWER(s) LIKE '%old-1%')), false))
  AND cm.precio_sugerido >= 100.0),
 tot AS (SELECT COUNT(*) AS n FROM hits),
 page AS (SELECT * FROM hits ORDER BY precio_sugerido DESC NULLS LAST, nombre, id LIMIT 30 OFFSET 30)
SELECT {_CAT_COLS}, c.nombre AS categoria, tot.n AS total_count, CAST(ceil(tot.n / 30.0) AS INTEGER) AS total_pages
FROM page cm LEFT JOIN v_categories c ON cm.categoria_id = c.id, tot""",

    "catalog_not_in_inventory": f"""WITH {_SHELF}
SELECT seller.id AS vendedor_id, {_SHELF_COLS}, shelf.categoria
FROM shelf, v_users seller
WHERE shelf.estado AND shelf.marca_id = seller.marca_id AND NOT EXISTS (
  SELECT 1 FROM v_inventory own WHERE own.vendedor_id = seller.id AND own.producto_maestro_id = shelf.id)""",

    "vendor_inventory": f"""WITH {_SHELF},
 owned AS (SELECT id AS inventario_id, vendedor_id, producto_maestro_id, stock, CAST(precio_personalizado AS DOUBLE) AS precio_personalizado
  FROM v_inventory)
SELECT owned.*, shelf.sku, CAST(to_json(shelf.skus_anteriores) AS VARCHAR) AS skus_anteriores, shelf.nombre, shelf.descripcion,
 COALESCE(CAST(shelf.precio_sugerido AS DOUBLE), 0.0) AS precio_sugerido, shelf.ruta_imagen, shelf.categoria_id, shelf.categoria,
 shelf.estado, COALESCE(shelf.creado_por = owned.vendedor_id, false) AS es_custom
FROM shelf, owned WHERE shelf.id = owned.producto_maestro_id""",

    "storefront": f"""WITH {_SHELF},
 shop AS (SELECT id, store_slug, nombre, personalizacion FROM v_users),
 goods AS (SELECT * FROM v_inventory WHERE stock > 0)
SELECT shop.store_slug, shop.nombre AS vendedor_nombre, COALESCE(shop.personalizacion, '{{}}') AS personalizacion,
 goods.id AS inventario_id, goods.stock, CAST(goods.precio_personalizado AS DOUBLE) AS precio_personalizado,
 shelf.id AS producto_maestro_id, shelf.nombre, shelf.sku, COALESCE(shelf.descripcion, '{DEFAULT_DESCRIPTION}') AS descripcion,
 shelf.ruta_imagen, COALESCE(CAST(shelf.precio_sugerido AS DOUBLE), 0.0) AS precio_sugerido, shelf.categoria_id, shelf.categoria
FROM goods, shelf, shop WHERE goods.producto_maestro_id = shelf.id AND goods.vendedor_id = shop.id""",

    "categories_sorted": "SELECT id, nombre FROM v_categories ORDER BY nombre ASC",

    "pending_items": f"""WITH {_SHELF},
 author AS (SELECT id AS creado_por, nombre AS creador_nombre, email AS creador_email FROM v_users)
SELECT id, sku, nombre, descripcion, ruta_imagen, CAST(precio_sugerido AS DOUBLE) AS precio_sugerido, categoria_id, marca_id,
 estado, creado_por, creador_nombre, creador_email, categoria
FROM (SELECT * FROM shelf WHERE NOT estado) LEFT JOIN author USING (creado_por)""",

    "client_list": """SELECT vendedor_id, id, nombre, CAST(saldo_pendiente AS DOUBLE) AS saldo_pendiente, fecha_proximo_pago
FROM v_clients""",

    "client_statement": f"""SELECT c.id AS clienta_id, c.vendedor_id, c.nombre AS clienta_nombre,
 CAST(c.saldo_pendiente AS DOUBLE) AS saldo_pendiente, c.fecha_proximo_pago,
 h.venta_id, h.fecha, h.precio_total, h.estado_pago, h.saldo_restante, h.producto
FROM v_clients c LEFT JOIN (SELECT v.clienta_id, v.id AS venta_id, v.fecha, CAST(v.precio_total AS DOUBLE) AS precio_total,
  v.estado_pago, CAST(v.saldo_restante AS DOUBLE) AS saldo_restante, cm.nombre AS producto FROM {_SP}) h
ON h.clienta_id = c.id""",

    "user_profile": """SELECT u.id, u.nombre, u.email, u.marca_id, u.suscripcion_fin, u.suscripcion_estado,
 u.suscripcion_plan, ur.rol_id AS rol, u.store_slug, u.personalizacion
FROM v_users u LEFT JOIN v_roles ur ON u.id = ur.usuario_id""",

    "access_status": """SELECT id, email, suscripcion_plan, suscripcion_estado, suscripcion_fin,
 CASE WHEN suscripcion_estado = 'pendiente' THEN 'PENDING_SUBSCRIPTION'
      WHEN suscripcion_fin < DATE '2001-08-01' THEN 'EXPIRED_SUBSCRIPTION' ELSE 'OK' END AS acceso
FROM v_users""",

    "access_locked_by_plan": """SELECT suscripcion_plan, acceso, COUNT(*) AS cuentas FROM (
 SELECT suscripcion_plan, CASE WHEN suscripcion_estado = 'pendiente' THEN 'PENDING_SUBSCRIPTION'
      WHEN suscripcion_fin < DATE '2001-08-01' THEN 'EXPIRED_SUBSCRIPTION' ELSE 'OK' END AS acceso FROM v_users)
WHERE acceso <> 'OK' GROUP BY 1, 2""",

    "payment_funnel": """WITH p AS (SELECT estado, tipo, CASE WHEN id % 10 = 0 THEN 'bad-' || CAST(id AS VARCHAR)
  ELSE substr(md5(CAST(id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(id AS VARCHAR)), 9, 4) || '-' ||
       substr(md5(CAST(id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(id AS VARCHAR)), 17, 4) || '-' ||
       substr(md5(CAST(id AS VARCHAR)), 21, 12) END AS tid FROM v_payments)
SELECT estado, tipo, regexp_matches(tid, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$', 'i') AS id_valido,
 COUNT(*) AS pagos FROM p GROUP BY 1, 2, 3""",

    "duplicate_emails": """SELECT LOWER(TRIM(email)) AS email_key, COUNT(*) AS usuarios, MIN(id) AS primer_id,
 MAX(id) AS ultimo_id FROM v_users GROUP BY 1 HAVING COUNT(*) > 1""",

    "overdue_push_targets": f"""SELECT d.vendedor_id, p.id AS subscription_id,
 json_extract_string(p.subscription, '$.endpoint') AS endpoint, d.total_cobros,
 '{PUSH_TITLE}' AS title, replace('{PUSH_BODY}', '%d', CAST(d.total_cobros AS VARCHAR)) AS body, '{PUSH_URL}' AS url
FROM (SELECT vendedor_id, COUNT(id) AS total_cobros FROM v_clients WHERE {_DUE} GROUP BY 1) d
JOIN v_push p ON p.vendedor_id = d.vendedor_id""",

    "push_prune": """SELECT p.id, p.vendedor_id, p.subscription FROM v_push p
WHERE json_extract_string(p.subscription, '$.endpoint') NOT IN (
  SELECT 'https://push.example/' || CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 IN (1, 2))""",

    "manageable_subscription": """WITH s AS (SELECT 'cus_' || CAST(user_id AS VARCHAR) AS customer,
  json_extract_string(object, '$.id') AS subscription_id, event_id AS created,
  json_extract_string(object, '$.status') AS status FROM v_billing WHERE type = 'customer.subscription.updated'),
 listed AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY created DESC, subscription_id DESC) AS ord FROM s)
SELECT customer, arg_min(subscription_id, ord) AS subscription_id FROM listed
WHERE ord <= 20 AND status IN ('active', 'trialing', 'past_due', 'unpaid', 'paused') GROUP BY customer""",

    "checkout_routing": """WITH s AS (SELECT 'cus_' || CAST(user_id AS VARCHAR) AS customer,
  json_extract_string(object, '$.id') AS subscription_id, event_id AS created,
  json_extract_string(object, '$.status') AS status FROM v_billing WHERE type = 'customer.subscription.updated'),
 listed AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY created DESC, subscription_id DESC) AS ord FROM s),
 m AS (SELECT customer, arg_min(subscription_id, ord) AS sid FROM listed
       WHERE ord <= 20 AND status IN ('active', 'trialing', 'past_due', 'unpaid', 'paused') GROUP BY customer),
 j AS (SELECT u.id AS usuario_id, u.suscripcion_estado,
       (u.stripe_customer_id IS NOT NULL AND m.sid IS NOT NULL) AS portal
       FROM v_users u LEFT JOIN m ON m.customer = u.stripe_customer_id)
SELECT usuario_id, CASE WHEN portal THEN 'portal' ELSE 'checkout' END AS modo,
 CASE WHEN NOT portal THEN CASE WHEN suscripcion_estado = 'pendiente' THEN 'suscripcion_inicial' ELSE 'renovacion' END END AS tipo,
 CASE WHEN NOT portal THEN 29900 END AS monto, CASE WHEN NOT portal THEN 'pendiente' END AS estado,
 CASE WHEN NOT portal THEN 7 END AS trial_period_days FROM j""",
}

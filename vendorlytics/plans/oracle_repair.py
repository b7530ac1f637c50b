"""DuckDB oracle SQL for the repair jobs."""

_KEY = "(vendedor_id, producto_maestro_id)"
# One line per pair of vendor and product: the id that stays, the units of all.
_KEPT = """kept AS (SELECT vendedor_id, producto_maestro_id, min(id) AS keeper, CAST(COALESCE(sum(stock), 0) AS INTEGER) AS units
  FROM v_inventory_raw GROUP BY vendedor_id, producto_maestro_id)"""

_SRC = """src AS (SELECT 'catalogo_maestro' AS tabla, id, nombre, ruta_imagen AS valor FROM v_products
 UNION ALL SELECT 'usuarios', id, nombre, json_extract_string(personalizacion, '$.logo') FROM v_users)"""

_OBJ = f"""{_SRC}, obj AS (SELECT tabla, id,
  regexp_extract(valor, '^data:(image/\\w+);base64,(.+)$', 1) AS mime,
  from_base64(regexp_extract(valor, '^data:(image/\\w+);base64,(.+)$', 2)) AS bytes FROM src
  WHERE valor LIKE 'data:image%' AND regexp_matches(valor, '^data:(image/\\w+);base64,(.+)$')),
 keyed AS (SELECT *, CASE WHEN tabla = 'catalogo_maestro' THEN 'migration/joyas' ELSE 'migration/logos' END || '/' ||
  sha256(bytes) || '.' || replace(split_part(mime, '/', 2), 'jpeg', 'jpg') AS storage_key FROM obj)"""


def _violations(name, kind, sql):
    return f"SELECT '{name}' AS restriccion, '{kind}' AS tipo, CAST(({sql}) AS BIGINT) AS violaciones"


ORACLES = {
    "dedup_survivors": f"""WITH {_KEPT}
SELECT r.id, vendedor_id, producto_maestro_id, keeper AS superviviente FROM v_inventory_raw r JOIN kept USING {_KEY}""",

    "dedup_repoint_sales": f"""WITH {_KEPT}, moved AS (SELECT r.id, keeper FROM v_inventory_raw r JOIN kept USING {_KEY})
SELECT v.id, COALESCE(moved.keeper, v.id) AS inventario_id FROM v_sales v LEFT JOIN moved ON moved.id = v.id""",

    "dedup_stock_sum": f"WITH {_KEPT} SELECT keeper AS superviviente, units AS stock FROM kept",

    "dedup_inventory": f"WITH {_KEPT} SELECT keeper AS id, vendedor_id, producto_maestro_id, units AS stock FROM kept",

    "constraint_violations": "\nUNION ALL ".join([
        _violations("inventario_vendedor_vendedor_producto_unico", "unique",
                    "SELECT COUNT(*) FROM (SELECT 1 FROM v_inventory_raw GROUP BY vendedor_id, producto_maestro_id "
                    "HAVING COUNT(*) > 1)"),
        _violations("catalogo_maestro_sku_unico", "unique",
                    "SELECT COUNT(*) FROM (SELECT 1 FROM v_products GROUP BY sku HAVING COUNT(*) > 1)"),
        _violations("usuarios_email_unico", "unique",
                    "SELECT COUNT(*) FROM (SELECT 1 FROM v_users GROUP BY LOWER(email) HAVING COUNT(*) > 1)"),
        _violations("usuarios_store_slug_unico", "unique",
                    "SELECT COUNT(*) FROM (SELECT 1 FROM v_users GROUP BY store_slug HAVING COUNT(*) > 1)"),
        _violations("ventas_inventario_fk", "foreign_key",
                    "SELECT COUNT(*) FROM v_sales v WHERE v.inventario_id IS NOT NULL AND NOT EXISTS "
                    "(SELECT 1 FROM v_inventory i WHERE i.id = v.inventario_id)"),
        _violations("ventas_clienta_fk", "foreign_key",
                    "SELECT COUNT(*) FROM v_sales v WHERE v.clienta_id IS NOT NULL AND NOT EXISTS "
                    "(SELECT 1 FROM v_clients c WHERE c.id = v.clienta_id)"),
        _violations("abonos_venta_fk", "foreign_key",
                    "SELECT COUNT(*) FROM v_instalments a WHERE a.venta_id IS NOT NULL AND a.venta_id NOT IN (SELECT id FROM v_sales)"),
        _violations("abonos_monto_not_null", "not_null", "SELECT COUNT(*) FROM v_instalments WHERE monto IS NULL"),
        _violations("catalogo_categoria_fk", "foreign_key",
                    "SELECT COUNT(*) FROM v_products p WHERE p.categoria_id IS NOT NULL AND NOT EXISTS "
                    "(SELECT 1 FROM v_categories c WHERE c.id = p.categoria_id)"),
        _violations("inventario_producto_fk", "foreign_key",
                    "SELECT COUNT(*) FROM v_inventory_raw r WHERE r.producto_maestro_id IS NOT NULL AND NOT EXISTS "
                    "(SELECT 1 FROM v_products p WHERE p.id = r.producto_maestro_id)"),
        _violations("clientas_nombre_not_null", "not_null", "SELECT COUNT(*) FROM v_clients WHERE nombre IS NULL"),
        _violations("inventario_stock_not_null", "not_null",
                    "SELECT COUNT(*) FROM v_inventory_raw WHERE stock IS NULL"),
    ]),

    "schema_evolve": """SELECT id, nombre, email, marca_id, suscripcion_estado, suscripcion_fin, store_slug,
 CAST(NULL AS VARCHAR) AS stripe_customer_id, CAST(NULL AS VARCHAR) AS stripe_subscription_id,
 '{}' AS personalizacion, 'ninguno' AS suscripcion_plan FROM v_users""",

    "data_uri_audit": """SELECT 'catalogo_maestro' AS tabla, id, nombre, LEFT(ruta_imagen, 50) AS preview FROM v_products
 WHERE ruta_imagen LIKE 'data:image%'
UNION ALL SELECT 'usuarios', id, nombre, json_extract_string(personalizacion, '$.logo') FROM v_users
 WHERE json_extract_string(personalizacion, '$.logo') LIKE 'data:image%'""",

    "data_uri_counts": f"""WITH {_SRC} SELECT tabla, COUNT(*) FILTER (WHERE valor LIKE 'data:image%') AS pendientes
FROM src GROUP BY tabla""",

    "data_uri_extract": f"""WITH {_OBJ}
SELECT k.tabla, k.id, k.mime, CAST(octet_length(k.bytes) AS INTEGER) AS n_bytes, k.storage_key,
 'https://assets.example/' || k.storage_key AS url,
 'https://assets.example/' || k.storage_key AS logo,
 CASE WHEN k.tabla = 'usuarios' THEN json_extract_string(u.personalizacion, '$.accent_color') END AS accent_color,
 CASE WHEN k.tabla = 'usuarios' THEN json_extract_string(u.personalizacion, '$.social.instagram') END AS instagram
FROM keyed k LEFT JOIN v_users u ON k.tabla = 'usuarios' AND u.id = k.id""",
}

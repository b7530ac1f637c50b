"""DuckDB oracles for the change-set jobs' new snapshots. W8 and the SKU moves
of W13 are sequential recursive CTEs (one request a step)."""

from vendorlytics.plans.oracle_changes_accounts import _CLIENTS, _SLUG, _STORE, _USERS
from vendorlytics.plans.oracle_changes_inventory import _ADMIT, _CREATE


def _id(*keys: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"('0x' || substr(sha256({text}), 1, 15))::BIGINT"


def _product(**new: str) -> str:
    """SELECT list of a product; columns not given are the old row's (p)."""
    cols = {c: f"p.{c}" for c in ("id", "sku", "nombre", "descripcion", "precio_sugerido", "ruta_imagen", "categoria_id", "marca_id", "estado",
                                  "creado_por", "skus_anteriores")} | new
    cols["precio_sugerido"] = f"CAST({cols['precio_sugerido']} AS DOUBLE)"
    cols["skus_anteriores"] = f"CAST(to_json({cols['skus_anteriores']}) AS VARCHAR)"
    return ", ".join(f"{e} AS {c}" for c, e in cols.items())


_ITEM = "id, vendedor_id, producto_maestro_id, stock, CAST(precio_personalizado AS DOUBLE) AS precio_personalizado"
_USER = "id, nombre, email, marca_id, suscripcion_estado, store_slug, personalizacion"

_OWN = """r AS (SELECT p_partkey AS seq, p_partkey % 7 AS v, CASE WHEN p_partkey % 97 <> 0 THEN p_name END AS nombre,
   CASE WHEN p_partkey % 50 = 0 THEN 'SKU-' || CAST(p_partkey AS VARCHAR) ELSE 'CUS-' || CAST(p_partkey % 600 AS VARCHAR) END AS sku,
   p_size AS stock, CAST(p_retailprice AS DECIMAL(18,2)) AS precio, COALESCE(u.suscripcion_plan, 'mini') = 'mini' AS limited, u.marca_id,
   row_number() OVER (ORDER BY p_partkey) AS rn FROM part LEFT JOIN v_users u ON u.id = p_partkey % 7),
 f(rn, taken, owners, res) AS (
   SELECT CAST(0 AS BIGINT), (SELECT list(sku) FROM v_products), CAST([] AS BIGINT[]), CAST(NULL AS VARCHAR)
   UNION ALL
   SELECT rn, CASE WHEN res = 'ok' THEN list_append(taken, sku) ELSE taken END,
     CASE WHEN res = 'ok' THEN list_append(owners, v) ELSE owners END, res
   FROM (SELECT r.rn, f.taken, f.owners, r.sku, r.v,
     CASE WHEN r.nombre IS NULL OR r.nombre = '' THEN 'datos_faltantes'
          WHEN r.limited AND len(list_filter(f.owners, lambda o: o = r.v)) >= 50 THEN 'cuota'
          WHEN list_contains(f.taken, r.sku) THEN 'sku_duplicado' ELSE 'ok' END AS res
     FROM f JOIN r ON r.rn = f.rn + 1)),
 ok AS (SELECT r.* FROM r JOIN f ON f.rn = r.rn WHERE f.res = 'ok')"""

_MOVE = """r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'NEW-' || CAST(p_partkey % 50 AS VARCHAR)
     ELSE 'SKU-' || CAST(p_partkey + 3 AS VARCHAR) END AS sku,
   CASE WHEN p_partkey % 4 = 1 THEN p_name || ' v2' END AS nombre,
   CAST(CASE WHEN p_partkey % 11 = 0 THEN 99 WHEN p_partkey % 3 = 0 THEN 2 END AS INT) AS categoria_id,
   row_number() OVER (ORDER BY CASE WHEN p_partkey % 2 = 0 THEN -p_partkey ELSE p_partkey END) AS rn FROM part),
 f(rn, held, id, res) AS (
   SELECT CAST(0 AS BIGINT), (SELECT list({'o': id, 's': sku}) FROM v_products), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
   UNION ALL
   SELECT rn, CASE WHEN res = 'ok' THEN list_transform(held, lambda h: CASE WHEN h.o = id THEN {'o': id, 's': sku} ELSE h END) ELSE held END,
     id, res
   FROM (SELECT r.rn, f.held, r.id, r.sku,
     CASE WHEN len(list_filter(f.held, lambda h: h.s = r.sku AND h.o <> r.id)) > 0 THEN 'sku_duplicado'
          WHEN r.categoria_id IS NOT NULL AND r.categoria_id NOT IN (SELECT id FROM v_categories) THEN 'fk_invalida' ELSE 'ok' END AS res
     FROM f JOIN r ON r.rn = f.rn + 1)),
 n AS (SELECT r.*, f.res = 'ok' AS ok, f.res FROM r JOIN f ON f.rn = r.rn)"""

_SLUGS = f"""r AS (SELECT c_custkey % 45 AS owner, c_custkey AS seq, {_SLUG.format(x="'Tienda ' || CAST((c_custkey * 7) % 60 AS VARCHAR)")} AS slug,
   c_custkey % 13 <> 0 AS filled, CASE WHEN c_custkey % 4 = 0 THEN '{{"n":' || CAST(c_custkey AS VARCHAR) || '}}' END AS pers,
   COALESCE(u.suscripcion_plan, 'mini') = 'pro' AS pro, row_number() OVER (ORDER BY c_custkey) AS rn
   FROM customer LEFT JOIN v_users u ON u.id = c_custkey % 45),
 f(rn, held, res) AS (
   SELECT CAST(0 AS BIGINT), (SELECT list({{'o': id, 's': store_slug}}) FROM v_users), CAST(NULL AS VARCHAR)
   UNION ALL
   SELECT rn, CASE WHEN res = 'ok' THEN list_transform(held, lambda h: CASE WHEN h.o = owner THEN {{'o': owner, 's': slug}} ELSE h END) ELSE held END, res
   FROM (SELECT r.rn, f.held, r.owner, r.slug, CASE WHEN NOT r.filled THEN 'datos_faltantes' WHEN NOT r.pro THEN 'plan'
       WHEN len(list_filter(f.held, lambda h: h.s = r.slug AND h.o <> r.owner)) > 0 THEN 'slug_en_uso' ELSE 'ok' END AS res
     FROM f JOIN r ON r.rn = f.rn + 1)),
 n AS (SELECT r.*, f.res FROM r JOIN f ON f.rn = r.rn)"""

# The state is each product's SKU and history, request by request.
_CHAIN = """r AS (SELECT c_custkey AS seq, c_custkey % 300 AS id,
   CASE WHEN c_custkey % 9 <> 0 THEN 'SKU-' || CAST((c_custkey * 11) % 400 AS VARCHAR) END AS sku,
   CASE WHEN c_custkey % 6 = 1 THEN 'Pieza ' || CAST(c_custkey AS VARCHAR) END AS nombre,
   CASE WHEN c_custkey % 10 = 3 THEN CAST(c_custkey AS DECIMAL(18,2)) END AS precio,
   CAST(CASE WHEN c_custkey % 17 = 0 THEN 99 WHEN c_custkey % 4 = 0 THEN 2 END AS INT) AS categoria_id,
   row_number() OVER (ORDER BY c_custkey) AS rn FROM customer),
 f(rn, held, res) AS (
   SELECT CAST(0 AS BIGINT), (SELECT list({'o': id, 's': sku, 'a': skus_anteriores}) FROM v_products), CAST(NULL AS VARCHAR)
   UNION ALL
   SELECT rn, CASE WHEN res = 'ok' AND sku IS NOT NULL THEN list_transform(held, lambda h: CASE WHEN h.o = id AND h.s <> sku THEN
       {'o': id, 's': sku, 'a': list_filter(list_append(COALESCE(h.a, CAST([] AS VARCHAR[])), h.s), lambda x: x <> sku)} ELSE h END)
     ELSE held END, res
   FROM (SELECT r.rn, f.held, r.id, r.sku, CASE WHEN r.id NOT IN (SELECT id FROM v_products) THEN 'no_encontrada'
       WHEN len(list_filter(f.held, lambda h: h.s = r.sku AND h.o <> r.id)) > 0 THEN 'sku_duplicado'
       WHEN r.categoria_id IS NOT NULL AND r.categoria_id NOT IN (SELECT id FROM v_categories) THEN 'fk_invalida' ELSE 'ok' END AS res
     FROM f JOIN r ON r.rn = f.rn + 1)),
 n AS (SELECT r.*, f.res FROM r JOIN f ON f.rn = r.rn),
 u AS (SELECT unnest(held) AS x FROM f WHERE rn = (SELECT max(rn) FROM f)),
 h AS (SELECT x.o AS o, x.s AS s, x.a AS a FROM u),
 e AS (SELECT id, arg_max(nombre, seq) FILTER (WHERE nombre IS NOT NULL) AS nombre, arg_max(precio, seq) FILTER (WHERE precio IS NOT NULL) AS precio,
   max(seq) AS last FROM n WHERE res = 'ok' GROUP BY id)"""

_REGISTER = f"""{_USERS}, k AS (SELECT req.*, lower(trim(email)) AS correo FROM req),
 w AS (SELECT correo, MIN(seq) AS w FROM k WHERE correo NOT IN (SELECT lower(email) FROM v_users) AND trim(nombre) <> '' GROUP BY correo),
 ok AS (SELECT {_id('k.correo')} AS id, trim(nombre) AS nombre, k.correo AS email, 1 AS marca_id, 2 AS rol_id FROM k
   JOIN w ON w.correo = k.correo AND w.w = k.seq)"""
_CREATED = f"""{_USERS}, w AS (SELECT email, MIN(seq) AS w FROM req WHERE email NOT IN (SELECT email FROM v_users) GROUP BY email),
 ok AS (SELECT {_id('req.email')} AS id, nombre, req.email, CAST(CASE WHEN rol_id <> 1 THEN rol_id - 1 END AS INT) AS marca_id, rol_id FROM req
   JOIN w ON w.email = req.email AND w.w = req.seq)"""


def _with_users(ok: str, estado: str) -> str:
    return f"""WITH {ok} SELECT {_USER} FROM v_users
UNION ALL SELECT id, nombre, email, marca_id, {estado}, NULL, NULL FROM ok"""


ORACLES = {
    "inventory_admission_table": f"""WITH RECURSIVE {_ADMIT}
SELECT {_id('r.v', 'r.p')} AS id, r.v AS vendedor_id, r.p AS producto_maestro_id, CAST(r.l_quantity AS INT) AS stock,
 CAST(CAST(r.l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS precio_personalizado
FROM f JOIN r ON r.v = f.v AND r.rn = f.rn WHERE f.res = 'ok'""",

    "custom_item_outcome": f"""WITH RECURSIVE {_OWN}
SELECT r.seq, r.v AS vendedor_id, r.sku, f.res AS resultado FROM r JOIN f ON f.rn = r.rn""",

    "custom_item_products_table": f"""WITH RECURSIVE {_OWN}
SELECT {_product()} FROM v_products p
UNION ALL SELECT {_product(id=_id('p.sku'), descripcion='NULL', precio_sugerido='p.precio', ruta_imagen='NULL', categoria_id='NULL',
                           estado='false', creado_por='p.v', skus_anteriores='CAST(NULL AS VARCHAR[])')} FROM ok p""",

    "custom_item_inventory_table": f"""WITH RECURSIVE {_OWN}
SELECT {_id('v', _id('sku'))} AS id, v AS vendedor_id, {_id('sku')} AS producto_maestro_id, stock, CAST(precio AS DOUBLE) AS precio_personalizado
FROM ok""",

    "store_settings_users_table": f"""WITH RECURSIVE {_STORE}
SELECT u.id, u.nombre, u.email, u.marca_id, u.suscripcion_estado, COALESCE(f.slug, u.store_slug) AS store_slug,
 CASE WHEN f.owner IS NOT NULL AND u.id % 4 = 0 THEN '{{"theme":"dark"}}' ELSE u.personalizacion END AS personalizacion
FROM v_users u LEFT JOIN f ON f.owner = u.id AND f.res = 'ok'""",

    "store_settings_repeats": f"""WITH RECURSIVE {_SLUGS}
SELECT owner AS id, seq, res AS resultado, slug AS store_slug FROM n""",

    "store_settings_repeats_table": f"""WITH RECURSIVE {_SLUGS},
 e AS (SELECT owner, arg_max(slug, seq) AS slug, arg_max(pers, seq) FILTER (WHERE pers IS NOT NULL) AS pers FROM n WHERE res = 'ok' GROUP BY owner)
SELECT u.id, u.nombre, u.email, u.marca_id, u.suscripcion_estado, COALESCE(e.slug, u.store_slug) AS store_slug,
 COALESCE(e.pers, u.personalizacion) AS personalizacion FROM v_users u LEFT JOIN e ON e.owner = u.id""",

    "catalog_repeats_outcome": f"WITH RECURSIVE {_CHAIN} SELECT seq, id, sku, res AS resultado FROM n",

    "catalog_repeats_table": f"""WITH RECURSIVE {_CHAIN}
SELECT {_product(sku='h.s', nombre='COALESCE(e.nombre, p.nombre)', precio_sugerido='COALESCE(e.precio, p.precio_sugerido)',
                 categoria_id='CASE WHEN e.id IS NULL THEN p.categoria_id ELSE l.categoria_id END', skus_anteriores='h.a')}
FROM v_products p JOIN h ON h.o = p.id LEFT JOIN e ON e.id = p.id LEFT JOIN r l ON l.seq = e.last""",

    "catalog_create_table": f"""WITH {_CREATE}
SELECT {_product()} FROM v_products p
UNION ALL SELECT {_product(id=_id('p.sku'), nombre='part.p_name', descripcion='NULL', precio_sugerido='CAST(part.p_retailprice AS DECIMAL(18,2))',
                           ruta_imagen='NULL', estado='true', creado_por='NULL', skus_anteriores='CAST(NULL AS VARCHAR[])')}
FROM chk p JOIN win w ON w.sku = p.sku AND w.w = p.seq JOIN part ON p_partkey = p.seq""",

    "catalog_move_outcome": f"""WITH RECURSIVE {_MOVE}
SELECT n.id, n.res AS resultado, CASE WHEN n.ok THEN n.sku ELSE p.sku END AS sku FROM n JOIN v_products p ON p.id = n.id""",

    "catalog_patch_table": f"""WITH RECURSIVE {_MOVE}
SELECT {_product(sku='CASE WHEN n.ok THEN n.sku ELSE p.sku END', nombre='CASE WHEN n.ok THEN COALESCE(n.nombre, p.nombre) ELSE p.nombre END',
                 categoria_id='CASE WHEN n.ok THEN n.categoria_id ELSE p.categoria_id END',
                 skus_anteriores='''CASE WHEN n.ok AND n.sku <> p.sku THEN list_filter(list_append(COALESCE(p.skus_anteriores,
                   CAST([] AS VARCHAR[])), p.sku), lambda x: x <> n.sku) ELSE p.skus_anteriores END''')}
FROM v_products p LEFT JOIN n ON n.id = p.id""",

    "catalog_approve_table": f"SELECT {_product(estado='p.estado OR p.categoria_id IS NOT NULL')} FROM v_products p",

    "catalog_reject_table": f"SELECT {_product()} FROM v_products p WHERE p.estado",

    "catalog_reject_inventory_table": f"""SELECT {_ITEM} FROM v_inventory i
WHERE NOT EXISTS (SELECT 1 FROM v_products p WHERE p.id = i.producto_maestro_id AND NOT p.estado)""",

    "user_register_table": _with_users(_REGISTER, "'pendiente'"),
    "user_register_roles_table": f"WITH {_REGISTER} SELECT usuario_id, rol_id FROM v_roles UNION ALL SELECT id, rol_id FROM ok",
    "user_create_table": _with_users(_CREATED, "NULL"),
    "user_create_roles_table": f"WITH {_CREATED} SELECT usuario_id, rol_id FROM v_roles UNION ALL SELECT id, rol_id FROM ok",

    "client_admission_table": f"""WITH {_CLIENTS}
SELECT {_id('vendedor_id', 'nombre', 'seq')} AS id, vendedor_id, nombre, CAST(0 AS DOUBLE) AS saldo_pendiente, CAST(NULL AS DATE) AS fecha_proximo_pago
FROM c WHERE valid AND NOT (limited AND COALESCE(valid_before, 0) >= 20)""",

    "client_delete_table": """SELECT id, vendedor_id, nombre, CAST(saldo_pendiente AS DOUBLE) AS saldo_pendiente, fecha_proximo_pago
FROM v_clients WHERE saldo_pendiente > 0""",

    "client_delete_sales_table": """SELECT s.id, s.vendedor_id, c.id AS clienta_id FROM v_sales s
LEFT JOIN v_clients c ON c.id = s.clienta_id AND c.saldo_pendiente > 0""",

    "push_subscribe_table": f"""WITH e AS (SELECT DISTINCT user_id AS v, 'https://push.example/' || CAST(user_id AS VARCHAR) AS endpoint
   FROM events JOIN v_users u ON u.id = user_id AND u.suscripcion_plan = 'pro')
SELECT id, vendedor_id, subscription FROM v_push
UNION ALL SELECT {_id('v', 'endpoint')}, v, '{{"endpoint":"' || endpoint || '"}}' FROM e
WHERE NOT EXISTS (SELECT 1 FROM v_push p WHERE p.vendedor_id = v AND json_extract_string(p.subscription, '$.endpoint') = endpoint)""",
}

"""The fixture bindings of ``tables.FixtureTables`` as DuckDB SQL.

Oracle queries are written against the view names ``v_users``, ``v_sales``,
...; ``with_views`` prepends the definitions of the views a query uses as
CTEs, so the SQL runs on the bare base tables the checker registers.
"""

from __future__ import annotations

import re

# The binding SQL of FIXTURES.md, verbatim.
VIEWS = {
    "v_users": """
SELECT s_suppkey AS id, s_name AS nombre,
 CASE WHEN s_suppkey % 10 = 1 THEN 'VENDOR' || CAST(s_suppkey - 1 AS VARCHAR(20)) || '@EXAMPLE.COM' ELSE 'vendor' || CAST(s_suppkey AS VARCHAR(20)) || '@example.com' END AS email,
 s_nationkey + 1 AS marca_id,
 CASE s_suppkey % 5 WHEN 0 THEN 'mini' WHEN 1 THEN 'pro' WHEN 2 THEN 'avanzado' WHEN 3 THEN 'ninguno' ELSE NULL END AS suscripcion_plan,
 CASE s_suppkey % 4 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'activa' WHEN 2 THEN 'pago_fallido' ELSE 'cancelada' END AS suscripcion_estado,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '2001-06-01' + CAST(s_suppkey % 120 AS INT) END AS suscripcion_fin,
 'store-' || CAST(s_suppkey AS VARCHAR(20)) AS store_slug,
 CASE WHEN s_suppkey % 6 = 0 THEN '{"accent_color":"#18181b","logo":"data:image/png;base64,iVBORw0KGgo=","social":{"instagram":"x"}}' ELSE '{}' END AS personalizacion,
 CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE 'cus_' || CAST(s_suppkey AS VARCHAR(20)) END AS stripe_customer_id,
 CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'sub_' || CAST(s_suppkey AS VARCHAR(20)) END AS stripe_subscription_id
 FROM supplier""",
    "v_roles": """
SELECT s_suppkey AS usuario_id, CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 2 END AS rol_id FROM supplier WHERE s_suppkey % 9 <> 8""",
    "v_categories": """
SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 ELSE 6 END AS id, p_type AS nombre FROM part WHERE p_type <> 'PROMO'""",
    "v_products": """
SELECT p_partkey AS id, 'SKU-' || CAST(p_partkey AS VARCHAR(20)) AS sku, p_name AS nombre,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || ' ' || p_brand END AS descripcion,
 CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS precio_sugerido,
 CASE WHEN p_partkey % 40 = 0 THEN 'data:image/jpeg;base64,/9j/4AAQ' ELSE 'https://cdn.example/' || CAST(p_partkey AS VARCHAR(20)) || '.jpg' END AS ruta_imagen,
 CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 ELSE NULL END AS categoria_id,
 CAST(split_part(p_brand, '#', 2) AS INT) AS marca_id, p_size % 10 <> 0 AS estado,
 CASE WHEN p_size % 10 = 0 THEN p_partkey % 10 ELSE NULL END AS creado_por,
 CASE WHEN p_partkey % 3 = 0 THEN list_value('OLD-' || CAST(p_partkey AS VARCHAR(20))) ELSE NULL END AS skus_anteriores
 FROM part""",
    "v_inventory": """
SELECT l_suppkey * 1000000 + l_partkey AS id, l_suppkey AS vendedor_id, l_partkey AS producto_maestro_id,
 CAST(sum(CAST(l_quantity AS INT)) % 12 AS INT) AS stock, CAST(max(CAST(p_retailprice AS DECIMAL(18,2))) * CAST(1.2 AS DECIMAL(3,1)) AS DECIMAL(18,2)) AS precio_personalizado
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_partkey""",
    "v_inventory_raw": """
SELECT (l_orderkey * 100000 + l_suppkey) * 1000000 + l_partkey AS id, l_suppkey AS vendedor_id, l_partkey AS producto_maestro_id,
 CASE WHEN l_orderkey % 25 = 0 THEN NULL ELSE CAST(sum(CAST(l_quantity AS INT)) AS INT) END AS stock FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey""",
    "v_sales": """
SELECT (l_orderkey * 100000 + l_suppkey) * 1000000 + l_partkey AS id, l_suppkey AS vendedor_id, l_suppkey * 1000000 + l_partkey AS inventario_id,
 CAST(l_quantity AS INT) AS cantidad, CAST(l_extendedprice AS DECIMAL(18,2)) AS precio_total, o_orderdate AS fecha,
 CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE o_custkey END AS clienta_id,
 CASE WHEN o_orderstatus = 'O' AND l_linenumber % 5 <> 0 THEN 'EN_ABONOS' ELSE 'PAGADO' END AS estado_pago,
 CAST(CASE WHEN o_orderstatus = 'O' AND l_linenumber % 5 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS saldo_restante
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_instalments": """
SELECT ((l_orderkey * 100000 + l_suppkey) * 1000000 + l_partkey) * 10 + l_linenumber AS id,
 CASE WHEN l_orderkey % 200 = 0 THEN -1 ELSE 1 END * ((l_orderkey * 100000 + l_suppkey) * 1000000 + l_partkey) AS venta_id,
 CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS monto, l_shipdate AS fecha FROM lineitem WHERE l_linenumber % 3 = 0""",
    "v_clients": """
SELECT c_custkey AS id, c_custkey % (SELECT count(*) FROM supplier) AS vendedor_id, c_name AS nombre,
 CAST(c_acctbal AS DECIMAL(18,2)) AS saldo_pendiente, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE DATE '2001-06-01' + CAST(c_custkey % 120 AS INT) END AS fecha_proximo_pago FROM customer""",
    "v_push": """
SELECT s_suppkey * 10 + 1 AS id, s_suppkey AS vendedor_id, '{"endpoint":"https://push.example/' || CAST(s_suppkey AS VARCHAR(20)) || '"}' AS subscription FROM supplier WHERE s_suppkey % 2 = 0""",
    "v_sale_balances": """
SELECT o_orderkey AS venta_id, o_custkey % (SELECT count(*) FROM supplier) AS vendedor_id, o_custkey AS clienta_id,
 CAST(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2)) AS saldo_restante,
 CASE WHEN o_orderstatus = 'O' THEN 'EN_ABONOS' ELSE 'PAGADO' END AS estado_pago FROM orders""",
    "v_payments": """
SELECT event_id AS id, user_id AS usuario_id, CASE WHEN event_id % 4 = 0 THEN 'renovacion' ELSE 'suscripcion_inicial' END AS tipo, 29900 AS monto, 'pendiente' AS estado, ts AS creado_en FROM events WHERE event_type = 'signup'""",
    "v_billing": """
SELECT event_id, ts, user_id,
 CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'purchase' THEN 'invoice.payment_succeeded' WHEN 'error' THEN 'invoice.payment_failed' WHEN 'view' THEN 'customer.subscription.updated' ELSE 'customer.subscription.deleted' END AS type,
 CASE WHEN event_type IN ('purchase','error') AND event_id % 2 = 0 THEN '{"customer":"cus_' || CAST(user_id AS VARCHAR(20)) || '","parent":{"subscription_details":{"subscription":"sub_' || CAST(user_id AS VARCHAR(20)) || '"}},"lines":{"data":[{"period":{"end":' || CAST(1704067200 + event_id * 3600 AS VARCHAR(20)) || '},"price":{"id":"price_pro"}}]}}'
 WHEN event_type IN ('purchase','error') THEN '{"customer":{"id":"cus_' || CAST(CASE WHEN event_id % 10 = 3 THEN user_id + 1 ELSE user_id END AS VARCHAR(20)) || '"},"lines":{"data":[{"subscription":null},{"subscription":"' || CASE WHEN event_id % 10 = 5 THEN 'subx_' ELSE 'sub_' END || CAST(user_id AS VARCHAR(20)) || '"}]}}'
 WHEN event_type = 'signup' THEN '{"customer":"cus_' || CAST(user_id AS VARCHAR(20)) || '","subscription":"sub_' || CAST(user_id AS VARCHAR(20)) || '","payment_status":"' || CASE event_id % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'unpaid' ELSE 'no_payment_required' END || '","metadata":{"pago_id":"' || CAST(event_id AS VARCHAR(20)) || '","price_id":"price_adv"}}'
 ELSE '{"id":"sub_' || CAST(user_id AS VARCHAR(20)) || '","status":"' || CASE event_id % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' WHEN 2 THEN 'paused' WHEN 3 THEN 'unpaid' WHEN 4 THEN 'canceled' ELSE 'trialing' END || '"}' END AS object
 FROM events""",
}

_VIEW_RE = re.compile(r"\bv_[a-z_]+\b")
_WITH_RE = re.compile(r"^\s*WITH\s+(RECURSIVE\s+)?", re.IGNORECASE)


def with_views(body: str) -> str:
    """Prefix ``body`` with CTEs for every ``v_*`` view it names."""
    used = [v for v in VIEWS if v in set(_VIEW_RE.findall(body))]
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    m = _WITH_RE.match(body)
    if m:
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{ctes},\n{body[m.end():].strip()}"
    return f"WITH {ctes}\n{body.strip()}"

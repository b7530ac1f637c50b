"""DuckDB oracles for W7, W9, W10, W12-W15 (W8 is checked against a
sequential brute force in tests: its SKU rule couples all vendors)."""

from vendorlytics.plans.oracle_changes_sales import IDENT, SEQ

_DESC = SEQ.replace(", ", " DESC, ") + " DESC"

_ADMIT = f"""r0 AS (SELECT {SEQ}, l_suppkey AS v, l_partkey AS p,
   row_number() OVER (PARTITION BY l_suppkey ORDER BY {SEQ}) AS rn FROM lineitem),
 r AS (SELECT r0.*, u.id IS NOT NULL AS known, COALESCE(u.suscripcion_plan, 'mini') = 'mini' AS limited,
   COALESCE(pr.marca_id = u.marca_id OR pr.creado_por = r0.v, false) AS allowed
   FROM r0 LEFT JOIN v_users u ON u.id = r0.v LEFT JOIN v_products pr ON pr.id = r0.p),
 f(v, rn, cnt, prods, res) AS (
   SELECT DISTINCT v, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS VARCHAR) FROM r
   UNION ALL
   SELECT v, rn, cnt + CASE WHEN res = 'ok' THEN 1 ELSE 0 END,
     CASE WHEN res = 'ok' THEN list_append(prods, p) ELSE prods END, res
   FROM (SELECT f.v, r.rn, f.cnt, f.prods, r.p,
     CASE WHEN NOT r.known THEN 'vendedor_no_encontrado' WHEN r.limited AND f.cnt >= 50 THEN 'cuota'
          WHEN NOT r.allowed THEN 'sin_permiso' WHEN list_contains(f.prods, r.p) THEN 'duplicado' ELSE 'ok' END AS res
     FROM f JOIN r ON r.v = f.v AND r.rn = f.rn + 1))"""

_PATCH = f"""req AS (SELECT {SEQ}, l_suppkey * 1000000 + l_partkey AS id,
   CASE WHEN l_linenumber = 6 THEN l_suppkey + 1 ELSE l_suppkey END AS vendedor_id,
   CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS stock,
   CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS precio FROM lineitem),
 ok AS (SELECT req.* FROM req JOIN v_inventory iv ON iv.id = req.id AND iv.vendedor_id = req.vendedor_id),
 ls AS (SELECT id, stock FROM (SELECT id, stock, row_number() OVER (PARTITION BY id ORDER BY {_DESC}) AS r
   FROM ok WHERE stock IS NOT NULL) WHERE r = 1),
 lp AS (SELECT id, precio FROM (SELECT id, precio, row_number() OVER (PARTITION BY id ORDER BY {_DESC}) AS r
   FROM ok WHERE precio IS NOT NULL) WHERE r = 1)"""

_DELETE = """snap AS (SELECT id, vendedor_id, producto_maestro_id FROM v_inventory UNION ALL
   SELECT s_suppkey * 1000000 + p_partkey, s_suppkey, p_partkey FROM supplier JOIN part ON p_partkey % 97 = s_suppkey % 97
   WHERE s_suppkey * 1000000 + p_partkey NOT IN (SELECT id FROM v_inventory)),
 req AS (SELECT id, vendedor_id, id AS seq FROM snap),
 sold AS (SELECT inventario_id AS id, COUNT(*) AS n FROM v_sales GROUP BY 1),
 outc AS (SELECT r.id, r.vendedor_id, r.seq, s.producto_maestro_id, COALESCE(sold.n, 0) AS ventas,
   CASE WHEN COALESCE(sold.n, 0) > 0 THEN 'tiene_ventas' WHEN s.id IS NULL THEN 'no_encontrado' ELSE 'eliminado' END
   AS resultado FROM req r LEFT JOIN sold ON sold.id = r.id LEFT JOIN snap s ON s.id = r.id AND s.vendedor_id = r.vendedor_id)"""

_CREATE = """req AS (SELECT p_partkey AS seq, 'SKU-' || CAST(p_partkey + 1000 AS VARCHAR) AS sku,
   CAST(p_partkey % 8 AS INT) AS categoria_id, CAST(p_partkey % 27 AS INT) AS marca_id FROM part),
 chk AS (SELECT req.*, req.sku IN (SELECT sku FROM v_products) AS in_catalog,
   (req.categoria_id IS NULL OR req.categoria_id IN (SELECT id FROM v_categories))
   AND (req.marca_id IS NULL OR req.marca_id IN (SELECT marca_id FROM v_products)) AS fk_ok FROM req),
 win AS (SELECT sku, MIN(seq) AS w FROM chk WHERE NOT in_catalog AND fk_ok GROUP BY sku)"""

_CPATCH = """req AS (SELECT id, CASE id % 4 WHEN 0 THEN 'NEW-' || CAST(id AS VARCHAR) WHEN 1 THEN sku
   WHEN 2 THEN 'OLD-' || CAST(id AS VARCHAR) END AS sku,
   CASE WHEN id % 4 = 1 THEN nombre || ' v2' END AS nombre, CASE WHEN id % 4 = 3 THEN 'Editada' END AS descripcion,
   CASE WHEN id % 4 <> 3 THEN categoria_id END AS categoria_id FROM v_products)"""

ORACLES = {
    "inventory_admission": f"""WITH RECURSIVE {_ADMIT}
SELECT r.l_orderkey, r.l_linenumber, r.l_suppkey, r.l_partkey, r.v AS vendedor_id, r.p AS producto_maestro_id,
 f.res AS resultado FROM f JOIN r ON r.v = f.v AND r.rn = f.rn""",

    "inventory_patch": f"""WITH {_PATCH}
SELECT iv.id, iv.vendedor_id, iv.producto_maestro_id, COALESCE(ls.stock, iv.stock) AS stock,
 CAST(COALESCE(lp.precio, iv.precio_personalizado) AS DOUBLE) AS precio_personalizado
FROM v_inventory iv LEFT JOIN ls ON ls.id = iv.id LEFT JOIN lp ON lp.id = iv.id""",

    "inventory_patch_outcome": f"""WITH {_PATCH}
SELECT {IDENT}, req.id, req.vendedor_id, CASE WHEN iv.id IS NULL THEN 'no_encontrado' ELSE 'ok' END AS resultado
FROM req LEFT JOIN v_inventory iv ON iv.id = req.id AND iv.vendedor_id = req.vendedor_id""",

    "inventory_delete": f"""WITH {_DELETE}
SELECT id, vendedor_id, resultado, CAST(ventas AS BIGINT) AS ventas FROM outc""",

    "inventory_delete_products": f"""WITH {_DELETE}
SELECT p.id, p.creado_por FROM v_products p JOIN outc o ON o.producto_maestro_id = p.id
 AND o.vendedor_id = p.creado_por AND o.resultado = 'eliminado'
WHERE p.estado = false AND (SELECT COUNT(*) FROM snap s WHERE s.producto_maestro_id = p.id) =
 (SELECT COUNT(*) FROM outc o2 WHERE o2.producto_maestro_id = p.id AND o2.resultado = 'eliminado' AND o2.seq <= o.seq)""",

    "catalog_create": f"""WITH {_CREATE}
SELECT c.seq, c.sku, c.categoria_id, c.marca_id,
 CASE WHEN c.in_catalog OR w.w < c.seq THEN 'sku_duplicado' WHEN NOT c.fk_ok THEN 'fk_invalida' ELSE 'ok' END AS resultado
FROM chk c LEFT JOIN win w ON w.sku = c.sku""",

    "catalog_patch": f"""WITH {_CPATCH}
SELECT p.id,
 CASE WHEN EXISTS (SELECT 1 FROM v_products o WHERE o.sku = COALESCE(r.sku, p.sku) AND o.id <> p.id) THEN 'sku_duplicado'
      WHEN r.categoria_id IS NOT NULL AND r.categoria_id NOT IN (SELECT id FROM v_categories) THEN 'fk_invalida'
      ELSE 'ok' END AS resultado,
 COALESCE(r.sku, p.sku) AS sku, COALESCE(r.nombre, p.nombre) AS nombre, COALESCE(r.descripcion, p.descripcion) AS descripcion,
 CAST(p.precio_sugerido AS DOUBLE) AS precio_sugerido, r.categoria_id, p.marca_id,
 CAST(to_json(CASE WHEN r.sku IS NOT NULL AND p.sku IS NOT NULL AND r.sku <> p.sku
      THEN list_filter(list_append(COALESCE(p.skus_anteriores, CAST([] AS VARCHAR[])), p.sku), lambda x: x <> r.sku)
      ELSE p.skus_anteriores END) AS VARCHAR) AS skus_anteriores
FROM req r JOIN v_products p ON p.id = r.id""",

    "catalog_approve": """SELECT id, CASE WHEN categoria_id IS NULL THEN 'sin_categoria' ELSE 'aprobada' END AS resultado
FROM v_products WHERE estado = false""",

    "catalog_reject": """SELECT p.id, 'rechazada' AS resultado,
 CAST((SELECT COUNT(*) FROM v_inventory iv WHERE iv.producto_maestro_id = p.id) AS BIGINT) AS inventario_borrado
FROM v_products p WHERE p.estado = false""",
}

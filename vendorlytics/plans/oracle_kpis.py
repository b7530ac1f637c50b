"""DuckDB oracle SQL for the KPI queries (AS_OF = DATE '2001-08-01')."""

_K1_AGG = """s AS (SELECT vendedor_id, SUM(precio_total) AS rev, SUM(cantidad) AS units, COUNT(id) AS n,
  SUM(CASE WHEN CAST(fecha AS DATE) = DATE '2001-08-01' THEN cantidad ELSE 0 END) AS u_today,
  SUM(CASE WHEN CAST(fecha AS DATE) = DATE '2001-08-01' THEN precio_total ELSE 0 END) AS r_today
  FROM v_sales GROUP BY vendedor_id)"""

_K1_COLS = """CAST(COALESCE(s.rev, 0) AS DOUBLE) AS total_ingresos,
 CAST(COALESCE(s.units, 0) AS INTEGER) AS unidades_vendidas,
 CAST(COALESCE(s.n, 0) AS INTEGER) AS transacciones_totales,
 CAST(COALESCE(s.u_today, 0) AS INTEGER) AS joyas_vendidas_hoy,
 CAST(COALESCE(s.r_today, 0) AS DOUBLE) AS ingresos_hoy"""

_SALES_PRODUCTS = """v_sales v JOIN v_inventory iv ON v.inventario_id = iv.id
 JOIN v_products cm ON iv.producto_maestro_id = cm.id"""

_TOP = f"""top AS (SELECT * FROM (SELECT vendedor_id, nombre, total_vendido,
  CAST(row_number() OVER (PARTITION BY vendedor_id ORDER BY total_vendido DESC, nombre ASC) AS INTEGER) AS ord
  FROM (SELECT v.vendedor_id, cm.nombre, CAST(SUM(v.cantidad) AS INTEGER) AS total_vendido
        FROM {_SALES_PRODUCTS} GROUP BY v.vendedor_id, cm.nombre)) WHERE ord <= 3)"""

_RECENT = f"""rec AS (SELECT * FROM (SELECT v.vendedor_id, v.id, v.cantidad, CAST(v.precio_total AS DOUBLE) AS total,
  strftime(v.fecha, '%d/%m/%Y %H:%M') AS fecha, cm.nombre AS producto_nombre, cm.ruta_imagen AS imagen,
  CAST(row_number() OVER (PARTITION BY v.vendedor_id ORDER BY v.fecha DESC, v.id DESC) AS INTEGER) AS ord
  FROM {_SALES_PRODUCTS}) WHERE ord <= 5)"""

_DUE_WHERE = "saldo_pendiente > 0 AND fecha_proximo_pago <= DATE '2001-08-01'"

ORACLES = {
    "sales_summary": f"""WITH {_K1_AGG}
SELECT u.id AS vendedor_id, CAST(COALESCE(s.rev, 0) AS DOUBLE) AS valor_total_ventas, {_K1_COLS}
FROM v_users u LEFT JOIN s ON u.id = s.vendedor_id""",

    "low_stock_count": """SELECT u.id AS vendedor_id, CAST(COALESCE(c.n, 0) AS INTEGER) AS productos_criticos
FROM v_users u LEFT JOIN (SELECT vendedor_id, COUNT(*) AS n FROM v_inventory WHERE stock < 5 GROUP BY vendedor_id) c
ON u.id = c.vendedor_id""",

    "stock_alert_count": """SELECT u.id AS vendedor_id, CAST(COALESCE(c.n, 0) AS INTEGER) AS count
FROM v_users u LEFT JOIN (SELECT vendedor_id, COUNT(*) AS n FROM v_inventory WHERE stock > 0 AND stock <= 3
GROUP BY vendedor_id) c ON u.id = c.vendedor_id""",

    "top_products": f"""WITH {_TOP} SELECT vendedor_id, nombre, total_vendido, ord FROM top""",

    "inventory_valuation": """SELECT u.id AS vendedor_id, CAST(COALESCE(c.tp, 0) AS INTEGER) AS total_productos,
 CAST(COALESCE(c.vt, 0) AS DOUBLE) AS valor_total
FROM v_users u LEFT JOIN (SELECT vendedor_id, SUM(stock) AS tp, SUM(stock * precio_personalizado) AS vt
 FROM v_inventory GROUP BY vendedor_id) c ON u.id = c.vendedor_id""",

    "recent_sales": f"""WITH {_RECENT}
SELECT vendedor_id, ord, id, cantidad, total, fecha, producto_nombre, imagen FROM rec""",

    "daily_revenue_7d": """SELECT vendedor_id, CAST(fecha AS DATE) AS dia, strftime(CAST(fecha AS DATE), '%d %b') AS etiqueta,
 CAST(SUM(precio_total) AS DOUBLE) AS total
FROM v_sales WHERE fecha >= DATE '2001-08-01' - INTERVAL 7 DAY GROUP BY vendedor_id, CAST(fecha AS DATE)""",

    "monthly_revenue_ytd": """SELECT vendedor_id, CAST(date_trunc('month', fecha) AS DATE) AS mes_inicio,
 rpad(strftime(date_trunc('month', fecha), '%B'), 9, ' ') AS mes, CAST(SUM(precio_total) AS DOUBLE) AS total
FROM v_sales WHERE fecha >= DATE '2001-01-01' GROUP BY 1, 2, 3""",

    "yearly_revenue": """SELECT vendedor_id, CAST(EXTRACT(YEAR FROM fecha) AS INTEGER) AS anio,
 CAST(SUM(precio_total) AS DOUBLE) AS total FROM v_sales GROUP BY 1, 2""",

    "receivables_due": f"""SELECT vendedor_id, id, nombre, CAST(saldo_pendiente AS DOUBLE) AS deuda, fecha_proximo_pago
FROM v_clients WHERE {_DUE_WHERE}""",

    "receivables_due_count": f"""SELECT u.id AS vendedor_id, CAST(COALESCE(c.n, 0) AS INTEGER) AS count
FROM v_users u LEFT JOIN (SELECT vendedor_id, COUNT(id) AS n FROM v_clients WHERE {_DUE_WHERE} GROUP BY vendedor_id) c
ON u.id = c.vendedor_id""",

    "vendor_dashboard": f"""WITH {_K1_AGG}, {_TOP}, {_RECENT},
inv AS (SELECT vendedor_id, COUNT(*) FILTER (WHERE stock < 5) AS pc, SUM(stock) AS tp,
        SUM(stock * precio_personalizado) AS vt FROM v_inventory GROUP BY vendedor_id),
d7 AS (SELECT vendedor_id, CAST(fecha AS DATE) AS dia, CAST(SUM(precio_total) AS DECIMAL(18,2)) AS p FROM v_sales
       WHERE fecha >= DATE '2001-08-01' - INTERVAL 7 DAY GROUP BY 1, 2),
mo AS (SELECT vendedor_id, date_trunc('month', fecha) AS m, CAST(SUM(precio_total) AS DECIMAL(18,2)) AS p FROM v_sales WHERE fecha >= DATE '2001-01-01' GROUP BY 1, 2),
ya AS (SELECT vendedor_id, EXTRACT(YEAR FROM fecha) AS y, CAST(SUM(precio_total) AS DECIMAL(18,2)) AS p FROM v_sales GROUP BY 1, 2),
yr AS (SELECT vendedor_id, COUNT(*) AS ny FROM ya GROUP BY 1),
due AS (SELECT vendedor_id, COUNT(id) AS c FROM v_clients WHERE {_DUE_WHERE} GROUP BY 1)
SELECT u.id AS vendedor_id, {_K1_COLS},
 CAST(COALESCE(inv.pc, 0) AS INTEGER) AS productos_criticos,
 CAST(COALESCE(inv.tp, 0) AS INTEGER) AS total_productos,
 CAST(COALESCE(inv.vt, 0) AS DOUBLE) AS valor_total,
 COALESCE((SELECT string_agg(nombre || ':' || CAST(total_vendido AS VARCHAR), '|' ORDER BY ord) FROM top
           WHERE top.vendedor_id = u.id), '') AS top_productos,
 COALESCE((SELECT string_agg(CAST(id AS VARCHAR), '|' ORDER BY ord) FROM rec WHERE rec.vendedor_id = u.id), '')
   AS ultimas_ventas,
 COALESCE((SELECT string_agg(strftime(dia, '%d %b') || ':' || CAST(p AS VARCHAR), '|' ORDER BY dia) FROM d7 WHERE d7.vendedor_id = u.id), '')
   AS dias,
 CAST((SELECT COUNT(*) FROM d7 WHERE d7.vendedor_id = u.id) AS INTEGER) AS n_dias,
 COALESCE((SELECT string_agg(strftime(m, '%B') || ':' || CAST(p AS VARCHAR), '|' ORDER BY m) FROM mo WHERE mo.vendedor_id = u.id), '') AS meses,
 COALESCE((SELECT string_agg(CAST(y AS VARCHAR) || ':' || CAST(p AS VARCHAR), '|' ORDER BY y) FROM ya WHERE ya.vendedor_id = u.id), '') AS anios,
 CAST(COALESCE(yr.ny, 0) AS INTEGER) AS n_anios,
 CAST(COALESCE(due.c, 0) AS INTEGER) AS cobros_hoy
FROM v_users u LEFT JOIN s ON u.id = s.vendedor_id LEFT JOIN inv ON u.id = inv.vendedor_id
 LEFT JOIN yr ON u.id = yr.vendedor_id LEFT JOIN due ON u.id = due.vendedor_id""",
}

"""DuckDB oracles for W11, W16-W23."""

_SLUG = ("regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), "
         "'^-|-$', '', 'g')")

_STORE = f"""req AS (SELECT s_suppkey AS owner,
   {_SLUG.format(x="'Store ' || CAST(s_suppkey % 40 AS VARCHAR) || '!'")} AS slug,
   regexp_replace('+52 (55) ' || CAST(s_suppkey AS VARCHAR), '[^0-9]', '', 'g') AS phone,
   row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
 r AS (SELECT req.*, COALESCE(u.suscripcion_plan, 'mini') = 'pro' AS pro FROM req LEFT JOIN v_users u ON u.id = req.owner),
 f(rn, holders, owner, slug, phone, res) AS (
   SELECT CAST(0 AS BIGINT), (SELECT list({{'o': id, 's': store_slug}}) FROM v_users), CAST(NULL AS BIGINT),
     CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
   UNION ALL
   SELECT rn, CASE WHEN res = 'ok' THEN list_transform(holders, lambda h: CASE WHEN h.o = owner
       THEN {{'o': h.o, 's': slug}} ELSE h END) ELSE holders END, owner, slug, phone, res
   FROM (SELECT r.rn, f.holders, r.owner, r.slug, r.phone,
     CASE WHEN NOT r.pro THEN 'plan'
          WHEN len(list_filter(f.holders, lambda h: h.s = r.slug AND h.o <> r.owner)) > 0 THEN 'slug_en_uso'
          ELSE 'ok' END AS res
     FROM f JOIN r ON r.rn = f.rn + 1))"""

_USERS = """req AS (SELECT c_custkey AS seq, c_name AS nombre,
   'VENDOR' || CAST(c_custkey % 200 AS VARCHAR) || '@example.com' AS email, CAST(c_custkey % 3 + 1 AS INT) AS rol_id
   FROM customer)"""

_CLIENTS = """req AS (SELECT c_custkey AS seq, c_custkey % 100 AS vendedor_id,
   CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS nombre FROM customer),
 r AS (SELECT req.seq, req.vendedor_id, req.nombre, COALESCE(u.suscripcion_plan, 'mini') = 'mini' AS limited,
   req.nombre IS NOT NULL AND req.nombre <> '' AS valid FROM req LEFT JOIN v_users u ON u.id = req.vendedor_id),
 c AS (SELECT *, COUNT(*) FILTER (WHERE valid) OVER (PARTITION BY vendedor_id ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS valid_before FROM r)"""

_UPLOADS = """u AS (SELECT event_id, user_id,
   (['image/jpeg', 'image/png', 'image/webp', 'image/gif', 'application/pdf'])[event_id % 5 + 1] AS ct,
   CAST(floor(value * 20000) AS BIGINT) AS size FROM events),
 s AS (SELECT *, CASE ct WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.png' WHEN 'image/webp' THEN '.webp' END AS ext
   FROM u),
 st AS (SELECT *, CASE WHEN ext IS NULL THEN 400 WHEN size IS NULL OR size <= 0 OR size > 5242880 THEN 413 ELSE 200 END
   AS estado FROM s)"""

ORACLES = {
    "store_settings_apply": f"""WITH RECURSIVE {_STORE}
SELECT owner AS id, res AS resultado, slug AS store_slug, phone AS telefono FROM f WHERE rn > 0""",

    "user_register": f"""WITH {_USERS},
 r AS (SELECT req.*, lower(trim(email)) AS correo FROM req),
 k AS (SELECT r.*, lower(trim(email)) IN (SELECT lower(email) FROM v_users) AS ex FROM r),
 w AS (SELECT correo, MIN(seq) AS w FROM k WHERE NOT ex AND trim(nombre) <> '' GROUP BY correo)
SELECT k.seq, CASE WHEN trim(k.nombre) = '' OR k.nombre IS NULL THEN 'datos_faltantes'
  WHEN k.ex OR w.w < k.seq THEN 'correo_registrado' ELSE 'ok' END AS resultado,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN sha256(k.correo) END AS usuario_id,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN k.correo END AS email,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN 1 END AS marca_id,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN 2 END AS rol_id,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN 'pendiente' END AS suscripcion_estado
FROM k LEFT JOIN w ON w.correo = k.correo""",

    "user_create": f"""WITH {_USERS},
 k AS (SELECT req.*, email IN (SELECT email FROM v_users) AS ex FROM req),
 w AS (SELECT email, MIN(seq) AS w FROM k WHERE NOT ex GROUP BY email)
SELECT k.seq, CASE WHEN k.ex OR w.w < k.seq THEN 'correo_registrado' ELSE 'ok' END AS resultado,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN sha256(k.email) END AS usuario_id,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN CASE WHEN k.rol_id = 1 THEN NULL ELSE k.rol_id - 1 END END AS marca_id,
 CASE WHEN NOT k.ex AND w.w = k.seq THEN k.rol_id END AS rol_id
FROM k LEFT JOIN w ON w.email = k.email""",

    "user_soft_delete": """SELECT id,
 CASE WHEN id IN (SELECT (c_custkey * 37) % 1000 FROM customer) THEN 'cancelada' ELSE suscripcion_estado END
   AS suscripcion_estado,
 CASE WHEN id IN (SELECT (c_custkey * 37) % 1000 FROM customer) THEN DATE '2001-08-01' ELSE suscripcion_fin END
   AS suscripcion_fin FROM v_users""",

    "client_admission": f"""WITH {_CLIENTS}
SELECT seq, vendedor_id, CASE WHEN NOT valid THEN 'datos_faltantes'
  WHEN limited AND COALESCE(valid_before, 0) >= 10 THEN 'cuota' ELSE 'ok' END AS resultado,
 CASE WHEN valid AND NOT (limited AND COALESCE(valid_before, 0) >= 10) THEN '{{}}' END AS detalles FROM c""",

    "client_patch": """WITH req AS (SELECT id, CASE WHEN id % 17 = 0 THEN vendedor_id + 1 ELSE vendedor_id END AS vendedor_id,
   CASE WHEN id % 3 = 0 THEN NULL ELSE nombre || ' *' END AS nombre,
   CASE WHEN id % 3 = 1 THEN NULL ELSE fecha_proximo_pago + 7 END AS fecha,
   CASE WHEN id % 3 = 2 THEN '{"talla":"7"}' END AS detalles FROM v_clients)
SELECT c.id, CASE WHEN r.id IS NOT NULL THEN 'ok' ELSE 'sin_cambios' END AS resultado,
 COALESCE(r.nombre, c.nombre) AS nombre,
 CASE WHEN r.id IS NOT NULL THEN COALESCE(r.detalles, '{}') END AS detalles,
 CASE WHEN r.id IS NOT NULL THEN r.fecha ELSE c.fecha_proximo_pago END AS fecha_proximo_pago
FROM v_clients c LEFT JOIN req r ON r.id = c.id AND r.vendedor_id = c.vendedor_id""",

    "client_delete": """SELECT c.id, CASE WHEN c.saldo_pendiente > 0 THEN 'saldo_pendiente' ELSE 'eliminada' END AS resultado,
 CAST(CASE WHEN c.saldo_pendiente > 0 THEN 0 ELSE (SELECT COUNT(*) FROM v_sales v WHERE v.clienta_id = c.id) END AS BIGINT)
   AS ventas_desvinculadas
FROM v_clients c""",

    "push_subscribe": """WITH e AS (SELECT event_id AS seq, user_id AS vendedor_id,
   'https://push.example/' || CAST(user_id AS VARCHAR) AS endpoint FROM events),
 k AS (SELECT e.*, COALESCE(u.suscripcion_plan = 'pro', false) AS pro,
   EXISTS (SELECT 1 FROM v_push p WHERE p.vendedor_id = e.vendedor_id
           AND json_extract_string(p.subscription, '$.endpoint') = e.endpoint) AS stored
   FROM e LEFT JOIN v_users u ON u.id = e.vendedor_id),
 w AS (SELECT vendedor_id, endpoint, MIN(seq) AS w FROM k WHERE pro AND NOT stored GROUP BY 1, 2)
SELECT k.seq, k.vendedor_id, k.endpoint, CASE WHEN NOT k.pro THEN 'sin_plan'
  WHEN k.stored OR w.w < k.seq THEN 'existente' ELSE 'insertada' END AS resultado
FROM k LEFT JOIN w ON w.vendedor_id = k.vendedor_id AND w.endpoint = k.endpoint""",

    "upload_manifest_check": f"""WITH {_UPLOADS}
SELECT event_id, user_id, estado, CASE WHEN estado = 200 THEN 'uploads/' || CAST(user_id AS VARCHAR) || '/' ||
 CAST(event_id AS VARCHAR) || ext END AS storage_key FROM st""",

    "upload_bytes_by_user": f"""WITH {_UPLOADS}
SELECT user_id, COUNT(*) AS subidas, CAST(SUM(size) AS BIGINT) AS bytes FROM st WHERE estado = 200 GROUP BY user_id""",

    "payment_error_summary": """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS dia,
   CASE WHEN event_id % 20 < 10 THEN 'StripeCardError' ELSE (['StripeConnectionError', 'StripeAuthenticationError',
     'StripeInvalidRequestError', 'StripeRateLimitError', 'StripeAPIError'])[event_id % 5 + 1] END AS tipo,
   CASE WHEN event_id % 20 < 10 THEN (['card_declined', 'insufficient_funds', 'expired_card', 'incorrect_cvc',
     'invalid_cvc', 'incorrect_number', 'invalid_number', 'fraudulent', 'processing_error',
     'do_not_honor'])[event_id % 10 + 1] WHEN event_id % 20 = 17 THEN 'ECONNREFUSED' END AS codigo FROM events WHERE event_type = 'error')
SELECT dia, CASE WHEN tipo = 'StripeConnectionError' OR codigo = 'ECONNREFUSED' THEN 'sin_conexion'
  WHEN tipo = 'StripeCardError' THEN CASE codigo WHEN 'card_declined' THEN 'banco_rechazo'
   WHEN 'insufficient_funds' THEN 'fondos_insuficientes' WHEN 'expired_card' THEN 'tarjeta_vencida'
   WHEN 'incorrect_cvc' THEN 'cvc_incorrecto' WHEN 'invalid_cvc' THEN 'cvc_incorrecto'
   WHEN 'incorrect_number' THEN 'numero_invalido' WHEN 'invalid_number' THEN 'numero_invalido'
   WHEN 'fraudulent' THEN 'fraude' WHEN 'processing_error' THEN 'error_temporal' ELSE 'tarjeta_otro' END
  ELSE CASE tipo WHEN 'StripeAuthenticationError' THEN 'configuracion'
   WHEN 'StripeInvalidRequestError' THEN 'datos_pago' WHEN 'StripeRateLimitError' THEN 'demasiadas_solicitudes'
   ELSE 'generico' END END AS clase, COUNT(*) AS fallos FROM e GROUP BY 1, 2""",
}

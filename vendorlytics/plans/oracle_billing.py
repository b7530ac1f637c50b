"""DuckDB oracles for the billing jobs; B5/B6 as a recursive per-user fold."""

HANDLED = ("'checkout.session.completed', 'invoice.payment_succeeded', 'invoice.payment_failed', "
           "'customer.subscription.deleted', 'customer.subscription.updated'")

_PARSE = """pl AS (SELECT *,
   list_filter(CAST(json_extract(object, '$.lines.data') AS JSON[]),
     lambda l: json_extract_string(l, '$.subscription') IS NOT NULL)[1] AS sub_line,
   list_filter(CAST(json_extract(object, '$.lines.data') AS JSON[]),
     lambda l: json_extract_string(l, '$.period.end') IS NOT NULL)[1] AS period_line FROM v_billing),
 p AS (SELECT event_id, ts, user_id, type,
   CASE WHEN type NOT LIKE 'customer.subscription.%' THEN COALESCE(json_extract_string(object, '$.customer.id'),
     json_extract_string(object, '$.customer')) END AS customer_id,
   CASE WHEN type LIKE 'invoice.%' THEN COALESCE(
       json_extract_string(object, '$.parent.subscription_details.subscription.id'),
       json_extract_string(object, '$.parent.subscription_details.subscription'),
       json_extract_string(sub_line, '$.subscription.id'), json_extract_string(sub_line, '$.subscription'))
     WHEN type = 'checkout.session.completed' THEN COALESCE(json_extract_string(object, '$.subscription.id'),
       json_extract_string(object, '$.subscription'))
     WHEN type LIKE 'customer.subscription.%' THEN json_extract_string(object, '$.id') END AS subscription_id,
   make_timestamp(CAST(json_extract_string(period_line, '$.period.end') AS BIGINT) * 1000000) AS period_end,
   CASE WHEN type LIKE 'invoice.%' THEN COALESCE(json_extract_string(period_line, '$.price.id'),
       json_extract_string(period_line, '$.plan.id'))
     WHEN type = 'checkout.session.completed' THEN json_extract_string(object, '$.metadata.price_id') END AS price_id,
   CASE WHEN type = 'checkout.session.completed' THEN json_extract_string(object, '$.payment_status') END AS payment_status,
   CASE WHEN type = 'checkout.session.completed' THEN json_extract_string(object, '$.metadata.pago_id') END AS pago_id,
   CASE WHEN type LIKE 'customer.subscription.%' THEN json_extract_string(object, '$.status') END AS status
   FROM pl)"""

_PLAN = "CASE {x} WHEN 'price_pro' THEN 'pro' WHEN 'price_adv' THEN 'avanzado' ELSE 'mini' END"

_CUST = """cust AS (SELECT DISTINCT 'cus_' || CAST(user_id AS VARCHAR) AS customer_id,
   CASE WHEN user_id % 2 = 0 THEN 'Vendor' || CAST(user_id AS VARCHAR) || '@Example.COM' END AS customer_email FROM events)"""

_FOLD = f"""{_PARSE}, {_CUST},
 h AS (SELECT * FROM p WHERE type IN ({HANDLED})),
 links AS (SELECT c.event_id, pg.usuario_id, c.customer_id, c.subscription_id FROM h c
   JOIN v_payments pg ON CAST(pg.id AS VARCHAR) = c.pago_id WHERE c.type = 'checkout.session.completed'),
 by_mail AS (SELECT lower(email) AS mail, MIN(id) AS uid FROM v_users GROUP BY 1),
 ordered AS MATERIALIZED (SELECT h.event_id, h.type, h.subscription_id AS sid, h.customer_id AS cid, l.usuario_id AS linked, bm.uid AS mailed,
   row_number() OVER (ORDER BY h.event_id) AS n FROM h LEFT JOIN links l ON l.event_id = h.event_id
   LEFT JOIN cust ON cust.customer_id = h.customer_id LEFT JOIN by_mail bm ON bm.mail = lower(cust.customer_email)),
 t0 AS MATERIALIZED (SELECT list(id ORDER BY id) AS ids, list(stripe_subscription_id ORDER BY id) AS subs,
   list(stripe_customer_id ORDER BY id) AS cuss FROM v_users),
 walk(n, event_id, hit, subs, cuss) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), subs, cuss FROM t0
   UNION ALL SELECT n, event_id, hit,
     CASE WHEN type IN ('checkout.session.completed', 'invoice.payment_succeeded') AND len(hit) > 0 AND sid IS NOT NULL
       THEN list_transform(subs, lambda x, i: CASE WHEN ids[i] = hit[1] THEN sid ELSE x END) ELSE subs END,
     CASE WHEN type = 'checkout.session.completed' AND len(hit) > 0 AND cid IS NOT NULL
       THEN list_transform(cuss, lambda x, i: CASE WHEN ids[i] = hit[1] THEN cid ELSE x END) ELSE cuss END
   FROM (SELECT o.*, w.subs, w.cuss, t0.ids, CASE
       WHEN o.type = 'checkout.session.completed' THEN CASE WHEN o.linked IS NULL THEN [] ELSE [o.linked] END
       WHEN o.type = 'invoice.payment_succeeded' THEN CASE WHEN list_contains(w.subs, o.sid) THEN [t0.ids[list_position(w.subs, o.sid)]]
         WHEN list_contains(w.cuss, o.cid) THEN [t0.ids[list_position(w.cuss, o.cid)]]
         WHEN o.mailed IS NOT NULL THEN [o.mailed] ELSE [] END
       WHEN list_contains(w.subs, o.sid) THEN list_filter(t0.ids, lambda x, i: w.subs[i] = o.sid) ELSE [] END AS hit
     FROM walk w JOIN ordered o ON o.n = w.n + 1, t0)),
 routed AS MATERIALIZED (SELECT event_id, UNNEST(hit) AS uid FROM walk),
 ev AS MATERIALIZED (SELECT r.uid, h.event_id, h.type, h.ts, h.subscription_id AS sid, h.customer_id AS cid,
   h.period_end,
   {_PLAN.format(x="h.price_id")} AS eplan,
   COALESCE(h.payment_status IN ('paid', 'no_payment_required'), false) AS pay_ok,
   CASE h.status WHEN 'canceled' THEN 'cancelada' WHEN 'unpaid' THEN 'pago_fallido' WHEN 'paused' THEN 'pausada'
     WHEN 'past_due' THEN 'pago_fallido' END AS mapped,
   CAST(h.pago_id AS BIGINT) AS pago_id,
   row_number() OVER (PARTITION BY r.uid ORDER BY h.event_id) AS rn
   FROM routed r JOIN h ON h.event_id = r.event_id),
 pend0 AS (SELECT usuario_id AS uid, list(id ORDER BY creado_en DESC, id DESC) AS pend FROM v_payments
   WHERE estado = 'pendiente' GROUP BY 1),
 f(uid, rn, estado, plan, inicio, fin, sub, cus, pend, settled) AS (
   SELECT u.id, CAST(0 AS BIGINT), u.suscripcion_estado, u.suscripcion_plan, CAST(NULL AS TIMESTAMP),
     CAST(u.suscripcion_fin AS TIMESTAMP), u.stripe_subscription_id, u.stripe_customer_id,
     COALESCE(pend0.pend, CAST([] AS BIGINT[])), CAST([] AS STRUCT(pago_id BIGINT, event_id BIGINT)[])
   FROM v_users u LEFT JOIN pend0 ON pend0.uid = u.id
   UNION ALL
   SELECT uid, rn,
     CASE WHEN chk_paid OR resolved THEN 'activa'
       WHEN type = 'invoice.payment_failed' AND mtch THEN 'pago_fallido'
       WHEN type = 'customer.subscription.deleted' AND mtch THEN 'cancelada'
       WHEN type = 'customer.subscription.updated' AND mtch AND mapped IS NOT NULL THEN mapped ELSE estado END,
     CASE WHEN chk_paid OR resolved THEN eplan ELSE splan END,
     CASE WHEN chk_paid OR resolved THEN COALESCE(inicio, ts) ELSE inicio END,
     CASE WHEN chk_paid OR resolved THEN COALESCE(period_end, fin, ts + INTERVAL 1 MONTH) ELSE fin END,
     CASE WHEN chk_paid OR resolved THEN COALESCE(sid, lsub) ELSE lsub END,
     CASE WHEN type = 'checkout.session.completed' THEN COALESCE(cid, cus) ELSE cus END,
     CASE WHEN chk_paid AND list_contains(pend, pago_id) THEN list_filter(pend, lambda x: x <> pago_id)
       WHEN resolved AND len(pend) > 0 THEN pend[2:] ELSE pend END,
     CASE WHEN chk_paid AND list_contains(pend, pago_id)
         THEN list_append(settled, {{'pago_id': pago_id, 'event_id': event_id}})
       WHEN resolved AND len(pend) > 0 THEN list_append(settled, {{'pago_id': pend[1], 'event_id': event_id}})
       ELSE settled END
   FROM (SELECT f.uid, e.rn, f.estado, f.plan AS splan, f.inicio, f.fin, f.sub, f.cus, f.pend, f.settled,
       e.type, e.ts, e.sid, e.cid, e.period_end, e.eplan, e.mapped, e.pago_id, e.event_id,
       CASE WHEN e.type = 'checkout.session.completed' THEN COALESCE(e.sid, f.sub) ELSE f.sub END AS lsub,
       e.type = 'invoice.payment_succeeded' AS resolved,
       (e.type = 'checkout.session.completed' AND e.pay_ok) AS chk_paid,
       COALESCE(e.sid IS NOT NULL AND f.sub = e.sid, false) AS mtch
     FROM f JOIN ev e ON e.uid = f.uid AND e.rn = f.rn + 1)),
 last AS (SELECT f.* FROM f JOIN (SELECT uid, MAX(rn) AS m FROM f GROUP BY uid) x ON x.uid = f.uid AND x.m = f.rn)"""

ORACLES = {
    "billing_events_parsed": f"WITH {_PARSE} SELECT * FROM p",

    "billing_event_counts": f"""SELECT CAST(ts AS DATE) AS dia, type, COUNT(*) AS eventos, type IN ({HANDLED}) AS manejado
FROM v_billing GROUP BY 1, 2""",

    "event_user_resolved": f"""WITH {_PARSE}, {_CUST},
 by_mail AS (SELECT lower(email) AS mail, MIN(id) AS uid FROM v_users GROUP BY 1),
 j AS (SELECT p.event_id, us.id AS u_sub, uc.id AS u_cus, bm.uid AS u_mail FROM p
   LEFT JOIN v_users us ON us.stripe_subscription_id = p.subscription_id
   LEFT JOIN v_users uc ON uc.stripe_customer_id = p.customer_id
   LEFT JOIN cust ON cust.customer_id = p.customer_id LEFT JOIN by_mail bm ON bm.mail = lower(cust.customer_email)
   WHERE p.type = 'invoice.payment_succeeded')
SELECT event_id, COALESCE(u_sub, u_cus, u_mail) AS usuario_id,
 CASE WHEN u_sub IS NOT NULL THEN 'subscription' WHEN u_cus IS NOT NULL THEN 'customer' ELSE 'email' END AS via
FROM j WHERE COALESCE(u_sub, u_cus, u_mail) IS NOT NULL""",

    "plan_from_price": f"""WITH {_PARSE} SELECT event_id, type, price_id, {_PLAN.format(x="price_id")} AS plan FROM p
WHERE type IN ('checkout.session.completed', 'invoice.payment_succeeded')""",

    "checkout_payment_link": f"""WITH {_PARSE} SELECT p.event_id, p.ts, p.pago_id, pg.usuario_id, p.customer_id,
 p.subscription_id, COALESCE(p.payment_status IN ('paid', 'no_payment_required'), false) AS pagado,
 {_PLAN.format(x="p.price_id")} AS plan
FROM p LEFT JOIN v_payments pg ON CAST(pg.id AS VARCHAR) = p.pago_id WHERE p.type = 'checkout.session.completed'""",

    "subscription_state": f"""WITH RECURSIVE {_FOLD}
SELECT uid AS id, estado AS suscripcion_estado, plan AS suscripcion_plan, inicio AS suscripcion_inicio,
 fin AS suscripcion_fin, sub AS stripe_subscription_id, cus AS stripe_customer_id FROM last""",

    "pending_payment_match": f"""WITH RECURSIVE {_FOLD},
 s AS (SELECT UNNEST(settled, recursive := true) FROM last)
SELECT pg.id, pg.usuario_id, CASE WHEN s.event_id IS NOT NULL THEN 'pagado' ELSE pg.estado END AS estado,
 CASE WHEN s.event_id IS NOT NULL THEN 'card' END AS metodo, s.event_id AS evento
FROM v_payments pg LEFT JOIN s ON s.pago_id = pg.id""",

    "rate_limit_violations": """SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS inicio, COUNT(*) AS solicitudes
FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1""",
}

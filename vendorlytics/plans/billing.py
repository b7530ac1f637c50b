"""Subscription-billing events as batch jobs.

Events are the payment provider's webhook bodies (type + JSON object).
Arrival order is ``event_id``. The state of each user (status, plan, start,
end, subscription and customer ids, pending payments) is an ordered fold
over the user's events; see ``subscription_fold``.

Events are routed to users by who holds their ids when they arrive
(``route_events``), so ids that move between users are handled as the
reference does; ids may be of any type.
"""

from __future__ import annotations

import calendar
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.operators.asof import START, as_of, time_segments
from vendorlytics.session import materialize
from vendorlytics.sources.tables import Tables

# Fixed values (reference handlers).
HANDLED = ["checkout.session.completed", "invoice.payment_succeeded", "invoice.payment_failed",
           "customer.subscription.deleted", "customer.subscription.updated"]
PAID_STATUSES = ["paid", "no_payment_required"]
UPDATED_STATUS_MAP = {"canceled": "cancelada", "unpaid": "pago_fallido", "paused": "pausada",
                      "past_due": "pago_fallido"}
DEFAULT_PLAN = "mini"
# Price ids are configuration; these are the fixture's.
PRICE_PLANS = {"price_pro": "pro", "price_adv": "avanzado"}
RATE_LIMIT = 10
RATE_WINDOW = "15 minutes"

CHECKOUT, PAID, FAILED, DELETED, UPDATED = HANDLED


def _lit_map(d: dict) -> F.Column:
    return F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


# The event body, parsed once. Fields that are "id" or {"id": ...} are read
# as text (an object arrives as its JSON text) and resolved by ``_id_of``.
OBJECT_SCHEMA = (
    "id string, customer string, subscription string, status string, payment_status string, "
    "metadata struct<pago_id: string, price_id: string>, "
    "parent struct<subscription_details: struct<subscription: string>>, "
    "lines struct<data: array<struct<subscription: string, period: struct<`end`: bigint>, "
    "price: struct<id: string>, plan: struct<id: string>>>>")


def _epoch_ntz(seconds) -> F.Column:
    """Epoch seconds as a wall-clock UTC timestamp, whatever the session
    time zone (``timestamp_seconds`` would be shifted by a cast to NTZ)."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _id_of(ref) -> F.Column:
    """A provider reference that is either "id" or {"id": ...}."""
    return F.when(ref.startswith("{"), F.get_json_object(ref, "$.id")).otherwise(ref)


def plan_from_price(price_id, price_plans: dict = PRICE_PLANS) -> F.Column:
    """Price id -> plan ('mini' when unknown or missing)."""
    return F.coalesce(F.try_element_at(_lit_map(price_plans), price_id), F.lit(DEFAULT_PLAN))


# -- B1 -------------------------------------------------------------------
def parse_events(ev: DataFrame) -> DataFrame:
    """B1: typed fields out of the event body (both id shapes), one parse
    per event."""
    o = F.col("o")
    lines = o["lines"]["data"]
    sub_line = F.get(F.filter(lines, lambda l: l["subscription"].isNotNull()), 0)
    period_line = F.get(F.filter(lines, lambda l: l["period"]["end"].isNotNull()), 0)
    invoice = F.col("type").startswith("invoice.")
    checkout = F.col("type") == CHECKOUT
    subscription = F.col("type").startswith("customer.subscription.")
    sub_id = (F.when(invoice, F.coalesce(_id_of(o["parent"]["subscription_details"]["subscription"]),
                                         _id_of(sub_line["subscription"])))
              .when(checkout, _id_of(o["subscription"]))
              .when(subscription, o["id"]))
    price = F.when(invoice, F.coalesce(period_line["price"]["id"], period_line["plan"]["id"])) \
        .when(checkout, o["metadata"]["price_id"])
    seg = [c for c in ("seg",) if c in ev.columns]  # time segments pass through
    parsed = ev.select("event_id", "ts", "user_id", "type", F.from_json("object", OBJECT_SCHEMA).alias("o"), *seg)
    return parsed.select(
        "event_id", "ts", "user_id", "type",
        F.when(~subscription, _id_of(F.col("o.customer"))).alias("customer_id"),
        sub_id.alias("subscription_id"),
        _epoch_ntz(period_line["period"]["end"]).alias("period_end"),
        price.alias("price_id"),
        F.when(checkout, F.col("o.payment_status")).alias("payment_status"),
        F.when(checkout, F.col("o.metadata.pago_id")).alias("pago_id"),
        F.when(subscription, F.col("o.status")).alias("status"), *seg)


def billing_events_parsed(t: Tables) -> DataFrame:
    return parse_events(t.billing())


# -- B2 / B4 --------------------------------------------------------------
def billing_event_counts(t: Tables) -> DataFrame:
    """B2: events per day and type; types outside the five handled ones are
    ignored by the handler."""
    b = t.billing()
    return (b.groupBy(F.to_date("ts").alias("dia"), "type")
            .agg(F.count(F.lit(1)).alias("eventos"))
            .withColumn("manejado", F.col("type").isin(*HANDLED)))


def event_plans(t: Tables) -> DataFrame:
    """B4 applied: plan of every paid invoice and checkout."""
    p = parse_events(t.billing()).where(F.col("type").isin(CHECKOUT, PAID))
    return p.select("event_id", "type", "price_id", plan_from_price(F.col("price_id")).alias("plan"))


# -- routing (B3) -----------------------------------------------------------
def customer_emails(t: Tables) -> DataFrame:
    """Fixture: the provider's customer records (id -> e-mail), one per
    event user; every second one has an e-mail in mixed case."""
    u = t.read("events").select("user_id").distinct()
    return u.select(F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_id"),
                    F.when(F.col("user_id") % 2 == 0,
                           F.concat(F.lit("Vendor"), F.col("user_id").cast("string"), F.lit("@Example.COM")))
                    .alias("customer_email"))


def checkout_links(parsed: DataFrame, payments: DataFrame) -> DataFrame:
    """Checkout session -> pago (metadata id) -> user; ids to store."""
    c = parsed.where(F.col("type") == CHECKOUT)
    p = payments.select(F.col("id").cast("string").alias("pago_id"), "usuario_id")
    return c.join(p, "pago_id", "left").select(
        "event_id", "ts", "pago_id", "usuario_id", "customer_id", "subscription_id",
        F.col("payment_status").isin(*PAID_STATUSES).alias("pagado"),
        plan_from_price(F.col("price_id")).alias("plan"), *[c for c in ("seg",) if c in parsed.columns])


def checkout_payment_link(t: Tables) -> DataFrame:
    return checkout_links(parse_events(t.billing()), t.payments())


def _holders(state: DataFrame, links: DataFrame, seg: str | None = "seg") -> DataFrame:
    """Who holds which provider id from when on: one mark (held, uid, since,
    seg, on) where a run of equal ids in a user's history begins (on) and
    where the next one ends it. A link counts for the events after it;
    ``since`` NULL is the stored state."""
    stored = state.where(F.col("held").isNotNull()).select(
        "uid", "held", F.lit(None).cast(links.schema["since"].dataType).alias("since"), F.lit(START).alias("seg"))
    links = links.where(F.col("held").isNotNull()).select("uid", "held", "since", "seg")
    if seg is not None:  # a link to the id of the link before, in one segment, begins no run
        before = F.lag("held").over(Window.partitionBy("uid", "seg").orderBy("since"))
        links = links.withColumn("before", before).where("before is null or before <> held").drop("before")
    history = stored.unionByName(links).withColumnRenamed("held", "prev")
    runs = as_of(links, history, ["uid"], "since", "prev", seg).where("prev is null or prev <> held")
    marks = F.array(F.struct("held", F.lit(True).alias("on")), F.struct(F.col("prev").alias("held"), F.lit(False).alias("on")))
    marks = runs.select("uid", "since", "seg", F.explode(marks).alias("m")).select("m.held", "uid", "since", "seg", "m.on").where("held is not null")
    return marks.unionByName(stored.withColumn("on", F.lit(True)))


def _holder_of(events: DataFrame, event_key: str, holders: DataFrame, seg: str | None = "seg") -> DataFrame:
    """(event_id, uid) for every user that holds the event's id when it
    arrives: of the users that ever hold it, those whose last mark is on. Only
    users that also lose the id are matched as of the event; others hold it
    from their first mark on."""
    ever = holders.groupBy("held", "uid").agg(F.min("on").alias("kept"), F.min("since").alias("first"), F.max(F.col("since").isNull()).alias("start"))
    asked = events.select(F.col("event_id").alias("since"), "seg", F.col(event_key).alias("held")).join(ever, "held")
    kept = asked.where("kept and (first < since or start and since is not null)")
    lost = ever.where("not kept").select("held", "uid")
    moved = as_of(asked.where("not kept").drop("kept", "first", "start"), holders.join(lost, ["held", "uid"], "left_semi"), ["held", "uid"], "since", "on", seg).where("on")
    return kept.select("since", "uid").unionByName(moved.select("since", "uid")).withColumnRenamed("since", "event_id")


def _held_for_sure(links: DataFrame, state: DataFrame, asked: DataFrame) -> DataFrame:
    """``links`` and ``asked`` (uid, held, since, seg: links that may be given)
    in one line a user, with the flag ``sure``: the user holds the id already,
    whichever of ``asked`` become links. That is so inside a run of one id, in
    the user's line of stored state, links and asked links, after the first
    stored state or link of the run. Lines of one time with unlike ids are
    never sure, nor is what follows up to the next link."""
    cols = ["uid", "held", "since", "seg", "link"]
    stored = state.select("uid", "held", F.lit(None).cast(links.schema["since"].dataType).alias("since"), F.lit(START).alias("seg"), F.lit(True).alias("link"))
    line = stored.unionByName(links.withColumn("link", F.lit(True))).unionByName(asked.withColumn("link", F.lit(False))) \
        .where("held is not null").select(*cols).repartition("uid")
    tie = Window.partitionBy("uid", "since")
    line = line.withColumns({"lo": F.min("held").over(tie), "hi": F.max("held").over(tie)})
    order = Window.partitionBy("uid").orderBy(F.col("since").asc_nulls_first())
    same = (F.col("lo") == F.col("hi")) & (F.lag("lo").over(order) == F.col("lo")) & (F.lag("hi").over(order) == F.col("hi"))
    line = line.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    line = line.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy("uid", "run").orderBy(F.col("since").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col("link"), F.struct("since"))).over(run)["since"]
    begun = F.max(F.col("link") & F.col("since").isNull()).over(run)
    return line.withColumn("sure", F.coalesce(F.col("since").isNotNull() & (begun | (first < F.col("since"))), F.lit(False))) \
        .where("seg <> %d" % START).select(*cols, "sure")


def _unheld(asked: DataFrame, holders: DataFrame) -> DataFrame:
    """``asked`` (event_id, held, ...) with ``free``: no user holds the id when
    the event arrives, nor an id of another row with the same event_id. Users
    are counted in one line an id, not paired with its events."""
    marks = holders.where("uid is not null").select("held", "uid", "since", "on", F.lit(1).alias("mark"))
    line = asked.withColumn("since", F.col("event_id")).withColumn("mark", F.lit(0)).unionByName(
        marks.withColumnRenamed("uid", "holder"), allowMissingColumns=True).repartition("held")
    time = [F.col("since").asc_nulls_first(), "mark"]
    was = F.coalesce(F.lag("on").over(Window.partitionBy("held", "holder").orderBy(*time)), F.lit(False))
    line = line.withColumn("step", F.when(F.col("mark") == 1, F.col("on").cast("int") - was.cast("int")).otherwise(0))
    users = F.sum("step").over(Window.partitionBy("held").orderBy(*time).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("users", users).where("mark = 0")
    return line.withColumn("free", F.max("users").over(Window.partitionBy("event_id")) == 0).select(*asked.columns, "free")


def route_events(parsed: DataFrame, users: DataFrame, payments: DataFrame, customers: DataFrame) -> DataFrame:
    """Event -> user at the time of the event (arrival order = event_id).

    Checkout: the user of its pago. Paid invoice: exactly one user, the first
    found of the holder of its subscription id, the holder of its customer
    id, and the user with the customer's e-mail (smallest id among equals).
    Failed / deleted / updated: every holder of the subscription id.
    Unroutable events are dropped, as the reference drops unresolved ones.

    A paid invoice found by customer or e-mail gives its user the invoice's
    subscription id, which later events see. Which invoices give one is
    iterated until it no longer changes: it depends on earlier events only, so
    each round settles at least the earliest unsettled invoice, and the result
    is the sequential one. A round is written once, with the flag of the round
    before beside its own; so the comparison is a scan of what was written.

    ``parsed`` has the time segments of its events (``seg``). Matches that run
    once go by them (``as_of``), so neither a user nor an id with a third of
    the events is one task's work; in the rounds a user's links, and the
    invoices of one id, are one sorted pass each."""
    links = checkout_links(parsed, payments).join(users.select(F.col("id").alias("usuario_id")), "usuario_id", "left_semi")
    links = materialize(links.select("event_id", "usuario_id", "subscription_id", "customer_id", "seg"), "billing-checkouts")
    state = users.select(F.col("id").alias("uid"), F.col("stripe_subscription_id").alias("sid"),
                         F.col("stripe_customer_id").alias("cid"))
    chk = links.select(F.col("usuario_id").alias("uid"), F.col("event_id").alias("since"),
                       "seg", "subscription_id", "customer_id")
    chk_sub = chk.select("uid", F.col("subscription_id").alias("held"), "since", "seg")
    chk_cus = chk.select("uid", F.col("customer_id").alias("held"), "since", "seg")
    sub_state, cus_state = state.withColumnRenamed("sid", "held"), state.withColumnRenamed("cid", "held")

    paid = parsed.where(F.col("type") == PAID)
    by_email = users.groupBy(F.lower("email").alias("mail")).agg(F.min("id").alias("uid"))
    mail = paid.select("event_id", "customer_id").join(customers, "customer_id") \
        .where(F.col("customer_email").isNotNull()) \
        .join(by_email, F.lower("customer_email") == by_email.mail).select("event_id", "uid")
    via_cus = _holder_of(paid, "customer_id", materialize(_holders(cus_state, chk_cus), "billing-customers"))
    fallback = via_cus.groupBy("event_id").agg(F.min("uid").alias("u_cus")) \
        .join(mail.groupBy("event_id").agg(F.min("uid").alias("u_mail")), "event_id", "full") \
        .select("event_id", F.coalesce("u_cus", "u_mail").alias("u_other"))
    paid = materialize(paid.select("event_id", "seg", "subscription_id").join(fallback, "event_id", "left"), "billing-paid")
    # Only invoices that could give an id are asked in the rounds, and of these
    # and the links only those whose user doesn't hold the id already.
    may = paid.where(F.col("u_other").isNotNull() & F.col("subscription_id").isNotNull())
    line = _held_for_sure(chk_sub, sub_state, may.select(F.col("u_other").alias("uid"), F.col("subscription_id").alias("held"),
                                                        F.col("event_id").alias("since"), "seg"))
    line = materialize(line.where(~F.col("sure")).drop("sure"), "billing-links")
    chk_sub = line.where("link").drop("link")
    found = line.where(~F.col("link")).select(F.col("since").alias("event_id"), "uid", "held", "seg", F.lit(False).alias("gives"))
    while True:
        links_now = chk_sub.unionByName(found.where("gives").select("uid", "held", F.col("event_id").alias("since"), "seg"))
        asked = found.select("event_id", "uid", "held", "seg", F.col("gives").alias("gave"))
        found = materialize(_unheld(asked, _holders(sub_state, links_now, None)).withColumnRenamed("free", "gives"), "billing-found")
        if found.where("gives <> gave").isEmpty():
            break

    holders = materialize(_holders(sub_state, links_now), "billing-holders")
    by_sub = _holder_of(paid, "subscription_id", holders, None).groupBy("event_id").agg(F.min("uid").alias("u_sub"))
    resolved = paid.select("event_id", "u_other").join(by_sub, "event_id", "left") \
        .select("event_id", F.coalesce("u_sub", "u_other").alias("uid")).where(F.col("uid").isNotNull())
    other = parsed.where(F.col("type").isin(FAILED, DELETED, UPDATED))
    return links.select("event_id", F.col("usuario_id").alias("uid")).unionByName(resolved) \
        .unionByName(_holder_of(other, "subscription_id", holders))


def event_user_resolved(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """Paid invoices -> user by subscription id, else customer id, else
    e-mail (snapshot ids); unresolved invoices are dropped."""
    users = t.users()
    paid = parse_events(t.billing()).where(F.col("type") == PAID)
    by_sub = users.select(F.col("id").alias("u_sub"), F.col("stripe_subscription_id").alias("subscription_id"))
    by_cus = users.select(F.col("id").alias("u_cus"), F.col("stripe_customer_id").alias("customer_id"))
    by_mail = users.groupBy(F.lower("email").alias("mail")).agg(F.min("id").alias("u_mail"))
    j = (paid.join(by_sub, "subscription_id", "left").join(by_cus, "customer_id", "left")
         .join(customers if customers is not None else customer_emails(t), "customer_id", "left")
         .join(by_mail, F.lower(F.col("customer_email")) == by_mail.mail, "left"))
    uid = F.coalesce("u_sub", "u_cus", "u_mail")
    via = (F.when(F.col("u_sub").isNotNull(), "subscription").when(F.col("u_cus").isNotNull(), "customer")
           .when(F.col("u_mail").isNotNull(), "email"))
    return j.where(uid.isNotNull()).select("event_id", uid.alias("usuario_id"), via.alias("via"))


# -- B5 / B6: the per-user fold ---------------------------------------------
def fold_inputs(t: Tables, events: DataFrame | None = None, users: DataFrame | None = None,
                payments: DataFrame | None = None, customers: DataFrame | None = None):
    """(user event rows, initial user states, pending pagos) for the fold."""
    events = events if events is not None else t.billing()
    users = users if users is not None else t.users()
    payments = payments if payments is not None else t.payments()
    # Parsed once: routing and the fold read it several times. With the
    # segments of arrival for as-of matching; bodies aren't moved for them.
    parsed = materialize(parse_events(time_segments(events.where(F.col("type").isin(*HANDLED)), "event_id")), "billing-parsed")
    customers = customers if customers is not None else customer_emails(t)
    ev = route_events(parsed, users, payments, customers).join(parsed, "event_id")
    ev = ev.select(
        "uid", "event_id", "type", "ts", "subscription_id", "customer_id",
        "period_end", plan_from_price(F.col("price_id")).alias("plan"),
        F.coalesce(F.col("payment_status").isin(*PAID_STATUSES), F.lit(False)).alias("pay_ok"),
        F.try_element_at(_lit_map(UPDATED_STATUS_MAP), F.col("status")).alias("mapped"),
        F.col("pago_id").try_cast(payments.schema["id"].dataType).alias("pago_id"))
    init = users.select(F.col("id").alias("uid"), F.col("suscripcion_estado").alias("estado"),
                        F.col("suscripcion_plan").alias("plan"),
                        (F.col("suscripcion_inicio") if "suscripcion_inicio" in users.columns
                         else F.lit(None)).cast("timestamp_ntz").alias("inicio"),
                        F.col("suscripcion_fin").cast("timestamp_ntz").alias("fin"),
                        F.col("stripe_subscription_id").alias("sub"), F.col("stripe_customer_id").alias("cus"))
    pend = payments.where(F.col("estado") == "pendiente").select(
        F.col("usuario_id").alias("uid"), "creado_en", F.col("id").alias("pago_id"))
    return ev, init, pend


def _step(acc, e):
    """One event applied to a user's state (Column expressions)."""
    kind = e["type"]
    is_chk, is_paid = kind == CHECKOUT, kind == PAID
    resolved = is_paid  # routed to this user: already resolved at its time
    chk_paid = is_chk & e["pay_ok"]
    activate = chk_paid | resolved
    match = F.coalesce(e["subscription_id"].isNotNull() & (acc["sub"] == e["subscription_id"]), F.lit(False))
    linked_sub = F.when(is_chk, F.coalesce(e["subscription_id"], acc["sub"])).otherwise(acc["sub"])
    linked_cus = F.when(is_chk, F.coalesce(e["customer_id"], acc["cus"])).otherwise(acc["cus"])
    estado = (F.when(activate, F.lit("activa"))
              .when((kind == FAILED) & match, F.lit("pago_fallido"))
              .when((kind == DELETED) & match, F.lit("cancelada"))
              .when((kind == UPDATED) & match & e["mapped"].isNotNull(), e["mapped"])
              .otherwise(acc["estado"]))
    pend = acc["pend"]
    has_pago = F.exists(pend, lambda p: p["pago_id"] == e["pago_id"])
    settle_chk = chk_paid & has_pago
    settle_inv = resolved & (F.size(pend) > 0)
    new_pend = (F.when(settle_chk, F.filter(pend, lambda p: p["pago_id"] != e["pago_id"]))
                .when(settle_inv, F.slice(pend, 2, F.greatest(F.size(pend) - 1, F.lit(0))))
                .otherwise(pend))
    settled = (F.when(settle_chk, F.array_append(acc["settled"], F.struct(e["pago_id"].alias("pago_id"),
                                                                           e["event_id"].alias("event_id"))))
               .when(settle_inv, F.array_append(acc["settled"], F.struct(pend[0]["pago_id"].alias("pago_id"),
                                                                          e["event_id"].alias("event_id"))))
               .otherwise(acc["settled"]))
    return F.struct(
        estado.alias("estado"),
        F.when(activate, e["plan"]).otherwise(acc["plan"]).alias("plan"),
        F.when(activate, F.coalesce(acc["inicio"], e["ts"])).otherwise(acc["inicio"]).alias("inicio"),
        F.when(activate, F.coalesce(e["period_end"], acc["fin"], e["ts"] + F.expr("INTERVAL 1 MONTH")))
         .otherwise(acc["fin"]).alias("fin"),
        F.when(activate, F.coalesce(e["subscription_id"], linked_sub)).otherwise(linked_sub).alias("sub"),
        linked_cus.alias("cus"),
        new_pend.alias("pend"),
        settled.alias("settled"))


MAX_EVENTS = 2048
_EV_FIELDS = ["event_id", "type", "ts", "subscription_id", "customer_id", "period_end", "plan", "pay_ok",
              "mapped", "pago_id"]
_STATE_FIELDS = ["estado", "plan", "inicio", "fin", "sub", "cus"]


def _next_month(ts):
    year, month = ts.year + ts.month // 12, ts.month % 12 + 1
    return ts.replace(year=year, month=month, day=min(ts.day, calendar.monthrange(year, month)[1]))


def _fold_stream(batches):
    """Python twin of ``_step`` for users with very many events: rows of one
    user arrive together, sorted as state (kind 0), pending pagos newest
    first (kind 1), events by id (kind 2); only the state is kept."""
    import pyarrow as pa

    out, schema = [], None
    uid, st, pend, live, gone, head, settled = None, None, [], set(), set(), 0, []

    def flush():
        if uid is not None:
            out.append({"uid": uid, **st, "pago_id": None, "event_id": None, "kind": 0})
            for p, e in settled:
                out.append({"uid": uid, **{k: None for k in _STATE_FIELDS}, "pago_id": p, "event_id": e, "kind": 1})

    for batch in batches:
        of = batch.schema.field
        schema = pa.schema([("uid", of("uid").type), *[(k, of("s_" + k).type) for k in _STATE_FIELDS],
                            ("pago_id", of("pago_id").type), ("event_id", of("event_id").type), ("kind", pa.int32())])
        for r in batch.to_pylist():
            if r["uid"] != uid:
                flush()
                uid, st, pend, live, gone, head, settled = r["uid"], None, [], set(), set(), 0, []
            kind = r["kind"]
            if kind == 0:
                st = {k: r["s_" + k] for k in _STATE_FIELDS}
                continue
            if kind == 1:
                pend.append(r["pago_id"])
                live.add(r["pago_id"])
                continue
            e = {k: r[k] for k in _EV_FIELDS}
            sid, cid, typ = e["subscription_id"], e["customer_id"], e["type"]
            resolved = typ == PAID
            chk_paid = typ == CHECKOUT and bool(e["pay_ok"])
            activate = chk_paid or resolved
            match = sid is not None and st["sub"] == sid
            linked_sub = (sid if sid is not None else st["sub"]) if typ == CHECKOUT else st["sub"]
            linked_cus = (cid if cid is not None else st["cus"]) if typ == CHECKOUT else st["cus"]
            if activate:
                st["estado"] = "activa"
            elif match and typ == FAILED:
                st["estado"] = "pago_fallido"
            elif match and typ == DELETED:
                st["estado"] = "cancelada"
            elif match and typ == UPDATED and e["mapped"] is not None:
                st["estado"] = e["mapped"]
            while head < len(pend) and pend[head] in gone:
                head += 1
            if chk_paid and e["pago_id"] is not None and e["pago_id"] in live:
                live.discard(e["pago_id"])
                gone.add(e["pago_id"])
                settled.append((e["pago_id"], e["event_id"]))
            elif resolved and head < len(pend):
                live.discard(pend[head])
                gone.add(pend[head])
                settled.append((pend[head], e["event_id"]))
            if activate:
                ts = e["ts"]
                st["plan"] = e["plan"]
                st["inicio"] = st["inicio"] if st["inicio"] is not None else ts
                st["fin"] = next(x for x in (e["period_end"], st["fin"], _next_month(ts))
                                 if x is not None)
                st["sub"] = sid if sid is not None else linked_sub
            else:
                st["sub"] = linked_sub
            st["cus"] = linked_cus
        if len(out) > 10000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    flush()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def subscription_fold(t: Tables, events: DataFrame | None = None, users: DataFrame | None = None,
                      payments: DataFrame | None = None, max_events: int = MAX_EVENTS,
                      customers: DataFrame | None = None) -> DataFrame:
    """B5 + B6: fold each user's events (arrival order) over their state.

    Returns one row per user: estado, plan, inicio, fin, sub, cus and the
    list of (pago_id, event_id) settled by this batch. Users with at most
    ``max_events`` events: the list is ordered by ``array_sort`` and folded
    with ``aggregate`` (bounded list). Users with more: a streaming pass over
    their rows sorted by Spark (``_fold_stream``), holding only the state
    and the user's pending pagos. Users without events keep their state.
    """
    ev, init, pend = fold_inputs(t, events, users, payments, customers)
    ev = materialize(ev, "billing-routed")
    uid_t, pago_t, event_t = (f.schema[c].dataType.simpleString()
                              for f, c in ((init, "uid"), (pend, "pago_id"), (ev, "event_id")))
    settled_t = f"array<struct<pago_id:{pago_t},event_id:{event_t}>>"
    counts = ev.groupBy("uid").agg(F.count(F.lit(1)).alias("n_ev"))
    init = init.join(counts, "uid", "left").withColumn("big", F.coalesce(F.col("n_ev") > max_events, F.lit(False)))
    init = materialize(init, "billing-init")
    small_users = init.where(~F.col("big")).drop("big", "n_ev")
    big_users = init.where(F.col("big")).select("uid")

    ev_small = ev.join(big_users, "uid", "left_anti")
    ev_lists = ev_small.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(*_EV_FIELDS))).alias("evs"))
    pend_small = pend.join(big_users, "uid", "left_anti")
    pend_lists = pend_small.groupBy("uid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("creado_en", "pago_id")), asc=False),
                    lambda p: F.struct(p["pago_id"].alias("pago_id"))).alias("pend"))
    s = small_users.join(ev_lists, "uid", "left").join(pend_lists, "uid", "left")
    start = F.struct(
        F.col("estado"), F.col("plan"), F.col("inicio"), F.col("fin"), F.col("sub"), F.col("cus"),
        F.coalesce(F.col("pend"), F.array().cast(f"array<struct<pago_id:{pago_t}>>")).alias("pend"),
        F.array().cast(settled_t).alias("settled"))
    folded = s.select("uid", F.aggregate(F.coalesce("evs", F.array().cast(s.schema["evs"].dataType)),
                                         start, _step).alias("st"))
    small_out = folded.select(F.col("uid").alias("id"), "st.*").drop("pend")
    if big_users.isEmpty():
        return small_out

    # Users with many events: one sorted stream of state, pagos, events.
    big_init = init.where(F.col("big"))
    null = {c: F.lit(None) for c in _EV_FIELDS}
    cols = ["uid", "kind", "order_a"] + [f"s_{k}" for k in _STATE_FIELDS] + _EV_FIELDS
    st_rows = big_init.select("uid", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("order_a"),
                              *[F.col(k).alias(f"s_{k}") for k in _STATE_FIELDS],
                              *[null[c].cast(ev.schema[c].dataType).alias(c) for c in _EV_FIELDS])
    p_rows = pend.join(big_users, "uid").select(
        "uid", F.lit(1).alias("kind"), F.col("creado_en").alias("order_a"),
        *[F.lit(None).cast(init.schema[k].dataType).alias(f"s_{k}") for k in _STATE_FIELDS],
        *[(F.col("pago_id") if c == "pago_id" else null[c].cast(ev.schema[c].dataType)).alias(c)
          for c in _EV_FIELDS])
    e_rows = ev.join(big_users, "uid").select(
        "uid", F.lit(2).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("order_a"),
        *[F.lit(None).cast(init.schema[k].dataType).alias(f"s_{k}") for k in _STATE_FIELDS], *_EV_FIELDS)
    stream_in = (st_rows.select(*cols).unionByName(p_rows.select(*cols)).unionByName(e_rows.select(*cols))
                 .repartition("uid"))
    stream_in = stream_in.sortWithinPartitions(
        "uid", "kind", F.col("order_a").desc_nulls_last(),
        F.when(F.col("kind") == 1, F.col("pago_id")).desc_nulls_last(), "event_id")
    out_schema = (f"uid {uid_t}, estado string, plan string, inicio timestamp_ntz, fin timestamp_ntz, sub string, "
                  f"cus string, pago_id {pago_t}, event_id {event_t}, kind int")
    streamed = stream_in.mapInArrow(_fold_stream, out_schema)
    big_state = streamed.where(F.col("kind") == 0).drop("pago_id", "event_id", "kind")
    big_settled = streamed.where(F.col("kind") == 1).groupBy("uid").agg(
        F.collect_list(F.struct("pago_id", "event_id")).alias("settled"))
    big_out = big_state.join(big_settled, "uid", "left").select(
        F.col("uid").alias("id"), *_STATE_FIELDS,
        F.coalesce("settled", F.array().cast(settled_t)).alias("settled"))
    return small_out.unionByName(big_out)


def subscription_state(t: Tables) -> DataFrame:
    """users' subscription state after the event batch."""
    f = subscription_fold(t)
    return f.select("id", F.col("estado").alias("suscripcion_estado"), F.col("plan").alias("suscripcion_plan"),
                    F.col("inicio").alias("suscripcion_inicio"), F.col("fin").alias("suscripcion_fin"),
                    F.col("sub").alias("stripe_subscription_id"), F.col("cus").alias("stripe_customer_id"))


def pending_payment_match(t: Tables) -> DataFrame:
    """Pagos settled by the batch (paid invoices take the user's newest
    pending pago; paid checkouts their own pago), method 'card'."""
    f = subscription_fold(t)
    s = f.select(F.explode("settled").alias("s")).select("s.pago_id", "s.event_id")
    p = t.payments()
    j = p.join(s, p.id == s.pago_id, "left")
    paid = F.col("event_id").isNotNull()
    return j.select("id", "usuario_id", F.when(paid, "pagado").otherwise(F.col("estado")).alias("estado"),
                    F.when(paid, F.lit("card")).alias("metodo"), F.col("event_id").alias("evento"))


# -- B9 batch -------------------------------------------------------------
def rate_limit_violations(t: Tables, limit: int = RATE_LIMIT) -> DataFrame:
    """Keys with more than ``limit`` requests in a clock-aligned
    15-minute window (fixture: key = user; registered with limit 1)."""
    e = t.read("events")
    w = e.groupBy(F.window(F.col("ts").cast("timestamp"), RATE_WINDOW), "user_id").agg(
        F.count(F.lit(1)).alias("solicitudes"))
    return w.where(F.col("solicitudes") > limit).select(
        "user_id", F.col("window.start").cast("timestamp_ntz").alias("inicio"), "solicitudes")


QUERIES = {
    "billing_events_parsed": billing_events_parsed,
    "billing_event_counts": billing_event_counts,
    "event_user_resolved": event_user_resolved,
    "plan_from_price": event_plans,
    "subscription_state": subscription_state,
    "pending_payment_match": pending_payment_match,
    "checkout_payment_link": checkout_payment_link,
    "rate_limit_violations": rate_limit_violations,
}

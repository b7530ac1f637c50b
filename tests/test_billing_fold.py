"""The streaming path of the subscription fold equals the list path."""

import random

from pyspark.sql import functions as F

from tests.conftest import SMALL
from vendorlytics.plans import billing
from vendorlytics.plans.billing import subscription_fold
from vendorlytics.sources.tables import FixtureTables


def _rows(df):
    return sorted(tuple(r) for r in df.select(
        "id", "estado", "plan", "inicio", "fin", "sub", "cus",
        F.array_sort(F.col("settled")).cast("string").alias("s")).collect())


def test_stream_path_equals_list_path(spark):
    t = FixtureTables(spark, SMALL)
    assert _rows(subscription_fold(t, max_events=0)) == _rows(subscription_fold(t))


def test_invoice_goes_to_one_user_on_text_keys(spark):
    """Subscription before customer before e-mail, at the time of the event."""
    users = spark.createDataFrame(
        [("u1", "a@x", "sub_1", "cus_1"), ("u2", "b@x", None, "cus_9"), ("u3", "C@x", None, None)],
        "id string, email string, stripe_subscription_id string, stripe_customer_id string") \
        .withColumns({"suscripcion_estado": F.lit("pendiente"), "suscripcion_plan": F.lit("mini"),
                      "suscripcion_fin": F.lit(None).cast("date")})
    pays = spark.createDataFrame([("p-1", "u1", "pendiente")], "id string, usuario_id string, estado string") \
        .withColumn("creado_en", F.lit("2024-01-01").cast("timestamp_ntz"))

    def invoice(sub, cus):
        return ('{"customer":"%s","parent":{"subscription_details":{"subscription":"%s"}},"lines":{"data":[]}}' % (cus, sub))

    paid, failed = "invoice.payment_succeeded", "invoice.payment_failed"
    rows = [(1, paid, invoice("sub_1", "cus_9")), (2, failed, invoice("sub_3", "cus_3")),
            (3, paid, invoice("sub_3", "cus_3")), (4, failed, invoice("sub_3", "cus_9"))]
    events = spark.createDataFrame(rows, "event_id int, type string, object string") \
        .withColumn("ts", F.lit("2024-01-31").cast("timestamp_ntz")).withColumn("user_id", F.lit(0))
    customers = spark.createDataFrame([("cus_3", "c@X")], "customer_id string, customer_email string")
    for most in (0, 100):
        out = {r["id"]: r for r in subscription_fold(None, events, users, pays, most, customers).collect()}
        assert [(out[u]["estado"], out[u]["sub"]) for u in ("u1", "u2", "u3")] == [
            ("activa", "sub_1"), ("pendiente", None), ("pago_fallido", "sub_3")]
        assert [tuple(x) for x in out["u1"]["settled"]] == [("p-1", 1)]
        assert str(out["u3"]["fin"]) == "2024-02-29 00:00:00"


PARSED = "event_id int, ts timestamp_ntz, user_id int, type string, customer_id string, subscription_id string, price_id string, payment_status string, pago_id string, seg int"
USERS = "id int, email string, stripe_subscription_id string, stripe_customer_id string"


def _routed(spark, users, pays, events):
    """Events are (event_id, type, customer, subscription, pago)."""
    parsed = spark.createDataFrame([(e, None, 0, kind, cus, sub, None, "paid", pago, e // 25) for e, kind, cus, sub, pago in events], PARSED)
    customers = spark.createDataFrame([("c9", "U0@X")], "customer_id string, customer_email string")
    return billing.route_events(parsed, spark.createDataFrame(users, USERS), spark.createDataFrame(pays, "id int, usuario_id int"), customers)


def _in_sequence(users, pays, events):
    sub, cus, out = {u[0]: u[2] for u in users}, {u[0]: u[3] for u in users}, []
    for e, kind, c, s, pago in sorted(events):
        by_sub = sorted(u for u in sub if s is not None and sub[u] == s)
        if kind == billing.CHECKOUT:
            u = dict(pays).get(int(pago)) if pago else None
            if u in sub:
                out.append((e, u))
                sub[u], cus[u] = s or sub[u], c or cus[u]
        elif kind == billing.PAID:
            found = by_sub or sorted(u for u in cus if c is not None and cus[u] == c) or ([0] if c == "c9" else [])
            if found:
                out.append((e, found[0]))
                sub[found[0]] = s or sub[found[0]]
        else:
            out += [(e, u) for u in by_sub]
    return sorted(out)


def test_routing_equals_the_sequence(spark):
    r = random.Random(3)
    users = [(i, f"u{i}@x", r.choice([None, f"s{i}"]), r.choice([None, f"c{i}"])) for i in range(6)]
    pays = [(i, r.randrange(7)) for i in range(20)]
    events = []
    for e in range(70):
        own = r.randrange(6)
        sub, cus = r.choice([f"s{own}", f"s{own}", f"s{r.randrange(6)}", None]), r.choice([f"c{own}", f"c{own}", f"c{r.randrange(6)}", "c9", None])
        events.append((e, r.choice([billing.CHECKOUT, billing.PAID, billing.PAID, billing.FAILED]), cus, sub, str(r.randrange(25))))
    got = sorted((x["event_id"], x["uid"]) for x in _routed(spark, users, pays, events).collect())
    assert got == _in_sequence(users, pays, events)


def test_rounds_ask_only_invoices_that_may_give(spark, monkeypatch):
    """A user's invoices for the id it surely holds stay out of the rounds."""
    written, plain = [], billing.materialize

    def counted(df, name="stage"):
        out = plain(df, name)
        if name == "billing-found":
            written.append(out.count())
        return out

    monkeypatch.setattr(billing, "materialize", counted)
    users, pays = [(0, "u0@x", "s0", "c0"), (1, "u1@x", None, "c1")], [(1, 1)]
    events = [(0, billing.CHECKOUT, "c1", "s1", "1"), (1, billing.PAID, "c1", "s2", None)]
    events += [(e, billing.PAID, "c0", "s0", None) for e in range(2, 60)] + [(60, billing.PAID, "c1", "s1", None)]
    got = sorted((x["event_id"], x["uid"]) for x in _routed(spark, users, pays, events).collect())
    assert got == _in_sequence(users, pays, events)
    assert written and max(written) == 2

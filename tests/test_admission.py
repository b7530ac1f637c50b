"""W8 (quota + global SKU uniqueness) against a sequential brute force."""

import random

from pyspark.sql import functions as F

from tests.conftest import FakeTables
from vendorlytics.plans.changes_inventory import submit_custom_items
from vendorlytics.sources.requests import SEQ


def brute(reqs, plans, catalog, quota):
    count = {}
    taken = set(catalog)
    out = {}
    for r in sorted(reqs, key=lambda r: r["seq"]):
        v = r["vendor"]
        limited = (plans.get(v) or "mini") == "mini"
        if r["nombre"] is None:
            out[r["seq"]] = "datos_faltantes"
        elif limited and count.get(v, 0) >= quota:
            out[r["seq"]] = "cuota"
        elif r["sku"] in taken:
            out[r["seq"]] = "sku_duplicado"
        else:
            out[r["seq"]] = "ok"
            taken.add(r["sku"])
            count[v] = count.get(v, 0) + 1
    return out


def test_custom_items_match_sequential(spark):
    rnd = random.Random(3)
    plans = {0: "mini", 1: "pro", 2: None, 3: "mini", 4: "avanzado"}
    catalog = ["S0", "S1"]
    reqs = [{"seq": i, "vendor": rnd.randint(0, 4), "sku": f"S{rnd.randint(0, 25)}",
             "nombre": None if rnd.random() < 0.05 else f"n{i}"} for i in range(300)]
    rows = [(r["seq"], 0, 0, r["vendor"], 0, 0.0, 0.0, r["vendor"], r["nombre"], r["sku"], 1, 10.0) for r in reqs]
    req = spark.createDataFrame(rows, "l_shipdate long, l_orderkey long, l_linenumber int, l_suppkey long, "
                                      "l_partkey long, l_quantity double, l_extendedprice double, vendedor_id long, "
                                      "nombre string, sku string, stock int, precio_personalizado double")
    req = req.withColumn("req_id", F.col("l_shipdate").cast("string"))
    users = spark.createDataFrame([(k, v) for k, v in plans.items()], "id long, suscripcion_plan string") \
        .withColumn("marca_id", F.lit(1))
    inv = spark.createDataFrame([], "id long, vendedor_id long, producto_maestro_id long, stock int, "
                                    "precio_personalizado decimal(18,2)")
    products = spark.createDataFrame([(s,) for s in catalog], "sku string")
    t = FakeTables(spark, users=users, inventory=inv, products=products)
    res = submit_custom_items(t, req=req, snapshot=inv, quota=4)
    got = {r["l_shipdate"]: r["resultado"] for r in res.select(SEQ[0], "resultado").collect()}
    assert got == brute(reqs, plans, catalog, 4)


def test_custom_items_write_only_candidates(spark, tmp_path, monkeypatch):
    """The rounds carry the requests that may be accepted, not the batch; a
    request sent twice has its rows, and uses slots, as often as before."""
    from vendorlytics.plans import changes_inventory as ci

    written = []
    monkeypatch.setattr(ci, "materialize", lambda df, name="stage": written.append((name, df.count())) or df)
    plans = {0: "mini", 1: "pro", 2: "mini"}
    reqs = [{"seq": i, "vendor": i % 3, "sku": f"S{i % 7}", "nombre": f"n{i}"} for i in range(420)]
    rows = [(r["seq"], r["seq"], r["vendor"], r["nombre"], r["sku"], 1, 10.0) for r in reqs]
    schema = "seq long, req_id long, vendedor_id long, nombre string, sku string, stock int, precio_personalizado double"
    users = spark.createDataFrame([(k, v) for k, v in plans.items()], "id long, suscripcion_plan string").withColumn("marca_id", F.lit(1))
    inv = spark.createDataFrame([], "id long, vendedor_id long, producto_maestro_id long, stock int, precio_personalizado decimal(18,2)")
    t = FakeTables(spark, users=users, inventory=inv, products=spark.createDataFrame([("S0",)], "sku string"))
    res = submit_custom_items(t, req=spark.createDataFrame(rows, schema), snapshot=inv, quota=2)
    assert {r["seq"]: r["resultado"] for r in res.collect()} == brute(reqs, plans, ["S0"], 2)
    assert written and max(n for _, n in written) <= 30, written

    twice = spark.createDataFrame(rows[:30] + rows[:3], schema)  # vendor 2's request 2 uses both of its slots... twice over
    got = submit_custom_items(t, req=twice, snapshot=inv, quota=2).groupBy("seq").count().collect()
    assert {r["seq"]: r["count"] for r in got} == {i: 4 if i < 3 else 1 for i in range(30)}


def test_long_chain_of_claims_takes_blocks_not_rounds(spark, monkeypatch):
    """Each owner waits for the next one's value: one link a round would be 60
    rounds. Blocks of 90 requests give the sequential answer."""
    from vendorlytics.operators import admission

    rnd = random.Random(11)
    n = 60
    reqs = [(i, (7 * i) % n, i, f"v{((7 * i) + 1) % n}", True, True) for i in range(2 * n)]  # the value after the one's own
    reqs += [(i, rnd.randrange(n), i, rnd.choice([None, *(f"v{k}" for k in range(n + 2))]), rnd.random() > 0.1, rnd.random() > 0.1) for i in range(2 * n, 6 * n)]
    held = {k: f"v{k}" for k in range(n - 1)}
    base = spark.createDataFrame(reqs, "req long, owner long, seq long, value string, pre_ok boolean, post_ok boolean")
    holders = spark.createDataFrame(list(held.items()), "h_owner long, h_value string")
    written = []
    plain = admission.materialize
    monkeypatch.setattr(admission, "materialize", lambda df, name="stage": written.append(name) or plain(df, name))
    got = {r["req"]: (r["blocked"], r["ok"]) for r in admission.unique_claims(base, holders, rounds=2, block_rows=90).collect()}
    want = {}
    for req, owner, _, value, pre, post in reqs:
        blocked = value is not None and any(v == value for o, v in held.items() if o != owner)
        want[req] = (blocked, pre and post and not blocked)
        if value is not None and want[req][1]:
            held[owner] = value
    assert got == want
    assert written.count("admission-flags") <= 4 and written.count("claim-block") == 4

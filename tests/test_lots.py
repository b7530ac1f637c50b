"""Jobs that deal out very many rows do so lot by lot, with the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import FakeTables
from tests.test_fold import brute
from vendorlytics.operators.fold import greedy_consume
from vendorlytics.plans import changes_inventory as ci
from vendorlytics.plans import changes_sales as cs
from vendorlytics.sources.requests import SEQ


def deletion(spark, seed):
    rnd = random.Random(seed)
    snap = [(v * 100 + p, v, p) for v in range(6) for p in range(12) if rnd.random() < 0.7] + [(None, 1, 2), (7, None, 2)]
    reqs = [(i, v, n) for n, (i, v, _) in enumerate(rnd.sample(snap, len(snap)) + snap[:20]) if p_kept(i)] + [(5, 1, 900), (None, 1, 901)]
    sales = [(i,) for i, _, _ in snap if i and i % 17 == 3]
    prod = [(p, p % 3 == 0, p % 6) for p in range(12)]
    t = FakeTables(spark, sales=spark.createDataFrame(sales, "inventario_id long"), products=spark.createDataFrame(prod, "id long, estado boolean, creado_por long"))
    frames = spark.createDataFrame(reqs, "id long, vendedor_id long, seq long"), spark.createDataFrame(snap, "id long, vendedor_id long, producto_maestro_id long")
    first = {}
    for i, v, s in reqs:
        first.setdefault((i, v), s)
    gone = [(first[i, v], v, p) for i, v, p in snap if i and v is not None and (i, v) in first and (i,) not in sales]
    want = set()
    for p, estado, by in prod:
        mine = [(s, v) for s, v, q in gone if q == p]
        if not estado and mine and len(mine) == sum(q == p for _, _, q in snap) and max(mine)[1] == by:
            want.add((p, by))
    return t, *frames, want


def p_kept(i):
    return i is None or i % 11 != 1


def test_deletion_outcomes_lot_by_lot(spark, monkeypatch):
    t, req, snap, _ = deletion(spark, 3)
    made = []
    monkeypatch.setattr(ci, "materialize_lots", lambda s, make, lots, name, f=ci.materialize_lots: made.append(lots) or f(s, make, lots, name))
    whole, lots = ci._outcomes(t, req, snap), ci._outcomes(t, req, snap, lot_rows=20)
    assert made and made[0] > 3
    key = ["id", "vendedor_id", "seq", "resultado", "ventas", "producto_maestro_id"]
    assert sorted(map(str, lots.select(*key).collect())) == sorted(map(str, whole.select(*key).collect()))


@pytest.mark.parametrize("seed,most", [(1, 10**6), (2, 3), (3, 3), (4, 9)])
def test_removed_products(spark, seed, most):
    """Also where only some of each product's rows are looked at first."""
    t, req, snap, want = deletion(spark, seed)
    assert {tuple(r) for r in ci._removed(t, req, snap, most).collect()} == want


def test_cleanup_looks_only_at_products_whose_creator_deletes(spark, monkeypatch):
    """The requests of other products, far more, never meet the snapshot."""
    seen = []
    monkeypatch.setattr(ci, "materialize", lambda df, name="stage", f=ci.materialize: (lambda out: seen.append((name, out.count())) or out)(f(df, name)))
    rows = [(v * 1000 + p, v, p) for v in range(40) for p in range(30)]
    t = FakeTables(spark, sales=spark.createDataFrame([], "inventario_id long"), products=spark.createDataFrame([(p, False, 99 if p else 39) for p in range(30)], "id long, estado boolean, creado_por long"))
    snap = spark.createDataFrame(rows, "id long, vendedor_id long, producto_maestro_id long")
    assert [tuple(r) for r in ci._removed(t, snap.select("id", "vendedor_id", F.col("id").alias("seq")), snap).collect()] == [(0, 39)]
    assert max(n for name, n in seen) <= 40, seen


def test_fold_lot_by_lot(spark, monkeypatch):
    from vendorlytics.operators import fold

    made = []
    monkeypatch.setattr(fold, "materialize_lots", lambda s, make, lots, name, f=fold.materialize_lots: made.append(lots) or f(s, make, lots, name))
    rnd = random.Random(8)
    start = {k: rnd.randint(0, 60) for k in range(12)}
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 13), i, rnd.randint(-2, 15)) for i in range(300)]
    res, final = greedy_consume(spark.createDataFrame(rows, "k long, s long, a long"), spark.createDataFrame(list(start.items()), "k long, b long"),
                                ["k"], ["s"], "a", "b", max_list=20, lot_rows=40)
    want, left = brute(start, rows)
    assert {(r["k"], r["s"]): r["accepted"] for r in res.collect()} == want and {r["k"]: r["b"] for r in final.collect()} == left
    assert made == [8]


def test_sales_write_only_what_is_wanted(spark, monkeypatch):
    """Requests go once, in few columns; unknown clients are refused, a client
    stored twice is a match twice."""
    day = dt.datetime(2001, 1, 1)
    reqs = [(day, n, 1, 1, 1, 1.0, 2.0, 7, 1 if n % 5 else None, 2, 5.0, c, 1.0, False, day.date()) for n, c in enumerate([10, 11, 12, None, 10, 13])]
    names = ", ".join(f"{c} {k}" for c, k in zip(SEQ, ["timestamp", "long", "int", "long", "long", "double", "double"]))
    req = spark.createDataFrame(reqs, names + ", vendedor_id long, inventario_id long, cantidad int, precio_unitario double, clienta_id long, anticipo double, en_abonos boolean, fecha_proximo_pago date")
    req = req.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("precio_unitario", "anticipo")})
    t = FakeTables(spark)
    clients, inv = spark.createDataFrame([(10,), (11,), (11,)], "id long"), spark.createDataFrame([(1, 7, 4)], "id long, vendedor_id long, stock int")
    seen, lots = {}, cs.materialize_lots
    monkeypatch.setattr(cs, "materialize_lots", lambda s, make, n, name: seen.setdefault(name, lots(s, make, n, name)))
    out, stock = cs.register_sales(t, req, inv, clients, keep=["saldo_restante"])
    got = sorted((r["l_orderkey"], r["motivo"] or "ok") for r in out.collect())
    assert got == [(0, "cantidad_invalida"), (1, "ok"), (1, "ok"), (2, "clienta_no_existe"), (3, "sin_stock"), (4, "sin_stock"), (5, "cantidad_invalida")]
    assert stock.collect()[0]["stock"] == 0
    assert set(seen["sale-requests"].columns) == {*SEQ, "inventario_id", "vendedor_id", "cantidad", "clienta_id", "motivo", "saldo_restante"}
    assert "clienta_id" not in out.columns

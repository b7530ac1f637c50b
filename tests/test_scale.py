"""Jobs whose rows are many more than their inputs' keep them where they are made."""

import random

from tests.conftest import FakeTables
from vendorlytics.plans.changes_inventory import delete_inventory, delete_snapshot
from vendorlytics.plans.reads import catalog_not_in_inventory
from vendorlytics.sources.tables import FixtureTables

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_deletion_outcome_joins_by_id_only(spark):
    """One distribution, by id, serves sales, first requests and owners."""
    rnd = random.Random(5)
    snap = [(i % 40, i % 5, i % 7, 1, 1) for i in range(60)] + [(None, 1, 2, 1, 1), (3, None, 2, 1, 1)]
    reqs = [(rnd.randint(0, 45), rnd.randint(0, 5), i) for i in range(200)] + [(None, 1, 900), (3, None, 901)]
    sales = [(i,) for i in range(0, 40, 6)]
    prod = [(i, i % 2 == 0, i % 5) for i in range(7)]
    snapshot = spark.createDataFrame(snap, "id long, vendedor_id long, producto_maestro_id long, stock int, precio_personalizado int")
    t = FakeTables(spark, sales=spark.createDataFrame(sales, "inventario_id long"), products=spark.createDataFrame(prod, "id long, estado boolean, creado_por long"))
    out, left, gone = delete_inventory(t, spark.createDataFrame(reqs, "id long, vendedor_id long, seq long"), snapshot)
    want, deleted = [], []
    for i, v, s in reqs:
        if i is None or v is None:
            continue
        first = min(z for a, b, z in reqs if (a, b) == (i, v))
        for p in [r[2] for r in snap if r[:2] == (i, v)] or [None]:
            res = "tiene_ventas" if (i,) in sales else "no_encontrado" if p is None or s != first else "eliminado"
            want.append((i, v, s, p, res))
    got = out.select("id", "vendedor_id", "seq", "producto_maestro_id", "resultado").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    deleted = {w[0] for w in want if w[4] == "eliminado"}
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in snap if r[0] not in deleted)
    dels = [w for w in want if w[4] == "eliminado"]
    expect = []
    for p, estado, by in prod:
        mine = [w for w in dels if w[3] == p]
        if not estado and mine and len(mine) == sum(r[2] == p for r in snap) and max(w[2] for w in mine) == max((w[2] for w in mine if w[1] == by), default=None):
            expect.append((p, by))
    assert sorted(map(tuple, gone.collect())) == sorted(expect)
    joins = [x for x in plan(out).splitlines() if "Join" in x]
    assert len(joins) == 2 and all("vendedor_id" not in x.split("]")[0] for x in joins), joins


def test_delete_snapshot_pairs_stay(spark):
    """The made pairs meet the inventory's ids by broadcast, not by a shuffle."""
    df = delete_snapshot(FixtureTables(spark, SMALL))
    anti = [x for x in plan(df).splitlines() if "LeftAnti" in x]
    assert anti and all("BroadcastHashJoin" in x for x in anti)
    assert df.count() == df.select("id").distinct().count()


def test_not_in_inventory_after_the_join_nothing_moves(spark):
    users = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (None, 1), (4, None)], "id long, marca_id int")
    prod = spark.createDataFrame([(i, f"S{i}", None, f"n{i}", "d", "r", 1.5, i % 3, i % 4, i % 5 > 0) for i in range(60)],
                                 "id long, sku string, skus_anteriores array<string>, nombre string, descripcion string, ruta_imagen string, "
                                 "precio_sugerido double, marca_id int, categoria_id int, estado boolean")
    held = [(1, i) for i in range(0, 60, 2)] + [(2, 1), (3, 2), (None, 4), (1, None)]
    t = FakeTables(spark, users=users, products=prod, categories=spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, nombre string"),
                   inventory=spark.createDataFrame(held, "vendedor_id long, producto_maestro_id long"))
    out = catalog_not_in_inventory(t)
    got = sorted(str((r["vendedor_id"], r["id"], r["marca_id"], r["categoria"])) for r in out.collect())
    want = [str((u, i, m, c)) for u, m in [(1, 1), (2, 1), (3, 2), (None, 1)] for i in range(60) if i % 3 == m and i % 5 and (u is None or (u, i) not in held)
            for c in {1: ["a"], 2: ["b", "c"]}.get(i % 4, [None])]
    assert got == sorted(want)
    assert "LeftAnti" not in plan(out)

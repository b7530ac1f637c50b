"""Ordered greedy fold: hand cases and a brute-force property on all paths."""

import random

import pytest
from pyspark.sql import functions as F

from vendorlytics.operators.fold import greedy_consume


def brute(start, rows):
    """rows: list of (key, seq, amount) -> {(key, seq): accepted}, final."""
    rem = dict(start)
    out = {}
    for k, s, a in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in rem:
            out[(k, s)] = None
            continue
        ok = 0 < a <= rem[k]
        if ok:
            rem[k] -= a
        out[(k, s)] = ok
    return out, rem


def run(spark, start, rows, max_list, segment_rows=500_000):
    ch = spark.createDataFrame(rows, "k long, s long, a long").withColumn("rid", F.concat_ws(":", "k", "s"))
    st = spark.createDataFrame(list(start.items()), "k long, b long")
    res, final = greedy_consume(ch, st, ["k"], ["s"], "a", "b", carry=["rid"], max_list=max_list,
                                segment_rows=segment_rows)
    got = {tuple(int(x) for x in r["rid"].split(":")): r["accepted"] for r in res.collect()}
    return got, {r["k"]: r["b"] for r in final.collect()}


def test_stock_skip_case(spark):
    # stock 6; sales 3, 9, 2, 1 -> accept 3, 2, 1; refuse 9; final 0
    got, final = run(spark, {1: 6}, [(1, 1, 3), (1, 2, 9), (1, 3, 2), (1, 4, 1)], max_list=10)
    assert [got[(1, i)] for i in range(1, 5)] == [True, False, True, True]
    assert final == {1: 0}


def test_instalment_case(spark):
    # saldo 50; abonos 30, 30, 20, 5 -> accept, refuse, accept (paid), refuse
    got, final = run(spark, {7: 5000}, [(7, 1, 3000), (7, 2, 3000), (7, 3, 2000), (7, 4, 500)], max_list=10)
    assert [got[(7, i)] for i in range(1, 5)] == [True, False, True, False]
    assert final == {7: 0}


@pytest.mark.parametrize("max_list,segment_rows", [
    (1, 10**6),      # every key by levels
    (3, 37),         # hot keys in many range partitions
    (1000, 10),      # bounded JVM lists
])
def test_random_against_brute_force(spark, max_list, segment_rows):
    rnd = random.Random(max_list + segment_rows)
    start = {k: rnd.randint(0, 40) for k in range(12)}
    start[0] = 600  # one hot key with a third of the rows
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 13), i, rnd.randint(-2, 15)) for i in range(400)]
    got, final = run(spark, start, rows, max_list, segment_rows)
    want, want_final = brute(start, rows)
    assert got == want
    assert final == want_final
    # conservation: accepted + final = start
    for k in start:
        used = sum(a for kk, s, a in rows if kk == k and want[(kk, s)])
        assert used + want_final[k] == start[k]


def test_carried_ids_above_2_53_with_nulls(spark):
    big = 2**53 + 1
    ch = spark.createDataFrame([(0, i, 3, big if i % 2 else None) for i in range(20)], "k long, s long, a long, c long")
    st = spark.createDataFrame([(0, 10)], "k long, b long")
    rows, _ = greedy_consume(ch, st, ["k"], ["s"], "a", "b", carry=["c"], max_list=1, segment_rows=5)
    assert {(r["s"], r["c"]) for r in rows.collect()} == {(i, big if i % 2 else None) for i in range(20)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_with_large_balances(spark, seed):
    """Balances far apart, amounts at powers of two and one beside them, a
    hot key with a third of the rows, repeated sequence ranges of refusals."""
    rnd = random.Random(seed)
    start = {k: rnd.choice([0, 1, 2, 3, 7, 8, 1023, 1024, 2**33 + 5, 10**12]) for k in range(12)}
    start[0] = 10**9 + 7

    def amount(k):
        return max(0, 2**rnd.randint(0, max(1, start[k].bit_length())) + rnd.randint(-1, 1)) if rnd.random() < 0.6 \
            else rnd.randint(1, max(1, start[k] // 40))

    rows = [(k, i, amount(k)) for i in range(500) for k in [0 if i % 3 == 0 else rnd.randint(1, 13) if i % 7 else 99]
            if k in start] + [(77, 1, 5)]
    got, final = run(spark, start, rows, 1, 50)
    want, want_final = brute(start, rows)
    assert got == want and final == want_final


def test_levels_run_no_python(spark):
    ch = spark.createDataFrame([(0, i, 3) for i in range(40)], "k long, s long, a long")
    st = spark.createDataFrame([(0, 50)], "k long, b long")
    rows, final = greedy_consume(ch, st, ["k"], ["s"], "a", "b", max_list=1, segment_rows=5)
    for df in (rows, final):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(op in plan for op in ("InArrow", "InPandas", "EvalPython"))
    assert sum(r["accepted"] for r in rows.collect()) == 16 and final.collect()[0]["b"] == 2

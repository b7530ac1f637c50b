"""As-of matching and indexed pages against brute force."""

import random

from pyspark.sql import functions as F

from vendorlytics.operators.asof import START, as_of
from vendorlytics.operators.topk import day_index, indexed_page


def test_as_of_equals_brute_force(spark):
    r = random.Random(4)
    marks = [("hot" if r.random() < 0.4 else f"k{r.randrange(6)}", t, t // 37, r.choice(["a", "b", "c"])) for t in r.sample(range(1000), 300)]
    marks += [(f"k{i}", None, START, "start") for i in range(0, 6, 2)]
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(8)}", t, t // 37) for t in range(1000)]
    out = as_of(spark.createDataFrame(rows, "k string, at int, seg int"), spark.createDataFrame(marks, "k string, at int, seg int, v string"),
                ["k"], "at", "v")
    got = {(x["k"], x["at"]): x["v"] for x in out.collect()}
    assert len(got) == len(rows)
    for k, at, _ in rows:
        before = [(-1 if m[1] is None else m[1], m[3]) for m in marks if m[0] == k and (m[1] is None or m[1] < at)]
        assert got[k, at] == (max(before)[1] if before else None)


def test_as_of_takes_no_window_over_a_whole_key(spark):
    rows = spark.createDataFrame([("k", 1, 0)], "k string, at int, seg int")
    marks = rows.withColumn("v", F.lit(1))
    plan = as_of(rows, marks, ["k"], "at", "v")._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window" in line and "[k#" in line and "seg#" not in line.split("], [")[1]]
    # the one over whole keys reads one row per key and segment
    assert all("Aggregate" in plan.split(line)[1] for line in whole)


def test_as_of_without_marks_or_rows(spark):
    rows = spark.createDataFrame([("k", 1, 0)], "k string, at int, seg int")
    marks = rows.withColumn("v", F.lit("x"))
    assert [tuple(x) for x in as_of(rows, marks.limit(0), ["k"], "at", "v").collect()] == [("k", 1, 0, None)]
    assert as_of(rows.limit(0), marks, ["k"], "at", "v").count() == 0
    # a mark at a row's own time counts for later rows only
    later = rows.unionByName(spark.createDataFrame([("k", 2, 0)], "k string, at int, seg int"))
    assert sorted(x["v"] or "" for x in as_of(later, marks, ["k"], "at", "v").collect()) == ["", "x"]


def test_pages_equal_brute_force(spark):
    r = random.Random(9)
    rows = [(1 if r.random() < 0.5 else r.randrange(5), None if r.random() < 0.02 else f"2001-{r.randrange(1, 4):02d}-{r.randrange(1, 29):02d}", i)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "v int, f string, id int").withColumn("f", F.to_date("f"))
    halves = day_index(df.where("id < 1000"), ["v"], "f").unionByName(day_index(df.where("id >= 1000"), ["v"], "f"))
    stored = halves.groupBy("v", "dia").agg(F.sum("n").alias("n"))
    for first, last in ((1, 50), (51, 100), (951, 1000), (5001, 5050)):
        for index in (day_index(df, ["v"], "f"), stored):
            out = indexed_page(df, index, ["v"], "f", "id", first, last)
            got = sorted((x["v"], x["ord"], x["id"], x["total_count"]) for x in out.collect())
            want = []
            for v in range(5):
                mine = sorted((x for x in rows if x[0] == v), key=lambda x: (x[1] or "", x[2]), reverse=True)
                want += [(v, k + 1, x[2], len(mine)) for k, x in enumerate(mine) if first <= k + 1 <= last]
            assert got == sorted(want)

"""As-of matching: the last mark before each row, per key.

Rows and marks are put in one line, ordered by time, and the last mark's value
is carried forward. Nothing is paired up: a key with R rows and M marks costs
R + M rows, not R x M.

A hot key doesn't become one window task. Time is cut into segments (``seg``, a
number that never falls as time goes on, see ``time_segments``); inside a
segment a window carries the value, and from segment to segment the last value
of each is carried over one row per (key, segment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START = -1  # segment of what holds from the start


def time_segments(df: DataFrame, at: str, seg: str = "seg") -> DataFrame:
    """``df`` with the number of the range of ``at`` that each row is in. The
    ranges' first values are drawn from ``at`` alone, one a shuffle partition,
    so the rows stay where they are and their other columns aren't sampled."""
    ranges = df.select(F.col(at).alias("at")).repartitionByRange("at").groupBy(F.spark_partition_id().alias("n")).agg(F.min("at").alias("at"))
    firsts = ranges.where("at is not null").agg(F.array_sort(F.collect_list("at")).alias("firsts"))
    # the first range also takes what is null or was drawn too late
    number = F.greatest(F.size(F.filter("__firsts", lambda x: x <= F.col(at))) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(firsts.withColumnRenamed("firsts", "__firsts"))).withColumn(seg, number).drop("__firsts")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: str, seg: str | None = "seg") -> DataFrame:
    """``rows`` with ``value`` of the last of ``marks`` strictly before ``at``
    with the same ``by``, or null. A mark whose ``at`` is null (segment
    ``START``) comes before all rows. Keys aren't null; ``rows`` have ``by``,
    ``at`` and ``seg``. Without segments (``seg`` None) a key is one sorted
    pass of one task: for small keys, or where a plan runs many times."""
    val = F.struct(F.col(value).alias("v"))
    line = rows.withColumn("__mark", F.lit(0)).unionByName(
        marks.select(*by, at, *([seg] if seg else []), F.lit(1).alias("__mark"), val.alias("__v")), allowMissingColumns=True)
    inside = Window.partitionBy(*by, *([seg] if seg else [])).orderBy(F.col(at).asc_nulls_first(), "__mark").rowsBetween(Window.unboundedPreceding, 0)
    near = line.withColumn("__near", F.last("__v", ignorenulls=True).over(inside)).where("__mark = 0")
    if seg is None:
        return near.withColumn(value, F.col("__near")["v"]).select(*rows.columns, value)
    ends = marks.groupBy(*by, seg).agg(F.max(F.struct(at, val.alias("v"))).alias("__end"))
    here = rows.select(*by, seg).distinct().withColumn("__here", F.lit(True))
    before = Window.partitionBy(*by).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(here, [*by, seg], "full").withColumn("__carried", F.last("__end.v", ignorenulls=True).over(before)) \
        .where("__here and __carried is not null").select(*by, seg, "__carried")
    return near.join(carried, [*by, seg], "left").withColumn(value, F.coalesce("__near", "__carried")["v"]).select(*rows.columns, value)

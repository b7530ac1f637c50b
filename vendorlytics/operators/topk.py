"""Top-k and pages per group.

``row_number() over (partition by g order by o) <= k`` is planned by Spark
(3.5+) with a partial ``WindowGroupLimit`` below the shuffle: every map task
keeps only its own top k per group, so a hot group ships at most
k x (map tasks) rows to the final window instead of all of its rows. The
order must be total (add tie-breaks) for the result to be deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank_col: str = "ord") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def day_index(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows per group and day (by..., dia, n): the index that locates pages.
    Indexes of disjoint batches add up by a sum of ``n``."""
    return df.groupBy(*by, F.to_date(at).alias("dia")).agg(F.count(F.lit(1)).alias("n"))


def indexed_page(df: DataFrame, index: DataFrame, by: list[str], at: str, tie: str, first: int, last: int,
                 rank_col: str = "ord", total_col: str = "total_count") -> DataFrame:
    """Rows ranked first..last (1-based, inclusive) of each group, newest
    first (``at``, then ``tie``, both descending; rows without a time last; rows
    with the same ``tie`` by their other columns), and the group's number of rows.

    Running counts over the index locate the days that the page touches; only
    these days' rows are ranked, so a page costs the same however deep it lies.
    """
    newest = Window.partitionBy(*by).orderBy(F.col("dia").desc_nulls_last())
    days = index.withColumn("__before", F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn(total_col, F.sum("n").over(Window.partitionBy(*by)))
    hit = days.where((F.col("__before") < last) & (F.col("__before") + F.col("n") >= first)).select(
        *by, "dia", "__before", total_col)
    day, of = F.to_date(at), hit.withColumnsRenamed({c: f"__{c}" for c in by})
    same = day.eqNullSafe(F.col("dia"))
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    rows = df.join(of, same)
    rest = [F.col(c).desc() for c, kind in df.dtypes if c not in (at, tie, *by) and "map<" not in kind]
    w = Window.partitionBy(*by, "dia").orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc(), *rest)
    ranked = rows.withColumn(rank_col, (F.col("__before") + F.row_number().over(w)).cast("int"))
    return ranked.where(F.col(rank_col).between(first, last)).select(*df.columns, rank_col, total_col)

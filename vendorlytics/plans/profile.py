"""S2 as mergeable column sketches.

One pass over a table gives a row a column: rows, nulls, greatest text length
and a HyperLogLog sketch of the values. Sketches of disjoint batches add up
(``merge_profiles``), so a new batch of rows is profiled alone. Distinct
counts are estimates: with 2^12 registers their relative standard error is
about 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
KEYS = ["table_name", "column_name", "ordinal_position", "data_type", "is_nullable"]


def column_sketches(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, ordinal_position, data_type, is_nullable,
    row_count, null_count, max_length, sketch); an empty table has no rows to
    count and an empty sketch, max_length is null but for texts."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields, 1):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        nested = kind.startswith(("array", "map", "struct"))
        value = F.to_json(F.struct(c)) if nested else c.cast("string")
        length = F.length(c) if kind == "string" else F.lit(None).cast("int")
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), F.max(length).alias(f"l{i}"),
                 F.hll_sketch_agg(F.when(c.isNotNull(), value), LG_K).alias(f"s{i}")]
        rows.append(F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
                             F.lit(i).alias("ordinal_position"), F.lit(kind).alias("data_type"),
                             F.lit(f.nullable).alias("is_nullable"), F.col("n").alias("row_count"),
                             F.col(f"n{i}").alias("null_count"), F.col(f"l{i}").alias("max_length"), F.col(f"s{i}").alias("sketch")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merge_profiles(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The profile of the rows of both."""
    return stored.unionByName(batch).groupBy(*KEYS).agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.max("max_length").alias("max_length"), F.hll_union_agg("sketch").alias("sketch"))


def profile_report(profile: DataFrame) -> DataFrame:
    return profile.withColumn("distinct_estimate", F.hll_sketch_estimate("sketch")).drop("sketch")

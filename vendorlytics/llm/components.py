"""Connected components by local contraction.

Every vertex joins the vertex of least priority among itself and its
neighbours (priorities are hashes, so chains of ids don't slow it down), the
pointers are followed once more, and the graph is contracted: edges are mapped
to their ends' new vertices, loops and repeats go. The graph shrinks by a
constant factor a round in expectation. The rounds' maps are then composed
from the last (smallest) to the first. Neighbour minima are aggregated before
the shuffle, so a vertex of very high degree is one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (u, v: long). Two vertices
    have the same root just when a path joins them; the root is one of them."""
    def tidy(df: DataFrame) -> DataFrame:
        return (df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    rank = F.xxhash64
    left, maps = scratch.write(tidy(edges), "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v"))).alias("m"))
        own = F.struct(rank("u").alias("r"), F.col("u").alias("v"))
        step = scratch.write(near.select(F.col("u").alias("id"), F.least(own, "m")["v"].alias("to")), "step")
        jump = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
        move = scratch.write(step.join(jump, "to").select("id", F.col("further").alias("to")), "move")
        scratch.drop(step)
        maps.append(move)
        mapped = (left.join(move.select(F.col("id").alias("u"), F.col("to").alias("a")), "u")
                      .join(move.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
                      .select(F.col("a").alias("u"), F.col("b").alias("v")))
        smaller = scratch.write(tidy(mapped), "edges")
        scratch.drop(left)
        left = smaller
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "id long, root long")
    out = maps[-1].select("id", F.col("to").alias("root"))
    for move in reversed(maps[:-1]):
        out = (move.join(out.select(F.col("id").alias("to"), "root"), "to", "left")
                   .select("id", F.coalesce("root", "to").alias("root")))
    return scratch.write(out, "roots")

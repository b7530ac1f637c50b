"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks. With weight w of a total Q, the
source's block k is released at slot floor(k Q / w) and due by slot
ceil((k + 1) Q / w); in every slot the released block with the earliest
deadline runs (ties: the source named first). While no source ends, after t
slots every source has had its share of t to within less than one block.

Integer weights make the schedule periodic: after Q slots every source has had
exactly w blocks. So the driver schedules one period, of at most the recipe's
total weight, and every block's slot follows by arithmetic on its number; no
step depends on the number of rows. When a source ends, a new phase begins for
those left, with their weights' own total; there is at most one phase for each
entry of the recipe. All rows are placed: weights steer the order, nothing is
dropped or repeated.

A row's place inside its source comes from a hash order that is cut into
hash-range buckets, so a source holding a third of all rows is ranked by as
many tasks as its size asks for.

Defined cases: sources that the recipe doesn't name, and null, share the
stream ``REST``; repeated rows and ties in the hash order each get a place of
their own; null doc_ids are hashed as such; an empty table gives an empty
result; weights must be positive integers. Other columns pass through under any
name but an output's, which raises ``ValueError``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlytics.llm.common import given, packed, quoted, table

REST = "rest"
BLOCK = 16
BUCKET_ROWS = 50_000
# Target weights of the registered query: hundredths of the mix.
RECIPE = {"src0": 10} | {f"src{k}": 6 for k in range(1, 10)} | {f"src{k}": 3 for k in range(10, 20)}
REST_WEIGHT = 6
ADDED = ["stream", "block", "phase", "release", "deadline", "slot", "position"]


def period(weights: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """One period of the schedule: (stream, k, release, deadline) by slot."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    order = {s: i for i, s in enumerate(weights)}
    slots = []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // w), order[s], s) for s, w in weights.items()
                 if done[s] < w and done[s] * total // w <= t]
        deadline, _, s = min(ready)
        slots.append((s, done[s], done[s] * total // weights[s], deadline))
        done[s] += 1
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]):
    """The schedule of all blocks: spans (phase, stream, first block, end
    block, first slot, Q, w) and periods (phase, stream, k, slot, release,
    deadline), both bounded by the recipe."""
    done = {s: 0 for s in weights if blocks.get(s)}
    spans, periods, at, phase = [], [], 0, 0
    while done:
        w = {s: weights[s] for s in weights if s in done}
        total, slots = sum(w.values()), period({s: weights[s] for s in weights if s in done})
        place = {(s, k): t for t, (s, k, _, _) in enumerate(slots)}

        def end(s: str) -> int:
            last = blocks[s] - done[s] - 1
            return last // w[s] * total + place[s, last % w[s]] + 1

        length = min(map(end, w))
        for s in w:
            part = sum(x[0] == s for x in slots[:length % total])
            n = length // total * w[s] + part
            spans.append((phase, s, done[s], done[s] + n, at, total, w[s]))
            done[s] += n
        periods += [(phase, s, k, t, r, d) for t, (s, k, r, d) in enumerate(slots)]
        done = {s: n for s, n in done.items() if n < blocks[s]}
        at, phase = at + length, phase + 1
    return spans, periods


def hash_order(doc_id: Column) -> Column:
    """60 bits of the id's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, recipe: dict[str, int], rest: int, block: int = BLOCK, source: str = "source") -> DataFrame:
    """``docs`` with the columns ``ADDED``; ``position`` orders the mix (0 to
    the number of rows, without gaps)."""
    clash = set(ADDED) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    weights = recipe | {REST: rest}
    if any(not isinstance(w, int) or w <= 0 for w in weights.values()) or REST in recipe:
        raise ValueError("weights are positive integers; the name of the rest is reserved")
    spark = docs.sparkSession
    of = F.col(quoted(source))
    stream = F.when(of.isin(*recipe), of).otherwise(F.lit(REST)) if recipe else F.lit(REST)
    bits = max(8, math.ceil(math.log2(max(1, docs.count() / BUCKET_ROWS))))
    rows = packed(docs, stream=stream, doc_id="doc_id", _h=hash_order(F.col("doc_id"))).withColumn("_b", F.shiftright("_h", 60 - bits))
    counts = rows.groupBy("stream", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("stream").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    size = {r["stream"]: r["n"] for r in counts.groupBy("stream").agg(F.sum("_n").alias("n")).collect()}  # one row per recipe entry
    spans, periods = phases({s: -(-n // block) for s, n in size.items()}, weights)
    span = spark.createDataFrame(spans, "phase int, stream string, lo long, hi long, at long, q long, w long")
    turn = spark.createDataFrame(periods, "phase int, stream string, k long, t long, r long, d long")
    within = Window.partitionBy("stream", "_b").orderBy("_h", "doc_id")
    placed = (rows.withColumn("_i", F.row_number().over(within) - 1)
                  .join(offsets, ["stream", "_b"])
                  .withColumn("_rank", F.col("_i") + F.col("_before"))
                  .withColumn("block", F.floor(F.col("_rank") / block).cast("long")))
    b = (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi"))
    placed = placed.join(F.broadcast(span.withColumnRenamed("stream", "_s")), (F.col("stream") == F.col("_s")) & b)
    nth = F.col("block") - F.col("lo")
    placed = placed.withColumn("k", nth % F.col("w")).withColumn("_c", F.col("at") + F.floor(nth / F.col("w")) * F.col("q"))
    placed = placed.join(F.broadcast(turn), ["phase", "stream", "k"])
    placed = placed.withColumn("slot", F.col("_c") + F.col("t"))
    # a source's last block may be short: later rows move up
    short = [(_slot(n // block, s, spans, periods), block - n % block) for s, n in size.items() if n % block]
    gap = sum((F.when(F.col("slot") > t, F.lit(g)).otherwise(F.lit(0)) for t, g in short), F.lit(0).cast("long"))
    return placed.select(
        *given(docs), "stream", "block", "phase",
        (F.col("_c") + F.col("r")).alias("release"), (F.col("_c") + F.col("d")).alias("deadline"), "slot",
        (F.col("slot") * block + F.col("_rank") % block - gap).alias("position"))


def _slot(block: int, stream: str, spans, periods) -> int:
    phase, _, lo, _, at, q, w = next(x for x in spans if x[1] == stream and x[2] <= block < x[3])
    t = next(x[3] for x in periods if x[:3] == (phase, stream, (block - lo) % w))
    return at + (block - lo) // w * q + t


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, RECIPE, REST_WEIGHT)


QUERIES = {"op1_mixing": op1_mixing}

# The schedule slot by slot: the state holds the phase, its start and, by
# stream, the blocks done in this phase and in all.
ORACLES = {"op1_mixing": f"""
WITH RECURSIVE recipe(i, name, w) AS (
  VALUES {', '.join(f"({i + 1}, '{s}', {w})" for i, (s, w) in enumerate((RECIPE | {REST: REST_WEIGHT}).items()))}
), d AS (
  SELECT doc_id, source, coalesce(r.i, {len(RECIPE) + 1}) AS i,
         row_number() OVER (PARTITION BY coalesce(r.i, {len(RECIPE) + 1})
                            ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id) - 1 AS rank
  FROM documents LEFT JOIN recipe r ON r.name = source AND r.i <= {len(RECIPE)}
), st AS (
  SELECT list(w ORDER BY i) AS w, list(coalesce(n, 0) ORDER BY i) AS n
  FROM recipe LEFT JOIN (SELECT i, (count(*) + {BLOCK - 1}) // {BLOCK} AS n FROM d GROUP BY i) c USING (i)
), run(slot, phase, base, k, done, pick, blk, rel, due) AS (
  SELECT -1, 0, 0, [0 for x in w], [0 for x in w], 0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM st
  UNION ALL
  SELECT slot + 1,
         CASE WHEN ended THEN phase + 1 ELSE phase END,
         CASE WHEN ended THEN slot + 2 ELSE base END,
         CASE WHEN ended THEN [0 for x in w] ELSE [k[x] + (x = p)::INT for x in range(1, len(w) + 1)] END,
         [done[x] + (x = p)::INT for x in range(1, len(w) + 1)],
         p, done[p]::BIGINT, (base + k[p] * q // w[p])::BIGINT, (base + ((k[p] + 1) * q + w[p] - 1) // w[p])::BIGINT
  FROM (
    SELECT *, done[p] + 1 = n[p] AS ended FROM (
      SELECT *, (list_min([((k[x] + 1) * q + w[x] - 1) // w[x] * 1000 + x for x in range(1, len(w) + 1)
                           if done[x] < n[x] AND k[x] * q // w[x] <= slot + 1 - base]) % 1000)::INT AS p
      FROM (
        SELECT run.*, w, n, list_sum([w[x] for x in range(1, len(w) + 1) if done[x] < n[x]])::BIGINT AS q
        FROM run, st WHERE list_sum(done) < list_sum(n)
      )
    )
  )
), sized AS (
  SELECT r.*, lag(phase, 1, 0) OVER (ORDER BY slot) AS ph, c.m FROM run r
  JOIN (SELECT i, rank // {BLOCK} AS blk, count(*) AS m FROM d GROUP BY ALL) c ON c.i = r.pick AND c.blk = r.blk
), placed AS (
  SELECT *, sum(m) OVER (ORDER BY slot) - m AS rows_before FROM sized
)
SELECT doc_id, source, name AS stream, d.rank // {BLOCK} AS block, ph::INT AS phase, rel AS release, due AS deadline,
       slot::BIGINT AS slot, (rows_before + d.rank % {BLOCK})::BIGINT AS position
FROM d JOIN recipe USING (i) JOIN placed p ON p.pick = d.i AND p.blk = d.rank // {BLOCK}
"""}

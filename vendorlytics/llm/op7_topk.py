"""Exact top-k inner product search with block-at-a-time pruning.

Vectors become integers, floor(1024 x). They are ordered by the signs of a few
fixed projections, so that neighbours are alike, and packed into ranges of
``RANGE`` vectors; a range holds blocks of ``BLOCK`` vectors. A term is a
dimension; a block's term maxima are the largest and smallest values of the
dimension in it. For a query, a block's bound is the sum over terms of the
larger of query * max and query * min.

1. Each query is scored against its own range, which gives a floor under its
   k-th score.
2. Every range takes every query: its blocks come in the order of their
   bounds and are scored through their rows (the forward index) until the
   bound falls below the k-th score so far or the floor. Blocks that reach it
   exactly are scored, so ties are right.
3. The ranges' lists of k are merged per query; only k rows a range and query
   cross the shuffle.

Defined cases: vectors that are null or hold null or non-finite components
take no part; a query is compared with vectors of its own length; candidates
are the rows with another vec_id, and repeated rows are candidates each; null
vec_ids are candidates but no queries; fewer than k candidates give all; an
empty table gives an empty result; other columns are ignored. Products are
exact: in double precision while they are below 2^53, else as Python integers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, table

K = 10
EVERY = 100
SCALE = 1024
RANGE = 4096
BLOCK = 64
CODE_BITS = 12


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unpack(blob: bytes, dim: int):
    return np.frombuffer(blob, np.int64).reshape(-1, dim) if dim else np.zeros((len(blob), 0), np.int64)


def pack(m) -> bytes:
    return np.ascontiguousarray(m, np.int64).tobytes() if m.shape[1] else bytes(len(m))


def numbers(a, b):
    """The matrices in a type in which their products are exact."""
    most = max((int(np.abs(x).max()) if x.size else 0) for x in (a, b))
    kind = np.float64 if most * most * max(1, a.shape[1]) < 2 ** 53 else object
    return a.astype(kind), b.astype(kind)


def best(scores, ids, k: int):
    """Positions of the k highest scores, ties to the smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores))
    return np.asarray(order[:k], np.int64)


def search(queries, query_ids, floors, rows, ids, k: int):
    """Per query: (positions of rows, scores) of the k best rows of a range."""
    q, r = numbers(queries, rows)
    cut = range(0, len(r), BLOCK)
    high = np.stack([r[i:i + BLOCK].max(0) for i in cut]) if r.shape[1] else np.zeros((len(cut), 0))
    low = np.stack([r[i:i + BLOCK].min(0) for i in cut]) if r.shape[1] else np.zeros((len(cut), 0))
    up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    bounds = up @ high.T + down @ low.T
    for i, own in enumerate(query_ids):
        at, got, kth = np.empty(0, np.int64), np.empty(0, r.dtype), floors[i]
        for b in np.argsort(-bounds[i], kind="stable"):
            if bounds[i, b] < kth:
                break
            lo = b * BLOCK
            s = r[lo:lo + BLOCK] @ q[i]
            ok = (ids[lo:lo + BLOCK] != own) & (s >= kth)
            at, got = np.concatenate((at, lo + np.flatnonzero(ok))), np.concatenate((got, s[ok]))
            if len(at) > k:
                keep = best(got, ids[at], k)
                at, got = at[keep], got[keep]
            if len(at) == k:
                kth = max(kth, got.min())
        yield at, got


def ranges(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """Packed ranges: dim, range, ids, rows; and the queries among them with
    their floors."""
    def code(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                sign = np.random.default_rng(len(v)).standard_normal((CODE_BITS, len(v))) @ np.array(v, np.float64) > 0
                out.append(int(np.packbits(sign, bitorder="little").view(np.uint16)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=["vec_id", "v", "code"])

    coded = vectors.mapInArrow(code, "vec_id long, v array<long>, code int").withColumn("dim", F.size("v"))
    parts = max(8, math.ceil(vectors.count() / RANGE))
    # sampling and dealing read the codes once each
    dealt = coded.repartitionByRange(parts, "dim", "code", "vec_id").sortWithinPartitions("dim", "code", "vec_id")

    def put(batches):
        import pyarrow as pa

        held: list = []

        def flush():
            dim = len(held[0][1])
            ids = np.array([-(1 << 63) if i is None else i for i, _ in held], np.int64)
            rows = np.array([v for _, v in held], np.int64).reshape(len(held), dim)
            ask = np.flatnonzero((ids % every == 0) & (ids != -(1 << 63)))
            floors = [float(s.min()) if len(at) == k else -math.inf
                      for at, s in search(rows[ask], ids[ask], [-math.inf] * len(ask), rows, ids, k)] if len(ask) else []
            # a floor is a score that k rows reach; rounding may only lower it
            floors = [np.nextafter(f, -math.inf) if abs(f) >= 2 ** 53 else f for f in floors]
            return [dim, ids.tobytes(), pack(rows), ids[ask].tobytes(), pack(rows[ask]), np.array(floors, np.float64).tobytes()]

        out = []
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if held and (len(held) == RANGE or len(held[0][1]) != len(v)):
                    out.append(flush())
                    held = []
                held.append((i, v))
        if held:
            out.append(flush())
        for row in out:
            yield pa.RecordBatch.from_pylist([dict(zip(["dim", "ids", "rows", "qids", "qrows", "floors"], row))],
                                             schema=pa.schema([("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "rows", "qids", "qrows", "floors")]]))

    packed = dealt.select("vec_id", "v").mapInArrow(put, "dim int, ids binary, rows binary, qids binary, qrows binary, floors binary")
    return packed.withColumn("range", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score); ``vectors`` has vec_id and embedding."""
    scratch = Scratch(vectors.sparkSession, "topk")
    ints = vectors.where(usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    packed = scratch.write(ranges(scratch.write(ints, "ints"), k, every), "ranges")
    # the stated queries against all rows: each pack of queries goes to each range
    sizes = packed.groupBy("dim").agg(F.collect_list("range").alias("to"))
    asked = packed.where(F.length("qids") > 0).select("dim", "qids", "qrows", "floors").join(sizes, "dim").select(
        F.explode("to").alias("range"), "qids", "qrows", "floors")
    work = packed.select("range", "dim", "ids", "rows").join(asked, "range")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x in batch.to_pylist():
                ids, asked = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["qids"], np.int64)
                q = unpack(x["qrows"], x["dim"])
                who, found, scores, at = [], [], [], []
                for i, (pos, s) in enumerate(search(q, asked, np.frombuffer(x["floors"], np.float64), unpack(x["rows"], x["dim"]), ids, k)):
                    key = hash(q[i].tobytes()) & 0x7FFFFFFF
                    who += [(int(asked[i]), key)] * len(pos)
                    found += [None if v == -(1 << 63) else v for v in ids[pos].tolist()]
                    scores += [int(v) for v in s]
                    at += pos.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[0] for w in who], pa.int64()), pa.array([w[1] for w in who], pa.int64()), pa.array(found, pa.int64()),
                     pa.array(scores, pa.int64()), pa.array([x["range"] * RANGE + p for p in at], pa.int64())],
                    names=["query_id", "q", "vec_id", "score", "at"])

    found = work.mapInArrow(run, "query_id long, q long, vec_id long, score long, at long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op7_topk": op7_topk}

ORACLES = {"op7_topk": """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""}

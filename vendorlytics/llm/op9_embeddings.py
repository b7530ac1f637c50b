"""Embedding near-duplicates by NN-descent.

Vectors of equal label link when their cosine, in double precision, is 0.98
or more. Equal vectors are one node with a count. Then

1. *Start.* Nodes are sorted by label and the signs of random projections, in
   ``TABLES`` different orders; each meets the ``WINDOW`` nodes after it. A
   node's list keeps its ``LIST`` nearest.
2. *NN-descent.* A node's neighbours (those in its list and nodes in whose
   lists it is) are compared with each other, and lists take what is nearer.
   A list that is saturated, that is full of links, is enlarged up to
   ``LARGE`` links.
3. *Threshold edges* of the lists of all rounds give components. A list that
   is full at ``LARGE`` links may hide others, so components with such a list
   are compared exactly with all other nodes of the label, but for those too
   far from a pivot to link with any member. Links never leave a component, so its members are compared exactly, block by block, for the
   numbers of links: a list that was too short for a large group of near
   copies loses nothing. Blocks send counts, never pairs.
4. *Audit.* For ``AUDIT`` nodes of each size of found components, lone nodes
   included, links are counted against all vectors. If the mean recall of a
   node's links is under ``RECALL`` for nodes of few, some or many links, more
   rounds follow; if that doesn't do, all components of a label, lone nodes
   too, are compared exactly like those with full lists, which is quadratic in
   their number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do those with a null label or of
different lengths; repeated rows are linked as equal vectors; null vec_ids
count as the largest; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, shuffle_partitions, table
from vendorlytics.llm.components import components
from vendorlytics.llm.op7_topk import usable

COSINE = 0.98
TABLES = 4
WINDOW = 8
LIST = 12
LARGE = 32
ROUNDS = 2
MORE_ROUNDS = 3
AUDIT = 200
FEW = 4  # links of a node in a small group
RECALL = 0.95
BLOCK = 2048
PACK = 1024  # nodes to a group, however many there are
NO_ID = (1 << 63) - 1


def unit(column):
    """Rows of unit length, in double precision."""
    x = np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their key, or null; one row per key)."""
    v = F.col("embedding")
    good = usable(v) & F.col("label").isNotNull() & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec"), F.col("label").cast("long").alias("label"),
                          F.transform(v, lambda x: x.cast("double")).alias("v"), good.alias("good"))
    rows = rows.withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "label", "v")))
    nodes = rows.where("good").groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min("vec").alias("vec"), F.first("label").alias("label"), F.first("v").alias("v"))
    return rows.select("vec", "h1", "h2"), nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))


def start(nodes: DataFrame, bits: int, t: int, partitions: int) -> DataFrame:
    """(u, v, s) of neighbours in the t-th order."""
    def code(batches):
        import pyarrow as pa

        for batch in batches:
            out, at = [], []
            for v in batch.column("v").to_pylist():
                r = np.random.default_rng([t, len(v)]).standard_normal((bits + 1, len(v))) @ np.array(v)
                out.append(int("".join("01"[int(x > 0)] for x in r[:bits]), 2))
                at.append(float(r[bits] / np.linalg.norm(v)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64()), pa.array(at)], names=[*batch.schema.names, "code", "at"])

    coded = nodes.select("id", "label", "dim", "v").mapInArrow(code, "id long, label long, dim int, v array<double>, code long, at double")
    keys = ["label", "dim", "code", "at", "id"]
    dealt = coded.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)

    def windows(batches):
        import pyarrow as pa

        tail = None
        for batch in batches:
            now = batch.to_pandas()
            now = now if tail is None else _concat(tail, now)
            tail = now.iloc[-WINDOW:]
            for (_, dim), g in now.groupby(["label", "dim"], sort=False):
                x, ids = unit(g["v"]), g["id"].to_numpy()
                for w in range(1, min(WINDOW, len(ids) - 1) + 1):
                    s = np.einsum("ij,ij->i", x[:-w], x[w:])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-w]), pa.array(ids[w:]), pa.array(s)], names=["u", "v", "s"])

    return dealt.mapInArrow(windows, "u long, v long, s double")


def _concat(a, b):
    import pandas as pd

    return pd.concat([a, b], ignore_index=True)


def lists_of(edges: DataFrame) -> DataFrame:
    """Each node's nearest: ``LIST`` of them, and more while they are links."""
    both = edges.select("u", "v", "s").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    both = both.groupBy("u", "v").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return both.withColumn("r", rank).where(f"r <= {LARGE} and (r <= {LIST} or s >= {COSINE})")  # the bound of r is applied before the shuffle


def descend(lists: DataFrame, nodes: DataFrame, groups: int) -> DataFrame:
    """(u, v, s) of pairs of neighbours' neighbours that lists may take."""
    floor = lists.groupBy("u").agg(F.min("s").alias("floor"), F.count("*").alias("n"), F.min(F.when(F.col("s") < COSINE, 1)).alias("open"))
    floor = floor.select(F.col("u").alias("id"), F.when(F.col("n") < LIST, -1.0).otherwise(F.col("floor")).alias("floor"))
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"))
    pick = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v"))
    back = back.withColumn("r", pick).where(F.col("r") <= LIST).drop("r")  # the others hold u in their own lists
    member = lists.select("u", "v").unionByName(back).distinct().withColumnRenamed("v", "id")
    member = member.join(nodes.select("id", "v"), "id").join(floor, "id").withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)))

    def compare(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["u", "id"])
        u, ids, floor = (pdf[c].to_numpy() for c in ("u", "id", "floor"))
        sizes = pdf["v"].map(len).to_numpy()
        out = []
        edge = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1], [True])))
        vs = pdf["v"].to_numpy()
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2 or sizes[lo:hi].min() != sizes[lo:hi].max():
                continue
            x = unit(vs[lo:hi])
            s = x @ x.T
            f = floor[lo:hi]
            a, b = np.nonzero(np.triu((s > f[:, None]) | (s > f[None, :]), 1))
            out.append((ids[lo + a], ids[lo + b], s[a, b]))
        if not out:
            return pd.DataFrame({"u": [], "v": [], "s": []})
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate("uvs")}).drop_duplicates(["u", "v"])

    return member.groupBy("g").applyInPandas(compare, "u long, v long, s double")


def count_links(nodes: DataFrame, roots: DataFrame, groups: int) -> DataFrame:
    """(id, links): vectors of other nodes in the component with a cosine of
    the threshold or more; exact, in blocks of ``BLOCK`` members."""
    rows = nodes.join(roots, "id").select("id", "root", "v", "copies")
    parts = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("c"))
    rows = rows.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.withColumn("block", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
    # small components share groups; a pair of parts of a large one has its own
    rows = rows.withColumn("g", F.when(F.col("c") == 1, F.pmod("block", F.lit(groups))).otherwise(F.col("block"))).select("id", "root", "v", "copies", "own", "c", "other", "block", "g")

    def compare(key, pdf):
        import pandas as pd

        out = []
        for _, b in pdf.groupby("block", sort=False):
            x, own, n = unit(b["v"]), b["own"].to_numpy(), b["copies"].to_numpy()
            hit = x @ x.T >= COSINE
            np.fill_diagonal(hit, False)
            if own.min() != own.max():
                hit &= own[:, None] != own[None, :]  # pairs inside a part have a block of their own
            out.append((b["id"].to_numpy(), hit @ n))
        return pd.DataFrame({"id": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out])})

    return rows.groupBy("g").applyInPandas(compare, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def touching(nodes: DataFrame, roots: DataFrame, full: DataFrame, groups: int) -> DataFrame:
    """(u, v): a node and the root of a component of ``full`` that it doesn't
    belong to but links with; exact. A node is compared with a component's
    members only if its angle to one of them, the pivot, leaves room."""
    named = nodes.select("id", "label", "dim", "v").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    named = named.withColumn("norm", norm)

    def angle():
        dot = F.aggregate(F.zip_with("v", "p", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / (F.col("norm") * F.col("pnorm"))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))

    members = named.join(full, "root", "left_semi")
    pivot = members.groupBy("root").agg(F.min_by("v", "id").alias("p"), F.min_by("norm", "id").alias("pnorm"), F.count("*").alias("n"))
    reach = members.join(pivot, "root").groupBy("root", "label", "dim").agg(
        F.max(angle()).alias("reach"), F.first("p").alias("p"), F.first("pnorm").alias("pnorm"), F.first("n").alias("n"))
    # a label's nodes are dealt in lots, each meets all pivots of the label
    reach = reach.withColumnRenamed("root", "other").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    lots = named.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asked = lots.join(reach, ["label", "dim", "lot"]).where(F.col("root") != F.col("other")).where(
        angle() <= F.col("reach") + math.acos(COSINE) + 1e-6).select("id", "v", F.col("other").alias("root"), "n")
    sizes = asked.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ca"), F.ceil(F.first("n") / BLOCK).cast("int").alias("cm"))

    def dealt(rows, own, other, side):
        rows = rows.select("id", "root", "v").join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("own", "part") if side == 0 else ("part", "own")
        rows = rows.withColumn("block", F.xxhash64("root", *pair)).withColumn("side", F.lit(side))
        return rows.withColumn("g", F.when(F.col("ca") * F.col("cm") == 1, F.pmod("block", F.lit(groups))).otherwise(F.col("block"))).select("id", "root", "v", "side", "block", "g")

    def compare(key, pdf):
        import pandas as pd

        out = []
        for _, b in pdf.groupby("block", sort=False):
            of, ask = b[b["side"] == 0], b[b["side"] == 1]
            if len(of) and len(ask):
                hit = (unit(ask["v"]) @ unit(of["v"]).T >= COSINE).any(1)
                out.append((ask["id"].to_numpy()[hit], ask["root"].to_numpy()[hit]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i, c in enumerate("uv")})

    return dealt(members, "cm", "ca", 0).unionByName(dealt(asked, "ca", "cm", 1)).groupBy("g").applyInPandas(compare, "u long, v long")


def audit(nodes: DataFrame, found: DataFrame, roots: DataFrame) -> float:
    """Mean recall of a node's links, against all vectors, in the worst of the
    classes of nodes with few, some and many links. ``AUDIT`` nodes are taken
    by hash of each size of found components, lone nodes included, and stand
    for all of that size."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    kind = F.when(F.col("size").isNull(), 0).when(F.col("size") <= FEW + 1, 1).when(F.col("size") <= LARGE, 2).otherwise(3)
    kinds = nodes.select("id", "label", "v").join(roots.join(sizes, "root").select("id", "size"), "id", "left").withColumn("kind", kind)
    total = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("id"), "id"))
    sample = kinds.withColumn("r", rank).where(F.col("r") <= AUDIT).select("id", "label", "v", "kind").collect()  # bounded by AUDIT and the kinds
    if not sample:
        return 1.0
    taken = [r["kind"] for r in sample]
    share = nodes.sparkSession.createDataFrame([(r["id"], total[r["kind"]] / taken.count(r["kind"])) for r in sample], "id long, share double")
    by: dict = {}
    for r in sample:
        by.setdefault((r["label"], len(r["v"])), []).append((r["id"], r["v"]))
    asked = {k: (np.array([i for i, _ in x]), unit([v for _, v in x])) for k, x in by.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            b = batch.to_pandas()
            for (label, dim), g in b.groupby(["label", "dim"]):
                if (label, dim) in asked:
                    ids, q = asked[label, dim]
                    hit = q @ unit(g["v"]).T >= COSINE
                    hit &= ids[:, None] != g["id"].to_numpy()[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((hit @ g["copies"].to_numpy()).astype(np.int64))], names=["id", "links"])

    truth = nodes.select("id", "label", "dim", "v", "copies").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    held = truth.where("links > 0").join(share, "id").join(found.withColumnRenamed("links", "got"), "id", "left")
    part = F.least("links", F.coalesce("got", F.lit(0))) / F.col("links")
    size = F.when(F.col("links") <= FEW, 0).when(F.col("links") < LARGE, 1).otherwise(2)
    classes = held.groupBy(size.alias("size")).agg((F.sum(part * F.col("share")) / F.sum("share")).alias("recall")).collect()
    return min((r["recall"] for r in classes), default=1.0)


def closed(nodes: DataFrame, roots: DataFrame, known: DataFrame, full: DataFrame, groups: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(roots, edges) with the links between ``full`` components and others."""
    more = scratch.write(touching(nodes, roots, scratch.write(full, "full"), groups), "touching")
    if more.isEmpty():
        return roots, known
    known = scratch.write(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(more), "known")
    return components(known, scratch), known


def near_vectors(vectors: DataFrame) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) per row, and the audited recall."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows, nodes = nodes_of(vectors)
    rows, nodes = scratch.write(rows, "rows"), scratch.write(nodes, "nodes")
    n = nodes.count()
    groups = max(64, 2 * shuffle_partitions(spark), math.ceil(n / PACK))
    bits, partitions = max(4, math.ceil(math.log2(max(2, n) / 64))), max(4, math.ceil(n / 8192))
    edges = start(nodes, bits, 0, partitions)
    for t in range(1, TABLES):
        edges = edges.unionByName(start(nodes, bits, t, partitions))
    lists = scratch.write(lists_of(edges), "lists")
    is_link = F.col("s") >= COSINE
    known = scratch.write(lists.where(is_link).select("u", "v"), "known")
    done, recall = 0, 0.0
    while True:
        for _ in range(ROUNDS if not done else 1):
            new = descend(lists, nodes, groups).unionByName(lists.select("u", "v", "s"))
            nearer = scratch.write(lists_of(new), "lists")
            scratch.drop(lists)
            lists, done = nearer, done + 1
            known = known.unionByName(scratch.write(lists.where(is_link).select("u", "v"), "known"))
        roots = components(known, scratch)
        # a list that is full of links may hide some: its component meets all others
        full = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("s")).where((F.col("n") >= LARGE) & is_link)
        full = full.select(F.col("u").alias("id")).join(roots, "id").select("root").distinct()
        roots, known = closed(nodes, roots, known, full, groups, scratch)
        links = scratch.write(count_links(nodes, roots, groups), "links")
        recall = audit(nodes, links, roots)
        if recall >= RECALL:
            break
        if done >= ROUNDS + MORE_ROUNDS:  # the rounds didn't do: every component, lone nodes too, meets all others
            every = nodes.select("id").join(roots, "id", "left").select(F.coalesce("root", "id").alias("root")).distinct()
            roots, known = closed(nodes, roots, known, every, groups, scratch)
            links = scratch.write(count_links(nodes, roots, groups), "links")
            recall = audit(nodes, links, roots)
            break
    named = nodes.select("id", "h1", "h2", "copies", "vec").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lead = named.groupBy("root").agg(F.min("vec").alias("component"))
    named = named.join(lead, "root").join(links, "id", "left").select(
        "h1", "h2", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec")
    out = out.select(
        F.when(F.col("vec") != NO_ID, F.col("vec")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NO_ID, component).alias("component_id"), (F.col("vec") == component).alias("kept"))
    return out, recall


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))[0]


QUERIES = {"op9_embeddings": op9_embeddings}

ORACLES = {"op9_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([x * x for x in v]) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v
)
SELECT u AS vec_id, (SELECT count(*) FROM link WHERE link.u = reach.u) AS n_links, min(v) AS component_id, u = min(v) AS kept
FROM reach GROUP BY u
"""}

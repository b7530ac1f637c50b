"""Merkle manifest of a dataset in van Emde Boas layout.

Every row is a leaf: the SHA-256 of its fields, each with its length. Leaves of
one group (lang) ascend by id; runs of ``FAN`` nodes become their parent until
one is left, the group's subroot. The subroots, by group, give the root.

The tree is cut into aligned blocks of ``height`` levels (``FAN ** height``
leaves). A block is one row that holds its nodes in van Emde Boas order: the
levels are split at half height, the top subtree comes first, then the bottom
subtrees one after another, each laid out the same way. A node's place follows
from its depth and index alone (``layout``), in building and in looking up
siblings. Block roots are the leaves of the next table of blocks, until each
group has one; the tables shrink by ``FAN ** height`` a round.

Ranks come from range partitions and their counts, so a group that holds a
third of all rows is spread over as many tasks as its size asks for; no task
holds more than a block and its batch. Proofs run from the root down: what lies
above a block is joined to it, once a block.

Defined cases: a null field is ``-``; null groups come first, null ids first in
their group; rows of equal id are ordered by leaf, equal rows are leaves of
their own; a single leaf is its group's subroot; an empty table gives no
blocks and no rows. Only the columns named here are read, so further columns
of any name don't matter, and none pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, ascii_lower, bucket_count, table

FAN = 8
HEIGHT = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    """The leaf digest, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def layout(levels: int) -> list:
    """Places of a full subtree's nodes in van Emde Boas order: one array by
    depth, indexed by the node's number from the left."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top = levels // 2
    head, tail = layout(top), layout(levels - top)
    first, size = (FAN ** top - 1) // (FAN - 1), (FAN ** (levels - top) - 1) // (FAN - 1)
    starts = first + np.arange(FAN ** top)[:, None] * size
    return head + [(starts + places).ravel() for places in tail]


def height_of(n: int) -> int:
    """Rounds until one of ``n`` nodes is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def digest_of(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join([x.hex() for x in nodes]).encode()).digest()


def block_nodes(leaves: list[bytes], height: int) -> bytes:
    """A block's nodes in layout order; places without a node stay zero."""
    places = layout(height + 1)
    out = bytearray(DIGEST * sum(len(p) for p in places))
    level = leaves
    for depth in range(height, -1, -1):
        for p, node in zip(places[depth], level):
            out[DIGEST * p:DIGEST * (p + 1)] = node
        if depth:
            level = [digest_of(level[i:i + FAN]) for i in range(0, len(level), FAN)]
    return bytes(out)


class Block:
    """Sibling lookups in one block. A step of a path is two bytes (number of
    siblings, own place among them) and the siblings' digests."""

    def __init__(self, nodes: bytes, height: int, leaves: int):
        self.nodes, self.height = nodes, height
        self.places = layout(height + 1)
        self.counts = [-(-leaves // FAN ** (height - d)) for d in range(height + 1)]

    def node(self, depth: int, index: int) -> bytes:
        p = DIGEST * int(self.places[depth][index])
        return self.nodes[p:p + DIGEST]

    def path(self, index: int) -> bytes:
        out = []
        for depth in range(self.height, 0, -1):
            first = index // FAN * FAN
            run = range(first, min(first + FAN, self.counts[depth]))
            out.append(bytes([len(run) - 1, index - first]))
            out += [self.node(depth, i) for i in run if i != index]
            index //= FAN
        return b"".join(out)


def fold(start: bytes, path: bytes) -> tuple[bytes, str]:
    """What a path leads to from ``start``, and the siblings on it as text."""
    at, now, seen = 0, start.hex(), []
    while at < len(path):
        n, place = path[at], path[at + 1]
        siblings = path[at + 2:at + 2 + DIGEST * n].hex()
        cut = 2 * DIGEST * place
        now = hashlib.sha256((siblings[:cut] + now + siblings[cut:]).encode()).hexdigest()
        seen.append(siblings)
        at += 2 + DIGEST * n
    return bytes.fromhex(now), "".join(seen)


def ranked(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``rank`` in its ``grp`` (from 0, by ``order``) and the
    group's ``n``, by range partitions and their counts."""
    parts = bucket_count(df, least=8)
    tie = df.withColumn("uid", F.monotonically_increasing_id())
    spread = tie.repartitionByRange(parts, "grp", *order, "uid").sortWithinPartitions("grp", *order, "uid")
    placed = scratch.write(spread.withColumn("at", F.monotonically_increasing_id()).drop("uid"), "ranges")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("grp", part).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    group = Window.partitionBy("grp")
    runs = (runs.withColumn("before", F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
                .withColumn("n", F.sum("m").over(group)))
    runs = scratch.write(runs.select(F.col("grp").alias("g"), F.col("part").alias("p"), "first", "before", "n"), "runs")
    on = F.col("grp").eqNullSafe(F.col("g")) & (F.shiftright("at", 33) == F.col("p"))
    return (placed.join(runs, on).withColumn("rank", F.col("before") + F.col("at") - F.col("first"))
                  .drop("g", "p", "first", "before", "at"))


BLOCK = "grp string, block long, n long, height int, leaves int, nodes binary, ids array<long>, altered array<binary>"


def blocks_of(leaves: DataFrame, height: int) -> DataFrame:
    """Blocks of ``leaves`` (grp, rank, n, digest, id, altered)."""
    width = FAN ** height

    def build(t):
        t = t.sort_by("rank")
        n = t.column("n")[0].as_py()
        h = height if n > width else height_of(n)
        return pa.table({
            "grp": t.column("grp").slice(0, 1), "block": t.column("block").slice(0, 1), "n": pa.array([n], pa.int64()),
            "height": pa.array([h], pa.int32()), "leaves": pa.array([t.num_rows], pa.int32()),
            "nodes": pa.array([block_nodes(t.column("digest").to_pylist(), h)], pa.binary()),
            "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())),
            "altered": pa.array([t.column("altered").to_pylist()], pa.list_(pa.binary()))})

    keyed = leaves.withColumn("block", F.floor(F.col("rank") / width).cast("long"))
    return keyed.groupBy("grp", "block").applyInArrow(build, BLOCK)


def forest(leaves: DataFrame, height: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """All tables of blocks, from the leaves up, and the groups' subroots."""
    width = FAN ** height
    tables, tops = [], []
    while True:
        blocks = scratch.write(blocks_of(leaves, height), "blocks")
        tables.append(blocks)
        roots = blocks.select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / width).cast("long").alias("n"),
                              F.substring("nodes", 1, DIGEST).alias("digest"))
        tops.append(roots.where("n = 1").select("grp", F.col("digest").alias("subroot")))
        leaves = roots.where("n > 1").select("*", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered"))
        if leaves.isEmpty():
            break
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    return tables, subroots


def below(blocks: DataFrame, height: int) -> DataFrame:
    """For every leaf of ``blocks`` (with their own path ``up``): its rank and
    its path to the root."""
    width = FAN ** height

    def expand(batches):
        for b in batches:
            for grp, block, h, m, nodes, up in zip(*[b.column(c).to_pylist() for c in ("grp", "block", "height", "leaves", "nodes", "up")]):
                tree = Block(nodes, h, m)
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array([grp] * m, pa.string()), "b": pa.array(range(block * width, block * width + m), pa.int64()),
                    "up": pa.array([tree.path(i) + up for i in range(m)], pa.binary())})

    return blocks.select("grp", "block", "height", "leaves", "nodes", "up").mapInArrow(expand, "g string, b long, up binary")


def with_paths(tables: list[DataFrame], tops: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """The lowest blocks with ``up``, the path from the block's root to the
    root. ``tops`` has the path ``up`` above each group's subroot."""
    ends = tops.select(F.col("grp").alias("g"), F.lit(0).cast("long").alias("b"), "up")
    width, upper = FAN ** height, None
    for blocks in reversed(tables):
        last = blocks.where(F.col("n") <= width)  # a group's top block
        paths = ends if upper is None else scratch.write(upper, "paths")
        on = F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))
        found = last.join(ends, on).drop("g", "b")
        if upper is not None:
            found = found.unionByName(blocks.where(F.col("n") > width).join(paths, on).drop("g", "b"))
        upper = below(found, height)
    return found


class Manifest:
    """Tables of a dataset's manifest: ``blocks`` (list of tables, leaves
    first), ``subroots`` (grp, subroot) and ``root`` (one row), with the
    blocks of the groups' tree in ``top``."""

    def __init__(self, rows: DataFrame, height: int = HEIGHT):
        """``rows``: grp string, id long, digest binary, altered binary (a
        digest to check in place of the row's own, or null)."""
        if height < 1:
            raise ValueError("a block has one level at least")
        self.height = height
        self.scratch = Scratch(rows.sparkSession, "merkle")
        leaves = self.scratch.write(rows.select("grp", "id", "digest", "altered"), "leaves")
        self.blocks, subroots = forest(ranked(leaves, ["id", "digest"], self.scratch), height, self.scratch)
        self.subroots = self.scratch.write(subroots, "subroots")
        named = self.subroots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("digest"))
        top = self.scratch.write(ranked(named, ["name"], self.scratch), "groups")
        self.names = top.select("rank", "name", F.col("digest").alias("subroot"))
        bare = top.select("grp", "rank", "n", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered"))
        self.top, self.root = forest(bare, height, self.scratch)

    def proofs(self) -> DataFrame:
        """One row a leaf: id, leaf, subroot, root, proof (siblings' digests as
        text, from the leaf up), folded (root recomputed from ``altered``, else
        from the leaf) and verified."""
        s, h = self.scratch, self.height
        none = self.root.select("grp", F.lit(b"").alias("up"))
        above = s.write(below(with_paths(self.top, none, h, s), h), "above").select(F.col("b").alias("rank"), "up")
        groups = self.names.join(above, "rank").select(F.col("name").alias("grp"), "subroot", "up")
        root = self.root.select(F.col("subroot").alias("root"))  # one row
        groups = s.write(groups.join(F.broadcast(root), F.lit(True)), "tops")
        low = with_paths(self.blocks, groups, h, s)
        ends = groups.select(F.col("grp").alias("g"), "subroot", "root")
        low = low.join(ends, F.col("grp").eqNullSafe(F.col("g")))

        def prove(batches):
            for b in batches:
                for r in b.to_pylist():
                    tree, m = Block(r["nodes"], r["height"], r["leaves"]), r["leaves"]
                    own = [tree.node(r["height"], i) for i in range(m)]
                    folds = [fold(own[i] if a is None else a, tree.path(i) + r["up"]) for i, a in enumerate(r["altered"])]
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(r["ids"], pa.int64()), "leaf": pa.array([x.hex() for x in own], pa.string()),
                        "subroot": pa.array([r["subroot"].hex()] * m, pa.string()), "root": pa.array([r["root"].hex()] * m, pa.string()),
                        "proof": pa.array([p for _, p in folds], pa.string()), "folded": pa.array([f.hex() for f, _ in folds], pa.string()),
                        "verified": pa.array([f == r["root"] for f, _ in folds], pa.bool_())})

        return (low.select("height", "leaves", "nodes", "ids", "altered", "up", "subroot", "root")
                   .mapInArrow(prove, "id long, leaf string, subroot string, root string, proof string, folded string, verified boolean"))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of documents by lang; where ``tampered`` holds, ``altered`` is
    the leaf of the row with its text's A-Z lower-cased."""
    c = {name: F.col(name) for name in FIELDS}
    changed = leaf(*[ascii_lower(c[x]) if x == "text" else c[x] for x in FIELDS])
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf(*[c[x] for x in FIELDS]).alias("digest"),
                       F.when(F.lit(False) if tampered is None else tampered, changed).alias("altered"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return Manifest(document_leaves(docs, third)).proofs().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), "verified")


QUERIES = {"op11_merkle": op11_merkle}

# Level by level; a level's nodes keep their run's list, so a proof is the
# list without the own place. ROUNDS levels hold 8 ** ROUNDS leaves a lang.
ROUNDS, GROUP_ROUNDS = 9, 4


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR END"


def _levels(name: str, first: str, key: str, rounds: int) -> str:
    """CTEs name0..: (key, i, h, n): nodes of each level; run: list of hashes
    by parent. A group that is down to one node keeps it, with no run."""
    out = [f"{name}0 AS ({first})"]
    for k in range(rounds):
        out.append(f"{name}r{k} AS (SELECT {key}, i // 8 AS p, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"""{name}{k + 1} AS (
  SELECT {key}, p AS i, sha256(array_to_string(hs, '')) AS h, count(*) OVER (PARTITION BY {key}) AS n FROM {name}r{k}
  UNION ALL SELECT {key}, i, h, n FROM {name}{k} WHERE n = 1)""")
    return ",\n".join(out)


def _folds(name: str, key: str, start: str, rounds: int, source: str) -> str:
    out, now = [], source
    for k in range(rounds):
        cut = "(c.i % 8)::BIGINT"
        out.append(f"""{start}{k} AS (
  SELECT c.* EXCLUDE (i, now, proof), c.i // 8 AS i,
         CASE WHEN hs IS NULL THEN now ELSE sha256(array_to_string(list_concat(list_concat(hs[:{cut}], [now]), hs[{cut} + 2:]), '')) END AS now,
         CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(list_concat(hs[:{cut}], hs[{cut} + 2:]), '') END AS proof
  FROM {now} c LEFT JOIN {name}r{k} r ON r.{key} IS NOT DISTINCT FROM c.{key} AND r.p = c.i // 8)""")
        now = f"{start}{k}"
    return ",\n".join(out)


_PLAIN = " || ".join(_field(x) for x in FIELDS)
_LOWER = " || ".join(_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if x == "text" else x) for x in FIELDS)
ORACLES = {"op11_merkle": f"""
WITH crc(t) AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i)
  FROM range(256) r(i)
), d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256({_PLAIN}) AS h,
               CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                         lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) % 3 = 0
                    THEN sha256({_LOWER}) ELSE sha256({_PLAIN}) END AS now
        FROM documents, crc)
), {_levels("l", "SELECT lang, i, h, n FROM d", "lang", ROUNDS)},
s AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 0 AS z FROM l{ROUNDS}
), {_levels("g", "SELECT z, i, subroot AS h, n FROM s", "z", GROUP_ROUNDS)},
c AS (
  SELECT doc_id, lang, 0 AS z, h AS leaf, now, '' AS proof, i FROM d
), {_folds("l", "lang", "f", ROUNDS, "c")},
e AS (
  SELECT f.* EXCLUDE (i), s.i, s.subroot FROM f{ROUNDS - 1} f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang
), {_folds("g", "z", "k", GROUP_ROUNDS, "e")}
SELECT doc_id, leaf, subroot, g.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = g.h AS verified
FROM k{GROUP_ROUNDS - 1}, g{GROUP_ROUNDS} g
"""}

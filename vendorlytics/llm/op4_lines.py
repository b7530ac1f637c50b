"""Line dedup with levelled sorted runs of line hashes.

Documents are taken in batches of rising doc_id. The line hashes known so far
lie in runs: tables sorted and bucketed by hash that hold (hash, owner), the
owner being the smallest doc_id with the line. A batch

1. reduces its own lines to one row per hash before anything meets the runs,
   so a line that a third of all documents hold is one row there;
2. merge-joins these rows with the runs, bucket by bucket, without shuffling
   a run again: hashes found there are old, the rest are new;
3. adds the new ones as a run of level 0.

Whenever a level holds ``fanout`` runs they are compacted into one run of the
next level, so a batch meets few runs however many batches came before.

A line's key is the line without ASCII spaces at both ends and with A-Z
lower-cased. Keys of ``least`` or more code points that occur in two or more
documents keep their lines in the smallest doc_id only (all of them there).

Defined cases: a null or empty text is one empty line; null doc_ids count as
one document after all others; rows with the same doc_id are one document;
a document that loses all lines keeps the empty text; an empty table gives an
empty result; other columns pass through under any name but ``n_lines`` and
``n_dropped``, which raise ``ValueError``. Keys are compared by 128-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, ascii_lower, bucket_count, given, packed, quoted, table

LEAST = 10
BATCHES = 4
FANOUT = 2
LEAST_BUCKETS = 8
SPACES = " \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class Runs:
    """The levelled runs: bucketed, sorted tables of (h1, h2, owner)."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = FANOUT):
        self.scratch, self.spark, self.fanout = scratch, scratch.spark, fanout
        self.buckets = buckets
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = self.scratch.path("run")
        name = "llm_run_" + path.rsplit("/", 2)[1].replace("-", "_") + "_" + path.rsplit("/", 1)[1].replace("-", "_")
        (df.repartition(self.buckets, "h1", "h2").write.option("path", path)
           .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        out = self.spark.table(name)
        out._scratch_path = path
        return name, out

    def add(self, df: DataFrame) -> None:
        self.levels[0].append(self._write(df))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = old[0][1]
            for _, run in old[1:]:
                merged = merged.unionByName(run)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            self._forget(old)
            level += 1

    def _forget(self, runs) -> None:
        for name, run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(run)

    def probe(self, keys: DataFrame) -> DataFrame:
        """``keys`` (one row per hash) with the owner from the runs, or null."""
        found = []
        for i, (_, run) in enumerate(r for level in self.levels for r in level):
            keys = keys.join(run.select("h1", "h2", F.col("owner").alias(f"owner{i}")), ["h1", "h2"], "left")
            found.append(F.col(f"owner{i}"))
        owner = F.coalesce(*found) if found else F.lit(None).cast("long")
        return keys.withColumn("known", owner).drop(*[f"owner{i}" for i in range(len(found))])

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)


def line_keys(docs: DataFrame, text: str, least: int) -> DataFrame:
    """One row per line that can be dropped: document, row, index, hash."""
    lines = F.transform(lines_of(F.col(quoted(text))), key_of)
    return (docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(quoted(text))).alias("row"), F.posexplode(lines).alias("i", "key"))
                .where(F.length("key") >= least)
                .select("doc", "row", "i", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))


def dropped_lines(docs: DataFrame, text: str = "text", least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT,
                  scratch: Scratch | None = None) -> DataFrame:
    """(doc, row, drop): the line indices that each document row loses."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    cuts = [k / batches for k in range(1, batches)]
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    found = docs.select(F.percentile_approx(doc, cuts, 1000).alias("c")).first()["c"] or []  # any cuts give the same result
    edges = [None, *sorted(set(found)), None]
    # about an input split's lines a bucket, however large the input is
    runs, drops = Runs(scratch, bucket_count(docs, least=LEAST_BUCKETS), fanout), []
    for lo, hi in zip(edges, edges[1:]):
        part = docs
        if lo is not None:
            part = part.where((F.col("doc_id") > lo) | F.col("doc_id").isNull())
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        lines = scratch.write(line_keys(part, text, least), "lines")
        keys = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        keys = scratch.write(runs.probe(keys), "keys")
        old = keys.where("known is not null or first <> last").select("h1", "h2", F.coalesce("known", "first").alias("owner"))
        # the owner's own lines stay, so a hot line's rows meet one row here
        gone = lines.join(old, ["h1", "h2"]).where("doc <> owner")
        drops.append(scratch.write(gone.groupBy("doc", "row").agg(F.collect_set("i").alias("drop")), "drops"))
        scratch.drop(lines)
        if hi is not None:
            runs.add(keys.where("known is null").select("h1", "h2", F.col("first").alias("owner")))
        scratch.drop(keys)
    runs.close()
    out = drops[0]
    for d in drops[1:]:
        out = out.unionByName(d)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the kept text, and ``n_lines`` and ``n_dropped`` added."""
    clash = {"n_lines", "n_dropped"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    drops = dropped_lines(docs, text, least, batches, fanout)
    body = F.col(quoted(text))
    rows = packed(docs, doc=F.coalesce("doc_id", F.lit(NO_ID)), row=F.xxhash64(body))
    hit = rows.join(drops, ["doc", "row"], "left").withColumn("lines", lines_of(F.col(f"given.{quoted(text)}")))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col(f"given.{quoted(text)}"), F.lit(""))).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n"))
    return hit.select(
        *given(docs, **{text: kept}), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_lines": op4_lines}

ORACLES = {"op4_lines": r"""
WITH l AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS d, i,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents)
), owned AS (
  SELECT k, min(d) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT d) >= 2
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE owner IS NOT NULL AND d <> owner) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE owner IS NULL OR d = owner), '')) AS kept_sha256
FROM l LEFT JOIN owned USING (k) GROUP BY l.doc_id
"""}

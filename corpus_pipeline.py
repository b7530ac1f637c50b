"""Corpus pipeline: five stages, each one operator of ``vendorlytics.llm``.

1. quality classifier (6): documents with a predicted label of 0 go.
2. line dedup (4): repeated lines stay in the smallest doc_id only.
3. n-gram Jaccard join (5): of each near-duplicate group the smallest doc_id
   stays; of several rows with that doc_id, the one with the smallest text hash.
4. mixing (1): rows are put in the order of the weighted mix.
5. BPE (10): number of tokens, digests of the ids and of the decoded text, and
   the row's stream and position in the mix, which follow from the rows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; line dedup sets ``n_chars`` to the new
text's length. Rows without words link with nothing and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm import op1_mixing, op4_lines, op5_jaccard, op6_quality, op10_bpe
from vendorlytics.llm.common import Scratch, quoted, table


def apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *added: str) -> DataFrame:
    """The columns of ``docs`` after ``step``, which adds the columns ``added``
    and drops or changes rows. An input column with one of these names has
    another one meanwhile."""
    moved = {c: f"given {i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    out = step(docs.withColumnsRenamed(moved))
    return out.select(*[F.col(quoted(moved.get(c, c))).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return apart(docs, lambda d: op6_quality.classify(d, labels).where("predicted = 1"), "score", "predicted")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        out = op4_lines.dedup_lines(d)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out

    return apart(docs, step, "n_lines", "n_dropped")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_jaccard.first_of_groups(docs)


def mixed(docs: DataFrame) -> DataFrame:
    return op1_mixing.mix(docs, op1_mixing.RECIPE, op1_mixing.REST_WEIGHT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apart(docs, lambda d: mixed(d).orderBy("position"), *op1_mixing.ADDED)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixed(docs.select("doc_id", "text", "source")).select("doc_id", "text", "stream", "position")
    return op10_bpe.digest(op10_bpe.encode_decode(placed), "stream", "position")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("bpe", tokenize)]

# The classifier and the near-duplicate join can't be written in SQL over
# whole tables; tests/llm/test_pipeline.py holds run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs

"""The pipeline against a brute-force version of its deterministic stages."""

from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import AWKWARD, DOCS, jaccard_groups, tables
from tests.llm.test_operators import lines_kept
from vendorlytics.llm import op1_mixing, op6_quality, op10_bpe


def brute(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = op6_quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1").select("doc_id", "text").collect()
    texts = [(None if d == "None" else int(d), t) for d, _, t in lines_kept([tuple(r) for r in kept])]
    root, first = jaccard_groups([t for _, t in texts]), {}
    for i, (d, t) in enumerate(texts):
        key = root[i] if t.split() else ("empty", i)
        if key not in first or (texts[first[key]][0] is None, texts[first[key]][0] or 0) > (d is None, d or 0):
            first[key] = i
    lib = Tokenizer.from_file(public_tokenizers.path(op10_bpe.TOKENIZER))
    return Counter((texts[i][0], len(lib.encode(texts[i][1], add_special_tokens=False).ids)) for i in first.values())


def test_pipeline_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    path = tables(spark, docs, labels)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, path).collect())
    assert got == brute(spark, path)


def test_pipeline_rows_hold_the_mix(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    path = tables(spark, docs, labels)
    left = {d for d, _ in brute(spark, path)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[3]) for r in docs if r[0] in left])
    want = con.execute(f"SELECT doc_id, stream, position FROM ({op1_mixing.ORACLES['op1_mixing']})").fetchall()
    got = [(r["doc_id"], r["stream"], r["position"]) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(got) == sorted(want) and len(want) == len(left)


def test_stages_take_awkward_rows(spark):
    path = tables(spark, AWKWARD)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "mix":
            assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))

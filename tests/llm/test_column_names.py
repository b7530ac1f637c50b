"""Extra columns under the operators' own working names come back unchanged."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import AWKWARD, DOCS, tables
from vendorlytics.llm import op1_mixing, op2_pii, op3_urls, op4_lines, op5_jaccard, op6_quality, op10_bpe

WORKING = ["given", "k", "w", "at", "lo", "hi", "q", "t", "r", "d", "c", "i", "u", "v", "a", "b", "n", "h1", "h2", "_h", "_b", "_s", "_n", "_i", "_c",
           "_rank", "_before", "_doc", "_row", "_drop", "_lines", "_extra", "_own", "_node", "doc", "row", "drop", "lines", "line", "key", "owner",
           "known", "first", "last", "root", "id", "said", "own", "node", "plain", "word", "before", "bare", "lead", "start", "end", "extra", "of_doc",
           "of_row", "seed", "pattern", "instance", "component", "lead_row", "y", "x", "stats", "bucket", "with space"]
OUTPUTS = ["stream", "block", "phase", "release", "deadline", "slot", "position", "base", "spans", "host", "path", "rule", "verdict", "n_lines",
           "n_dropped", "score", "predicted", "ids", "decoded", "n_tokens"]


def quoted(c):
    return F.col(f"`{c}`")


def marked(df, names):
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, quality int")


OPERATORS = {
    "op1": lambda d, none: op1_mixing.mix(d, {"src0": 2}, 1), "op2": lambda d, none: op2_pii.find_pii(d), "op4": lambda d, none: op4_lines.dedup_lines(d),
    "op5": lambda d, none: op5_jaccard.first_of_groups(d), "op6": op6_quality.classify, "op10": lambda d, none: op10_bpe.encode_decode(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, none, name):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    out = OPERATORS[name](marked(docs, WORKING), none)
    plain = OPERATORS[name](docs, none)
    rows = out.select(*[quoted(c) for c in WORKING]).distinct().collect()
    assert [list(r) for r in rows] == [[f"mine {c}" for c in WORKING]]
    own = [quoted(c) for c in plain.columns if c not in ("block", "slot", "position", "release", "deadline")]  # ties may swap places
    assert sorted(map(str, out.select(*own).collect())) == sorted(map(str, plain.select(*own).collect()))


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/es/x", '<link rel="canonical" href="http://b.net/q">'), (2, "http://b.net/q", None), (None, None, "")],
                                  "page_id long, url string, html string")
    names = [c for c in WORKING if c != "id"]
    out = op3_urls.judge(marked(pages, names))
    assert {tuple(r) for r in out.select(*[quoted(c) for c in names]).collect()} == {tuple(f"mine {c}" for c in names)}
    plain = op3_urls.judge(pages)
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", dict(corpus_pipeline.STAGES))
def test_stages(spark, tmp_path, name):
    path, stage = tables(spark, AWKWARD), dict(corpus_pipeline.STAGES)[name]
    docs = marked(spark.createDataFrame(AWKWARD, DOCS), WORKING + OUTPUTS)
    docs.write.parquet(os.path.join(tmp_path, "docs"))
    docs = spark.read.parquet(os.path.join(tmp_path, "docs"))
    out = stage(spark, docs, path)
    if name == "bpe":
        assert out.columns[0] == "doc_id" and out.count() == len(AWKWARD)
        return
    assert out.columns == docs.columns
    for r in out.select(*[quoted(c) for c in WORKING + OUTPUTS]).collect():
        assert list(r) == [f"mine {c}" for c in WORKING + OUTPUTS]

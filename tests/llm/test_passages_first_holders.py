"""Passages whose windows only met an unlike first holder are compared."""

import numpy as np
import pytest

from vendorlytics.llm import op8_passages
from vendorlytics.llm.common import Scratch


@pytest.mark.parametrize("copies", [1, 3])
def test_windows_unlike_their_first_holder_meet_each_other(spark, monkeypatch, copies):
    """Documents 1 and up share a passage; every window of theirs met
    document 0 only, which has other words."""
    r = np.random.default_rng(5)
    word = lambda n: [f"v{x}" for x in r.integers(0, 10 ** 6, n)]
    shared = word(60)
    texts = [word(120)] + [" ".join(word(20) + shared + word(30))] * copies + [" ".join(word(20) + shared + word(10))]
    texts[0] = " ".join(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = {x["doc_id"]: x["w"] for x in docs.selectExpr("doc_id", "xxhash64(text) w").collect()}
    pairs = [(0, w[0], 0, 100, d, w[d], 15, 80, -20, c) for d in range(1, len(texts)) for c in (30, 31)]
    monkeypatch.setattr(op8_passages, "candidate_pairs", lambda packed: spark.createDataFrame(pairs, op8_passages.PAIR + ", c1 int"))
    out = op8_passages.repeated_passages(docs).collect()
    got = {x["doc_id"]: (x["class_id"], x["first_word"], x["end_word"]) for x in out}
    assert set(got) == set(range(1, len(texts))) and {v[0] for v in got.values()} == {1}
    assert all(a <= 20 and b >= 80 for _, a, b in got.values())


def test_only_windows_still_apart_are_compared(spark):
    """1 agrees with the first holder at centre 20, 2 doesn't, 3 met it at another centre."""
    scratch = Scratch(spark, "apart")
    rows = [(0, 9, 0, 60, 1, 1, 0, 60, 0, 20), (0, 9, 0, 60, 2, 2, 10, 70, -10, 20), (0, 9, 100, 160, 3, 3, 0, 60, 100, 120)]
    pairs = op8_passages.stretches(spark.createDataFrame(rows, op8_passages.PAIR + ", c1 int"), scratch)
    number = {x["d2"]: x["pair"] for x in pairs.collect()}
    good = spark.createDataFrame([(number[1], 0, 50), (number[3], 100, 150)], "pair long, a1 int, b1 int")
    more = op8_passages.still_apart(pairs, good, scratch)
    assert [(x["d1"], x["a1"], x["d2"], x["a2"], x["least"], x["most"]) for x in more.collect()] == [(2, 10, 1, 0, 10, 10)]
    all_good = spark.createDataFrame([(n, 0, 160) for n in number.values()], "pair long, a1 int, b1 int")
    assert op8_passages.still_apart(pairs, all_good, scratch) is None

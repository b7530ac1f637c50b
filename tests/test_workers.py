"""Python-side helpers run on workers that cannot import the package."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from vendorlytics.operators.fold import greedy_consume
ch = spark.createDataFrame([(0, i, 3) for i in range(40)], "k long, s long, a long")
st = spark.createDataFrame([(0, 100)], "k long, b long")
for most in (1, 1000):
    rows, final = greedy_consume(ch, st, ["k"], ["s"], "a", "b", max_list=most, segment_rows=10)
    assert rows.where("accepted").count() == 33 and final.first()["b"] == 1
print("OK")
"""


def test_folds_from_a_foreign_directory():
    cwd = tempfile.mkdtemp(prefix="vl-cwd-")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]

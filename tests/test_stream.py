"""B8 survives a restart: two runs on one checkpoint equal the batch fold."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from vendorlytics.plans.billing import subscription_state
from vendorlytics.sources.tables import FixtureTables
from vendorlytics.streaming import billing_stream
from vendorlytics.streaming.billing_stream import (latest_version, read_state, run_billing_stream, scratch,
                                                   write_event_files)

COLS = ["id", "suscripcion_estado", "suscripcion_plan", "suscripcion_inicio", "suscripcion_fin",
        "stripe_subscription_id", "stripe_customer_id"]


def test_restart_continues_from_checkpoint(spark):
    t = FixtureTables(spark, SMALL)
    ev = t.billing()
    mid = ev.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    src, state = scratch(spark, "t-src"), scratch(spark, "t-state")
    write_event_files(ev.where(F.col("event_id") <= mid), src, 2)
    v1 = run_billing_stream(t, src, state, compact_every=3)
    assert run_billing_stream(t, src, state, compact_every=3) == v1   # nothing new: same version
    write_event_files(ev.where(F.col("event_id") > mid), src, 2, duplicate_chunks=(0,))
    v2 = run_billing_stream(t, src, state, compact_every=3)
    assert v2 > v1 == latest_version(spark, state) - (v2 - v1)
    got = sorted(map(tuple, read_state(spark, f"{state}/users", v2, 3).select(*COLS).collect()))
    want = sorted(map(tuple, subscription_state(t).select(*COLS).collect()))
    assert got == want


def test_chunks_of_several_files_and_repeated_deliveries(spark, monkeypatch):
    """A chunk's files are written side by side and taken by one batch; a
    chunk delivered again isn't folded again, and the result is the batch fold."""
    t = FixtureTables(spark, SMALL)
    src, state = scratch(spark, "t-src"), scratch(spark, "t-state")
    files = write_event_files(t.billing(), src, 2, duplicate_chunks=(0,), file_rows=200)
    per_file = spark.read.json(src).groupBy(F.input_file_name()).count().collect()
    assert files == 2 and len(per_file) == 3 * files
    folds = []
    monkeypatch.setattr(billing_stream, "apply_batch", lambda *a, real=billing_stream.apply_batch: folds.append(1) or real(*a))
    v = run_billing_stream(t, src, state, max_files_per_trigger=files, compact_every=3)
    assert len(folds) == 2
    got = sorted(map(tuple, read_state(spark, f"{state}/users", v, 3).select(*COLS).collect()))
    assert got == sorted(map(tuple, subscription_state(t).select(*COLS).collect()))

"""Structured Streaming forms of the billing jobs.

B8: webhook bodies land as JSON files; ``readStream`` with an explicit
schema -> event-time watermark -> ``dropDuplicatesWithinWatermark`` on the
event id (the provider retries, so deliveries are at-least-once) ->
``foreachBatch`` that folds the micro-batch into the per-user state. State
is merge-on-read: each batch writes only the rows it changed as
``delta/v=<batch_id>``, computed from version ``batch_id - 1``, and every
few batches a compacted ``base`` is written. A replayed batch rewrites the
same files: the sink is idempotent and the job survives executor or driver
loss through the streaming checkpoint.

B9: the same source counted per key in clock-aligned 15-minute windows
with a watermark; ``update`` output merged per batch, so every window's
final count is kept without holding all windows in state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.plans.billing import RATE_LIMIT, RATE_WINDOW, subscription_fold
from vendorlytics.session import checkpoint_dir, materialize
from vendorlytics.sources.snapshots import current_version
from vendorlytics.sources.tables import Tables

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("object", T.StringType()),
])

USER_STATE_COLS = ["id", "email", "suscripcion_estado", "suscripcion_plan", "suscripcion_inicio", "suscripcion_fin",
                   "stripe_subscription_id", "stripe_customer_id"]
PAYMENT_COLS = ["id", "usuario_id", "tipo", "monto", "estado", "creado_en", "metodo"]
# Event times travel as text with full microsecond precision.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


FILE_ROWS = 200_000


def write_event_files(events: DataFrame, folder: str, chunks: int = 4, duplicate_chunks: tuple = (),
                      file_rows: int = FILE_ROWS) -> int:
    """Land events as JSON files in arrival order: one write per event-id
    range, so file times follow event order. Chunks listed in
    ``duplicate_chunks`` are delivered twice (a provider retry). Returns the
    number of files of every chunk: more than one, written side by side, if
    the smallest chunk has several times ``file_rows`` rows."""
    bounds = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) // chunks + 1
    parts = [events.where((F.col("event_id") >= lo + i * step) & (F.col("event_id") < lo + (i + 1) * step)) for i in range(chunks)]
    smallest = min(events.agg(*[F.count_if((F.col("event_id") >= lo + i * step) & (F.col("event_id") < lo + (i + 1) * step))
                                for i in range(chunks)]).first())
    files = max(1, smallest // file_rows)
    for i, part in enumerate(parts):
        # dealt in turn: every file has rows, so each chunk has as many files
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        for _ in range(2 if i in duplicate_chunks else 1):
            part.write.mode("append").option("timestampNTZFormat", TS_FORMAT).json(folder)
    return files


def _initial_state(t: Tables, users: DataFrame | None, payments: DataFrame | None):
    u = users if users is not None else t.users()
    if "suscripcion_inicio" not in u.columns:
        u = u.withColumn("suscripcion_inicio", F.lit(None).cast("timestamp_ntz"))
    u = u.withColumn("suscripcion_fin", F.col("suscripcion_fin").cast("timestamp_ntz"))
    p = payments if payments is not None else t.payments()
    if "metodo" not in p.columns:
        p = p.withColumn("metodo", F.lit(None).cast("string"))
    return u.select(*USER_STATE_COLS), p.select(*PAYMENT_COLS)


def apply_batch(t: Tables, events: DataFrame, users: DataFrame, payments: DataFrame):
    """Fold one batch of events into (users, payments) state. Rows have
    ``changed``: whether the batch changed them."""
    f = materialize(subscription_fold(t, events=events, users=users, payments=payments), "billing-folded")
    folded = {"suscripcion_estado": "estado", "suscripcion_plan": "plan", "suscripcion_inicio": "inicio",
              "suscripcion_fin": "fin", "stripe_subscription_id": "sub", "stripe_customer_id": "cus"}
    changed = ~F.lit(True)
    for old, new in folded.items():
        changed = changed | ~F.col(old).eqNullSafe(F.col(new))
    new_users = users.join(f, "id").select("id", "email", *[F.col(new).alias(old) for old, new in folded.items()],
                                           changed.alias("changed"))
    settled = f.select(F.explode("settled").alias("s")).select(F.col("s.pago_id").alias("id"),
                                                               F.lit(True).alias("paid_now"))
    paid_now = F.col("paid_now").isNotNull()
    new_pay = payments.join(settled, "id", "left").select(
        "id", "usuario_id", "tipo", "monto",
        F.when(paid_now, "pagado").otherwise(F.col("estado")).alias("estado"), "creado_en",
        F.when(paid_now, F.lit("card")).otherwise(F.col("metodo")).alias("metodo"), paid_now.alias("changed"))
    return new_users, new_pay


COMPACT_EVERY = 8


def _base_of(v: int, every: int) -> int:
    """Last compacted version at or before ``v`` (-1 = the initial state)."""
    return ((v + 1) // every) * every - 1


def read_state(spark: SparkSession, root: str, v: int, every: int) -> DataFrame:
    """State after version ``v``: the last compacted base plus the deltas
    written since (latest row per id wins). Deltas are few and small, so the
    anti-join against the base is planned with Spark's size check."""
    b = _base_of(v, every)
    base = spark.read.parquet(f"{root}/base/b={b}")
    if v == b:
        return base
    cols = base.columns
    deltas = spark.read.parquet(f"{root}/delta").where((F.col("v") > b) & (F.col("v") <= v))
    latest = deltas.groupBy("id").agg(F.max_by(F.struct(*cols), "v").alias("r")).select("r.*")
    return base.join(latest.select("id"), "id", "left_anti").unionByName(latest)


def committed(spark: SparkSession, folder: str) -> bool:
    """Does the folder have Spark's commit marker?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run_billing_stream(t: Tables, source: str, state: str, lateness: str = "1 day",
                       max_files_per_trigger: int = 1, users: DataFrame | None = None,
                       payments: DataFrame | None = None, compact_every: int = COMPACT_EVERY) -> int:
    """Process every file in ``source``; returns the last version.

    Merge-on-read state: a micro-batch writes only the users and pagos it
    changed (``delta/v=<batch_id>``); every ``compact_every`` batches the
    whole state is rewritten as a new base. Every write is keyed by the batch
    id and computed from the previous version only, so a replayed batch
    rewrites identical files."""
    spark = t.spark
    for name, first in zip(("users", "payments"), _initial_state(t, users, payments)):
        if not committed(spark, f"{state}/{name}/base/b=-1"):  # once, not at a restart
            first.write.mode("overwrite").parquet(f"{state}/{name}/base/b=-1")

    def merge(batch: DataFrame, batch_id: int) -> None:
        prev_u = read_state(spark, f"{state}/users", batch_id - 1, compact_every)
        prev_p = read_state(spark, f"{state}/payments", batch_id - 1, compact_every)
        # written once, so the stateful deduplication runs once a batch
        ev = materialize(batch.select("event_id", "ts", "user_id", "type", "object"), "billing-batch")
        if ev.isEmpty():  # delivered again, or none that came in time: the state stays
            new_u, new_p = (x.withColumn("changed", F.lit(False)) for x in (prev_u, prev_p))
        else:
            new_u, new_p = apply_batch(t, ev, prev_u, prev_p)
        for name, new in (("users", new_u), ("payments", new_p)):
            if _base_of(batch_id, compact_every) == batch_id:
                new.drop("changed").write.mode("overwrite").parquet(f"{state}/{name}/base/b={batch_id}")
            else:
                new.where("changed").drop("changed").write.mode("overwrite").parquet(f"{state}/{name}/delta/v={batch_id}")
        spark.range(1).select(F.lit(batch_id).alias("batch")).write.mode("overwrite") \
            .parquet(f"{state}/_versions/v={batch_id}")

    stream = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("timestampNTZFormat", TS_FORMAT).json(source)
              .withColumn("event_time", F.col("ts").cast("timestamp"))
              .withWatermark("event_time", lateness)
              .dropDuplicatesWithinWatermark(["event_id"]))
    q = (stream.writeStream.foreachBatch(merge).trigger(availableNow=True)
         .option("checkpointLocation", f"{state}/_checkpoint").start())
    q.awaitTermination()
    return latest_version(spark, state)


def latest_version(spark: SparkSession, state: str) -> int:
    """Highest committed state version (also after a restart that found no
    new files, when no batch ran in this process); -1 before any batch. Read
    errors are raised."""
    v = current_version(spark, f"{state}/_versions")
    return -1 if v is None else v


def billing_stream_state(t: Tables, chunks: int = 3, compact_every: int = 2) -> DataFrame:
    """B8 end to end on the fixture: events land in ``chunks`` files (one
    chunk delivered twice), the stream folds them, the final user state is
    returned. Equals the batch fold B5 (``subscription_state``). Compaction
    every 2 batches here, so both deltas and bases are exercised."""
    spark = t.spark
    src, state = scratch(spark, "billing-src"), scratch(spark, "billing-state")
    files = write_event_files(t.billing(), src, chunks, duplicate_chunks=(1,))
    v = run_billing_stream(t, src, state, max_files_per_trigger=files, compact_every=compact_every)
    users = read_state(spark, f"{state}/users", v, compact_every)
    return users.select("id", "suscripcion_estado", "suscripcion_plan", "suscripcion_inicio", "suscripcion_fin",
                        "stripe_subscription_id", "stripe_customer_id")


def rate_limit_stream(t: Tables, limit: int = RATE_LIMIT, chunks: int = 4, lateness: str = "1 hour") -> DataFrame:
    """B9 streaming: windowed counts per key with a watermark; each batch's
    updated windows are appended with the batch id, and the latest count per
    window is the final one."""
    spark = t.spark
    src, out = scratch(spark, "events-src"), scratch(spark, "ratelimit")
    ev = t.read("events").select("event_id", "ts", "user_id", F.col("event_type").alias("type"),
                                 F.col("props").alias("object"))
    files = write_event_files(ev, src, chunks)
    counts = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files)
              .option("timestampNTZFormat", TS_FORMAT).json(src)
              .withColumn("event_time", F.col("ts").cast("timestamp"))
              .withWatermark("event_time", lateness)
              .groupBy(F.window("event_time", RATE_WINDOW), "user_id").agg(F.count(F.lit(1)).alias("solicitudes")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (counts.writeStream.outputMode("update").foreachBatch(sink).trigger(availableNow=True)
         .option("checkpointLocation", f"{out}_checkpoint").start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    final = res.groupBy("window", "user_id").agg(F.max_by("solicitudes", "batch_id").alias("solicitudes"))
    return final.where(F.col("solicitudes") > limit).select(
        "user_id", F.col("window.start").cast("timestamp_ntz").alias("inicio"), "solicitudes")


QUERIES = {
    "billing_stream_state": billing_stream_state,
    "rate_limit_stream": rate_limit_stream,
}

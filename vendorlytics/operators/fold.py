"""Ordered conditional consumption ("greedy first fit") per key.

For each key with a starting balance S and change rows in arrival order,
a row is accepted iff its amount fits what is left, and only accepted rows
reduce the balance. A refused row consumes nothing, so this is not a
running sum. Used by the stock ledger (W2) and the instalment ledger (W6).

Plan, cheapest path first:

1. rows with amount <= 0 or amount > S can never be accepted: refused
   without any ordering work;
2. keys whose remaining rows all fit (sum <= S) accept everything: one
   aggregate, combined map-side, no ordering needed;
3. other keys with at most ``max_list`` rows are folded JVM-side: one
   ``array_sort(collect_list(struct(seq, ...)))`` list per key and
   ``aggregate`` over it (bounded list size by construction);
4. keys with more rows are folded by levels (``_levelled_fold``). While the
   balance lies in [2^k, 2^(k+1)), amounts below 2^k always fit, so they are a
   running sum; the first of these to bring the balance below 2^k, or the
   first amount of 2^k and more that fits, ends the level. Larger amounts are
   refused for good, as the balance never rises. Each round takes every key
   through one level, so there are at most log2(S) + 1 rounds, whatever the
   number of rows. A round is a prefix sum over range partitions of (key,
   seq): sums by partition, their offsets, and row by row only the partitions
   where a level may end. A key that holds a third of all rows is spread over
   as many tasks as its rows ask for.

Amounts and balances are integers (stock units, or money in cents), so the
result is exact and independent of partitioning. No step runs Python code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.session import materialize, materialize_lots, released

MAX_LIST = 2048
SEGMENT_ROWS = 500_000
LOT_ROWS = 24_000_000  # change rows that are dealt out by key at a time
LAST = 2**63 - 1


def _levelled_fold(rows: DataFrame, key: list[str], seq: list[str], segment_rows: int) -> tuple[DataFrame, DataFrame]:
    """rows: (key..., seq..., carry..., __a, __s) with 0 < __a <= __s. Returns
    (rows with ``accepted``, per-key final balance (key..., __end))."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // segment_rows))
    placed = materialize(rows.repartitionByRange(parts, *key, *seq).sortWithinPartitions(*key, *seq)
                         .withColumn("__at", F.monotonically_increasing_id()), "fold-ranges")
    part = F.shiftright("__at", 33)  # the partition that the row was written from
    narrow = placed.select(*key, "__a", "__at", part.alias("__part"))
    state = materialize(placed.groupBy(*key).agg(F.first("__s").alias("__b"))
                        .withColumn("__p", F.lit(-1).cast("long")), "fold-state")
    rounds = []
    while not state.isEmpty():
        low = F.expr("shiftleft(1L, length(bin(__b)) - 1)")  # 2^k <= balance
        open_rows = narrow.join(state, key).where((F.col("__at") > F.col("__p")) & (F.col("__a") <= F.col("__b"))) \
            .withColumn("__low", low)
        small = F.col("__a") < F.col("__low")
        sums = open_rows.groupBy(*key, "__part", "__b", "__low").agg(
            F.sum(F.when(small, F.col("__a")).otherwise(0)).alias("__sum"),
            F.min(F.when(~small, F.col("__a"))).alias("__mid"))
        upto = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
        sums = materialize(sums.withColumn("__cum", F.sum("__sum").over(upto)), "fold-sums")
        left = F.col("__b") - F.col("__cum")
        may_end = (left < F.col("__low")) | (F.col("__mid") <= left + F.col("__sum"))
        sure = sums.where(left < F.col("__low")).groupBy(*key).agg(F.min("__part").alias("__sure"))
        look = sums.where(may_end).join(sure, key, "left").where(F.col("__sure").isNull() | (F.col("__part") <= F.col("__sure"))) \
            .select(*key, "__part", (F.col("__cum") - F.col("__sum")).alias("__before"))
        run = F.sum(F.when(small, F.col("__a")).otherwise(0)).over(
            Window.partitionBy(*key, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
        near = open_rows.join(look, [*key, "__part"]).withColumn("__left", F.col("__b") - F.col("__before") - run)
        after = F.when(small, F.col("__left")).otherwise(F.col("__left") - F.col("__a"))
        ended = near.where(F.when(small, F.col("__left") < F.col("__low")).otherwise(F.col("__a") <= F.col("__left"))) \
            .groupBy(*key).agg(F.min(F.struct(F.col("__at").alias("e"), after.alias("b"))).alias("__end"))
        total = sums.groupBy(*key).agg(F.sum("__sum").alias("__total"))
        done = materialize(state.withColumn("__low", low).join(ended, key, "left").join(total, key, "left").select(
            *key, "__low", "__p", F.coalesce("__end.e", F.lit(LAST)).alias("__e"),
            F.coalesce(F.col("__end.b"), F.col("__b") - F.coalesce("__total", F.lit(0))).alias("__b")), "fold-level")
        rounds.append(done)
        state = done.where((F.col("__e") < LAST) & (F.col("__b") > 0)).select(*key, "__b", F.col("__e").alias("__p"))
    levels = rounds[0]
    for r in rounds[1:]:
        levels = levels.unionByName(r)
    # at most log2(S) + 1 levels a key
    levels = levels.groupBy(*key).agg(F.collect_list(F.struct("__p", "__e", "__low")).alias("__levels"),
                                      F.min("__b").alias("__end"))
    at, a = F.col("__at"), F.col("__a")
    taken = F.exists("__levels", lambda x: (at > x["__p"]) & (at <= x["__e"]) & ((a < x["__low"]) | (at == x["__e"])))
    flags = placed.join(levels.drop("__end"), key).withColumn("accepted", taken).drop("__s", "__at", "__levels")
    return flags, levels.select(*key, "__end")


def greedy_consume(changes: DataFrame, start: DataFrame, key: list[str], seq: list[str], amount: str,
                   balance: str, carry: list[str] = (), max_list: int = MAX_LIST,
                   segment_rows: int = SEGMENT_ROWS, lot_rows: int = LOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Fold ``changes`` (key, seq..., amount, carry...) against ``start``
    (key, balance). Both amount and balance must be integral.

    Returns (rows, final): rows = (key..., seq..., carry..., accepted), one
    per change row; final = (key..., balance) for every key of ``start``.
    Change rows whose key has no start balance get accepted = NULL (the
    caller decides the reason). The carried columns travel through every
    path, so no join back to the change table is needed.

    The joined input (with each key's path) is written once to the shared
    checkpoint folder, so the branches below read it instead of
    recomputing the change table. Keys are dealt out in lots of about
    ``lot_rows`` change rows, one after the other, so that the shuffle files
    are those of one lot, not of the whole change table.
    """
    carry = [c for c in carry if c not in key and c not in seq]
    cols = [*key, *seq, *carry]
    ch = changes.select(*cols, F.col(amount).cast("long").alias("__a"))
    st = start.select(*key, F.col(balance).cast("long").alias("__s"))
    # a key's hash is the same on both sides only for one type
    alike = [ch.schema[k].dataType for k in key] == [st.schema[k].dataType for k in key]
    lots = max(1, -(-ch.count() // lot_rows)) if alike else 1

    def joined(i: int) -> DataFrame:
        mine = F.lit(True) if lots == 1 else F.pmod(F.xxhash64(*key), F.lit(lots)) == i
        j = ch.where(mine).join(st.where(mine), key, "left")
        never = F.col("__s").isNull() | (F.col("__a") <= 0) | (F.col("__a") > F.col("__s"))
        stats = j.where(~never).groupBy(*key).agg(F.sum("__a").alias("__sum"), F.count(F.lit(1)).alias("__n"))
        path = (F.when(F.col("__s").isNull(), F.lit("unknown")).when(never, F.lit("never"))
                .when(F.col("__sum") <= F.col("__s"), F.lit("all"))
                .when(F.col("__n") <= max_list, F.lit("list")).otherwise(F.lit("levels")))
        return j.join(stats, key, "left").withColumn("__path", path).drop("__n")

    with released(ch.sparkSession):
        j = materialize_lots(ch.sparkSession, joined, lots, "fold-input")

    simple = j.where(F.col("__path").isin("unknown", "never", "all")).select(
        *cols, F.when(F.col("__path") == "all", F.lit(True))
        .when(F.col("__path") == "never", F.lit(False)).alias("accepted"))

    # Bounded lists: JVM-side fold with aggregate().
    lists = j.where(F.col("__path") == "list").groupBy(*key).agg(
        F.first("__s").alias("__s"),
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in seq], F.col("__a"),
                                             *[F.col(c) for c in carry]))).alias("__rows"))
    init = F.struct(F.col("__s").alias("rem"), F.array().cast("array<boolean>").alias("ok"))
    folded = lists.select(*key, F.aggregate(
        "__rows", init,
        lambda acc, x: F.struct(
            F.when(x["__a"] <= acc["rem"], acc["rem"] - x["__a"]).otherwise(acc["rem"]).alias("rem"),
            F.array_append(acc["ok"], x["__a"] <= acc["rem"]).alias("ok")),
    ).alias("__st"), "__rows")
    listed = folded.select(*key, F.explode(F.arrays_zip(F.col("__rows").alias("r"),
                                                        F.col("__st.ok").alias("ok"))).alias("z")) \
        .select(*key, *[F.col(f"z.r.{c}").alias(c) for c in [*seq, *carry]], F.col("z.ok").alias("accepted"))

    rows = simple.unionByName(listed)
    ends = (j.where(F.col("__path") == "all").groupBy(*key).agg(F.first(F.col("__s") - F.col("__sum")).alias("__end"))
            .unionByName(folded.select(*key, F.col("__st.rem").alias("__end"))))

    # Keys with more rows: by levels, spread over range partitions.
    many = j.where(F.col("__path") == "levels").select(*cols, "__a", "__s")
    if not many.isEmpty():
        flags, level_ends = _levelled_fold(many, key, seq, segment_rows)
        rows = rows.unionByName(flags.select(*cols, "accepted"))
        ends = ends.unionByName(level_ends)

    final = st.join(ends, key, "left").select(*key, F.coalesce(F.col("__end"), F.col("__s")).alias(balance))
    return rows, final

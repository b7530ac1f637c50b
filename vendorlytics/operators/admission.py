"""Admission rules that the reference checks request by request: per-owner
quotas and unique values (SKU, slug) claimed in arrival order.

A request's outcome depends only on the outcomes of *earlier* requests, so
the batch has exactly one sequential answer. We compute it set-wise:

* quota: with rejected requests using no slot, the accepted ones are the
  first ``cap`` candidates of their owner; ``quota_fill`` finds the seq of
  the cap-th candidate per owner with a top-k (constant k, so Spark plans a
  partial WindowGroupLimit and a hot owner never lands whole in one task);
* when quota and unique claims interact (W8), ``fixpoint`` iterates the
  set-wise step A_{k+1} = step(A_k) until nothing changes. Each request
  depends only on earlier ones, so a fixed point is the sequential answer;
  the number of rounds is the length of the longest chain of dependent
  decisions, not the batch size, and there is no limit to it: every round
  settles at least the earliest undecided request. Each round's flags are
  written to the shared checkpoint folder (``materialize``) to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.operators.topk import top_k
from vendorlytics.session import materialize


def seq_struct(seq: list[str]) -> F.Column:
    return F.struct(*[F.col(c) for c in seq])


def quota_fill(cands: DataFrame, owner: str, seq: list[str], cap_col: str, max_cap: int) -> DataFrame:
    """owner -> ``fill`` = seq struct of the cap-th candidate (cap >= 1),
    for owners with at least cap candidates. ``cap_col`` <= ``max_cap``."""
    ranked = top_k(cands.select(owner, cap_col, *seq), [owner], [F.asc(c) for c in seq], max_cap, "__rank")
    return ranked.where(F.col("__rank") == F.col(cap_col)).select(owner, seq_struct(seq).alias("fill"))


def quota_ok(limited, cap, fill, seq: list[str]) -> F.Column:
    """A request passes the quota when the owner is unlimited, or slots
    remain (cap > 0) and it is not after the request that used the last one."""
    return (~limited) | ((cap > 0) & (fill.isNull() | (seq_struct(seq) <= fill)))


def _rounds(step, flags: DataFrame, key: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """(flags, settled?) after as many rounds as it takes, or ``most``."""
    cur, done = materialize(flags, "admission-flags"), 0
    while most is None or done < most:
        nxt = materialize(step(cur), "admission-flags")
        diff = nxt.alias("n").join(cur.alias("c"), key).where(~F.col("n.ok").eqNullSafe(F.col("c.ok")))
        cur, done = nxt, done + 1
        if diff.isEmpty():
            return cur, True
    return cur, False


def fixpoint(step, flags: DataFrame, key: str) -> DataFrame:
    """Iterate ``flags -> step(flags)`` (DataFrames of (key, ok)) until no
    flag changes."""
    return _rounds(step, flags, key)[0]


# Long chains of claims: set-wise rounds before they are taken in order, and
# requests that one task takes at a time.
CLAIM_ROUNDS = 4
CLAIM_BLOCK = 200_000


def _fold_claims(batches):
    """One block of claims in arrival order. Rows come sorted: what is held
    (kind 0), then the requests (kind 1) by seq. Gives the accepted requests
    (kind 1) and what owners that moved hold now (kind 0)."""
    import pyarrow as pa

    holds, holders, moved, accepted, same, at = {}, {}, set(), [], [], None

    def settle():
        # requests of one arrival see what was held before it
        free = [r for r in same if r[1] is None or not holders.get(r[3], set()) - {r[0]}]
        for owner, _, req, value in free:
            accepted.append(req)
            if owner in holds:
                holders[holds[owner]].discard(owner)
            holds[owner] = value
            holders.setdefault(value, set()).add(owner)
            moved.add(owner)

    schema = None
    for batch in batches:
        schema = batch.schema
        for kind, owner, seq, req, value in zip(*(batch.column(c).to_pylist() for c in ("kind", "owner", "seq", "req", "value"))):
            if kind == 0:
                holds[owner] = value
                holders.setdefault(value, set()).add(owner)
                continue
            if same and seq != at:
                settle()
                same = []
            at = seq
            same.append((owner, seq, req, value))
    settle()
    if schema is not None:
        rows = [{"kind": 1, "req": r, "owner": None, "value": None} for r in accepted]
        rows += [{"kind": 0, "req": None, "owner": o, "value": holds[o]} for o in moved]
        out = pa.schema([schema.field(c) for c in ("kind", "req", "owner", "value")])
        yield pa.RecordBatch.from_pylist(rows, out)


def _claims_in_order(asks: DataFrame, held: DataFrame, block_rows: int) -> DataFrame:
    """The accepted ones (req) of ``asks`` (req, owner, seq, value), which
    only the holders of their values can block. ``held``: (owner, value).

    Blocks of arrival order, one after the other: a task gets one block and
    what is held of its values and by its owners, and gives what changed. So
    a chain of claims, each waiting for the one before, costs a step a block
    and not a round a link; no task sees more than a block."""
    blocks = -(-asks.count() // block_rows)
    placed = materialize(asks.repartitionByRange(blocks, F.col("seq").asc_nulls_first()).withColumn("block", F.spark_partition_id()), "claim-blocks")
    types = {c: asks.schema[c].dataType for c in ("req", "owner", "seq", "value")}
    out = ", ".join(f"{c} {t.simpleString()}" for c, t in (("req", types["req"]), ("owner", types["owner"]), ("value", types["value"])))
    accepted = None
    for block in range(blocks):
        now = placed.where(F.col("block") == block)
        near = held.join(now.select("owner").distinct(), "owner", "left_semi").unionByName(held.join(now.select("value").distinct(), "value", "left_semi").select(*held.columns))
        rows = near.distinct().select(F.lit(0).alias("kind"), "owner", F.lit(None).cast(types["seq"]).alias("seq"), F.lit(None).cast(types["req"]).alias("req"), "value") \
            .unionByName(now.select(F.lit(1).alias("kind"), "owner", "seq", "req", "value"))
        got = materialize(rows.repartition(1).sortWithinPartitions("kind", F.col("seq").asc_nulls_first()).mapInArrow(_fold_claims, f"kind int, {out}"), "claim-block")
        new = got.where("kind = 0").select("owner", "value")
        held = materialize(held.join(new, "owner", "left_anti").unionByName(new), "claim-held")
        ok = got.where("kind = 1").select("req")
        accepted = ok if accepted is None else accepted.unionByName(ok)
    return accepted.distinct()


def unique_claims(base: DataFrame, holders: DataFrame, rounds: int = CLAIM_ROUNDS, block_rows: int = CLAIM_BLOCK) -> DataFrame:
    """Unique values claimed in arrival order (store slug, SKU).

    ``base``: the requests (req, owner, seq, value, pre_ok, post_ok), any
    number of them an owner; a NULL value claims nothing. ``seq`` may be any
    type that orders. ``holders``: the snapshot (h_owner, h_value), values
    unique.

    An accepted request makes its owner hold the value until the owner's next
    accepted request for another one; a snapshot value is held from the
    start. A request is blocked when another owner holds its value as it
    arrives; accepted = pre_ok and not blocked and post_ok.
    Returns (req, blocked, ok).

    Holdings are intervals of arrival order: +1 where one begins and -1 where
    it ends, so who holds a value at a request is a running sum over the
    value's begins, ends and requests, without pairing them up. What isn't
    settled after ``rounds`` rounds is a long chain of owners that wait for
    each other's values; it is taken in arrival order (``_claims_in_order``)."""
    base = materialize(base, "claims")
    claims = base.where(F.col("value").isNotNull()).select("req", "owner", "seq", "value", "pre_ok", "post_ok")
    no_seq = F.lit(None).cast(base.schema["seq"].dataType)
    start = holders.where(F.col("h_value").isNotNull()).join(claims.select(F.col("owner").alias("h_owner")).distinct().withColumn("moves", F.lit(True)),
                                                             "h_owner", "left")
    wanted = claims.select(F.col("value").alias("h_value")).distinct()
    start = materialize(start.join(wanted.withColumn("wanted", F.lit(True)), "h_value", "left").where("moves or wanted").select(
        F.col("h_owner").alias("owner"), no_seq.alias("seq"), F.col("h_value").alias("value")), "claim-holders")
    by_owner = Window.partitionBy("owner").orderBy(F.col("seq").asc_nulls_first())

    def blocked_by(flags: DataFrame) -> DataFrame:
        held = start.unionByName(claims.join(flags.where("ok"), "req").select("owner", "seq", "value"))
        change = ~F.col("value").eqNullSafe(F.lag("value").over(by_owner))
        held = held.withColumn("change", change).where("change")
        held = held.withColumn("until", F.lead("seq").over(by_owner))
        begins = held.select("value", "seq", F.lit(1).alias("step"), F.lit(None).cast(base.schema["req"].dataType).alias("req"), "owner")
        ends = held.where(F.col("until").isNotNull()).select("value", F.col("until").alias("seq"), F.lit(-1).alias("step"),
                                                             F.lit(None).cast(base.schema["req"].dataType).alias("req"), "owner")
        asks = claims.select("value", "seq", F.lit(0).alias("step"), "req", "owner")
        # what happens at a request's own arrival comes after it
        order = [F.col("seq").asc_nulls_first(), (F.col("step") != 0).asc()]
        whole = Window.partitionBy("value").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        own = Window.partitionBy("value", "owner").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        line = begins.unionByName(ends).unionByName(asks)
        line = line.withColumn("mine", F.sum("step").over(own)).withColumn("all", F.sum("step").over(whole))
        return base.join(line.where("step = 0").select("req", (F.col("all") > F.col("mine")).alias("blocked")), "req", "left") \
            .select("req", F.coalesce("blocked", F.lit(False)).alias("blocked"), "pre_ok", "post_ok")

    def step(flags: DataFrame) -> DataFrame:
        return blocked_by(flags).select("req", (F.col("pre_ok") & ~F.col("blocked") & F.col("post_ok")).alias("ok"))

    flags, settled = _rounds(step, base.select("req", (F.col("pre_ok") & F.col("post_ok")).alias("ok")), "req", rounds)
    if not settled:
        may = F.col("pre_ok") & F.col("post_ok")
        taken = _claims_in_order(claims.where(may).select("req", "owner", "seq", "value"), start.select("owner", "value"), block_rows)
        none = base.where(may & F.col("value").isNull()).select("req").distinct()  # these claim nothing
        won = taken.unionByName(none).withColumn("won", F.lit(True))
        flags = materialize(flags.select("req").join(won, "req", "left").select("req", F.coalesce("won", F.lit(False)).alias("ok")), "admission-flags")
    return blocked_by(flags).join(flags, "req").select("req", "blocked", "ok")

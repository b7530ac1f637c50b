"""Substring dedup: near-duplicate passages by compact windows.

A text is its sequence of 5-word shingles. For each of a few hash functions
the Cartesian tree over the shingles' hashes tells, for every position c, the
widest span in which c has the least hash: the compact window (l, c, r) stands
for all subsequences from l..c to c..r at once, as all have the same min-hash.
Only windows of ``SPAN`` shingles or more matter. Each holds a stretch of
``SPAN`` shingles with its minimum at c, so the centres are the stretches'
minima, and their spans come from the next smaller values on both sides.

Windows of the ``ROWS`` functions of a band that overlap in ``SPAN`` or more
shingles are joined into one: all its subsequences share ``ROWS`` min-hashes.
Two passages that repeat word for word (``SPAN`` + 4 = 50 words or more) share
such a window in every band; passages with a similarity of 0.8 agree in a band
with a probability of 0.64, so in none of ``BANDS`` with one of 0.0003.

Texts are cut down first, without loss: two passages that agree share most of
their shingles, so those shingles occur twice in the corpus. They are counted
in packed buckets, and only stretches of ``SPAN`` or more of which ``PERCENT``
or more occur twice get windows (``likely``).

Windows with equal signatures are found in packed buckets, where each meets a
few others only: the first with the same signature; the first of those whose
text agrees also to the right, or to the left, of the centres; so a window
that a third of all documents hold costs one row a document, as long as it
agrees with the first: windows that don't are then compared with all others of
their signature (``still_apart``), which is quadratic in their number. Pairs are
verified on the words, each run of common shingles by itself: the passages'
shingle sets must have a similarity of 0.8 or more. Verified passages are joined to classes by connected components.

Result: one row per passage, doc_id, first and last word (end exclusive), and
class_id, the smallest doc_id of the class; where a document holds several
passages of a class, each is a row.

Defined cases: null, empty and short texts have no passages; null doc_ids
count as the largest id; rows with one doc_id are told apart by their text,
repeated rows repeat all their passages; passages may repeat inside one
document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlytics.llm.common import ODD, Scratch, batch_shingles, bucket_count, mix, sub_batches, table
from vendorlytics.llm.components import components
from vendorlytics.llm.op5_jaccard import NO_ID, _emit, _id, _keyed

WIDTH = 5
SPAN = 46  # shingles: 50 words
ROWS = 2
BANDS = 8
PERCENT = 80
SIDE = 15  # shingles of context beside the centres
# a query's shuffle files go when it ends, not when the driver happens to collect
# its garbage; texts and packed rows come to Python a few MB at a time
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
BLOCK = 1 << 19  # bytes of text taken at once
CELLS = 1 << 16  # places times shifts compared at once
DRIFT = max(8, SPAN // 5)  # words that a passage may gain or lose beside a window


def run_of(pick, value):
    """``pick`` (minimum, maximum) over the SPAN values from each place on."""
    have = 1
    while have < SPAN:
        step = min(have, SPAN - have)
        value = pick(value[:-step], value[step:])
        have += step
    return value


def spans(value, texts):
    """Compact windows of SPAN or more: (left, centre, right), positions of
    the batch, for one hash function. ``texts`` are the bounds of the texts."""
    n = len(value)
    empty = np.empty(0, np.int64)
    if n < SPAN:
        return empty, empty, empty
    # least value of the stretch that starts at each place (0 where it leaves
    # its text), then the greatest of these over the stretches that hold a
    # place, both by doubling: places whose value it is are some stretch's
    # least ones, ties included
    low = run_of(np.minimum, value)
    ends = np.zeros(n + SPAN - 1, value.dtype)
    ends[SPAN - 1:n] = low
    leaves = (texts[1:, None] + np.arange(SPAN - 1)).ravel()
    ends[leaves[leaves < n]] = 0
    place = np.flatnonzero(run_of(np.maximum, ends) == value)
    # the Cartesian tree's spans: next smaller value on the right (or equal on
    # the left, so that ties go to the first), inside the text. What ends the
    # span of a stretch's least value is itself the least of a stretch, so only
    # these places are looked at
    least, own = value[place], np.searchsorted(texts, place, "right") - 1
    bounds = np.searchsorted(place, texts)
    left, right = bounds[own], bounds[own + 1] - 1
    mins, size = [least], 1
    while size < int(np.diff(bounds).max()):
        prev = mins[-1]
        mins.append(np.minimum(prev[:-size], prev[size:]) if len(prev) > size else prev[:0])
        size *= 2
    go, back = np.arange(len(place)) + 1, np.arange(len(place)) - 1
    for level in range(len(mins) - 1, -1, -1):
        w, m = 1 << level, mins[level]
        if not len(m):
            continue
        ok = go + w - 1 <= right
        ok[ok] = m[go[ok]] >= least[ok]
        go = np.where(ok, go + w, go)
        ok = back - w + 1 >= left
        ok[ok] = m[(back - w + 1)[ok]] > least[ok]
        back = np.where(ok, back - w, back)
    edge = np.concatenate((place, [0]))  # 0: not used, beyond the last place
    l = np.where(back >= left, edge[back] + 1, texts[own])
    r = np.where(go <= right, edge[np.minimum(go, len(place))], texts[own + 1]) - 1
    wide = r - l + 1 >= SPAN
    return l[wide], place[wide], r[wide]


def joined_windows(value_sets, texts):
    """Interval join of the functions' windows: (first start, last end, least
    centre, greatest centre, centres) of those that share SPAN or more."""
    l, c, r = spans(value_sets[0], texts)
    low, high, centres = c, c, [c]
    for value in value_sets[1:]:
        l2, c2, r2 = spans(value, texts)
        if not len(l) or not len(l2):
            return [np.empty(0, np.int64)] * 4 + [[np.empty(0, np.int64)] * len(value_sets)]
        # a joint stretch holds both centres, which lie less than SPAN apart and in either window
        order = np.argsort(c2, kind="stable")
        l2, c2, r2 = l2[order], c2[order], r2[order]
        lo, hi = np.searchsorted(c2, np.maximum(high - SPAN + 1, l)), np.searchsorted(c2, np.minimum(low + SPAN - 1, r), "right")
        n = np.maximum(hi - lo, 0)
        i = np.repeat(np.arange(len(l)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        a, b = np.maximum(l[i], l2[j]), np.minimum(r[i], r2[j])
        c = c2[j]
        x, y = np.minimum(low[i], c), np.maximum(high[i], c)
        ok = (a <= x) & (b >= y) & (b - a + 1 >= SPAN) & (y - x < SPAN)
        l, r, low, high = a[ok], b[ok], x[ok], y[ok]
        centres = [p[i[ok]] for p in centres] + [c[ok]]
    return l, r, low, high, centres


def shingles_of(texts):
    """Shingles of the texts, see ``batch_shingles``, taken in blocks that
    stay in a core's cache."""
    import pyarrow as pa

    each = [batch_shingles(block.column("text"), WIDTH) for block in sub_batches(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", BLOCK)]
    if not each:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*each))


def corpus_parts(docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(part, docs, rows, texts): the table in lots of about 4 MB of text, so
    that what is found about a lot's shingles can be brought back to it."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sub_batches(batch, "text"):
                own = [pa.array([np.asarray(part.column(c).to_numpy(), "<i8").tobytes()], pa.binary()) for c in ("doc", "row")]
                texts = part.column("text")
                whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
                yield pa.RecordBatch.from_arrays([*own, whole], names=["docs", "rows", "texts"])

    lots = _keyed(docs, text).mapInArrow(run, "docs binary, rows binary, texts array<string>")
    return scratch.write(lots.withColumn("part", F.monotonically_increasing_id()), "parts")


def distinct_cells(h, buckets: int):
    """Distinct shingles in order of bucket and 32 bits of their hash:
    (buckets, bits, place of each shingle among them, how often)."""
    cell = (h % np.uint64(buckets)) << np.uint64(32) | h >> np.uint64(32)
    cell, place, often = np.unique(cell, return_inverse=True, return_counts=True)
    return (cell >> np.uint64(32)).astype(np.int64), (cell & np.uint64(0xFFFFFFFF)).astype("<u4"), place, often


def repeated_cells(parts: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket, bits): which of a part's distinct shingles of a bucket
    are in another part too. A shingle counts once a part, so one that a third
    of all texts hold is no larger than the number of parts."""
    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in zip(batch.column("part").to_pylist(), batch.column("texts")):
                h, _ = shingles_of(texts.values)
                if len(h):
                    bucket, bits, _, _ = distinct_cells(h, buckets)
                    out = _emit(bucket, buckets, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, part)), *out.columns], names=["part", "bucket", "c0"])

    def find(key, pdf):
        import pandas as pd

        each = [np.frombuffer(x, "<u4") for x in pdf["c0"]]
        whole = np.concatenate(each)
        order = np.sort(whole)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            return pd.DataFrame({"part": [], "bucket": [], "bits": []})
        hit = twice[np.minimum(np.searchsorted(twice, whole), len(twice) - 1)] == whole
        bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(x) for x in each])[:-1])]
        return pd.DataFrame({"part": pdf["part"], "bucket": key[0], "bits": bits})

    packed = parts.select("part", "texts").mapInArrow(cells, "part long, bucket long, c0 binary")
    return packed.groupBy("bucket").applyInPandas(find, "part long, bucket long, bits binary")


def likely(again, bounds):
    """Which shingles lie in a stretch of SPAN or more, PERCENT of which or
    more are repeated (``again``); ``bounds`` are the texts'. A passage that
    agrees with another to PERCENT is such a stretch, as what both hold occurs
    twice: so whatever lies outside belongs to no passage."""
    n = len(again)
    # sums in which a stretch with PERCENT repeated is 0 or more; a fall between
    # texts keeps stretches inside a text
    step = np.where(again, 100 - PERCENT, -PERCENT).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(step)))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    fall = (100 * n + 1) * text
    start, end = total[:-1] - fall, total[1:] - fall
    # the last end whose sum is as high as at the start
    high = np.maximum.accumulate(end[::-1])
    last = n - np.searchsorted(high, start, "left")  # end, exclusive
    ok = last - np.arange(n) >= SPAN
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(ok), 1)
    np.add.at(cover, last[ok], -1)
    return np.cumsum(cover[:-1]) > 0


def hot_texts(parts: DataFrame, repeats: DataFrame, buckets: int) -> DataFrame:
    """(doc, row, text, starts, ends): the whole texts that have stretches
    which may repeat, and these stretches, in shingles."""
    def found_in(texts, doc, row, marks):
        import pyarrow as pa

        h, n = shingles_of(texts)
        bounds = np.concatenate(([0], np.cumsum(n)))
        bucket, _, place, often = distinct_cells(h, buckets)
        again = often > 1
        for mark in marks:
            lo, hi = np.searchsorted(bucket, [mark["bucket"], mark["bucket"] + 1])
            again[lo:hi] |= np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=hi - lo).astype(bool)
        at = np.flatnonzero(likely(again[place], bounds))
        of = np.searchsorted(bounds, at, "right") - 1
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(of) > 0), [True]))) if len(at) else np.zeros(1, np.int64)
        t = of[cut[:-1]]
        hot, first = np.unique(t, return_index=True)
        off = pa.array(np.append(first, len(t)), pa.int32())
        starts, ends = (pa.ListArray.from_arrays(off, pa.array(x - bounds[t], pa.int32())) for x in (at[cut[:-1]], at[cut[1:] - 1] + 1))
        return pa.RecordBatch.from_arrays([pa.array(doc[hot]), pa.array(row[hot]), texts.take(pa.array(hot)), starts, ends], names=["doc", "row", "text", "starts", "ends"])

    def run(batches):
        for batch in batches:
            for texts, d, w, marks in zip(batch.column("texts"), *(batch.column(c).to_pylist() for c in ("docs", "rows", "marks"))):
                yield found_in(texts.values, np.frombuffer(d, "<i8"), np.frombuffer(w, "<i8"), marks or [])

    marks = repeats.groupBy("part").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    # a part without marks may still repeat a passage in itself
    need = parts.join(marks, "part", "left").select("texts", "docs", "rows", "marks")
    return need.mapInArrow(run, "doc long, row long, text string, starts array<int>, ends array<int>")


def windows(hot: DataFrame, buckets: int) -> DataFrame:
    """Packed joint windows of the stretches that may repeat: signature,
    document, row, start, end, hashes of the text to the right and left of the
    centres, and the first centre."""
    def found_in(texts, doc, row, starts, ends):
        import pyarrow.compute as pc

        h, n = batch_shingles(texts, WIDTH)
        bounds = np.concatenate(([0], np.cumsum(n)))
        base = np.repeat(bounds[:-1], pc.list_value_length(starts).to_numpy(zero_copy_only=False))
        lo, hi = (x.flatten().to_numpy(zero_copy_only=False) + base for x in (starts, ends))
        cut = np.concatenate(([0], np.cumsum(hi - lo)))
        at = np.arange(cut[-1]) + np.repeat(lo - cut[:-1], hi - lo)
        total = np.concatenate(([np.uint64(0)], np.cumsum(h * ODD[9], dtype=np.uint64)))
        found, kept = [], h[at]
        for band in range(BANDS):
            values = [mix(kept ^ ODD[16 + band * ROWS + k]) for k in range(ROWS)]
            l, r, low, high, centres = joined_windows(values, cut)
            if not len(l):
                continue
            sig = np.full(len(l), ODD[12 + band])
            for v, c in zip(values, centres):
                sig = mix(sig * ODD[11] + v[c])
            l, r, low, high, first = (at[x] for x in (l, r, low, high, centres[0]))
            t = np.searchsorted(bounds, low, "right") - 1
            after = total[np.minimum(high + 1 + SIDE, bounds[t + 1])] - total[high + 1]
            before = total[low] - total[np.maximum(low - SIDE, bounds[t])]
            found.append((sig, doc[t], row[t], l - bounds[t], r - bounds[t] + 1, mix(after), mix(before), first - bounds[t]))
        return [np.concatenate(x) for x in zip(*found)] if found else None

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text", 2 * BLOCK):
                found = [found_in(block.column("text"), *(block.column(c).to_numpy() for c in ("doc", "row")), block.column("starts"), block.column("ends"))
                         for block in sub_batches(part, "text", BLOCK)]
                found = [x for x in found if x]
                if found:
                    sig, d, w, l, r, after, before, c = (np.concatenate(x) for x in zip(*found))
                    yield _emit((sig % np.uint64(buckets)).astype(np.int64), buckets, (sig >> np.uint64(32)).astype("<u4"), d.astype("<i8"),
                                w.astype("<i8"), l.astype("<u4"), r.astype("<u4"), (after >> np.uint64(32)).astype("<u4"), (before >> np.uint64(32)).astype("<u4"), c.astype("<u4"))

    return hot.mapInArrow(run, "bucket long, " + ", ".join(f"c{i} binary" for i in range(8)))


PAIR = "d1 long, w1 long, a1 int, b1 int, d2 long, w2 long, a2 int, b2 int, shift int"


def candidate_pairs(packed: DataFrame) -> DataFrame:
    """Pairs of windows to verify, linear in the number of windows."""
    def find(key, pdf):
        import pandas as pd

        kinds = ["<u4", "<i8", "<i8", "<u4", "<u4", "<u4", "<u4", "<u4"]
        sig, d, w, a, b, after, before, c = (np.concatenate([np.frombuffer(x, k) for x in pdf[f"c{i}"]]) for i, k in enumerate(kinds))
        order = np.argsort(sig)
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((a[order], w[order], d[order], sig[order]))]
        pairs = []
        for more in (None, after, before):
            group = sig[order].astype(np.uint64) << np.uint64(32)
            o = order
            if more is not None:
                group |= more[order]
                by = np.argsort(group, kind="stable")
                group, o = group[by], order[by]
            new = np.ones(len(o), bool)
            new[1:] = group[1:] != group[:-1]
            first = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else o
            pairs.append(first[~new] * len(sig) + o[~new])
        x, y = np.divmod(np.unique(np.concatenate(pairs)), max(len(sig), 1))
        return pd.DataFrame({"d1": d[x], "w1": w[x], "a1": a[x].astype(np.int32), "b1": b[x].astype(np.int32),
                             "d2": d[y], "w2": w[y], "a2": a[y].astype(np.int32), "b2": b[y].astype(np.int32),
                             "shift": c[x].astype(np.int32) - c[y].astype(np.int32), "c1": c[x].astype(np.int32)})

    return packed.groupBy("bucket").applyInPandas(find, PAIR + ", c1 int")


def matched(x, y, least, most):
    """Passages of two shingle slices that agree to PERCENT or more, each of
    SPAN or more shingles: [((from, to), (from, to))]. Places of x are aligned
    with equal ones of y on the windows' shifts, ``least`` to ``most``, and
    ``DRIFT`` beside them; each run without a gap that would break the
    threshold is judged, see ``agreed``."""
    met = np.full(len(x), -1)
    lines = []
    shifts = np.arange(max(least - DRIFT, 1 - len(y)), min(most + DRIFT, len(x) - 1) + 1)
    if 0 < len(shifts) * len(x) <= CELLS and len(y):
        # all shifts at once; the shift with most common shingles first (a few words may differ)
        j = np.arange(len(x)) - shifts[:, None]
        same = (y[np.clip(j, 0, len(y) - 1)] == x) & (j >= 0) & (j < len(y))
        order = np.argsort(-same.sum(1), kind="stable")
        best = order[same[order].argmax(0)]
        met = np.where(same.any(0), np.arange(len(x)) - shifts[best], -1)
        shifts = shifts[:0]
    for shift in shifts.tolist():
        lo, hi = max(shift, 0), min(len(x), len(y) + shift)
        at = lo + np.flatnonzero(x[lo:hi] == y[lo - shift:hi - shift])
        if len(at):
            lines.append((len(at), shift, at))
    for _, shift, at in sorted(lines, key=lambda z: (-z[0], z[1])):
        at = at[met[at] < 0]
        met[at] = at - shift
    i = np.flatnonzero(met >= 0)
    if len(i) < 2:
        return []
    gap = SPAN * (100 - PERCENT) // 100 + WIDTH
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(i) > gap) | (np.abs(np.diff(met[i])) > gap), [True])))
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        out += agreed(x, y, i[lo:hi], met[i[lo:hi]])
    return out


def alike(x, y):
    """Whether the sets of x and y have a similarity of PERCENT or more."""
    if np.array_equal(x, y):
        return True
    one, two, union = (1 + np.count_nonzero(np.diff(np.sort(z))) for z in (x, y, np.concatenate((x, y))))
    return 100 * (one + two - union) >= PERCENT * union


def agreed(x, y, i, j):
    """Passages of one run, i in x aligned with j in y: the whole run if it
    agrees; else its longest stretch whose common places outweigh the others
    as the threshold asks, and the same for what lies beside that."""
    out, todo = [], [(0, len(i), True)]
    # common shingles must be PERCENT / (100 - PERCENT) times the others
    price = PERCENT / (100 - PERCENT)
    between = np.abs(np.diff(i) - 1) + np.abs(np.diff(j) - 1)
    while todo:
        lo, hi, whole = todo.pop()
        if hi - lo < 2 or i[hi - 1] + 1 - i[lo] < SPAN:
            continue
        if whole:
            a, b = lo, hi
        else:
            # sums up to each place; where a stretch starts the gap before is free
            ends = np.concatenate(([1.0], 1 + np.cumsum(1 - price * between[lo:hi - 1])))
            starts = np.minimum.accumulate(ends - 1)
            # with sums that fall from place to place at the starts: the first low enough
            first = np.searchsorted(-starts, -ends, "left")
            wide = np.arange(hi - lo) - first
            k = int(np.argmax(wide))
            a, b = lo + int(first[k]), lo + k + 1
        p, q = (int(i[a]), int(i[b - 1]) + 1), (int(j[a:b].min()), int(j[a:b].max()) + 1)
        if min(p[1] - p[0], q[1] - q[0]) >= SPAN and alike(x[p[0]:p[1]], y[q[0]:q[1]]):
            out.append((p, q))
            todo += [(lo, a, False), (b, hi, False)]
        elif whole:
            todo.append((lo, hi, False))
        elif (a, b) != (lo, hi):
            todo += [(lo, a, False), (a, b, True), (b, hi, False)] if b - a > 1 else []
        elif between[a:b - 1].any():
            k = a + int(np.argmax(between[a:b - 1])) + 1
            todo += [(a, k, True), (k, b, True)]
    return sorted(out)


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(d1, w1, a1, b1, d2, w2, a2, b2) of passages that match, in shingles."""
    return judged(stretches(pairs, scratch), texts).drop("pair")


def stretches(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of windows as pairs of stretches to judge, each with a number and,
    where given, the windows' centres in the first (``at``)."""
    at = [F.collect_set("c1").alias("at")] if "c1" in pairs.columns else []
    joint = [F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")] if at else []
    # windows of one pair of documents with one shift are one stretch, from the
    # first to the last (aggregated before the shuffle; what lies between is
    # judged too); those with near shifts that overlap on both sides are joined
    both = ["d1", "w1", "d2", "w2"]
    pairs = pairs.groupBy(*both, "shift").agg(*[f(c).alias(c) for f, c in ((F.min, "a1"), (F.max, "b1"), (F.min, "a2"), (F.max, "b2"))], *at)
    line = Window.partitionBy(*both).orderBy("shift")
    pairs = pairs.withColumn("far", F.when(F.col("shift") - F.lag("shift").over(line) > DRIFT, 1).otherwise(0))
    pairs = pairs.withColumn("line", F.sum("far").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy(*both, "line").orderBy("a1", "b1", "a2", "b2", "shift")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("a1") >= F.max("b1").over(past)) | (F.col("a2") >= F.max("b2").over(past))
    pairs = pairs.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("part", F.sum("apart").over(
        along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return scratch.write(pairs.groupBy(*both, "line", "part")
                              .agg(F.min("a1").alias("a1"), F.max("b1").alias("b1"), F.min("a2").alias("a2"), F.max("b2").alias("b2"),
                                   F.min("shift").alias("least"), F.max("shift").alias("most"), *joint)
                              .drop("line", "part").withColumn("pair", F.monotonically_increasing_id()), "pairs")


def still_apart(pairs: DataFrame, good: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Pairs of stretches that only met the same first holder.

    Windows of one signature were each compared with their first holder. Those
    whose centre lies in a passage that they share with it are in its class.
    The others are compared with every window that met the first holder at this
    centre. Rows with equal texts have equal stretches: one of them meets the
    others, and the rest meets that one."""
    done = good.groupBy("pair").agg(F.collect_list(F.struct("a1", "b1")).alias("done"))
    place = ["d1", "w1", "w2", "a1", "b1", "a2", "b2", "least", "most"]
    alone = F.filter("at", lambda c: ~F.coalesce(F.exists("done", lambda m: (m["a1"] <= c) & (c < m["b1"])), F.lit(False)))
    met = pairs.join(done, "pair", "left").withColumn("alone", alone)
    met = scratch.write(met.groupBy(*place).agg(F.min(F.struct("d2", "at", "alone")).alias("m")).select(*place, "m.*"), "met")
    unlike = met.where(F.size("alone") > 0)
    if unlike.isEmpty():
        scratch.drop(met)
        return None
    cols = ["d2", *place[2:], "at", "alone"]
    x = unlike.select("d1", "w1", *[F.col(c).alias(f"x_{c}") for c in cols])
    y = met.select("d1", "w1", *[F.col(c).alias(f"y_{c}") for c in cols])
    name = [F.struct(*[F.col(f"{s}_{c}") for c in ("d2", *place[2:])]) for s in "xy"]
    apart = (F.col("x_d2") != F.col("y_d2")) | (F.col("x_w2") != F.col("y_w2")) | (F.col("x_b2") <= F.col("y_a2")) | (F.col("y_b2") <= F.col("x_a2"))
    once = ~F.arrays_overlap("y_alone", "x_at") | (name[0] < name[1])
    one = x.join(y, ["d1", "w1"]).where(apart & F.arrays_overlap("x_alone", "y_at") & once).select(
        F.col("x_d2").alias("d1"), F.col("x_w2").alias("w1"), F.col("y_d2").alias("d2"), F.col("y_w2").alias("w2"),
        F.col("x_a2").alias("a1"), F.col("x_b2").alias("b1"), F.col("y_a2").alias("a2"), F.col("y_b2").alias("b2"),
        (F.col("y_least") - F.col("x_most")).alias("least"), (F.col("y_most") - F.col("x_least")).alias("most"))
    same = pairs.join(unlike.select(*place, F.col("d2").alias("first")), place).where("d2 <> first").select(
        F.col("first").alias("d1"), F.col("w2").alias("w1"), "d2", "w2", F.col("a2").alias("a1"), F.col("b2").alias("b1"), "a2", "b2",
        F.lit(0).alias("least"), F.lit(0).alias("most"))
    both = [f"{c}{k}" for k in (1, 2) for c in "dwab"]
    more = one.unionByName(same).groupBy(*both).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    more = scratch.write(more.withColumn("pair", F.monotonically_increasing_id()), "more")
    scratch.drop(met)
    return more


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair, d1, w1, a1, b1, d2, w2, a2, b2) of passages that match."""
    one = pairs.select(F.col("d1").alias("doc"), F.col("w1").alias("row"), "pair", F.lit(1).alias("side"), F.col("a1").alias("a"), F.col("b1").alias("b"))
    two = pairs.select(F.col("d2").alias("doc"), F.col("w2").alias("row"), "pair", F.lit(2).alias("side"), F.col("a2").alias("a"), F.col("b2").alias("b"))
    # a document's slices in lots of bounded size, so a document that very many
    # pairs share is cut by many tasks
    asked = one.unionByName(two)
    asked = asked.groupBy("doc", "row", F.pmod(F.xxhash64("pair"), F.lit(64)).alias("lot")).agg(F.collect_list(F.struct("pair", "side", "a", "b")).alias("cuts"))
    # small lots of a document go together, so that its text is taken once
    few = F.when(F.size("cuts") >= 64, F.col("lot"))
    asked = asked.groupBy("doc", "row", few.alias("lot")).agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    if not texts.groupBy("doc", "row").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc", "row"])
    need = texts.join(asked, ["doc", "row"]).select("text", "cuts")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sub_batches(batch, "text"):
                h, n = shingles_of(part.column("text"))
                base = np.cumsum(n) - n
                cuts = [(c["pair"], c["side"], c["a"], base[i] + c["a"], base[i] + min(c["b"], n[i])) for i, x in enumerate(part.column("cuts").to_pylist()) for c in x]
                # a document may be asked very often: about BLOCK bytes a batch
                lot = np.cumsum([8 * max(c[4] - c[3], 0) for c in cuts]) // BLOCK
                for at in np.split(np.arange(len(cuts)), np.flatnonzero(np.diff(lot)) + 1):
                    out = [cuts[k] for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()),
                                                      pa.array([o[2] for o in out], pa.int32()), pa.array([h[o[3]:o[4]].tobytes() for o in out], pa.binary())],
                                                     names=["pair", "side", "a", "h"])

    slices = need.mapInArrow(cut, "pair long, side int, a int, h binary")
    met = slices.groupBy("pair").agg(F.max(F.when(F.col("side") == 1, F.struct("a", "h"))).alias("x"), F.max(F.when(F.col("side") == 2, F.struct("a", "h"))).alias("y"))
    met = met.select("pair", F.col("x.a").alias("s1"), F.col("x.h").alias("h1"), F.col("y.a").alias("s2"), F.col("y.h").alias("h2"))
    met = met.join(pairs.select("pair", "least", "most"), "pair")

    def verify(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in sub_batches(whole, "h1", BLOCK)):
            out = []
            for pair, s1, h1, s2, h2, least, most in zip(*(batch.column(c).to_pylist() for c in ("pair", "s1", "h1", "s2", "h2", "least", "most"))):
                if h1 is None or h2 is None:
                    continue
                for m in matched(np.frombuffer(h1, np.uint64), np.frombuffer(h2, np.uint64), least - s1 + s2, most - s1 + s2):
                    out.append((pair, s1 + m[0][0], s1 + m[0][1], s2 + m[1][0], s2 + m[1][1]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if not i else pa.int32()) for i in range(5)],
                                             names=["pair", "f1", "t1", "f2", "t2"])

    ok = met.mapInArrow(verify, "pair long, f1 int, t1 int, f2 int, t2 int")
    return ok.join(pairs.select("pair", "d1", "w1", "d2", "w2"), "pair").select(
        "pair", "d1", "w1", F.col("f1").alias("a1"), F.col("t1").alias("b1"), "d2", "w2", F.col("f2").alias("a2"), F.col("t2").alias("b2"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings as given, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, first_word, end_word, class_id): passages that repeat."""
    scratch = Scratch(docs.sparkSession, "passages")
    with settings(docs.sparkSession, SETTINGS):
        return _classes(_matches(docs, text, scratch), scratch)


def _matches(docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """Verified pairs of passages. Each step that shuffles is written by
    itself, so that its shuffle and its input go before the next one's."""
    buckets = bucket_count(docs)
    parts = corpus_parts(docs, text, scratch)
    repeats = scratch.write(repeated_cells(parts, buckets), "repeats")
    hot = scratch.write(hot_texts(parts, repeats, buckets), "hot")
    scratch.drop(parts, repeats)
    pairs = candidate_pairs(windows(hot, 4 * buckets)).where("d1 <> d2 or w1 <> w2 or b1 < a2 or b2 < a1")
    texts = hot.select("doc", "row", "text")
    pairs = stretches(pairs, scratch)
    good = scratch.write(judged(pairs, texts), "matches")
    more = still_apart(pairs, good, scratch)
    scratch.drop(pairs)
    good = good.drop("pair")
    if more is not None:
        good = good.unionByName(scratch.write(judged(more, texts), "matches").drop("pair"))
        scratch.drop(more)
    scratch.drop(hot)
    return good


def _classes(good: DataFrame, scratch: Scratch) -> DataFrame:
    ends = good.select(F.col("d1").alias("doc"), F.col("w1").alias("row"), F.col("a1").alias("a"), F.col("b1").alias("b")).unionByName(
        good.select(F.col("d2").alias("doc"), F.col("w2").alias("row"), F.col("a2").alias("a"), F.col("b2").alias("b"))).distinct()
    # matched stretches of a document that share half of the shorter one's
    # shingles or more, in order of their start, are one passage
    order = Window.partitionBy("doc", "row").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    share = (F.least(reach, "b") - F.col("a")) * 2 >= F.col("b") - F.col("a")
    marked = ends.withColumn("new", F.when(share, 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    named = scratch.write(marked.withColumn("id", F.xxhash64("doc", "row", "part")).select("doc", "row", "a", "b", "id"), "named")
    left = named.select(F.col("doc").alias("d1"), F.col("row").alias("w1"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("id").alias("u"))
    right = named.select(F.col("doc").alias("d2"), F.col("row").alias("w2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("v"))
    edges = good.join(left, ["d1", "w1", "a1", "b1"]).join(right, ["d2", "w2", "a2", "b2"]).select("u", "v")
    roots = components(edges, scratch)
    passage = named.groupBy("id").agg(F.min("doc").alias("doc"), F.min("row").alias("row"), F.min("a").alias("a"), F.max("b").alias("b"))
    passage = scratch.write(passage.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "passages")
    lead = passage.groupBy("root").agg(F.min("doc").alias("lead"))
    return passage.join(lead, "root").select(
        _id("doc").alias("doc_id"), F.col("a").cast("long").alias("first_word"), (F.col("b") + WIDTH - 1).cast("long").alias("end_word"), _id("lead").alias("class_id"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_passages": op8_passages}
ORACLES: dict[str, str] = {}

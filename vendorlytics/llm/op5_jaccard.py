"""N-gram Jaccard self-join by a size-aware heavy-light scheme.

A document's set holds its distinct 5-word shingles. Two sets link when
100 * intersection >= 80 * union. Copies (equal sets) are one class from the
start. The join of the classes:

1. *Order.* Shingles are counted over all documents in packed buckets. The
   most frequent ones (at most ``HEAVY_SHINGLES``, a bound on what is
   broadcast) come last in the order of shingles, the others by hash. Any
   order gives the same result; this one keeps inverted lists short.
2. *Signatures.* A set of n shingles that links at all shares at least
   a = ceil(0.8 n) of them, so the first n - a + c shingles of two linked sets
   have c in common. Small (light) sets enumerate all subsets of c = 2 of
   their first n - a + 2 shingles; large (heavy) sets are looked up in the
   inverted lists of their first n - a + 1 shingles. Where the two meet, a
   light set whose size allows a heavy partner is in both. The boundary is the
   size up to which enumerating costs less than scanning lists, with the
   lists' mean length taken from the counts of step 1.
3. *Verification in three rounds.* Round one compares each member of a list
   with a member of about its size, round two with a random one (both linear
   in the list); linked classes are joined. Round three takes the lists whose
   members are still in different components and compares these members, each
   with all of the others that sizes and odd sketches (an exact bound on the
   difference) don't rule out. Pairs inside a component need no comparing: the
   result is the component. So a group of near copies doesn't become its
   square of pairs, and no link between components is lost.

Lists are found in packed form: a task sorts its signatures into buckets and
emits one binary row a bucket, so billions of signatures don't become rows.

Defined cases: null or empty texts have no shingles and link with nothing;
fewer than five words are one shingle; null doc_ids count as the largest id
and a component of nothing else has a null id; rows are judged one by one, so
repeated rows are copies of each other; an empty table gives an empty result.
Sets are told apart by a 64-bit hash of their 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm.common import ODD, Scratch, batch_shingles, bucket_count, given, mix, packed, sub_batches, table
from vendorlytics.llm.components import components

WIDTH = 5
PERCENT = 80
HEAVY_SHINGLES = 1 << 18
HEAVY_FROM = 12
VERIFY_COST = 16  # what comparing two sets costs, in signatures made
NO_ID = (1 << 63) - 1
LIST_BLOCK = 4096
LEAST_CELLS, MOST_CELLS = 256, 8192


def cell_of(h, buckets: int):
    """A shingle's place in the counts: its bucket and 32 bits of its hash."""
    return (h % np.uint64(buckets)) << np.uint64(32) | h >> np.uint64(32)


def _set_order(h, group):
    """The order by (group, h): by one 64-bit word that holds the group and the
    first bits of h, unless two unlike hashes of a group agree in these."""
    bits = int(group[-1]).bit_length() if len(group) else 0
    if bits > 32:
        return np.lexsort((h, group))
    word = h >> np.uint64(bits) if not bits else (group.astype(np.uint64) << np.uint64(64 - bits)) | h >> np.uint64(bits)
    order = np.argsort(word)
    w, own = word[order], h[order]
    if np.any((w[1:] == w[:-1]) & (own[1:] != own[:-1])):
        return np.lexsort((h, group))
    return order


def set_arrays(texts, cells=None, buckets: int = 1):
    """Distinct shingles of every text, in order (heavy, hash): (shingles,
    text of each, sizes, set hashes). Texts without words have size 0."""
    h, n = batch_shingles(texts, WIDTH)
    doc = np.repeat(np.arange(len(n)), n)
    if cells is not None and len(cells):
        own = cell_of(h, buckets)
        at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
        late = (cells[at] == own).astype(np.int64)
    else:
        late = np.zeros(len(h), np.int64)
    order = _set_order(h, doc * 2 + late)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    size = np.bincount(doc, minlength=len(n)).astype(np.int64)
    key = np.zeros(len(n), np.uint64)
    some = size > 0
    first = (np.cumsum(size) - size)[some]
    if len(first):
        key[some] = mix(np.add.reduceat(mix(h ^ ODD[0]), first) + size[some].astype(np.uint64))
    return h, doc, size, key


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def _emit(bucket, buckets: int, *columns):
    """One row a bucket that has entries: the columns' values as bytes. A
    column is an array, or (which entries it has, array)."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    by = bucket[order]
    full = np.unique(by)
    blobs = []
    for c in columns:
        mine, value = c if isinstance(c, tuple) else (None, c)
        o = order if mine is None else order[mine[order]]
        b, value = bucket[o], value[o]
        lo, hi = np.searchsorted(b, full), np.searchsorted(b, full, "right")
        blobs.append(pa.array([value[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), *blobs], names=["bucket", *[f"c{i}" for i in range(len(columns))]])


def sets_and_counts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """Two tables from one pass over the texts. With a cell: (cell, n),
    occurrences of frequent shingles over all documents; a row with cell -1
    for each bucket has the sums of counts (n) and of squared counts (sq) of
    the others. Without: (doc, row, n, k), set size and set hash of every row."""
    def count(batches):
        import pyarrow as pa

        held, size, most = [], 0, 8 << 20

        def flush():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            bucket, cells = (cells >> np.uint64(32)).astype(np.int64), (cells & np.uint64(0xFFFFFFFF)).astype("<u4")
            return packed(_emit(bucket, buckets, (n == 1, cells), (n > 1, cells), (n > 1, np.minimum(n, 2 ** 31).astype("<u4"))).columns)

        def packed(columns):
            return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(1, pa.binary()).take(pa.array([0] * len(columns[0])))] * (5 - len(columns))],
                                              names=["bucket", "c0", "c1", "c2", "c3"])

        for batch in batches:
            for part in sub_batches(batch, "text"):
                h, _, n, key = set_arrays(part.column("text"))
                own = [np.asarray(part.column(c).to_numpy(), "<i8") for c in ("doc", "row")] + [n.astype("<i8"), key]
                # lots of sets travel beside the buckets of counts
                yield packed([pa.array([-1 - int(own[1][0]) % buckets], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in own]])
                held.append(cell_of(h, buckets))
                size += len(held[-1])
                if size > most:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add(key, pdf):
        import pandas as pd

        if key[0] < 0:
            doc, row, n, k = (np.concatenate([np.frombuffer(x, "<i8") for x in pdf[c]]) for c in ("c0", "c1", "c2", "c3"))
            return pd.DataFrame({"cell": None, "n": n, "sq": None, "doc": doc, "row": row, "k": k})
        single, multiple, times = (np.concatenate([np.frombuffer(x, "<u4") for x in pdf[c]]) for c in ("c0", "c1", "c2"))
        cells = np.concatenate((single, multiple))
        n = np.concatenate((np.ones(len(single), np.int64), times.astype(np.int64)))
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        cells, n = cells[first].astype(np.int64) | key[0] << 32, np.add.reduceat(n, first)
        often, rest = n >= HEAVY_FROM, n[n < HEAVY_FROM]
        return pd.DataFrame({"cell": np.append(cells[often], -1), "n": np.append(n[often], rest.sum()),
                             "sq": np.append(n[often] ** 2, (rest ** 2).sum()), "doc": None, "row": None, "k": None})

    found = _keyed(docs, text).mapInArrow(count, "bucket long, c0 binary, c1 binary, c2 binary, c3 binary")
    return found.groupBy("bucket").applyInPandas(add, "cell long, n long, sq long, doc long, row long, k long")


def needed(n):
    """Shingles that a set of n shares at least with any linked set."""
    return -(-n * PERCENT // 100)


def boundary(mean_list: float) -> int:
    """The largest size whose subsets cost less than scanning its lists: with
    p = n - needed(n) + 1 shingles looked up, scanning costs p (1 + V m) for
    lists of m others each that take V to verify; subsets cost p (p + 1) / 2."""
    n = 4
    while True:
        p = n + 1 - needed(n + 1) + 1
        if p * (p + 1) / 2 > p * (1 + VERIFY_COST * mean_list) or n >= 200:
            return n
        n += 1


def signatures(docs: DataFrame, cells, light: int, buckets: int, text: str = "text") -> DataFrame:
    """Packed (32 bits of the signature, set, size) of every distinct set."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)  # at most HEAVY_SHINGLES longs

    def run(batches):
        cells, seen = shared.value, set()
        for batch in batches:
            for part in sub_batches(batch, "text"):
                h, _, size, key = set_arrays(part.column("text"), cells, buckets)
                first = np.cumsum(size) - size
                sig, own, sizes = [], [], []
                rows = []
                for i in np.flatnonzero(size >= 4).tolist():
                    k = int(key[i])
                    if k in seen:
                        continue
                    if len(seen) < 1_000_000:  # repeats beyond are harmless
                        seen.add(k)
                    rows.append(i)
                if not rows:
                    continue
                rows = np.array(rows)
                n = size[rows]
                p = n - needed(n) + 1
                # inverted lists of the large sets and of those next to them
                big = n * 100 > light * PERCENT
                r, m = rows[big], p[big]
                at = np.repeat(first[r], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                sig.append(mix(h[at] ^ ODD[1]))
                own.append(np.repeat(key[r], m))
                sizes.append(np.repeat(size[r], m))
                for i, q in zip(rows[n <= light].tolist(), (p + 1)[n <= light].tolist()):
                    x = h[first[i]:first[i] + q]
                    a, b = np.triu_indices(q, 1)
                    lo, hi = np.minimum(x[a], x[b]), np.maximum(x[a], x[b])
                    sig.append(mix(lo * ODD[2] + mix(hi ^ ODD[3])))
                    own.append(np.full(len(a), key[i]))
                    sizes.append(np.full(len(a), size[i]))
                sig, own, sizes = np.concatenate(sig), np.concatenate(own), np.concatenate(sizes)
                if len(sig):
                    yield _emit((sig % np.uint64(buckets)).astype(np.int64), buckets, (sig >> np.uint64(32)).astype("<u4"), own.astype("<u8"), sizes.astype("<u4"))

    return _keyed(docs, text).mapInArrow(run, "bucket long, c0 binary, c1 binary, c2 binary")


def shared_lists(packed: DataFrame) -> DataFrame:
    """(sig, k, n, pivot) of all lists with two sets or more. In a list sorted
    by size, a pivot serves the sets of up to 5/4 of its size."""
    def find(key, pdf):
        import pandas as pd

        sig = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["c0"]]).astype(np.int64) | key[0] << 32
        k = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["c1"]])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["c2"]]).astype(np.int64)
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        order = order[many]
        sig, k, n = sig[order], k[order], n[order]
        order = np.lexsort((k, n, sig))
        sig, k, n = sig[order], k[order], n[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])
        sig, k, n = sig[new], k[new], n[new]
        edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True]))) if len(sig) else np.zeros(1, np.int64)
        pivot, keep = np.zeros(len(sig), np.uint64), np.zeros(len(sig), bool)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2:
                continue
            keep[lo:hi] = True
            while lo < hi:
                end = lo + int(np.searchsorted(n[lo:hi], n[lo] * 100 // PERCENT, "right"))
                pivot[lo:end] = k[lo]
                lo = end
        return pd.DataFrame({"sig": sig[keep], "k": k[keep].view(np.int64), "n": n[keep], "pivot": pivot[keep].view(np.int64)})

    return packed.groupBy("bucket").applyInPandas(find, "sig long, k long, n long, pivot long")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of set hashes whose texts' sets link."""
    both = (pairs.join(texts.select(F.col("k").alias("u"), F.col("text").alias("a")), "u")
                 .join(texts.select(F.col("k").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sub_batches(batch, "a"):
                u = part.column("u").to_numpy()
                # a text that many pairs share is cut into shingles once
                first, at = np.unique(u, return_index=True)
                ha, da, na, _ = set_arrays(part.column("a").take(pa.array(at)))
                hb, db, nb, _ = set_arrays(part.column("b"))
                ea, eb = np.cumsum(na), np.cumsum(nb)
                where, ok = np.searchsorted(first, u), np.zeros(len(u), bool)
                for i, w in enumerate(where.tolist()):
                    x, y = ha[ea[w] - na[w]:ea[w]], hb[eb[i] - nb[i]:eb[i]]
                    if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
                hit = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column("u").take(hit), part.column("v").take(hit)], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def pair(u: str, v: str):
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def set_components(docs: DataFrame, scratch: Scratch, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, row, n, k), every row's set; (id, root), set hashes that link
    with another, and their component."""
    buckets = bucket_count(docs)
    counts = scratch.write(sets_and_counts(docs, buckets, text), "counts")
    sets = scratch.write(counts.where("cell is null").select("doc", "row", "n", "k"), "sets")
    usual = counts.where("cell = -1").agg(F.sum("n").alias("n"), F.sum("sq").alias("sq")).first()
    top = counts.where("cell >= 0").orderBy(F.desc("n"), "cell").limit(HEAVY_SHINGLES).select("cell")
    cells = np.sort(np.array(top.toArrow().column("cell").to_numpy(), np.uint64))
    light = boundary(usual["sq"] / usual["n"] - 1 if usual["n"] else 0.0)
    lists = scratch.write(shared_lists(signatures(docs, cells, light, buckets, text)), "lists")
    scratch.drop(counts)
    # one text for each set that is in a list
    chosen = sets.join(lists.select("k").distinct(), "k").groupBy("k").agg(F.min(F.struct("doc", "row")).alias("r")).select("k", "r.*")
    texts = _keyed(docs, text).join(chosen, ["doc", "row"]).select("k", "text")
    if not sets.groupBy("doc", "row").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["k"])
    texts = scratch.write(texts, "texts")
    # rounds one and two: a member of about its size, then one at random
    tried = scratch.write(lists.where("k <> pivot").select(*pair("k", "pivot")).distinct(), "tried")
    links = scratch.write(linked(tried, texts), "links")
    roots = components(links, scratch)
    apart = scratch.write(split_lists(lists, roots), "apart")
    pivots = apart.groupBy("sig").agg(F.min_by(F.struct("k", "n", "root"), F.xxhash64("k", "sig")).alias("p"))
    again = (apart.join(pivots, "sig").where("root <> p.root and n * 100 >= p.n * 80 and p.n * 100 >= n * 80")
                  .select("k", F.col("p.k").alias("pivot")).select(*pair("k", "pivot")).distinct())
    again = scratch.write(again.join(tried, ["u", "v"], "left_anti"), "tried")
    links = links.unionByName(scratch.write(linked(again, texts), "links"))
    roots = components(links, scratch)
    # round three: what is still apart
    apart = scratch.write(split_lists(apart.select("sig", "k", "n"), roots), "apart")
    used = texts.join(apart.select("k").distinct(), "k", "left_semi")
    bits = scratch.write(odd_sketches(used), "sketches")
    rest = close_pairs(apart, bits, buckets).distinct()
    more = scratch.write(linked(rest.join(tried.unionByName(again), ["u", "v"], "left_anti"), texts), "links")
    if more.isEmpty():
        return sets, roots
    return sets, components(links.unionByName(more), scratch)


def split_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, k, n, root) of the lists that span two components or more."""
    part = lists.select("sig", "k", "n").join(roots.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    split = part.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    return part.join(split, "sig")


def odd_sketches(texts: DataFrame) -> DataFrame:
    """(k, bits): for each of M cells, whether the set has an odd number of
    shingles there. Two sets differ in at least as many shingles as their
    sketches differ in cells, so a sketch can rule a pair out for certain. M
    is a power of two near 4 n; halves fold onto each other by XOR."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sub_batches(batch, "text"):
                h, _, size, _ = set_arrays(part.column("text"))
                end, out = np.cumsum(size).tolist(), []
                for n, e in zip(size.tolist(), end):
                    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * n - 1).bit_length()))
                    odd = np.bincount((h[e - n:e] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
                    out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(out, pa.binary())], names=["k", "bits"])

    return texts.mapInArrow(run, "k long, bits binary")


def close_pairs(apart: DataFrame, bits: DataFrame, buckets: int) -> DataFrame:
    """(u, v) in one list, in different components, that sizes and sketches
    don't rule out. A list is compared in blocks of about ``LIST_BLOCK``
    members, so a very long one is many tasks' work."""
    size = apart.groupBy("sig").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("c"))
    rows = apart.join(size, "sig").withColumn("own", F.pmod(F.xxhash64("k"), F.col("c")).cast("int"))
    rows = rows.select("sig", "k", "n", "root", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    rows = rows.withColumn("block", F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")))
    rows = rows.join(bits, "k").withColumn("g", F.pmod("block", F.lit(buckets)))

    def compare(key, pdf):
        import pandas as pd

        u, v = [], []
        pdf = pdf.sort_values(["block", "n", "k"])
        block, n, root, k = (pdf[c].to_numpy() for c in ("block", "n", "root", "k"))
        sketch = [np.frombuffer(x, np.uint64) for x in pdf["bits"]]
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if (root[lo:hi] == root[lo]).all():
                continue
            names, count = np.unique(root[lo:hi], return_counts=True)
            main = names[np.argmax(count)]
            width = np.array([len(x) for x in sketch[lo:hi]])
            stacks = {w: np.stack([x if len(x) == w else x[:w] ^ x[w:] for x in sketch[lo:hi] if len(x) in (w, 2 * w)]) for w in set(width.tolist())}
            index = {w: np.flatnonzero((width == w) | (width == 2 * w)) for w in stacks}
            for i in np.flatnonzero(root[lo:hi] != main).tolist():
                for w in {int(width[i]), int(width[i]) // 2} & stacks.keys():
                    mine = sketch[lo + i]
                    mine = mine if len(mine) == w else mine[:w] ^ mine[w:]
                    at = index[w]
                    if w != width[i]:
                        sel = width[at] == w
                    else:
                        sel = np.ones(len(at), bool)
                    m = n[lo:hi][at]
                    sel &= (root[lo:hi][at] != root[lo + i]) & (m * 100 >= n[lo + i] * PERCENT) & (n[lo + i] * 100 >= m * PERCENT)
                    at, m, rows = at[sel], m[sel], stacks[w][sel]
                    apart = np.bitwise_count(rows ^ mine).sum(1, dtype=np.int64)
                    # linked sets differ in at most (n1 + n2) / 9 shingles
                    near = at[apart * (100 + PERCENT) <= (m + n[lo + i]) * (100 - PERCENT)]
                    u.append(np.full(len(near), k[lo + i]))
                    v.append(k[lo:hi][near])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

    return rows.groupBy("g").applyInPandas(compare, "u long, v long")


def groups(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with size and set hash; sets with their component's first
    document and that document's row)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    sets, roots = set_components(docs, scratch, text)
    # by set, then by component: one row each before the rows are met again
    by_set = sets.where("n > 0").groupBy("k").agg(F.min(F.struct("doc", "row")).alias("first"))
    by_set = by_set.join(roots.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    lead = by_set.groupBy("root").agg(F.min("first").alias("lead"))
    return sets, by_set.join(lead, "root").select("k", F.col("lead.doc").alias("component"), F.col("lead.row").alias("lead_row"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    sets, named = groups(docs, text)
    out = sets.join(named, "k", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), _id(own).alias("component_id"))


def first_of_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the
    smallest doc_id (then text hash); rows without words all stay."""
    sets, named = groups(docs, text)
    first = sets.join(named, "k").where("doc = component and row = lead_row").select("doc", "row").distinct()
    keyed = packed(docs, doc=F.coalesce("doc_id", F.lit(NO_ID)), row=F.xxhash64(text))

    def those(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, ["doc", "row"], "left_semi")

    if sets.groupBy("doc", "row").count().where("count > 1").isEmpty():
        out = those(first.unionByName(sets.where("n = 0").select("doc", "row")))
    else:
        out = those(first).dropDuplicates(["doc", "row"]).unionByName(those(sets.where("n = 0").select("doc", "row").distinct()))
    return out.select(*given(docs))


def _id(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NO_ID, c)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_jaccard": op5_jaccard}

ORACLES = {"op5_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM w
), sized AS (
  SELECT doc_id, len(s)::BIGINT AS n, s FROM s
), x AS (
  SELECT doc_id, n, unnest(s) AS t FROM sized
), link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT doc_id, doc_id FROM sized
  UNION
  SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v
)
SELECT u AS doc_id, any_value(n) AS n_shingles, min(v) AS component_id FROM reach JOIN sized ON doc_id = u GROUP BY u
"""}

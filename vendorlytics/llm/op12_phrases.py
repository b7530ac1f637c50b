"""Phrase collocations by mergeable Misra-Gries summaries.

A phrase is frequent in its group (lang) when it occurs ``least`` times. Counts
go in three rounds, by length: single words; pairs of frequent words; then 3 to
``LONGEST`` words all of whose neighbouring pairs are frequent (each part of a
frequent phrase is frequent, so nothing is lost). A round has two passes:

1. Summaries. Tasks add up the occurrences of what they hold and send them on
   by hash partition of the phrase, packed: 32 bits of hash for each phrase in
   a partition (phrases that share them only bring each other along). Each
   partition keeps a Misra-Gries summary of ``capacity`` counters: where it is
   full, the smallest counts are subtracted from all. With a capacity above the
   partition's mass / ``least``, what is subtracted stays below ``least``, so
   every frequent phrase survives; a partition whose mass turns out larger gets
   more room instead of going over. Survivors are those whose counter plus what
   was subtracted reaches ``least``.
2. Exact counts of the survivors. Tasks know them by a bit filter of at most
   2 ** MOST_BITS bits; what passes it wrongly (all, were the filter full) is
   counted too and falls at the threshold, so its size costs time, not rows.
   Phrases are told apart by 128 bits of hash.

A pass of one round and the first of the next read the texts together.
Scores: a phrase cut after k words into parts of l and r occurrences has
floor(1000 a n / (l r)), its lowest cut counts; phrases inside a longer one
that is as frequent go.

Scale: a task holds one stretch of text and about ``HELD`` counters (more are
sent on and begun anew), a partition ``capacity`` counters; the number of
partitions grows with the corpus. A frequent word is one counter a task.

Defined cases: null and empty texts have no words, a null lang is ``und``;
repeated rows count each time; a piece ends at ``.,;:!?`` and line ends, words
at spaces and tabs only; whole texts of any length, cut at piece ends only.
Only ``text`` and ``lang`` are read, so further columns of any name don't
matter. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlytics.llm.common import FOLD, MIX1, ODD, Scratch, bucket_count, mix, powers, sub_batches, table, text_buffers

LEAST = 100
LONGEST = 5
TOP = 2000
SEGMENT = 2 << 20
HELD = 1 << 20
PENDING = 1 << 18  # counts that a partition takes into its summary at once
MOST_BITS = 29

KIND = np.zeros(256, np.int8)  # 0: of a word, 1: between words, 2: ends a piece
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
OTHER = np.uint64(0x2545F4914F6CDD1D)
SPLIT = bytes.maketrans(b"\t", b" ")


class Words:
    """Words of a stretch of bytes: their ends, pieces, and two hashes each."""

    def __init__(self, b, group):
        """``group``: one hash per text; ``b`` is a list of byte arrays."""
        size = np.array([len(x) + 1 for x in b])
        self.bytes = np.concatenate([y for x in b for y in (x, BREAK)]) if b else np.empty(0, np.uint8)
        kind = KIND[self.bytes]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.start)
        self.text = np.searchsorted(np.cumsum(size), self.start, "right")
        self.piece = np.cumsum(kind == 2)[self.start] if n else np.empty(0, np.int64)
        if not n:
            self.h = self.g = np.empty(0, np.uint64)
            return
        length = self.end - self.start
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        at = np.arange(int(length.sum())) - np.repeat(first, length)
        p = powers(int(length.max()))
        values = FOLD[self.bytes[np.flatnonzero(inside)]]
        one = np.add.reduceat(values * p[at], first)
        two = np.add.reduceat(mix(values) * p[at], first)
        own = np.asarray(group, np.uint64)[self.text]
        self.h = mix(one + length.astype(np.uint64) + own)
        self.g = mix(two * OTHER + own * MIX1)

    def grams(self, k: int, at):
        """Both hashes of the phrases of ``k`` words from the words ``at``."""
        if k == 1:
            return self.h[at], self.g[at]
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i in range(k):
            a += self.h[at + i] * ODD[i]
            b += self.g[at + i] * ODD[i + 8]
        return mix(a + np.uint64(k)), mix(b + np.uint64(k))

    def phrase(self, i: int, k: int) -> str:
        raw = self.bytes[self.start[i]:self.end[i + k - 1]].tobytes().translate(SPLIT).lower()
        return " ".join([w for w in raw.decode("utf-8", "replace").split(" ") if w])


MASK = (1 << 64) - 1
BREAK = np.array([10], np.uint8)


def group_hash(lang: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((lang if lang is not None else "und").encode())


def words_of(batches):
    """(Words, group by text) of stretches of about ``SEGMENT`` bytes; longer
    texts are cut where a piece ends."""
    for batch in batches:
        for part in sub_batches(batch, "text", SEGMENT):
            data, off = text_buffers(part.column("text"))
            langs = [x if x is not None else "und" for x in part.column("lang").to_pylist()]
            group = {x: group_hash(x) for x in set(langs)}
            texts = [data[off[i]:off[i + 1]] for i in range(len(langs))]
            if len(texts) == 1 and len(texts[0]) > SEGMENT:
                b = texts[0]
                ends = np.flatnonzero(KIND[b] == 2)
                lo = 0
                while lo < len(b):
                    j = np.searchsorted(ends, lo + SEGMENT)
                    hi = int(ends[j]) + 1 if j < len(ends) else len(b)
                    yield Words([b[lo:hi]], [group[langs[0]]]), langs
                    lo = hi
            else:
                yield Words(texts, [group[x] for x in langs]), langs


class Filter:
    """Bits of the survivors' hashes; without bits, everything passes."""

    def __init__(self, bits=None, log: int = 0):
        self.bits, self.log = bits, log

    def has(self, h):
        if self.bits is None:
            return np.ones(len(h), bool)
        at = h >> np.uint64(64 - self.log)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def starts(words: Words, k: int, singles: Filter | None, pairs: Filter | None):
    """Words from which a phrase of ``k`` words may be frequent."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(words.piece[:n] == words.piece[k - 1:])
    if k == 2 and singles is not None:
        ok = singles.has(words.h)
        at = at[ok[at] & ok[at + 1]]
    if k > 2 and pairs is not None and len(at):
        two = np.flatnonzero(words.piece[:-1] == words.piece[1:])
        ok = np.zeros(len(words.start), bool)
        ok[two[pairs.has(words.grams(2, two)[0])]] = True
        for i in range(k - 1):
            at = at[ok[at + i]]
    return at


def tally(keys, counts):
    """Sums by key."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class Sums:
    """Occurrences by hash; sent on when more than ``HELD`` are held."""

    def __init__(self):
        self.keys, self.counts, self.new = np.empty(0, np.uint64), np.empty(0, np.int64), []
        self.waiting = 0

    def add(self, h):
        if len(h):
            self.new.append(h)
            self.waiting += len(h)
        if self.waiting > HELD:
            self.settle()

    def settle(self):
        if self.new:
            k = np.concatenate([self.keys, *self.new])
            c = np.concatenate([self.counts, np.ones(self.waiting, np.int64)])
            self.keys, self.counts = tally(k, c)
            self.new, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.keys) > HELD

    def take(self):
        self.settle()
        out = self.keys, self.counts
        self.__init__()
        return out


class Summary:
    """A Misra-Gries summary that can be merged with counted batches."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.lost, self.mass = max(capacity, 1), least, 0, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys, counts):
        self.mass += int(counts.sum())
        self.keys, self.counts = tally(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        while len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.lost + cut >= self.least:  # more mass than the capacity was meant for
                self.capacity *= 2
                continue
            self.lost += cut
            keep = self.counts > cut
            self.keys, self.counts = self.keys[keep], self.counts[keep] - cut

    def survivors(self):
        keep = self.counts + self.lost >= self.least
        return self.keys[keep], self.counts[keep] + self.lost


CHUNK = 1 << 16


def rows_of(**columns):
    """Record batches of at most ``CHUNK`` rows."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, CHUNK):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[i:i + CHUNK]) for k, v in columns.items()})


def signed(h):
    return h.view(np.int64)


PASS = "kind int, a long, b long, lang string, k int, phrase string, n long, data binary"


def pack(keys, counts, log: int):
    """(partition, mass, payload) of sorted hashes: 32 bits each, those that
    occur once first, and the others' counts."""
    part = keys >> np.uint64(64 - log)
    low = (keys >> np.uint64(32 - log)).astype(np.uint32)
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), [len(part)])) if len(part) else [0]
    for lo, hi in zip(edge[:-1], edge[1:]):
        once = counts[lo:hi] == 1
        single, more = low[lo:hi][once], low[lo:hi][~once]
        yield int(part[lo]), int(counts[lo:hi].sum()), b"".join((
            np.uint32(len(single)).tobytes(), single.tobytes(), more.tobytes(), counts[lo:hi][~once].tobytes()))


def unpack(data: bytes):
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    single = np.frombuffer(data, np.uint32, n, 4)
    rest = (len(data) - 4 - 4 * n) // 12
    more = np.frombuffer(data, np.uint32, rest, 4 + 4 * n)
    counts = np.frombuffer(data, np.int64, rest, 4 + 4 * (n + rest))
    return np.concatenate((single, more)), np.concatenate((np.ones(n, np.int64), counts))


def one_pass(texts: DataFrame, exact, summed, singles, pairs, log: int) -> DataFrame:
    """Reads the texts once: counts of the phrases of ``exact`` lengths that
    pass their filter ``exact[k]`` (kind 1: partition, lang, k, the phrases in
    lines, their hashes and counts packed), occurrences by hash for ``summed``
    lengths (kind 0: partition, mass, packed counts; 2 ** log partitions), and
    the first time words by lang (kind 2). ``singles`` and ``pairs`` are
    broadcast filters or None."""

    def send(sums):
        for part, mass, data in pack(*sums.take(), log):
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([0], pa.int32()), "a": pa.array([part], pa.int64()), "b": pa.array([0], pa.int64()),
                "lang": pa.nulls(1, pa.string()), "k": pa.array([0], pa.int32()), "phrase": pa.nulls(1, pa.string()),
                "n": pa.array([mass], pa.int64()), "data": pa.array([data], pa.binary())})

    def total(words):
        n = len(words)
        yield from rows_of(kind=np.full(n, 2, np.int32), a=np.zeros(n, np.int64), b=np.zeros(n, np.int64), lang=pa.array(list(words), pa.string()),
                           k=np.ones(n, np.int32), phrase=pa.nulls(n, pa.string()), n=np.array(list(words.values()), np.int64),
                           data=pa.nulls(n, pa.binary()))

    def give(found):
        rows: dict = {}
        for (x, y), (n, lang, k, phrase) in found.items():
            rows.setdefault(((x & MASK) >> (64 - log), lang, k), []).append((x, y, n, phrase))
        for (part, lang, k), r in rows.items():
            numbers = np.array([x[:3] for x in r], np.int64)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([1], pa.int32()), "a": pa.array([part], pa.int64()), "b": pa.array([len(r)], pa.int64()),
                "lang": pa.array([lang], pa.string()), "k": pa.array([k], pa.int32()),
                "phrase": pa.array(["\n".join([x[3] for x in r])], pa.string()), "n": pa.array([int(numbers[:, 2].sum())], pa.int64()),
                "data": pa.array([numbers.tobytes()], pa.binary())})
        found.clear()

    def run(batches):
        one = Filter(*singles.value) if singles is not None else None
        two = Filter(*pairs.value) if pairs is not None else None
        tests = {k: Filter(*f.value) for k, f in exact.items()}
        sums, found, seen = Sums(), {}, {}
        for words, langs in words_of(batches):
            if 1 in summed:
                n = np.bincount(words.text, minlength=len(langs)) if len(words.start) else np.zeros(len(langs), np.int64)
                for x, m in zip(langs, n.tolist()):
                    seen[x] = seen.get(x, 0) + m
                if len(seen) > HELD // 4:
                    yield from total(seen)
                    seen = {}
            for k, f in tests.items():
                at = starts(words, k, one, two)
                a, _ = words.grams(k, at)
                ok = f.has(a)
                at, a = at[ok], a[ok]
                if not len(at):
                    continue
                order = np.argsort(a, kind="stable")
                at, a = at[order], a[order]
                b = words.grams(k, at)[1]
                change = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                first = np.flatnonzero(change)
                counts = np.diff(np.concatenate((first, [len(a)])))
                for x, y, i, n in zip(signed(a[first]).tolist(), signed(b[first]).tolist(), at[first].tolist(), counts.tolist()):
                    row = found.get((x, y))
                    if row is None:
                        found[x, y] = [n, langs[int(words.text[i])] if len(langs) > 1 else langs[0], k, words.phrase(i, k)]
                    else:
                        row[0] += n
                if len(found) > HELD // 4:
                    yield from give(found)
            for k in summed:
                at = starts(words, k, one, two)
                sums.add(words.grams(k, at)[0])
            if sums.full():
                yield from send(sums)
        yield from send(sums)
        yield from give(found)
        yield from total(seen)

    return texts.mapInArrow(run, PASS)


def counted(packed: DataFrame, least: int, log: int) -> DataFrame:
    """(lang, k, phrase, n): the exact counts that reach ``least``, by hash
    partition."""
    def add(batches):
        found: dict = {}
        for batch in batches:
            for lang, k, phrases, data in zip(*[batch.column(c).to_pylist() for c in ("lang", "k", "phrase", "data")]):
                numbers = np.frombuffer(data, np.int64).reshape(-1, 3).tolist()
                for (a, b, n), phrase in zip(numbers, phrases.split("\n")):  # a phrase has no line end
                    row = found.get((a, b))
                    if row is None:
                        found[a, b] = [n, lang, k, phrase]
                    else:
                        row[0] += n
        rows = [x for x in found.values() if x[0] >= least]
        yield from rows_of(lang=pa.array([x[1] for x in rows], pa.string()), k=np.array([x[2] for x in rows], np.int32),
                           phrase=pa.array([x[3] for x in rows], pa.string()), n=np.array([x[0] for x in rows], np.int64))

    return (packed.select("a", "lang", "k", "phrase", "data").repartition(1 << log, "a")
                  .mapInArrow(add, "lang string, k int, phrase string, n long"))


def survivors(sums: DataFrame, mass: int, least: int, log: int) -> DataFrame:
    """(a, n): hashes whose summary reaches ``least``, by hash partition."""
    capacity = 2 * (mass // (least << log)) + 1

    def merge(batches):
        held: dict = {}

        def settle(part):
            s, keys, counts, _ = held[part]
            s.merge(np.concatenate(keys).astype(np.uint64), np.concatenate(counts))
            held[part] = [s, [], [], 0]

        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part not in held:
                    held[part] = [Summary(capacity, least), [], [], 0]
                keys, counts = unpack(data)
                held[part][1].append(keys)
                held[part][2].append(counts)
                held[part][3] += len(keys)
                if held[part][3] > PENDING:
                    settle(part)
        for part in list(held):
            if held[part][3]:
                settle(part)
            keys, n = held[part][0].survivors()
            yield from rows_of(a=signed((np.uint64(part) << np.uint64(64 - log)) | (keys << np.uint64(32 - log))), n=n)

    return sums.select("a", "data").repartition(1 << log, "a").mapInArrow(merge, "a long, n long")


def filter_of(found: DataFrame):
    """A broadcast filter of the column ``a``: 64 bits for each row, at most
    2 ** MOST_BITS in all (64 MB)."""
    spark = found.sparkSession
    log = min(MOST_BITS, max(12, math.ceil(math.log2(64 * max(1, found.count())))))
    bits = (found.select(F.shiftrightunsigned("a", 64 - log).alias("at"))
                 .select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("v"))
                 .groupBy("w").agg(F.bit_or("v").alias("v"))).toArrow()
    out = np.zeros(1 << (log - 6), np.uint64)
    out[np.asarray(bits.column(0))] = np.asarray(bits.column(1)).view(np.uint64)
    return spark.sparkContext.broadcast((out, log))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of 1 to ``longest`` words that
    occur ``least`` times in their lang, exact; and (lang, n), all words."""
    if not 2 <= longest <= 8 or least < 2:
        raise ValueError("phrases have 2 to 8 words; the threshold is 2 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    log = min(24, math.ceil(math.log2(bucket_count(texts, 0.125))))
    rounds = [[1], [2], list(range(3, longest + 1))]
    filters: list = []
    tables = []
    for turn in range(len(rounds) + 1):
        if turn and not filters[-1]:
            break
        lengths = rounds[turn] if turn < len(rounds) else []
        done = {k: filters[turn - 1] for k in rounds[turn - 1]} if turn else {}
        both = scratch.write(one_pass(texts, done, lengths, *(filters + [None, None])[:2], log), f"pass{turn}")
        if done:
            tables.append(scratch.write(counted(both.where("kind = 1"), least, log), f"exact{turn}"))
        else:
            words = scratch.write(both.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        if lengths:
            sums = both.where("kind = 0")
            mass = sums.agg(F.sum("n")).first()[0] or 0
            found = scratch.write(survivors(sums, mass, least, log), f"survivors{turn}")
            filters.append(filter_of(found) if not found.isEmpty() else None)
        scratch.drop(both)
    out = spark.createDataFrame([], "lang string, k int, phrase string, n long")
    for t in tables:
        out = out.unionByName(t)
    return out, words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``top`` phrases."""
    found, words = frequent(docs, least, longest)
    phrases = found.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    cuts = (phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
                   .withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
                   .withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)")))
    part = found.select(F.col("lang").alias("g"), F.col("phrase").alias("p"), F.col("n").alias("f"))
    cuts = (cuts.join(part, (F.col("lang") == F.col("g")) & (F.col("head") == F.col("p"))).drop("g", "p").withColumnRenamed("f", "l")
                .join(part, (F.col("lang") == F.col("g")) & (F.col("rest") == F.col("p"))).drop("g", "p").withColumnRenamed("f", "r")
                .join(words, "lang"))
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    cuts = (cuts.withColumn("over", wide["a"] * wide["n"]).withColumn("under", wide["l"] * wide["r"])
                .withColumn("score", F.expr(EXACT)))
    best = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "k", "a", "n", "m.score", "m.l", "m.r")
    inner = (phrases.where("k > 2")
                    .withColumn("w", F.split("phrase", " "))
                    .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
                    .withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
                    .select("lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"), F.col("a").alias("longer")))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
                .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


# 1000 a n / (l r) by long division in thousands: each step's remainder is
# below l r, so every product keeps within 38 digits.
EXACT = "cast(over div under as bigint) * 1000 + cast(((over % under) * cast(1000 as decimal(4,0))) div under as bigint)"


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}

_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS p FROM pieces"
    for k in range(1, LONGEST + 1))
ORACLES = {"op12_phrases": rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, k, p, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT f.lang, f.k, f.p, f.a, c.cut, x.a AS l, y.a AS r, n, (1000::HUGEINT * f.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, string_split(p, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1) c
  JOIN f USING (lang, k, p)
  JOIN f x ON x.lang = f.lang AND x.k = c.cut AND x.p = array_to_string(w[1:c.cut], ' ')
  JOIN f y ON y.lang = f.lang AND y.k = f.k - c.cut AND y.p = array_to_string(w[c.cut + 1:], ' ')
  JOIN total t ON t.lang = f.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS p, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i
        FROM (SELECT *, string_split(p, ' ') AS w, unnest(range(2, k)) AS size FROM f WHERE k > 2)) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * best.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""}

"""Helpers shared by the operators: reading, scratch tables, word hashing."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one operator call, written as Parquet under
    ``spark.checkpoint.dir`` (a lost executor re-reads files instead of
    recomputing). ``drop`` removes tables that nothing will read again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **used) -> DataFrame:
    """Columns under names of the caller's own, beside the struct ``given`` of
    all columns of ``df``, so that no input column can clash with a working
    name. ``used`` maps a working name to a column name or expression."""
    own = [(F.col(quoted(c)) if isinstance(c, str) else c).alias(name) for name, c in used.items()]
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("given"), *own)


def given(df: DataFrame, **changed) -> list[Column]:
    """The columns of the input ``df`` out of a packed row; ``changed`` gives
    some of them a new value."""
    return [changed[c].alias(c) if c in changed else F.col(f"given.{quoted(c)}").alias(c) for c in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def bucket_count(df: DataFrame, per_split: float = 1.0, least: int = 128) -> int:
    """Buckets for packed exchanges: in proportion to the input's splits, so
    that a bucket stays of bounded size however large the input is."""
    return max(least, math.ceil(per_split * df.rdd.getNumPartitions()))


# --- word and shingle hashes, vectorized over whole Arrow batches ---------

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint64)
FOLD[65:91] += np.uint64(32)
FOLD += np.uint64(1)


def mix(x):
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int):
    p = np.full(n, BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def segment_words(b):
    """Hash, start and end of every word of the bytes ``b``."""
    w = ~SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], w, [False])).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    if not len(s):
        return np.empty(0, np.uint64), s, e
    length = e - s
    inside = np.flatnonzero(w)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    at = np.arange(len(inside)) - np.repeat(first, length)
    h = np.add.reduceat(FOLD[b[inside]] * powers(int(length.max()))[at], first)
    return mix(h + length.astype(np.uint64)), s, e


def text_buffers(texts):
    """Bytes and offsets of an Arrow string array (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def batch_words(texts):
    """Words of every text: (hashes, words per text). A-Z are lower-cased; a
    word is a run without the six ASCII spaces. Whole texts, in segments of
    about 4 MB that end where a text or a word ends."""
    data, off = text_buffers(texts)
    n = len(off) - 1
    hashes, counts = [], np.zeros(n, np.int64)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(off, off[i] + SEGMENT, "right")) - 1, i + 1)
        if j == i + 1 and off[j] - off[i] > SEGMENT:
            lo = int(off[i])
            while lo < off[j]:
                hi = min(lo + SEGMENT, int(off[j]))
                while hi < off[j] and not SPACE[data[hi]]:
                    hi += 1
                h, _, _ = segment_words(data[lo:hi])
                hashes.append(h)
                counts[i] += len(h)
                lo = hi
        else:
            # a space between texts keeps their words apart
            part = data[off[i]:off[j]]
            cut = off[i + 1:j] - off[i]
            h, s, _ = segment_words(np.insert(part, cut, 32))
            starts = off[i:j] - off[i] + np.arange(j - i)
            counts[i:j] += np.diff(np.concatenate((np.searchsorted(s, starts), [len(s)])))
            hashes.append(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def batch_shingles(texts, width: int = 5):
    """Shingles of ``width`` words in text order: (hashes, per text). A text
    with 1 to width-1 words has one shingle, its whole sequence."""
    h, words = batch_words(texts)
    n = np.maximum(words - width + 1, (words > 0).astype(np.int64))
    out = np.empty(int(n.sum()), np.uint64)
    if not len(out):
        return out, n
    wpos = np.concatenate(([0], np.cumsum(words)))[:-1]
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    at = np.arange(len(out)) - np.repeat(first, n) + np.repeat(wpos, n)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    acc = np.zeros(len(out), np.uint64)
    size = np.minimum(np.repeat(words, n), width)
    for k in range(width):
        acc += np.where(k < size, padded[at + k] * ODD[k], np.uint64(0))
    return mix(acc + size.astype(np.uint64)), n


def sub_batches(batch, column: str, most: int = SEGMENT):
    """Slices of a record batch with about ``most`` bytes of text each."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi

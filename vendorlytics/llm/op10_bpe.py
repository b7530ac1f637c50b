"""BPE encoding and decoding through a tokenization automaton.

The merge list is compiled, merge by merge, into a deterministic automaton
whose arcs are labelled with tokens and which accepts exactly the token
sequences that byte-pair encoding produces. A merge gadget for ``(u, v) -> x``

* removes the arc ``v`` from the state reached by ``u`` (the pair must merge);
* adds an arc ``x`` from every state that had an arc ``u`` at that moment,
  into the state reached by ``v`` at that moment.

The state after a token depends on that token alone, so states are named by
tokens. An arc inherited through gadgets is resolved by undoing them from the
newest one, and the answer is kept in the transition table.

A pre-split word is encoded by following arcs, the longest label first. Only
one accepted path spells a given prefix, so a position from which nothing leads
on is backed over once and never entered again.
Decoding emits the labels of the arcs.

Defined cases: a null or empty text has no ids and decodes to the empty text;
texts are encoded whole, whatever their length; repeated rows are encoded
each; other columns pass through, and a clash with an output name raises
``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.llm.common import sub_batches, table

TOKENIZER = "byte_bpe_50k.json"  # a public tokenizer's file name, or a path

# Fixed values of the byte-level format: the bytes that are their own
# character; the others take the characters from 256 on, in order.
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Fixed value: the pattern that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 250_000


def byte_chars() -> dict[str, int]:
    out = {chr(b): b for b in OWN_BYTES}
    rest = [b for b in range(256) if b not in set(OWN_BYTES)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges: labels (bytes of each token), gadgets in merge order
    and the transition table, which fills as words are read."""

    def __init__(self, vocab: dict[str, int], merges: list, added: list[dict]):
        to_byte = byte_chars()
        text = {t: bytes(to_byte[c] for c in t) for t in vocab}
        self.labels = {i: text[t] for t, i in vocab.items()}
        self.ids = {text[t]: i for t, i in vocab.items()}
        # the start of every label: its token, or -1 where labels only begin so
        self.prefixes = {label[:k]: -1 for label in self.ids for k in range(1, len(label))} | self.ids
        # gadgets[x] = (when, u, v); removed[(u, v)] = when
        self.gadgets: dict[int, tuple[int, int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for when, pair in enumerate(merges):
            u, v = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.add_gadget(when, vocab[u], vocab[v], vocab[u + v])
        self.special = {a["content"]: a["id"] for a in added}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        # all merges, ids and special tokens: no other tokenizer shares its coder
        whole = json.dumps([sorted(vocab.items()), list(merges), sorted(self.special.items())])
        self.key = hashlib.sha256(whole.encode()).hexdigest()

    def add_gadget(self, when: int, u: int, v: int, x: int) -> None:
        self.removed[u, v] = when
        self.gadgets.setdefault(x, (when, u, v))

    @classmethod
    def load(cls, path: str) -> "Automaton":
        if not os.path.dirname(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        return cls(spec["model"]["vocab"], spec["model"]["merges"], spec.get("added_tokens", []))

    def arc(self, state: int, token: int, now: int = 1 << 60) -> bool:
        """Has the state after ``state`` an arc ``token`` at time ``now`` (at
        the end: all gadgets are in place)? Undo the newer gadget of the two
        until the pair's own removal, or two single bytes, decide. Gadget k
        removes its arc at time 2k and adds arcs at 2k + 1."""
        gadgets, removed = self.gadgets, self.removed
        while True:
            if 2 * removed.get((state, token), now) < now:
                return False
            a, b = gadgets.get(state), gadgets.get(token)
            a = a if a is not None and 2 * a[0] < now else None
            b = b if b is not None and 2 * b[0] + 1 < now else None
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                # after x: what there was after v, its own arc not yet removed
                now, state = 2 * a[0], a[2]
            else:
                # an arc x was added where the arc u was left just then
                now, token = 2 * b[0] + 1, b[1]

    def word(self, w: bytes, table: dict) -> list[int]:
        """The accepted token path of one pre-split word: follow arcs by the
        longest label first. Only one accepted path spells a given prefix, so
        a byte position is given up for good once nothing leads on from it."""
        prefixes, size = self.prefixes, len(w)
        path, ends, dead, i, q, limit = [], [], set(), 0, -1, size
        while i < size:
            found, j = [], i + 1
            while j <= limit:
                t = prefixes.get(w[i:j])
                if t is None:
                    break
                if t >= 0 and j not in dead:
                    found.append(t)
                    ends.append(j)
                j += 1
            base = len(ends) - len(found)
            while found:
                t, j = found.pop(), ends.pop()
                k = q << 32 | t
                ok = table.get(k)
                if ok is None:
                    ok = table[k] = self.reachable(t) if q < 0 else self.arc(q, t)
                if ok:
                    del ends[base:]
                    path.append(t)
                    i, q, limit = j, t, size
                    break
            else:
                dead.add(i)
                limit = i - 1
                i -= len(self.labels[path.pop()])
                q = path[-1] if path else -1
        return path

    def reachable(self, token: int) -> bool:
        """Is there an arc from the start: did the path u, v exist when the
        gadget of ``token`` was added, and so on for its parts?"""
        g = self.gadgets.get(token)
        return g is None or self.reachable(g[1]) and self.reachable(g[2]) and self.arc(g[1], g[2], 2 * g[0])


class Pieces(dict):
    """Ids (little-endian bytes) of space-led pieces, computed when missed."""

    def __init__(self, coder):
        self.coder = coder

    def __missing__(self, piece):
        # letters only: one pre-split word, no need to split
        ids = self.coder.one(" " + piece) if piece.isalpha() else self.coder.slow(" " + piece)
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids


class Coder:
    """Encodes and decodes whole texts with an automaton."""

    def __init__(self, automaton: Automaton):
        import re

        import regex

        self.automaton, self.table, self.words = automaton, {}, {}
        self.split = regex.compile(SPLIT).findall
        self.mixed = re.compile(r"\s | \s|[\x1c-\x1f\x85]").search
        self.pieces = Pieces(self)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None
        self.labels = automaton.labels

    def one(self, w: str) -> bytes:
        if len(self.table) > 2 * CACHE_ENTRIES:
            self.table.clear()
        return struct.pack(f"<{len(path := self.automaton.word(w.encode(), self.table))}I", *path)

    def slow(self, text: str) -> bytes:
        words, pieces, out = self.words, self.pieces, []
        for w in self.split(text):
            if w[0] == " " and w[1:].isalpha():
                out.append(pieces[w[1:]])
                continue
            ids = words.get(w)
            if ids is None:
                if len(words) > CACHE_ENTRIES:
                    words.clear()
                ids = words[w] = self.one(w)
            out.append(ids)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.mixed(text):
            return self.slow(text)
        # every space is single and between other characters: the words of
        # each space-led piece don't depend on what surrounds it
        first, *rest = text.split(" ")
        return self.slow(first) + b"".join(map(self.pieces.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(s in text for s in self.automaton.special):
            return self.plain(text)
        return b"".join(
            np.array([self.automaton.special[p]], "<u4").tobytes() if p in self.automaton.special else self.plain(p)
            for p in self.special.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def worker_coder(automaton: Automaton) -> Coder:
    """One coder (with its caches) per Python worker, kept between tasks."""
    kept = sys.modules.setdefault("_llm_bpe_coders", types.ModuleType("_llm_bpe_coders"))
    coder = kept.__dict__.get(f"k{automaton.key}")
    if coder is None:
        coder = kept.__dict__[f"k{automaton.key}"] = Coder(automaton)
    return coder


def _mapped(df: DataFrame, column: str, steps: list[tuple[str, str]], automaton: Automaton) -> DataFrame:
    """``steps``: (output name, "encode" or "decode"), each on the one before."""
    clash = {name for name, _ in steps} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    kinds = {"encode": T.BinaryType(), "decode": T.StringType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kinds[what]) for name, what in steps)])
    shared = df.sparkSession.sparkContext.broadcast(automaton)  # bounded by the vocabulary

    def run(batches):
        import pyarrow as pa

        coder = worker_coder(shared.value)
        for batch in batches:
            for part in sub_batches(batch, column, 1 << 20):
                values, added = part.column(column).to_pylist(), []
                for _, what in steps:
                    f, empty = getattr(coder, what), "" if what == "encode" else b""
                    values = [f(empty if x is None else x) for x in values]
                    added.append(pa.array(values, pa.binary() if what == "encode" else pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, automaton: Automaton, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text as little-endian unsigned 32-bit integers."""
    return _mapped(df, text, [(out, "encode")], automaton)


def decode(df: DataFrame, automaton: Automaton, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for (invalid UTF-8 is replaced)."""
    return _mapped(df, ids, [(out, "decode")], automaton)


def encode_decode(df: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """Both directions in one pass, adding ``ids`` and ``decoded``."""
    return _mapped(df, text, [("ids", "encode"), ("decoded", "decode")], Automaton.load(path))


def digest(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        "doc_id", *keep,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}

"""Brute-force versions in plain Python, and small tables of awkward rows."""

import re
import tempfile

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

AWKWARD = [
    (1, "Alpha beta gamma delta epsilon\nzeta eta theta iota kappa", "en", "src0", 10),
    (1, "Alpha beta gamma delta epsilon\nzeta eta theta iota kappa", "en", "src0", 10),
    (2, "", "en", "src1", 0), (3, None, None, None, None), (None, "a line of null id, mail x@y.zz now", "de", "src0", 3),
    (None, None, "de", "src2", None), (4, "  ALPHA BETA gamma delta epsilon \n\nshort\nshort", "fr", "other", 5),
    (5, "word " * 4000 + "\n" + "x" * 20000, "en", "src0", 9), (6, "one two", "en", "src3", 7), (7, "\n\n", "en", "src3", 2),
    (6, "another text of id six +1 555 010 9999", "en", "src3", 7), (8, "é😀 10.0.0.255 4111 1111 1111 1111", "es", "src4", 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = [x for x in SPACE.split((text or "").translate(UP)) if x]
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def roots(n, linked):
    lead = list(range(n))

    def find(x):
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for a, b in linked:
        lead[find(a)] = find(b)
    return [find(i) for i in range(n)]


def jaccard_groups(texts):
    s = [shingles(t) for t in texts]
    return roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j]
                          and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])])


def tables(spark, docs, labels=()):
    """A folder with documents and labels of these rows."""
    path = tempfile.mkdtemp(prefix="llm-test-")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def near_copies(seed, n, words=120, edits=3):
    """Texts in groups of one base each, with a few words changed."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base = [f"w{x}" for x in r.integers(0, 5000, words + int(r.integers(0, 60)))]
        out.append(" ".join(base))
        for _ in range(int(r.integers(0, 6))):
            w = list(base)
            for k in r.integers(0, len(w), int(r.integers(0, edits + 1))):
                w[k] = f"e{r.integers(0, 10 ** 9)}"
            out.append(" ".join(w))
    return out

"""Operators 11 to 13 against brute-force versions and on awkward rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, DOCS, UP
from vendorlytics.llm import op11_merkle, op12_phrases, op13_wrappers
from vendorlytics.llm.common import Scratch


# --- Merkle manifest -------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree, i, now):
    proof = ""
    for level in tree[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        proof += "".join(run[:i % 8] + run[i % 8 + 1:])
        now, i = h(*run[:i % 8], now, *run[i % 8 + 1:]), i // 8
    return now, proof


def manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(langs[g], key=lambda x: x[:3])):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, one = climb(trees[g], i, leaf(r[0], r[1] and r[1].translate(UP), *r[2:]) if changed else own)
            now, two = climb(top, k, now)
            out.append((r[0], own, trees[g][-1][0], root, h(one, two), now, now == root))
    return sorted(out, key=repr)


def proofs(spark, rows, height):
    docs = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("nodes", F.lit(None))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = op11_merkle.Manifest(op11_merkle.document_leaves(docs, third), height).proofs()
    return sorted([(r["id"], r["leaf"], r["subroot"], r["root"], h(r["proof"]), r["folded"], r["verified"]) for r in got.collect()], key=repr)


@pytest.mark.parametrize("n, height", [(1, 4), (9, 1), (700, 1), (700, 2), (600, 4)])
def test_manifest(spark, n, height):
    rows = [(i * 7 % 1000, f"Text {i}", random.Random(i).choice(["en", "en", "é", None]), "s", i) for i in range(n)]
    assert proofs(spark, rows, height) == manifest(rows)


def test_manifest_awkward_rows_and_many_groups(spark):
    rows = AWKWARD + [(i, "X", f"g{i}", None, None) for i in range(80)]
    assert proofs(spark, rows, 1) == manifest(rows)


def test_manifest_of_one_row_is_its_leaf(spark):
    (r,) = proofs(spark, AWKWARD[:1], 4)
    assert r[1] == r[2] == r[3] and r[4] == h()


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 6])
def test_layout_splits_at_half_height(count):
    places = op11_merkle.layout(count)
    assert [len(p) for p in places] == [8 ** d for d in range(count)]
    assert sorted(np.concatenate(places).tolist()) == list(range(sum(8 ** d for d in range(count))))
    top = count // 2
    if top:  # the top subtree comes first, the bottom ones are contiguous
        size = sum(8 ** d for d in range(count - top))
        assert places[top][0] == sum(8 ** d for d in range(top)) and (np.diff(places[top]) == size).all()


def test_tampering_any_leaf_changes_the_root(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    leaves = op11_merkle.document_leaves(df).withColumn("altered", F.when(F.col("id") == 17, F.unhex(F.lit("ab" * 32))))
    got = op11_merkle.Manifest(leaves, 1).proofs().collect()
    assert [r["id"] for r in got if not r["verified"]] == [17] and len({r["root"] for r in got}) == 1


# --- phrases ----------------------------------------------------------------


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        g = lang if lang is not None else "und"
        n[g] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, 6):
                f.update((g, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def phrases(rows, least, top):
    f, n = counted(rows)
    f = {x: a for x, a in f.items() if a >= least}
    inner = Counter()
    for (g, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[g, p[i:i + k]] = max(inner[g, p[i:i + k]], a)
    out = defaultdict(list)
    for (g, p), a in f.items():
        if len(p) > 1 and inner[g, p] < a:
            score, k = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            out[g].append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, i + 1, x[2].decode(), -x[1], x[3], x[4], n[g], -x[0]) for g in out for i, x in enumerate(sorted(out[g])[:top]))


def phrase_rows(seed, n):
    r = random.Random(seed)
    vocab = ["a", "B", "cc", "é", "Ñ", "d'e", "x-y", "😀", "b"]
    sep = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", " ; ", "\x0b", "\r\n", "\xa0"]
    return [("".join(r.choice(vocab) + r.choice(sep) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("least, top", [(3, 2000), (8, 5)])
def test_phrases(spark, least, top):
    rows = phrase_rows(least, 150) + [(None, "en"), ("", None), ("a b " * 3000, "de"), ("q" * 50000, "en")] + [("same row here", "xx")] * 20
    docs = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, n int, phrase int")
    got = op12_phrases.collocations(docs.repartition(3), least, 5, top)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == phrases(rows, least, top)


def test_phrases_in_small_segments_and_with_flushed_counters(spark, monkeypatch):
    words = op12_phrases.Words([np.frombuffer(b"a b. c", np.uint8)], [1])
    assert op12_phrases.starts(words, 2, None, None).tolist() == [0]
    import pyarrow as pa

    monkeypatch.setattr(op12_phrases, "SEGMENT", 64)
    rows = phrase_rows(5, 30) + [("a b cc " * 300 + ". " + "x y, " * 200, "en")]
    want, _ = counted(rows)
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [g or "und" for _, g in rows]})
    got = Counter()
    for w, langs in op12_phrases.words_of([batch]):
        for k in (1, 2, 3, 4, 5):
            for i in op12_phrases.starts(w, k, None, None):
                got[langs[int(w.text[i])], tuple(w.phrase(int(i), k).split(" "))] += 1
    assert got == want


def test_summary_keeps_all_frequent_keys():
    r = np.random.default_rng(1)
    keys = np.concatenate([r.integers(0, 50000, 60000), np.repeat(np.arange(60000, 60040), 100)]).astype(np.uint64)
    r.shuffle(keys)
    for capacity in (len(keys) // 100 + 1, 50):  # the second is too small for the mass
        s = op12_phrases.Summary(capacity, 100)
        for part in np.array_split(keys, 37):
            s.merge(*op12_phrases.tally(part, np.ones(len(part), np.int64)))
        found, upper = s.survivors()
        assert set(range(60000, 60040)) <= set(found.tolist()) and s.lost < 100 and s.mass == len(keys)
        assert (upper[np.isin(found, np.arange(60000, 60040))] >= 100).all()


@pytest.mark.parametrize("log", [7, 12])
def test_packed_counts_come_back(log):
    r = np.random.default_rng(log)
    keys = np.unique(r.integers(0, 2 ** 64, 5000, dtype=np.uint64))
    counts = np.where(r.random(len(keys)) < 0.7, 1, r.integers(2, 10 ** 10, len(keys)))
    seen = {}
    for part, mass, data in op12_phrases.pack(keys, counts, log):
        low, n = op12_phrases.unpack(data)
        assert mass == n.sum()
        seen |= {(part << 32) + int(x): int(y) for x, y in zip(low, n)}
    assert seen == {int(k) >> (32 - log): int(n) for k, n in zip(keys, counts)}
    assert list(op12_phrases.pack(keys[:0], counts[:0], log)) == []


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10 ** 12 + 7, 9 * 10 ** 14 + 1, 10 ** 13 + 3, 10 ** 12 + 9), (3, 7, 3, 3), (10 ** 14, 10 ** 15 - 1, 10 ** 14, 10 ** 14 + 1)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").select(
        "*", *[F.col(c).cast("decimal(18,0)").alias(c + c) for c in "anlr"])
    df = df.withColumn("over", F.col("aa") * F.col("nn")).withColumn("under", F.col("ll") * F.col("rr")).withColumn("score", F.expr(op12_phrases.EXACT))
    assert {(r["a"], r["score"]) for r in df.collect()} == {(a, 1000 * a * n // (x * y)) for a, n, x, y in cases}


# --- wrappers ---------------------------------------------------------------


def pages(spark, htmls, url="http://A.org/x"):
    return spark.createDataFrame([(i, url, x, "c", "d") for i, x in enumerate(htmls)], "page_id long, url string, html string, host string, content string")


def texts(spark, htmls, url="http://A.org/x"):
    return [r["text"] for r in sorted(op13_wrappers.extract(pages(spark, htmls, url)).collect(), key=lambda r: r["page_id"])]


def test_articles_of_the_table(spark):
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op13_wrappers.op13_wrappers(spark, SMALL).collect()
    assert len(got) == len(raw)
    for r in got:
        inner = re.search("(?s)<article>(.*?)</article>", raw[r["page_id"]])[1]
        inner = re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))
        assert r["text"] == " ".join(html.unescape(inner).split()) and r["n_chars"] == len(r["text"])


def test_parts_around_an_article(spark):
    made = [f"""<body class="no-sidebar"><header><h1>Site</h1></header><form><div class="page-header"><main>
      <article class="post has-comments"><header><h1>T{i}</h1></header><p>a<b>b</b>c&nbsp;d <span class="ad">BUY</span> e &lt;&amp;lt;</p>
      <div class=share>Share</div><ul><li>one<li>two {i}</ul><p title="x>y">q<br>r<section id="comments"><article class=comment><p>c{i}</p></article></section>
      <footer>tags</footer></article><aside>x</aside><div class="cookie-notice">We use</div></main></div></form>
      <script>document.write("<article>no</article>")</script><!-- <article>no</article> --></body>""" for i in range(4)]
    assert texts(spark, made) == [f"T{i} abc d e <&lt; one two {i} q r" for i in range(4)]


def test_pages_without_an_article(spark):
    made = [f"""<html><body><div id=top><ul><li><a href=/a>Home {i}</a><li><a href=/b>News</a></ul></div>
      <div class=story><h2>Title {i}</h2>{'<p>More.' * i}<p>Text of page {i}</div><div class="comments"><p>reader {i} says hi</p></div>
      <div class=page-footer>&copy; 2020</div></body></html>""" for i in range(4)]
    assert texts(spark, made) == [f"Title {i} {'More. ' * i}Text of page {i}" for i in range(4)]
    plain = [re.sub(" class=story", "", x) for x in made]
    assert texts(spark, plain, "http://b.org") == [f"Title {i} {'More. ' * i}Text of page {i}" for i in range(4)]


def test_awkward_pages(spark):
    deep = "<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "after</article>no"
    long = "<article>" + "<p>a</p><ul><li>x</ul><h2>q</h2>" * 4000 + "</article>"
    made = [None, "", "plain &lt;b", "a < b <i>c</i>d <!-- x", deep, long, long]
    got = texts(spark, made, None)
    assert got[:2] == ["", ""] and got[2] == "plain <b" and got[3] == "a < b cd" and got[4] == "deep after"
    assert got[5] == got[6] == " ".join(["a x q"] * 4000)


def test_wrappers_of_a_host_on_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(op13_wrappers, "MERGE", 3)
    made = [f"<nav><a href=x>n{i}</a></nav><article><h1>h{i}</h1>{'<p>p</p>' * (i % 5)}{'<ul><li>z</ul>' if i % 3 else ''}</article>" for i in range(40)]
    df = pages(spark, made).repartition(20)
    got = {r["page_id"]: r["text"] for r in op13_wrappers.extract(df).collect()}
    assert got == {i: " ".join([f"h{i}"] + ["p"] * (i % 5) + ["z"] * (i % 3 > 0)) for i in range(40)}
    assert op13_wrappers.wrappers(df.withColumn("host", F.lit("h")), Scratch(spark, "t")).count() == 1


def test_mismatches_become_optional_repeated_or_slots():
    a, b = (op13_wrappers.wrap(op13_wrappers.read(x)) for x in ("<h1>A</h1><p>x<p>y", "<h1>B</h1><hr><p>x<p>y<p>z<ul><li>k</ul>"))
    assert op13_wrappers.text_of(op13_wrappers.merged(a, b)) == "<page>[<h1>[#text] (<p>[#text]?)+ (<ul>[<li>[#same]])?]"

"""Main text of web pages by inferred wrappers (union-free regular expressions).

A page is read into blocks (elements that aren't inline) and text runs. A
host's pages are aligned one after another into one wrapper, a tree of
elements whose content is a sequence of units: an element or a text slot, once
or optional, or a repeated group of them. Two contents that differ are aligned
from both ends; in the stretch where they don't agree, what recurs becomes a
repeated group (also with the equal units next to it), what one of them lacks
becomes optional, and different texts in one place become a slot. No unions:
every unit has one alternative.

Wrappers can be merged, so each task aligns its own pages and sends one
wrapper a host; these are merged in rounds of at most ``MERGE``, and a host
with a third of all pages is aligned by all tasks. A wrapper's size follows
the host's templates: contents of more than ``LONG`` units are folded at once.

Each text slot of the wrapper gets a part. Slots in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments (by
element, role, class or id) have none. The others rank: in an article; else in
a main element, or one named as content; else in the smallest element that
holds most of the host's plain text, link text counted against it. A page is
matched against its host's wrapper from left to right, and gives the texts of
the best rank that it has, in page order.

Text: character references are decoded once, white space in a block becomes
one space, blocks are trimmed and joined by one space; ``br`` and block
elements end a block, inline elements don't.

Defined cases: null or empty html gives an empty text; a null url, or one
without a host, belongs to the host of empty name; html without an element is
one block; elements may be unclosed or closed in any order; elements deeper
than ``DEEP`` are read as content of the last level; repeated pages count
again in a slot's figures. Only page_id, url and html are read, further columns of any
name don't matter. An empty table gives no rows. A wrapper may depend on the
order of its pages; whether a slot lies in an article or a main element doesn't.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, ascii_lower, table

DEEP = 60
LONG = 64
MERGE = 32
HOSTS = 2000  # hosts whose wrappers one task holds before it sends them on

# Elements by HTML: inline ones, those without content, those whose content is
# no markup, and which open element a start tag closes.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var img wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe noframes template".split())
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}} | {b: {"p"} for b in BLOCKS}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "aside", "nav", "footer", "header", "form",
         "blockquote", "td", "th"}

PARAGRAPHS = set("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote td th tr tbody ul ol dl figcaption caption address summary".split())

# What isn't main text, by element and by the words of role, class and id.
NOISE = set("head nav aside footer form script style noscript template button select textarea input iframe object svg canvas "
            "dialog menu title datalist audio video map xmp noframes".split())
NOISE_WORDS = set("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
                  "commentlist complementary consent contentinfo cookie cookies disclaimer disqus dialog footer form gdpr "
                  "masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination "
                  "paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
                  "signup skyscraper social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets "
                  "alert alertdialog tooltip toc login reviews outbrain taboola".split())
SITE_HEADER = {"header", "banner", "masthead"}
CONTENT_WORDS = set("article articlebody story post entry content maincontent main body text".split())
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
STATE = re.compile(r"(?i)(?:no|has|have|with|without|is|show|hide|hidden)[-_]")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTR = re.compile(r"""(?:^|[\s"'/])(role|class|id|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def labels(attrs: str) -> tuple[str, ...]:
    """Words of role, class, id and itemprop, sorted; digits don't count."""
    if "=" not in attrs:
        return ()
    out = set()
    for m in ATTR.finditer(attrs):
        value = html.unescape(m[2] or m[3] or m[4] or "")
        for name in value.split():
            if STATE.match(name):
                continue  # says what a part has, not what it is
            parts = NAME.findall(CAMEL.sub("-", name).lower())
            out.update(parts)
            out.add("".join(parts))
    return tuple(sorted(out - {""}))


def noise(tag: str, words: tuple[str, ...], inside: bool) -> bool:
    """Whether an element holds no main text. ``inside``: of an article."""
    if tag in NOISE or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main"):
        return any(w in ("comment", "comments", "reply", "sidebar", "ad", "advert") for w in words) if tag in ("article", "main") else False
    if inside and SITE_HEADER & set(words):
        words = tuple(w for w in words if w not in SITE_HEADER)
    return any(w in NOISE_WORDS or w in SITE_HEADER for w in words)


# --- pages ----------------------------------------------------------------
# An element is [key, content]; a text is [chars, link chars, text]. A key is
# (tag, labels).

TEXT = ("#", ())


def read(source: str):
    """The page's tree, of blocks and texts."""
    root = [("", ()), []]
    stack = [(root, 0)]
    links, run, linked = 0, [], 0
    skip = None

    def flush():
        nonlocal run, linked
        if run:
            t = " ".join("".join(run).split())
            if t:
                stack[-1][0][1].append([len(t), min(linked, len(t)), t])
            run, linked = [], 0

    def add(raw):
        nonlocal linked
        if raw:
            t = html.unescape(raw)
            run.append(t)
            if links:
                linked += len(t)

    def pop(depth):
        nonlocal links
        flush()
        while len(stack) > depth:
            _, links = stack.pop()

    at, over = 0, {}
    for m in TAG.finditer(source):
        if m.start() < at:
            continue  # inside raw content
        add(source[at:m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            if tag in INLINE:
                if tag == "a" and links:
                    links -= 1
                own = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0][0][0] == tag), None)
                if own and stack[own][0][0][1] and own == len(stack) - 1:
                    pop(own)  # an inline element that is kept apart
                continue
            if tag == "br" or tag == "p" and not any(s[0][0][0] == "p" for s in stack):
                flush()
                continue
            if over.get(tag):
                over[tag] -= 1
                flush()
                continue
            own = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0][0][0] == tag), None)
            if own:
                pop(own)
            continue
        closed = m[3].endswith("/") and tag in ("svg", "path")
        if tag in RAW:
            flush()
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        words = labels(m[3])
        if tag in INLINE:
            if tag == "a":
                links += 1
            if tag in EMPTY or not words or not noise(tag, words, True):
                continue
        flush()
        if tag in EMPTY:
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0][0][0]
                if open_tag in CLOSES[tag]:
                    pop(i)
                    if tag not in ("tbody", "tfoot", "thead", "tr"):
                        break
                elif open_tag in SCOPE:
                    break
        if closed:
            continue
        if len(stack) > DEEP:
            over[tag] = over.get(tag, 0) + 1
            continue
        node = [(tag, words), []]
        stack[-1][0][1].append(node)
        stack.append((node, links))
    add(source[at:])
    flush()
    return root


# --- wrappers -------------------------------------------------------------
# A unit is a dict: key, keys (of all members), opt, and for an element body
# (units), for a text n, chars, linked and same (the text while all are
# equal, else None), for a repeated group members (units of different keys).


def wrap(node):
    """A page's own wrapper."""
    if len(node) == 3:
        return {"key": TEXT, "keys": {TEXT}, "opt": False, "n": 1, "chars": node[0], "linked": node[1], "same": hash_of(node[2])}
    body = [wrap(x) for x in node[1]]
    return {"key": node[0], "keys": {node[0]}, "opt": False, "body": folded(body) if len(body) > LONG else body}


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def merged(a, b):
    """Both units in one place."""
    opt = a["opt"] or b["opt"]
    if "members" in a or "members" in b or a["key"] != b["key"]:
        return group([a, b], opt)
    if "body" in a:
        return {"key": a["key"], "keys": a["keys"], "opt": opt, "body": aligned(a["body"], b["body"])}
    return {"key": TEXT, "keys": a["keys"], "opt": opt, "n": a["n"] + b["n"], "chars": a["chars"] + b["chars"],
            "linked": a["linked"] + b["linked"], "same": a["same"] if a["same"] == b["same"] else None}


def group(units, opt: bool = False):
    """A repeated group; members are optional in it."""
    members: dict = {}
    for u in units:
        for x in u.get("members") or [u]:
            members[x["key"]] = merged(members[x["key"]], x) if x["key"] in members else x | {"opt": False}
    return {"key": next(iter(members)), "keys": set(members), "opt": opt, "members": list(members.values())}


def folded(units):
    """Units without a key in two of them: what recurs becomes a group."""
    out: list = []
    for u in units:
        hit = next((i for i, x in enumerate(out) if x["keys"] & u["keys"]), None)
        if hit is None:
            out.append(u)
        else:
            out[hit:] = [group([*out[hit:], u], all(x["opt"] for x in [*out[hit:], u]))]
    return out


def aligned(a, b):
    """One content for both."""
    n, p, s = min(len(a), len(b)), 0, 0
    while p < n and a[p]["keys"] == b[p]["keys"] and ("members" in a[p]) == ("members" in b[p]):
        p += 1
    if p == len(a) == len(b):
        return [merged(x, y) for x, y in zip(a, b)]
    while s < n - p and a[-1 - s]["keys"] == b[-1 - s]["keys"] and ("members" in a[-1 - s]) == ("members" in b[-1 - s]):
        s += 1
    seen = set().union(*[u["keys"] for u in a[p:len(a) - s] + b[p:len(b) - s]])
    while p and a[p - 1]["keys"] & seen:
        p -= 1
        seen |= a[p]["keys"]
    while s and a[-s]["keys"] & seen:
        s -= 1
        seen |= a[-1 - s]["keys"]
    out = folded(a[p:len(a) - s])
    met = [False] * len(out)
    at = 0
    for u in folded(b[p:len(b) - s]):
        hits = [i for i, x in enumerate(out) if x["keys"] & u["keys"]]
        if not hits:
            out.insert(at, u | {"opt": True})
            met.insert(at, True)
            at += 1
        elif len(hits) == 1 and hits[0] >= at:
            i = hits[0]
            out[i], met[i] = merged(out[i], u), True
            at = i + 1
        else:
            lo, hi = min([*hits, at - 1 if at else 0]), max([*hits, at - 1])
            out[lo:hi + 1] = [group([*out[lo:hi + 1], u])]
            met[lo:hi + 1] = [True]
            at = lo + 1
    middle = [u if seen_too else u | {"opt": True} for u, seen_too in zip(out, met)]
    return ([merged(x, y) for x, y in zip(a[:p], b[:p])] + middle
            + [merged(x, y) for x, y in zip(a[len(a) - s:], b[len(b) - s:])])


def text_of(wrapper) -> str:
    """The wrapper as an expression (for people)."""
    def one(u):
        if "members" in u:
            s = "(" + " ".join(one(x) + "?" for x in u["members"]) + ")+"
        elif "body" in u:
            s = "<" + ".".join([u["key"][0] or "page", *u["key"][1]]) + ">[" + " ".join(map(one, u["body"])) + "]"
        else:
            s = "#text" if u["same"] is None else "#same"
        return f"({s})?" if u["opt"] else s

    return one(wrapper)


# --- parts of the slots ---------------------------------------------------


def has_article(u) -> bool:
    return "body" in u and u["key"][0] in ("article", "main") and not noise(*u["key"], True) or any(
        has_article(x) for x in u.get("members") or u.get("body") or ())


def rank_slots(wrapper) -> dict[int, int]:
    """Rank by slot (id of its unit): 1 article, 2 main or content, 3 most of
    the plain text, 4 none of these. Slots without a part are missing."""
    ranks = slots(wrapper, False)
    if 1 not in ranks.values() and has_article(wrapper):
        ranks = slots(wrapper, True)  # the article lies in what looked like noise
    return ranks


def slots(wrapper, lenient: bool) -> dict[int, int]:
    ranks: dict[int, int] = {}
    plain: list = []  # (container, plain chars), children before parents

    def dull(u):
        return 2 * u["linked"] > u["chars"] or (u["same"] is not None and u["n"] > 2)

    def walk(u, rank, inside):
        if "members" in u:
            return sum([walk(x, rank, inside) for x in u["members"]])
        if "body" not in u:
            ranks[id(u)] = rank
            return 0 if dull(u) else u["chars"] - 2 * u["linked"]
        tag, words = u["key"]
        if noise(tag, words, inside) and not (lenient and (tag == "form" or tag not in NOISE) and has_article(u)):
            return 0
        if tag == "article" or "articlebody" in words:
            rank, inside = 1, True
        elif rank != 1 and (tag == "main" or tag not in ("html", "body") and CONTENT_WORDS & set(words)):
            rank = 2
        total = sum([walk(x, rank, inside) for x in u["body"]])
        if tag not in PARAGRAPHS:
            plain.append((u, total))
        return total

    walk(wrapper, 4, False)
    if not {1, 2} & set(ranks.values()):
        whole = plain[-1][1]
        best = next((u for u, n in plain if 2 * n > whole), plain[-1][0])

        def mark(u):
            for x in u.get("members") or u.get("body") or ():
                mark(x)
            if id(u) in ranks and not dull(u):
                ranks[id(u)] = 3

        mark(best)
    return ranks


def compact(u, ranks: dict[int, int]):
    """What matching needs: a slot's rank (0: no part), an element's (key,
    content), a group's list of those."""
    if "members" in u:
        return [(x["key"], compact(x, ranks)) for x in u["members"]]
    if "body" in u:
        return tuple([y if isinstance(y := compact(x, ranks), list) else (x["key"], y) for x in u["body"]])
    return ranks.get(id(u), 0)


def best_texts(page, content) -> list[str]:
    """The page matched against its wrapper's ``content`` (see ``compact``):
    the texts of its best rank."""
    found: dict[int, list[str]] = {}

    def match(node, units):
        at = 0
        keys = [[k for k, _ in u] if isinstance(u, list) else [u[0]] for u in units]
        for child in node[1]:
            key = TEXT if len(child) == 3 else child[0]
            i = next((j for j in [*range(at, len(units)), *range(at)] if key in keys[j]), None)
            if i is None:
                continue
            u = units[i]
            at = i if isinstance(u, list) else i + 1
            part = dict(u)[key] if isinstance(u, list) else u[1]
            if len(child) == 3:
                if part:
                    found.setdefault(part, []).append(child[2])
            else:
                match(child, part)

    match(page, content)
    return found[min(found)] if found else []


# --- on Spark -------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The url's host, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


PART = "host string, part long, wrapper binary"


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper) of ``pages`` (host, html)."""
    def align(batches):
        from pyspark import TaskContext

        part, held, sent = TaskContext.get().partitionId(), {}, 0

        def send():
            return pa.RecordBatch.from_pydict({
                "host": pa.array(list(held), pa.string()), "part": pa.array([part * 1009 + sent] * len(held), pa.int64()),
                "wrapper": pa.array([pickle.dumps(w) for w in held.values()], pa.binary())})

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = wrap(read(source or ""))
                held[host] = merged(held[host], own) if host in held else own
                if len(held) >= HOSTS:
                    yield send()
                    held, sent = {}, sent + 1
        if held:
            yield send()

    def join(t):
        out = None
        for x in t.sort_by("part").column("wrapper").to_pylist():
            w = pickle.loads(x)
            out = w if out is None else merged(out, w)
        return pa.table({"host": t.column("host").slice(0, 1), "part": pa.array([t.column("at")[0].as_py()], pa.int64()),
                         "wrapper": pa.array([pickle.dumps(out)], pa.binary())})

    parts = scratch.write(pages.select("host", "html").mapInArrow(align, PART), "parts")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        at = F.lit(0) if most <= MERGE else F.pmod(F.xxhash64("part"), F.lit(-(-most // (MERGE // 2))))
        parts = scratch.write(parts.withColumn("at", at.cast("long")).groupBy("host", "at").applyInArrow(join, PART), "merged")
    return parts.select("host", "wrapper")


def contents(batches):
    """Wrappers as what matching needs."""
    for b in batches:
        out = []
        for raw in b.column(1).to_pylist():
            w = pickle.loads(raw)
            out.append(zlib.compress(pickle.dumps(compact(w, rank_slots(w)))))
        yield pa.RecordBatch.from_pydict({"h": b.column(0), "content": pa.array(out, pa.binary())})


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url and ``text``, the main text of ``html``."""
    scratch = scratch or Scratch(pages.sparkSession, "wrappers")
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = scratch.write(wrappers(named, scratch).mapInArrow(contents, "h string, content binary"), "contents")
    joined = named.join(found, F.col("host") == F.col("h")).select("page_id", "url", "html", "host", "content")
    ids = joined.schema["page_id"].dataType.simpleString()

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = []
            for host, source, raw in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "content")]):
                if host not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[host] = pickle.loads(zlib.decompress(raw))
                texts.append(" ".join(best_texts(read(source or ""), known[host])))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})

    return joined.mapInArrow(run, f"page_id {ids}, url string, text string")


def op13_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op13_wrappers": op13_wrappers}
ORACLES: dict[str, str] = {}

"""URL filters with redirect equivalence.

Rules name a host (with its subdomains) and a path prefix; the longest rule
that fits a page's URL decides: the longer host first, then the longer path.
Pages that no rule fits get the method's verdict: aliases share decisions.

Nodes are URLs in a plain form (without scheme, default port, fragment and
tracking parameters; host lower-cased). Edges join a page to the target of its
meta refresh and of its canonical link. Connected components of these edges
are found by Spark; a component in which a rule allows some page is allowed
(explicit allow has precedence), else one with a blocked page is blocked, and
pages of no such component are allowed.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is allowed; null or empty html has no edges; repeated rows are
judged each; ties between rules of equal length go to allow; an empty table
gives an empty result; extra columns pass through under any name but an
output's, which raises ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, ascii_lower, given, packed, table
from vendorlytics.llm.components import components

# The rules of the registered query: (verdict, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
TRACKING = r"(?<=[?&])(?:utm_[^=&#]*|fbclid|gclid)(?:=[^&#]*)?&?"
ADDED = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    first = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2]), r[0] != "allow"))
    rule = verdict = None
    for kind, h, p in first:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def plain(url: Column) -> Column:
    """The URL without what doesn't change the page; null if it isn't one."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), TRACKING, ""), r"[?&]$", "")
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    return F.when((F.instr(url, "://") > 0) & (host != ""), F.concat(host, F.when(rest == "", "/").otherwise(rest)))


def resolved(base: Column, target: Column) -> Column:
    """An absolute URL from a link's target."""
    t = F.regexp_replace(F.trim(target), "&amp;", "&")
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (F.when(t == "", None)
             .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)"), None)
             .when(t.contains("://"), t)
             .when(t.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), t))
             .when(t.startswith("/"), F.concat(origin, t))
             .otherwise(F.concat(F.when(folder.endswith("/") & (F.length(folder) > F.length(origin)), folder).otherwise(F.concat(origin, F.lit("/"))), t)))


# A tag of any length up to its end, then its attributes in the tag alone.
TAGS = r"(?i)<(?:link|meta)\b[^>]*"
CANONICAL, HREF = r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH, TO = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): plain URLs of a page and of what it redirects or points to, by
    all its link and meta tags."""
    # only the pages with such a tag are searched for its attributes
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    link = F.when(tag.rlike(r"(?i)^<link") & tag.rlike(CANONICAL), F.regexp_extract(tag, HREF, 1)) \
        .when(tag.rlike(r"(?i)^<meta") & tag.rlike(REFRESH), F.regexp_extract(tag, TO, 1))
    out = tags.select("url", link.alias("to")).where("to <> ''")
    return out.select(plain(F.col("url")).alias("a"), plain(resolved(F.col("url"), F.col("to"))).alias("b")).where("a <> b")


def node(c: str) -> Column:
    return F.xxhash64(F.col(c))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    clash = set(ADDED) & set(pages.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    scratch = Scratch(pages.sparkSession, "urls")
    edges = scratch.write(alias_edges(pages).distinct(), "edges")
    rule, explicit = rule_for(F.col("host"), F.col("path"), rules)
    out = (packed(pages, host=host_of(F.col("url")), path=path_of(F.col("url")), node=node_of("url"))
           .withColumn("rule", rule).withColumn("own", explicit))
    # decisions reach aliases through the component; rows by node come first,
    # so a URL that a third of all pages share is one row here. A node that
    # only links point to is judged by its own URL too.
    roots = components(edges.select(node("a").alias("u"), node("b").alias("v")), scratch)
    known = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("plain"))
    known = known.withColumn("host", F.regexp_extract("plain", r"^[^/?#]*", 0)).withColumn("path", F.regexp_extract("plain", r"^[^/?#]*([^?#]*)", 1))
    _, theirs = rule_for(F.col("host"), F.col("path"), rules)
    votes = known.select(node("plain").alias("id"), theirs.alias("said")).where("said is not null")
    said = votes.join(roots, "id").groupBy("root").agg(F.min("said").alias("said"))  # allow comes before block
    shared = scratch.write(roots.join(said, "root").select(F.col("id").alias("node"), "said"), "shared")
    if shared.isEmpty():
        out = out.withColumn("said", F.lit(None).cast("string"))
    else:
        out = out.join(shared, "node", "left")
    return out.select(*given(pages), "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"))


def node_of(url: str) -> Column:
    p = plain(F.col(url))
    return F.when(p.isNotNull(), F.xxhash64(p))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", *ADDED)


QUERIES = {"op3_urls": op3_urls}

# Rules, hosts and paths; pages with canonical links or refreshes are joined
# to their targets by a recursive walk.
ORACLES = {"op3_urls": r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), raw AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest
  FROM pages
), links AS (
  SELECT *, regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS target FROM raw
), plain AS (
  SELECT page_id, host, path,
         host || regexp_replace(regexp_replace(regexp_replace(rest, '([?&])utm_[^=&]*=[^&]*&?', '\1', 'g'), '[?&]$', ''), '^$', '/') AS a,
         CASE WHEN target LIKE '%://%' THEN regexp_replace(target, '^.*?://', '') WHEN target LIKE '/%' THEN host || target END AS b
  FROM links
), edge AS (
  SELECT a, b FROM plain WHERE b <> a UNION SELECT b, a FROM plain WHERE b <> a
), reach(a, b) AS (
  SELECT a, a FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
), judged AS (
  SELECT n.a, (SELECT verdict FROM rules WHERE (split_part(n.a, '/', 1) = h OR split_part(n.a, '/', 1) LIKE '%.' || h)
                 AND starts_with(substr(n.a, length(split_part(n.a, '/', 1)) + 1), p)
               ORDER BY length(h) DESC, length(p) DESC LIMIT 1) AS verdict
  FROM (SELECT DISTINCT a FROM edge) n
), said AS (
  SELECT reach.a, min(verdict) AS verdict FROM reach JOIN judged ON judged.a = reach.b GROUP BY reach.a
), own AS (
  SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(verdict, length(h) * 1000 + length(p)) AS verdict
  FROM raw JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
)
SELECT plain.page_id, plain.host, plain.path, own.rule, coalesce(own.verdict, said.verdict, 'allow') AS verdict
FROM plain LEFT JOIN own USING (page_id) LEFT JOIN said USING (a)
"""}

"""Personal data: fixed patterns, and identifiers found by bootstrapping.

*Seeds.* E-mail addresses, IPv4 addresses, card numbers and phone numbers are
found by their patterns (leftmost, non-overlapping by kind, then checked).

*Bootstrapping.* Candidates are the words of a text that hold a digit or an @.
A candidate's instance is its word, A-Z lower-cased, without marks at the
ends; its patterns are the word before it and the word after it, each by
itself and apart from the candidate's shape. Documents are reduced to counts
of (pattern, instance). Seeds are the instances that overlap a seed span. Then
over this graph, in rounds:

    trust(pattern)   = sum(w * belief) / (sum(w) + 1), w = log(1 + count)
    belief(instance) = 1 for seeds, else the mean trust of its patterns,
                       weighted by how often each occurs, on the better side;
                       never less than in the round before

A pattern counts only if it holds ``SUPPORT`` different instances that are
seeds or were believed with ``CONFIDENT`` in an earlier round. The rounds end
when no pattern and no such instance is added. An instance with a belief of
``CONFIDENT`` or more, beside a pattern that is trusted as much, is an
identifier (kind ``id``); base spans stay as they are.

Everything runs as DataFrame expressions. Patterns have possessive forms and
a start that is tied to the run's start (or the last match's end), so a long
run of word characters costs linear time.

Defined cases: a null or empty text has no spans; offsets are code points, end
exclusive; rows with the same doc_id are judged each by its own text; an empty
table gives an empty result; a word that is only marks is no candidate. Words,
contexts and the space between them may have any length. Other columns pass
through under any name but ``base`` and ``spans``, which raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm.common import Scratch, ascii_lower, given, packed, table

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
# kind -> (pattern, condition on a match); kinds in the order of ties
KINDS = ["email", "ip", "card", "phone"]
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
# a word with a digit or an @, and the word before it if that has neither
CANDIDATE = r"(?<![^ \t-\r])(?:[^ \t-\r0-9@]++[ \t-\r]++)?+[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
FIRST_WORD = r"^[ \t-\r]*+[^ \t-\r]*+"  # with the space before it
AFTER = r"^[ \t-\r]++([^ \t-\r0-9@]++)$"
LONG = 64  # longer words are compared by their SHA-256

SUPPORT = 5
CONFIDENT = 0.8
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, pattern: str) -> Column:
    """[(start, end, match, after)] of all matches, in code points: the lengths
    of the gaps and matches before, summed in blocks of ``BLOCK``. ``after`` is
    the beginning of the text that follows."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,after:string>>")

    def found(matches):
        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(gaps, matches)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def next_word(gaps: Column, matches: Column, i: Column) -> Column:
    """The space and the word that follow a match, of any length: they lie in
    the gap ``i``, or go on in the match after it."""
    gap, more = F.get(gaps, i), F.coalesce(F.get(matches, i), F.lit(""))
    begun = F.regexp_extract(gap, FIRST_WORD, 0)
    return F.when(F.length(begun) < F.length(gap), begun).otherwise(F.regexp_extract(F.concat(gap, F.regexp_extract(more, FIRST_WORD, 0)), FIRST_WORD, 0))


def short(word: Column) -> Column:
    return F.when(F.length(word) <= LONG, word).otherwise(F.sha2(word.cast("binary"), 256))


def placed(gaps: Column, matches: Column) -> Column:
    n = F.size(matches)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def width(lo, size):
        return (F.aggregate(F.slice(gaps, lo + 1, size), F.lit(0), lambda a, g: a + F.length(g))
                + F.aggregate(F.slice(matches, lo + 1, size), F.lit(0), lambda a, m: a + F.length(m)))

    def block(b, before):
        lo = b * BLOCK

        def one(i):
            s = before + width(lo, i) + F.length(F.get(gaps, lo + i))
            m = F.get(matches, lo + i)
            return F.struct(s.cast("int").alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("match"), next_word(gaps, matches, lo + i + 1).alias("after"))

        return F.transform(F.sequence(F.lit(0), F.least(F.lit(BLOCK), n - lo) - 1), one)

    def all_blocks(totals):
        def before(b):
            return F.aggregate(F.slice(totals, F.lit(1), b), F.lit(0), lambda a, x: a + x)
        return F.flatten(F.transform(blocks, lambda b: let(before(b), lambda x: block(b, x))))

    return let(F.transform(blocks, lambda b: width(b * BLOCK, F.lit(BLOCK))), all_blocks)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Doubles every second digit from the right; the sum ends in 0."""
    n = F.length(number)
    figures = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, i, F.lit(1)).cast("int"))
    double = F.transform(figures, lambda d, i: F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(double, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_VALID)
    n = F.length(digits(match))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(False)
    return n.between(9, 15)


def base_spans(text: Column) -> Column:
    """[(start, order, kind, end)] of the fixed patterns, sorted."""
    def of(order: int, kind: str, pattern: str) -> Column:
        ok = F.filter(spans_of(text, pattern), lambda x: valid(kind, x["match"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[of(i, k, p) for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE)))]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


MARKS = r"""^[^\p{L}0-9+]+|[^\p{L}0-9]+$"""


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc, row, start, end, patterns, instance, seed
    (does it overlap a base span?)."""
    found = docs.where(F.col("text").rlike("[0-9@]")).select("doc", "row", "base", F.explode(spans_of(F.col("text"), CANDIDATE)).alias("c"))
    word = F.regexp_replace(F.col("c.match"), r"^[^ \t-\r0-9@]++[ \t-\r]++", "")
    found = found.withColumn("word", word).withColumn("before", F.substring("c.match", F.lit(1), F.length("c.match") - F.length("word")))
    bare = F.regexp_replace("word", MARKS, "")
    lead = F.length(F.regexp_extract("word", r"^[^\p{L}0-9+]*", 0))
    start = F.col("c.end") - F.length("word") + F.col("lead")
    found = (found.withColumn("bare", bare).withColumn("lead", lead)
                  .where(F.length("bare") > 0)
                  .withColumn("start", start).withColumn("end", start + F.length("bare")))

    def context(side: str, word) -> Column:
        letters = ascii_lower(F.regexp_replace(word, r"[^\p{L}]", ""))
        return F.when(letters != "", F.concat(F.lit(side), short(letters)))

    return found.select(
        "doc", "row", "start", "end",
        F.array_compact(F.array(context("<", "before"), context(">", F.regexp_extract("c.after", AFTER, 1)))).alias("patterns"), short(ascii_lower(F.col("bare"))).alias("instance"),
        F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))).alias("seed"))


def bootstrap(found: DataFrame, scratch: Scratch, support: int = SUPPORT, confident: float = CONFIDENT):
    """(pattern, trust) and (instance, belief) after the rounds."""
    graph = scratch.write(found.select("instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(
        F.count("*").alias("w")), "graph")
    seeds = found.groupBy("instance").agg(F.count("*").alias("all"), F.sum(F.col("seed").cast("long")).alias("seeded"))
    belief = scratch.write(seeds.select("instance", F.when(F.col("seeded") * 2 >= F.col("all"), 1.0).otherwise(0.0).alias("belief")), "belief")
    sure = F.col("belief") >= confident
    held, state = graph.join(belief, "instance"), None
    while True:
        weight = F.log1p("w")
        rated = held.groupBy("pattern").agg(
            F.sum(weight * F.col("belief")).alias("b"), F.sum(weight).alias("a"), F.sum(sure.cast("long")).alias("k"))
        trust = scratch.write(rated.where(F.col("k") >= support).select("pattern", (F.col("b") / (F.col("a") + 1)).alias("trust")), "trust")

        def mean(side: str) -> Column:
            w = F.when(F.col("pattern").startswith(side), F.col("w"))
            return F.coalesce(F.sum(w * F.coalesce("trust", F.lit(0.0))) / F.sum(w), F.lit(0.0))

        heard = graph.join(trust, "pattern", "left").groupBy("instance").agg(F.greatest(mean("<"), mean(">")).alias("now"))
        belief = scratch.write(belief.join(heard, "instance", "left").select("instance", F.greatest("belief", F.coalesce("now", F.lit(0.0))).alias("belief")), "belief")
        # neither number falls, as no belief does
        before, state = state, (trust.count(), belief.where(sure).count())
        if state == before:
            return trust, belief
        held = graph.join(belief, "instance")


def find_pii(docs: DataFrame, text: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, order, kind, end)."""
    clash = {"base", "spans"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    scratch = Scratch(docs.sparkSession, "pii")
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    marked = keyed.withColumn("base", base_spans(F.col("text")))
    found = scratch.write(candidates(marked), "candidates")
    trust, belief = bootstrap(found, scratch, confident=confident)
    sure = (found.where("not seed").withColumn("pattern", F.explode("patterns"))
                 .join(trust.where(F.col("trust") >= confident).select("pattern"), "pattern", "left_semi")
                 .join(belief.where(F.col("belief") >= confident).select("instance"), "instance", "left_semi"))
    extra = sure.groupBy("doc", "row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("order"), F.lit("id").alias("kind"), "end")).alias("extra"))
    extra = scratch.write(extra, "extra").withColumnRenamed("doc", "of_doc").withColumnRenamed("row", "of_row")
    own = packed(docs, doc="doc_id", row=F.xxhash64(text), base=base_spans(F.coalesce(text, F.lit(""))))
    out = own.join(extra, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left")
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return out.select(*given(docs), "base", every.alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(k) for k in KINDS]
    return out.select("doc_id", *count, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                      (F.size("spans") - F.size("base")).cast("long").alias("n_found"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}

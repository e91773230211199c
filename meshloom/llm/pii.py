"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal the entities they find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality import bound

#: Kinds in order, the last added by the method.
KINDS = ("email", "ip", "card", "phone", "term")
#: Base patterns. Possessive runs and look-behinds give the plain patterns' leftmost matches in linear time; for cards,
#: runs of 12 to 19 digits are picked at once, since every run of digits and single separators is one match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A term: a run of letters, marks and digits.
TERM = r"[\p{L}\p{M}\p{N}]+"
#: A term discloses an entity if their pointwise mutual information, discounted for small counts, is at least DISCLOSE of the
#: entity's information content. At a half, a term needs three documents with the entity, even where it is in no others.
DISCLOSE = 0.5
#: Terms in over a COMMON-th of the documents that can't disclose anything are dropped by a broadcast, before any shuffle.
COMMON = 1000
#: Terms that are broadcast; more are joined by a shuffle.
FEW = 1_000_000
#: Matches and spans handled between two copies of what has been built so far.
BLOCK = 256

_SPAN = "array<struct<s:int,e:int,v:string>>"


def _blocks(n: Column) -> Column:
    """0, 1, ...: the blocks of n entries, one at least."""
    return F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / BLOCK), F.lit(0)).cast("int"))


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches of pattern as (s, e, v): code-point offsets, end exclusive, and the text matched; only those that keep takes.

    The stretches between matches give the offsets as running lengths.
    """
    more = lambda o, y: F.concat(o, F.array(F.struct(y["b"].alias("s"), (y["b"] + F.length(y["w"])).alias("e"), y["w"].alias("v"))))
    step = lambda x: lambda a, i: bound(
        F.struct((a["p"] + F.length(F.get(x["g"], i))).alias("b"), F.get(x["m"], i).alias("w")),
        lambda y: F.struct((y["b"] + F.length(y["w"])).alias("p"), (F.when(keep(y["w"]), more(a["o"], y)).otherwise(a["o"]) if keep else more(a["o"], y)).alias("o")),
    )
    none = F.array().cast(_SPAN)
    part = lambda x: lambda a, k: bound(
        F.aggregate(F.sequence(k * BLOCK, F.least(k * BLOCK + (BLOCK - 1), F.size(x["m"]) - 1)), F.struct(a["p"].alias("p"), none.alias("o")), step(x)),
        lambda r: F.struct(r["p"].alias("p"), F.concat(a["o"], r["o"]).alias("o")),
    )
    walk = lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(
        F.aggregate(_blocks(F.size(x["m"])), F.struct(F.lit(0).alias("p"), none.alias("o")), part(x), lambda a: a["o"])
    )
    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), walk)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the check sum."""
    r = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.length(x)),
        F.lit(0),
        lambda s, i: s + bound(F.substring(x, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return bound(F.reverse(digits), r) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base patterns in order: (s, k, e, v) with k the kind's place and v its normal form."""

    def kind(k: int, found: Column, ok: Callable[[Column], Column], form: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(found, lambda x: ok(x["v"])), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.concat(F.lit(f"{KINDS[k]}:"), form(x["v"])).alias("v")))

    none = F.array().cast(_SPAN)
    if_has = lambda c, p: F.when(text.contains(c), located(text, p)).otherwise(none)
    small = lambda v: F.forall(F.split(v, "[.]"), lambda p: bound(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (q.substr(1, 3).cast("int") <= 255)))
    long = lambda v: bound(F.length(_digits(v)), lambda n: (n >= 9) & (n <= 15))
    all_of = F.concat(
        kind(0, if_has("@", EMAIL), lambda v: F.lit(True), F.lower),
        kind(1, if_has(".", IP), small, lambda v: v),
        kind(2, located(text, CARD), lambda v: luhn(_digits(v)), _digits),
        kind(3, if_has("+", PHONE), long, _digits),
    )
    return F.array_sort(all_of)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(found: DataFrame, docs: DataFrame, disclose: float = DISCLOSE) -> DataFrame:
    """(uid, terms): per row of found the terms that reveal one of its entities, by document counts over the whole corpus.

    With N documents, PMI(v; t) = log2(N * n(v, t) / (n(v) * n(t))) and IC(v) = log2(N / n(v)); t discloses v if
    PMI * n(v, t) / (n(v, t) + 1) * m / (m + 1) >= disclose * IC(v), m the smaller of n(v) and n(t). The factors shrink what few
    documents say: all rare words of a document meet its entity once, and in a copy of it twice, related to it or not. So
    counts with which no term or entity could reach the threshold are left out first, whatever their PMI.

    Terms anywhere in the text count. As n(v, t) <= n(v), only terms with n(t) <= n(v) * (N / n(v)) ** (1 - disclose) can
    disclose v; pairs of others aren't formed. Entities in the same documents have the same counts with every term, so they
    are one class. All counts are partially aggregated by task.
    """
    n = float(found.count())
    some = found.filter(F.size("base") > 0)
    # a count of c alone allows a factor of (c / (c + 1)) squared at most
    enough = lambda c: F.pow(c / (c + F.lit(1.0)), F.lit(2.0)) >= disclose
    held = some.select("uid", F.explode(F.array_distinct(F.transform("base", lambda b: b["v"]))).alias("v"))
    entities = held.groupBy("v").agg(F.count("*").alias("n_v"), F.bit_xor(F.xxhash64("uid")).alias("c1"), F.bit_xor(F.xxhash64(F.lit("again"), "uid")).alias("c2")).filter(enough(F.col("n_v")))
    classes = cut(held.join(entities, "v").select("uid", "n_v", "c1", "c2").distinct())
    bound_of = lambda n_v: n_v * F.pow(F.lit(n) / n_v, F.lit(1 - disclose)) * (1 + 1e-9)
    most = classes.agg(F.max(bound_of(F.col("n_v")))).first()[0] or 0.0
    counts = cut(_texts(docs).select(F.explode(_terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")))
    common = counts.filter(F.col("n_t") > max(most, n / COMMON)).select("t")
    rows = some.join(classes.select("uid").distinct(), "uid", "left_semi").select("uid", F.explode(_terms(F.col("text"))).alias("t"))
    common = cut(common)
    rows = rows.join(F.broadcast(common) if common.count() <= FEW else common, "t", "left_anti")
    rows = rows.join(counts.filter((F.col("n_t") <= most) & enough(F.col("n_t"))), "t").join(classes, "uid").filter(F.col("n_t") <= bound_of(F.col("n_v")))
    rows = cut(rows.select("uid", "t", "n_t", "n_v", "c1", "c2"))
    pairs = rows.groupBy("c1", "c2", "n_v", "t", "n_t").agg(F.count("*").alias("both"))
    content = F.log2(F.lit(n) / F.col("n_v"))
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("n_v") * F.col("n_t")))
    few = F.least("n_v", "n_t")
    score = pmi * F.col("both") / (F.col("both") + 1) * few / (few + 1)
    hit = pairs.filter((content > 0) & (score >= disclose * content)).select("c1", "c2", "n_v", "t")
    return rows.join(hit, ["c1", "c2", "n_v", "t"], "left_semi").groupBy("uid").agg(F.collect_set("t").alias("terms"))


def _found(docs: DataFrame, *keep: Column) -> DataFrame:
    """Rows with their base spans and, where there are any, their text."""
    base = _texts(docs).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return cut(base.select("doc_id", *keep, "base", F.when(F.size("base") > 0, F.col("text")).alias("text")).withColumn("uid", F.monotonically_increasing_id()))


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """Every occurrence of terms that overlaps no base span, as (s, k, e)."""
    every = located(text, TERM, lambda w: F.array_contains(terms, F.lower(w)))
    clear = F.filter(every, lambda c: ~F.exists(base, lambda b: (c["s"] < b["e"]) & (b["s"] < c["e"])))
    return F.transform(clear, lambda c: F.struct(c["s"].alias("s"), F.lit(4).alias("k"), c["e"].alias("e")))


def _spelled(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat(name(x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


_BARE = "array<struct<s:int,k:int,e:int>>"


def pii_spans(docs: DataFrame, **options) -> DataFrame:
    """Per row doc_id, counts of base kinds, base_sha256, spans, n_term, n_base (all base spans) and found (there is one).

    Base kinds are fixed patterns, leftmost and non-overlapping per kind, with matches that fail their check dropped. To
    these the method adds every occurrence, outside base spans, of a term that discloses an entity of the text (see
    `disclosing`). Spans read kind:start:end in code points, ordered by start and kind.

    Null and empty texts: no spans, the digest of an empty string. Long texts are searched whole. Repeated rows each count
    as a document and get equal results; null ids pass through; an empty table gives an empty one. Only doc_id and text are
    read. Time grows with the product of terms and disclosing terms only within a single document.
    """
    found = _found(docs)
    terms = disclosing(found, docs, **options)
    bare = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    none = F.array().cast(_BARE)
    near = found.filter(F.size("base") > 0).select("doc_id", "uid", "text", bare.alias("base")).join(terms, "uid", "left")
    near = near.select("doc_id", "base", F.when(F.col("terms").isNull(), none).otherwise(_term_spans(F.col("text"), F.col("base"), F.col("terms"))).alias("terms"))
    rows = found.filter(F.size("base") == 0).select("doc_id", bare.alias("base"), none.alias("terms")).union(near)
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"), F.size("base").cast("long").alias("n_base"), (F.size("base") > 0).alias("found"))


def _masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; spans that overlap the one before join it."""
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)
    start = lambda at: F.struct(F.lit("").alias("t"), at.alias("at"))

    def part(a: Column, k: Column) -> Column:
        own = lambda s: bound(F.substring(text, a["at"] + 1, F.greatest(F.array_max(F.transform(s, lambda x: x["e"])) - a["at"], F.lit(0))), lambda cut_out: inner(s, cut_out))
        inner = lambda s, cut_out: F.aggregate(
            s,
            start(a["at"]),
            lambda b, x: F.when(x["s"] >= b["at"], F.struct(F.concat(b["t"], F.substring(cut_out, b["at"] - a["at"] + 1, x["s"] - b["at"]), name(x["k"])).alias("t"), x["e"].alias("at"))).otherwise(
                F.struct(b["t"].alias("t"), F.greatest(b["at"], x["e"]).alias("at"))
            ),
        )
        return bound(bound(F.slice(spans, k * BLOCK + 1, F.lit(BLOCK)), own), lambda r: F.struct(F.concat(a["t"], r["t"]).alias("t"), r["at"].alias("at")))

    return F.aggregate(_blocks(F.size(spans)), start(F.lit(0)), part, lambda a: F.concat(a["t"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of pii_spans in text generalised to its kind in brackets; other columns stay, n_chars follows.

    Rows that share doc_id and text get equal texts. Null texts stay null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = _found(docs, F.xxhash64("text").alias("h"))
    terms = found.select("uid", "doc_id", "h").join(disclosing(found, docs, **options), "uid")
    terms = terms.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.first("terms").alias("terms"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("__doc"), text.alias("__text"))
    # only texts in which some base pattern occurs can have spans; the others pass by without a shuffle
    some = F.col("__text").contains("@") | F.col("__text").rlike(IP) | F.col("__text").rlike(CARD) | F.col("__text").rlike(PHONE)
    rest = named.filter(some).withColumn("__hash", F.xxhash64("__text"))
    rest = rest.join(terms.withColumnRenamed("terms", "__terms").hint("merge"), F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    bare = F.transform(base_spans(F.col("__text")), lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    added = lambda x: F.when(F.col("__terms").isNull(), F.array().cast(_BARE)).otherwise(_term_spans(F.col("__text"), x, F.col("__terms")))
    spans = bound(bare, lambda x: F.array_sort(F.concat(x, added(x))))
    new = F.when(F.col("d.text").isNull(), F.lit(None)).otherwise(bound(spans, lambda s: F.when(F.size(s) == 0, F.col("__text")).otherwise(_masked(F.col("__text"), s))))
    same = F.when(F.col("d.text").isNotNull(), F.col("__text"))
    named = rest.select("d", new.cast("string").alias("__new")).union(named.filter(~some).select("d", same.alias("__new")))
    each = {c: F.col(f"d.`{c}`").alias(c) for c in docs.columns}
    each["text"] = F.col("__new").alias("text")
    if "n_chars" in each:
        each["n_chars"] = F.length("__new").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return named.select(*each.values())

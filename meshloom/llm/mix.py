"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights given to sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def _offset(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes(key, source, source_size) -> the same with target: the source's words in the mix.

    Weighted shares of share * all words, each at most cap * source_size, the excess dealt anew by weight. That is
    min(cap * size, level * weight); level is read off prefix sums over sources ordered by cap * size / weight.
    A row per source, so these windows hold one small table. All sizes 0: targets 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("top") / F.col("w"), "pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("lv", level).withColumn("ok", F.col("lv") * F.col("w") <= F.col("top"))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("ok"), F.col("lv"))).over(every))
    return ranked.select("key", "source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("top")), F.col("top")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, size, key (the source, null apart), h (md5 of the id), cell, a digest m of the text, beside keep."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    # rows without an id are told apart by their text, so that they don't share a cell
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.xxhash64("text").cast("string"), F.lit("")))))
    return docs.select(*keep, "doc_id", "source", size.alias("size"), key.alias("key"), h.alias("h"), F.xxhash64("text").alias("m")).withColumn("cell", F.substring("h", 1, 2))


def _copies(rows: DataFrame, d: DataFrame, weights: tuple[int, ...], cap: float, share: float, seed: int) -> DataFrame:
    """rows (of _measured, with columns beside) with source_size, target and copies; d is what _measured gives for all rows."""
    cells = d.groupBy("key", "size", "cell").agg(F.count("*").alias("n"))
    steps = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    prior = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("key", "size", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("larger"))
    prior = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("key", "size", "cell", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("lower"))
    # sources are few beside documents; AQE broadcasts them if their measured size allows
    sizes = d.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap, share).withColumn("u", _offset(F.col("key"), seed))
    start = cells.join(steps, ["key", "size"]).join(targets.drop("source"), "key")
    inner = Window.partitionBy("key", "size", "cell").orderBy("h", "doc_id", "m")
    # the window and the join share one exchange; with the merge join that holds whatever the size
    out = rows.withColumn("row", F.row_number().over(inner)).join(start.hint("merge"), ["key", "size", "cell"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("larger") + F.col("lower") + F.col("row")
    return out.withColumn("copies", (F.floor(rate * upto + F.col("u")) - F.floor(rate * (upto - 1) + F.col("u"))).cast("long"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words. Within a source documents are ordered by size, largest first, then md5 of doc_id, then
    doc_id; each has target / source_size expected copies, and copies counts the integers that the prefix sum plus one
    offset per source crosses in its step. Ordering by size bounds |taken - target| by the largest document.

    The global rank is (smaller keys counted in histograms) + (row number in a (source, size, 2 hex digits) cell), so no
    window gathers a source, however hot. Null or empty text: size 0, copies still counted, taken 0. Null source: a source
    of its own, last. Repeated rows and rows that share an id: each row is a document, ranked next to its twin; null ids
    are ranked by a digest of their text. Empty table: empty. Only doc_id, text and source are read, other columns may
    have any name.
    """
    d = cut(_measured(docs))
    out = _copies(d, d, weights, cap, share, seed)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix itself: docs' own columns, each row as many times as mix_plan gives it copies.

    The row travels with its rank, so rows that share an id keep their own texts, and texts are shuffled once. Rows of equal
    source, size, id and text may differ in other columns; which of them gets a copy more is then arbitrary.
    """
    rows = _measured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    out = _copies(rows, cut(_measured(docs)), weights, cap, share, seed).filter("copies > 0")
    return out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select([F.col(f"d.`{c}`").alias(c) for c in docs.columns])

"""Driver tables seen as the engine's data model: fragments, points, words, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.operators import spatial, words

#: A total order over the line items of an order.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
EVENT_CHARS = {"click": "C", "error": "E", "purchase": "P", "signup": "S", "view": "V"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def part_fragments(spark, sf) -> DataFrame:
    """Orders as cells, line items as primitives, parts as objects."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("oid"))


def part_types(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("oid"), F.col("p_type").alias("type"))


def supplier_fragments(spark, sf) -> DataFrame:
    """Orders as cells, suppliers as objects: a small dense graph."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("oid"))


def shared_parts(spark, sf) -> DataFrame:
    """Parts as cells, suppliers as objects."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("oid"))


def supplier_types(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("oid"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("type"))


def points(spark, sf) -> DataFrame:
    """Line items as points of their supplier."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("oid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"), (F.col("l_tax") * 500).alias("z"), "l_orderkey")


def lines(spark, sf) -> DataFrame:
    """scene (order), rank, ch (return flag) and a point of each line item in total order."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scene"), rank.alias("rank"), F.col("l_returnflag").alias("ch"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("type"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"), (F.col("l_tax") * 500).alias("z")
    )


def order_words(spark, sf) -> DataFrame:
    """scene, word: root O and the order's line items as its children."""
    return words.encode_trees(lines(spark, sf).select("scene", "rank", "ch"))


def event_words(spark, sf) -> DataFrame:
    """scene (user), word: a character per event in order of time."""
    e = table(spark, sf, "events")
    ch = F.upper(F.substring("event_type", 1, 1))
    return e.groupBy(F.col("user_id").alias("scene")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", ch.alias("ch")))), lambda x: x["ch"]), "").alias("word"))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def part_graph(spark, sf) -> DataFrame:
    return spatial.collision_graph(part_fragments(spark, sf), part_types(spark, sf))


def supplier_edges(spark, sf) -> DataFrame:
    return spatial.symmetric(spatial.cell_pairs(supplier_fragments(spark, sf)))


def supplier_nodes(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))


def supplier_stats(spark, sf) -> DataFrame:
    """Suppliers as objects: centre, bounds, size, type and scene (nation)."""
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_nationkey").alias("scene"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("type"))
    return spatial.object_stats(points(spark, sf)).join(t, "oid")

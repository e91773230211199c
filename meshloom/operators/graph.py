"""Graph operators over node and edge(src, dst) frames. Edges hold both directions unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree with 0 for nodes without an edge (GR3, GR12)."""
    n = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


_PART = 33  # bits of a row's place in its partition in monotonically increasing ids


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with a dense number from 0 in the given total order, without a window over all rows.

    Rows are dealt by range and sorted within partitions; a row's number is its place there plus the rows of the partitions
    before, of which there is one count each.
    """
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    at = placed.withColumn("__p", F.shiftright("__m", _PART))
    sizes = at.groupBy("__p").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__m") - F.shiftleft(F.col("__p"), _PART)
    return at.join(F.broadcast(before), "__p").select(*[F.col(c) for c in df.columns], number.alias(name))


def csr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, begin, end: the interval of each node in the edge list sorted by (src, dst) (GR1, GR3).

    Running sums within ranges of nodes, plus the sums of the ranges before.
    """
    d = settle(degrees(nodes, edges).repartitionByRange("node").sortWithinPartitions("node").withColumn("p", F.spark_partition_id()))
    sums = d.groupBy("p").agg(F.sum("degree").alias("s"))
    before = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("p").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.withColumn("upto", F.sum("degree").over(w)).join(F.broadcast(before), "p").withColumn("end", F.col("before") + F.col("upto"))
    return out.select("node", (F.col("end") - F.col("degree")).alias("begin"), "end")


def to_matrix(edges: DataFrame, ids: list) -> DataFrame:
    """src and one 0/1 column per id: small graphs only, as the matrix is (GR2)."""
    return edges.groupBy("src").pivot("dst", ids).agg(F.lit(1)).na.fill(0)


def from_matrix(rows: DataFrame, ids: list) -> DataFrame:
    """src, dst of the non-zero entries (GR1)."""
    return rows.select("src", F.explode(F.array(*[F.struct(F.lit(i).alias("dst"), F.col(f"`{i}`").alias("v")) for i in ids])).alias("e")).filter("e.v <> 0").select("src", "e.dst")


def with_reverse(edges: DataFrame) -> DataFrame:
    """edge_id, src, dst, reverse_id (JN10); ids number the edges by (src, dst)."""
    e = settle(numbered(edges.select("src", "dst"), "src", "dst").select("src", "dst", (F.col("number") + 1).alias("edge_id")))
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("edge_id").alias("reverse_id"))
    return e.join(r, ["src", "dst"], "left").select("edge_id", "src", "dst", "reverse_id")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node reachable (GR5, GR6).

    Each round hooks labels onto the smallest neighbouring label and then jumps to the label's own label, so rounds grow
    with the logarithm of the diameter. Rounds end when no label changes.
    """
    pairs = settle(edges.select("src", "dst").filter("src <> dst").distinct())
    now = settle(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        seen = pairs.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label")
        # what a node's neighbours know, told to the node and to the label it has
        low = now.unionByName(seen).groupBy("node").agg(F.min("label").alias("low"))
        told = now.join(low, "node").select(F.col("label").alias("node"), "low").groupBy("node").agg(F.min("low").alias("told"))
        new = now.join(low, "node").join(told, "node", "left").select("node", F.least("low", F.coalesce("told", "low")).alias("next"), "label")
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        new = settle(new.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("next"), "label"))
        moved = new.filter("next <> label").limit(1).count()
        now = new.select("node", F.col("next").alias("label"))
        if not moved:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def bfs_levels(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """node, level of nodes reachable from seeds(node); stop(node) is never entered (GR8, GR9)."""
    seen = settle(seeds.select("node", F.lit(0).cast("long").alias("level")).distinct())
    front, level = seen, 0
    while limit is None or level < limit:
        level += 1
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        step = step.join(seen, "node", "left_anti")
        if stop is not None:
            step = step.join(stop, "node", "left_anti")
        front = settle(step.select("node", F.lit(level).cast("long").alias("level")))
        if not front.limit(1).count():
            break
        seen = settle(seen.unionByName(front)) if level % 8 == 0 else seen.unionByName(front)
    return seen


def augment_components(label: DataFrame) -> DataFrame:
    """src, dst: the fewest edges that join all components, a chain of their smallest nodes (GR10), numbered by ranges."""
    at = numbered(label.select(F.col("label").alias("dst")).distinct(), "dst")
    return at.join(at.select(F.col("dst").alias("src"), (F.col("number") + 1).alias("number")), "number").select("src", "dst")


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """source, node, dist, pred by Bellman-Ford relaxation over edges(src, dst, weight) (GR11); ties go to the smaller pred."""
    best = settle(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.lit(None).cast(sources.schema["node"].dataType).alias("pred")))
    front = best
    for _ in range(rounds):
        step = front.select("source", F.col("node").alias("src"), "dist").join(edges, "src").select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("pred"))
        step = step.groupBy("source", "node").agg(F.min(F.struct("dist", "pred")).alias("s")).select("source", "node", "s.dist", "s.pred")
        old = best.select("source", "node", F.col("dist").alias("old"))
        front = settle(step.join(old, ["source", "node"], "left").filter("old IS NULL OR dist < old").drop("old"))
        if not front.limit(1).count():
            break
        best = settle(best.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"paths did not settle in {rounds} rounds")
    return best


def stars(groups: DataFrame) -> DataFrame:
    """a, b: each member of a group (group, node) with the group's smallest node, so a group of any size costs a row per member."""
    low = groups.groupBy("group").agg(F.min("node").alias("a"))
    return groups.join(low, "group").filter("node <> a").select("a", F.col("node").alias("b"))


def latent_edges(word_pairs: DataFrame, knn: DataFrame) -> DataFrame:
    """a, b, weight: similar-word pairs weigh 0 unless a nearest-neighbour edge gives the pair a weight (GR13)."""
    u = word_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.0).alias("weight"), F.lit(0).alias("rank"))
    k = knn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").alias("weight"), F.lit(1).alias("rank"))
    return u.unionByName(k).filter("a <> b").groupBy("a", "b").agg(F.max(F.struct("rank", "weight"))["weight"].alias("weight"))


def border_flags(sample: DataFrame, edges: DataFrame) -> DataFrame:
    """sample_id, node, flag: 1 if a neighbour lies outside the sample, 2 if only touching such a node, else 0 (TK9). Flags come from one snapshot."""
    inside = sample.select("sample_id", "node")
    nb = inside.join(edges.select(F.col("src").alias("node"), "dst"), "node")
    own = inside.select("sample_id", F.col("node").alias("dst"), F.lit(True).alias("in"))
    border = nb.join(own, ["sample_id", "dst"], "left").groupBy("sample_id", "node").agg(F.max(F.col("in").isNull()).alias("border"))
    b = settle(inside.join(border, ["sample_id", "node"], "left").select("sample_id", "node", F.coalesce("border", F.lit(False)).alias("border")))
    near = nb.join(b.filter("border").select("sample_id", F.col("node").alias("dst")), ["sample_id", "dst"], "left_semi").select("sample_id", "node").distinct().withColumn("near", F.lit(True))
    return b.join(near, ["sample_id", "node"], "left").select("sample_id", "node", F.when(F.col("border"), 1).when(F.col("near"), 2).otherwise(0).alias("flag"))

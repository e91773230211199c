"""Spanning forests by votes: components hook on along one edge each, in rounds that follow the logarithm of their number (GR5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

#: Components whose new labels are broadcast to edges; of more, edges ask by a salted join, as one component may hold most edges.
LABELS, SALTS = 2_000_000, 32


def _relabelled(edges: DataFrame, side: str, label: DataFrame, few: bool) -> DataFrame:
    """edges with the component on one side replaced by label(c, root)."""
    if few:
        return edges.join(F.broadcast(label.select(F.col("c").alias(side), "root")), side).drop(side).withColumnRenamed("root", side)
    salted = label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("c", side)
    asked = edges.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
    return asked.join(salted, [side, "salt"]).drop(side, "salt").withColumnRenamed("root", side)


def _roots(hooks: DataFrame, rounds: int = 60) -> DataFrame:
    """hooks(c, to) -> c, root: where each component's hooks lead, by doubling. Two components that hook onto each other meet at the smaller."""
    back = hooks.select(F.col("c").alias("to"), F.col("to").alias("back"))
    at = settle(hooks.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")))
    for _ in range(rounds):
        # three jumps a round: where a component leads, where that leads, and where that does
        one, two = (at.select(F.col("c").alias(a), F.col("root").alias(b)) for a, b in (("root", "one"), ("one", "two")))
        new = settle(at.join(one, "root").join(two, "one").select("c", "root", "two"))
        moved = not new.filter("root <> two").isEmpty()
        at = new.select("c", F.col("two").alias("root"))
        if not moved:
            return at
    raise RuntimeError(f"hooks did not settle in {rounds} rounds")


def voted_forest(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(tree, label): tree(src, dst), src < dst, the edges of a spanning forest; label(node, root) of every node with an edge.

    Every round each component votes for its first edge, by (src, dst), that leads out of it; voted edges are marked, and
    components hook on along their votes. Edges are in one total order, so votes make no cycle, and no round leaves more than
    half of the components that still have an edge out: rounds grow with the logarithm of the nodes, not with the diameter.
    The forest is the one that taking edges in order, unless they close a cycle, would give. Edges within a component are
    dropped as soon as they are. Votes are partially aggregated, so a component of most edges is no hot key.

    edges: src, dst, either or both directions; loops and repeats don't count. An empty table gives empty ones.
    """
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    left = settle(e.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    nodes = settle(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
    tree, label = None, nodes.select("node", F.col("node").alias("root"))
    for _ in range(rounds):
        if left.isEmpty():
            break
        told = left.select(F.col("ca").alias("c"), F.struct("a", "b", F.col("cb").alias("to")).alias("v")).union(left.select(F.col("cb").alias("c"), F.struct("a", "b", F.col("ca").alias("to"))))
        votes = settle(told.groupBy("c").agg(F.min("v").alias("v")).select("c", "v.a", "v.b", "v.to"))
        new = votes.select("a", "b").distinct()
        tree = settle(new if tree is None else tree.union(new))
        root = _roots(votes.select("c", "to"))
        few = root.count() <= LABELS
        left = settle(_relabelled(_relabelled(left, "ca", root, few), "cb", root, few).filter("ca <> cb").select("a", "b", "ca", "cb"))
        label = settle(label.join(F.broadcast(root.withColumnRenamed("root", "next")) if few else root.withColumnRenamed("root", "next"), label["root"] == root["c"], "left").select("node", F.coalesce("next", "root").alias("root")))
    else:
        raise RuntimeError(f"components did not join in {rounds} rounds")
    tree = nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")) if tree is None else tree
    return tree.select(F.col("a").alias("src"), F.col("b").alias("dst")), label


def edge_kinds(edges: DataFrame) -> DataFrame:
    """src, dst (src < dst), kind: 1 for tree edges of the voted forest, 2 for edges that close a cycle (GR5, GR7)."""
    tree, _ = voted_forest(edges)
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return e.join(tree.withColumn("kind", F.lit(1)), ["src", "dst"], "left").select("src", "dst", F.coalesce("kind", F.lit(2)).alias("kind"))


def forest_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, n_nodes, n_tree, n_cycle by component (GR7): a forest has n_tree = n_nodes - 1. Nodes without an edge are components of their own."""
    tree, root = voted_forest(edges)
    label = settle(nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    low = label.groupBy("root").agg(F.min("node").alias("label"), F.count("*").alias("n_nodes"))
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    marked = e.join(tree.withColumn("tree", F.lit(True)), ["src", "dst"], "left").join(label, e["src"] == label["node"])
    n = marked.groupBy("root").agg(F.count("tree").alias("n_tree"), F.count(F.when(F.col("tree").isNull(), 1)).alias("n_cycle"))
    return low.join(n, "root", "left").select("label", "n_nodes", F.coalesce("n_tree", F.lit(0)).cast("long").alias("n_tree"), F.coalesce("n_cycle", F.lit(0)).cast("long").alias("n_cycle"))

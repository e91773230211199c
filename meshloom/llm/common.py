"""Helpers shared by the training-data operators: inputs, lineage cuts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for one word: a run of anything but space and \x09-\x0D.
WORD = r"[^ \t\n\x0B\f\r]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a
    temporary folder, and a cluster an error, since its executors would write elsewhere."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and its size is known to the planner.

    The files outlive lost executors and go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def marked(*cols) -> tuple[Column, Column]:
    """Two 64-bit digests of a row's columns, __m1 and __m2: rows with equal columns share them, others don't."""
    return F.xxhash64(*cols).alias("__m1"), F.xxhash64(F.lit("again"), *cols[::-1]).alias("__m2")


#: A vertex of more neighbours is a hub: its minimum is broadcast to its edges, so they don't meet in one task. There are at
#: most edges / HUB hubs; more than HUBS of them are joined like other vertices.
HUB, HUBS = 256, 4_000_000
#: Edges in a partition that a round writes.
PART_EDGES = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (id, root), root the smallest id reachable.

    Alternates large-star and small-star steps; each vertex' minimum comes from a partially aggregated group-by and
    is joined back, for hubs by broadcast, so a hub's neighbours are never gathered. Ids without an edge do not appear. Empty
    in, empty out. Rounds grow with the logarithm of the longest chain; an error is raised should max_rounds not suffice.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        hubs = low.filter(F.col("n") > HUB).select("a", "m")
        if 0 < hubs.count() <= HUBS:
            rest = both.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.filter(F.col("n") <= HUB).select("a", "m"), "a")
            out = rest.union(both.join(F.broadcast(hubs), "a"))
        else:
            out = both.join(low.select("a", "m"), "a")
        if large:
            return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()

    cur = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # rounds write few files where there are few edges: their number never grows
    parts = max(4, -(-cur.count() // PART_EDGES))
    written = lambda df: cut(df.coalesce(parts))
    mark = None
    for _ in range(max_rounds):
        cur = written(stars(cur, True))
        cur = written(stars(cur, False))
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())

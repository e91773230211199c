"""Tables in and out: grammars, pose graphs, tensors by split, latent vectors as TSV, graphs as GraphML, flat pose rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as a Parquet table of its name under path (IO20, IO21)."""
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def store_split(df: DataFrame, path: str) -> None:
    """df with a column split, one folder per split, so that a reader of one split reads no other (IO22)."""
    df.write.partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


def to_tsv(vectors: DataFrame, digits: int = 6) -> DataFrame:
    """value: a line of id and components for each vector (IO23)."""
    return vectors.select(F.concat_ws("\t", F.col("id").cast("string"), F.transform("v", lambda x: F.format_string(f"%.{digits}f", x.cast("double")))).alias("value"))


def from_tsv(lines: DataFrame) -> DataFrame:
    """id, v of such lines."""
    x = F.split("value", "\t")
    return lines.select(F.get(x, F.lit(0)).cast("long").alias("id"), F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda c: c.cast("double")).alias("v"))


def to_graphml(edges: DataFrame) -> DataFrame:
    """value: one GraphML edge element per line, with its weight (IO24). The frame around them is the same for every graph:
    see GRAPHML."""
    return edges.select(F.format_string('<edge source="%d" target="%d"><data key="weight">%.9f</data></edge>', F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).alias("value"))


GRAPHML = ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">', "</graph></graphml>")


def from_graphml(lines: DataFrame) -> DataFrame:
    """src, dst, weight of the edge elements among lines."""
    part = lambda p: F.regexp_extract("value", p, 1)
    e = lines.filter(F.col("value").contains("<edge "))
    return e.select(part('source="([^"]*)"').cast("long").alias("src"), part('target="([^"]*)"').cast("long").alias("dst"), part("<data[^>]*>([^<]*)<").cast("double").alias("weight"))


def pose_row(src: Column, dst: Column, src_type: Column, dst_type: Column, t, r, size: Column, turn) -> Column:
    """An edge as sixteen numbers: ids, types, relative translation and turn, the neighbour's size, the own turn (IO25)."""
    return F.array(*[c.cast("double") for c in (src, dst, src_type, dst_type, *t, *r, size, *turn)])

"""Merging whole scenes: chosen objects of two, one of them moved, with vertices, texture coordinates and normals compacted and named anew (PR10, PR11, PR13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import geometry as G

from . import graph
from .lineage import settle

_FACE = [f"{c}{i}" for c in "vtn" for i in (1, 2, 3)]


def moved(df: DataFrame, which: Column, turn: tuple[float, float, float, float], by: tuple[float, float, float], about: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """df with x, y, z of the chosen rows turned by a unit quaternion (x, y, z, w) about a point, then moved (PR13)."""
    p = G.sub(tuple(F.col(a) for a in "xyz"), tuple(map(F.lit, about)))
    at = G.add(G.rotate(tuple(map(F.lit, turn)), p), tuple(F.lit(a + b) for a, b in zip(about, by)))
    new = dict(zip("xyz", at))
    return df.select(*[F.when(which, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def _renamed(used: DataFrame, name: str) -> DataFrame:
    """used(scene, part, old), distinct, with a dense number from 0 in each scene, by part and old; no scene is one group."""
    n = graph.numbered(used, "scene", "part", "old", name="number")
    first = n.groupBy("scene").agg(F.min("number").alias("first"))
    return n.join(first, "scene").select("scene", "part", "old", (F.col("number") - F.col("first")).alias(name))


def merge_elements(a: DataFrame, b: DataFrame, keep_a: DataFrame, keep_b: DataFrame, turn: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0), by: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Elements of scenes that hold a's objects in keep_a(scene, oid), then b's in keep_b, turned and moved (PR11).

    Elements are rows as the obj format gives them: faces, and the vertices, texture coordinates and normals that kept faces
    name; others go. Everything is numbered densely by (part, old number) within its scene, through ranges and joins, so a
    large scene is spread. Numbers are joined by sorting and never broadcast: they are as many as the elements, while Spark's estimate
    follows the size of what they were made from. Objects and faces are numbered alike. For overlap suppression pass what overlap_anti_join leaves as
    keep_b. Scenes that neither side keeps anything of don't appear; null or repeated rows of keep_* count once.
    """
    sides = []
    for part, (e, keep) in enumerate(((a, keep_a), (b, keep_b))):
        own = keep.select("scene", "oid").distinct().withColumn("kept", F.lit(True))
        face = e.filter("kind = 'face'").join(own, ["scene", "oid"], "left_semi")
        rest = e.filter("kind IN ('vertex', 'texcoord', 'normal')")
        if part:  # directions turn, places move too
            rest = moved(moved(rest, F.col("kind") == "vertex", turn, by), F.col("kind") == "normal", turn, (0.0, 0.0, 0.0))
        sides.append([df.withColumn("part", F.lit(part)) for df in (face, rest)])
    face, rest = (sides[0][i].unionByName(sides[1][i]) for i in (0, 1))
    objects = _renamed(face.select("scene", "part", F.col("oid").alias("old")).distinct(), "new_oid")
    face = face.join(objects.withColumnRenamed("old", "oid").hint("merge"), ["scene", "part", "oid"])
    order = _renamed(face.select("scene", "part", F.struct("new_oid", "idx").alias("old")), "new_idx").select("scene", "part", F.col("old.new_oid").alias("new_oid"), F.col("old.idx").alias("idx"), "new_idx")
    face = settle(face.join(order.hint("merge"), ["scene", "part", "new_oid", "idx"]))
    out = None
    for kind, c in (("vertex", "v"), ("texcoord", "t"), ("normal", "n")):
        names = [f"{c}{i}" for i in (1, 2, 3)]
        used = face.select("scene", "part", F.explode(F.array(*names)).alias("old")).filter("old >= 0").distinct()
        number = _renamed(used, "new")
        element = rest.filter(F.col("kind") == kind).join(number.withColumnRenamed("old", "idx").hint("merge"), ["scene", "part", "idx"]).select("scene", "kind", F.col("new").alias("idx"), "x", "y", "z")
        out = element if out is None else out.unionByName(element)
        for name in names:
            face = face.join(number.select("scene", "part", F.col("old").alias(name), F.col("new").alias("new_" + name)).hint("merge"), ["scene", "part", name], "left")
    corners = [F.coalesce(F.col("new_" + c), F.lit(-1).cast("long")).alias(c) for c in _FACE]
    face = face.select("scene", "kind", F.col("new_idx").alias("idx"), F.col("new_oid").alias("oid"), "material", *corners)
    return out.unionByName(face, allowMissingColumns=True)

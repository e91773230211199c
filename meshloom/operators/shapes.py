"""From OBJ files to part graphs, words and poses: the way in for whole files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import geometry as G
from meshloom.functions import words as W
from meshloom.sources import obj

from . import collide, pose, words
from .lineage import settle, stored

#: Materials whose numbers are broadcast; more are joined.
MATERIALS = 1_000_000
#: Triangles of a file whose contacts are found where it is parsed; those of larger files are dealt to the cells of a grid.
WHOLE = 20_000


def mesh_faces(files: DataFrame) -> DataFrame:
    """scene, oid, kind (material), fid, c (nine coordinates) of the triangles in files(scene, text)."""
    return obj.triangles(files).select("scene", "oid", F.col("material").alias("kind"), "fid", "c")


def part_edges(faces: DataFrame) -> DataFrame:
    """scene, src, dst: both directions of the contacts of parts, by their triangles."""
    return collide.collision_graph(faces.select("scene", "oid", "fid", "c"))


class _Parts:
    """The parts of some files in order: their file, object, first face and kind, and the contacts of files of up to WHOLE triangles."""

    def __init__(self, scene: list, files: list[obj._File]):
        self.of, self.oid, self.fid, c, self.keep = obj.corners(files)
        self.tri, self.scene = c.reshape(-1, 3, 3), pa.array(scene, pa.string())
        self.first = np.flatnonzero((np.diff(self.of, prepend=-1) != 0) | (np.diff(self.oid, prepend=-1) != 0)) if len(self.of) else np.zeros(0, np.int64)
        self.material = pa.array([m for f in files for m in f.material], pa.string()).take(pa.array(self.keep))
        self.large = np.flatnonzero(np.bincount(self.of, minlength=len(files)) > WHOLE)

    def names(self, part: np.ndarray) -> pa.Array:
        return self.scene.take(pa.array(self.of[self.first[part]]))

    def contacts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of parts (their places) in contact, the smaller first."""
        own = np.flatnonzero(~np.isin(self.of, self.large))
        a, b = collide.whole_scenes(self.of[own], self.oid[own], self.tri[own])
        a, b = (np.searchsorted(self.first, own[x], "right") - 1 for x in (a, b))
        return np.minimum(a, b), np.maximum(a, b)

    def frames(self) -> np.ndarray:
        return pose.frames_of_points(np.append(self.first, len(self.of)) * 9, self.tri.reshape(-1)) if len(self.of) else np.zeros((0, 7))

    def sizes(self) -> np.ndarray:
        if not len(self.of):
            return np.zeros(0)
        d = np.maximum.reduceat(self.tri.max(1), self.first) - np.minimum.reduceat(self.tri.min(1), self.first)
        return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])


def _by_parts(files: DataFrame, make: Callable[[_Parts], list], fields: str) -> DataFrame:
    """scene and fields: what make gives (scene first) for the parts of some files at a time, each of which is parsed once."""
    names = ["scene", *(f.split()[0] for f in fields.split(", "))]

    def run(scene, parsed):
        yield pa.RecordBatch.from_arrays(make(_Parts(scene, parsed)), names)

    return files.select(F.col("scene").cast("string").alias("scene"), "text").mapInArrow(obj.by_file(run), f"scene string, {fields}")


def _and_large(files: DataFrame, made: DataFrame, mark: str, rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made without its rows that have no `mark`, which name the files that are too large to be whole in a task, and what rest gives for these."""
    made = stored(made, "parts")
    large = made.filter(F.col(mark).isNull()).select("scene")
    if large.isEmpty():
        return made
    own = files.withColumn("scene", F.col("scene").cast("string")).join(large.distinct(), "scene", "left_semi")
    return made.filter(F.col(mark).isNotNull()).unionByName(rest(own))


def _with_marks(columns: list, marked: pa.Array) -> list:
    """columns and a row for each of marked, with nulls but for the first column."""
    return [pa.concat_arrays([c, marked if not i else pa.nulls(len(marked), c.type)]) for i, c in enumerate(columns)]


def contacts_of_files(files: DataFrame) -> DataFrame:
    """scene, a, b (a < b): parts in files(scene, text) of which triangles meet. Files of up to WHOLE triangles are parsed once, and
    only pairs leave the task."""

    def make(p: _Parts):
        a, b = p.contacts()
        return _with_marks([p.names(a), pa.array(p.oid[p.first[a]]), pa.array(p.oid[p.first[b]])], p.scene.take(pa.array(p.large)))

    return _and_large(files, _by_parts(files, make, "a long, b long"), "a", lambda own: collide.object_contacts(mesh_faces(own)))


def frames_of_files(files: DataFrame) -> DataFrame:
    """pose.frames_of_faces of the parts in files(scene, text), made where a file is parsed."""

    def make(p: _Parts):
        every = np.arange(len(p.first))
        return [p.names(every), pa.array(p.oid[p.first]), *map(pa.array, p.frames().T)]

    return _by_parts(files, make, "oid long, cx double, cy double, cz double, qx double, qy double, qz double, qw double")


def _neighbours(n: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.ListArray:
    """For each of n parts the values of those that it meets."""
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((dst, src))
    ends = np.append(0, np.cumsum(np.bincount(src, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value[dst[order]], pa.int64()))


def words_of_files(files: DataFrame, repeats: int = 11, starts: str = "all") -> DataFrame:
    """scene, start, repeat, word, node_ids: the words of each connected scene in files(scene, text), from every part (or the
    first) and so many neighbour orders. At most 52 types have a character."""

    def make(p: _Parts):
        every = np.arange(len(p.first))
        a, b = p.contacts()
        kind = p.material.take(pa.array(p.first))
        ends = pa.array(np.append(p.first, len(p.of)).astype(np.int32))
        near = _neighbours(len(every), a, b, p.oid[p.first])
        if len(p.large):  # of large files the types are known, the contacts not
            near = pa.array(near.to_pylist(), pa.list_(pa.int64()), mask=np.isin(p.of[p.first], p.large))
        return [p.names(every), pa.array(p.oid[p.first]), kind, pa.ListArray.from_arrays(ends, p.material), near]

    parts = _by_parts(files, make, "oid long, kind string, materials array<string>, near array<long>")
    parts = stored(parts.withColumn("materials", F.array_distinct("materials")), "parts")
    index = obj.material_index(parts.select(F.lit("face").alias("kind"), F.explode("materials").alias("material")))
    index = settle(index.withColumnRenamed("material", "kind"))
    index = F.broadcast(index) if index.count() <= MATERIALS else index
    nodes = parts.select("scene", F.col("oid").alias("node"), "kind").join(index, "kind").select("scene", "node", W.type_char(F.col("type")).alias("ch"))
    edges = parts.select("scene", F.col("oid").alias("src"), F.explode("near").alias("dst"))
    large = parts.filter("near IS NULL").select("scene").distinct()
    if not large.isEmpty():
        edges = edges.unionByName(part_edges(mesh_faces(files.withColumn("scene", F.col("scene").cast("string")).join(large, "scene", "left_semi"))))
    return words.encode_graphs(nodes, edges, repeats, starts=starts)


_PLACE = ("cx", "cy", "cz", "qx", "qy", "qz", "qw")


def poses_of_files(files: DataFrame) -> DataFrame:
    """scene, src, dst, types, relative translation (x, y, z), relative turn (rx, ry, rz, rw) and the neighbour's size of each
    directed contact in files(scene, text). A file's contacts meet the frames of its parts where it is parsed."""

    def make(p: _Parts):
        a, b = p.contacts()
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        place, size, kind = p.frames(), p.sizes(), p.material.take(pa.array(p.first))
        end = lambda x: [*map(pa.array, place[x].T), kind.take(pa.array(x))]
        return _with_marks([p.names(src), pa.array(p.oid[p.first[src]]), pa.array(p.oid[p.first[dst]]), *end(src), *end(dst), pa.array(size[dst])], p.scene.take(pa.array(p.large)))

    fields = ["src long", "dst long", *(f"{s}_{c} {'string' if c == 'kind' else 'double'}" for s in "ab" for c in (*_PLACE, "kind")), "b_size double"]
    e = _and_large(files, _by_parts(files, make, ", ".join(fields)), "src", lambda own: _joined_poses(mesh_faces(own)))
    q = lambda p: tuple(F.col(f"{p}q{c}") for c in "xyzw")
    c = lambda p: tuple(F.col(f"{p}c{a}") for a in "xyz")
    t, r = G.rotate(G.conjugate(q("a_")), G.sub(c("b_"), c("a_"))), G.product(G.conjugate(q("b_")), q("a_"))
    return e.select("scene", "src", "dst", F.col("a_kind").alias("src_type"), F.col("b_kind").alias("dst_type"), *[x.alias(a) for a, x in zip("xyz", t)], *[x.alias(f"r{a}") for a, x in zip("xyzw", r)], F.col("b_size").alias("size"))


def _joined_poses(faces: DataFrame) -> DataFrame:
    """scene, src, dst and the frames, kinds and size (b's) of both ends of each directed contact of faces."""
    at = lambda f, g, i: f(g(*[F.col("c")[3 * k + i] for k in range(3)]))
    size = faces.groupBy("scene", "oid").agg(F.min_by("kind", "fid").alias("kind"), *[(at(F.max, F.greatest, i) - at(F.min, F.least, i)).alias(a) for i, a in enumerate("xyz")])
    n = pose.frames_of_faces(faces).join(size.select("scene", "oid", "kind", G.length([F.col(a) for a in "xyz"]).alias("size")), ["scene", "oid"])
    end = lambda p, key, *more: n.select("scene", F.col("oid").alias(key), *[F.col(c).alias(p + c) for c in (*_PLACE, "kind", *more)])
    return part_edges(faces).join(end("a_", "src"), ["scene", "src"]).join(end("b_", "dst", "size"), ["scene", "dst"])

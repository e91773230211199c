"""Poses of parts: local frames, exact triangle tests, rigid alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.frames import kabsch_of, local_frames_of, quaternions_of


def frames_of_points(end: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Centre and quaternion (m x 7) of m parts: part i has the points flat[end[i]:end[i + 1]], coordinates one after the other."""
    size = np.diff(end) // 3
    out = np.empty((len(size), 7))
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        c, axes = local_frames_of(flat[end[:-1][own][:, None] + np.arange(3 * k)].reshape(len(own), k, 3))
        out[own, :3], out[own, 3:] = c, quaternions_of(axes)
    return out


def _frames(parts: DataFrame) -> DataFrame:
    """scene, oid, centre and quaternion of parts(scene, oid, p): p the coordinates of a part's points, one after the other."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            p = rb.column(2)
            end = p.offsets.to_numpy() - p.offsets[0].as_py()
            out = frames_of_points(end, p.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *map(pa.array, out.T)], names)

    names = ["scene", "oid", "cx", "cy", "cz", "qx", "qy", "qz", "qw"]
    kind = parts.schema["scene"].dataType.simpleString()
    return parts.select("scene", F.col("oid").cast("long").alias("oid"), "p").mapInArrow(run, f"scene {kind}, oid long, cx double, cy double, cz double, qx double, qy double, qz double, qw double")


def local_frames(points: DataFrame) -> DataFrame:
    """scene, oid, centre and quaternion of each part (PO1). points: scene, oid, x, y, z; a part's points are one row, many parts
    one batch."""
    p = points.groupBy("scene", "oid").agg(F.array_sort(F.collect_list(F.array("x", "y", "z"))).alias("p"))
    return _frames(p.select("scene", "oid", F.flatten("p").alias("p")))


def frames_of_faces(faces: DataFrame) -> DataFrame:
    """local_frames of the corners of faces(scene, oid, fid, c)."""
    p = faces.groupBy("scene", "oid").agg(F.array_sort(F.collect_list(F.struct("fid", "c"))).alias("p"))
    return _frames(p.select("scene", "oid", F.flatten(F.transform("p", lambda x: x["c"])).alias("p")))


def rigid_align(matches: DataFrame, limit: float = 0.05) -> DataFrame:
    """sample, n, ok, residue and quaternion and translation of each sample's matched points (TK11).

    matches: sample, px..pz, qx..qz. ok if the fit is a turn, not a mirror image, and the residue is under limit of their extent.
    """
    end = lambda s: F.struct(*[F.col(s + a).alias(a) for a in "xyz"]).alias(s)
    each = matches.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(end("p"), end("q")))).alias("e"))
    return rigid_align_rows(each.select("sample", F.transform("e", lambda x: x["p"]).alias("p"), F.transform("e", lambda x: x["q"]).alias("q")), limit)


def rigid_align_rows(matches: DataFrame, limit: float = 0.05) -> DataFrame:
    """rigid_align of samples that are rows: sample, p and q as arrays of structs with x, y, z. Those of a batch with as many points go together."""
    names = ["sample", "n", "ok", "residue", "qx", "qy", "qz", "qw", "tx", "ty", "tz"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            begin, size = rb.column(1).offsets.to_numpy(), np.diff(rb.column(1).offsets.to_numpy()) // 3
            flat = [c.values.to_numpy(zero_copy_only=False) for c in rb.columns[1:]]
            out, turn, fine = np.empty((len(size), 8)), np.zeros(len(size), bool), np.zeros(len(size), bool)
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                p, q = (x[begin[own][:, None] + np.arange(3 * k)].reshape(len(own), k, 3) for x in flat)
                r, t, res, det = kabsch_of(p, q)
                turn[own] = np.abs(det - 1) <= 0.01
                fine[own] = res <= limit * np.maximum(np.linalg.norm(p.max(1) - p.min(1), axis=1), 1e-9)
                out[own, 0], out[own, 1:5], out[own, 5:] = res, quaternions_of(r.transpose(0, 2, 1)), t
            out[~turn, 1:5] = [0.0, 0.0, 0.0, 1.0]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(size.astype(np.int64)), pa.array(turn & fine), *map(pa.array, out.T)], names)

    flat = lambda c: F.flatten(F.transform(c, lambda x: F.array(*[x[a].cast("double") for a in "xyz"]))).alias(c)
    return matches.select(F.col("sample").cast("long").alias("sample"), flat("p"), flat("q")).mapInArrow(run, "sample long, n long, ok boolean, residue double, qx double, qy double, qz double, qw double, tx double, ty double, tz double")

"""Spatial operators: object statistics, uniform grid, cell joins, overlap tests, scene edits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .lineage import parts, settle, small

AXES = ("x", "y", "z")


def node_types(faces: DataFrame, order: list[str]) -> DataFrame:
    """oid, type: the type of each object's first face in the given total order (PR1, PR2)."""
    return faces.groupBy("oid").agg(F.min_by("type", F.struct(*order)).alias("type"))


def object_stats(points: DataFrame, scale: float = 1.0) -> DataFrame:
    """oid, centre, bounds and size (diagonal of the bounds times scale) of each object's points (PR3, PR4)."""
    aggs = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("c", F.avg), ("lo_", F.min), ("hi_", F.max))]
    out = points.groupBy("oid").agg(*aggs, F.count("*").alias("n"))
    return out.withColumn("size", F.lit(scale) * F.sqrt(sum((F.pow(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(2.0)) for a in AXES[1:]), F.pow(F.col("hi_x") - F.col("lo_x"), F.lit(2.0)))))


def scene_bounds(points: DataFrame) -> DataFrame:
    """One row: bounds over all points, used or not (PR5)."""
    return points.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])


def grid_resolution(bounds: DataFrame, n_faces: int, exact: bool = True, threshold: float = 0.02) -> DataFrame:
    """bounds (lo_*, hi_*) and cells per axis (JN3): 8 cells a face in exact mode, else cells of the given share of the diagonal. Flat extents count as a millionth."""
    d = {a: F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(1e-6)) for a in AXES}
    if exact:
        unit = F.pow(F.lit(8.0 * n_faces) / (d["x"] * d["y"] * d["z"]), F.lit(1.0 / 3.0))
        res = {a: d[a] * unit for a in AXES}
    else:
        diag = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
        res = {a: d[a] / (diag * F.lit(0.57735 * threshold)) for a in AXES}
    return bounds.select("*", *[F.greatest(F.floor(res[a]), F.lit(1)).cast("long").alias(f"r{a}") for a in AXES])


def sane(scenes: DataFrame) -> DataFrame:
    """Scenes that hold vertices, faces and objects and more than one material (PR8). scenes: n_vertices, n_faces, n_objects, n_materials."""
    return scenes.filter("n_vertices > 0 AND n_faces > 0 AND n_objects > 0 AND n_materials > 1")


def cell_of(value: Column, lo: Column, hi: Column, res: Column) -> Column:
    """Cell index along one axis, clamped to the grid (MA21)."""
    at = F.floor((value - lo) / F.greatest(hi - lo, F.lit(1e-6)) * res)
    return F.least(F.greatest(at, F.lit(0)), res - 1).cast("long")


def fragments(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """oid, cell: every grid cell that an object's box meets (JN1). grid is one row and broadcast as such."""
    b = boxes.join(F.broadcast(grid.select(*[F.col(f"lo_{a}").alias(f"g_{a}") for a in AXES], *[F.col(f"hi_{a}").alias(f"h_{a}") for a in AXES], "rx", "ry", "rz")))
    for a in AXES:
        lo, hi = (cell_of(F.col(f"{e}_{a}"), F.col(f"g_{a}"), F.col(f"h_{a}"), F.col(f"r{a}")) for e in ("lo", "hi"))
        b = b.withColumn(f"i{a}", F.explode(F.sequence(lo, hi)))
    return b.select("oid", (F.col("ix") + F.col("iy") * F.col("rx") + F.col("iz") * F.col("rx") * F.col("ry")).alias("cell"))


def meets_cells(tri: np.ndarray, centre: np.ndarray, half: np.ndarray, slack: float = 0.01) -> np.ndarray:
    """Whether triangles tri[i] (n x 3 x 3) meet the boxes around centre[i] (n x 3) of half-widths half (MA23).

    Boxes are taken a hundredth larger. A triangle and a box are apart if they are along a box axis, the triangle's normal or
    a cross product of an edge and an axis.
    """
    h = half * (1 + slack)
    v = tri - centre[:, None]
    edge = np.roll(v, -1, 1) - v
    axes = [np.broadcast_to(e, centre.shape) for e in np.eye(3)] + [np.cross(edge[:, 0], edge[:, 1])]
    axes += [np.cross(edge[:, i], e) for i in range(3) for e in np.eye(3)]
    apart = np.zeros(len(tri), bool)
    for a in axes:
        p = np.einsum("nij,nj->ni", v, a)
        r = np.abs(a) @ h
        apart |= (p.min(1) > r) | (p.max(1) < -r)
    return ~apart


#: Candidate cells that are tested at a time; bounds memory, however large a triangle.
CELLS = 1 << 20


def _boxes_of_cells(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first cell and cells along each axis of boxes at (m x 3), n cells wide (m x 3); those of over CELLS cells are cut in two."""
    row = np.arange(len(n))
    while len(big := np.flatnonzero(n.prod(1) > CELLS)):
        axis, half = n[big].argmax(1), n[big].max(1) // 2
        first, second, moved = n[big], n[big], at[big]
        k = np.arange(len(big))
        first[k, axis], second[k, axis], moved[k, axis] = half, n[big][k, axis] - half, moved[k, axis] + half
        rest = np.delete(np.arange(len(n)), big)
        row, at, n = np.concatenate([row[rest], row[big], row[big]]), np.concatenate([at[rest], at[big], moved]), np.concatenate([n[rest], first, second])
    return row, at, n


def _meets_boxes(tri: np.ndarray, at: np.ndarray, n: tuple[int, int, int], cell: np.ndarray, slack: float = 0.01) -> np.ndarray:
    """meets_cells of m triangles, each with its own box of n cells from at (m x 3), as m x n: an axis along an edge's product
    with a box axis sees two coordinates only, so all but the normal are tested on planes of cells."""
    half = cell / 2 * (1 + slack)
    # along an axis all cells share the triangle's interval and the place of their centres, counted from the first one's
    v = tri - (at + 0.5)[:, None] * cell
    edge = np.roll(v, -1, 1) - v
    place = [np.arange(n[i]) * cell[i] for i in range(3)]
    shape = [(-1, *[n[i] if i == k else 1 for i in range(3)]) for k in range(3)]
    meets = np.ones((len(tri), *n), bool)

    def test(a):
        p, r = np.einsum("nij,nj->ni", v, a), np.abs(a) @ half
        along = sum((a[:, k, None] * place[k]).reshape(shape[k]) for k in range(3) if a[:, k].any())
        wide = lambda x: x[:, None, None, None]
        return (wide(p.min(1) - r) <= along) & (along <= wide(p.max(1) + r))

    for a in np.eye(3):
        meets &= test(np.broadcast_to(a, (len(tri), 3)))
    for i in range(3):
        for e in np.eye(3):
            meets &= test(np.cross(edge[:, i], e))
    return meets & test(np.cross(edge[:, 0], edge[:, 1]))


def _batch_cells(rb: pa.RecordBatch, wide: np.ndarray, base: np.ndarray):
    """(rows of the batch, cells) of the cells that its triangles meet, up to CELLS candidates at a time."""
    tri = rb.column(rb.schema.get_field_index("c")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3, 3) - base
    # a hundredth of a cell more on either side, as cells are taken that much larger
    lo, hi = np.floor(tri.min(1) / wide - 0.005).astype(np.int64), np.floor(tri.max(1) / wide + 0.005).astype(np.int64)
    row, at, n = _boxes_of_cells(lo, hi - lo + 1)
    for size in np.unique(n, axis=0):
        alike = np.flatnonzero((n == size).all(1))
        step = max(1, CELLS // int(size.prod()))
        for k in range(0, len(alike), step):
            own = alike[k : k + step]
            hit = np.nonzero(_meets_boxes(tri[row[own]], at[own], tuple(size.tolist()), wide))
            src = own[hit[0]]
            yield row[src], at[src] + np.stack(hit[1:], 1)


def _with_corners(faces: DataFrame, *columns: str) -> DataFrame:
    return faces.filter("c IS NOT NULL").select(*columns, F.col("c").cast("array<double>").alias("c"))


def triangle_cells(faces: DataFrame, cell: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """scene, oid, fid, ix, iy, iz: every grid cell that a triangle meets (JN1). faces: scene, oid, fid, c (nine coordinates).

    The cells of a triangle's box are candidates; triangles of a batch whose boxes are equally wide are tested together by
    separating axes, and candidates are never rows.
    """
    wide, base = np.array(cell, float), np.array(origin, float)

    def run(it):
        for rb in filter(len, it):
            ids = pa.RecordBatch.from_arrays(rb.columns[:3], ["scene", "oid", "fid"])
            for row, at in _batch_cells(rb, wide, base):
                yield pa.RecordBatch.from_arrays([*ids.take(pa.array(row)).columns, *map(pa.array, at.T)], [*ids.schema.names, "ix", "iy", "iz"])

    kind = faces.schema["scene"].dataType.simpleString()
    return _with_corners(faces, "scene", F.col("oid").cast("long").alias("oid"), F.col("fid").cast("long").alias("fid")).mapInArrow(run, f"scene {kind}, oid long, fid long, ix long, iy long, iz long")


def scene_cells(faces: DataFrame, cell: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """scene, n, n_cells: how many (triangle, cell) rows triangle_cells gives for a scene, and in how many cells.

    A scene's triangles are a row, which is counted where it lies: neither rows nor cells are shuffled, and faces that are
    dealt by scene aren't either. Scenes without a cell give nothing.
    """
    wide, base = np.array(cell, float), np.array(origin, float)
    kind = faces.schema["scene"].dataType.simpleString()

    def run(it):
        for rb in filter(len, it):
            c = rb.column(1)
            begin = c.offsets.to_numpy()
            of = np.repeat(np.arange(rb.num_rows), np.diff(begin) // 9)
            tri = pa.ListArray.from_arrays(np.arange(0, 9 * len(of) + 1, 9, dtype=np.int32), c.flatten())
            n, distinct = np.zeros(rb.num_rows, np.int64), np.zeros(rb.num_rows, np.int64)
            found = [(of[row], at) for row, at in _batch_cells(pa.RecordBatch.from_arrays([tri], ["c"]), wide, base)]
            if found:
                scene, at = (np.concatenate(x) for x in zip(*found))
                n = np.bincount(scene, minlength=rb.num_rows)
                order = np.lexsort((*at.T, scene))
                scene, at = scene[order], at[order]
                new = np.ones(len(scene), bool)
                new[1:] = (scene[1:] != scene[:-1]) | (at[1:] != at[:-1]).any(1)
                distinct = np.bincount(scene[new], minlength=rb.num_rows)
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n), pa.array(distinct)], ["scene", "n", "n_cells"]).filter(some)

    held = _with_corners(faces, "scene").groupBy("scene").agg(F.flatten(F.collect_list("c")).alias("c"))
    return held.mapInArrow(run, f"scene {kind}, n long, n_cells long")


def prune_cells(frags: DataFrame) -> DataFrame:
    """cell, n_prims, n_objects of cells that can give a pair (JN5)."""
    return frags.groupBy("cell").agg(F.count("*").alias("n_prims"), F.countDistinct("oid").alias("n_objects")).filter("n_objects > 1")


def cell_pairs(frags: DataFrame, dense: bool = False) -> DataFrame:
    """Distinct undirected pairs a < b that share a cell (JN6). Members are made distinct before the self-join, so a cell's primitives
    never multiply. Large tables are dealt into as many partitions as their rows ask for, so that a task's pairs don't grow with
    the table. dense: cells of many members, whose pairs repeat; tasks join equal ones before they shuffle them."""
    n = parts(frags)
    m = (frags.select("cell", "oid").repartition(n, "cell") if n else frags.select("cell", "oid")).distinct()
    p = m.select("cell", F.col("oid").alias("a")).join(m.select("cell", F.col("oid").alias("b")), "cell").filter("a < b").select("a", "b")
    return (p.repartition(n, "a", "b") if n and not dense else p).distinct()


def near_pairs(frags: DataFrame, bands: DataFrame, reach: int = 1) -> DataFrame:
    """cell_pairs of objects whose bands (oid, n: a whole number each) lie within reach: objects of other bands never meet, so a cell
    of many gives the pairs that are asked for only."""
    n = parts(frags)
    m = (frags.select("cell", "oid").repartition(n, "cell") if n else frags.select("cell", "oid")).distinct().join(small(bands), "oid")
    # an object stands in its own band, and asks the bands up to reach above it; within its own the smaller one asks
    a = m.select("cell", F.col("oid").alias("a"), F.col("n").alias("na"), F.explode(F.sequence(F.col("n"), F.col("n") + reach)).alias("band"))
    b = m.select("cell", F.col("oid").alias("b"), F.col("n").alias("band"))
    p = a.join(b, ["cell", "band"]).filter((F.col("na") < F.col("band")) | (F.col("a") < F.col("b")))
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def symmetric(pairs: DataFrame) -> DataFrame:
    """src, dst: both directions of each pair."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def collision_graph(frags: DataFrame, types: DataFrame) -> DataFrame:
    """src, dst, src_type, dst_type: objects that share a cell (JN9). The last join is by src, which what follows groups by."""
    e = symmetric(cell_pairs(frags))
    t = types.select("oid", "type")
    n = parts(frags)
    deal = lambda df, c: df.repartition(n, c) if n else df
    e = deal(e, "dst").join(t.select(F.col("oid").alias("dst"), F.col("type").alias("dst_type")), "dst")
    e = deal(e, "src").join(t.select(F.col("oid").alias("src"), F.col("type").alias("src_type")), "src")
    return e.select("src", "dst", "src_type", "dst_type")


def gap(a: str, b: str) -> Column:
    """Distance of the centres whose columns begin with a and b."""
    d = [F.col(f"{a}c{x}") - F.col(f"{b}c{x}") for x in AXES]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def pairwise_distance(nodes: DataFrame, scene: str = "scene") -> DataFrame:
    """scene, a, b, d: distances of all ordered pairs of centres of a scene (JN16); the answer itself is quadratic in a scene."""
    return prefixed(nodes, "a_").join(prefixed(nodes, "b_"), F.col(f"a_{scene}") == F.col(f"b_{scene}")).filter("a_oid <> b_oid").select(F.col(f"a_{scene}").alias(scene), F.col("a_oid").alias("a"), F.col("b_oid").alias("b"), gap("a_", "b_").alias("d"))


def overlap_anti_join(b: DataFrame, a: DataFrame, share: float = 0.125 * 0.25) -> DataFrame:
    """Objects of b without an object of a of the same type whose centre lies within share * size (JN4).

    b's objects look into the cells of a grid around their centre and a's lie in one each, so only near objects meet. A
    cell is as wide as the largest reach, the type is part of the key.
    """
    reach = b.agg(F.max(F.col("size") * F.lit(share))).first()[0] or 0.0
    if not reach:
        return b
    cell = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    at = prefixed(a, "a_").select("a_type", "a_cx", "a_cy", "a_cz", *[cell(f"a_c{x}").alias(f"g{x}") for x in AXES])
    ask = prefixed(b, "b_")
    for x in AXES:
        ask = ask.withColumn(f"g{x}", F.explode(F.array(*[cell(f"b_c{x}") + d for d in (-1, 0, 1)])))
    near = ask.join(at, [f"g{x}" for x in AXES]).filter((F.col("b_type") == F.col("a_type")) & (gap("b_", "a_") < F.col("b_size") * F.lit(share)))
    return b.join(near.select(F.col("b_oid").alias("oid")).distinct(), "oid", "left_anti").select(b.columns)


#: Members of a cell that one group pairs; the cells of more are dealt into blocks that meet two by two.
CELL_BLOCK = 1024


#: Objects of a block where counts of shared cells are a matrix, and how many pairs a row that travels must spare for it.
SHARED_BLOCK, SPARED = 4096, 32


def shared_cells(members: DataFrame) -> DataFrame:
    """a, b, shared: pairs a < b of distinct (cell, oid) members with the number of cells they share (JN6, JN8).

    Where objects share many cells, pairs by cell would be many times the answer: there objects are dealt into blocks, and the
    counts of two blocks are a matrix product. Elsewhere pairs are listed by cell.
    """
    held = settle(members.select("cell", "oid"))
    k = held.groupBy("cell").agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs")).first()
    blocks = max(1, -(-held.agg(F.countDistinct("oid")).first()[0] // SHARED_BLOCK))
    if k["n"] and members.schema["cell"].dataType.simpleString() == "bigint" and k["pairs"] > SPARED * k["n"] * blocks:
        return _shared_by_block(held, blocks)
    return _shared_by_cell(held)


def _shared(cell: np.ndarray, row: np.ndarray, mine: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Shared cells of each row of the first block (mine) with each of the second: cells of many members by matrix products, 1024
    at a time, others pair by pair."""
    out = np.zeros(rows * columns, np.int32)
    n_cells, cell = (lambda u: (len(u[0]), u[1]))(np.unique(cell, return_inverse=True))
    k = [np.bincount(cell[m], minlength=n_cells) for m in (mine, ~mine)]
    dense = k[0] * k[1] * 64 > rows * columns
    few = ~dense & (k[0] * k[1] > 0)
    order = [np.flatnonzero(m & few[cell]) for m in (mine, ~mine)]
    order = [o[np.argsort(cell[o], kind="stable")] for o in order]
    end = np.cumsum(np.where(few, k[1], 0))
    for lo in range(0, len(order[0]), 100_000):
        a = order[0][lo : lo + 100_000]
        run = k[1][cell[a]]
        b = order[1][np.repeat(end[cell[a]] - run, run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)]
        out += np.bincount(np.repeat(row[a], run) * columns + row[b], minlength=len(out)).astype(np.int32) if len(b) * 8 > len(out) else 0
        if len(b) * 8 <= len(out):
            np.add.at(out, np.repeat(row[a], run) * columns + row[b], 1)
    out = out.reshape(rows, columns)
    number = np.cumsum(dense) - 1
    use = np.flatnonzero(dense[cell])
    for lo in range(0, int(dense.sum()), 1024):
        at = use[(number[cell[use]] >= lo) & (number[cell[use]] < lo + 1024)]
        m = [np.zeros((size, 1024), np.float32) for size in (rows, columns)]
        for matrix, side in zip(m, (mine[at], ~mine[at])):
            matrix[row[at[side]], number[cell[at[side]]] - lo] = 1
        out += (m[0] @ m[1].T).astype(np.int32)
    return out


def _shared_by_block(members: DataFrame, blocks: int) -> DataFrame:
    """shared_cells by products of blocks: a member travels once for each block; memory holds two blocks and their counts."""
    kind = members.schema["oid"].dataType.simpleString()
    m = members.select("cell", F.col("oid").cast("long").alias("oid"), F.pmod(F.xxhash64("oid"), F.lit(blocks)).alias("own"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    m = m.select((lo * blocks + hi).alias("g"), (F.col("own") == lo).alias("mine"), (lo == hi).alias("same"), "cell", "oid")

    def count(held):
        mine, same, cell, oid = (np.concatenate(x) for x in list(zip(*held))[1:])
        if same[0]:
            mine, cell, oid = np.concatenate([mine, ~mine]), np.concatenate([cell, cell]), np.concatenate([oid, oid])
        row, names = np.zeros(len(oid), np.int64), []
        for side in (mine, ~mine):
            name, row[side] = np.unique(oid[side], return_inverse=True)
            names.append(name)
        n = _shared(cell, row, mine, len(names[0]), len(names[1]))
        for at in range(0, len(n), 64):
            i, j = np.nonzero(n[at : at + 64])
            x, y = names[0][i + at], names[1][j]
            keep = x < y if same[0] else np.ones(len(x), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(n[i + at, j][keep].astype(np.int64))], ["a", "b", "shared"])

    def run(it):
        held = []
        for rb in it:
            cols = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
            edge = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), rb.num_rows]
            for lo, hi in zip(edge, edge[1:]):
                if held and hi > lo and held[-1][0][0] != cols[0][lo]:
                    yield from count(held)
                    held = []
                if hi > lo:
                    held.append([c[lo:hi] for c in cols])
        if held:
            yield from count(held)

    found = m.repartition(max(1, blocks * (blocks + 1) // 2), "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, shared long")
    return found.select(F.col("a").cast(kind), F.col("b").cast(kind), "shared")


def _shared_by_cell(members: DataFrame) -> DataFrame:
    """shared_cells by the pairs of each cell.

    A hot cell is dealt into blocks of CELL_BLOCK members, every two blocks a group, so no task pairs more than two blocks at
    a time; pairs are counted within a task before they are shuffled.
    """
    n = members.groupBy("cell").agg(F.ceil(F.count("*") / CELL_BLOCK).alias("blocks")).filter("blocks >= 1")
    m = members.join(n, "cell").withColumn("own", F.pmod(F.xxhash64("oid"), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    m = m.select(F.xxhash64("cell", lo, hi).alias("grp"), (F.col("own") == lo).alias("first"), (lo == hi).alias("same"), "oid")

    def run(it):
        def total(held):
            a, b, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((b, a))
            a, b, c = a[order], b[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return a[at], b[at], np.add.reduceat(c, at)

        def pairs(first, oid, same):
            x, y = (oid, oid) if same else (oid[first], oid[~first])
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            if same:
                keep = a < b
                return a[keep], b[keep]
            return np.minimum(a, b), np.maximum(a, b)

        held, size, rest = [], 0, None
        for rb in it:
            cols = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            g = cols[0]
            edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
            for lo, hi in zip(edge, edge[1:]):
                a, b = pairs(cols[1][lo:hi], cols[3][lo:hi], cols[2][lo])
                held.append((a, b, np.ones(len(a), np.int64)))
                size += len(a)
                if size > 4_000_000:
                    held = [total(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b", "shared"])
                        held = []
                    size = len(held[0][0]) if held else 0
            rest = [c[edge[-1] :] for c in cols] if len(g) else rest
        if rest is not None and len(rest[0]):
            a, b = pairs(rest[1], rest[3], rest[2][0])
            held.append((a, b, np.ones(len(a), np.int64)))
        if held and sum(len(x[0]) for x in held):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total(held)], ["a", "b", "shared"])

    kind = members.schema["oid"].dataType.simpleString()
    found = m.withColumn("oid", F.col("oid").cast("long")).repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long, shared long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared")).select(F.col("a").cast(kind), F.col("b").cast(kind), "shared")


def merge_scenes(a: DataFrame, b: DataFrame, share: float = 0.125 * 0.25) -> DataFrame:
    """a's objects and those of b that overlap none, with new dense ids: part (0 or 1), oid, new_id (PR10, PR11)."""
    u = a.withColumn("part", F.lit(0)).unionByName(overlap_anti_join(b, a, share).withColumn("part", F.lit(1)))
    return graph.numbered(u, "part", "oid", name="new_id")


def translate_objects(points: DataFrame, ids: Column, t: tuple[float, float, float]) -> DataFrame:
    """points with those of the chosen objects moved by t (PR13)."""
    return points.select(*[F.when(ids, F.col(a) + F.lit(d)).otherwise(F.col(a)).alias(a) if a in AXES else F.col(a) for a, d in ((c, dict(zip(AXES, t)).get(c, 0.0)) for c in points.columns)])

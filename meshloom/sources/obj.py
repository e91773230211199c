"""OBJ and MTL text as DataFrames, and back (IO1-IO17)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row per element. Vertices, normals and materials hold x, y, z; faces hold corner indexes from 0, -1 where absent.
SCHEMA = "scene string, kind string, idx long, oid long, material string, x double, y double, z double, v1 long, v2 long, v3 long, n1 long, n2 long, n3 long"
DEFAULT = "Default"


def read_text(spark: SparkSession, path: str, glob: str = "*.obj") -> DataFrame:
    """scene, text of every file under path but exported collision graphs (IO17)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return files.select(F.col("_metadata.file_path").alias("scene"), F.col("value").alias("text")).filter(~F.col("scene").like("%\\_coll\\_graph.obj"))


def dirname(path: Column) -> Column:
    """The folder of a path, empty where it has none (MA25)."""
    return F.regexp_extract(path, r"^(.*)[/\\\\]", 1)


def _corner(c: str, nv: int, nn: int) -> tuple[int, int]:
    if "/" not in c:
        i = int(c)
        return (i - 1 if i > 0 else nv + i), -1
    part = c.split("/")
    place = lambda s, n: (int(s) - 1 if int(s) > 0 else n + int(s)) if s else -1
    return place(part[0], nv), place(part[2], nn) if len(part) > 2 else -1


class _File:
    """What one file holds: places as numbers one after the other, faces as object, material and six corner indexes each, lines
    and points as rows. Plain numbers, unlike tuples of them, cost the garbage collector nothing."""

    def __init__(self, text: str | None):
        self.v, self.n, self.vt, self.oid, self.material, self.index, self.rest = [], [], [], [], [], [], []
        v, n, oids, materials, index, oid, material = self.v, self.n, self.oid, self.material, self.index, 0, DEFAULT
        text = text or ""
        marked = "#" in text
        for line in text.splitlines():
            words = (line.partition("#")[0] if marked else line).split()
            if not words:
                continue
            key = words[0]
            try:
                if key == "f" and len(words) == 5 and "/" not in line:  # a plain quad
                    v0, v1, v2, v3 = int(words[1]), int(words[2]), int(words[3]), int(words[4])
                    if v0 > 0 and v1 > 0 and v2 > 0 and v3 > 0:
                        index += (v0 - 1, v1 - 1, v2 - 1, -1, -1, -1, v0 - 1, v2 - 1, v3 - 1, -1, -1, -1)
                        oids += (oid, oid)
                        materials += (material, material)
                        continue
                if key == "v" or key == "vn":
                    if len(words) == 4:
                        (v if key == "v" else n).extend((float(words[1]), float(words[2]), float(words[3])))
                elif key == "vt" and len(words) >= 3:
                    self.vt.extend((float(words[1]), float(words[2])))
                elif key == "usemtl" and len(words) > 1:
                    material = words[1]
                elif key == "o":
                    oid += 1
                elif key in ("f", "fo", "l", "p") and len(words) > 1:
                    if "/" in line:
                        c = [_corner(w, len(v) // 3, len(n) // 3) for w in words[1:]]
                    else:
                        nv = len(v) // 3
                        c = [(i - 1 if i > 0 else nv + i, -1) for i in map(int, words[1:])]
                    if len(c) <= 2:
                        self.rest.append((len(c), oid, material, c[0][0], c[1][0] if len(c) == 2 else None))
                        continue
                    (v0, n0), (v1, n1) = c[0], c[1]
                    for v2, n2 in c[2:]:
                        oids.append(oid)
                        materials.append(material)
                        index += (v0, v1, v2, n0, n1, n2)
                        v1, n1 = v2, n2
            except ValueError:
                continue
        if self.oid and len(set(self.oid)) != self.oid[-1] + 1:
            dense = {o: i for i, o in enumerate(sorted(set(self.oid)))}
            self.oid = [dense[o] for o in self.oid]


_TYPES = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.float64()] * 3 + [pa.int64()] * 6))


def _batch(kind: str, scene: pa.Array, size: list, wanted: list, **columns) -> pa.RecordBatch:
    """Rows of SCHEMA of one kind: size[i] rows of scene[i], numbered from 0; columns that aren't given are null."""
    size = np.array(size, np.int64)
    total = int(size.sum())
    made = {
        "scene": lambda: scene.take(pa.array(np.repeat(np.arange(len(size)), size))),
        "kind": lambda: pa.repeat(pa.scalar(kind), total),
        "idx": lambda: np.arange(total) - np.repeat(np.cumsum(size) - size, size),
    }
    columns |= {c: f() for c, f in made.items() if c in wanted}
    # an Arrow array stays as it is: made anew it would be read value by value
    held = lambda c: columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], _TYPES[c])
    return pa.RecordBatch.from_arrays([held(c) if c in columns else pa.nulls(total, _TYPES[c]) for c in wanted], wanted)


def _rows(scene: list, files: list[_File], kinds: list | None = None, wanted: list | None = None) -> Iterator[pa.RecordBatch]:
    """The elements of some files, kind by kind: all, or those of some kinds and the columns wanted."""
    wanted = wanted or list(_TYPES)
    every = lambda name: list(chain.from_iterable(getattr(f, name) for f in files))
    size = lambda name, each=1: [len(getattr(f, name)) // each for f in files]
    asked = lambda *kind: kinds is None or any(k in kinds for k in kind)
    numbers = lambda rows, names, kind: dict(zip(names, np.array(every(rows), kind).reshape(-1, len(names)).T)) if set(names) & set(wanted) else {}
    scene = pa.array(scene, pa.string())
    for kind, name, axes in (("vertex", "v", "xyz"), ("normal", "n", "xyz"), ("texcoord", "vt", "xy")):
        if asked(kind) and sum(n := size(name, len(axes))):
            yield _batch(kind, scene, n, wanted, **numbers(name, axes, float))
    if asked("face") and sum(n := size("oid")):
        named = {k: every(k) for k in ("oid", "material") if k in wanted}
        named |= {"oid": np.array(named["oid"], np.int64)} if "oid" in named else {}
        yield _batch("face", scene, n, wanted, **named, **numbers("index", ("v1", "v2", "v3", "n1", "n2", "n3"), np.int64))
    if asked("line", "point") and (rest := every("rest")):
        corners, oid, material, v1, v2 = map(list, zip(*rest))
        full = [*wanted, *(c for c in ("kind",) if c not in wanted)]
        made = _batch("", scene, size("rest"), full, oid=oid, material=material, v1=v1, v2=v2)
        names = pa.array(["point" if k == 1 else "line" for k in corners])
        made = made.set_column(full.index("kind"), "kind", names)
        yield (made if kinds is None else made.filter(pa.array([x in kinds for x in names.to_pylist()]))).select(wanted)


#: Characters of text that are turned into rows at a time; a larger file is one turn.
_TURN = 4_000_000


def by_file(make):
    """Arrow batches of scene, text -> what make(scenes, files) yields, some files at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            scene, files, held = [], [], 0
            for name, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                t = text.as_py()
                scene.append(name)
                files.append(_File(t))
                held += len(t or "")
                if held > _TURN:
                    yield from make(scene, files)
                    scene, files, held = [], [], 0
            yield from make(scene, files)

    return run


def scan(files: DataFrame, kinds: list | None = None, columns: list | None = None) -> DataFrame:
    """files(scene, text) -> rows of SCHEMA. A file is one row and is parsed whole. Faces of more corners become fans; objects
    without faces are dropped and ids close up; lines that can't be read are left out.

    Spark can't see into a parser: who needs some kinds of elements or some columns only names them here, and no others are made.
    """
    wanted = [c for c in _TYPES if columns is None or c in columns]
    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in wanted)
    return files.select(F.col("scene").cast("string").alias("scene"), "text").mapInArrow(by_file(lambda scene, parsed: _rows(scene, parsed, kinds, wanted)), schema)


def corners(files: list[_File]) -> tuple[np.ndarray, ...]:
    """File, object, number and nine coordinates of each face in order, and its place in the files' materials; faces that name a vertex
    their file lacks are left out."""
    n_v, n_f = np.array([len(f.v) // 3 for f in files], np.int64), np.array([len(f.oid) for f in files], np.int64)
    index = np.fromiter(chain.from_iterable(f.index for f in files), np.int64).reshape(-1, 6)[:, :3]
    of = np.repeat(np.arange(len(files)), n_f)
    fid = np.arange(len(index)) - (np.cumsum(n_f) - n_f)[of]
    keep = np.flatnonzero(((index >= 0) & (index < n_v[of][:, None])).all(1))
    place = np.fromiter(chain.from_iterable(f.v for f in files), float).reshape(-1, 3)
    c = place[(index + (np.cumsum(n_v) - n_v)[of][:, None])[keep]].reshape(-1, 9)
    return of[keep], np.fromiter(chain.from_iterable(f.oid for f in files), np.int64)[keep], fid[keep], c, keep


_HELD = ("v1", "v2", "v3", "n1", "n2", "n3", "x", "y", "z")
_ELEMENT = "struct<part:int,o:bigint,idx:bigint,material:string,v1:bigint,v2:bigint,v3:bigint,n1:bigint,n2:bigint,n3:bigint,x:double,y:double,z:double>"


def _elements(files: list[_File]) -> pa.ListArray:
    """Each file's elements in the order that to_text writes: vertices, normals, faces, lines and points."""
    blocks = []

    def add(part, size, **columns):
        n = int(np.sum(size))
        if n:
            idx = columns.pop("idx", None)
            idx = np.arange(n) - np.repeat(np.cumsum(size) - size, size) if idx is None else idx
            kinds = {"part": pa.int32(), "o": pa.int64(), "idx": pa.int64(), **{c: _TYPES[c] for c in ("material", *_HELD)}}
            columns = {"o": np.full(n, -1), **columns, "part": np.full(n, part, np.int32), "idx": idx}
            blocks.append((np.repeat(np.arange(len(files)), size), [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]))

    numbers = lambda name, width, kind: np.fromiter(chain.from_iterable(getattr(f, name) for f in files), kind).reshape(-1, width).T
    of = lambda name, width=1: np.array([len(getattr(f, name)) // width for f in files], np.int64)
    for part, name in ((1, "v"), (2, "n")):
        add(part, of(name, 3), **dict(zip("xyz", numbers(name, 3, float))))
    add(3, of("oid"), o=numbers("oid", 1, np.int64)[0], material=[m for f in files for m in f.material], **dict(zip(_HELD[:6], numbers("index", 6, np.int64))))
    for part, corners in ((4, 2), (5, 1)):
        own = [[(i, *r[2:]) for i, r in enumerate(f.rest) if r[0] == corners] for f in files]
        idx, material, v1, v2 = map(list, zip(*(r for x in own for r in x))) if any(own) else ([],) * 4
        add(part, np.array([len(x) for x in own], np.int64), idx=idx, material=material, v1=v1, v2=v2)
    names = [x.split(":")[0] for x in _ELEMENT[7:-1].split(",")]
    if not blocks:
        made, size = pa.StructArray.from_arrays([pa.nulls(0, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3)], names), np.zeros(len(files), np.int64)
    else:
        at = np.concatenate([b[0] for b in blocks])
        order = pa.array(np.argsort(at, kind="stable"))
        made = pa.StructArray.from_arrays([pa.concat_arrays(c).take(order) for c in zip(*(b[1] for b in blocks))], names)
        size = np.bincount(at, minlength=len(files))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), made)


def _parsed(rb: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, list[_File]]]:
    """Rows of a batch and their files, some at a time."""
    lo, held, files = 0, 0, []
    for i, t in enumerate(rb.column(text)):
        files.append(_File(t.as_py()))
        held += len(t.as_py() or "")
        if held > _TURN:
            yield lo, i + 1, files
            lo, held, files = i + 1, 0, []
    if files:
        yield lo, rb.num_rows, files


def gathered(files: DataFrame) -> DataFrame:
    """files(scene, text) -> scene, e: a file's elements as an array, in the order that it would be written in."""

    def run(it):
        for rb in it:
            for lo, hi, parsed in _parsed(rb, 1):
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(lo, hi - lo), _elements(parsed)], ["scene", "e"])

    return files.select(F.col("scene").cast("string").alias("scene"), "text").mapInArrow(run, f"scene string, e array<{_ELEMENT}>")


def same_as_text(held: DataFrame) -> DataFrame:
    """scene, n_faces, same of held(scene, e, text): whether text holds the elements e, in order, with places to four digits."""

    def run(it):
        for rb in it:
            for lo, hi, parsed in _parsed(rb, 2):
                want, got = rb.column(1).slice(lo, hi - lo), _elements(parsed)
                size = [np.diff(x.offsets.to_numpy()) for x in (want, got)]
                of = [np.repeat(np.arange(hi - lo), n) for n in size]
                same = size[0] == size[1]
                a, b = (x.flatten().filter(pa.array(same[o])) for x, o in zip((want, got), of))
                bad = np.zeros(len(a), bool)
                for x, y in zip(a.flatten(), b.flatten()):
                    if pa.types.is_floating(x.type):
                        x, y = pc.round(x, 4), pc.round(y, 4)
                    equal = pc.fill_null(pc.equal(x, y), False)
                    bad |= ~pc.or_(equal, pc.and_(x.is_null(), y.is_null())).to_numpy(zero_copy_only=False)
                same[of[0][same[of[0]]][bad]] = False
                faces = np.bincount(of[0], want.flatten().field("part").to_numpy() == 3, hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(lo, hi - lo), pa.array(faces), pa.array(same)], ["scene", "n_faces", "same"])

    return held.select("scene", "e", "text").mapInArrow(run, "scene string, n_faces long, same boolean")


def _triangles(scene: list, files: list[_File]) -> Iterator[pa.RecordBatch]:
    of, oid, fid, c, keep = corners(files)
    if not len(of):
        return
    material = pa.array([m for f in files for m in f.material], pa.string()).take(pa.array(keep))
    rows = pa.ListArray.from_arrays(np.arange(0, c.size + 1, 9, dtype=np.int32), pa.array(c.reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(scene, pa.string()).take(pa.array(of)), pa.array(oid), material, pa.array(fid), rows], ["scene", "oid", "material", "fid", "c"])


def triangles(files: DataFrame) -> DataFrame:
    """files(scene, text) -> scene, oid, material, fid, c (nine coordinates) of each face. Corners are looked up where the file is
    parsed, so nothing is joined or shuffled; faces that name a vertex their file lacks are left out."""
    return files.select(F.col("scene").cast("string").alias("scene"), "text").mapInArrow(by_file(_triangles), "scene string, oid long, material string, fid long, c array<double>")


def mesh_points(elements: DataFrame) -> DataFrame:
    """scene, fid, oid, material, corner, x, y, z: each face's corners in order (PR6). Vertices are never broadcast: a text's size
    says little about its rows, and by that estimate Spark would send all of them through the driver."""
    face = elements.filter("kind = 'face'").select("scene", F.col("idx").alias("fid"), "oid", "material", F.posexplode(F.array("v1", "v2", "v3")).alias("corner", "vid"))
    vertex = elements.filter("kind = 'vertex'").select("scene", F.col("idx").alias("vid"), "x", "y", "z")
    return face.join(vertex.hint("merge"), ["scene", "vid"]).drop("vid")


def face_normals(faces: DataFrame) -> DataFrame:
    """scene, fid and the unit normal of each triangle; faces as `triangles` gives them (IO7)."""
    from meshloom.functions import geometry as G

    at = lambda i: tuple(F.col("c")[3 * i + k] for k in range(3))
    normal = G.unit(G.cross(G.sub(at(1), at(0)), G.sub(at(2), at(0))))
    return faces.select("scene", "fid", *[x.alias(f"n{a}") for a, x in zip("xyz", normal)])


def material_index(elements: DataFrame) -> DataFrame:
    """material, type: 0 for the default, then by name over all scenes (IO8)."""
    m = elements.filter("kind = 'face'").select("material").distinct()
    return m.withColumn("type", F.row_number().over(Window.orderBy(F.col("material") != DEFAULT, "material")).cast("long") - F.lit(1))


_COLOURS = ("Kd", "Ks", "Ka", "Ke")


def parse_mtl(text: str) -> list[tuple]:
    """(name, kd, ks, ka, ke, ns, ni, refractive) of each material; illumination models above 3 refract (IO9)."""
    out: list[list] = []
    for line in (text or "").splitlines():
        words = re.sub(r"#.*$", "", line).split()
        if not words:
            continue
        key, args = words[0], words[1:]
        try:
            if key == "newmtl" and args:
                out.append([args[0], None, None, None, None, None, None, False])
            elif out and key in _COLOURS and len(args) >= 3:
                out[-1][1 + _COLOURS.index(key)] = list(map(float, args[:3]))
            elif out and key in ("Ns", "Ni") and args:
                out[-1][5 if key == "Ns" else 6] = float(args[0])
            elif out and key == "illum" and args:
                out[-1][7] = int(args[0]) > 3
        except ValueError:
            continue
    return [tuple(x) for x in out]


def scan_mtl(files: DataFrame) -> DataFrame:
    """files(scene, text) -> scene and the fields of each material, a batch of files at a time."""
    three = pa.list_(pa.float64())
    names = ("name", "kd", "ks", "ka", "ke", "ns", "ni", "refractive")
    kinds = (pa.string(), three, three, three, three, pa.float64(), pa.float64(), pa.bool_())

    def run(it):
        for rb in it:
            found = [(scene, *m) for scene, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()) for m in parse_mtl(text)]
            cols = list(zip(*found)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], ["scene", *names])

    fields = "name string, kd array<double>, ks array<double>, ka array<double>, ke array<double>, ns double, ni double, refractive boolean"
    return files.select(F.col("scene").cast("string").alias("scene"), "text").mapInArrow(run, f"scene string, {fields}")


def mtl_text(materials: DataFrame) -> DataFrame:
    """scene, text: the materials of each scene as MTL, by name (IO13). Fields that are null are left out."""
    colour = lambda c: F.concat(F.lit(f"{c} "), F.array_join(F.transform(c.lower(), lambda x: F.format_string("%.6f", x)), " "))
    number = lambda c: F.concat(F.lit(f"{c} "), F.format_string("%.6f", F.col(c.lower())))
    illum = F.concat(F.lit("illum "), F.when(F.col("refractive"), "4").otherwise("2"))
    one = F.concat_ws("\n", F.concat(F.lit("newmtl "), F.col("name")), *[F.when(F.col(c.lower()).isNotNull(), colour(c)) for c in _COLOURS], *[F.when(F.col(c.lower()).isNotNull(), number(c)) for c in ("Ns", "Ni")], illum)
    return materials.groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def to_text(elements: DataFrame, library: str | None = None) -> DataFrame:
    """scene, text: each scene as an OBJ file, objects in order of id, then lines and points (IO13). A scene's elements meet in one
    row, as in its file, as numbers; they become text there, so no text is shuffled. usemtl stands where the material changes."""
    part = F.when(F.col("kind") == "vertex", 1).when(F.col("kind") == "normal", 2).when(F.col("kind") == "face", 3).when(F.col("kind") == "line", 4).when(F.col("kind") == "point", 5)
    e = F.struct(part.alias("part"), F.when(part == 3, F.col("oid")).otherwise(-1).alias("o"), "idx", "material", *_HELD)
    every = elements if library else elements.filter(part.isNotNull())
    held = every.groupBy("scene").agg(F.array_sort(F.collect_list(F.when(part.isNotNull(), e))).alias("e"))
    return held.select("scene", text_of(library).alias("text"))


def text_of(library: str | None = None) -> Column:
    """The OBJ text of a scene's elements e, which stand in order (see to_text)."""
    num = lambda c: F.format_string("%.12g", c)
    corner = lambda x, i: F.concat((x[f"v{i}"] + 1).cast("string"), F.when(x[f"n{i}"] >= 0, F.concat(F.lit("//"), (x[f"n{i}"] + 1).cast("string"))).otherwise(F.lit("")))
    plain = lambda x, i: (x[f"v{i}"] + 1).cast("string")
    use = lambda x: F.concat(F.lit("usemtl "), x["material"], F.lit("\n"))

    def line(x, i):
        before = F.get("e", i - 1)
        first = (i == 0) | (before["part"] < 3) | (before["o"] != x["o"])
        opens = F.when(first, F.concat(F.lit("o part"), x["o"].cast("string"), F.lit("\n"))).otherwise(F.lit(""))
        turns = F.when(first | ~before["material"].eqNullSafe(x["material"]), use(x)).otherwise(F.lit(""))
        place = lambda word: F.concat_ws(" ", F.lit(word), num(x["x"]), num(x["y"]), num(x["z"]))
        face = F.concat(opens, turns, F.concat_ws(" ", F.lit("f"), *[corner(x, k) for k in (1, 2, 3)]))
        rest = F.when(x["part"] == 4, F.concat(use(x), F.concat_ws(" ", F.lit("l"), plain(x, 1), plain(x, 2)))).otherwise(F.concat(use(x), F.concat_ws(" ", F.lit("p"), plain(x, 1))))
        return F.when(x["part"] == 1, place("v")).when(x["part"] == 2, place("vn")).when(x["part"] == 3, face).otherwise(rest)

    lines = F.transform("e", line)
    if library:
        lines = F.concat(F.array(F.lit(f"mtllib {library}")), lines)
    return F.array_join(lines, "\n")


def flagged_edges(pairs: DataFrame, flagged: DataFrame) -> DataFrame:
    """The edges of pairs(scene, src, dst, ...) with an end in flagged(scene, node) (IO16)."""
    f = flagged.select("scene", "node").distinct()
    ends = pairs.select("scene", "src", "dst", F.explode(F.array("src", "dst")).alias("node")).join(f, ["scene", "node"], "left_semi")
    return pairs.join(ends.select("scene", "src", "dst").distinct(), ["scene", "src", "dst"], "left_semi")


def graph_text(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """scene, text: a collision graph as OBJ points and lines, tree edges and cycle edges as groups (IO15). nodes(scene, node, x, y, z), pairs(scene, src, dst, kind)."""
    at = nodes.withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("node")))
    v = at.select("scene", F.lit(0).alias("part"), F.col("i").cast("long").alias("k"), F.format_string("v %.12g %.12g %.12g", "x", "y", "z").alias("t"))
    a, b = (at.select("scene", F.col("node").alias(c), F.col("i").alias(f"{c}_i")) for c in ("src", "dst"))
    e = pairs.filter("src < dst").join(a, ["scene", "src"]).join(b, ["scene", "dst"])
    e = e.select("scene", F.col("kind").alias("part"), (F.col("src_i") * 1_000_000 + F.col("dst_i")).cast("long").alias("k"), F.format_string("l %d %d", "src_i", "dst_i").alias("t"))
    return v.unionByName(e).groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "t"))), lambda x: x["t"]), "\n").alias("text"))


def _numbers(i: int):
    return F.split(F.trim(F.col("l")[i]), r"\s+")


def parse_wire(text: DataFrame) -> DataFrame:
    """scene, g (0 to 2), src, dst, category from nine lines of numbers: three graphs of sources, targets and categories (IO26)."""
    ln = text.select("scene", F.split("text", "\n").alias("l"))
    out = None
    for g in range(3):
        z = F.zip_with(F.zip_with(_numbers(3 * g), _numbers(3 * g + 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))), _numbers(3 * g + 2), lambda e, c: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), c.alias("category")))
        part = ln.select("scene", F.lit(g).alias("g"), F.explode(z).alias("e")).select("scene", "g", *[F.col("e")[c].cast("long").alias(c) for c in ("src", "dst", "category")])
        out = part if out is None else out.unionByName(part)
    return out


def phong(kd: Column, ks: Column, ns: Column) -> tuple[Column, Column]:
    """Diffuse and specular coefficients (arrays of three) scaled so that together they reflect no more than all light (IO11)."""
    top, pi = F.lit(0.99), F.lit(3.141592653589793)
    spec = F.zip_with(ks, kd, lambda s, d: F.least(s, top - F.least(top, d)) * (ns + 2) * 0.5 / pi)
    return F.transform(kd, lambda d: F.least(d, top) / pi), spec


_ROWS = ("m_row_0", "m_row_1", "m_row_2")


def scan_instances(files: DataFrame) -> DataFrame:
    """scene, place, object, m (twelve numbers, row by row), lo, hi of the instance records in files(scene, text) (IO12). A record
    begins with its object's id; rows that lack give the identity, bounds that lack are null."""
    clean = F.regexp_replace("text", "(?m)#.*$", "")
    records = F.split(clean, r"(?m)^\s*obj_id\s+")
    parts = F.slice(records, F.lit(2), F.size(records))
    rec = files.select("scene", F.posexplode(parts).alias("place", "r"))
    nums = lambda k: F.transform(F.split(F.trim(F.regexp_extract("r", rf"(?m)^\s*{k}[ \t]+(.*)$", 1)), r"\s+"), lambda x: x.cast("double"))
    has = lambda k: F.col("r").rlike(rf"(?m)^\s*{k}[ \t]")
    rows = [F.when(has(k), nums(k)).otherwise(F.array(*[F.lit(1.0 if j == i else 0.0) for j in range(4)])) for i, k in enumerate(_ROWS)]
    bound = lambda k: F.when(has(k), nums(k))
    first = F.regexp_extract("r", r"^(\d+)", 1).cast("long")
    return rec.select("scene", F.col("place").cast("long").alias("place"), first.alias("object"), F.concat(*rows).alias("m"), bound("AABB_min").alias("lo"), bound("AABB_max").alias("hi"))


def instance_text(instances: DataFrame) -> DataFrame:
    """scene, text: instance records in order of place (IO14)."""
    line = lambda k, c: F.concat(F.lit(f"{k} "), F.array_join(F.transform(c, lambda x: F.format_string("%.9g", x)), " "))
    m = [line(k, F.slice("m", 4 * i + 1, 4)) for i, k in enumerate(_ROWS)]
    one = F.concat_ws("\n", F.lit("#new instance#"), F.concat(F.lit("obj_id "), F.col("object").cast("string")), *m, line("AABB_min", F.col("lo")), line("AABB_max", F.col("hi")))
    return instances.groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def flat_index(elements: DataFrame) -> DataFrame:
    """scene, id, vertex: the vertices that faces name one after the other, or lines where a scene has no faces, or points (PR9)."""
    size = F.when(F.col("kind") == "face", 3).when(F.col("kind") == "line", 2).otherwise(1)
    use = elements.filter("kind IN ('face', 'line', 'point')").withColumn("size", size)
    top = use.groupBy("scene").agg(F.max("size").alias("top"))
    use = use.join(top, "scene").filter("size = top")
    at = F.row_number().over(Window.partitionBy("scene").orderBy("idx")) - 1
    flat = use.withColumn("at", at).select("scene", "at", "size", F.posexplode(F.slice(F.array("v1", "v2", "v3"), F.lit(1), F.col("size"))).alias("p", "vertex"))
    return flat.select("scene", (F.col("at") * F.col("size") + F.col("p")).cast("long").alias("id"), "vertex")

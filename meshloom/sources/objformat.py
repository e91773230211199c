"""OBJ folders as a Spark data source: spark.read.format("obj") and df.write.format("obj") (IO1-IO6, IO10, IO13, IO17).

A scene is a file; its name is the file's path below the folder, without the ending. Rows are elements:

kind      idx           further columns
vertex    place         x, y, z
normal    place         x, y, z
texcoord  place         x, y (u and v)
face      place         oid, material, v1-v3, t1-t3, n1-n3 (from 0, -1 where the file names none)
line      place         oid, material, v1-v2, t1-t2, n1-n2
point     place         oid, material, v1, t1, n1
object    oid           v1, v2: the half-open range of its faces
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_CORNERS = [f"{c}{i}" for c in "vtn" for i in (1, 2, 3)]
SCHEMA = "scene string, kind string, idx long, oid long, material string, x double, y double, z double, " + ", ".join(f"{c} long" for c in _CORNERS)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]
#: In a file, kinds stand in this order; objects have no line of their own but o.
KINDS = ("vertex", "normal", "texcoord", "face", "line", "point", "object")
DEFAULT = "Default"
#: Rows of a batch.
ROWS = 20_000


def _corner(word: str, sizes: tuple[int, int, int]) -> list[int]:
    """v, t, n of a corner from 0, -1 where it names none; a negative place counts back from the last element read."""
    out = [-1, -1, -1]
    for i, s in enumerate(word.split("/")):
        if s or i == 0:
            out[i] = int(s) - 1 if int(s) > 0 else sizes[i] + int(s)
    return out


def elements(scene: str, lines: Iterable[str]) -> Iterator[tuple]:
    """Rows of SCHEMA for the lines of one file, as they come; a line that can't be read gives none.

    Faces of more corners become fans. An object ends at the next o if it has faces by then, and one always ends with the
    file, faces or not, so ids are dense.
    """
    n = dict.fromkeys(KINDS, 0)
    oid, begin, material = 0, 0, DEFAULT
    none = (None,) * 9

    def row(kind, mine, xyz, corners):
        n[kind] += 1
        return (scene, kind, n[kind] - 1, oid if mine else None, material if mine else None, *xyz, *corners)

    for line in lines:
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        key, args = words[0].lower(), words[1:]
        try:
            if key in ("v", "vn") and len(args) == 3:
                yield row("vertex" if key == "v" else "normal", False, map(float, args), none)
            elif key == "vt" and 2 <= len(args) <= 4:
                yield row("texcoord", False, (*[float(a) for a in args][:2], None), none)
            elif key in ("f", "fo", "l", "lo", "p") and args:
                at = [_corner(a, (n["vertex"], n["texcoord"], n["normal"])) for a in args]
                if len(at) < 3:
                    at += [[None] * 3] * (3 - len(at))
                    yield row("point" if len(args) == 1 else "line", True, (None,) * 3, (c[k] for k in range(3) for c in at))
                else:
                    for i in range(1, len(at) - 1):
                        yield row("face", True, (None,) * 3, (c[k] for k in range(3) for c in (at[0], at[i], at[i + 1])))
            elif key == "o" and n["face"] > begin:
                yield (scene, "object", oid, oid, None, None, None, None, begin, n["face"], *[None] * 7)
                oid, begin = oid + 1, n["face"]
            elif key == "usemtl" and args:
                material = " ".join(args)
        except (ValueError, IndexError):
            continue
    yield (scene, "object", oid, oid, None, None, None, None, begin, n["face"], *[None] * 7)


def _files(path: str):
    """The file system of a path or uri, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][\w+.-]*:", path) else posixpath.abspath(path))


@dataclass
class _Group(InputPartition):
    """Files that one task reads: (scene, path)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class ObjReader(DataSourceReader):
    """One partition per group of files of about maxPartitionBytes. Rows of other kinds than those asked for aren't built."""

    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the obj format needs a path")
        self.ending = options.get("ending", ".obj")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.most = int(options.get("maxpartitionbytes", options.get("maxPartitionBytes", 64 << 20)))
        self.kinds = set(options["kinds"].split(",")) if options.get("kinds") else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.path)
        one = system.get_file_info(root)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        base = posixpath.dirname(root) if one.type == fs.FileType.File else root
        found = []
        for f in sorted(infos, key=lambda f: f.path):
            name = posixpath.relpath(f.path, base)
            hidden = any(p.startswith(("_", ".")) for p in name.split("/"))
            if f.type != fs.FileType.File or hidden or not name.endswith(self.ending) or name.endswith(f"_coll_graph{self.ending}"):
                continue
            found.append((f.size or 0, name.removesuffix(self.ending), f.path))
        groups, size = [_Group()], 0
        for n, scene, path in found:
            if groups[-1].files and size + n > self.most:
                groups.append(_Group())
                size = 0
            groups[-1].files.append((scene, path))
            size += n
        return groups

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        held: list[tuple] = []
        for scene, path in partition.files:
            with system.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8", "replace", newline="\n") as text:
                for r in elements(scene, text):
                    if self.kinds is None or r[1] in self.kinds:
                        held.append(r)
                        if len(held) == ROWS:
                            yield _batch(held)
                            held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


@dataclass
class _Written(WriterCommitMessage):
    """Scenes that a task wrote, and the folder that holds them until the commit."""

    folder: str
    scenes: list[str]


class ObjWriter(DataSourceArrowWriter):
    """A file per scene. Tasks write below _temporary; the commit moves their files into place, and an abort deletes them.

    A task's rows come scene by scene and within a scene by kind, as save() orders them; others are refused, so no
    scene is held in memory.
    """

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.ending, self.library, self.overwrite = options.get("path"), options.get("ending", ".obj"), options.get("library"), overwrite
        missing = [c for c in _NAMES if c not in columns]
        if not self.path or missing:
            raise ValueError(f"the obj format needs a path and the columns {missing}")
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _files(self.path)
        folder = f"{self.job}/{uuid.uuid4().hex}"
        done, written, out, now, state = set(), [], None, None, None
        try:
            for rb in iterator:
                for r in zip(*(rb.column(rb.schema.get_field_index(c)).to_pylist() for c in _NAMES)):
                    if r[0] != now:
                        if out:
                            out.close()
                        now, state = r[0], [0, None, None]  # kind, object and material of the line before
                        if now in done or now is None or any(p.startswith(("_", ".")) for p in now.split("/")):
                            raise ValueError(f"rows of scene {now!r} don't stand together, or its name is no file's")
                        done.add(now)
                        out = None
                    line = _line(r, state)
                    if line and not out:
                        at = f"{root}/{folder}/{now}{self.ending}"
                        system.create_dir(posixpath.dirname(at), recursive=True)
                        out = io.TextIOWrapper(io.BufferedWriter(system.open_output_stream(at), 1 << 20), "utf-8")
                        written.append(now)
                        if self.library:
                            out.write(f"mtllib {self.library}\n")
                    if line:
                        out.write(line)
        finally:
            if out:
                out.close()
        return _Written(folder, written)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, root = _files(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
                if f.type == fs.FileType.File and f.path.endswith(self.ending) and not posixpath.relpath(f.path, root).startswith("_temporary/"):
                    system.delete_file(f.path)
        for m in messages:
            for scene in m.scenes if m else ():
                to = f"{root}/{scene}{self.ending}"
                system.create_dir(posixpath.dirname(to), recursive=True)
                system.move(f"{root}/{m.folder}/{scene}{self.ending}", to)
        self._clear(system, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")
        if not system.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
            if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/_temporary")


def _line(r: tuple, state: list) -> str:
    """An element's line, with o and usemtl lines before it where object or material change."""
    _, kind, _, oid, material, x, y, z, *c = r
    rank = KINDS.index(kind)
    if rank < state[0]:
        raise ValueError(f"a {kind} comes after a {KINDS[state[0]]}; save() puts elements in order")
    state[0] = rank
    if kind in ("vertex", "normal", "texcoord"):
        return {"vertex": "v", "normal": "vn", "texcoord": "vt"}[kind] + "".join(f" {float(a):.12g}" for a in (x, y, z) if a is not None) + "\n"
    if kind == "object":
        return ""
    head = ""
    if kind == "face" and oid != state[1]:
        head, state[1] = f"o {oid}\n", oid
    if (material or DEFAULT) != state[2]:
        state[2] = material or DEFAULT
        head += f"usemtl {state[2]}\n"
    corners = []
    for i in range({"face": 3, "line": 2, "point": 1}[kind]):
        v, t, n = (c[3 * k + i] for k in range(3))
        t, n = ("" if a is None or a < 0 else str(a + 1) for a in (t, n))
        corners.append(f"{v + 1}" + (f"/{t}/{n}" if n else f"/{t}" if t else ""))
    return f"{head}{kind[0]} {' '.join(corners)}\n"


class ObjDataSource(DataSource):
    """Options: path; ending (.obj); recursive (true); maxPartitionBytes of a reading task; kinds, the elements to read, with
    commas between; library, named in files that are written."""

    @classmethod
    def name(cls) -> str:
        return "obj"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjReader:
        return ObjReader(self.options)

    def writer(self, schema, overwrite: bool) -> ObjWriter:
        return ObjWriter(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format obj known to a session."""
    spark.dataSource.register(ObjDataSource)


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The elements of all OBJ files in a folder and those below it, but for exported collision graphs."""
    register(spark)
    return spark.read.format("obj").options(**options).load(path)


def save(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Writes elements as a file per scene. A scene goes to one task, as a file has one writer; scenes are spread over tasks.

    Columns of SCHEMA that df lacks are null. Object rows have no line of their own: an object without faces is not written.
    """
    register(df.sparkSession)
    full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in SCHEMA.split(", "))])
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    full.repartition("scene").sortWithinPartitions("scene", rank, F.when(F.col("kind") == "face", F.col("oid")), "idx").write.format("obj").mode(mode).options(**options).save(path)

"""OBJ folders, contacts, forests, mean shift, exemplars and the word checker, each against plain Python."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import words as W
from meshloom.functions.frames import triangles_meet
from meshloom.operators import category, collide, exemplar, forest, words
from meshloom.sources import objformat

TEXT = """# made up
mtllib some.mtl
v 0 0 0
v 1 0 0 # a corner
  v 0 1 0
V 0 0 1
v 1 2
v 1 2 3 4
vt 0.5 0.25 7
vn 0 0 1
g group
s off
o empty at first
o first
usemtl red paint
f 1 2 3
f 1/1 2/1 3/1
f 1//1 2//1 4//1
fo 1/1/1 2/1/1 3/1/1 4/1/1
f 1 x 2
f
l 1/1 2/1
p 3
wobble 1
o second
f -4 -3 -1
o last
"""


def files_of(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_obj_lines():
    rows = list(objformat.elements("s", TEXT.splitlines(True)))
    kinds = Counter(r[1] for r in rows)
    assert kinds == {"vertex": 4, "texcoord": 1, "normal": 1, "face": 6, "line": 1, "point": 1, "object": 3}
    face = [r[2:5] + r[8:] for r in rows if r[1] == "face"]
    red = "red paint"
    assert face == [
        (0, 0, red, 0, 1, 2, -1, -1, -1, -1, -1, -1), (1, 0, red, 0, 1, 2, 0, 0, 0, -1, -1, -1), (2, 0, red, 0, 1, 3, -1, -1, -1, 0, 0, 0),
        (3, 0, red, 0, 1, 2, 0, 0, 0, 0, 0, 0), (4, 0, red, 0, 2, 3, 0, 0, 0, 0, 0, 0), (5, 1, red, 0, 1, 3, -1, -1, -1, -1, -1, -1),
    ]
    assert [r[2:3] + r[8:10] for r in rows if r[1] == "object"] == [(0, 0, 5), (1, 5, 6), (2, 6, 6)]  # the last one is empty
    assert [r[8:12] for r in rows if r[1] == "line"] == [(0, 1, None, 0)] and [r[8] for r in rows if r[1] == "point"] == [2]
    assert [r[5:8] for r in rows if r[1] == "texcoord"] == [(0.5, 0.25, None)]
    assert [r[1:10] for r in objformat.elements("s", [])] == [("object", 0, 0, None, None, None, None, 0, 0)]


def test_obj_folder(spark, tmp_path):
    """Folders below are read, exported graphs and hidden files are not; written folders give the same elements."""
    root = str(tmp_path / "in")
    for name, text in {"a.obj": TEXT, "b/c.obj": "v 1 2 3\n", "b/a_coll_graph.obj": TEXT, "b/x.txt": TEXT, ".hidden.obj": TEXT, "_temporary/z.obj": TEXT, "b/empty.obj": "", "odd name#1.obj": "v 1 1 1 # \xff\n"}.items():
        write(root, name, text)
    got = objformat.load(spark, root, maxPartitionBytes="10")
    assert {r.scene: r.n for r in got.groupBy("scene").agg(F.count("*").alias("n")).collect()} == {"a": 17, "b/c": 2, "b/empty": 1, "odd name#1": 2}
    assert got.rdd.getNumPartitions() > 1 and objformat.load(spark, root).rdd.getNumPartitions() == 1
    assert {r.scene for r in objformat.load(spark, root, recursive="false").collect()} == {"a", "odd name#1"}
    assert objformat.load(spark, f"{root}/b/c.obj").filter("kind = 'vertex'").count() == 1
    assert {r.kind for r in objformat.load(spark, root, kinds="face,line").collect()} == {"face", "line"} and got.filter("scene = 'a' AND kind = 'face'").count() == 6
    out = str(tmp_path / "out")
    objformat.save(got.repartition(3), out, library="x.mtl")
    assert files_of(out) == ["a.obj", "b/c.obj", "odd name#1.obj"]  # an object without elements writes no line, so no file
    key = [c for c in got.columns if c != "oid"]
    real = lambda df: sorted(map(str, df.filter("kind <> 'object'").select(key).collect()))
    assert real(objformat.load(spark, out)) == real(got)
    with open(f"{out}/a.obj") as f:
        lines = f.read().splitlines()
    assert lines[0] == "mtllib x.mtl" and "f 1//1 2//1 4//1" in lines and "f 1/1 2/1 3/1" in lines and lines.count("usemtl red paint") == 1
    objformat.save(got.filter("scene = 'b/c'"), out, mode="append")
    assert len(files_of(out)) == 3
    objformat.save(got.filter("scene = 'b/c'"), out)
    assert files_of(out) == ["b/c.obj"]
    objformat.save(got.filter("scene = 'none'"), out)
    assert files_of(out) == []


def test_obj_write_that_fails_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = objformat.load(spark, _folder_with(tmp_path, "v 1 2 3\nf 1 1 1\n"))
    objformat.save(frame, out)
    before = files_of(out)
    wrong = frame.filter("kind <> 'object'").coalesce(1).orderBy(F.col("kind"))  # faces before vertices
    with pytest.raises(Exception, match="comes after"):
        wrong.coalesce(1).write.format("obj").mode("overwrite").save(out)
    assert files_of(out) == before and not os.path.exists(f"{out}/_temporary")
    with pytest.raises(Exception, match="columns"):
        frame.select("scene", "kind").write.format("obj").mode("append").save(out)
    with pytest.raises(Exception, match="(?i)not ?found|missing"):
        objformat.load(spark, str(tmp_path / "missing")).count()


def _folder_with(tmp_path, text):
    write(str(tmp_path / "one"), "s.obj", text)
    return str(tmp_path / "one")


def triangles(seed, n_objects, per, spread, size=1.0, whole=False):
    r = random.Random(seed)
    out = []
    for o in range(n_objects):
        centre = [r.uniform(0, spread) for _ in range(3)]
        for _ in range(per):
            c = [[centre[i] + r.uniform(-size, size) for i in range(3)] for _ in range(3)]
            out.append((o, [float(round(x)) if whole else x for v in c for x in v]))
    return out


def brute_contacts(tri):
    c, o = np.array([t[1] for t in tri]).reshape(-1, 3, 3), np.array([t[0] for t in tri])
    a, b = np.triu_indices(len(tri), 1)
    keep = o[a] != o[b]
    a, b = a[keep], b[keep]
    near = ((c[a].min(1) <= c[b].max(1)) & (c[b].min(1) <= c[a].max(1))).all(1)  # triangles without extent have no normal that parts them
    ok = near & triangles_meet(c[a], c[b])
    return {p for x, y in zip(o[a][ok].tolist(), o[b][ok].tolist()) for p in ((x, y), (y, x))}


FACES = "scene string, oid long, fid long, c array<double>"


def test_exact_contacts(spark):
    """Spread scenes, one whose triangles all lie in one cell, whole-number ties, a large triangle among small ones, flat and single-object scenes."""
    scenes = {"spread": triangles(1, 30, 4, 12.0), "hot": triangles(2, 12, 5, 0.1), "ties": triangles(3, 20, 3, 6.0, whole=True), "ground": triangles(4, 25, 3, 20.0) + [(99, [-50.0, -50.0, 0.0, 50.0, -50.0, 0.0, 0.0, 90.0, 20.0])]}
    scenes["flat"] = [(o, [x if i % 3 < 2 else 0.0 for i, x in enumerate(c)]) for o, c in triangles(5, 15, 2, 5.0)]
    scenes["single"] = [(0, c) for _, c in triangles(6, 1, 5, 1.0)]
    rows = [(s, o, i, c) for s, tri in scenes.items() for i, (o, c) in enumerate(tri)]
    faces = spark.createDataFrame(rows, FACES).repartition(3)
    want = {(s, *p) for s, tri in scenes.items() for p in brute_contacts(tri)}
    assert len(want) > 100 and not any(w[0] == "single" for w in want)
    for block in (4, 512):  # cells of more than four fragments are dealt into blocks
        watch = {}
        got = [tuple(r) for r in collide.collision_graph(faces, watch=watch, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert watch["contacts"].get["n_contacts"] * 2 == len(got) and watch["fragments"].get["n_fragments"] >= len(rows) - 5
    assert collide.collision_graph(faces.filter("oid < 0")).count() == 0


def test_near_contacts(spark):
    """Parts with triangles in one cell, against every cell of every triangle."""
    from meshloom.operators.spatial import meets_cells

    tau, want, rows = 0.1, set(), []
    for s, tri in {"a": triangles(7, 15, 3, 8.0), "b": triangles(8, 8, 2, 2.0)}.items():
        c = np.array([t[1] for t in tri]).reshape(-1, 3, 3)
        lo, hi = c.min((0, 1)), c.max((0, 1))
        cells = np.maximum(np.floor((hi - lo) / (np.linalg.norm(hi - lo) * 0.577350269 * tau)), 1)
        width = (hi - lo) / cells
        grid = np.array([(x, y, z) for x in range(-1, int(cells[0]) + 1) for y in range(-1, int(cells[1]) + 1) for z in range(-1, int(cells[2]) + 1)], float)
        holds = defaultdict(set)
        for (o, _), t in zip(tri, c):
            unit = np.broadcast_to((t - lo) / width, (len(grid), 3, 3))
            for g in grid[meets_cells(unit, grid + 0.5, np.full(3, 0.5))]:
                holds[tuple(g)].add(o)
        want |= {(s, p, q) for h in holds.values() for p in h for q in h if p != q}
        rows += [(s, o, i, x) for i, (o, x) in enumerate(tri)]
    got = [tuple(r) for r in collide.collision_graph(spark.createDataFrame(rows, FACES), tau, block=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    tree = set()
    for a, b in sorted({(min(e), max(e)) for e in edges if e[0] != e[1]}):
        if find(a) != find(b):
            root[find(b)] = find(a)
            tree.add((a, b))
    return tree, find


@pytest.mark.parametrize("kind", ["random", "path", "none"])
def test_voted_forest(spark, kind, monkeypatch):
    """The votes' forest is the one that edges in order give, for a thousand nodes, a path with a star at its end, and nothing."""
    r = random.Random(5)
    name = r.sample(range(40), 40)
    edges = {"random": [(r.randrange(1000), r.randrange(1000)) for _ in range(1500)], "path": list(zip(name, name[1:])) + [(name[0], x) for x in range(100, 120)], "none": []}[kind]
    frame = spark.createDataFrame(edges + edges[:50] + [(b, a) for a, b in edges[:20]], "src long, dst long")
    if kind == "path":  # beyond the size that is broadcast
        monkeypatch.setattr(forest, "LABELS", 10)
    rounds = 10  # the logarithm of a thousand
    tree, label = forest.voted_forest(frame, rounds)
    want, find = kruskal(edges)
    assert {tuple(x) for x in tree.collect()} == want
    groups = defaultdict(set)
    for x in label.collect():
        groups[x.root].add(x.node)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert sorted(map(sorted, groups.values())) == sorted(sorted(n for n in nodes if find(n) == f) for f in {find(n) for n in nodes})
    if kind == "path":
        kinds = {(x.src, x.dst): x.kind for x in forest.edge_kinds(frame).collect()}
        assert kinds == {(min(e), max(e)): 1 if (min(e), max(e)) in want else 2 for e in edges if e[0] != e[1]}


def plain_mean_shift(points, bandwidth, rounds=100):
    found = []
    for c in np.unique(np.round(points / bandwidth), axis=0) * bandwidth:
        for _ in range(rounds):
            near = points[((points - c) ** 2).sum(1) <= bandwidth**2]
            if not len(near):
                break
            new = near.mean(0)
            if ((new - c) ** 2).sum() < (1e-3 * bandwidth) ** 2:
                break
            c = new
        n = int((((points - c) ** 2).sum(1) <= bandwidth**2).sum())
        if n:
            found.append((n, tuple(np.round(c, 9))))
    out = []
    for _, c in sorted(set(found), key=lambda x: (-x[0], x[1])):
        if all(((np.array(c) - o) ** 2).sum() > bandwidth**2 for o in out):
            out.append(np.array(c))
    return np.array(out)


def test_mean_shift_by_joins(spark, monkeypatch):
    """A hot type pair, a single point, a pair without extent, and seeds beyond the size that is broadcast."""
    rng = np.random.Generator(np.random.PCG64(3))
    rows = []
    for pair, centres, n, size in [(("a", "b"), rng.uniform(-4, 4, (4, 3)), 60, 3.0), (("b", "a"), rng.uniform(-1, 1, (2, 3)), 9, 2.0), (("c", "c"), np.zeros((1, 3)), 1, 5.0)]:
        rows += [(i, *pair, *(centres[i % len(centres)] + rng.normal(0, 0.1, 3)).tolist(), size) for i in range(n)]
    rows += [(i, "d", "d", float(i % 2), 0.0, 0.0, 0.0) for i in range(4)]
    frame = spark.createDataFrame(rows, "src long, src_type string, dst_type string, x double, y double, z double, size double")
    want = {}
    for pair in {r[1:3] for r in rows}:
        mine = sorted([r for r in rows if r[1:3] == pair], key=lambda r: (r[0], *r[3:6]))
        p, size = np.array([r[3:6] for r in mine]), mine[0][6]
        least = max(Counter(r[0] for r in mine).values())
        c = category.merge_close(plain_mean_shift(p, 0.2 * size) if size else np.unique(p, axis=0), 0.25 * size, least)
        want[pair] = c[np.lexsort(c.T[::-1])]
    for seeds in (1_000_000, 5):
        monkeypatch.setattr(category, "SEEDS", seeds)
        got = defaultdict(dict)
        for r in category.edge_categories(frame).collect():
            got[r.src_type, r.dst_type][r.local_id] = (r.x, r.y, r.z)
        assert got.keys() == want.keys()
        for pair, c in want.items():
            assert np.allclose([got[pair][i] for i in range(len(got[pair]))], c, atol=1e-7), pair
    assert category.edge_categories(frame.filter("src < 0")).count() == 0


def test_best_exemplar(spark):
    r = random.Random(4)
    turn = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([r.gauss(0, 1) for _ in range(4)])
    pose = lambda: [round(r.choice([0.0, 5.0, 40.0]) + r.uniform(0, 0.6), 2) for _ in range(3)] + turn()
    lib = [(f"s{i % 3}", i, r.choice("ab"), r.choice("xy"), *pose()) for i in range(150)]
    lib += [(s, 1000 + i, "a", "x", *lib[0][4:]) for i, s in enumerate(["s0"] * 40 + ["s1"] * 40)] + [("far", 5000, "c", "x", 900.0, 0.0, 0.0, *turn()), ("s1", 5001, "d", "x", *pose())]
    asks = [(i, f"s{i % 3}", r.choice("abcd"), r.choice("xy"), *pose()) for i in range(80)] + [(500, "s1", "d", "x", *pose()), (501, "far", "c", "x", *pose())]
    cols = "src_type string, dst_type string, x double, y double, z double, rx double, ry double, rz double, rw double"
    frame = exemplar.library(spark.createDataFrame(lib, f"scene string, ex long, {cols}"))
    tol, want = 0.3, {}
    for i, scene, a, b, *p in asks:
        found = []
        for es, ex, ea, eb, *q in lib:
            if (ea, eb) == (a, b) and es != scene:
                found.append((round(math.dist(p[:3], q[:3]), 5), round(abs(abs(sum(x * y for x, y in zip(p[3:], q[3:]))) - 1), 5), ex))
        if found:
            least = min(found)[0]
            want[i] = min((dev, d, ex) for d, dev, ex in found if d < least + tol)
    got = {r.id: (r.dev, r.d, r.ex) for r in exemplar.best_match(spark.createDataFrame(asks, f"id long, scene string, {cols}"), frame, tol).collect()}
    assert got == want and 500 not in want and len(want) > 50
    points = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 3.0, 4.0, 0.0), ("b", 1.0, 1.0, 1.0)], "scene string, x double, y double, z double")
    assert exemplar.tolerance(points) == pytest.approx(0.05)


def recursive_needs(word):
    """The checker as a recursive grammar: node = character labels branches [node]."""
    if not word or word.count("(") != word.count(")") or any(word.count(d) % 2 for d in "0123456789"):
        return None
    items, first = set(), {}

    def node(i, parent):
        c = word[i] if i < len(word) else ""
        if not (c.isascii() and c.isalpha()):
            raise ValueError
        items.add("c" + c)
        degree, me, i = int(parent is not None), i, i + 1
        if parent is not None:
            items.add("p" + word[parent] + c)
        while i < len(word) and word[i] in "0123456789":
            j = i
            while j < len(word) and word[j] in "0123456789":
                j += 1
            degree += 1
            other = first.setdefault(int(word[i:j]), me)
            if other != me:
                items.add("p" + c + word[other])
            i = j + 1 if word[j : j + 1] == "%" else j
        while word[i : i + 1] == "(":
            degree += 1
            i = node(i + 1, me)
            if word[i : i + 1] != ")":
                raise ValueError
            i += 1
        if i < len(word) and word[i] != ")":
            degree += 1
            i = node(i, me)
        items.add(f"d{c}{degree}")
        return i

    try:
        return sorted(items) if node(0, None) == len(word) else None
    except ValueError:
        return None


def test_word_checker(spark):
    """Labels, labels that close on their own node, unknown characters, brackets of all sorts: as a recursive parser says."""
    r = random.Random(2)
    seen = Counter()
    found = ["A-B", "A?B", "A%B", "A*", "A(%B)B", "A1%1B", "A1%2B1C2", "A12B12", "A(B)", "A(B(C)D)E", "A((B))", "A()", ")A(", "(A)", "A1(B1)C", "A(B)1C1", "A11B", "A1%", "A1B1%", "", "1A1", "A(B)(C)"]
    found += ["".join(r.choice("AABBC()()11%?") for _ in range(r.randint(1, 9))) for _ in range(6000)]
    for w in found:
        assert W.needs(w) == recursive_needs(w), w
        seen[W.needs(w) is None] += 1
    assert min(seen.values()) > 300
    g = words.induce_words(spark.createDataFrame([("AB",), ("A1%1B",), ("A(B)C",)], "word string"))
    asked = ["AB", "BA", "A-B", "A?B", "A%B", "A*", "A(%B)B", "A1%1B", "AC", "CA", "B", "A(B)C", "A(C)B", None, "AB", "AD"]
    got = {r.word: r.ok for r in words.check_words(spark.createDataFrame([(w,) for w in asked], "word string"), g).collect()}
    assert {w for w, ok in got.items() if ok} == {"AB", "A1%1B", "A(B)C", "A(C)B", "BA", "AC", "CA"}


def test_merged_scenes_resolve_to_the_same_places(spark):
    """Chosen objects of two scenes, one moved; what no kept face names goes; null textures and normals stay null."""
    from meshloom.operators import merge

    first = "v 9 9 9\nv 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\nvt 0 0\nvt 1 1\nvn 1 0 0\no a\nusemtl m\nf 2/2/1 3/2/1 4/1/1\no b\nf 3 4 5\no c\nf 1 2 3\nf 5 4 3\n"
    second = "vn 0 1 0\nv 5 0 0\nv 6 0 0\nv 5 1 0\nv 7 7 7\no x\nf 1//1 2//1 3//1\no y\nf 4 4 4\n"
    cols = objformat.SCHEMA
    a, b = (spark.createDataFrame(list(objformat.elements("s", t.splitlines())), cols).repartition(3) for t in (first, second))
    keep = lambda *oids: spark.createDataFrame([("s", o) for o in oids], "scene string, oid long")
    half = math.sqrt(0.5)
    m = merge.merge_elements(a, b, keep(0, 2, 2), keep(0), (0.0, 0.0, half, half), (10.0, 0.0, 0.0)).collect()  # a quarter turn about z
    at = {(r.kind, r.idx): tuple(round(x, 6) + 0.0 for x in (r.x, r.y, r.z) if x is not None) for r in m if r.kind in ("vertex", "texcoord", "normal")}
    faces = sorted((r.idx, r.oid, r.material, [at["vertex", v] for v in (r.v1, r.v2, r.v3)], [at.get(("texcoord", t)) for t in (r.t1, r.t2, r.t3)], [at.get(("normal", n)) for n in (r.n1, r.n2, r.n3)]) for r in m if r.kind == "face")
    none = [None] * 3
    assert faces == [
        (0, 0, "m", [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(1, 1), (1, 1), (0, 0)], [(1, 0, 0)] * 3),
        (1, 1, "m", [(9, 9, 9), (0, 0, 0), (1, 0, 0)], none, none),
        (2, 1, "m", [(0, 0, 1), (0, 1, 0), (1, 0, 0)], none, none),
        (3, 2, "Default", [(10, 5, 0), (10, 6, 0), (9, 5, 0)], none, [(-1, 0, 0)] * 3),
    ]
    assert Counter(k for k, _ in at) == {"vertex": 8, "texcoord": 2, "normal": 2} and {i for k, i in at if k == "vertex"} == set(range(8))
    assert merge.merge_elements(a, b, keep(0).filter("oid < 0"), keep(0).filter("oid < 0")).count() == 0


def test_cut_matching_by_brute_force(spark):
    """Graphs that are no copies: every match of every sample, the first one from each of four starts, verified in pairs."""
    from itertools import permutations

    from meshloom.operators.variation import match_cuts

    r = random.Random(6)
    node = lambda i: (i, r.choice("aab"), *[float(r.randint(0, 3)) for _ in range(3)], r.choice([1.0, 2.0]))
    graphs = {g: [node(10 * i + g) for i in range(7)] for g in range(3)}
    samples = {s: (s % 4, [node(i)[:5] for i in range(r.choice([1, 2, 3, 3, 4]))]) for s in range(40)}
    tol, want = 0.5, set()
    for s, (g, p) in samples.items():
        found = []
        for m in permutations(graphs.get(g, []), len(p)):
            if any(a[1] != b[1] for a, b in zip(p, m)):
                continue
            gap = lambda i, j: abs(math.dist(p[i][2:5], p[j][2:5]) - math.dist(m[i][2:5], m[j][2:5]))  # noqa: E731, B023
            if all(gap(i, j) <= tol * m[j][5] for j in range(len(p)) for i in range(j)):
                found.append(([n[0] for n in m], all(gap(i, j) <= tol * min(m[i][5], m[j][5]) for j in range(len(p)) for i in range(j))))
        first = sorted(n[0] for n in graphs.get(g, []) if n[1] == p[0][1])
        taken = set()
        for start in range(4):
            if found:
                ids, good = min(found, key=lambda f: ((first.index(f[0][0]) - start * len(first) // 4) % len(first), f[0]))  # noqa: B023
                if tuple(ids) not in taken and good:
                    want |= {(s, start, i, p[i][0], x) for i, x in enumerate(ids)}
                taken.add(tuple(ids))
    cols = "node long, type string, x double, y double, z double"
    left = spark.createDataFrame([(s, g, i, *n) for s, (g, p) in samples.items() for i, n in enumerate(p)], f"sample_id long, graph long, slot long, {cols}")
    right = spark.createDataFrame([(g, *n) for g, ns in graphs.items() for n in ns], f"graph long, {cols}, size double")
    got = [tuple(x) for x in match_cuts(left, right, tol).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({w[0] for w in want}) > 8 and {w[1] for w in want} == {0, 1, 2, 3}

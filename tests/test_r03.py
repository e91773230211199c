"""Findings of round 3, each on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import frames
from meshloom.operators import collide, pose, shapes
from meshloom.plans import meshes
from meshloom.sources import obj

SF = "/root/testdata/sf0.001"
CUBE = "o a\nv 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\nusemtl red\nf 1 2 3\nf 1 2 4\no b\nv 0.5 0 0\nv 2 0 0\nv 2 1 0\nusemtl blue\nf 5 6 7\nf 5 6 99\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_parsed_elements_is_broadcast(spark):
    files = meshes.scene_files(spark, SF)
    assert "BroadcastHashJoin" not in plan(obj.mesh_points(obj.scan(files)))
    assert "Join" not in plan(pose.frames_of_faces(obj.triangles(files))) and "Join" not in plan(obj.face_normals(obj.triangles(files)))


def test_no_text_is_shuffled(spark):
    gathered = meshes.scene_files(spark, SF)._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "l_orderkey" in gathered and "concat_ws" not in gathered and "format_string" not in gathered


def test_triangles_are_those_of_the_elements(spark):
    files = spark.createDataFrame([("one", CUBE), ("none", ""), ("null", None), ("two", CUBE.replace("red", "green"))], "scene string, text string")
    got = {(r.scene, r.fid): (r.oid, r.material, tuple(r.c)) for r in obj.triangles(files).collect()}
    points = obj.mesh_points(obj.scan(files)).orderBy("scene", "fid", "corner").collect()
    want = {}
    for r in points:
        want.setdefault((r.scene, r.fid), []).append(((r.oid, r.material), (r.x, r.y, r.z)))
    whole = {k: (*v[0][0], tuple(x for _, p in v for x in p)) for k, v in want.items() if len(v) == 3}
    assert got == whole and len(got) == 6  # the face of a vertex that lacks is left out


def test_frames_of_many_parts_at_once():
    rng = np.random.default_rng(3)
    p = rng.integers(-2, 3, (300, 6, 3)).astype(float)
    p[0], p[1] = 1.0, np.arange(6)[:, None] * [1.0, 2.0, 3.0]
    c, axes = frames.local_frames_of(p)
    q = frames.quaternions_of(axes)
    for i in range(len(p)):
        want = frames.local_frame(p[i])
        assert np.allclose(c[i], want[0]) and np.allclose(axes[i], want[1])
        assert np.allclose(q[i], frames.quaternion(want[1])) or np.allclose(q[i], -frames.quaternion(want[1]))


@pytest.mark.parametrize("block", [2, 40, 512])
def test_contacts_of_many_small_scenes_and_a_large_one(spark, block):
    rng = np.random.default_rng(7)
    rows = []
    for scene in range(40):
        n = 60 if scene == 0 else int(rng.integers(1, 6))
        for fid in range(n):
            rows.append((f"s{scene}", int(rng.integers(0, 4)), fid, rng.integers(0, 9, 9).astype(float).tolist()))
    faces = spark.createDataFrame(rows, "scene string, oid long, fid long, c array<double>")
    want = set()
    for s, o, _, c in rows:
        for s2, o2, _, c2 in rows:
            if s == s2 and o < o2 and frames.triangles_meet(np.array(c).reshape(1, 3, 3), np.array(c2).reshape(1, 3, 3))[0]:
                want.add((s, o, o2))
    got = [tuple(r) for r in collide.object_contacts(faces, block=block).collect()]
    assert set(got) == want and len(got) == len(want)
    if block == 512:  # scenes of a block at most need neither grid nor counts of cells
        assert collide.scene_grids(faces, 0.0).isEmpty() and not collide.grid_fragments(faces)[1]


def test_poses_query_takes_files_only(spark):
    assert meshes.obj_poses(spark, SF).columns == shapes.poses_of_files(meshes.scene_files(spark, SF)).columns


def test_nearest_words_in_blocks(spark, monkeypatch):
    from meshloom.operators import words

    monkeypatch.setattr(words, "DEALT", 5)
    rng = np.random.default_rng(5)
    w = {int(i) * 7: "".join(rng.choice(list("CEPSV"), int(rng.integers(1, 7)))) for i in range(90)}
    d = lambda a, b: round(sum(abs(a.count(c) - b.count(c)) for c in "CEPSV") / (len(a) + len(b)), 9)
    df = spark.createDataFrame(list(w.items()), "scene long, word string")
    got = sorted((r.query, r.rank, r.match, round(r.d, 9)) for r in words.nearest_words(df, "scene", "CEPSV", 4).collect())
    want = sorted((a, i + 1, b, x) for a in w for i, (x, b) in enumerate(sorted((d(w[a], w[b]), b) for b in w if b != a)[:4]))
    assert got == want
    assert "regexp_count" not in plan(words.distances(df, "scene", "CEPSV")) and words.distances(df, "scene", "CEPSV").count() == 90 * 89 // 2


@pytest.mark.parametrize("block", [7, 4096])
def test_shared_cells_by_products(spark, monkeypatch, block):
    from collections import Counter

    from meshloom.operators import spatial

    monkeypatch.setattr(spatial, "SHARED_BLOCK", block)
    rng = np.random.default_rng(9)
    rows = sorted({(int(c), int(o)) for c, o in zip(rng.integers(0, 30, 900), rng.integers(0, 60, 900))} | {(100 + i, int(o)) for i in range(40) for o in rng.integers(0, 60, 2)})
    want = Counter((a, b) for c, a in rows for e, b in rows if c == e and a < b)
    df = spark.createDataFrame(rows, "cell long, oid long")
    for got in (spatial._shared_by_block(df, -(-60 // block)), spatial.shared_cells(df)):
        assert {(r.a, r.b): r.shared for r in got.collect()} == dict(want) and got.count() == len(want)


def test_exemplars_of_a_pair_in_blocks(spark, monkeypatch):
    from meshloom.operators import exemplar

    for name, size in (("ASKS", 7), ("LIBRARY", 11), ("ROWS", 3), ("COLUMNS", 4)):
        monkeypatch.setattr(exemplar, name, size)
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 4)), "a", "b", *np.round(rng.uniform(0, 2, 3), 2).tolist(), *rng.normal(0, 1, 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, scene long, src_type string, dst_type string, x double, y double, z double, rx double, ry double, rz double, rw double")
    want = {}
    for r in rows:
        found = [(round(float(np.linalg.norm(np.subtract(r[4:7], e[4:7]))), 5), round(abs(abs(float(np.dot(r[7:], e[7:]))) - 1), 5), e[0]) for e in rows if e[1] != r[1]]
        want[r[0]] = min((dev, d, ex) for d, dev, ex in found if d < min(found)[0] + 0.4)
    got = exemplar.best_match(df, df.withColumnRenamed("id", "ex"), 0.4)
    assert {r.id: (r.dev, r.d, r.ex) for r in got.collect()} == want


def test_total_builds_no_table(monkeypatch):
    import public_tokenizers

    from meshloom.llm import tokens

    c = tokens.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("", None, "A plain text, of 12 words.", "  spaces \n\n", "naïve café — “quotes” 漢字 é", "x" * 300):
        want = int(c.table(text)[-1])
        assert want == len(c.lib.encode(text or "", add_special_tokens=False).ids)
        with monkeypatch.context() as m:
            m.setattr(c, "table", None)
            assert c.total(text) == want

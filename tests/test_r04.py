import itertools

import numpy as np
from pyspark.sql import functions as F

from meshloom.functions import scenes as S
from meshloom.operators import generate
from meshloom.plans import catalogue, generative

SF = "/root/testdata/sf0.001"


def test_every_order_is_a_chain_and_long_chains_pair_with_each_other(spark):
    sizes = {r.scene: r.n for r in generative.chain_scenes(spark, SF).groupBy("scene").agg(F.countDistinct("oid").alias("n")).collect()}
    assert sizes == {r.l_orderkey: r["count"] for r in spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").count().collect()}
    pairs = generative._pairs(spark, SF).groupBy("key").agg(F.max(F.when(F.col("role") == "a", F.col("oid"))).alias("a"), F.max(F.when(F.col("role") == "b", F.col("oid"))).alias("b")).collect()
    long = sum(n >= 9 for n in sizes.values())
    assert len(pairs) == long // 2 + (len(sizes) - long) // 2 and all((p.a >= 8) == (p.b >= 8) for p in pairs)
    e = catalogue.queries()["embed_graph"](spark, SF).collect()
    assert {r.key for r in e} == {p.key for p in pairs}
    # a node without edges has no type; all others are placed
    assert all(r.n_parts == sizes[r.key] for r in e if r.status < 2) and {r.key for r in e if not r.n_parts} == {p.key for p in pairs if p.a == 0}


def test_equal_scenes_are_looked_at_once_and_give_the_same(spark):
    tri = lambda x: [(f, [float(v + 3 * x * (i % 3 == 0)) for i, v in enumerate(t)]) for f, t in enumerate([[0, 0, 0, 4, 0, 0, 0, 2, 0], [0, 0, 0, 4, 0, 0, 0, 0, 1]])]
    rows = [(k, role, i, kind, f, c) for k in range(40) for role, word in (("a", "AB"), ("b", "AB" if k % 2 else "AAB")) for i, kind in enumerate(word) for f, c in tri(i)]
    rows += [(99, None, 0, "A", 0, [0.0] * 9)]
    f = spark.createDataFrame(rows, generate.FACES).repartition(7)
    got = {}
    for r in generate.append_parts(f).collect():
        got.setdefault(r.key, []).append((r.oid, r.kind, r.fid, tuple(r.c)))
    got = {k: sorted(v) for k, v in got.items()}
    assert set(got) == set(range(40)) and len({tuple(v) for v in got.values()}) == 2 and all(got[k] == got[k % 2] for k in got)
    assert len({r.key for r in generate.contacts(f).collect()}) == 40


def test_connected_sets_are_counted():
    rng = np.random.default_rng(4)
    for n in (1, 4, 7):
        near = {i: [] for i in range(n)}
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.45:
                near[i].append(j), near[j].append(i)
        for k in range(1, n + 1):
            want = sum(set(S.grown({v: [w for w in near[v] if w in c] for v in c}, [c[0]])) == set(c) for c in itertools.combinations(range(n), k))
            assert S.connected_sets(near, k, 1000) == want and (want < 2 or S.connected_sets(near, k, want - 1) is None)


def test_variations_of_many_samples_stop_when_nothing_new_can_come(monkeypatch):
    part = lambda i, kind: S.Part(kind, np.array([[v + 3.0 * i * (a % 3 == 0) for a, v in enumerate(t)] for t in ([0, 0, 0, 4, 0, 0, 0, 2, 0], [0, 0, 0, 4, 0, 0, 0, 0, 1])]).reshape(-1, 3, 3))
    a, b = ([part(i, k) for i, k in enumerate(w)] for w in ("ABCABCABCA", "BCABCABCABCA"))
    calls, sampled = [], S.sampled
    monkeypatch.setattr(S, "sampled", lambda *x: calls.append(x) or sampled(*x))
    short = S.variations(a, b, 300)
    few = len(calls)
    monkeypatch.setattr(S, "connected_sets", lambda *_: None)
    full = S.variations(a, b, 300)
    names = lambda r: [(v["k"], v["sample"], v["hist"]) for v in r[0]]
    assert names(short) == names(full) and short[1] == full[1] and few < 300 < len(calls) - few


def test_augmented_words_take_two_rounds_of_all_samples(spark, monkeypatch):
    from meshloom.operators import dataset

    asked = []
    monkeypatch.setattr(dataset, "augmented", lambda f, rounds, samples: asked.append((rounds, samples)))
    catalogue.queries()["augmented_words"](spark, SF)
    assert asked == [(2, 2048)]


def test_words_with_cycles_are_encoded_from_every_start(spark, monkeypatch):
    from meshloom.operators import words

    w = spark.createDataFrame([(1, "O1ANR1"), (2, "OA"), (3, "")], "scene long, word string")
    made = {r.scene: r.made for r in words.with_variants(w, 3, every=True).collect()}
    assert {x[0] for x in made[1]} == set("OANR") and made[2] == ["OA", "AO"] and made[3] == [] and len(set(made[1])) == len(made[1])
    assert all(len(r.made) == 3 for r in words.with_variants(w, 3).filter("scene < 3").collect())
    asked, plain = [], words.with_variants
    monkeypatch.setattr(words, "with_variants", lambda *a, **k: asked.append(k) or plain(*a, **k))
    q = catalogue.queries()["cycle_word_roundtrip"](spark, SF)
    assert asked == [{"every": True}] and q.filter("NOT same").count() == 0


def test_files_are_parsed_once_and_large_ones_go_by_the_grid(spark):
    from meshloom.operators import collide, pose, shapes
    from meshloom.sources import obj

    cube = lambda o, x, n=1: "\n".join([f"o p{o}", f"usemtl m{o}", *(f"v {x + a} {b} {c}" for a, b, c in itertools.product((0, 1), repeat=3)), *["f -8 -7 -6 -5\nf -4 -3 -2 -1\nf -8 -4 -2"] * n])
    text = {"large": "\n".join(cube(i, i, 4100 if i == 1 else 1) for i in range(4)), "small": "\n".join(cube(i, i * 0.9) for i in range(5)), "one": cube(0, 0), "none": ""}
    files = spark.createDataFrame(list(text.items()) + [("null", None)], "scene string, text string").repartition(2)
    faces = shapes.mesh_faces(files)
    n = {r.scene: r["count"] for r in faces.groupBy("scene").count().collect()}
    assert n["large"] > shapes.WHOLE > n["small"]
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(collide.object_contacts(faces))
    assert rows(shapes.contacts_of_files(files)) == want and len(want) == 7
    assert rows(shapes.frames_of_files(files)) == rows(pose.frames_of_faces(obj.triangles(files)))
    w = {(r.scene, r.start): r.n for r in shapes.words_of_files(files, repeats=1).selectExpr("scene", "start", "size(node_ids) AS n").collect()}
    assert w == {**{("large", i): 4 for i in range(4)}, **{("small", i): 5 for i in range(5)}, ("one", 0): 1}
    poses = shapes.poses_of_files(files).collect()
    assert {(r.scene, min(r.src, r.dst), max(r.src, r.dst)) for r in poses} == {(r.scene, r.a, r.b) for r in collide.object_contacts(faces).collect()} and len(poses) == 14
    assert all(r.src_type == f"m{r.src}" and r.dst_type == f"m{r.dst}" and abs(r.size - 3**0.5) < 1e-9 for r in poses)


def test_contacts_and_frames_of_files_shuffle_no_triangles(spark):
    q = catalogue.queries()["local_frames"](spark, SF)
    text = q._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") <= 2 and "collect_list(struct(fid" not in text


def test_pairs_of_configurations_are_not_shuffled(spark):
    from meshloom.operators import grammar

    rows = [(n, "t", f"b{(n + j) % 5}", f"b{j}", j * 0.5 + (n % 3) * 0.01, 1.0, j, j + 1) for n in range(40) for j in range(1 + n % 4)]
    df = spark.createDataFrame(rows, "node long, type string, b0 string, b1 string, dist double, size double, l_dst long, r_dst long")
    target, example = df.filter("node % 2 = 1"), df.filter("node % 2 = 0")
    got = grammar.config_subset(target, example, 0.02)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [ask#" in plan and not any("Aggregate [ask#" in line and ", x#" in line.split("]")[0] for line in plan.splitlines())
    by = {}
    for n, *c in rows:
        by.setdefault(n, []).append(c)
    like = lambda a, b: a[:3] == b[:3] and abs(a[3] - b[3]) < a[4] * 0.02
    want = {n: any(all(any(like(a, b) for b in x) for a in c) for m, x in by.items() if m % 2 == 0) for n, c in by.items() if n % 2}
    assert {r.node: r.ok for r in got.collect()} == want and 0 < sum(want.values()) < len(want)


def test_samples_rank_neighbours_by_a_plain_hash(spark, monkeypatch):
    from meshloom.operators import variation

    plans, settle = [], variation.settle
    monkeypatch.setattr(variation, "settle", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), settle(df))[1])
    e = spark.createDataFrame([(i, j) for i in range(9) for j in range(9) if i != j], "src long, dst long")
    a, b = (variation.sample_subgraphs(e, spark.createDataFrame([(i, i) for i in range(9)], "sample_id long, node long"), 4).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and not any("md5" in p for p in plans)


def test_cells_of_scenes_are_counted_where_they_lie(spark):
    from meshloom.operators import spatial

    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 30)), i % 3, i, rng.uniform(-4, 4, 9).tolist()) for i in range(400)] + [(99, 0, 0, None)]
    f = spark.createDataFrame(rows, "scene long, oid long, fid long, c array<double>").repartition(5)
    want = spatial.triangle_cells(f, (2.0, 1.0, 0.5), (0.1, 0.0, 0.2)).groupBy("scene").agg(F.count("*").alias("n"), F.countDistinct("ix", "iy", "iz").alias("n_cells"))
    assert sorted(map(tuple, spatial.scene_cells(f, (2.0, 1.0, 0.5), (0.1, 0.0, 0.2)).collect())) == sorted(map(tuple, want.collect()))
    q = catalogue.queries()["triangle_cells"](spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and plan.count("Aggregate") == plan.count("ObjectHashAggregate")


def test_a_file_goes_round_without_leaving_its_row(spark):
    from meshloom.sources import obj

    text = "v 0 0 0\nv 1.5 0 -2e-9\nv 0 1 0\nv 0 0 1\nvn 0 0 1\nvt 0.5 0.25\no a\nusemtl red\nf 1 2 3 4\nl 1 2\no b\nf -1//1 2//1 3//1\nusemtl blue\nf 1 2 4\nl 3 4\np 3"
    files = spark.createDataFrame([("s", text), ("t", None), ("u", "v 1 2 3\np 1")], "scene string, text string").repartition(1)
    held = obj.gathered(files).withColumn("text", obj.text_of())
    # the same text as by a shuffle of all elements
    assert {r.scene: r.text for r in held.collect() if r.text} == {r.scene: r.text for r in obj.to_text(obj.scan(files)).collect()}
    assert {tuple(r) for r in obj.same_as_text(held).collect()} == {("s", 4, True), ("t", 0, True), ("u", 0, True)}
    for old, new in (("f 1 2 3\n", "f 1 3 2\n"), ("usemtl blue", "usemtl red"), ("v 1.5", "v 1.6"), ("p 3", ""), ("l 3 4", "l 4 3")):
        bent = held.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
        assert {r.scene: r.same for r in obj.same_as_text(bent).collect()}["s"] is False, old
    plan = catalogue.queries()["obj_export_roundtrip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_plain_quads_are_read_as_other_faces_are(spark):
    from meshloom.sources import obj

    head = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\no a\nusemtl m\n"
    faces = ["f 1 2 3 4", "f -4 -3 -2 -1", "f 1 2 3 -1", "f 1 2 x 4 ", "f 1 2 3 4 # note", "f 1/ 2/ 3/ 4/", "f 0 1 2 3"]
    plain, slow = obj._File(head + "\n".join(faces)), obj._File(head + "\n".join(f.replace("f ", "fo ", 1) for f in faces))
    assert plain.index == slow.index and plain.oid == slow.oid and plain.material == slow.material and len(plain.oid) == 12


def test_boxes_are_dealt_and_few_triangles_of_two_objects_are_tested(spark, monkeypatch):
    from meshloom.functions.frames import triangles_meet
    from meshloom.operators import collide
    from meshloom.plans import geometry

    assert geometry._faces(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rng = np.random.default_rng(2)
    corner = np.array(list(itertools.product((0, 1), repeat=3)), float)
    cubes = [(rng.integers(0, 6, 3) + corner * 3)[np.array(geometry._TRIANGLES)] for _ in range(20)]
    tri, oid = np.concatenate(cubes), np.repeat(np.arange(20), 12)
    want = {(i, j) for i, j in itertools.combinations(range(20), 2) if triangles_meet(np.repeat(cubes[i], 12, 0), np.tile(cubes[j], (12, 1, 1))).any()}
    tested = []
    monkeypatch.setattr(collide, "triangles_meet", lambda a, b: tested.append(len(a)) or triangles_meet(a, b))
    a, b = collide.whole_scenes(np.zeros(240, np.int64), oid, tri)
    assert sorted((min(x, y), max(x, y)) for x, y in zip(oid[a].tolist(), oid[b].tolist())) == sorted(want) and sum(tested) < 20 * len(want)

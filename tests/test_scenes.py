"""Scenes, neighbours and counts against brute force or by their invariants."""

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from meshloom.functions import frames, scenes
from meshloom.functions import words as W
from meshloom.operators import category, dataset, generate, graph, pose, shapes, spatial, variation, vector, words
from meshloom.plans import catalogue, generative
from meshloom.plans import projections as P

SF = "/root/testdata/sf0.001"
CORNERS = np.array([[0, 0, 0], [4, 0, 0], [0, 2, 0], [0, 0, 1.0]])
FACES = np.array([[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]])


def turn(angle):
    c, s = math.cos(angle), math.sin(angle)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def part(kind, at, angle=0.0):
    return scenes.Part(kind, (CORNERS @ turn(angle).T + at)[FACES])


def chain(kinds, bent=()):
    return [part(k, [3.0 * i, 0, 0], 0.5 if i in bent else 0.0) for i, k in enumerate(kinds)]


def line(n):
    return {i: [j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)}


def test_contacts_of_a_chain():
    assert scenes.contact_graph(chain("ABCAB")) == line(5)
    assert scenes.contact_graph([]) == {} and scenes.contact_graph(chain("A")) == {0: []}


def test_grammar_gates():
    a = chain("ABCABC")
    g = scenes.Grammar().learn(a, line(6))
    assert g.allows(a, line(6)) and not g.allows(chain("AAB"), line(3)) and not g.allows(chain("ABX"), line(3))
    assert not g.allows(a, {**line(6), 2: [1], 3: [4]})  # not connected
    assert g.allows_part(chain("AB"), line(2)) and not g.allows_part(chain("AA"), line(2))
    assert g.stands(a, line(6))


def test_repair_brings_parts_back():
    a, b, bent = chain("ABCABCABC"), chain("ABCABC"), chain("ABCABCABC", bent=(3, 5))
    status, out, n = scenes.fix_variation(a, b, bent)
    assert status == 0 and n >= 2
    near = scenes.contact_graph(out)
    library = scenes.Library().learn(a, line(9))
    for i, ns in near.items():
        for j in ns:
            t, r = scenes.relative(out[i].frame(), out[j].frame())
            assert scenes.deviation(library.best((out[i].kind, out[j].kind), t, r)[1], r) < scenes.TURN
    assert scenes.fix_variation(a, b, chain("ABB"))[0] == 1
    assert scenes.fix_variation(a, b, a)[0::2] == (0, 0)


def categories(near, kinds):
    return {(i, j): ord(kinds[i]) * 512 + ord(kinds[j]) * 2 + (i < j) for i, ns in near.items() for j in ns}


def test_embedding_of_a_known_graph():
    kinds = "ABCABCABC"
    a, b = chain(kinds), chain("ABCABC")
    ex = [scenes.Example(s, line(len(s)), categories(line(len(s)), [p.kind for p in s])) for s in (a, b)]
    status, parts, _ = scenes.realise(ex, line(9), categories(line(9), kinds))
    assert status == 0 and Counter(p.kind for p in parts) == Counter(kinds)
    assert sorted(map(len, scenes.contact_graph(parts).values())) == sorted(map(len, line(9).values()))
    odd = {e: c + 100_000 for e, c in categories(line(9), kinds).items()}
    assert scenes.realise(ex, line(9), odd, tries=3)[0] == 2  # no example has these categories


def test_edge_lookups():
    cats = {(0, 1): 5, (1, 0): 6, (1, 2): 5, (2, 1): 7}
    assert scenes.matching_edge(cats, 5, 6, True, (1,)) == (0, 1) and scenes.matching_edge(cats, 7, 5, True, (1,)) == (2, 1)
    assert scenes.matching_edge(cats, 5, 9, True, (1,)) is None and scenes.matching_edge(cats, 5, 9, False, (1,)) in ((0, 1), (1, 2))
    parts = chain("ABC")
    assert scenes.edge_of_types(parts, line(3), "B", "C", (1,)) == (1, 2) and scenes.edge_of_types(parts, line(3), "A", "C", (1,)) is None
    assert scenes.type_beyond(parts, cats, 6, "A") == "B" and scenes.type_beyond(parts, cats, 99, "A") is None


def test_variations_pass_the_gates():
    a, b = chain("ABCABCABCABC"), chain("ABCABCABCABCABC")
    found, seen = scenes.variations(a, b, 20)
    assert found and seen["variations"] == len(found) <= seen["grammar"] <= seen["histograms"] <= seen["matches"] <= seen["samples"]
    g = scenes.Grammar().learn(a, line(12)).learn(b, line(15))
    hist = [v["hist"] for v in found]
    assert len(set(hist)) == len(hist)
    for v in found:
        near = scenes.contact_graph(v["parts"])
        assert near == v["near"] and g.allows(v["parts"], near) and g.stands(v["parts"], near)
    assert scenes.variations(chain("ABC"), b, 5) == ([], Counter())
    assert [v["hist"] for v in scenes.variations(a, b, 20)[0]] == hist


def test_samples_grow_and_matches_hold():
    a = chain("ABCABCABCABC")
    g = scenes.contact_graph(a)
    seen = set()
    for s in range(30):
        held = scenes.sampled(g, 5, 1, s, [p.centre[2] for p in a], [p.size for p in a])
        assert len(held) == len(set(held)) <= 5
        assert len(scenes.grown({v: [w for w in g[v] if w in held] for v in held}, [held[0]])) == len(held)
        seen.add(frozenset(held))
        cut = [v for v in held if scenes.flags(g, held)[v]]
        m = scenes.cut_match(a, cut, a, 1e-6, (s,))
        assert m is not None and scenes.match_holds(a, cut, a, m, 1e-6)
    assert len(seen) > 3
    assert scenes.cut_match(chain("AB"), [0, 1], chain("AAA"), 0.0) is None
    x = scenes.extreme_points(np.concatenate([part("A", [0, 0, 0]).tri]), 1.0)
    assert sorted(map(tuple, x.tolist())) == sorted(map(tuple, CORNERS.tolist()))
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [[0.5, 0.5, 0.0]], float)
    assert len(scenes.extreme_points(cube, 1.0)) == 8  # the middle of a side is none


def test_merge_and_append():
    a, b = chain("ABC"), chain("ABC")
    assert len(scenes.merged(a, [0, 1, 2], b, [0, 1, 2])) == 3  # all of b cover a's
    assert len(scenes.merged(a, [0, 1, 2], b, [0, 1, 2], shift=np.array([50.0, 0, 0]))) == 6
    assert len(scenes.merged(a, [0], b, [1, 2], skip_overlap=False)) == 3
    out = scenes.append_part(a, 2, b, 0, 1)
    assert out[3].kind == "B" and np.allclose(out[3].centre - out[2].centre, b[1].centre - b[0].centre)
    at = part("C", [1, 2, 3], 0.7)  # the appended part follows the turn of the part it joins
    out = scenes.append_part([at], 0, b, 0, 1)
    assert np.allclose(out[1].centre - at.centre, turn(0.7) @ (b[1].centre - b[0].centre))


def test_generated_scenes_in_frames(spark):
    rows = [(k, r, i, p.kind, f, t.reshape(-1).tolist()) for k, ra, rb in ((1, "ABCABCABCABC", "ABCABCABCABCABC"), (2, "ABC", "ABC")) for r, kinds in (("a", ra), ("b", rb)) for i, p in enumerate(chain(kinds)) for f, t in enumerate(p.tri)]
    f = spark.createDataFrame(rows, generate.FACES).repartition(3)
    v = generate.generate_variations(f, 20).select("key", "variation", "word", "hist").distinct().collect()
    want, seen = scenes.variations(chain("ABCABCABCABC"), chain("ABCABCABCABCABC"), 20)
    assert sum(r.variation >= 0 for r in v) == len(want) and {r.key for r in v if r.variation < 0} == {1, 2}
    assert next(r.hist for r in v if r.key == 1 and r.variation < 0).endswith(f"variations={seen['variations']}")
    for r in v:
        if r.word:
            chars, near = W.graph(r.word)
            assert len(chars) == sum(int(x.split("=")[1]) for x in r.hist.split(";")) and all(near[i] for i in range(len(chars)))
    c = {(r.key, r.role, r.src, r.dst) for r in generate.contacts(f).collect()}
    assert c == {(k, r, i, j) for k, r, n in ((1, "a", 12), (1, "b", 15), (2, "a", 3), (2, "b", 3)) for i, ns in line(n).items() for j in ns}
    two = dataset.augmented(f, 2, 8).collect()
    assert {r.round for r in two} <= {0, 1} and two and len({r.word for r in two}) == len(two)


def test_queries_of_scenes_hold_their_invariants(spark):
    """On the driver's chains: bent scenes are repaired, graphs embed anew with as many parts, variations have distinct histograms."""
    sizes = {r.scene: r.n for r in generative.chain_scenes(spark, SF).groupBy("scene").agg(F.countDistinct("oid").alias("n")).collect()}
    r = catalogue.queries()["repair_scenes"](spark, SF).collect()
    assert r and all(x.n_parts == sizes[x.key] for x in r) and sum(x.status == 0 for x in r) >= 0.8 * len(r)
    e = catalogue.queries()["embed_graph"](spark, SF).collect()
    assert len(e) == len(r) and all(x.status in (0, 1, 2) and x.n_parts <= sizes[x.key] for x in e) and all(x.n_parts == sizes[x.key] for x in e if x.status < 2)
    v = catalogue.queries()["variation_pipeline"](spark, SF).collect()
    h = [(x.key, x.hist) for x in v if x.variation >= 0]
    assert len(set(h)) == len(h) and sum(x.variation < 0 for x in v) == len(r)


def test_mirror_images_are_no_turns(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    p = rng.normal(size=(6, 3))
    rows = []
    for sample, q in enumerate((p @ turn(0.6).T + [1, 2, 3], p * [-1, 1, 1], p + rng.normal(size=(6, 3)))):
        rows += [(sample, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    got = {r["sample"]: r for r in pose.rigid_align(spark.createDataFrame(rows, "sample long, px double, py double, pz double, qx double, qy double, qz double")).collect()}
    assert got[0].ok and got[0].residue < 1e-9 and np.allclose([got[0].tx, got[0].ty, got[0].tz], [1, 2, 3]) and np.isclose(abs(got[0].qw), math.cos(0.3))
    assert not got[1].ok and not got[2].ok
    assert abs(frames.kabsch(p, p * [-1, 1, 1])[3] + 1) < 1e-9


def test_nearest_with_ties(spark):
    """Equal vectors, large norms and blocks of every size: the k nearest by (distance, id)."""
    rng = np.random.Generator(np.random.PCG64(5))
    sets = [[(i, [1.0, 2.0]) for i in range(200)], [(i, [1e8 + i % 7, 1e8 - i % 5, float(i % 3)]) for i in range(150)], [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(120)]]
    for rows in sets:
        frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
        v = np.array([r[1] for r in rows])
        want = set()
        for i, x in enumerate(v):
            d = np.sqrt(((v - x) ** 2).sum(1))
            want |= {(i, j, n + 1) for n, j in enumerate([j for j in np.lexsort((np.arange(len(v)), d)) if j != i][:4])}
        for block, span in ((8192, 65536), (37, 50)):
            assert {(r.a, r.b, r.rank) for r in vector.knn(frame, 4, block=block, span=span).collect()} == want
    own = vector.knn(spark.createDataFrame(sets[0][:5], "id long, v array<double>"), 2, include_self=True).collect()
    assert sorted((r.a, r.b) for r in own) == [(i, j) for i in range(5) for j in (0, 1)]


def test_latent_graph_keeps_zero_weights(spark):
    w = [r.weight for r in catalogue.queries()["latent_graph"](spark, SF).collect()]
    assert 0 < sum(x == 0 for x in w) < len(w)


def test_numbering(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "k long, s string").repartition(5)
    assert sorted((r.k, r.number) for r in graph.numbered(df, "k").collect()) == [(i, i) for i in range(50)]
    assert graph.numbered(df.filter("k < 0"), "k").count() == 0


def test_shared_cells_of_a_hot_cell(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = {(0, i) for i in range(90)} | {(int(c), int(o)) for c, o in zip(rng.integers(0, 30, 400), rng.integers(0, 90, 400))}
    want = Counter()
    by = defaultdict(list)
    for c, o in sorted(rows):
        by[c].append(o)
    for m in by.values():
        want.update((a, b) for a in m for b in m if a < b)
    keep = spatial.CELL_BLOCK
    try:
        for spatial.CELL_BLOCK in (keep, 16):
            got = spatial.shared_cells(spark.createDataFrame(sorted(rows), "cell long, oid long"))
            assert {(r.a, r.b): r.shared for r in got.collect()} == dict(want)
    finally:
        spatial.CELL_BLOCK = keep


def clipped(tri, lo, hi):
    """Whether a triangle meets a box, by cutting it at the box's planes."""
    poly = [np.array(p, float) for p in tri]
    for axis in range(3):
        for sign, limit in ((1, hi[axis]), (-1, -lo[axis])):
            out = []
            for p, q in zip(poly, poly[1:] + poly[:1]):
                a, b = sign * p[axis] - limit, sign * q[axis] - limit
                if a <= 0:
                    out.append(p)
                if (a < 0) != (b < 0) and a != b:
                    out.append(p + (q - p) * (a / (a - b)))
            poly = out
            if not poly:
                return False
    return True


def test_triangles_in_cells(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    tri = rng.uniform(-2, 2, (60, 3, 3))
    f = spark.createDataFrame([(0, 0, i, t.reshape(-1).tolist()) for i, t in enumerate(tri)], "scene long, oid long, fid long, c array<double>").repartition(3)
    cell = np.array([0.7, 0.5, 0.9])
    got = {(r.fid, r.ix, r.iy, r.iz) for r in spatial.triangle_cells(f, tuple(cell)).collect()}
    for i, t in enumerate(tri):
        lo, hi = np.floor(t.min(0) / cell).astype(int) - 1, np.floor(t.max(0) / cell).astype(int) + 1
        for x in np.ndindex(*(hi - lo + 1)):
            c = (np.array(x) + lo + 0.5) * cell
            surely, maybe = (clipped(t, c - cell / 2 * k, c + cell / 2 * k) for k in (1.0, 1.0101))
            key = (i, *(int(v) for v in np.array(x) + lo))
            assert not surely or key in got
            assert maybe or key not in got


def test_overlap_near_cell_borders(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    make = lambda n, seed: [(i, "xy"[i % 2], *rng.uniform(0, 3, 3).round(2).tolist(), float(rng.uniform(1, 9))) for i in range(n)]
    a, b = make(80, 1), make(90, 2)
    schema = "oid long, type string, cx double, cy double, cz double, size double"
    got = {r.oid for r in spatial.overlap_anti_join(spark.createDataFrame(b, schema), spark.createDataFrame(a, schema)).collect()}
    want = {y[0] for y in b if not any(x[1] == y[1] and math.dist(x[2:5], y[2:5]) < 0.03125 * y[5] for x in a)}
    assert got == want and 0 < len(want) < len(b)


def test_words_from_every_start(spark):
    """Words of the same graph from each start and seed decode to graphs with the same nodes and edges by id."""
    got = catalogue.queries()["encode_multi_start"](spark, SF).collect()
    ln = defaultdict(dict)
    for r in P.lines(spark, SF).collect():
        ln[r.scene][r.rank] = r.ch
    seen = Counter()
    for r in got:
        n = len(ln[r.scene])
        ids = [int(i) for i in r.node_ids.split()]
        chars, _ = W.graph(r.word)
        assert ids[0] == r.start and sorted(ids) == list(range(n + 1)) and chars == [ln[r.scene].get(i, "O") for i in ids]
        edges = {tuple(sorted((ids[a], ids[b]))) for _, a, b in W.edges(r.word)}
        assert edges == {(0, i) for i in range(1, n + 1)} | {(i, i + 1) for i in range(1, n)}
        seen[r.scene] += 1
    assert all(seen[s] == 2 * (len(x) + 1) for s, x in ln.items())


def test_variants_and_mutations(spark):
    w = {r.scene: r.word for r in P.order_words(spark, SF).collect()}
    for r in catalogue.queries()["word_variants"](spark, SF).collect():
        assert W.signature(r.word) == W.signature(w[r.scene])
    known = set(w.values())
    for r in catalogue.queries()["artificial_words"](spark, SF).collect():
        assert r.word not in known
        assert r.word.replace("AA", "A", 1) == w[r.scene] if r.kind == "longer" else r.word.translate(str.maketrans("RN", "NR")) == w[r.scene]


def test_samples_matches_and_flags(spark):
    edges = [(a, b) for a in range(12) for b in range(12) if a != b and abs(a - b) in (1, 5)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    e = spark.createDataFrame(edges, "src long, dst long")
    got = defaultdict(list)
    for r in variation.sample_subgraphs(e, spark.createDataFrame([(i, i) for i in range(12)], "sample_id long, node long"), 5).collect():
        got[r.sample_id].append((r.slot, r.node))
    for seed, x in got.items():
        ids = [n for _, n in sorted(x)]
        assert ids[0] == seed and len(set(ids)) == 5 and all(near[v] & set(ids[:i]) for i, v in enumerate(ids) if i)
    m = catalogue.queries()["cut_matching"](spark, SF).collect()
    stats = {(r.scene, r.rank): (r.ch, r.x, r.y, r.z) for r in P.lines(spark, SF).collect()}
    by = defaultdict(list)
    for r in m:
        p, q = stats[r.sample_id, r.node], stats[r.sample_id + 1, r.match]
        assert p[0] == q[0]
        by[r.sample_id, r.start].append((p[1:], q[1:], r.match))
    assert m and all(len({x[2] for x in xs}) == len(xs) for xs in by.values())
    for x in by.values():
        for p, q, _ in x:
            for p2, q2, _ in x:
                assert abs(math.dist(p, p2) - math.dist(q, q2)) <= generative.MATCH


def test_frames_of_turned_parts(spark):
    rows, want = [], {}
    for i in range(12):
        p = part("A", [i, 2.0 * i, 0], 0.3 * i)
        rows += [("s", i, *map(float, x)) for x in p.points]
        want[i] = p.centre
    got = pose.local_frames(spark.createDataFrame(rows, "scene string, oid long, x double, y double, z double")).collect()
    base = next(r for r in got if r.oid == 0)
    for r in got:
        assert np.allclose([r.cx, r.cy, r.cz], want[r.oid]) and abs(r.qx**2 + r.qy**2 + r.qz**2 + r.qw**2 - 1) < 1e-9
        # the frame turns with the part
        dot = abs(r.qx * base.qx + r.qy * base.qy + r.qz * base.qz + r.qw * base.qw)
        z = frames.quaternion(turn(0.3 * r.oid).T)
        b = np.array([base.qx, base.qy, base.qz, base.qw])
        own = np.array([z[3] * b[0] + z[0] * b[3] + z[1] * b[2] - z[2] * b[1], z[3] * b[1] - z[0] * b[2] + z[1] * b[3] + z[2] * b[0], z[3] * b[2] + z[0] * b[1] - z[1] * b[0] + z[2] * b[3], z[3] * b[3] - z[0] * b[0] - z[1] * b[1] - z[2] * b[2]])
        assert abs(abs(own @ [r.qx, r.qy, r.qz, r.qw]) - 1) < 1e-9 and 0 <= dot <= 1 + 1e-9


def test_waypoints_and_noise(spark):
    v = {r.id: np.array(r.v) for r in P.vectors(spark, SF).collect()}
    pairs = {r.pair: (r.a, r.b) for r in catalogue._pairs(spark, SF).collect()}

    def between(a, b):
        return min((x for x in v if x not in (a, b)), key=lambda x: (round(float(np.linalg.norm(v[a] - v[x]) + np.linalg.norm(v[b] - v[x])), 6), x))

    def path(a, b, depth):
        return [a] if not depth else path(a, (m := between(a, b)), depth - 1) + path(m, b, depth - 1)

    got = defaultdict(dict)
    for r in catalogue.queries()["latent_path"](spark, SF).collect():
        got[r.pair][r.step] = r.id
    assert {p: [x[i] for i in sorted(x)] for p, x in got.items()} == {p: path(a, b, 3) for p, (a, b) in pairs.items()}
    for r in catalogue.queries()["neighborhood_sample"](spark, SF).collect():
        assert abs(r.norm - np.linalg.norm(v[pairs[r.pair][0]])) < 6 * 0.05 * math.sqrt(len(v[pairs[r.pair][0]]))
    z = np.array([r.v for r in vector.prior_sample(spark, 400, 8, seed=3).collect()])
    assert z.shape == (400, 8) and abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1
    assert np.array_equal(z, np.array([r.v for r in vector.prior_sample(spark, 400, 8, seed=3).collect()]))


def test_mean_shift_categories(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    centres = {("a", "b"): [(0, 0, 0), (5, 0, 0)], ("b", "a"): [(1, 1, 1)]}
    rows = [(i, *k, *(np.array(c) + rng.normal(0, 0.05, 3)).tolist(), 4.0) for k, cs in centres.items() for c in cs for i in range(30)]
    got = defaultdict(list)
    for r in category.edge_categories(spark.createDataFrame(rows, "src long, src_type string, dst_type string, x double, y double, z double, size double")).collect():
        got[r.src_type, r.dst_type].append((r.x, r.y, r.z))
    assert {k: len(x) for k, x in got.items()} == {k: len(x) for k, x in centres.items()}
    assert all(min(math.dist(x, c) for c in centres[k]) < 0.1 for k, xs in got.items() for x in xs)


def test_shortest_paths_against_dijkstra(spark):
    near = defaultdict(dict)
    for r in catalogue._knn_edges(spark, SF, 2).collect():
        near[r.src][r.dst] = r.weight
    start = min(near)
    best, todo = {}, [(0.0, start)]
    while todo:
        d, x = heapq.heappop(todo)
        if x not in best:
            best[x] = d
            for y, w in near[x].items():
                heapq.heappush(todo, (d + w, y))
    got = {r.node: r.dist for r in catalogue.queries()["shortest_path"](spark, SF).collect()}
    assert got.keys() == best.keys() and all(abs(got[x] - best[x]) < 1e-5 for x in best)


def test_words_of_listing_and_model(spark):
    m = dataset.CharacterModel(" ()ANOR", 12)
    ws = ["O(A)N", "", "ORRR(A)N"]
    assert m.decode(m.encode(ws)) == ws
    df = spark.createDataFrame([("A\nO(R)\n7\n1 2\n",), ("",), (None,)], "t string").select(dataset.split_listing(F.col("t")).alias("x")).collect()
    assert [(y.word, list(y.ids)) for y in df[0].x] == [("A", [7]), ("O(R)", [1, 2])] and not df[1].x
    assert words.filter_words(spark.createDataFrame([("A9",), ("",), ("A" * 200,), ("AB",)], "word string")).count() == 1


def test_words_and_poses_of_files(spark):
    """A chain of tetrahedra as OBJ text: words decode to its graph, poses are those of its frames."""

    def text(kinds, gap=0.0):
        out = []
        for i, k in enumerate(kinds):
            out += [f"v {x + 3 * i + gap * (i > 1)} {y} {z}" for x, y, z in CORNERS] + [f"o p{i}", f"usemtl {k}"]
            out += ["f " + " ".join(str(4 * i + v + 1) for v in f) for f in FACES]
        return "\n".join(out)

    files = spark.createDataFrame([("one", text("red blue red green".split())), ("apart", text("red blue red".split(), 50.0)), ("none", "")], "scene string, text string")
    got = shapes.words_of_files(files, repeats=3).collect()
    assert {r.scene for r in got} == {"one"} and Counter(r.start for r in got) == {i: 3 for i in range(4)}
    kind = {0: "C", 1: "A", 2: "C", 3: "B"}  # by name: blue, green, red
    for r in got:
        chars, _ = W.graph(r.word)
        ids = list(r.node_ids)
        assert chars == [kind[i] for i in ids] and {tuple(sorted((ids[a], ids[b]))) for _, a, b in W.edges(r.word)} == {(0, 1), (1, 2), (2, 3)}
    assert len(shapes.words_of_files(files, repeats=1, starts="first").collect()) == 1
    poses = {(r.src, r.dst): r for r in shapes.poses_of_files(files).filter("scene = 'one'").collect()}
    assert set(poses) == {(i, j) for i, ns in line(4).items() for j in ns}
    parts = chain("rbrg")
    for (i, j), r in poses.items():
        t, turned = scenes.relative(parts[i].frame(), parts[j].frame())
        assert np.allclose([r.x, r.y, r.z], t, atol=1e-6) and abs(abs(r.rw) - 1) < 1e-6 and abs(r["size"] - parts[j].size) < 1e-9 and np.allclose(turned, np.eye(3))

"""Steps that the third round's size findings name, second half: each would have failed before."""

import numpy as np
import test_geometry
from pyspark.sql import functions as F

from meshloom.functions import frames
from meshloom.operators import category, lineage, pose, spatial, variation
from meshloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cuts_are_matched_alike_as_rows_and_by_buckets(spark, monkeypatch):
    for whole, slots in ((0, 6), (32, 2)):
        monkeypatch.setattr(variation, "WHOLE", whole)
        monkeypatch.setattr(variation, "SLOTS", slots)
        test_geometry.test_cut_matching_by_brute_force(spark)


def test_cuts_of_small_graphs_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(variation, "distance_pairs", None)
    assert catalogue.queries()["cut_matching"](spark, SF).count() > 0


def test_many_sets_are_aligned_as_one_by_one(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    for k in (1, 2, 3, 4, 7):
        p, q = rng.normal(size=(20, k, 3)), rng.normal(size=(20, k, 3))
        q[:5] = p[:5]
        q[5:9] = p[5:9] * [-1, 1, 1]
        r, t, res, det = frames.kabsch_of(p, q)
        for i in range(20):
            want = frames.kabsch(p[i], q[i])
            assert np.allclose(r[i] @ p[i].T + t[i][:, None], want[0] @ p[i].T + want[1][:, None]) and np.isclose(res[i], want[2]) and np.isclose(det[i], want[3])
    q = catalogue.queries()["rigid_align"](spark, SF)
    assert "FlatMapGroupsInPandas" not in plan(q) and q.filter(F.col("residue").isNull()).count() == 0 and hasattr(pose, "rigid_align_rows")


def test_large_tables_are_dealt_by_their_rows_and_give_the_same_pairs(spark, monkeypatch):
    f = spark.range(4000).selectExpr("id * 7 % 400 AS cell", "id * 13 % 97 AS oid").cache()
    t = spark.range(97).selectExpr("id AS oid", "concat('t', id % 5) AS type")
    rows = lambda df: sorted(map(tuple, df.collect()))
    pairs, graph = rows(spatial.cell_pairs(f)), rows(spatial.collision_graph(f, t))
    monkeypatch.setattr(lineage, "DEALT", 100)
    assert spatial.cell_pairs(f).rdd.getNumPartitions() == 40
    assert rows(spatial.cell_pairs(f)) == rows(spatial.cell_pairs(f, dense=True)) == pairs and rows(spatial.collision_graph(f, t)) == graph


def test_near_pairs_are_those_of_all_pairs_that_are_near(spark):
    f = spark.range(3000).selectExpr("id * 7 % 60 AS cell", "id * 13 % 97 AS oid")
    n = spark.range(95).selectExpr("id AS oid", "CAST(id % 9 - 3 AS INT) AS n")
    band = {r.oid: r.n for r in n.collect()}
    every = [(r.a, r.b) for r in spatial.cell_pairs(f).collect()]
    for reach in (0, 1, 3):
        got = [tuple(r) for r in spatial.near_pairs(f, n, reach).collect()]
        assert sorted(got) == sorted((a, b) for a, b in every if a in band and b in band and abs(band[a] - band[b]) <= reach)


def test_an_edge_meets_its_centres_as_a_row(spark):
    e = spark.createDataFrame([(1, 2, "a", "b", 0.0, 0.0, 0.0), (1, 2, "a", "b", 5.0, 0.0, 0.0), (3, 4, "a", "c", 1.0, 1.0, 1.0), (5, 6, "a", "b", None, 0.0, 0.0)], "src long, dst long, src_type string, dst_type string, x double, y double, z double")
    c = spark.createDataFrame([("a", "b", 7, 1.0, 0.0, 0.0), ("a", "b", 3, -1.0, 0.0, 0.0), ("a", "b", 1, 5.0, 0.0, 0.1)], "src_type string, dst_type string, category long, x double, y double, z double")
    q = category.nearest_category(e, c)
    assert {(r.src, r.dst): r.category for r in q.collect()} == {(1, 2): 1, (3, 4): None, (5, 6): 1}
    assert "SortMergeJoin" not in plan(q) and "BroadcastHashJoin" in plan(q)


def test_a_word_is_looked_at_once_a_task(spark, monkeypatch):
    import pyarrow as pa

    from meshloom.operators import words

    df = spark.range(0, 60_000, 1, 1).selectExpr("id", "IF(id % 7 = 6, NULL, concat('w', id % 7)) AS word")
    calls = spark.sparkContext.accumulator(0)

    def fn(w):
        calls.add(1)
        return (None if w is None else w * 2,)

    got = words.by_word(df, "twice string", [pa.string()], fn)
    assert got.filter("twice IS DISTINCT FROM concat(word, word)").count() == 0 and calls.value == 7
    g = spark.range(0, 40_000, 1, 1)
    nodes = g.selectExpr("id AS scene", "explode(sequence(0, 2 + id % 2)) AS n").selectExpr("scene", "CAST(n AS LONG) AS node", "IF(n = 0, 'O', 'A') AS ch")
    edges = nodes.filter("node > 0").selectExpr("scene", "explode(array(struct(0L AS src, node AS dst), struct(node AS src, 0L AS dst))) AS e").select("scene", "e.*")
    out = words.encode_graphs(nodes, edges, repeats=2)
    assert out.count() == 20_000 * 2 * (3 + 4) and out.groupBy(F.col("scene") % 2, "start", "repeat").agg(F.countDistinct("word", "node_ids").alias("n")).filter("n > 1").count() == 0


def test_cycle_words_go_round_without_joins(spark):
    q = catalogue.queries()["cycle_word_roundtrip"](spark, SF)
    assert "Join" not in plan(q) and q.filter("NOT same").count() == 0


def test_a_model_takes_matrices_and_lists(spark):
    from meshloom.operators import dataset

    class Lists(dataset.CharacterModel):
        def encode(self, words):
            return super().encode(words).tolist()

    w = spark.createDataFrame([(1, "O(A)N"), (2, ""), (3, "O")], "scene long, word string")
    for model in (dataset.CharacterModel(" ()ANOR", 6), Lists(" ()ANOR", 6)):
        assert {tuple(r) for r in dataset.decoded(dataset.encoded(w, model), model).collect()} == {(1, "O(A)N"), (2, ""), (3, "O")}
    assert isinstance(dataset.CharacterModel(" AB", 2).encode(["A"]), np.ndarray)


def test_configurations_are_found_by_the_rarest_one(spark):
    import random

    from meshloom.operators import grammar

    r = random.Random(4)
    make = lambda n: [(i, "O", a, b, *sorted((r.choice("ab"), r.choice("ab"))), r.randint(0, 12) / 4, 30.0) for i in range(n) for a, b in [(1, 2), (1, 3), (2, 3)][: r.randint(1, 3)]]
    schema = "node long, type string, l_dst long, r_dst long, b0 string, b1 string, dist double, size double"
    t, x = make(60), make(25)
    t += [(99, "O", 1, 2, "a", "a", 1.0, 30.0)] * 2 + [(98, "P", 1, 2, "a", "a", 1.0, 30.0), (97, "O", 1, 2, None, "a", 1.0, 30.0)]
    hit = lambda c, e: c[1] == e[1] and c[4:6] == e[4:6] and abs(c[6] - e[6]) < c[7] * 0.02
    own = lambda rows, n: [c for c in rows if c[0] == n]
    want = {n: n < 97 and any(all(any(hit(c, e) for e in own(x, k)) for c in own(t, n)) for k in range(25)) for n in {c[0] for c in t}}
    q = grammar.config_subset(spark.createDataFrame(t, schema), spark.createDataFrame(x, schema))
    assert {a.node: a.ok for a in q.collect()} == want and len(set(want.values())) == 2
    # copies ask and answer once
    twice = lambda rows: spark.createDataFrame(rows + [(c[0] + 1000, *c[1:]) for c in rows], schema)
    assert {a.node % 1000: a.ok for a in grammar.config_subset(twice(t), twice(x)).collect()} == want

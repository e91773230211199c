"""Steps that the third round's size findings name: scenes spread over tasks, contacts in batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import scenes as S
from meshloom.operators import generate
from meshloom.plans import generative

SF = "/root/testdata/sf0.001"


def _scene(n, seed, spread=6.0):
    r = np.random.Generator(np.random.PCG64(seed))
    return [S.Part("ANR"[i % 3], r.random((5, 3, 3)) * 3 + r.random(3) * spread) for i in range(n)]


@pytest.mark.parametrize("pairs", [1, 60, 50_000])
def test_contacts_do_not_depend_on_batches_and_grow_from_a_known_graph(monkeypatch, pairs):
    monkeypatch.setattr(S, "PAIRS", pairs)
    parts = _scene(14, 3)
    every = S.contact_graph(parts)
    alone = {i: [j for j in range(14) if j != i and S.contact_graph([parts[min(i, j)], parts[max(i, j)]])[0]] for i in range(14)}
    assert every == alone and 0 < sum(map(len, every.values())) < 14 * 13
    for k in (1, 2, 9, 13):
        assert S.contact_graph(parts, S.contact_graph(parts[:k])) == every
    assert S.contact_graph([]) == {} and S.contact_graph(parts[:1]) == {0: []}


def test_keys_of_few_bytes_are_spread_over_tasks(spark):
    f = generative._pairs(spark, "/root/testdata/sf0.01")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = generate.merge_parts(f, np.eye(3).tolist(), [0, 0, 0], lambda i: True, lambda i: True).withColumn("p", F.spark_partition_id())
    assert done.agg(F.countDistinct("p")).first()[0] > n / 2


def test_a_scan_makes_the_kinds_and_columns_that_are_asked_for(spark):
    from meshloom.sources import obj

    text = "v 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\nvn 0 0 1\nvt 0.5 0.25\no a\nusemtl red\nf 1 2 3 4\nl 1 2\np 3\no b\nf -1/1/1 2/1/1 3/1/1\nf 1 x 2\no c"
    files = spark.createDataFrame([("s", text), ("t", None), ("u", "f 1 2 9\nv 1 2 3")], "scene string, text string")
    every = obj.scan(files)
    assert {r["kind"]: r["count"] for r in every.groupBy("kind").count().collect()} == {"vertex": 5, "normal": 1, "texcoord": 1, "face": 4, "line": 1, "point": 1}
    for kinds in (["face"], ["vertex", "point"], ["line"], ["normal", "texcoord", "face"]):
        for columns in (["scene", "kind", "oid", "material"], ["scene", "idx", "x", "v1", "n3"], ["scene"]):
            names = [c for c in every.columns if c in columns]
            want = every.filter(F.col("kind").isin(kinds)).select(*names)
            assert sorted(map(str, obj.scan(files, kinds, columns).collect())) == sorted(map(str, want.collect()))
    assert [tuple(r) for r in obj.triangles(files).filter("fid = 2").select("oid", "material", "c").collect()] == [(1, "red", [0.0, 0, 1, 1, 0, 0, 0, 1, 0])]

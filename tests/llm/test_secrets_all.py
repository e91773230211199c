"""The network of the secret scanner is fitted and calibrated on all labelled findings."""

import numpy as np
from pyspark.sql import functions as F

from meshloom.llm import secretscan


def test_all_findings_are_used(spark, monkeypatch):
    monkeypatch.setattr(secretscan, "LABELLED", 40)
    monkeypatch.setattr(secretscan, "SHARD", 150)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    every = [r for r in secretscan.corpus_findings(docs, None).collect()]
    nets = [secretscan.trained_on_all(d) for d in (docs.coalesce(1), docs.repartition(7))]
    for net in nets:
        assert net.fitted == sum(not r.held and len(r.body) <= secretscan.FIT_CHARS for r in every) > 80
        assert net.judged == sum(r.held and r.y == 1 for r in every) > 0
        assert all(np.array_equal(net.p[k], nets[0].p[k]) for k in net.p) and net.threshold == nets[0].threshold
    rows, y = secretscan.labelled_findings(1500, 999)
    hit = nets[0].probability([secretscan.encode(*r) for r in rows]) >= nets[0].threshold
    assert hit[y == 1].mean() >= 0.9 and hit[y == 0].mean() <= 0.03
    own = [secretscan.encode(r.before, r.body, r.after) for r in every if r.held and r.y == 1]
    assert (nets[0].probability(own) >= nets[0].threshold).mean() >= 0.8
    assert secretscan.trained_on_all(docs.filter(F.lit(False))).fitted == 0

"""Edge categories: clustering relative translations, nearest centre, bounds, prefix, vote."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle, small, stored


#: Seeds that are broadcast to the points; more meet them by a salted join. SALTS parts of a cell that holds most points.
SEEDS, SALTS = 1_000_000, 32
_XYZ, _PAIR = ("x", "y", "z"), ("src_type", "dst_type")


def _apart(c: np.ndarray, bandwidth: float) -> np.ndarray:
    """Centres, in order of preference, without those within bandwidth of one taken before."""
    out: list[np.ndarray] = []
    for x in c:
        if all(((x - o) ** 2).sum() > bandwidth**2 for o in out):
            out.append(x)
    return np.array(out)


def shifted_seeds(points: DataFrame, rounds: int = 100) -> DataFrame:
    """src_type, dst_type, x, y, z, n: where flat-kernel mean shift leads from every occupied bin, and the points it holds there.

    points: src_type, dst_type, x, y, z, band (the pair's bandwidth, above 0). Each round a seed meets the points in the 27
    cells around it, as wide as the bandwidth, and moves to the mean of those within it; seeds that have come to rest leave,
    and seeds that meet go on as one. Seeds are one a cell at first, so a point meets some 27 of them, and a type pair of most
    points is spread over its cells. Seeds are broadcast up to a checked size, and sums are partial, so points are not shuffled.
    """
    at = lambda p: [F.floor(F.col(f"{p}{a}") / F.col("band")).cast("long") for a in _XYZ]
    own = points.select(*_PAIR, *_XYZ, "band", *[c.alias(f"i{a}") for c, a in zip(at(""), _XYZ)])
    bins = own.select(*_PAIR, "band", *[(F.round(F.col(a) / F.col("band")) * F.col("band")).alias(f"s{a}") for a in _XYZ])
    seeds, done = settle(bins.distinct()), None

    def around(seeds: DataFrame) -> DataFrame:
        """Seeds with the number and the means of the points within their bandwidth."""
        s = seeds.select(*_PAIR, "sx", "sy", "sz", *[c.alias(f"i{a}") for c, a in zip(at("s"), _XYZ)])
        for a in _XYZ:
            s = s.withColumn(f"i{a}", F.explode(F.array(*[F.col(f"i{a}") + d for d in (-1, 0, 1)])))
        key = [*_PAIR, "ix", "iy", "iz"]
        if seeds.count() * 27 <= SEEDS:
            met = own.join(F.broadcast(s), key)
        else:
            salted = s.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = own.withColumn("salt", F.pmod(F.xxhash64(*_XYZ), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"])
        gap = sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in "yz"), (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")))
        return met.filter(gap <= F.col("band") * F.col("band")).groupBy(*_PAIR, "band", "sx", "sy", "sz").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in _XYZ])

    for _ in range(rounds):
        moved = around(seeds)
        step = sum((F.pow(F.col(a) - F.col(f"s{a}"), F.lit(2.0)) for a in "yz"), F.pow(F.col("x") - F.col("sx"), F.lit(2.0)))
        moved = settle(moved.withColumn("rest", step < F.pow(F.col("band") * 1e-3, F.lit(2.0))))
        rest = moved.filter("rest").select(*_PAIR, "band", "sx", "sy", "sz")
        done = rest if done is None else done.unionByName(rest)
        seeds = settle(moved.filter("NOT rest").select(*_PAIR, "band", *[F.round(a, 12).alias(f"s{a}") for a in _XYZ]).distinct())
        if seeds.isEmpty():
            break
    ends = settle(done.unionByName(seeds).select(*_PAIR, "band", *[F.round(f"s{a}", 12).alias(f"s{a}") for a in _XYZ]).distinct())
    return around(ends).select(*_PAIR, "band", *[F.col(f"s{a}").alias(a) for a in _XYZ], "n")


def merge_close(centres: np.ndarray, limit: float, least: int) -> np.ndarray:
    """Centres with the nearest pairs under limit replaced by their mean, down to `least` centres (CL2)."""
    c = [np.array(x) for x in centres]
    while len(c) > max(least, 1):
        d = [(float(np.linalg.norm(c[i] - c[j])), i, j) for i in range(len(c)) for j in range(i)]
        best = min(d)
        if best[0] >= limit:
            break
        _, i, j = best
        c[j] = (c[i] + c[j]) / 2
        del c[i]
    return np.array(c)


def edge_categories(poses: DataFrame, bandwidth: float = 0.2, merge: float = 0.25) -> DataFrame:
    """src_type, dst_type, local_id, x, y, z: centres of relative translations by type pair (CL1, CL2).

    poses: src, src_type, dst_type, x, y, z, size. A pair's bandwidth follows the size in its first row by (src, x, y, z), and
    merging stops at the largest number of the pair's edges at a node. Points shift by joins (shifted_seeds); only the ends of
    seeds, of which those within a bandwidth of a fuller one are left out, meet in a group. Pairs whose first size is 0 keep
    their distinct translations. Empty table: empty.
    """
    poses = stored(poses.select("src", *_PAIR, *_XYZ, "size"), "poses")
    first = F.min(F.struct("src", *_XYZ, "size"))["size"].cast("double").alias("first")
    degree = poses.groupBy(*_PAIR, "src").agg(F.count("*").alias("k")).groupBy(*_PAIR).agg(F.max("k").alias("least"))
    pairs = settle(poses.groupBy(*_PAIR).agg(first).join(degree, list(_PAIR)))
    few = pairs.count() <= SEEDS
    p = poses.select(*_PAIR, *[F.col(a).cast("double").alias(a) for a in _XYZ]).join(F.broadcast(pairs) if few else pairs, list(_PAIR)).withColumn("band", F.col("first") * bandwidth)
    ends = shifted_seeds(p.filter("band > 0")).select(*_PAIR, *_XYZ, "n")
    ends = ends.unionByName(p.filter("band <= 0").select(*_PAIR, *_XYZ).distinct().withColumn("n", F.lit(1).cast("long")))

    def run(pdf):
        import pandas as pd

        size, least = float(pdf["first"].iloc[0]), int(pdf["least"].iloc[0])
        pdf = pdf.sort_values(["n", *_XYZ], ascending=[False, True, True, True])
        c = pdf[list(_XYZ)].to_numpy(float)
        c = merge_close(_apart(c, bandwidth * size) if bandwidth * size > 0 else c, merge * size, least)
        c = c[np.lexsort(c.T[::-1])]
        return pd.DataFrame({"src_type": pdf["src_type"].iloc[0], "dst_type": pdf["dst_type"].iloc[0], "local_id": range(len(c)), "x": c[:, 0], "y": c[:, 1], "z": c[:, 2]})

    t = poses.schema["src_type"].dataType.simpleString()
    return ends.join(pairs, list(_PAIR)).groupBy(*_PAIR).applyInPandas(run, f"src_type {t}, dst_type {t}, local_id long, x double, y double, z double")


def category_prefix(counts: DataFrame) -> DataFrame:
    """counts(src_type, dst_type, n) with prefix: centres of all pairs before, so that local ids become global (AG12). One row per type pair is ordered."""
    w = Window.orderBy("src_type", "dst_type").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("prefix", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def nearest_category(poses: DataFrame, centres: DataFrame) -> DataFrame:
    """src, dst, category: the nearest centre of the edge's type pair, ties to the smaller id; null where the pair has none (CL4).
    A pair's centres are a row, so an edge is a row as well, and edges are not shuffled to meet them where pairs are few."""
    c = centres.groupBy(*_PAIR).agg(F.collect_list(F.struct("category", *[F.col(a).alias(f"c{a}") for a in _XYZ])).alias("centres"))
    gap = lambda c: F.sqrt(sum((F.pow(F.col(a) - c[f"c{a}"], F.lit(2.0)) for a in "yz"), F.pow(F.col("x") - c["cx"], F.lit(2.0))))
    best = F.array_min(F.transform("centres", lambda c: F.struct(F.round(gap(c), 6).alias("d"), c["category"].alias("category"))))
    hit = poses.join(small(c), list(_PAIR), "left").select("src", "dst", best.alias("best"))
    return hit.groupBy("src", "dst").agg(F.min("best")["category"].alias("category"))


def both_directions(poses: DataFrame) -> DataFrame:
    """poses and their reverses, translations negated (CL5)."""
    back = poses.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), *[(-F.col(a)).alias(a) for a in "xyz"])
    return poses.select(*back.columns).unionByName(back)


def majority_vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, category: the most frequent category, ties to the smallest (AG9); counts are partially aggregated."""
    n = votes.groupBy(*keys, "category").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("category")))["category"].alias("category"))


def category_bounds(edges: DataFrame, prefix: DataFrame, total: int) -> DataFrame:
    """edges(scene, pos, src_type, dst_type) with lo, hi: the categories the type pair may take (CL6); [0, total) where unknown."""
    p = prefix.select("src_type", "dst_type", F.col("prefix").alias("lo"), (F.col("prefix") + F.col("n")).alias("hi"))
    return edges.join(p, ["src_type", "dst_type"], "left").select("scene", "pos", F.coalesce("lo", F.lit(0)).cast("long").alias("lo"), F.coalesce("hi", F.lit(total)).cast("long").alias("hi"))


def mask(lo, hi, total: int):
    """Array of `total` booleans, true in [lo, hi) (EN5)."""
    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda k: (k >= lo) & (k < hi))


def missing_category_pairs(target: DataFrame, examples: DataFrame) -> DataFrame:
    """(category, reverse) pairs of the target that no example holds (JN11)."""
    return target.select("category", "reverse").distinct().join(examples.select("category", "reverse").distinct(), ["category", "reverse"], "left_anti")


def with_reverse_category(edges: DataFrame) -> DataFrame:
    """edges(src, dst, category) with reverse, the category of the edge back (JN15)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("category").alias("reverse"))
    return edges.join(back, ["src", "dst"], "left")


def corresponding_edges(wanted: DataFrame, examples: DataFrame) -> DataFrame:
    """category, reverse, src, dst, tier: for each wanted pair of categories a hashed example edge with both (tier 0), else one
    with the first only (1), else none (JN12). Example edges hold both directions, so an edge the other way round is one too."""
    h = F.struct(F.md5(F.concat_ws(":", "src", "dst")).alias("h"), "src", "dst")
    both = examples.groupBy("category", "reverse").agg(F.min(h).alias("both"))
    # the best edge of a category whose reverse differs: the best of all pairs of the category but the wanted one
    rest = both.select("category", F.col("reverse").alias("other"), F.col("both").alias("m"))
    one = wanted.join(rest, "category").filter("other <> reverse").groupBy("category", "reverse").agg(F.min("m").alias("one"))
    out = wanted.join(both, ["category", "reverse"], "left").join(one, ["category", "reverse"], "left")
    pick = F.coalesce("both", "one")
    tier = F.when(F.col("both").isNotNull(), 0).when(F.col("one").isNotNull(), 1).cast("long")
    return out.select("category", "reverse", pick["src"].alias("src"), pick["dst"].alias("dst"), tier.alias("tier"))


def types_beyond(edges: DataFrame) -> DataFrame:
    """category, kind, there: the type at the far end of the first edge of a category whose near end has a type (JN14).
    edges: category, kind, to, src, dst, both directions."""
    return edges.groupBy("category", "kind").agg(F.min_by("to", F.struct("src", "dst")).alias("there"))

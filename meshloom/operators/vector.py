"""Vector operators: nearest neighbours, waypoints, interpolation, triplets, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

#: Query vectors and candidates that meet in one group.
BLOCK, RANGE = 8192, 65_536


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(q: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the ids and distances of the k nearest rows of c by (distance, id).

    A matrix product gives squared distances up to a bounded rounding error; every candidate within that bound of the k-th
    is measured directly, so ties and cancellation lose none.
    """
    out = []
    n_q, n_c = (q**2).sum(1), (c**2).sum(1)
    near = n_q[:, None] + n_c[None] - 2 * q @ c.T
    # rounding of the sums and the product, with room to spare
    slack = 8 * (q.shape[1] + 4) * np.finfo(float).eps * (n_q + n_c.max(initial=0.0))
    for r in range(len(q)):
        at = np.arange(len(c_id))
        if len(at) > k:
            edge = np.partition(near[r], k - 1)[k - 1] if k else 0.0
            at = np.flatnonzero(near[r] <= edge + 2 * slack[r])
        d = np.sqrt(((c[at] - q[r]) ** 2).sum(1))
        order = np.lexsort((c_id[at], d))[:k]
        out.append((c_id[at][order], d[order]))
    return out


def _nearest_groups(k: int, include_self: bool):
    """Rows sorted by group, queries first -> each query's k nearest candidates of the group and of one batch."""

    def run(it):
        now, q_id, q, held = None, [], np.zeros((0, 0)), []
        for rb in it:
            group, side = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])) if len(group) else []
            for lo, hi in zip(edge, [*edge[1:], len(group)]):
                part = rb.slice(lo, hi - lo)
                if group[lo] != now:
                    now, q_id, held = group[lo], [], []
                if side[lo] == 0:
                    q_id += part.column(2).to_numpy().tolist()
                    held.append(_matrix(part.column(3)))
                    continue
                if held and len(held) > 1 or len(held) == 1 and held[0] is not q:
                    q = np.concatenate(held)
                    held = [q]
                c_id, c = part.column(2).to_numpy(), _matrix(part.column(3))
                cols: list[list] = [[], [], []]
                for a in range(0, len(q_id), 256):
                    for i, (ids, d) in zip(q_id[a : a + 256], nearest(q[a : a + 256], c, c_id, k + (not include_self))):
                        ok = np.ones(len(ids), bool) if include_self else ids != i
                        ids, d = ids[ok][:k], d[ok][:k]
                        cols[0].append(np.full(len(ids), i)), cols[1].append(ids), cols[2].append(d)
                if cols[0]:
                    a, b, d = (np.concatenate(x) for x in cols)
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(d.astype(float))], ["a", "b", "d"])

    return run


def knn(vectors: DataFrame, k: int, include_self: bool = False, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """a, b, rank, d: the k nearest of each vector by (distance, id) (TK1). vectors(id, v), all of one length, ids distinct.

    Queries are dealt into blocks and candidates into ranges; every block meets every range in one group of one job, whose
    tasks hold a block and one batch, and a grouped rank merges what they keep. Nothing is gathered or broadcast.
    """
    rows = settle(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL"))
    n = rows.count()
    blocks, ranges = max(1, -(-n // block)), max(1, -(-n // span))
    deal = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m)).cast("long")
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    q = rows.withColumn("b", deal("query", blocks)).withColumn("r", each(ranges)).withColumn("side", F.lit(0))
    c = rows.withColumn("r", deal("candidate", ranges)).withColumn("b", each(blocks)).withColumn("side", F.lit(1))
    both = q.unionByName(c).select((F.col("b") * ranges + F.col("r")).alias("grp"), "side", "id", "v")
    found = both.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(_nearest_groups(k, include_self), "a long, b long, d double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b")).cast("long")).filter(F.col("rank") <= k)
    return found.select("a", "b", "rank", "d")


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def waypoints(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, waypoint: for each pair (pair, a, b) the vector that the shortest detour a - x - b passes, other than the ends (TK3). pairs should be few."""
    v = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    p = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    d = p.join(v, (F.col("id") != F.col("a")) & (F.col("id") != F.col("b"))).select("pair", "id", F.round(euclid(F.col("va"), F.col("v")) + euclid(F.col("vb"), F.col("v")), 6).alias("d"))
    return d.groupBy("pair").agg(F.min(F.struct("d", "id")).alias("m")).select("pair", F.col("m.id").alias("waypoint"), F.col("m.d").alias("d"))


def latent_path(vectors: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """pair, step, id: the path that repeated waypoints refine, 2 ** depth - 1 waypoints (TK3). One round per depth for all pairs."""
    legs = pairs.select("pair", F.lit(0).cast("long").alias("at"), "a", "b")
    for _ in range(depth):
        key = legs.withColumn("leg", F.struct("pair", "at"))
        mid = waypoints(vectors, key.select(F.col("leg").alias("pair"), "a", "b")).select(F.col("pair").alias("leg"), "waypoint")
        m = key.join(mid, "leg")
        legs = settle(m.select("pair", (F.col("at") * 2).alias("at"), "a", F.col("waypoint").alias("b")).unionByName(m.select("pair", (F.col("at") * 2 + 1).alias("at"), F.col("waypoint").alias("a"), "b")))
    return legs.select("pair", F.col("at").alias("step"), F.col("a").alias("id"))


def interpolate(vectors: DataFrame, pairs: DataFrame, steps: list[float], noise: float = 0.0, seed: int = 1) -> DataFrame:
    """pair, k, v: (1 - k) a + k b for each step, with hashed noise on request (TK4)."""
    v = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    p = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    p = p.select("pair", "va", "vb", F.explode(F.array(*[F.lit(float(s)) for s in steps])).alias("k"))
    mixed = F.zip_with("va", "vb", lambda x, y: x * (1 - F.col("k")) + y * F.col("k"))
    if noise:
        u = lambda i: F.pmod(F.xxhash64("pair", "k", i, F.lit(seed)), F.lit(2_000_001)) / 1_000_000 - 1
        mixed = F.transform(mixed, lambda x, i: x + u(i) * F.lit(noise))
    return p.select("pair", "k", mixed.alias("v"))


def prior_sample(spark, n: int, dim: int, seed: int = 1) -> DataFrame:
    """id, v: n vectors of independent standard normal components, the same ones for a seed (TK5).

    Each pair of hashed uniform numbers gives a normal one by the polar form of Box and Muller.
    """
    u = lambda salt, i: (F.pmod(F.xxhash64("id", i, F.lit(salt), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return spark.range(n).select("id", normal_vector(F.lit(dim), u).alias("v"))


def normal_vector(dim: Column, uniform) -> Column:
    """dim independent standard normal numbers; uniform(salt, place) is a hashed number in (0, 1)."""
    normal = lambda i: F.sqrt(-2 * F.log(uniform(1, i))) * F.cos(2 * np.pi * uniform(2, i))
    return F.transform(F.sequence(F.lit(0), dim - 1), normal)


def hashed_rank(key: Column, seed: str = "") -> Column:
    """The order that samples follow: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows without replacement, the same ones each run (TK7)."""
    return df.orderBy(hashed_rank(F.col(key), seed), key).limit(n)


def hash_split(df: DataFrame, key: str, share: float = 0.2, seed: str = "") -> DataFrame:
    """df with split, test for about `share` of the keys and train for the rest (EN6)."""
    byte = F.conv(F.substring(hashed_rank(F.col(key), seed), 1, 4), 16, 10).cast("int")
    return df.withColumn("split", F.when(byte < int(65536 * share), "test").otherwise("train"))


#: Rows of a pool that every anchor ranks, and that are broadcast.
POOL = 100_000


def mine_triplets(anchors: DataFrame, pool: DataFrame, distance, m: int = 10) -> DataFrame:
    """anchor, positive, negative: nearest and farthest of the m pool rows that a hash draws for each anchor (TK8).

    anchors(id, w), pool(id, w); pool is a bounded sample, since every anchor ranks all of it: one of over POOL rows is refused.
    """
    if pool.limit(POOL + 1).count() > POOL:
        raise ValueError(f"a pool of over {POOL} rows: draw a sample first")
    a, p = anchors.select(F.col("id").alias("anchor"), F.col("w").alias("wa")), pool.select(F.col("id").alias("other"), F.col("w").alias("wo"))
    c = a.join(F.broadcast(p), F.col("anchor") != F.col("other"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.md5(F.concat_ws(":", "anchor", "other")), "other"))
    c = c.withColumn("r", rank).filter(F.col("r") <= m).withColumn("d", distance(F.col("wa"), F.col("wo")))
    return c.groupBy("anchor").agg(F.min(F.struct("d", "other"))["other"].alias("positive"), F.max(F.struct("d", "other"))["other"].alias("negative"))

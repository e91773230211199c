"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Queries and candidates that meet in one group: bounds of a task's score arrays and lists.
QUERY_BLOCK, RANGE = 16_384, 131_072
#: Candidates scored at a time.
BATCH = 16_384


def quantise(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vectors(vec_id, embedding) -> (uid, vec_id, v): v the components as doubles times scale, to be floored. Rows that take no part are left out."""
    x = F.transform("embedding", lambda c: c.cast("double") * F.lit(scale))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * F.lit(scale)) == float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~F.coalesce(bad, F.lit(True)))
    return own.select(F.monotonically_increasing_id().alias("uid"), "vec_id", x.alias("v"))


def dense(column: pa.Array, wide: bool = False) -> np.ndarray:
    """A list column floored to a matrix of int64, or of Python integers where wide; rows shorter than the longest are filled with 0."""
    n = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), object if wide else np.int64)
    flat = np.array([int(x) for x in flat], object) if wide else flat.astype(np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Postings:
    """One batch of candidates by term: for each dimension the rows that hold it and their weights."""

    def __init__(self, m: np.ndarray):
        self.rows, self.kind, self.terms = len(m), m.dtype, []
        for t in range(m.shape[1]):
            at = np.flatnonzero(m[:, t])
            # a list held by most rows is cheaper to add as a whole column
            self.terms.append((None, np.ascontiguousarray(m[:, t])) if 4 * len(at) > self.rows else (at, m[at, t]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows, self.kind)
        for t in np.flatnonzero(query[: len(self.terms)]):
            at, w = self.terms[t]
            if at is None:
                out += query[t] * w
            elif len(at):
                out[at] += query[t] * w
        return out


def select(score: np.ndarray, vec: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, vec, uid)."""
    at = np.arange(len(score))
    if len(score) > k:
        edge = np.sort(score)[len(score) - k] if score.dtype == object else np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    if score.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-score[i], vec[i], uid[i]))[:k], np.int64)
    return at[np.lexsort((uid[at], vec[at], -score[at]))][:k]


def ordered(score: int) -> bytes:
    """Bytes that sort as the integers do, for any size of integer."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    size = len(raw).to_bytes(3, "big")
    return b"\1" + size + raw if score >= 0 else b"\0" + bytes(255 - x for x in size + raw) + b"\xff"


_FOUND = "q_uid long, query_id long, vec_id long, uid long, score long, big binary"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _search(k: int, wide: bool):
    """Rows sorted by group, queries first -> each query's k best candidates of the group. Memory holds a group's queries and one batch."""

    def out(q_uid, q_vec, best):
        for lo in range(0, len(best), 512):
            part = [(i, b) for i, b in enumerate(best[lo : lo + 512], lo) if b is not None]
            if not part:
                continue
            n = [len(b[0]) for _, b in part]
            score = np.concatenate([b[0] for _, b in part])
            cols = [np.repeat([q_uid[i] for i, _ in part], n), np.repeat([q_vec[i] for i, _ in part], n), *(np.concatenate([b[j] for _, b in part]) for j in (1, 2))]
            big = pa.array([ordered(s) for s in score], pa.binary()) if wide else pa.nulls(len(score), pa.binary())
            if wide:
                score = np.array([max(min(s, 2**63 - 1), -(2**63)) for s in score], np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in cols), pa.array(score.astype(np.int64)), big], _NAMES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_uid, q_vec, q, held, best = None, [], [], [], [], []
        for rb in it:
            group, side = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])) if len(group) else []
            for lo, hi in zip(edge, [*edge[1:], len(group)]):
                if group[lo] != now:
                    yield from out(q_uid, q_vec, best)
                    now, q_uid, q_vec, q, held, best = group[lo], [], [], [], [], []
                part = rb.slice(lo, hi - lo)
                uid, vec = part.column(2).to_numpy(), part.column(3).to_numpy()
                if side[lo] == 0:
                    q_uid += uid.tolist()
                    q_vec += vec.tolist()
                    held.append(part.column(4))
                    continue
                if held:
                    q = [row for c in held for row in dense(c, wide)]
                    held, best = [], [None] * len(q)
                for a in range(0, len(uid) if q else 0, BATCH):
                    u, v = uid[a : a + BATCH], vec[a : a + BATCH]
                    posts = Postings(dense(part.column(4).slice(a, BATCH), wide))
                    for i, row in enumerate(q):
                        score = posts.scores(row)
                        # one more than k, since the query's own row may be among them
                        at = select(score, v, u, k + 1)
                        at = at[u[at] != q_uid[i]][:k]
                        new = (score[at], v[at], u[at])
                        if best[i] is not None:
                            new = tuple(np.concatenate(x) for x in zip(best[i], new, strict=True))
                            at = select(*new, k)
                            new = tuple(x[at] for x in new)
                        best[i] = new
        yield from out(q_uid, q_vec, best)

    return run


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = QUERY_BLOCK, span: int = RANGE) -> DataFrame:
    """The k best rows for each query: query_id, rank from 1, vec_id, score.

    Queries are rows whose vec_id is divisible by every; candidates are all other rows. Components become
    floor(scale * x), scores are integer inner products, ties go to the smaller vec_id. Queries are dealt into blocks of
    about `block` and candidates into ranges of about `span`; every block meets every range in one group of one job, which
    scatters the postings of its candidates into a score array per query and keeps k, and a grouped rank merges the ranges'
    lists. Nothing is gathered or broadcast; with Q queries and N candidates Q * N / span + N * Q / block rows are shuffled.

    Null vectors, null or non-finite components (also after scaling) and null vec_id take no part; an empty vector scores 0; a shorter vector
    counts as 0 where it has no component. Where the largest component and dimension allow a sum beyond 64 bits, scores are
    Python integers throughout, so ranks stay exact; a score beyond 64 bits is returned as the nearest long. Repeated rows
    are queries and candidates of their own. No query or no candidate: empty.
    """
    rows = cut(quantise(vectors, scale))
    ask = F.col("vec_id") % every == 0
    top = F.array_max(F.transform("v", F.abs)) + 1
    seen = rows.agg(F.count("*").alias("n"), F.count(F.when(ask, 1)).alias("q"), F.max(F.size("v")).alias("dim"), F.max(top).alias("top")).first()
    wide = float(seen["top"] or 0) ** 2 * (seen["dim"] or 0) >= 2.0**62
    blocks, ranges = max(1, -(-seen["q"] // block)), max(1, -(-seen["n"] // span))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(n)).cast("long")
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = rows.filter(ask).withColumn("b", deal("query", blocks)).withColumn("r", every_of(ranges)).withColumn("side", F.lit(0))
    others = rows.withColumn("r", deal("candidate", ranges)).withColumn("b", every_of(blocks)).withColumn("side", F.lit(1))
    both = queries.unionByName(others).select((F.col("b") * ranges + F.col("r")).alias("grp"), "side", "uid", "vec_id", "v")
    found = both.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(_search(k, wide), _FOUND)
    best = [F.col("big" if wide else "score").desc(), F.col("vec_id"), F.col("uid")]
    rank = F.row_number().over(Window.partitionBy("q_uid").orderBy(*best))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

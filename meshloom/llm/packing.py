"""Packing documents into token windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .neardup import _groups
from .tokens import encoder

#: What follows a document's own ids.
END_ID = 1
#: A document's rest beyond full windows is cut into pieces of this many ids at most, so that windows can be made equal.
PIECE = 512
#: Windows' worth of pieces that one group differences; memory and time of a group follow it.
GROUP_WINDOWS = 64


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: item positions of each of `ways` parts with near-equal sums.

    Each item starts as a partial partition with one filled part. The two partial partitions of largest imbalance are
    merged, the fullest parts of one onto the emptiest of the other, until one is left.
    """
    if ways == 1:
        return [list(range(len(sizes)))]
    heap = []
    for n, (s, i) in enumerate(sorted(((s, i) for i, s in enumerate(sizes)), reverse=True)):
        heap.append((-s, n, [s], [[i]]))  # parts in descending order; parts not listed are empty
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(a) + len(b) <= ways:  # every filled part of one meets an empty part of the other
            order = sorted(range(len(a) + len(b)), key=(a + b).__getitem__, reverse=True)
            both, parts = a + b, x + y
            heapq.heappush(heap, (-both[order[0]] + (both[order[-1]] if len(both) == ways else 0), n, [both[j] for j in order], [parts[j] for j in order]))
            n += 1
            continue
        sums, parts = a + [0] * (ways - len(a)), x + [[] for _ in range(ways - len(x))]
        for j, (s, p) in enumerate(zip(b, y)):
            sums[ways - 1 - j] += s
            parts[ways - 1 - j] = parts[ways - 1 - j] + p
        order = sorted(range(ways), key=sums.__getitem__, reverse=True)
        sums, parts = [sums[j] for j in order], [parts[j] for j in order]
        low = sums[-1]
        if low:  # the imbalance alone counts in what follows
            sums = [s - low for s in sums]
        while sums and not sums[-1] and not parts[-1]:
            sums.pop(), parts.pop()
        heapq.heappush(heap, (-sums[0] if sums else 0, n, sums, parts))
        n += 1
    parts = heap[0][3] if heap else []
    return parts + [[] for _ in range(ways - len(parts))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item positions of each window: as few windows as the total needs, one more each time a window exceeds capacity."""
    if not sizes:
        return []
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [sorted(p) for p in parts if p]
        ways += 1


def cut_points(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then its rest in equal parts of at most `piece`."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, begin = n - full * capacity, full * capacity
    if rest:
        k = -(-rest // piece)
        edge = [begin + rest * j // k for j in range(k + 1)]
        out += [(a, b - a) for a, b in zip(edge, edge[1:])]
    return out


def _pieces(paths: tuple[str, str, str], capacity: int, piece: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*paths)
        end = np.array([END_ID], "<u4").tobytes()
        for rb in it:
            cols: list[list] = [[], [], [], [], []]
            for i, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                ids = memoryview(enc.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                for start, length in cut_points(n, capacity, piece):
                    for c, v in zip(cols, (i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(capacity: int):
    def run(it):
        for g in _groups(it, "grp"):
            g = g.sort_values(["length", "doc_id", "start", "slot"], ascending=[False, True, True, True], kind="stable")
            size = g["length"].to_numpy()
            full = int((size == capacity).sum())
            parts = [[i] for i in range(full)] + [[full + i for i in p] for p in windows(size[full:].tolist(), capacity)]
            seq, off = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            for s, p in enumerate(parts):
                seq[p] = s
                off[p] = np.concatenate([[0], np.cumsum(size[p])[:-1]])
            g["sequence_id"], g["offset"] = (g["grp"].to_numpy().astype(np.int64) << 32) + seq, off
            yield g[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack_documents(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int = 2048, piece: int = PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Pieces of documents in windows of at most capacity ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and END_ID. It gives full windows first; its rest goes in equal pieces of at most `piece`. Pieces
    are dealt by a hash of the row into groups of about group_windows windows, however large a document or source is;
    each group is differenced on its own, so memory is bounded and every group is one task's work of equal size. Windows
    start at the count the group's ids need and rise by one while any exceeds capacity.

    Null and empty texts: the end id alone. Long texts: as many full windows as needed. Repeated rows: each is packed. Null
    doc_id: packed with a null id. Empty table: empty. Only doc_id and text are read.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = cut(two.mapInArrow(_pieces((json_path, rank_path, pattern), capacity, piece), schema).withColumn("slot", F.monotonically_increasing_id()))
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * group_windows)))
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("slot"), F.lit(groups))).repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInPandas(_pack(capacity), schema + ", sequence_id long, offset long")

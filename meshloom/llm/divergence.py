"""How sources of a language diverge in their use of terms: mergeable radix tries with counters by source in their leaves."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappush, heapreplace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HUBS, cut

#: Bytes at which a partition's trie is cut into parts that travel; a part of more than LEAVES leaves is cut again, STEP bytes further down.
DEPTH, STEP, LEAVES = 3, 3, 200_000
#: Terms, distinct (term, source) entries and bytes of long terms that a task counts before it sends its tries on; words it counts at a time.
TERMS, ENTRIES, TERM_BYTES, WORDS = 500_000, 3_000_000, 64_000_000, 1_500_000
#: Bytes that neighbouring leaves are compared by; terms of more are long.
LONG = 64
#: Entries of kept terms in a shard, and sources in a block: bounds of a traversal task's rows and of its sums (BLOCK * BLOCK longs).
SHARD, BLOCK = 50_000, 256
SCALE = 1_000_000_000
#: Bytes of terms: A-Z to a-z, other letters and all bytes of longer characters as they are, the rest to a space.
_TERM = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


class Trie:
    """A radix trie over byte strings, kept flat in preorder: leaves in UTF-8 order, each of which counts documents and occurrences by source.

    Written out, a leaf's edge is what follows the bytes that it shares with the leaf before it.
    """

    def __init__(self, terms: list[bytes], docs: np.ndarray, begin: np.ndarray, who: np.ndarray, count: np.ndarray):
        self.terms, self.docs, self.begin, self.who, self.count = terms, docs, begin, who, count

    @staticmethod
    def of(terms: list[bytes], at: np.ndarray, docs: np.ndarray, who: np.ndarray, count: np.ndarray) -> Trie:
        """The trie of entries: at the number of an entry's term in terms, with its documents, source and occurrences; equal entries are summed."""
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        key = rank[at] << 32 | who
        by = np.argsort(key, kind="stable")
        key = key[by]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        docs, count, key = np.add.reduceat(docs[by], edge), np.add.reduceat(count[by], edge), key[edge]
        leaf = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        return Trie([terms[order[r]] for r in (key[leaf] >> 32).tolist()], np.add.reduceat(docs, leaf), np.append(leaf, len(key)), key & 0xFFFFFFFF, count)

    def shared(self) -> np.ndarray:
        """Bytes (LONG at most) that each leaf shares with the one before it."""
        head = np.array([t[:LONG] for t in self.terms], f"S{LONG}").view(np.uint8).reshape(-1, LONG)
        size = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        same = np.zeros(len(size), np.int64)
        differ = head[1:] != head[:-1]
        same[1:] = np.where(differ.any(1), differ.argmax(1), LONG)
        return np.minimum(same, np.minimum(size, np.append(0, size[:-1])))

    def parts(self, lang: str, before: bytes, depth: int, names: list[str]) -> pa.RecordBatch:
        """A row for each prefix of `depth` bytes: before and the prefix, and the leaves below it. Terms that end earlier are prefixes of their own."""
        shared, n = self.shared(), len(self.terms)
        size = np.fromiter(map(len, self.terms), np.int64, n)
        new = shared < np.minimum(depth, size)
        new[:1] = True
        first = np.flatnonzero(new)
        cut_off = np.minimum(depth, size)
        kept = np.where(new, 0, shared - depth)
        tails = [t[c + k :] for t, c, k in zip(self.terms, cut_off.tolist(), kept.tolist())]
        tail = np.fromiter(map(len, tails), np.int64, n)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        entry = np.repeat(row, np.diff(self.begin))
        # sources are numbered within each row
        own, number = np.unique(entry * len(names) + self.who, return_inverse=True)
        starts = np.searchsorted(own, np.arange(len(first) + 1) * len(names))
        lists = lambda ends, flat: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
        leaf, held = np.append(first, n), self.begin[np.append(first, n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(first), pa.string()),
                pa.array([before + self.terms[i][:depth] for i in first.tolist()], pa.binary()),
                pa.array(np.diff(leaf), pa.int64()),
                pa.array((np.add.reduceat(tail + kept, first) > 0), pa.bool_()),
                lists(starts, pa.array([names[i] for i in (own % len(names)).tolist()], pa.string())),
                pa.array([b"".join(tails[i:j]) for i, j in zip(leaf, leaf[1:])], pa.binary()),
                lists(leaf, pa.array(kept.astype(np.int32))),
                lists(leaf, pa.array(tail.astype(np.int32))),
                lists(leaf, pa.array(self.docs)),
                lists(leaf, pa.array(np.diff(self.begin).astype(np.int32))),
                lists(held, pa.array((number - starts[entry]).astype(np.int32))),
                lists(held, pa.array(self.count)),
            ],
            _PART_NAMES,
        )


#: What a part says: whether any of its terms goes beyond the prefix, its sources, and by leaf what it shares and adds, documents and entries.
_PART = "lang string, prefix binary, n long, more boolean, names array<string>, tails binary, shared array<int>, added array<int>, docs array<long>, wide array<int>, who array<int>, count array<long>"
_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]


class _Open:
    """A part read back: terms without the prefix, and arrays."""

    def __init__(self, rb: pa.RecordBatch, i: int):
        self.lang, self.prefix, _, _, self.names, tails = (rb.column(k)[i].as_py() for k in range(6))
        shared, added, self.docs, self.wide, self.who, self.count = (rb.column(k)[i].values.to_numpy() for k in range(6, 12))
        self.terms, at, last = [], 0, b""
        for s, a in zip(shared.tolist(), added.tolist()):
            last = last[:s] + tails[at : at + a]
            self.terms.append(last)
            at += a


def _joined(parts: list[_Open]) -> tuple[Trie, list[str]]:
    """Parts of one prefix merged, with the names of their sources."""
    index, number = defaultdict(count().__next__), defaultdict(count().__next__)
    at, docs, who, n = [], [], [], []
    for p in parts:
        ids = np.fromiter(map(index.__getitem__, p.terms), np.int64, len(p.terms))
        own = np.fromiter(map(number.__getitem__, p.names), np.int64, len(p.names))
        at.append(np.repeat(ids, p.wide))
        # a leaf's documents stand at its first entry
        d = np.zeros(len(p.who), np.int64)
        d[np.cumsum(p.wide) - p.wide] = p.docs
        docs.append(d), who.append(own[p.who]), n.append(p.count)
    return Trie.of(list(index), *map(np.concatenate, (at, docs, who, n))), list(number)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (text, lang, source) -> parts of a trie a language, sent on whenever a task holds TERMS or ENTRIES."""
    # term -> id, (lang, source) -> group; numbers begin at 0 again after each flush
    fresh = lambda: (defaultdict(count().__next__), defaultdict(count().__next__))
    index, number = fresh()
    ids, sizes, groups, held, long = [], [], [], [], 0

    def chunk():
        """Words since the last chunk, as distinct (group, term) with documents and occurrences."""
        if ids:
            doc = np.repeat(np.arange(len(sizes)), sizes)
            key, n = np.unique(doc << 32 | np.array(ids, np.int64), return_counts=True)
            held.append((np.array(groups, np.int64)[key >> 32] << 32 | key & 0xFFFFFFFF, np.ones(len(key), np.int64), n))
            ids.clear(), sizes.clear(), groups.clear()
        if held:
            key, docs, n = map(np.concatenate, zip(*held))
            by = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.diff(key[by], prepend=-1))
            held[:] = [(key[by][edge], np.add.reduceat(docs[by], edge), np.add.reduceat(n[by], edge))]

    def flush():
        nonlocal index, number
        if held:
            key, docs, n = held[0]
            terms, names = list(index), list(number)
            langs = np.unique([x for x, _ in names], return_inverse=True)
            of = langs[1][key >> 32]
            for k, lang in enumerate(langs[0].tolist()):
                mine = of == k
                if mine.any():
                    used, at = np.unique(key[mine] & 0xFFFFFFFF, return_inverse=True)
                    trie = Trie.of([terms[i] for i in used.tolist()], at, docs[mine], key[mine] >> 32, n[mine])
                    rb = trie.parts(lang, b"", DEPTH, [s for _, s in names])
                    for lo in range(0, rb.num_rows, 1024):
                        yield rb.slice(lo, 1024)
        index, number = fresh()
        held.clear()

    for rb in it:
        for text, lang, source in zip(rb.column(0), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            words = raw.translate(_TERM).split()
            if not words:
                continue
            ids.extend(map(index.__getitem__, words))
            sizes.append(len(words)), groups.append(number[lang, source])
            if len(words) * LONG < len(raw):  # long terms weigh by their bytes
                long += len(raw)
            if len(ids) > WORDS:
                chunk()
            if len(index) > TERMS or long > TERM_BYTES or (held and len(held[0][0]) > ENTRIES):
                chunk()
                yield from flush()
                long = 0
    chunk()
    yield from flush()


def _deeper(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts cut again, STEP bytes further down."""
    for rb in it:
        for i in range(rb.num_rows):
            p = _Open(rb, i)
            trie, names = _joined([p])
            yield trie.parts(p.lang, p.prefix, STEP, names)


_KEPT = "lang string, term binary, total long, sources array<string>, counts array<long>"
_KEPT_NAMES = [c.split()[0] for c in _KEPT.split(", ")]


def _merge(least: int):
    """Parts sorted by language and prefix -> the kept terms. A prefix's parts are merged into one trie, which a task holds; its traversal is in UTF-8 order."""

    def kept(parts):
        trie, names = _joined(parts)
        stay = np.flatnonzero(trie.docs >= least)
        size = np.diff(trie.begin)[stay]
        ends = np.cumsum(size)
        flat = np.arange(size.sum()) - np.repeat(ends - size, size) + np.repeat(trie.begin[stay], size)
        offsets = pa.array(np.append(0, ends).astype(np.int32))
        total = np.add.reduceat(trie.count, trie.begin[:-1])[stay]
        sources = pa.array(names, pa.string()).take(pa.array(trie.who[flat]))
        cols = [pa.array([parts[0].lang] * len(stay), pa.string()), pa.array([parts[0].prefix + trie.terms[i] for i in stay.tolist()], pa.binary()), pa.array(total)]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(trie.count[flat]))], _KEPT_NAMES)

    def run(it):
        parts = []
        for rb in it:
            for i in range(rb.num_rows):
                p = _Open(rb, i)
                if parts and (p.lang, p.prefix) != (parts[0].lang, parts[0].prefix):
                    yield kept(parts)
                    parts = []
                parts.append(p)
        if parts:
            yield kept(parts)

    return run


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals up to 9e15: long division, a thousand at a time."""
    rest, out = np.asarray(count, np.int64) + 1, np.int64(0)
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


_FOUND = "part string, lang string, source string, item string, value long"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _traverse(top: int):
    """Rows sorted by group, its sources first and then its terms in UTF-8 order -> sums over the group's terms for each pair of sources (first block, second block), and candidates of each source of the first block where both blocks are one.

    Memory holds two blocks of sources, BATCH terms and the best `top` candidates of each source.
    """

    def done(names, sums, heaps, lang):
        left, right = names
        for i, g in enumerate(left):
            if len(right):
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(right)), pa.array([lang] * len(right)), pa.array([g] * len(right)), pa.array(right, pa.string()), pa.array(sums[i])], _FOUND_NAMES)
        for g, heap in zip(left, heaps):
            if heap:
                terms = [t.decode("utf-8", "surrogatepass") for _, _, t in heap]
                yield pa.RecordBatch.from_arrays([pa.array(["term"] * len(heap)), pa.array([lang] * len(heap)), pa.array([g] * len(heap)), pa.array(terms), pa.array([v for v, _, _ in heap], pa.int64())], _FOUND_NAMES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = lang = None
        place, names, total, sums, heaps, number = {}, ([], []), ([], []), None, [], 0
        for rb in it:
            col = {n: rb.column(i) for i, n in enumerate(_TOUR_NAMES)}
            group, side = col["grp"].to_numpy(zero_copy_only=False), col["side"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])) if len(group) else []
            for lo, hi in zip(edge, [*edge[1:], len(group)]):
                if group[lo] != now:
                    if now is not None:
                        yield from done(names, sums, heaps, lang)
                    now, lang = group[lo], col["lang"][lo].as_py()
                    place, names, total, sums, heaps, number = ({}, {}), ([], []), ([], []), None, [], 0
                if side[lo] < 2:  # a block's sources: 0 the first, 1 the second
                    s = int(side[lo])
                    for x, n in zip(col["source"].slice(lo, hi - lo).to_pylist(), col["total"].slice(lo, hi - lo).to_pylist()):
                        place[s][x] = len(names[s])
                        names[s].append(x), total[s].append(n)
                    sums = np.zeros((len(names[0]), len(names[1])), np.int64)
                    heaps = [[] for _ in names[0]]
                    own = col["own"][lo].as_py()  # the language's total
                    continue
                if sums is None:
                    continue
                for a in range(lo, hi, BATCH):
                    n = min(BATCH, hi - a)
                    who, count = col["sources"].slice(a, n), col["counts"].slice(a, n)
                    row = np.repeat(np.arange(n), np.diff(who.offsets.to_numpy()))
                    flat, c = who.flatten().to_pylist(), count.flatten().to_numpy()
                    p = []
                    for s in (0, 1):
                        dense = np.zeros((n, len(names[s])), np.int64)
                        at = np.fromiter((place[s].get(x, -1) for x in flat), np.int64, len(flat))
                        here = at >= 0
                        dense[row[here], at[here]] = c[here]
                        p.append(shares(dense, np.array(total[s], np.int64)))
                        if s == 0:
                            held = dense > 0
                    for i in range(len(names[0])):
                        gap = p[0][:, i : i + 1] - p[1]
                        sums[i] += (gap * gap // p[1]).sum(0)
                    if col["both"][lo].as_py():
                        q = shares(col["total"].slice(a, n).to_numpy(), own)
                        terms = col["term"].slice(a, n)
                        for i, heap in enumerate(heaps):
                            gap = p[0][:, i] - q
                            at = np.flatnonzero(held[:, i] & (gap > 0))
                            value = gap[at] * gap[at] // q[at]
                            if len(heap) == top:  # terms come in order: an equal value comes too late
                                at, value = at[value > heap[0][0]], value[value > heap[0][0]]
                            for k, v in zip(at.tolist(), value.tolist()):
                                entry = (v, -(number + k), terms[k].as_py())
                                if len(heap) < top:
                                    heappush(heap, entry)
                                elif entry > heap[0]:
                                    heapreplace(heap, entry)
                    number += n
        if now is not None:
            yield from done(names, sums, heaps, lang)

    return run


#: Terms that a traversal handles at a time.
BATCH = 2048
_TOUR_NAMES = ["grp", "side", "lang", "source", "total", "own", "both", "term", "sources", "counts"]


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the language's others (part pair), and by which terms from the language (part term).

    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the V terms that occur in
    at least `least` of its documents. A group (a language's source, or the language) of N occurrences of kept terms gives a
    term that it holds count times p = 1 + floor(SCALE * (count + 1) / (N + V)), and f = floor((p - q)^2 / q) compares two
    groups. Pair: f of the source and each other source, summed over all kept terms, all ranks. Term: f of the source and its
    language for terms that the source holds and uses more than the language does, the best `top`. Ranks: value descending,
    then item in UTF-8 order.

    Tasks count into radix tries, one a language, whose leaves count documents and occurrences by source. Tries are cut by
    prefix, and all parts of a prefix merge in one task; a prefix of over LEAVES leaves is cut further down until none has more
    (a term of all documents is one leaf a task). Kept terms are dealt into shards, each of which is traversed in UTF-8 order
    and meets each pair of blocks of BLOCK sources once. So a language or source that holds most documents is spread; totals by
    language are broadcast up to a checked size. Exact for languages of up to 9e15 occurrences.

    Null text, lang and source count as ''. Groups without terms take part with counts of 0. A lang without kept terms gives
    pairs of value 0. Very long terms travel as they are. Repeated rows count as documents of their own. Empty table: empty.
    Only text, lang and source are read.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    parts, settled = cut(own.mapInArrow(_count, _PART)), []
    while True:
        # a prefix that no term goes beyond is one term, of at most a leaf a part
        size = parts.groupBy("lang", "prefix").agg(F.sum("n").alias("leaves"), F.max("more").alias("more"))
        heavy = cut(size.filter((F.col("leaves") > LEAVES) & F.col("more")).select("lang", "prefix"))
        if heavy.isEmpty():
            settled.append(parts)
            break
        settled.append(parts.join(heavy, ["lang", "prefix"], "left_anti"))
        parts = cut(parts.join(heavy, ["lang", "prefix"], "left_semi").mapInArrow(_deeper, _PART))
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    kept = cut(whole.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(_merge(least), _KEPT))
    # N + V of each source and language
    entries = kept.select("lang", F.explode(F.arrays_zip("sources", "counts"))).select("lang", F.col("col.sources").alias("source"), F.col("col.counts").alias("n"))
    seen = own.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    groups = cut(seen.unionByName(entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))).groupBy("lang", "source").agg(F.sum("n").alias("n")))
    held = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("words"), F.sum(F.size("sources")).alias("entries"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).join(held, "lang", "left").na.fill(0)
    langs = cut(langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("entries") / SHARD)).cast("long")))
    few = langs.count() <= HUBS

    def beside(df, by):
        """df with its language's totals: broadcast up to a checked size, else by a salted join."""
        if few:
            return df.join(F.broadcast(langs), "lang")
        salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(32)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")

    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    grp = F.concat_ws("/", "shard", "b0", "b1", "lang").alias("grp")
    head = beside(groups, "source").withColumn("shard", to("shards"))
    sides = []
    for side, (mine, other) in enumerate((("b0", "b1"), ("b1", "b0"))):
        both = head.withColumn(mine, F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn(other, to("blocks"))
        sides.append(both.select(grp, F.lit(side).alias("side"), "lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.col("words") + F.col("v")).alias("own"), none("both", "boolean"), none("term", "binary"), none("sources", "array<string>"), none("counts", "array<long>")))
    tour = beside(kept, "term").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).withColumn("b0", to("blocks")).withColumn("b1", to("blocks"))
    sides.append(tour.select(grp, F.lit(2).alias("side"), "lang", none("source", "string"), "total", none("own", "long"), (F.col("b0") == F.col("b1")).alias("both"), "term", "sources", "counts"))
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    found = cut(rows.repartition("grp").sortWithinPartitions("grp", "side", "term").mapInArrow(_traverse(top), _FOUND))
    pair = found.filter("part = 'pair' AND item <> source").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    term = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")

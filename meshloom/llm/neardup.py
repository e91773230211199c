"""MinHash near-duplicate classes by a chosen-path set similarity join.

Path trees over minwise signatures gather documents that may be similar; nodes small enough are compared exhaustively on
signatures, larger ones branch on unless their members are alike anyhow; documents that may be linked form candidate classes,
whose full shingle sets decide, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, marked
from .textkernel import Words, batches, mix64

#: Minwise tokens in a signature, 16 bits each.
TOKENS = 128
#: Independent trees and the tokens chosen along a path before node sizes are looked at. A pair of similarity s meets in
#: one tree with probability s**DEPTH: at 0.85 it is missed by all trees with probability 8e-6, at 0.8 with 3e-4.
TREES, DEPTH = 16, 4
#: A node of more members branches on, BRANCH children per member, STEP more tokens each, at most ROUNDS times.
NODE, STEP, BRANCH, ROUNDS = 1024, 2, 3, 6
#: A large node of which so many members agree with its first one is a candidate class as it stands.
TIGHT = 0.9
#: Signature agreement below threshold - MARGIN counts as unlike; four standard deviations of the estimate.
MARGIN = 0.13
#: Members and shingles of a candidate class that one task compares; larger classes are dealt into blocks.
GROUP, VOLUME = 256, 200_000
#: Digests of rows to drop, and members of candidate classes with their blocks, that are broadcast at most; beyond it Spark joins.
BROADCAST_ROWS, MEMBERS = 4_000_000, 1_000_000

_rng = np.random.Generator(np.random.PCG64(99))
_A = _rng.integers(1, 2**62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signature(sh: np.ndarray) -> np.ndarray:
    """16-bit minwise tokens of one non-empty shingle set."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sh), 4096):
        low = np.minimum(low, (sh[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(1))
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)


def walk(node: np.ndarray, sig: np.ndarray, steps: int) -> np.ndarray:
    """Node ids reached from node (one per row of sig): at each step the node picks a token position, the token picks the child."""
    rows = np.arange(len(sig))
    for _ in range(steps):
        at = (mix64(node) % np.uint64(TOKENS)).astype(np.int64)
        node = mix64(node * _GOLD + sig[rows, at].astype(np.uint64) + np.uint64(1))
    return node


def _profiles(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(1, TREES + 1, dtype=np.uint64) * _GOLD)
        for rb in it:
            texts = rb.column(3).to_pylist()
            n, d1, d2, sigs, keys = [], [], [], [], []
            for lo, hi in batches(texts):
                w = Words(texts[lo:hi])
                for i in range(hi - lo):
                    sh = w.shingles(i, k)
                    n.append(len(sh))
                    if len(sh):
                        s = signature(sh)
                        x, y = mix64(sh ^ _GOLD), mix64(sh + _GOLD)
                        d1.append(int(x.sum().view(np.int64))), d2.append(int(y.sum().view(np.int64)))
                        sigs.append(s.tobytes())
                        keys.append(walk(roots, np.broadcast_to(s, (TREES, TOKENS)), DEPTH).view(np.int64))
                    else:
                        d1.append(None), d2.append(None), sigs.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [*rb.columns[:3], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "m1", "m2", "n_shingles", "d1", "d2", "sig", "keys"],
            )

    return run


def _groups(it: Iterator, key: str) -> Iterator:
    """Whole groups out of batches that are sorted by key; memory holds one group."""
    import pandas as pd

    kept = []
    for pdf in it:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(pdf)]
        for lo, hi in zip(at, at[1:]):
            part = pdf.iloc[lo:hi]
            if kept and kept[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(part)
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def _forest(ids: np.ndarray, like) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which like(i, others) says which of others are neighbours of i; connected pairs are skipped."""
    left, out = np.arange(len(ids)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = like(i, left)
            out += [(int(ids[i]), int(ids[j])) for j in left[hit]]
            todo += left[hit].tolist()
            left = left[~hit]
    return out


def _compare_nodes(floor: int):
    def run(it):
        import pandas as pd

        for g in _groups(it, "node"):
            g = g.drop_duplicates("uid").sort_values("uid")
            if len(g) < 2:
                continue
            sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), TOKENS)
            pairs = _forest(g["uid"].to_numpy(), lambda i, o: (sig[o] == sig[i]).sum(1) >= floor)
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])

    return run


class Sets:
    """The shingle sets of a group of texts with an inverted index over them."""

    def __init__(self, texts: list, k: int):
        sets = []
        for lo, hi in batches(texts):
            w = Words(texts[lo:hi])
            sets += [w.shingles(i, k) for i in range(hi - lo)]
        self.size = np.array([len(s) for s in sets], np.int64)
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), self.size)
        self.holders = doc[np.argsort(self.flat, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.flat))]).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])

    def linked(self, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which of others share num / den of their union with text i, by exact intersections."""
        terms = self.flat[self.begin[i] : self.begin[i + 1]]
        n = self.at[terms + 1] - self.at[terms]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[terms], n)
        both = np.bincount(self.holders[pos], minlength=len(self.size))[others]
        return den * both >= num * (self.size[i] + self.size[others] - both)


def _compare_sets(k: int, num: int, den: int):
    """Links on full sets within a group (grp): den * |x & y| >= num * |x | y|."""

    def run(it):
        import pandas as pd

        for g in _groups(it, "grp"):
            g = g.drop_duplicates("uid").sort_values("uid")
            if len(g) < 2:
                continue
            s = Sets(g["text"].tolist(), k)
            pairs = _forest(g["uid"].to_numpy(), lambda i, o: s.linked(i, o, num, den))  # noqa: B023
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])

    return run


def _compare_rest(k: int, num: int, den: int):
    """Links of a group's stragglers (apart = true) to members of other components: one for each straggler and component."""

    def run(it):
        import pandas as pd

        for g in _groups(it, "grp"):
            g = g.sort_values("apart", ascending=False).drop_duplicates("uid").sort_values("uid")
            if len(g) < 2:
                continue
            s = Sets(g["text"].tolist(), k)
            uid, comp, out = g["uid"].to_numpy(), g["comp"].to_numpy(), []
            for i in np.flatnonzero(g["apart"].to_numpy()):
                others = np.flatnonzero(comp != comp[i])
                hit = others[s.linked(i, others, num, den)]
                _, one = np.unique(comp[hit], return_index=True)
                out += [(int(uid[i]), int(uid[j])) for j in hit[one]]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _agree(floor: int):
    """Rows (node, uid, sig, first, lead) -> the same with like in place of lead: whether sig agrees with lead."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            sig, lead = (np.frombuffer(b"".join(rb.column(i).to_pylist()), np.uint16).reshape(-1, TOKENS) for i in (2, 4))
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], pa.array((sig == lead).sum(1) >= floor)], ["node", "uid", "sig", "first", "like"])

    return run


def _branch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        node = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        sig = np.frombuffer(b"".join(rb.column(2).to_pylist()), np.uint16).reshape(-1, TOKENS)
        for b in range(BRANCH):
            child = walk(mix64(node + np.uint64(b + 1) * _GOLD), sig, STEP)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), rb.column(1), rb.column(2)], ["node", "uid", "sig"])


def _by(df: DataFrame, key: str) -> DataFrame:
    """df dealt and sorted by key. The number of partitions is named, since work follows pairs rather than bytes, by which
    partitions would be put together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def _candidates(own: DataFrame, floor: int) -> DataFrame:
    """own(uid, sig, keys) -> (a, b): a graph whose components hold every two documents that the trees bring together and
    whose signatures agree in floor tokens.

    Nodes of up to NODE members are compared exhaustively. A larger node whose members mostly agree with its first member,
    or that branching has not made small, becomes a star around that member: that joins too much rather than too little,
    costs a row per member however large the node, and the full sets decide afterwards. Other large nodes branch on.
    """
    members = own.select(F.explode("keys").alias("node"), "uid")
    links = None
    for r in range(ROUNDS + 1):
        count = members.groupBy("node").agg(F.count("*").alias("c"), F.min("uid").alias("first")).filter("c > 1")
        known = members.join(count, "node")
        if "sig" not in members.columns:
            known = known.join(own.select("uid", "sig"), "uid")
        known = cut(known.select("node", "uid", "sig", "c", "first"))
        small = _by(known.filter(F.col("c") <= NODE).select("node", "uid", "sig"), "node").mapInPandas(_compare_nodes(floor), "a long, b long")
        links = small if links is None else links.union(small)
        big = known.filter(F.col("c") > NODE)
        if not big.limit(1).count():
            break
        lead = cut(big.filter("uid = first").select("node", F.col("sig").alias("lead")))
        near = cut(big.join(lead, "node").select("node", "uid", "sig", "first", "lead").mapInArrow(_agree(floor), "node long, uid long, sig binary, first long, like boolean"))
        share = cut(near.groupBy("node").agg(F.avg(F.col("like").cast("double")).alias("share")))
        star = F.col("share") >= (TIGHT if r < ROUNDS else 0.0)
        links = links.union(near.join(share.filter(star), "node").filter("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b")))
        members = near.join(share.filter(~star), "node").select("node", "uid", "sig").mapInArrow(_branch, "node long, uid long, sig binary").dropDuplicates(["node", "uid"])
    return links.distinct()


def _linked(docs: DataFrame, own: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, root): components of the links on full sets within candidate classes (id, root).

    A class is dealt into blocks of at most about GROUP members and VOLUME shingles. Each block is compared by itself together
    with the class's first member, so a group of copies of one text, however large, is joined in one pass whose cost grows
    with its members. What this leaves outside the first member's component (stragglers) is then compared with all members
    of other components, straggler blocks against blocks: exact, at a cost that grows with stragglers times members.
    """
    member = classes.select(F.col("id").alias("uid"), "root").join(own.select("uid", "n_shingles", "m1", "m2", "copies"), "uid")
    blocks = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n_shingles") / VOLUME)).alias("blocks")
    load = member.groupBy("root").agg(blocks)
    block = F.pmod(F.xxhash64("uid"), F.col("blocks")).alias("block")
    dealt = cut(member.join(load, "root").select("uid", "root", block, "blocks", "m1", "m2", "copies"))
    m1, m2 = marked(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = docs.select(m1, m2, F.col("text").cast("string").alias("text"))
    right = F.broadcast(dealt) if dealt.count() <= MEMBERS else dealt
    held = held.join(right, (F.col("__m1") == F.col("m1")) & (F.col("__m2") == F.col("m2"))).select("uid", "root", "block", "blocks", "copies", "text")
    # a row that repeats as a whole finds its representative as often; one is enough
    held = cut(held.filter("copies = 1").union(held.filter("copies > 1").dropDuplicates(["uid"])).drop("copies"))
    group = lambda *c: F.xxhash64(*c).alias("grp")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    leads = held.filter("uid = root AND blocks > 1").withColumn("other", each("blocks")).filter("other <> block")
    first = held.select(group("root", "block"), "uid", "text").union(leads.select(group("root", "other"), "uid", "text"))
    links = cut(_by(first, "grp").mapInPandas(_compare_sets(k, percent, 100), "a long, b long"))
    joined = components(links)
    if not dealt.filter("blocks > 1").limit(1).count():
        return joined
    joined = cut(joined)
    part = dealt.filter("blocks > 1").select("uid", "root", "block", "blocks").join(joined.select(F.col("id").alias("uid"), F.col("root").alias("comp")), "uid", "left")
    # the first member has the smallest uid, so its component goes by that
    part = part.withColumn("comp", F.coalesce("comp", "uid")).withColumn("apart", F.col("comp") != F.col("root"))
    rest = part.filter("apart").groupBy("root").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    part = cut(part.join(rest, "root"))
    if not part.limit(1).count():
        return joined
    texts = part.join(held.select("uid", "text"), "uid")
    asked = texts.filter("apart").withColumn("other", each("blocks")).select(group("root", "other", F.pmod(F.xxhash64(F.lit("part"), "uid"), F.col("parts"))), "uid", "comp", "apart", "text")
    rows = texts.withColumn("other", each("parts")).select(group("root", "block", "other"), "uid", "comp", F.lit(False).alias("apart"), "text")
    more = _by(asked.union(rows), "grp").mapInPandas(_compare_rest(k, percent, 100), "a long, b long")
    return components(more.union(joined.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b")))


def _classed(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(base, final): per row its digests, and per distinct set that is held twice or linked its component and staying row."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    m1, m2 = marked(doc_id, text)
    schema = "doc_id long, m1 long, m2 long, n_shingles long, d1 long, d2 long, sig binary, keys array<long>"
    base = docs.select(doc_id.alias("doc_id"), m1, m2, text.alias("text")).mapInArrow(_profiles(k), schema)
    base = cut(base.withColumn("uid", F.monotonically_increasing_id()))
    stay = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m1", "m2")).alias("stay")
    reps = cut(base.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), stay))
    own = cut(base.join(reps.select("uid", "copies"), "uid").select("uid", "n_shingles", "m1", "m2", "copies", "sig", "keys"))
    floor = int(np.ceil(TOKENS * (percent / 100 - MARGIN)))
    classes = cut(components(_candidates(own.select("uid", "sig", "keys"), floor)))
    joined = _linked(docs, own, classes, k, percent)
    final = reps.join(joined.select(F.col("id").alias("uid"), "root"), "uid", "left").filter("copies > 1 OR root IS NOT NULL")
    final = cut(final.select("d1", "d2", F.coalesce("root", "uid").alias("c"), "stay"))
    least = final.groupBy("c").agg(F.min("stay").alias("stay"))
    return base, cut(final.drop("stay").join(least, "c").select("d1", "d2", F.col("stay.doc_id").alias("component"), F.col("stay.m1").alias("stay1"), F.col("stay.m2").alias("stay2")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near-copies: per row of docs doc_id, n_shingles, component_id, kept.

    Words are runs of non-white-space with A-Z lower-cased; a document's set holds its distinct k-word shingles (fewer
    words: the whole sequence as one; null, empty or blank text: empty set, linked with nothing). Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable and kept marks that document.

    Equal sets are one representative from the start, found by a partially aggregated digest, so thousands of copies cost a
    row each. Candidates come from signatures, links from full sets; a class of any size loses no link to a cap. Rows are
    told apart by a row id: repeated rows get equal results, and rows of one doc_id with different texts are compared as
    separate texts. A row without doc_id is compared like any other; its component_id is the smallest id it reaches, null if
    there is none (kept is true then). Empty table: empty. Only doc_id and text are read.
    """
    base, final = _classed(docs, k, percent)
    out = base.select("doc_id", "n_shingles", "d1", "d2").join(final, ["d1", "d2"], "left")
    component = F.when(F.col("stay1").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class of near-copies: the one of smallest doc_id, null ids last, then by a digest of the text.

    Rows go by digests of id and text, so the texts of rows that share an id are judged apart. Of rows that agree in id and
    text one stays. Rows without words are in no class and all stay.
    """
    base, final = _classed(docs, k, percent)
    rows = cut(base.join(final, ["d1", "d2"]).select("m1", "m2", ((F.col("m1") == F.col("stay1")) & (F.col("m2") == F.col("stay2"))).alias("stays")))
    gone = cut(rows.filter("NOT stays").select("m1", "m2").distinct())
    twice = cut(rows.filter("stays").groupBy("m1", "m2").agg(F.count("*").alias("n")).filter("n > 1").select("m1", "m2"))

    def matched(left: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
        return left.join(right, (F.col("__m1") == F.col("m1")) & (F.col("__m2") == F.col("m2")), how)

    # docs' own columns travel in one struct, so that none of their names can clash
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *marked(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    left = matched(named, gone, "left_anti")
    if twice.limit(1).count():
        one = matched(left, twice, "left_semi").groupBy("__m1", "__m2").agg(F.min_by("d", F.to_json("d")).alias("d"))
        left = matched(left, twice, "left_anti").select("d").union(one.select("d"))
    return left.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])

"""Operators over words: encode, decode, grammar, similarity, variants."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshloom.functions import words as W

from .lineage import settle


def characters(word: Column) -> Column:
    """The characters of a string as an array."""
    return F.filter(F.split(word, ""), lambda c: c != "")


#: Characters of words, or nodes of words of graphs, whose results a task keeps; it begins anew beyond.
KNOWN = 2_000_000


def by_word(df: DataFrame, fields: str, types: list, fn, word: str = "word") -> DataFrame:
    """df with more columns (fields as DDL, types as Arrow types), of which fn gives a tuple for a word: each distinct word of a batch is
    looked at once, those that a task has seen before not at all, and rows take their word's results by index."""
    names = [*df.columns, *(f.split()[0] for f in fields.split("; "))]
    at = df.columns.index(word)
    schema = StructType(df.schema.fields + StructType.fromDDL(fields.replace("; ", ", ")).fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = {}, 0
        for rb in it:
            code = rb.column(at).dictionary_encode("encode")
            if held > KNOWN:
                known, held = {}, 0
            made = []
            for w in code.dictionary.to_pylist():
                if w not in known:
                    known[w] = fn(w)
                    held += len(w or "") + 1
                made.append(known[w])
            new = [pa.array([m[i] for m in made], t).take(code.indices) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*rb.columns, *new], names)

    return df.mapInArrow(run, schema)


def encode_trees(children: DataFrame, root: str = "O", scene: str = "scene") -> DataFrame:
    """scene, word of one-level trees: children(scene, rank, ch), all but the last in brackets (WD1)."""
    c = children.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("rank", "ch"))).alias("c"))
    head = F.transform(F.slice("c", 1, F.size("c") - 1), lambda x: F.concat(F.lit("("), x["ch"], F.lit(")")))
    return c.select(scene, F.concat(F.lit(root), F.array_join(head, ""), F.element_at("c", -1)["ch"]).alias("word"))


def encode_graphs(nodes: DataFrame, edges: DataFrame, repeats: int = 1, seed: int = 1, starts: str = "all") -> DataFrame:
    """scene, start, repeat, word, node_ids: words of connected scenes from each start node (WD1, WD2, WD10).

    nodes(scene, node, ch) and edges(scene, src, dst) are gathered by scene, as a scene's parts are few; neighbour order is
    shuffled by a hash of seed and repeat. Scenes that aren't connected give nothing.
    """
    # a scene's graph in one order, so that scenes of equal graphs are seen to be equal
    both = nodes.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("node", "ch"))).alias("n"))
    both = both.join(edges.groupBy("scene").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("e")), "scene", "left")
    part = lambda c, f, to: F.transform(c, lambda x: x[f].cast(to)).alias(f)
    flat = both.select("scene", part("n", "node", "long"), part("n", "ch", "string"), part("e", "src", "long"), part("e", "dst", "long"))
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]

    def one(node, ch, src, dst):
        chars = dict(zip(node, ch))
        near: dict[int, list[int]] = {}
        for a, b in zip(src or (), dst or ()):
            near.setdefault(a, []).append(b)
        out: list[list] = [[], [], [], []]
        for r in range(repeats):
            key = lambda v: hashlib.md5(f"{seed}:{r}:{v}".encode()).digest()  # noqa: B023, E731
            order = {v: sorted(x, key=key) for v, x in near.items()}
            for start in sorted(chars) if starts == "all" else [min(chars)]:
                word, ids = W.encode(start, chars, order)
                if len(ids) == len(chars):
                    for held, v in zip(out, (start, r, word, ids)):
                        held.append(v)
        return len(out[0]), [pa.array(v, t) for v, t in zip(out, kinds)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = {}, 0
        for rb in it:
            if weight > KNOWN:
                known, weight = {}, 0
            place: dict = {}
            code = np.array([place.setdefault(g, len(place)) for g in zip(*([None if x is None else tuple(x) for x in c.to_pylist()] for c in rb.columns[1:]))], np.int64)
            for g in place:
                if g not in known:
                    known[g] = one(*g)
                    weight += (known[g][0] + 1) * len(g[0])
            if not place:
                continue
            size = np.array([known[g][0] for g in place])
            all_ = [pa.concat_arrays([known[g][1][i] for g in place]) for i in range(len(kinds))]
            n, begin = size[code], (np.cumsum(size) - size)[code]
            row = np.repeat(np.arange(len(code)), n)
            at = pa.array(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n))
            # rows go out some thousand at a time, however many words a scene has
            for lo in range(0, len(row), 20_000):
                own = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(row[own])), *(c.take(at[own]) for c in all_)], names)

    names = ["scene", "start", "repeat", "word", "node_ids"]
    return flat.mapInArrow(run, f"scene {nodes.schema['scene'].dataType.simpleString()}, start long, repeat int, word string, node_ids array<bigint>")


def with_edges(words: DataFrame, word: str = "word", to: str = "e") -> DataFrame:
    """words with an array of (pos, a, b): the edge each character stands for, nodes by number (WD7); labels and branches of any depth."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
    found = lambda w: ([dict(zip(("pos", "a", "b"), e)) for e in W.edges(w or "")],)
    return by_word(words, f"{to} array<struct<pos:int,a:int,b:int>>", [kind], found, word)


def word_edges(words: DataFrame, key: str = "scene") -> DataFrame:
    """key, pos, a, b: with_edges, an edge a row."""
    return with_edges(words.select(key, "word")).select(key, F.explode("e").alias("e")).select(key, "e.*")


def with_shape(words: DataFrame, word: str, chars: str, edges: str) -> DataFrame:
    """words with the sorted node characters of a word and how many pairs of its nodes an edge joins: equal for words of one graph."""

    def shape(w):
        return "".join(sorted(W.node_chars(w or ""))), len({(min(a, b), max(a, b)) for _, a, b in W.edges(w or "")})

    return by_word(words, f"{chars} string; {edges} bigint", [pa.string(), pa.int64()], shape, word)


def tree_edges(words: DataFrame, key: str = "scene") -> DataFrame:
    """key, child_pos, parent_pos of words of brackets and nodes whose branches are one level deep, in built-in functions (WD7)."""
    pos = F.posexplode(characters(F.col("word")))
    c = words.select(key, pos.alias("p", "ch")).filter("ch rlike '[A-Za-z]'")
    first = c.groupBy(key).agg(F.min("p").alias("root"))
    return c.join(first, key).filter("p > root").select(key, (F.col("p") + 1).cast("long").alias("child_pos"), (F.col("root") + 1).cast("long").alias("parent_pos"))


def induce_words(words: DataFrame) -> dict[str, DataFrame]:
    """The string grammar of words: pair (a, b) in both orders, degree (ch, degree), charset (ch) (WD4)."""

    def parts(w):
        p, d = W.pairs_and_degrees(w or "")
        return [a + b for a, b in p], [f"{c}{n}" for c, n in d]

    list_of = pa.list_(pa.string())
    each = by_word(words.select("word").distinct(), "p array<string>; d array<string>", [list_of, list_of], parts)
    one = lambda c: F.substring(c, 1, 1)
    return {
        "pair": each.select(F.explode("p").alias("x")).distinct().select(one("x").alias("a"), F.substring("x", 2, 1).alias("b")),
        "degree": each.select(F.explode("d").alias("x")).distinct().select(one("x").alias("ch"), F.expr("substring(x, 2)").cast("long").alias("degree")),
        "charset": words.select(F.explode(characters(F.col("word"))).alias("ch")).distinct(),
    }


def to_tree_grammar(degree: DataFrame) -> DataFrame:
    """degree with all smaller ones added (WD6)."""
    return degree.filter("degree > 0").select("ch", F.explode(F.sequence(F.lit(1).cast("long"), "degree")).alias("degree")).distinct()


#: Characters, pairs and degrees of a grammar that are broadcast; more are joined.
GRAMMAR = 1_000_000


def check_words(words: DataFrame, grammar: dict[str, DataFrame]) -> DataFrame:
    """words with ok (WD5): the word is well formed, and the grammar knows its characters, its pairs and its nodes' degrees.

    The parser lists what each word needs (see words.needs), and an anti-join with the grammar finds what it lacks; the grammar
    is broadcast up to a checked size and never collected. Null words aren't ok. Repeated words are judged each.
    """
    parsed = settle(by_word(words, "__need array<string>", [pa.list_(pa.string())], lambda w: (W.needs(w or ""),)).withColumn("__row", F.monotonically_increasing_id()))
    item = lambda kind, *c: F.concat(F.lit(kind), *[F.col(x).cast("string") for x in c]).alias("item")
    nodes = grammar["charset"].filter("ch rlike '[A-Za-z]'")
    known = nodes.select(item("c", "ch")).union(grammar["pair"].select(item("p", "a", "b"))).union(grammar["degree"].select(item("d", "ch", "degree"))).distinct()
    known = settle(known)
    known = F.broadcast(known) if known.count() <= GRAMMAR else known
    lacks = parsed.select("__row", F.explode("__need").alias("item")).join(known, "item", "left_anti").select("__row").distinct().withColumn("__bad", F.lit(True))
    return parsed.join(lacks, "__row", "left").withColumn("ok", F.col("__need").isNotNull() & F.col("__bad").isNull()).drop("__row", "__need", "__bad")


def signatures(words: DataFrame) -> DataFrame:
    """words with sig: similar words are those of equal signature, so similarity is a group key (AG5)."""
    return by_word(words, "sig string", [pa.string()], lambda w: (W.signature(w or ""),))


def dedupe_by_signature(words: DataFrame, order: str, max_len: int = 960) -> DataFrame:
    """The first word of each signature in the given order, without words longer than max_len (AG6)."""
    s = signatures(words.filter(F.length("word") <= max_len))
    return s.groupBy("sig").agg(F.min(F.struct(order, "word")).alias("m"), F.count("*").alias("n")).select("sig", f"m.{order}", "m.word", "n")


def char_counts(words: DataFrame, key: str) -> DataFrame:
    """key, ch, n: node characters of each word."""
    return words.select(key, F.explode(characters(F.col("word"))).alias("ch")).filter("ch rlike '[A-Za-z]'").groupBy(key, "ch").agg(F.count("*").alias("n"))


def _bags(words: DataFrame, key: str, chars: str) -> tuple[DataFrame, list[str]]:
    """key and how often each of chars is in the word (c0, c1, ...), with its node characters (cn): all that a distance needs,
    counted once a word, not once a pair."""
    count = [F.regexp_count("word", F.lit(c)).alias(f"c{i}") for i, c in enumerate(chars)]
    names = [f"c{i}" for i in range(len(chars))] + ["cn"]
    return settle(words.filter("word IS NOT NULL").select(key, *count, F.regexp_count("word", F.lit("[A-Za-z]")).alias("cn"))), names


#: Words of a task where all pairs are listed, and candidates of a block where the nearest are searched.
DEALT = 512


def distances(words: DataFrame, key: str, chars: str) -> DataFrame:
    """a, b, d for each pair a < b of a table of words (AG4): as many rows as pairs. The words' counts are dealt to tasks of
    DEALT words, each joined with all."""
    w, names = _bags(words, key, chars)
    side = lambda p: w.select(F.col(key).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in names])
    a = side("a").repartition(max(1, -(-w.count() // DEALT)), "a")
    n = F.col("a_cn") + F.col("b_cn")
    diff = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names[:-1]), F.lit(0))
    return a.join(side("b"), F.col("a") < F.col("b")).select("a", "b", F.when(n > 0, diff / n).alias("d"))


def _nearest_kernel(chars: int, k: int):
    """Blocks sorted by block, queries first -> bag, match, d: the k nearest of a block's candidates for each query of it."""

    def near(t: pa.Table) -> Iterator[pa.RecordBatch]:
        mine = t.column("ask").to_numpy()
        key, bag = t.column("key").to_numpy(), t.column("bag").to_numpy()
        c = np.array([t.column(f"c{i}").to_numpy() for i in range(chars)]).T.astype(np.int32)
        n = t.column("cn").to_numpy().astype(np.int32)
        ask, own = np.flatnonzero(mine), np.flatnonzero(~mine)
        if not len(own):
            return
        for lo in range(0, len(ask), 256):
            q = ask[lo : lo + 256]
            diff = np.zeros((len(q), len(own)), np.int32)
            for i in range(chars):
                diff += np.abs(c[q, i][:, None] - c[own, i])
            both = n[q][:, None] + n[own]
            d = np.where(both > 0, diff / np.maximum(both, 1), np.inf) * 1e9
            low = np.floor(d)
            d = (low + (d - low >= 0.5)) / 1e9  # to nine digits, halves up
            kth = np.partition(d, k - 1, 1)[:, k - 1] if len(own) > k else np.full(len(q), np.inf)
            at, to = np.nonzero(d <= kth[:, None])
            order = np.lexsort((key[own[to]], d[at, to], at))
            at, to = at[order], to[order]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            place = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
            at, to = at[place < k], to[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(bag[q[at]]), pa.array(key[own[to]]), pa.array(d[at, to])], ["bag", "match", "d"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in it:
            g = rb.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(edge, edge[1:]):
                if held and hi > lo and held[-1].column(0)[0].as_py() != g[lo]:
                    yield from near(pa.Table.from_batches(held))
                    held = []
                if hi > lo:
                    held.append(rb.slice(lo, hi - lo))
        if held:
            yield from near(pa.Table.from_batches(held))

    return run


def nearest_words(words: DataFrame, key: str, chars: str, k: int) -> DataFrame:
    """query, match, d (to nine digits), rank: the k nearest other words of each word, ties to the smaller key (TK2, TK6). key is
    a long.

    A distance depends on the words' counts of characters only, so words of equal counts ask once, and of each such bag the
    k + 1 smallest keys answer: whatever word asks, k of them are others. All pairs of different bags are compared, in blocks
    of 4 * DEALT candidates: quadratic in the bags, with two blocks in memory.
    """
    w, names = _bags(words, key, chars)
    at = F.row_number().over(Window.partitionBy(*names).orderBy(key))
    c = w.select(F.col(key).cast("long").alias("key"), *names, at.alias("at")).filter(F.col("at") <= k + 1)
    c = settle(c.withColumn("bag", F.min("key").over(Window.partitionBy(*names))))
    blocks = max(1, -(-c.count() // (4 * DEALT)))
    own, all_ = F.pmod(F.xxhash64("key"), F.lit(blocks)), F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    row = lambda df, g, ask: df.select(g.alias("g"), F.lit(ask).alias("ask"), "key", "bag", *names)
    asks = row(c.filter("at = 1").withColumn("own", own).withColumn("other", F.explode(all_)), F.col("own") * blocks + F.col("other"), True)
    answers = row(c.withColumn("own", own).withColumn("other", F.explode(all_)), F.col("other") * blocks + F.col("own"), False)
    dealt = asks.unionByName(answers).repartition(blocks * blocks if blocks > 1 else 1, "g").sortWithinPartitions("g")
    found = dealt.mapInArrow(_nearest_kernel(len(chars), k + 1), "bag long, match long, d double")
    by = lambda *c: Window.partitionBy(*c).orderBy("d", "match")
    found = found.withColumn("r", F.row_number().over(by("bag"))).filter(F.col("r") <= k + 1).drop("r")
    bag = c.filter("at = 1").select("bag", *names)
    mine = w.select(F.col(key).cast("long").alias("query"), *names).join(bag, names).select("query", "bag")
    out = mine.join(found, "bag").filter("query <> match").withColumn("rank", F.row_number().over(by("query")).cast("long")).filter(F.col("rank") <= k)
    return out.select("query", "match", F.when(F.col("d") < float("inf"), F.col("d")).alias("d"), "rank")


def filter_words(words: DataFrame, max_len: int = 120, forbid: str = "9") -> DataFrame:
    """Words that are not empty, no longer than max_len and free of a character (PR18)."""
    return words.filter((F.length("word") > 0) & (F.length("word") <= max_len) & ~F.col("word").contains(forbid))


def word_variants(words: DataFrame, n: int = 10, seed: int = 1, key: str = "scene") -> DataFrame:
    """key, variant, word: other words of the same graph, from hashed starts and neighbour orders (WD8)."""
    return with_variants(words.select(key, "word"), n, seed).select(key, F.posexplode("made").alias("variant", "word"))


def with_variants(words: DataFrame, n: int = 10, seed: int = 1, every: bool = False) -> DataFrame:
    """words with made: an array of word_variants of each; with `every`, the distinct words from every start in n neighbour orders."""

    def make(w):
        chars, near = W.graph(w or "")
        out = []
        for r in range(n):
            rank = lambda v: hashlib.md5(f"{seed}:{r}:{v}".encode()).digest()  # noqa: B023, E731
            if chars:
                kinds, order = dict(enumerate(chars)), {v: sorted(x, key=rank) for v, x in near.items()}
                out += [W.encode(v, kinds, order)[0] for v in (kinds if every else [min(kinds, key=rank)])]
        return (list(dict.fromkeys(out)) if every else out,)

    return by_word(words, "made array<string>", [pa.list_(pa.string())], make)


def mutate_words(words: DataFrame, seed: int = 1, key: str = "scene", double: str = "A", swap: str = "RN") -> DataFrame:
    """key, kind, word: longer words (a node character doubled) and words with two characters exchanged where a hash says so (WD9)."""
    coin = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("word"))), 1, 2), 16, 10).cast("int") < 128
    longer = words.filter(F.col("word").contains(double) & coin("len")).select(key, F.lit("longer").alias("kind"), F.regexp_replace("word", f"^([^{double}]*){double}", f"$1{double}{double}").alias("word"))
    swapped = words.filter(coin("swap")).select(key, F.lit("swapped").alias("kind"), F.translate("word", swap, swap[::-1]).alias("word"))
    return longer.unionByName(swapped).join(words.select("word").distinct(), "word", "left_anti").select(key, "kind", "word").distinct()


def padded(word: Column, n: int) -> Column:
    """The word's characters, filled with blanks to n (EN1)."""
    return characters(F.rpad(word, n, " "))


def decode_one_hot(rows: DataFrame, charset: str, length: int) -> DataFrame:
    """scene, node, parent, ch of rows(scene, node, one, offset): the type by the largest entry of one, the parent by the offset
    scaled by length (WD11)."""
    ch = F.substring(F.lit(charset), F.array_position("one", F.array_max("one")).cast("int"), F.lit(1))
    return rows.select("scene", "node", (F.col("node") - F.round(F.col("offset") * length)).cast("long").alias("parent"), ch.alias("ch"))

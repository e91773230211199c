"""Quality classifier: interpolated modified Kneser-Ney over word pairs, sharded count joins, thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkernel import Words, batches, mix64

#: The vocabulary: words that occur LEAST times and, with L languages, make up at least L * SHARE of a language's trusted
#: words. So 1 / SHARE words at most, and a rare language keeps as many of its words as a frequent one.
SHARE, LEAST = 1e-6, 2
#: Other words count as unknown, by shape. Ids: 0 before a text, 1 to SHAPES the unknown ones, then the vocabulary.
SHAPES, FIRST = 16, 17
#: A pair of ids is one key: left << BITS | right.
BITS = np.uint64(24)
#: Words or pairs that a task holds before it passes them on (arrays of 24 bytes each and copies of them while they are sorted),
#: trusted words per shard of the counts, partial counts that a shard folds, and pairs in one row of counts.
HELD, SHARD, FOLD, CHUNK = 500_000, 4_000_000, 8_000_000, 250_000
#: Ids or marks broadcast at most; beyond it Spark joins.
BROADCAST_ROWS = 4_000_000

_SHAPE = np.zeros(256, np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = 1  # capitals after the first character
_SHAPE[ord("0") : ord("9") + 1] = 2
_SHAPE[[ord(c) for c in "#*$%&|<>=_~^\\/@+{}[]!?"]] = 4
_SHAPE[128:] = 8


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every word, and each text's first word (one entry more)."""
    w = Words(texts, lower=False)
    flags = _SHAPE[w.bytes]
    flags[w.start] &= 254
    shape = np.bitwise_or.reduceat(flags, w.start) if len(w.start) else np.zeros(0, np.uint8)
    return w.hash, shape, w.offset


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int, kind) -> np.ndarray:
    raw = pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(b, n, np.uint64), dtype=np.uint64)


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) -> partial counts of words: (lang, h, shape, n), one row per word of a language that the task holds at a time."""

    def rows(lang, held):
        every, shape = (np.concatenate(x) for x in zip(*held))
        h, first = np.unique(every, return_index=True)
        _, n = _sum_by(every, np.ones(len(every), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(shape[first].astype(np.int32)), pa.array(n)], ["lang", "h", "shape", "n"])

    held: dict[str, list] = {}
    size = 0
    for rb in it:
        langs, texts = np.array(rb.column(0).to_pylist(), object), rb.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for lo, hi in batches(own):
                h, shape, _ = _tokens(own[lo:hi])
                held.setdefault(lang, []).append((h, shape))
                size += len(h)
        if size >= HELD:
            yield from (rows(lang, x) for lang, x in held.items())
            held, size = {}, 0
    yield from (rows(lang, x) for lang, x in held.items())


@dataclass
class Vocabulary:
    """Sorted hashes of the known words, and per shape log2 of 1 / (unknown trusted words of this shape + 1)."""

    known: np.ndarray
    spread: np.ndarray

    def ids(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, h)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == h[hit]
        return np.where(hit, at + FIRST, shape + 1).astype(np.uint64)

    def pairs(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key of every word with the one before, its row in texts, and the words of each text."""
        h, shape, offset = _tokens(texts)
        right = self.ids(h, shape)
        n = np.diff(offset)
        left = np.concatenate([np.zeros(1, np.uint64), right])[: len(right)]
        left[offset[:-1][n > 0]] = 0
        return left << BITS | right, np.repeat(np.arange(len(texts)), n), n


def _split(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each shard the positions of its keys, in order."""
    own = (mix64(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.cumsum(np.bincount(own, minlength=shards))[:-1])


def _shard_names(spark, shards: int) -> list[int]:
    """Numbers that Spark's hash partitioning over so many partitions deals one to each, so that no task gets several shards."""
    n = int(shards * (np.log(shards) + 20)) + 1  # all partitions are met with probability 1 - exp(-20)
    ids = spark.range(n).select(F.col("id").cast("int").alias("i"))
    met = ids.groupBy(F.pmod(F.hash("i"), F.lit(shards)).alias("p")).agg(F.min("i").alias("i")).collect()  # one row per shard
    names = [r["i"] for r in met]
    return names + list(range(n, n + shards - len(names)))


def _count_pairs(shared, names: list[int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            every = np.concatenate(held)
            keys, n = _sum_by(every, np.ones(len(every), np.int64))
            parts = [(s, p) for s, p in zip(names, _split(keys, len(names))) if len(p)]
            cols = [pa.array([s for s, _ in parts], pa.int32()), pa.array([len(p) for _, p in parts], pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([_pack_keys(keys[p]) for _, p in parts], pa.binary()), pa.array([_pack(n[p]) for _, p in parts], pa.binary())], ["shard", "size", "keys", "n"])

        held, size = [], 0
        for rb in it:
            texts = rb.column(0).to_pylist()
            for lo, hi in batches(texts):
                held.append(shared.value.pairs(texts[lo:hi])[0])
                size += len(held[-1])
                if size >= HELD:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return run


def _merge_shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> each shard's summed counts, CHUNK pairs a row."""

    def out(shard, parts):
        keys, n = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        for lo in range(0, len(keys), CHUNK):
            k, c = keys[lo : lo + CHUNK], n[lo : lo + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(k)], pa.int32()), pa.array([_pack_keys(k)], pa.binary()), pa.array([_pack(c)], pa.binary())], ["shard", "size", "keys", "n"])

    now, parts, size = None, [], 0
    for rb in it:
        for r in rb.to_pylist():
            if r["shard"] != now and parts:
                yield from out(now, parts)
                parts, size = [], 0
            now = r["shard"]
            parts.append((_unpack_keys(r["keys"], r["size"]), _unpack(r["n"], r["size"], np.int64)))
            size += r["size"]
            if size > FOLD and len(parts) > 1:  # fold now and then: memory holds distinct pairs, not all partial counts
                parts = [_sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
                size = len(parts[0][0])
    if parts:
        yield from out(now, parts)


def _statistics(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per id what its pairs add up to: as left word tokens, pairs, pairs counted 1 to 4 times; as right word the words before it."""
    for rb in it:
        for r in rb.to_pylist():
            keys, n = _unpack_keys(r["keys"], r["size"]), _unpack(r["n"], r["size"], np.int64)
            left, right = (keys >> BITS).astype(np.int64), (keys & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64)
            top = int(max(left.max(), right.max())) + 1
            cols = [np.bincount(left, n, top).astype(np.int64), np.bincount(left, minlength=top), *[np.bincount(left[n == i], minlength=top) for i in (1, 2, 3, 4)], np.bincount(right, minlength=top)]
            w = np.flatnonzero(cols[1] + cols[6])
            yield pa.RecordBatch.from_arrays([pa.array(w), *[pa.array(c[w]) for c in cols]], ["w", "tokens", "types", "n1", "n2", "n3", "n4", "before"])


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from the numbers of things counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.0 for i in (1, 2, 3)]
    return np.array([0.0] + [min(max(x, 0.0), i) for i, x in zip((1, 2, 3), d)])


@dataclass
class Model:
    """What is broadcast of a fitted model: arrays by word id, so of bounded size. Pair counts stay in their shards."""

    words: Vocabulary
    discount: np.ndarray
    tokens: np.ndarray  # as left word; 1 where never
    freed: np.ndarray  # log2 of the share that a left word leaves to the lower order
    low: np.ndarray  # log2 of the lower order's probability

    @staticmethod
    def of(words: Vocabulary, w: np.ndarray, s: dict[str, np.ndarray]) -> Model:
        size = len(words.known) + FIRST

        def full(k):
            x = np.zeros(size)
            x[w] = s[k]
            return x

        tokens, types, n1, n2, before = (full(k) for k in ("tokens", "types", "n1", "n2", "before"))
        d = _discounts([int(s[k].sum()) for k in ("n1", "n2", "n3", "n4")])
        freed = np.where(tokens > 0, (d[1] * n1 + d[2] * n2 + d[3] * (types - n1 - n2)) / np.maximum(tokens, 1), 1.0)
        low_d = _discounts([int((before == i).sum()) for i in (1, 2, 3, 4)])[np.minimum(before, 3).astype(np.int64)]
        total = max(before.sum(), 1.0)
        rest = low_d.sum() / total if before.sum() else 1.0
        low = (before - low_d) / total + rest / (size - 1)  # the mark before a text is no word
        return Model(words, d, np.maximum(tokens, 1), np.log2(np.maximum(freed, 1e-9)), np.log2(np.maximum(low, 1e-12)))

    def base(self, keys: np.ndarray) -> np.ndarray:
        """log2 of each word's probability as if its pair had never been counted."""
        left, right = (keys >> BITS).astype(np.int64), (keys & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64)
        spread = np.where(right < FIRST, self.words.spread[np.minimum(right, FIRST - 1)], 0.0)
        return self.freed[left] + self.low[right] + spread

    def gain(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What a pair counted so often adds to base."""
        left, right = (keys >> BITS).astype(np.int64), (keys & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64)
        own = np.maximum(count - self.discount[np.clip(count, 0, 3)], 0) / self.tokens[left]
        return np.log2(1 + own * np.exp2(-self.freed[left] - self.low[right]))


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column __trusted: true where labels hold quality 1, and not toxic 1, for the doc_id."""
    fine = labels.filter("quality = 1")
    if "toxic" in labels.columns:
        fine = fine.filter("coalesce(toxic, 0) <> 1")
    good = cut(fine.select(F.col("doc_id").cast("long").alias("__good")).filter("__good IS NOT NULL").distinct())
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    return docs.join(good, F.col("doc_id") == F.col("__good"), "left").withColumn("__trusted", F.col("__good").isNotNull()).drop("__good")


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary of all texts (lang, text), and their number of words."""
    counts = texts.mapInArrow(_count_words, "lang string, h long, shape int, n long").groupBy("lang", "h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    counts = cut(counts)
    totals = cut(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    every = totals.agg(F.count("*").alias("langs"), F.sum("total").alias("total")).first()
    least = F.greatest(F.lit(LEAST), F.ceil(F.col("total") * (SHARE * (every["langs"] or 1))))
    words = cut(counts.join(totals, "lang").groupBy("h").agg(F.min("shape").alias("shape"), F.max(F.col("n") >= least).alias("known")))
    known = words.filter("known").select("h").toArrow()["h"].to_numpy()  # 1 / SHARE rows at most
    spread = np.zeros(FIRST)
    for r in words.filter("NOT known").groupBy("shape").count().collect():  # SHAPES rows at most
        spread[r["shape"] + 1] = r["count"]
    return Vocabulary(np.sort(known.astype(np.int64).view(np.uint64)), -np.log2(spread + 1)), int(every["total"] or 0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, list[int]]:
    """The model of all trusted texts: (arrays by word, table of pair counts by shard, names of the shards).

    The table grows with the corpus and is never gathered; the arrays hold 1 / SHARE entries at most.
    """
    spark = docs.sparkSession
    texts = _trusted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("lang"), _text().alias("text")), labels).filter("__trusted")
    words, total = vocabulary(texts.select("lang", "text"))
    texts = texts.select("text")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    names = _shard_names(spark, shards)
    kind = "shard int, size int, keys binary, n binary"
    parts = texts.mapInArrow(_count_pairs(spark.sparkContext.broadcast(words), names), kind)
    table = cut(parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_merge_shards, kind))
    sums = ["tokens", "types", "n1", "n2", "n3", "n4", "before"]
    stats = table.mapInArrow(_statistics, "w long, " + ", ".join(f"{k} long" for k in sums)).groupBy("w").agg(*[F.sum(k).alias(k) for k in sums]).toArrow()
    return Model.of(words, stats["w"].to_numpy(), {k: stats[k].to_numpy() for k in sums}), table, names


_PARTS = "batch long, shard int, kind int, size int, keys binary, n binary, at binary, idx int, doc_id long, lang string, n_chars long, m1 long, m2 long, trusted boolean, n_words long, base double"
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
_KINDS = [_TYPES[x.split()[1]] for x in _PARTS.split(", ")]
#: Kinds of rows: counts of the model, pairs that a batch of documents asks for, the documents themselves, gains found.
COUNTS, ASKED, DOCUMENT, GAINED = range(4)


def _rows(count: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(count, t) for k, t in zip(_NAMES, _KINDS)], _NAMES)


def _ask(shared, names: list[int]):
    """Documents (uid, doc_id, lang, n_chars, m1, m2, __trusted, text) -> a row each, and per shard one row of the distinct pairs of a batch of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows(held, own):
            batch = own[0]["uid"]
            keys, doc, n = (np.concatenate(x) for x in zip(*held))
            trusted = np.array([d["__trusted"] for d in own], np.uint32)
            order = np.lexsort((doc, keys))
            keys, doc, n = keys[order], doc[order].astype(np.uint32), np.minimum(n[order], 2**31).astype(np.uint32)
            at = doc * np.uint32(2) + trusted[doc]
            parts = [(s, p) for s, p in zip(names, _split(keys, len(names))) if len(p)]
            if parts:
                yield _rows(
                    len(parts), batch=[batch] * len(parts), shard=[s for s, _ in parts], kind=[ASKED] * len(parts), size=[len(p) for _, p in parts],
                    keys=[_pack_keys(keys[p]) for _, p in parts], n=[_pack(n[p]) for _, p in parts], at=[_pack(at[p]) for _, p in parts],
                )
            home = (mix64(np.uint64(batch) + np.arange(len(own), dtype=np.uint64)) % np.uint64(len(names))).astype(np.int64)
            plain = {k: [d[k] for d in own] for k in ("doc_id", "lang", "n_chars", "m1", "m2", "n_words", "base")}
            yield _rows(len(own), batch=[batch] * len(own), shard=np.array(names, np.int32)[home], kind=[DOCUMENT] * len(own), idx=list(range(len(own))), trusted=[d["__trusted"] for d in own], **plain)

        held, own, size = [], [], 0
        for rb in it:
            docs = rb.drop_columns(["text"]).to_pylist()
            texts = rb.column("text").to_pylist()
            for lo, hi in batches(texts):
                keys, row, words = model.words.pairs(texts[lo:hi])
                base = np.bincount(row, model.base(keys), hi - lo) if len(keys) else np.zeros(hi - lo)
                # distinct pairs of each document, with their number
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])) if len(keys) else np.zeros(0, np.int64)
                held.append((keys[new], row[new] + len(own), np.diff(np.append(new, len(keys)))))
                own += [d | {"n_words": int(words[i]), "base": float(base[i])} for i, d in enumerate(docs[lo:hi])]
                size += len(new)
                if size >= HELD:
                    yield from rows(held, own)
                    held, own, size = [], [], 0
        if own:
            yield from rows(held, own)

    return run


def _answer(shared):
    """Rows sorted by shard and kind: a shard's counts first, then what is asked of it. Memory holds one shard's counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, parts, keys, counts = shared.value, None, [], None, None
        for rb in it:
            kind = rb.column("kind").to_numpy(zero_copy_only=False)
            if (kind == DOCUMENT).any():
                yield rb.filter(pa.array(kind == DOCUMENT))
            for r in rb.filter(pa.array(kind != DOCUMENT)).to_pylist():
                if r["shard"] != now:
                    now, parts, keys = r["shard"], [], None
                asked = _unpack_keys(r["keys"], r["size"])
                if r["kind"] == COUNTS:
                    parts.append((asked, _unpack(r["n"], r["size"], np.int64)))
                    continue
                if keys is None:
                    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
                    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
                    order = np.argsort(keys, kind="stable")
                    keys, counts, parts = keys[order], counts[order], []
                pos = np.searchsorted(keys, asked)
                hit = pos < len(keys)
                hit[hit] = keys[pos[hit]] == asked[hit]
                pos, asked = pos[hit], asked[hit]
                n, at = _unpack(r["n"], r["size"], np.uint32)[hit].astype(np.int64), _unpack(r["at"], r["size"], np.uint32)[hit]
                left = counts[pos] - np.where(at & np.uint32(1), n, 0)  # a trusted text is scored without its own pairs
                gains = np.bincount((at >> np.uint32(1)).astype(np.int64), n * model.gain(asked, left)) if len(at) else np.zeros(0)
                idx = np.flatnonzero(gains).astype(np.uint32)
                if len(idx):
                    yield _rows(1, batch=[r["batch"]], kind=[GAINED], size=[len(idx)], at=[_pack(idx)], n=[_pack(gains[idx].astype(np.float32))])

    return run


_SCORED = "doc_id long, lang string, n_chars long, m1 long, m2 long, trusted boolean, n_words long, bits double"


def _total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch and kind, documents first -> bits per word of each document."""

    def out(docs, gains):
        t = pa.Table.from_batches(docs).sort_by("idx")
        words, base = t["n_words"].to_numpy(), t["base"].to_numpy()
        bits = np.where(words > 0, -(base + gains[: len(words)]) / np.maximum(words, 1), 0.0)
        yield from t.select(["doc_id", "lang", "n_chars", "m1", "m2", "trusted", "n_words"]).append_column("bits", pa.array(np.maximum(bits, 0.0))).to_batches()

    now, docs, gains = None, [], np.zeros(0)
    for rb in it:
        batch = rb.column("batch").to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(batch)]
        for lo, hi in zip(edge, edge[1:]):
            if hi == lo:
                continue
            if batch[lo] != now:
                if docs:
                    yield from out(docs, gains)
                now, docs, gains = batch[lo], [], np.zeros(0)
            part = rb.slice(lo, hi - lo)
            kind = part.column("kind").to_numpy(zero_copy_only=False)
            if (kind == DOCUMENT).any():
                docs.append(part.filter(pa.array(kind == DOCUMENT)))
            if len(gains) < (rows := sum(d.num_rows for d in docs)):
                gains = np.concatenate([gains, np.zeros(rows - len(gains))])
            for r in part.filter(pa.array(kind == GAINED)).to_pylist():
                gains[_unpack(r["at"], r["size"], np.uint32)] += _unpack(r["n"], r["size"], np.float32)
    if docs:
        yield from out(docs, gains)


def scores(docs: DataFrame, labels: DataFrame, fitted: tuple[Model, DataFrame, list[int]]) -> DataFrame:
    """Per row of docs doc_id, lang, n_chars, trusted, n_words, bits (per word), and m1, m2: a digest of doc_id, lang and text.

    A text's score is a sum that its own task knows (no pair counted) and what each counted pair adds. Tasks send the distinct
    pairs of a batch of texts to the shards, which hold the counts, and shards send back one sum per text. A frequent pair is
    spread over the rows of many batches, and shards are dealt by a hash of the pair, so neither frequent words nor pairs
    gather in one task.
    """
    model, table, names = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc_id, lang = F.col("doc_id").cast("long"), F.col("lang").cast("string")
    four = docs.select(doc_id.alias("doc_id"), lang.alias("lang"), F.length(_text()).cast("long").alias("n_chars"), *_marks(), _text().alias("text"))
    asked = _trusted(four, labels).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "lang", "n_chars", "m1", "m2", "__trusted", "text").mapInArrow(_ask(shared, names), _PARTS)
    counts = table.select(*[F.col(k) if k in ("shard", "size", "keys", "n") else F.lit(COUNTS).alias(k) if k == "kind" else F.lit(None).cast(x.split()[1]).alias(k) for k, x in zip(_NAMES, _PARTS.split(", "))])
    found = asked.union(counts).repartition(len(names), "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answer(shared), _PARTS)
    return found.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_total, _SCORED)


def _marks():
    """Two digests of a row's doc_id, lang and text."""
    three = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), _text()]
    return F.xxhash64(*three).alias("m1"), F.xxhash64(F.lit(1), *three[::-1]).alias("m2")


#: A document is rejected if its bits per word lie further above its language's median than SLACK times the QUANTILE of what
#: trusted documents do, both in units of the deviation that a document of its length has. SLACK was set by looking at the
#: labels of sf0.1 (see the README).
QUANTILE, SLACK = 0.995, 1.4
#: Languages with fewer trusted documents take deviation and quantile from all languages together.
LEAST_TEXTS = 50


def _language(c="lang"):
    """The language as a key; null is one of its own, apart from the empty string."""
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))


def _deviation(a="a", b="b"):
    return F.sqrt(F.col(a) + F.col(b) / F.greatest(F.col("n_words"), F.lit(1)))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame]:
    """(__lang, mid, a, b, top) by language, and one row of the same for texts of other languages.

    mid is the median of bits over trusted texts. The squared deviation of a text of n words is a + b / n, fitted by least
    squares to the texts above the median; top is the quantile of (bits - mid) / deviation.
    """
    own = scored.filter(F.col("trusted") & (F.col("n_words") > 0)).select(_language().alias("__lang"), "bits", "n_words")
    middle = lambda: F.percentile_approx("bits", 0.5, 10000).alias("mid")
    mids = cut(own.groupBy("__lang").agg(middle(), F.count("*").alias("texts")))
    off = own.join(mids, "__lang").withColumn("off", F.col("bits") - F.col("mid"))
    y, x = F.pow("off", F.lit(2.0)), 1 / F.col("n_words")
    b = F.greatest(F.when(F.var_pop(x) > 1e-12, F.regr_slope(y, x)).otherwise(F.lit(0.0)), F.lit(0.0))
    fit = [b.alias("b"), F.greatest(F.avg(y) - b * F.avg(x), F.lit(1e-4)).alias("a")]
    up = off.filter("off >= 0")
    each, every = cut(up.groupBy("__lang").agg(*fit)), cut(up.agg(*fit).select(F.col("a").alias("a0"), F.col("b").alias("b0")))
    off = off.join(each, "__lang").join(F.broadcast(every))
    top = lambda *dev: F.percentile_approx(F.col("off") / _deviation(*dev), quantile, 10000)
    tops = cut(off.groupBy("__lang").agg(top().alias("top")))
    other = cut(off.agg(top("a0", "b0").alias("top0"), middle().alias("mid0"), F.first("a0").alias("a0"), F.first("b0").alias("b0")))
    full = mids.join(each, "__lang").join(tops, "__lang").join(F.broadcast(other))
    enough = F.col("texts") >= LEAST_TEXTS
    return cut(full.select("__lang", "mid", *[F.when(enough, F.col(c)).otherwise(F.col(f"{c}0")).alias(c) for c in ("a", "b", "top")])), other


def _judged(docs: DataFrame, labels: DataFrame, fitted) -> DataFrame:
    scored = cut(scores(docs, labels, fitted or fit(docs, labels)))
    each, other = thresholds(scored)
    # one row per language, of known size once written: broadcast if small, so that a language of most rows isn't one task
    out = scored.withColumn("__lang", _language()).join(each, "__lang", "left").join(F.broadcast(other))
    out = out.withColumns({c: F.coalesce(c, f"{c}0") for c in ("mid", "a", "b", "top")})
    limit = F.col("mid") + SLACK * F.col("top") * _deviation()
    return out.withColumn("limit", limit).withColumn("kept", (F.col("n_words") == 0) | F.coalesce(F.col("bits") <= F.col("limit"), F.lit(True)))


def quality_scores(docs: DataFrame, labels: DataFrame, fitted: tuple[Model, DataFrame, list[int]] | None = None) -> DataFrame:
    """Per row doc_id, lang, n_chars, perplexity (2 ** bits per word), threshold, kept.

    Trains on every text that labels trust (quality 1, not toxic), scores all texts (trusted ones without their own pairs), and
    rejects those whose bits per word exceed the limit of their language at their length, or of all languages where none of
    its texts is trusted. Blank texts score 1 and are kept; without any trusted text nothing is rejected. Rows are
    independent: repeated rows and null ids or languages pass through (null: a language of its own). Empty table: empty. Labels
    may repeat ids. Other columns are not read.
    """
    return _judged(docs, labels, fitted).select("doc_id", "lang", "n_chars", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "limit").alias("threshold"), "kept")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that quality_scores rejects: digests of rejected rows are taken out, by broadcast where there are few."""
    gone = cut(_judged(docs, labels, None).filter("NOT kept").select(F.col("m1").alias("__m1"), F.col("m2").alias("__m2")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    # docs' own columns travel in one struct, so that none of their names can clash
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *_marks())
    left = named.join(gone, (F.col("m1") == F.col("__m1")) & (F.col("m2") == F.col("__m2")), "left_anti")
    return left.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])

"""Cross-tokenizer alignment by a dangling-suffix transducer, with corpus-wide counts of linked token pairs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import _BYTE, _JOINED, _ODD, _memo, _two

#: Characters of text in a block: its documents share one list of pairs. A longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Units and pairs that a worker remembers before it starts anew, the longest unit it remembers, and the pairs in a row of a block's list.
UNITS, PAIRS, UNIT_CHARS, LIST = 600_000, 3_000_000, 64, 32_768
#: New units that are encoded and aligned together.
TOGETHER = 8192

#: A space that follows a character other than white space: the next unit begins there.
_CUT = re.compile(r"(?<=\S) ")


class Transducer:
    """Aligns two token sequences over the same bytes.

    A state is the residual: which side leads (0 the first, 1 the second), and its bytes that the other side has not matched
    yet. The side that lags reads its next token, the first one where nothing is left over; each transition depends on residual and token only and is found once. An empty residual closes a
    group. Token sequences whose bytes differ have no alignment.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.clear()

    def clear(self) -> None:
        self.lead, self.left, self.next, self.number = [1], [b""], [_Row(self, 0)], {(1, b""): 0}

    def _step(self, state: int, token: int) -> int:
        """The state after the side that lags reads token; -1 where the bytes disagree. In the empty state the first side reads."""
        lead, left = self.lead[state], self.left[state]
        x = self.bytes[1 - lead][token]
        if left.startswith(x):
            lead, left = lead, left[len(x) :]
        elif x.startswith(left):
            lead, left = 1 - lead, x[len(left) :]
        else:
            return -1
        new = (lead, left) if left else (1, b"")
        if new not in self.number:
            self.number[new] = len(self.lead)
            self.lead.append(new[0]), self.left.append(new[1]), self.next.append(_Row(self, len(self.next)))
        return self.number[new]

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Where each of the smallest groups of tokens over the same bytes ends in a and in b; None where the bytes of a and b differ."""
        if len(self.lead) > PAIRS:
            self.clear()
        lead, follow, in_a, in_b, i, j = self.lead, self.next, [], [], 0, 0
        first, n = follow[0], len(a)
        end_a, end_b = in_a.append, in_b.append
        try:
            while i < n:
                state = first[a[i]]
                i += 1
                while state > 0:
                    if lead[state]:
                        state = follow[state][a[i]]
                        i += 1
                    else:
                        state = follow[state][b[j]]
                        j += 1
                if state < 0:
                    return None
                end_a(i), end_b(j)
        except IndexError:  # one side ended before the other
            return None
        return (in_a, in_b) if j == len(b) else None


class _Row(dict):
    """The transitions out of a state, found as they are asked for."""

    def __init__(self, of: Transducer, state: int):
        self.of, self.state = of, state

    def __missing__(self, token: int) -> int:
        self[token] = out = self.of._step(self.state, token)
        return out


class Aligner:
    """Groups and links of texts, found once for each unit: a run of characters that both tokenizers encode on its own.

    Both vocabularies' tokens begin at a space that follows a character other than white space, so a text is cut there. A
    unit whose tokens give back its bytes is exact; a text with any other unit is encoded and aligned as a whole.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str, piece_path: str):
        import base64

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(json_path)
        self.lib.encode_special_tokens = True
        self.lib.no_truncation(), self.lib.no_padding()
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte = {c: x for x, c in enumerate(_BYTE)}
        own = [self.lib.id_to_token(i) for i in range(self.lib.get_vocab_size())]
        a_bytes = [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else (t or "").encode() for t in own]
        model, b_bytes = self.pieces, []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
        # units may be encoded alone only if no piece holds a space after another character
        self.by_unit = not any(b" " in b.lstrip(b" ") for b in b_bytes)
        self.transducer, self.width = Transducer(a_bytes, b_bytes), np.array([len(x) for x in a_bytes])
        self._clear()

    def _clear(self) -> None:
        self.unit: dict[str, int] = {}  # a unit without its leading space -> its number
        self.says: list[str] = []
        self.sizes = np.zeros((1 << 12, 4), np.int64)  # per unit: a tokens, b tokens, groups, links
        self.seen = np.zeros(1 << 12, np.int64)  # how often a unit was met since units were last forgotten
        self.begin = np.zeros(1 << 12, np.int64)  # where a unit's pairs begin; they end where the next one's begin
        self.pool, self.often, self.used = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64), 0
        self.number: dict[int, int] = {}  # pair -> its number
        self.word: dict[int, str] = {}  # pair -> how a group of just these two tokens is written

    def tidy(self) -> None:
        """Where there are too many units, forgets those seen once; between blocks only."""
        n = len(self.says)
        if n <= UNITS and len(self.number) <= PAIRS:
            return
        keep = np.flatnonzero(self.seen[:n] > 1)
        if 2 * len(keep) > UNITS or len(self.number) > PAIRS:
            self._clear()
            return
        place = np.full(n, -1)
        place[keep] = np.arange(len(keep))
        size = self.begin[keep + 1] - self.begin[keep]
        ends = np.cumsum(size)
        flat = np.arange(size.sum()) - np.repeat(ends - size, size) + np.repeat(self.begin[keep], size)
        self.used = len(flat)
        self.pool[: self.used], self.often[: self.used] = self.pool[flat], self.often[flat]
        self.sizes[: len(keep)], self.seen[: len(keep)] = self.sizes[keep], 1
        self.seen[len(keep) :] = 0
        self.begin[1 : len(keep) + 1] = ends
        self.says = [self.says[i] for i in keep]
        self.unit = {p: i for p, i in zip(self.unit, place[list(self.unit.values())].tolist()) if i >= 0}

    def _a(self, s: str) -> list[int]:
        return self.lib.encode(s, add_special_tokens=False).ids if _ODD.search(s) else self.fast.encode_ordinary(s)

    def _keep(self, says: list[str], sizes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, often: np.ndarray) -> int:
        """Adds units with their pairs, unit by unit; the number of the first."""
        n, used = len(self.says), self.used
        while len(self.begin) < n + len(says) + 1:
            self.sizes, self.begin, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.begin, self.seen))
        while len(self.pool) < used + len(pairs):
            self.pool, self.often = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pool, self.often))
        distinct, at = np.unique(pairs, return_inverse=True)
        number = self.number
        own = np.array([number.setdefault(p, len(number)) for p in distinct.tolist()], np.int64)
        self.pool[used : used + len(pairs)], self.often[used : used + len(pairs)] = own[at] if len(own) else 0, often
        self.sizes[n : n + len(says)] = sizes
        self.begin[n + 1 : n + 1 + len(says)] = used + np.cumsum(counts)
        self.says += says
        self.used += len(pairs)
        return n

    def _whole(self, s: str) -> int:
        """The number of s, which begins with a space, as one unit; -1 where its tokens don't give back its bytes."""
        a, b = self.lib.encode(s, add_special_tokens=False).ids, self.pieces.encode(s[1:])
        side = self.transducer.bytes
        ends = self.transducer.ends(a, b) if a and b and b"".join(side[0][x] for x in a) == s.encode("utf-8", "surrogatepass") else None
        if ends is None:
            return -1
        links, says, linked, i, j = 0, [], Counter(), 0, 0
        for x, y in zip(*ends):
            ga, gb, i, j = a[i:x], b[j:y], x, y
            links += len(ga) * len(gb)
            says.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            in_b = Counter(gb)
            for p, m in Counter(ga).items():
                for q, n in in_b.items():
                    linked[p << 32 | q] += m * n
        sizes = np.array([[len(a), len(b), len(says), links]], np.int64)
        return self._keep([";".join(says)], sizes, np.array([len(linked)]), np.fromiter(linked, np.int64, len(linked)), np.fromiter(linked.values(), np.int64, len(linked)))

    def _together(self, units: list[str]) -> bool:
        """Aligns units, none of which ends in white space, as one text: their tokens are those of each on its own. False where some don't give back their bytes."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        a, b = self._a(" " + " ".join(units)), self.pieces.encode(" ".join(units))
        side = self.transducer.bytes
        found = self.transducer.ends(a, b)
        if found is None or b"".join(side[0][x] for x in a) != b" " + b" ".join(raw):
            return False
        ia, ib = np.array(a), np.array(b)
        in_a, in_b = np.array(found[0]), np.array(found[1])
        na, nb = np.diff(in_a, prepend=0), np.diff(in_b, prepend=0)
        byte_end = np.cumsum(self.width[ia])[in_a - 1]
        unit_end = np.cumsum([len(r) + 1 for r in raw])
        last = np.searchsorted(byte_end, unit_end)
        if (byte_end[np.minimum(last, len(byte_end) - 1)] != unit_end).any():
            return False
        group = np.diff(last + 1, prepend=0)  # groups of each unit
        of = np.repeat(np.arange(len(units)), group)
        sizes = np.stack([np.bincount(of, w, len(units)).astype(np.int64) for w in (na, nb, np.ones(len(of)), na * nb)], 1)
        each = na * nb  # links of a group: its first tokens times its second ones
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(nb, each)
        pair = ia[np.repeat(in_a - na, each) + at // wide] << 32 | ib[np.repeat(in_b - nb, each) + at % wide]
        distinct, at = np.unique(pair, return_inverse=True)
        key, often = np.unique(np.repeat(of, each) * len(distinct) + at, return_counts=True)
        unit, pair = key // len(distinct), distinct[key % len(distinct)]
        word, says = self.word, []
        for x, y, m, n, code in zip(found[0], found[1], na.tolist(), nb.tolist(), (ia[in_a - 1] << 32 | ib[in_b - 1]).tolist()):
            if m == n == 1:
                if code not in word:
                    word[code] = f"{code >> 32}|{code & 0xFFFFFFFF}"
                says.append(word[code])
            else:
                says.append(",".join(map(str, a[x - m : x])) + "|" + ",".join(map(str, b[y - n : y])))
        done = [0, *(last + 1).tolist()]
        first = self._keep([";".join(says[i:j]) for i, j in zip(done, done[1:])], sizes, np.bincount(unit, minlength=len(units)), pair, often)
        self.unit.update(zip(units, range(first, first + len(units))))
        return True

    def _parts(self, text: str) -> list[str]:
        """The units of a space and text, each without its leading space."""
        if not self.by_unit:
            return [text]
        if not _JOINED.search(" " + text):
            return text.split(" ")
        return _CUT.split(text)

    def units(self, texts: list[str | None]) -> list[list[int]]:
        """Per text the numbers of the units of a space and text, in order; empty where the text has no tokens."""
        split = [self._parts(t) if t else [] for t in texts]
        known = self.unit
        new = [p for p in set(chain.from_iterable(split)).difference(known) if p and len(p) <= UNIT_CHARS and not p[-1].isspace()]
        odd = [p for p in new if _ODD.search(p)]
        plain = [p for p in new if not _ODD.search(p)] if odd else new
        for group in (plain, odd):
            for lo in range(0, len(group), TOGETHER):
                self._together(group[lo : lo + TOGETHER])
        out = []
        for text, parts in zip(texts, split):
            try:
                out.append([known[p] for p in parts])
                continue
            except KeyError:
                got = []
            for p in parts:
                n = known.get(p)
                got.append(self._whole(" " + p) if n is None else n)
                if got[-1] < 0:  # not given back: the text as a whole may still be
                    n = self._whole(" " + text)
                    got = [] if n < 0 else [n]
                    break
            out.append(got)
        return out


_aligner = _memo(Aligner)
_BLOCKS = "block long, side int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, first int, pair array<long>, at array<int>, n array<int>"


def _block(al: Aligner, ids: list, texts: list, block: int) -> Iterator[pa.RecordBatch]:
    """A block's list of pairs with the number of documents that hold each (side 0), then a row per document (side 1)."""
    al.tidy()
    rows = al.units(texts)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    unit = np.fromiter(chain.from_iterable(rows), np.int64, len(doc))
    al.seen[: len(al.says)] += np.bincount(unit, minlength=len(al.says))
    sums = np.zeros((len(rows), 4), np.int64)
    edge = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(edge):
        sums[doc[edge]] = np.add.reduceat(al.sizes[unit], edge, axis=0)
    # distinct (document, unit), then its pairs, then distinct (document, pair)
    key, times = np.unique(doc * max(1, len(al.says)) + unit, return_counts=True)
    doc, unit = key // max(1, len(al.says)), key % max(1, len(al.says))
    each = al.begin[unit + 1] - al.begin[unit]
    flat = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(al.begin[unit], each)
    pool, often = al.pool[flat], al.often[flat]
    local, pool = np.unique(pool, return_inverse=True)
    key, weight = np.repeat(doc, each) * max(1, len(local)) + pool, np.repeat(times, each) * often
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, edge) if len(edge) else weight
    doc, at = key[edge] // max(1, len(local)), key[edge] % max(1, len(local))
    code = np.fromiter(al.number, np.int64, len(al.number))[local] if len(local) else np.zeros(0, np.int64)
    df = np.bincount(at, minlength=len(local))
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    null = lambda n, t: pa.nulls(n, t)

    def lists(flat, ends, kind):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32 if kind == pa.int32() else np.int64)))

    for lo in range(0, len(code), LIST):
        part = slice(lo, lo + LIST)
        one = lambda x, t: lists(x[part], [len(x[part])], t)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([0], pa.int32()), *[null(1, pa.int64())] * 5, null(1, pa.string()), pa.array([lo], pa.int32()), one(code, pa.int64()), null(1, pa.list_(pa.int32())), one(df, pa.int32())],
            names,
        )
    ends = np.searchsorted(doc, np.arange(len(rows)), side="right")
    sha = [hashlib.sha256(";".join([al.says[u] for u in r]).encode()).hexdigest() if r else "" for r in rows]
    n = len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), pa.array(np.ones(n, np.int32)), pa.array(ids, pa.int64()), *(pa.array(sums[:, k]) for k in range(4)), pa.array(sha, pa.string()), null(n, pa.int32()), null(n, pa.list_(pa.int64())), lists(at, ends, pa.int32()), lists(weight, ends, pa.int32())],
        names,
    )


def _align(paths: tuple[str, str, str, str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, block = _aligner(*paths), TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0
        for rb in it:
            for i, t in zip(rb.column(0).to_pylist(), rb.column(1)):
                t = t.as_py()
                if texts and chars + len(t or "") > BLOCK_CHARS:
                    yield from _block(al, ids, texts, block)
                    ids, texts, chars, block = [], [], 0, block + 1
                ids.append(i), texts.append(t)
                chars += len(t or "") + 64
        if texts:
            yield from _block(al, ids, texts, block)

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, its pairs' counts first: each document's sums over its links. Memory holds a block's counts."""
    now, held, count, best = None, [], None, None
    for rb in it:
        block, side = rb.column(0).to_numpy(), rb.column(1).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (side[1:] != side[:-1])])) if len(block) else []
        for lo, hi in zip(edge, [*edge[1:], len(block)]):
            if block[lo] != now:
                now, held, count = block[lo], [], None
            part = rb.slice(lo, hi - lo)
            if side[lo] == 0:
                held.append((part.column(9).to_numpy(), part.column(10).to_numpy(zero_copy_only=False)))
                continue
            if count is None:
                count = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
                best = np.concatenate([h[1] for h in held]) if held else np.zeros(0, bool)
            at, n = part.column(7), part.column(8)
            size = np.diff(at.offsets.to_numpy())
            flat, times = at.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = []
            for w in (times * best[flat], times * count[flat]):
                run = np.concatenate([[0], np.cumsum(w)])
                sums.append(pa.array((run[ends[1:]] - run[ends[:-1]]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(2, 7)), *sums, part.column(11)], [c.split()[0] for c in _OUT.split(", ")])


def align_tokenizers(docs: DataFrame, json_path: str, rank_path: str, pattern: str, piece_path: str) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256: how two tokenizers' tokens of a text align.

    Side A is the byte-level vocabulary of json_path (rank_path holds the same one) over a space and the text, side B the piece
    model, which adds that space. Byte offsets at which tokens of both end cut the text into groups; every A and B token of a
    group are linked. A pair's count is the number of documents of the whole table that hold it linked: n_best sums the links
    whose pair has the highest count of its A id (ties included), count_sum the counts of all links.

    Texts are aligned in blocks of about BLOCK_CHARS characters. A block's distinct pairs alone are shuffled, with the number
    of its documents that hold each, and their counts come back to the block; a frequent pair is one row a block. The highest
    count of each A id is broadcast: at most a row per id of the vocabulary.

    Null and empty texts, and texts that a vocabulary doesn't give back byte by byte: zeros and ''. Special strings are plain
    text. Long texts are aligned whole. Repeated rows count as documents of their own; null ids pass through; an empty table
    gives an empty one. Only doc_id and text are read.
    """
    found = cut(_two(docs).mapInArrow(_align((json_path, rank_path, pattern, piece_path)), _BLOCKS))
    pairs = found.filter("side = 0").select("block", "first", F.posexplode(F.arrays_zip("pair", "n"))).select("block", (F.col("first") + F.col("pos")).alias("place"), "col.pair", "col.n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    judged = counts.join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    back = pairs.select("block", "place", "pair").join(judged, "pair")
    doc = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "at", "n"]
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in doc]
    rows = back.select("block", F.lit(0).alias("side"), *none, "count", "best", F.lit(None).cast("string").alias("groups_sha256"), "place").unionByName(
        found.filter("side = 1").select("block", "side", *doc, F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), "groups_sha256", F.lit(None).cast("int").alias("place"))
    )
    return rows.repartition("block").sortWithinPartitions("block", "side", "place").mapInArrow(_weigh, _OUT)

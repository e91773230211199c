"""Exact token counts at every prefix of a text, and encoding for packing, on public tokenizers."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Memoised pieces a worker keeps, and characters of their tables, before it starts anew; bounds its memory.
MEMO, POOL = 1_200_000, 20_000_000
#: Pieces up to so long are merged by the library at every prefix, and so are chunks of unusual characters.
SHORT = 32
_NEVER = 1 << 60
#: Chunks, and the ASCII white space between them.
_CHUNKS = re.compile("[ \t\n\r]+|[^ \t\n\r]+")
#: Beyond these characters libraries may differ in normalisation or in what counts as a letter or space.
_ODD = re.compile("[^\t\n\r -~\xa1-ɏ]")
#: The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100.
_BYTE = [chr(x) for x in range(256)]
_hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255)]
for _i, _x in enumerate(_hidden):
    _BYTE[_x] = chr(256 + _i)
_workers: dict = {}


def _memo(build):
    """One per Python worker and vocabulary, reused by its tasks."""

    def get(*key):
        if (build, key) not in _workers:
            _workers[build, key] = build(*key)
        return _workers[build, key]

    return get


class _Dict(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) > MEMO:
            self.clear()
        v = self[key] = self.make(key)
        return v


class PrefixCounter:
    """Exact token counts at every prefix of a text, for a BPE vocabulary whose tokens never span ASCII white space.

    table(text)[p] is the number of tokens of text[:p] for every p from 0 to len(text), as the library counts text[:p] on
    its own. Texts are divided into pieces or chunks that can be counted on their own; the counts at a piece's prefixes are
    found once and reused, and the text's table is their running sum, so counting, truncating and budgets need no encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation(), self.lib.no_padding()
        special = sorted((t.content for t in self.lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.cut = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split") + r"|\s+")
        self.lowers = any(p["type"] == "Lowercase" for p in spec["normalizer"]["normalizers"])
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.split = {a + b: (a, b) for a, b in self.rank}
        self.left, self.right, self.whole = _Dict(lambda t: self._edge(t, 0)), _Dict(lambda t: self._edge(t, 1)), _Dict(self._whole)
        self.longest = max(map(len, self.vocab))
        self._clear()

    def _clear(self) -> None:
        self.id: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def encode_count(self, text: str) -> int:
        return len(self.lib.encode(text, add_special_tokens=False).ids)

    def _prefixes(self, s: str) -> np.ndarray:
        """Counts of s[:1], s[:2], ... by encoding each: for short strings."""
        return np.fromiter((self.encode_count(s[:i]) for i in range(1, len(s) + 1)), np.int32, len(s))

    def _unusual(self, s: str) -> np.ndarray:
        """Counts at the prefixes of a chunk without special strings.

        A long one is divided where the pre-tokenizer divides it: what stands before a piece does not depend on how much of
        the piece follows. That needs a normaliser that maps it character by character. A short chunk is encoded by the
        library at every prefix instead, and so is a long one that normalisation would compose or lengthen.
        """
        if len(s) <= SHORT:
            return self._prefixes(s)
        form = self.lib.normalizer.normalize_str(s) if self.lib.normalizer else s
        if len(form) != len(s) or any(map(unicodedata.combining, s)) or any("\u1100" <= c <= "\u11ff" for c in s):
            return self._prefixes(s)
        out, done, at = [], 0, 0
        for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(form):
            n = np.array(self._piece(form[a:b]), np.int32)
            out += [np.full(a - at, done, np.int32), done + n]  # between pieces: white space that only the normaliser knows
            done += int(n[-1])
            at = b
        return np.concatenate([*out, np.full(len(s) - at, done, np.int32)])

    def _edge(self, t: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one end (0 left, 1 right) of a token while merges build it, with the rank that consumes each."""
        out = [(t, _NEVER)]
        while t in self.split:
            pair = self.split[t]
            t = pair[side]
            out.append((t, self.rank[pair]))
        return out

    def _crossed(self, left: str, right: str, whole: bool = False) -> bool:
        """Whether some merge across the border of two tokens would come before the merges that build them. Merges are applied
        by rank, the leftmost of equal rank first. whole: the merge of the two tokens themselves doesn't count."""
        rank, ahead = self.rank.get, self.left[right]
        for r, until_r in self.right[left]:
            for x, until_x in ahead:
                m = rank((r, x))
                if m is not None and m < until_r and m <= until_x and not (whole and r == left and x == right):
                    return True
        return False

    def _whole(self, t: str) -> bool:
        """Whether a token's own text is encoded as that token."""
        if t not in self.split:
            return True
        a, b = self.split[t]
        return self.whole[a] and self.whole[b] and not self._crossed(a, b, True)

    def _last(self, b: str, i: int, inner: list, last: list, mark: str) -> tuple[int, str]:
        """Count and last token of the encoding of b[:i], whose shorter prefixes are known."""
        tail = b[max(0, i - self.longest) : i] + mark
        for j in range(max(0, i - self.longest), i):
            if tail in self.vocab and self.whole[tail] and (not j or not self._crossed(last[j], tail)):
                return inner[j] + 1, tail
            tail = tail[1:]
        raise ValueError("the vocabulary lacks a byte")

    def _piece(self, piece: str) -> list[int]:
        """Counts at the prefixes of a piece of normalised text: a short one's by the library's merges, a long one's by
        dynamic programming over its bytes, in time that grows with its length.

        The encoding of a prefix is that of a shorter prefix and one more token, the one that its neighbour on the left
        allows; so the last token at each place gives the count there. The last token of a whole word has the word-end mark.
        """
        raw = piece.encode("utf-8", "surrogatepass")
        plain = len(raw) == len(piece) and piece.isprintable()
        b = piece if plain else "".join([_BYTE[x] for x in raw])
        ends = range(1, len(b) + 1) if plain else [i for i, x in enumerate([*raw[1:], 0], 1) if x & 0xC0 != 0x80]
        if len(b) <= SHORT:
            merged = self.lib.model.tokenize
            return [len(merged(b[:i])) for i in ends]
        inner, last, out = [0], [""], []
        for i in range(1, len(b) + 1):
            n, t = self._last(b, i, inner, last, "")
            inner.append(n)
            last.append(t)
            out.append(self._last(b, i, inner, last, self.end)[0])
        return [out[i - 1] for i in ends]

    def _chunk(self, chunk: str) -> np.ndarray:
        """Counts at the prefixes of a chunk; special strings count one once whole, and are plain text until then."""
        out, at, done = [], 0, 0
        for m in self.special.finditer(chunk):
            n = self._unusual(chunk[at : m.end() - 1]) + done if m.end() - 1 > at else np.zeros(0, np.int32)
            done = (int(n[m.start() - at - 1]) if m.start() > at else done) + 1
            out += [n, np.array([done], np.int32)]
            at = m.end()
        if at < len(chunk):
            out.append(self._unusual(chunk[at:]) + done)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _add(self, part: str, n) -> int:
        if self.used + len(n) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(n)), np.int32)])
        self.pool[self.used : self.used + len(n)] = n
        i = len(self.id)
        if i == len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.begin, self.size))
        self.begin[i], self.size[i] = self.used, len(n)
        self.used += len(n)
        self.id[part] = i
        return i

    def _part(self, part: str) -> int:
        """The place of a part's counts. White space adds no token."""
        if part in self.id:
            return self.id[part]
        if part.strip(" \t\n\r") == "":
            return self._add(part, np.zeros(len(part), np.int32))
        return self._add(part, self._piece(part))

    def _chunk_part(self, chunk: str) -> int:
        key = "\0" + chunk  # apart from pieces, which are normalised
        if key in self.id:
            return self.id[key]
        return self._add(key, np.zeros(len(chunk), np.int32) if chunk.strip(" \t\n\r") == "" else self._chunk(chunk))

    def _parts(self, text: str) -> list[int]:
        """The places of the counts of a text's parts.

        A text of usual characters falls into the pieces that the vocabulary's own pattern finds, any other into chunks
        between ASCII white space; counts at the prefixes of either are found once.
        """
        if len(self.id) > MEMO or self.used > POOL:
            self._clear()
        form = text.lower() if self.lowers else text
        if len(form) == len(text) and not _ODD.search(text) and not self.special.search(text):
            parts, find = self.cut.findall(form), self._part
        else:
            parts, find = _CHUNKS.findall(text), self._chunk_part
        get = self.id.get
        ids = [get(x, -1) for x in parts] if find == self._part else [-1]
        if -1 in ids:
            ids = [find(x) for x in parts]
        return ids

    def table(self, text: str | None) -> np.ndarray:
        """Counts at all prefixes, from the empty one to the whole text: the running sums of the parts' counts."""
        if not text:
            return np.zeros(1, np.int32)
        ids = self._parts(text)
        size = self.size[ids]
        upto = np.cumsum(size)
        last = self.pool[self.begin[ids] + size - 1]
        flat = np.arange(upto[-1]) + np.repeat(self.begin[ids] - upto + size, size)
        out = np.zeros(len(text) + 1, np.int32)
        out[1:] = self.pool[flat] + np.repeat(np.cumsum(last) - last, size)
        return out

    def total(self, text: str | None) -> int:
        """The last entry of the text's table: the sum of the last counts of its parts."""
        if not text:
            return 0
        ids = np.array(self._parts(text))
        return int(self.pool[self.begin[ids] + self.size[ids] - 1].sum())

    @staticmethod
    def at(table: np.ndarray, p: int) -> int:
        """Tokens of text[:p]."""
        return int(table[p])

    @staticmethod
    def truncate(table: np.ndarray, budget: int) -> int:
        """The length of the longest prefix that has at most budget tokens."""
        return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


counter = _memo(PrefixCounter)


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counts(path: str, limit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for rb in it:
            n, size, cut_at = [], [], []
            for text in rb.column(1):
                t = text.as_py() or ""
                n.append(c.total(t))
                cut_at.append(len(t) if n[-1] <= limit else c.truncate(c.table(t), limit))
                size.append(len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cut_at, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_at"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per row doc_id, n_bytes, n_tokens, over_limit and cut_at, read from the text's prefix table.

    n_tokens is the table's last entry, cut_at the length of the longest prefix of at most limit tokens. The vocabulary at
    path is a tokenizers file of word-wise BPE. Null and empty texts: 0, false and 0. Long texts are counted whole. Rows are
    independent: repeated rows and null ids pass through, an empty table gives an empty one. Only doc_id and text are read.
    """
    return _two(docs).mapInArrow(_counts(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_at long")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """Per row doc_id and counts, the prefix table itself: element p (from 0) is the number of tokens of the first p characters."""

    def run(it):
        c = counter(path)
        for rb in it:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([c.table(t.as_py()) for t in rb.column(1)], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return _two(docs).mapInArrow(run, "doc_id long, counts array<int>")


def budget_prefix(tables: DataFrame, budget: int) -> DataFrame:
    """prefix_tables -> doc_id, cut_at, tokens: the longest prefix within budget (not below 0) and its tokens. No text is needed."""
    cut_at = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i)))
    return tables.select("doc_id", "counts", cut_at.cast("long").alias("cut_at")).select("doc_id", "cut_at", F.get("counts", F.col("cut_at").cast("int")).cast("long").alias("tokens"))


#: A space at which a text can't be cut for encoding: white space (or an edge) on both sides.
_JOINED = re.compile(r"\s (?:\s|$)|^ \s")


class ByteEncoder:
    """Ids of a byte-level vocabulary as bytes (little-endian unsigned 32 bit), memoised by space-separated chunk.

    In this family a token never spans a space that separates two chunks, so a chunk with its leading space is encoded once
    and reused. The rank file is the same vocabulary; special strings and unusual characters go through the .json library.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(json_path)
        self.lib.no_truncation(), self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk = _Dict(lambda c: np.array(self.fast.encode_ordinary(c), "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or _ODD.search(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _JOINED.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = self.chunk[first] if first else b""
        return head + b"".join(map(self.chunk.__getitem__, map(" ".__add__, rest)))


encoder = _memo(ByteEncoder)

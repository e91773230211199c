"""Secret scanning: fixed patterns, and a small character CNN over every candidate and its surrounding context."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The base patterns, kept as given. Kinds in order.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "cnn")
#: A candidate: a run of token characters of some length. Whatever it is made of, the network judges it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Characters of context that the network sees in front of a candidate and behind it; of the candidate it sees all.
BEFORE, AFTER = 24, 12
#: Positions convolved at a time when scanning; bounds memory, however long a candidate.
SPAN = 65_536
#: Labelled findings of either kind that the fit begins with (all follow), and the share of documents held out.
LABELLED, HELD_OUT = 1500, 4
#: Rounds over all labelled findings, their shards (of SHARD findings, but SHARDS at most: each sends its parameters to the driver),
#: and steps of the log odds that the threshold is found in.
ROUNDS, SHARD, SHARDS, STEPS = 2, 4000, 256, 1000
#: Longer findings are left out of the fit (whose batches are as wide as their longest row), not cut; calibration and scans take them whole.
FIT_CHARS = 200
_CLASSES = "abcdefghijklmnopqrstuvwxyzU0123456789 =:\"'_-+/.,"


def _code(c: str) -> int:
    if c in _CODE:
        return _CODE[c]
    return _CODE["U"] if "A" <= c <= "Z" else len(_CLASSES) + 1


_CODE = {c: i + 1 for i, c in enumerate(_CLASSES)}
_TABLE = np.array([0 if i == 0 else _code(chr(i)) for i in range(128)], np.int64)
CODES = len(_CLASSES) + 2
#: Width of the convolution.
WIDTH = 5


def codes(text: str) -> np.ndarray:
    """Codes of characters from 1; the last one stands for all that have none of their own."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(a < 128, _TABLE[np.minimum(a, 127)], CODES - 1)


def encode(before: str, body: str, after: str) -> np.ndarray:
    """A candidate and its context between zeros. The candidate's own characters have codes apart from those of context."""
    parts = codes(before), codes(body) + CODES, codes(after)
    return np.concatenate([np.zeros(WIDTH - 1, np.int64), *parts, np.zeros(WIDTH, np.int64)])


def padded(rows: list[np.ndarray]) -> np.ndarray:
    """Encoded candidates as one matrix, filled with zeros on the right."""
    out = np.zeros((len(rows), max(map(len, rows), default=WIDTH)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Network:
    """Embedding, one convolution, ReLU, maximum over positions, logistic output; numpy only."""

    def __init__(self, seed: int = 5, dim: int = 8, filters: int = 24, width: int = WIDTH):
        r = np.random.Generator(np.random.PCG64(seed))
        self.width = width
        self.p = {
            "e": r.normal(0, 0.5, (2 * CODES, dim)),
            "w": r.normal(0, 1 / np.sqrt(width * dim), (width * dim, filters)),
            "b": np.zeros(filters),
            "v": r.normal(0, 1 / np.sqrt(filters), filters),
            "c": np.zeros(1),
        }
        self.threshold = 0.5

    def forward(self, x: np.ndarray):
        n = x.shape[1] - self.width + 1
        win = x[:, np.arange(n)[:, None] + np.arange(self.width)]
        emb = self.p["e"][win].reshape(len(x), n, -1)
        act = emb @ self.p["w"] + self.p["b"]
        top = act.argmax(1)
        best = np.take_along_axis(act, top[:, None], 1)[:, 0]
        hid = np.maximum(best, 0)
        return 1 / (1 + np.exp(-(hid @ self.p["v"] + self.p["c"]))), (win, emb, top, hid)

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of each encoded candidate. Candidates stand one after the other, and what each offset of the convolution
        makes of a code is looked up; the maximum is taken piece by piece, so length is no matter."""
        if not rows:
            return np.zeros(0)
        seq, size = np.concatenate(rows), np.array([len(r) for r in rows])
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), size)
        dim = self.p["e"].shape[1]
        made = [self.p["e"] @ self.p["w"][j * dim : (j + 1) * dim] for j in range(self.width)]
        best = np.full((len(rows), len(self.p["b"])), -np.inf)
        for lo in range(0, len(seq), SPAN):
            hi = min(lo + SPAN, len(seq) - self.width + 1)
            if hi <= lo:
                break
            act = sum(made[j][seq[lo + j : hi + j]] for j in range(self.width))
            # windows that reach into the next candidate begin in the zeros at a candidate's end
            at = np.arange(lo, hi)
            inside = at + self.width <= (begin + size)[row[lo:hi]]
            act, own = act[inside], row[lo:hi][inside]
            if len(own):
                edge = np.flatnonzero(np.diff(own, prepend=-1))
                np.maximum.at(best, own[edge], np.maximum.reduceat(act, edge))
        return 1 / (1 + np.exp(-(np.maximum(best + self.p["b"], 0) @ self.p["v"] + self.p["c"])))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the logistic loss over encoded candidates. A batch's candidates stand one after the other, as in `probability`:
        what each offset of the convolution makes of a code is looked up, and no candidate is widened to the longest one."""
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        seq, size = np.concatenate([*rows, np.zeros(self.width, np.int64)]), np.array([len(x) for x in rows], np.int64)
        begin, (n_codes, dim), each = np.cumsum(size) - size, self.p["e"].shape, np.arange(self.width)
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                at = order[lo : lo + batch]
                n = size[at] - self.width + 1  # windows of each candidate
                edge = np.cumsum(n) - n
                first = np.repeat(begin[at] - edge, n) + np.arange(n.sum())
                made = np.einsum("cd,jdf->jcf", self.p["e"], self.p["w"].reshape(self.width, dim, -1), optimize=True)
                act = made[0][seq[first]]
                for j in range(1, self.width):
                    act += made[j][seq[first + j]]
                best = np.maximum.reduceat(act, edge)
                # the first window that reaches a candidate's maximum in each filter
                reach, filt = np.nonzero(act == np.repeat(best, n, 0))
                top = np.zeros(best.shape, np.int64)
                top[np.repeat(np.arange(len(at)), n)[reach][::-1], filt[::-1]] = first[reach][::-1]
                hid = np.maximum(best + self.p["b"], 0)
                d = (1 / (1 + np.exp(-(hid @ self.p["v"] + self.p["c"]))) - y[at]) / len(at)
                g = {"v": hid.T @ d, "c": np.array([d.sum()])}
                dh = (d[:, None] * self.p["v"]) * (hid > 0)
                win = seq[top[:, :, None] + each]  # rows x filters x width
                # how much each code at each offset adds to a filter: gradients of weights and embedding are products with it
                share = np.bincount(((each * n_codes + win) * hid.shape[1] + np.arange(hid.shape[1])[:, None]).ravel(), np.repeat(dh.ravel(), self.width), self.width * n_codes * hid.shape[1]).reshape(self.width, n_codes, -1)
                g["w"] = (self.p["e"].T @ share).reshape(self.width * dim, -1)
                g["b"] = dh.sum(0)
                g["e"] = (share @ self.p["w"].reshape(self.width, dim, -1).transpose(0, 2, 1)).sum(0)
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray, recall: float) -> None:
        """The highest threshold that still finds `recall` of the held-out findings."""
        found = np.sort(self.probability(rows)[y == 1])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5


def generated(n: int, seed: int) -> Iterator[tuple[str, tuple[int, int] | None]]:
    """n lines with the span of the secret each holds, if any: keys, tokens and passwords of many forms against identifiers,
    paths, numbers, dates, addresses and long words."""
    r = random.Random(seed)
    up, low, num = string.ascii_uppercase, string.ascii_lowercase, string.digits
    run = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda a=2, b=9: run("etaoinshrdlu", a, b)
    prose = lambda: " ".join(word() for _ in range(4))
    key = lambda: r.choice(("key", "auth", "credential", "pwd", "bearer", "private_key", "access", "signature", "client_key", "SIGNING_KEY_OF_THE_ACCOUNT"))
    secret = (lambda: run(up + low + num, 14, 44), lambda: run(up + low + num + "+/", 24, 60) + "=" * r.randint(0, 2), lambda: r.choice(("sk_", "ghp_", "xoxb-", "pk-")) + run(up + low + num, 16, 40), lambda: run(up + num, 16, 32), lambda: run(up + low, 18, 40), lambda: run("abcdef" + num, 24, 40))
    plain = (lambda: "_".join(word() for _ in range(4)) + run(num, 0, 3), lambda: "/".join(word() for _ in range(4)) + "/" + run(num, 0, 4), lambda: run(num, 12, 24), lambda: "-".join((run(num, 4, 4), run(num, 2, 2), run(num, 2, 2), word(), word())), lambda: word(9, 14) + word(8, 12) + run(num, 0, 2), lambda: word(3, 6) + "-" + run(num, 3, 5) + "-" + word(5, 9), lambda: "=" * r.randint(12, 30) + run(num, 0, 2), lambda: (word(8, 12) + word(8, 12)).upper() + run(num, 0, 1), lambda: word(8, 12).capitalize() + word(6, 12), lambda: "_".join(word(3, 9) for _ in range(4)).upper())
    for _ in range(n):
        hit = r.random() < 0.5
        body = r.choice(secret if hit else plain)()
        if hit:
            lead = r.choice((prose() + " ", prose() + f" {key()} = \"", f"{prose()} {key()}: ", prose() + "\n" + key() + "=", prose() + "/" + word() + "/"))
        else:
            lead = r.choice((prose() + " ", "see " + word() + ". ", prose() + " (", "//" + word() + ".", prose() + "\n", f"{prose()} {word()}: "))
        text = lead + body + r.choice((" ", ". ", "\n", '" ', ") ", "; ")) + prose()
        yield text, (len(lead), len(lead) + len(body)) if hit else None


def _row(text: str, a: int, b: int) -> tuple[str, str, str]:
    return text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """(context before, candidate, context behind) and label of every candidate in n generated lines, as scanning finds them."""
    rows, y = [], []
    for text, secret in generated(n, seed):
        for a, b, _ in candidates(text, base_values(text)):
            rows.append(_row(text, a, b))
            y.append(int(secret is not None and a < secret[1] and secret[0] < b))
    return rows, np.array(y)


#: Runs that are plainly words or numbers: labelled as no finding where no base pattern touches them.
_WORDLIKE = re.compile(r"[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*|[A-Z]+(?:[-_/][A-Z]+)*|[0-9]+(?:[-/][0-9]+)*|[-=_+/]+")


def corpus_findings(docs: DataFrame, limit: int | None = LABELLED) -> DataFrame:
    """(y, rank, held, before, body, after): findings of the corpus labelled by rule, at most limit of either kind a task, or all.

    A base finding's value is a finding (1), but for mere digits or a word; a run of words or digits outside base findings is
    none (0); others stay unlabelled. rank orders them at random but the same way each time; held marks the documents held out.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {0: [], 1: []}
        last = ["~", "~"]  # a kind's largest rank that may stay; digests are below
        types = pa.schema(list(zip(_LABELS, (pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()))))
        batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(_LABELS, x)) for x in rows], types)
        for rb in it:
            if limit is None and (best[0] or best[1]):
                yield batch(best[0] + best[1])
                best = {0: [], 1: []}
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                t = text.as_py() or ""
                mark = hashlib.blake2b(f"{doc_id}".encode(), digest_size=8).digest()
                for a, b, is_base in candidates(t, base_values(t)):
                    if is_base == bool(_WORDLIKE.fullmatch(t, a, b)):
                        continue
                    y, key = int(is_base), hashlib.blake2b(mark + a.to_bytes(8, "big"), digest_size=8).hexdigest()
                    if key <= last[y]:
                        best[y].append((y, key, mark[0] % HELD_OUT == 0, *_row(t, a, b)))
                        if limit is not None and len(best[y]) >= 2 * limit:
                            best[y] = sorted(best[y])[:limit]
                            last[y] = best[y][-1][1]
        yield batch([x for y in best for x in sorted(best[y])[:limit]])

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(run, "y int, rank string, held boolean, before string, body string, after string")


_LABELS = ("y", "rank", "held", "before", "body", "after")


def sampled_findings(docs: DataFrame, limit: int = LABELLED) -> list:
    """The limit first of either label by rank: at most 2 * limit rows, whatever the size of docs."""
    found = cut(corpus_findings(docs, limit))
    return [r for y in (1, 0) for r in found.filter(F.col("y") == y).orderBy(*_LABELS[1:]).limit(limit).collect()]


def trained(found: list = (), lines: int = 2400, recall: float = 0.97, seed: int = 11) -> Network:
    """The network fitted on `lines` generated lines and on the corpus findings of up to FIT_CHARS characters whose documents
    aren't held out; its threshold keeps `recall` of the findings in half as many other lines and in the documents held out. The numbers bound the training."""
    net = Network()
    rows, y = labelled_findings(lines, seed)
    own = [r for r in found if not r["held"] and len(r["body"]) <= FIT_CHARS]
    net.fit([encode(*r) for r in rows] + [encode(r["before"], r["body"], r["after"]) for r in own], np.array([*y, *(r["y"] for r in own)]))
    rows, y = labelled_findings(lines // 2, seed + 1)
    held = [r for r in found if r["held"]]
    net.calibrate([encode(*r) for r in rows] + [encode(r["before"], r["body"], r["after"]) for r in held], np.array([*y, *(r["y"] for r in held)]), recall)
    return net


def trained_on_all(docs: DataFrame, lines: int = 2400, recall: float = 0.97, seed: int = 11) -> Network:
    """`trained` on the first findings by rank, then fitted on all of docs' labelled findings that aren't held out (of FIT_CHARS at
    most), and calibrated on all that are held out.

    In each round every shard of findings goes on from the same parameters, with the generated lines beside its own, and the
    next ones are the shards' mean by size. Shards follow the findings' ranks and are summed in their order, so partitions
    don't matter; what reaches the driver is SHARDS sets of parameters and one count for each step of the log odds.
    """
    every = cut(corpus_findings(docs, None))
    net = trained([r for y in (1, 0) for r in every.filter(F.col("y") == y).orderBy(*_LABELS[1:]).limit(LABELLED).collect()], lines, recall, seed)
    own = every.filter(~F.col("held") & (F.length("body") <= FIT_CHARS))
    net.fitted = own.count()
    shards = min(SHARDS, -(-net.fitted // SHARD))
    own = own.withColumn("shard", F.pmod(F.xxhash64("rank"), F.lit(shards)).cast("int")) if shards else own
    rows, y = labelled_findings(lines, seed)
    base = [encode(*r) for r in rows]
    names = sorted(net.p)
    for turn in range(ROUNDS if shards else 0):
        now = {k: v.copy() for k, v in net.p.items()}

        def go_on(pdf):
            import pandas as pd

            pdf = pdf.sort_values(list(_LABELS))
            one = Network()
            one.p = {k: v.copy() for k, v in now.items()}
            one.fit(base + [encode(*r) for r in zip(pdf["before"], pdf["body"], pdf["after"])], np.array([*y, *pdf["y"]]), epochs=1, rate=0.003, seed=turn)
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "p": [np.concatenate([one.p[k].reshape(-1) for k in names])]})

        got = sorted(own.groupBy("shard").applyInPandas(go_on, "shard int, n long, p array<double>").collect())
        mean = sum(np.array(r["p"]) * r["n"] for r in got) / sum(r["n"] for r in got)
        at = 0
        for k in names:
            net.p[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape)
            at += net.p[k].size

    odds = lambda p: np.floor(np.clip(np.log(np.maximum(p, 1e-15) / np.maximum(1 - p, 1e-15)), -30, 30) * STEPS).astype(np.int64)

    def judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            found = [encode(*r) for r in zip(*(rb.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(odds(net.probability(found)))], ["step"])

    held = every.filter(F.col("held") & (F.col("y") == 1)).select("before", "body", "after").mapInArrow(judged, "step long").groupBy("step").count().collect()
    rows, y = labelled_findings(lines // 2, seed + 1)
    step = np.concatenate([odds(net.probability([encode(*r) for r, hit in zip(rows, y) if hit])), [r["step"] for r in held]]).astype(np.int64)
    n = np.array([1] * int(y.sum()) + [r["count"] for r in held])
    order = np.argsort(step, kind="stable")
    k = int(np.searchsorted(np.cumsum(n[order]), int((1 - recall) * n.sum()), side="right"))
    net.judged, net.threshold = sum(r["count"] for r in held), float(1 / (1 + np.exp(-step[order][k] / STEPS)))
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns by start then kind; matches that fail their length are dropped, not retried."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def base_values(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start of its value, end of its value) of the base findings."""
    out = []
    for a, k, b in base_spans(text):
        out.append((a, b, ASSIGN.match(text, a, b).start(2) if k == 0 else a, b))
    return out


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, base) of what the network judges: the values of all base findings, and every run of token characters
    with a letter or digit that doesn't lie inside one base finding."""
    out = [(a, b, True) for _, _, a, b in base]
    j = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while j < len(base) and base[j][1] <= a:
            j += 1
        if any(x <= a and b <= y for x, y, _, _ in base[j : j + 4]) or not _ANY.search(m[0]):
            continue
        out.append((a, b, False))
    return out


_ANY = re.compile("[A-Za-z0-9]")


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(net: Network):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            base, ask, rows = [], [], []
            for i, text in enumerate(rb.column(1)):
                t = text.as_py() or ""
                base.append(base_spans(t))
                for a, b, known in candidates(t, base_values(t) if base[-1] else []):
                    ask.append((i, a, b, known))
                    rows.append(encode(*_row(t, a, b)))
            extra: dict[int, list] = {}
            like = [0] * len(base)
            for (i, a, b, known), p in zip(ask, net.probability(rows)):
                if p >= net.threshold:
                    if known:
                        like[i] += 1
                    else:
                        extra.setdefault(i, []).append((a, 3, b))
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in base], pa.int64())
            digest = [hashlib.sha256(_join(s).encode()).hexdigest() for s in base]
            every = [_join(sorted(s + extra[i]) if i in extra else s) for i, s in enumerate(base)]
            more = [pa.array([len(extra.get(i, ())) for i in range(len(base))], pa.int64()), pa.array(like, pa.int64())]
            yield pa.RecordBatch.from_arrays([rb.column(0), count(0), count(1), count(2), pa.array(digest), pa.array(every), *more], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_like"])

    return run


def secret_spans(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per row doc_id, counts by base kind, base_sha256, spans (kind:start:end by start then kind, code points), n_cnn, n_like.

    Base spans always stay. The network judges the value of every base finding (n_like counts those it agrees with) and every
    other run of 12 or more token characters, whole and with the context on both sides, and adds runs at or above its
    calibrated threshold as kind cnn. Without net, one is trained on all findings of docs labelled by rule and on
    generated lines, as `trained_on_all` says.

    Null and empty texts: no spans. Long texts and long runs are scanned whole. Rows are independent: repeated rows and null
    ids pass through, an empty table gives an empty one; only doc_id and text are read.
    """
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = net or trained_on_all(docs)
    return two.mapInArrow(_scan(net), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_like long")


def redacted(text: str | None, spans: str, mask: str = "[SECRET]") -> str:
    """text with its spans (as in secret_spans) replaced; overlapping spans become one mask."""
    text, out, at = text or "", [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]

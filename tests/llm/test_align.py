import hashlib
import random
from collections import Counter, defaultdict

import pytest

from meshloom.llm import align, queries


def paths():
    return (*queries.byte_vocabulary(), queries.tokenizer_path("piece_bpe_32k.model"))


def brute(rows):
    """Alignment by cumulative byte ends, from the libraries' own whole encodings."""
    import sentencepiece
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(paths()[0])
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths()[3])
    hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255)]
    byte = {chr(x): x for x in range(256) if x not in hidden} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def of_a(i):
        t = lib.id_to_token(i)
        return t.encode() if t == "<|endoftext|>" else bytes(byte[c] for c in t)

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    def ends(tokens):
        out, n = [], 0
        for t in tokens:
            n += len(t)
            out.append(n)
        return out

    groups = []
    for _, t in rows:
        groups.append(None)
        if not t:
            continue
        a, b, whole = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
        x, y = [of_a(i) for i in a], [of_b(i) for i in b]
        if b"".join(x) != whole or b"".join(y) != whole:
            continue
        ex, ey = ends(x), ends(y)
        g, i, j = [], 0, 0
        for e in sorted(set(ex) & set(ey)):
            i2, j2 = ex.index(e, i) + 1, ey.index(e, j) + 1
            g.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        groups[-1] = (len(a), len(b), g)
    links = [Counter((p, q) for ga, gb in x[2] for p in ga for q in gb) if x else Counter() for x in groups]
    count = Counter(k for n in links for k in n)
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = Counter()
    for (i, _), x, held in zip(rows, groups, links):
        if not x:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        best = sum(n for k, n in held.items() if count[k] == top[k[0]])
        out[i, x[0], x[1], len(x[2]), sum(held.values()), best, sum(n * count[k] for k, n in held.items()), hashlib.sha256(said.encode()).hexdigest()] += 1
    return out


def aligned(frame):
    return Counter(map(tuple, align.align_tokenizers(frame, *paths()).collect()))


def fuzz():
    r = random.Random(5)
    letters = "ab e\n\t  é日𝒳'd1.,▁\x00\x01\x1c\x85\xa0<|s>ſ😀́"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 30)))) for i in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, " "), (9004, "  "), (9005, "a "), (9006, " a"), (9007, "<|endoftext|> hi"), (None, "x y"), (9007, "<|endoftext|> hi")]
    return rows + [(9008, "a" * 5000), (9009, "日本語" * 800), (9010, "<s> </s> <unk> <0x41>"), (9011, "ab, ab. ab " * 3000), (9012, "x\n\ny \n z  w")]


def test_alignment_by_brute_force(spark, sf):
    rows = fuzz()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS side", "'q' AS pair", "0 AS n").repartition(3)
    want = brute(rows)
    assert aligned(frame) == want
    assert sum(1 for r in want if r[1]) > 500 and sum(1 for r in want if not r[1]) > 100
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op11_align_tokenizers(spark, sf)
    assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint") | {"groups_sha256": "string"}


def test_blocks_forgetting_and_empty_table(spark, monkeypatch):
    """The same rows in many small blocks, in a worker that keeps forgetting its units."""
    rows = fuzz()[:600] + fuzz()[-14:]
    al, want = align.Aligner(*paths()), brute(rows)
    monkeypatch.setattr(align, "UNITS", 200)
    got = []
    for lo in range(0, len(rows), 20):
        part = rows[lo : lo + 20]
        for rb in align._block(al, [i for i, _ in part], [t for _, t in part], lo):
            got += [(d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["groups_sha256"]) for d in rb.to_pylist() if d["side"]]
    assert Counter(got) == Counter((*w[:5], w[7]) for w in want.elements())
    assert aligned(spark.createDataFrame([], "doc_id long, text string")) == Counter()


@pytest.mark.parametrize("a, b, want", [("ab,c", "a,bc", ([2], [2])), ("a,b", "a,b", ([1, 2], [1, 2])), ("ab", "a", None), ("a", "b", None), ("a", "ab", None)])
def test_transducer(a, b, want):
    """Groups close where the residual is empty; different bytes have no alignment."""
    side = [x.encode() for x in ("a", "b", "c", "ab", "bc")]
    number = {x.decode(): i for i, x in enumerate(side)}
    assert align.Transducer(side, side).ends([number[x] for x in a.split(",")], [number[x] for x in b.split(",")]) == want

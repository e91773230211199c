import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from meshloom.llm import divergence, queries
from meshloom.llm.divergence import Trie, shares, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least=3, top=200):
    """Rows of (text, lang, source) -> the result, with Python's integers."""
    df, n, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = [lower(w) for w in TERM.findall(text)]
        langs[lang].add(source)
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, k in df[lang].items() if k >= least]

        def p(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        by, q = {s: p(n[lang, s]) for s in sources}, p(whole)
        for s in sources:
            found = {"pair": {o: sum((by[s][t] - by[o][t]) ** 2 // by[o][t] for t in kept) for o in sources - {s}}}
            found["term"] = {t: (by[s][t] - q[t]) ** 2 // q[t] for t in kept if n[lang, s][t] and by[s][t] > q[t]}
            for part, value in found.items():
                ranked = sorted(value, key=lambda x: (-value[x], x.encode()))
                out |= {(lang, s, part, x, value[x], i + 1) for i, x in enumerate(ranked) if part == "pair" or i < top}
    return out


def rows_of(frame, **more):
    got = [tuple(r) for r in source_divergence(frame, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, docs=150, sources=4):
    r = random.Random(seed)
    stems = ["the", "then", "theo", "thé", "日本", "日本語", "a", "ab", "zz", "ß", "𝒳y", "common" + "x" * 70, "common" + "x" * 70 + "y", "common" + "x" * 71]
    words = stems + [r.choice(stems) + r.choice("abcd") * r.randint(1, 3) for _ in range(60)]
    rows = []
    for i in range(docs):
        picked = [w.upper() if r.random() < 0.1 else w for w in r.choices(words, k=r.randint(0, 30))]
        rows.append((r.choice([" ", ", ", "1", "_", "\n"]).join(picked), r.choice(["en", "en", "en", "de", None, ""]), r.choice([None, *(f"s{j}" for j in range(sources))])))
    rows += [(None, "en", "s0"), (None, "none", "s1"), ("", "none", "s2"), ("one two", "none", None), ("1 2 3", "alone", "s1"), ("Same same", "en", "s9")]
    return rows + [("Same same", "en", "s9")] * 4 + [("hot hot cold", "en", "hot")] * (docs // 2)


def test_by_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).selectExpr("*", "1 AS n", "'x' AS part", "2 AS prefix", "3 AS term").repartition(4)
        assert rows_of(frame) == brute(rows)
        assert rows_of(frame, least=1, top=3) == brute(rows, 1, 3)
    assert rows_of(frame.filter("doc_id < 0")) == set()


def test_bounds_change_nothing(spark, monkeypatch):
    """Prefixes cut further down, many shards, many blocks of sources: the same rows."""
    for name, value in {"LEAVES": 3, "SHARD": 20, "BLOCK": 3, "BATCH": 7}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(3, docs=120, sources=11)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(3)
    assert rows_of(frame) == brute(rows)


def parts_of(rb):
    """Parts as {prefix: {tail: (documents, {source: occurrences})}}."""
    out = {}
    for i in range(rb.num_rows):
        p, at = divergence._Open(rb, i), 0
        leaves = out.setdefault((p.lang, p.prefix), {})
        for term, d, w in zip(p.terms, p.docs.tolist(), p.wide.tolist()):
            leaves[term] = (d, {p.names[k]: n for k, n in zip(p.who[at : at + w].tolist(), p.count[at : at + w].tolist())})
            at += w
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 80])
def test_trie_comes_apart_and_back(depth):
    r = random.Random(depth)
    terms = sorted({"".join(r.choice("ab日") for _ in range(r.randint(1, 9))).encode() for _ in range(80)} | {b"q" * 70, b"q" * 71, b"q" * 90})
    at = np.array([r.randrange(len(terms)) for _ in range(500)] + list(range(len(terms))))
    who, n, docs = np.array([r.randrange(5) for _ in at]), np.array([r.randint(1, 9) for _ in at]), np.array([r.randint(1, 3) for _ in at])
    shuffled = r.sample(range(len(terms)), len(terms))
    place = {t: i for i, t in enumerate(shuffled)}
    trie = Trie.of([terms[i] for i in shuffled], np.array([place[i] for i in at]), docs, who, n)
    assert trie.terms == terms
    want = {}
    for a, d, w, k in zip(at.tolist(), docs.tolist(), who.tolist(), n.tolist()):
        t = terms[a]
        have = want.setdefault(("x", t[:depth]), {}).setdefault(t[depth:], [0, Counter()])
        have[0] += d
        have[1][f"s{w}"] += k
    want = {p: {t: (d, dict(c)) for t, (d, c) in leaves.items()} for p, leaves in want.items()}
    rb = trie.parts("x", b"", depth, [f"s{i}" for i in range(5)])
    assert parts_of(rb) == want
    both, names = divergence._joined([divergence._Open(rb, 0), divergence._Open(rb, 0)])
    assert both.docs.tolist() == [2 * d for d, _ in dict(sorted(want["x", terms[0][:depth]].items())).values()] and set(names) <= {f"s{i}" for i in range(5)}


def test_shares_are_exact():
    r = random.Random(1)
    for total in (1, 7, 10**9, 10**12 + 7, 9 * 10**15):
        count = np.array([r.randrange(total) for _ in range(50)] + [0, total - 1])
        assert shares(count, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(queries.oracle_sql()["op13_source_divergence"])
    names = [d[0] for d in cur.description]
    got = queries.op13_source_divergence(spark, sf)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(cur.fetchall())

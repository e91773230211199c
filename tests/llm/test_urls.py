import random
import re
from collections import Counter

import duckdb

from meshloom.llm import queries
from meshloom.llm.urls import RULES, url_verdicts


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def taken_apart(url):
    """scheme, host, path, query with ?; None without ://."""
    if url is None or "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    query = re.match(r"[^#]*", rest[len(host) + len(path) :]).group()
    return scheme, lower(host), path, query


def rule_for(host, path, rules=RULES):
    fits = [(len(h + p), h + p, what) for what, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def node(url):
    scheme, host, path, query = taken_apart(url)
    return f"{lower(scheme)}://{host}{path if path.startswith('/') else '/' + path}{query}"


def brute(rows, edges):
    """(page_id, host, path, rule, verdict): rules first, then breadth-first search over edges from blocked urls."""
    near = {}
    for a, b in edges:
        near.setdefault(node(a), set()).add(node(b))
        near.setdefault(node(b), set()).add(node(a))
    hit = {n for n in near if rule_for(*taken_apart(n)[1:3])[1] == "block"}
    todo = list(hit)
    while todo:
        for n in near[todo.pop()] - hit:
            hit.add(n)
            todo.append(n)
    out = Counter()
    for i, url in rows:
        part = taken_apart(url)
        host, path = part[1:3] if part else ("", "")
        rule, verdict = rule_for(host, path)
        out[i, host, path, rule, verdict or ("block" if part and node(url) in hit else "allow")] += 1
    return out


def verdicts(frame, **more):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_verdicts(frame, **more).collect())


ODD = [
    None, "", "no scheme", "http://", "HTTP://A.Example.COM/EN/x", "http://example.com", "http://example.com?x=/en/", "http://example.com/en/1#a?b", "https://WWW.example.com/en/", "https://www.example.com/en",
    "http://notexample.com/en/", "http://xcom/", "com://com/", "http://a.net/es/", "http://net/fr/x?y", "http://a.net/ES/", "http://ünet/fr/", "x://y://z.net/es/", "http://a.org//es/", "http://a.com:80/", "http://a.net/fr/\nb",
]


def test_rules_on_odd_urls(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[13]), (7, "http://q.net/es/" + "y" * 100_000)]
    frame = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS root", "3 AS rule", "4 AS node").repartition(3)
    assert verdicts(frame) == brute(rows, [])
    assert verdicts(frame.filter("page_id < -1")) == Counter()
    longer = [("block", "org", "/a/b/c"), ("allow", "x.org", "/a"), ("block", "x.org", "/a/b")]
    got = url_verdicts(spark.createDataFrame([(1, "http://x.org/a/b/c", None), (2, "http://x.org/a/", None), (3, "http://y.org/", None)], "page_id long, url string, html string"), longer, default="block").collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("x.org/a/b", "block"), 2: ("x.org/a", "allow"), 3: (None, "block")}


def page_with(links):
    return '<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title>' + links + "</head><body>" + "text refresh canonical " * 20 + "</body></html>"


def test_links_of_pages(spark):
    """Each way to write a link, and each thing that is none."""
    block = "http://b.net/es/"
    cases = [
        (f'<link rel="canonical" href="{block}1">', True), (f"<LINK HREF='{block}1' REL='CANONICAL'/>", True), (f"<link rel=canonical href={block}1>", True), (f'<link rel="alternate canonical" href="{block}1">', True),
        (f'<meta http-equiv="refresh" content="0; url={block}1">', True), (f"<META content='5;URL={block}1' HTTP-EQUIV=Refresh>", True), (f"""<meta http-equiv="refresh" content="0;url='{block}1'">""", True),
        ('<link rel="canonical" href="//b.net/es/1">', True), (f'<!-- <link rel="canonical" href="{block}1"> -->', False), (f'<script>var x = \'<link rel="canonical" href="{block}1">\'</script>', False),
        (f'<link rel="alternate" href="{block}1">', False), (f'<link rel="noncanonical" href="{block}1">', False), ('<link rel="canonical">', False), ('<link rel="canonical" href="">', False), ('<link rel="canonical" href="#top">', False),
        ('<link rel="canonical" href="mailto:a@b.net">', False), ('<meta http-equiv="refresh" content="30">', False), (f'<meta name="refresh" content="0; url={block}1">', False), ("", False), (f'<a href="{block}1">x</a>', False),
        (f'<link rel="canonical" href="{block}1#part">', True), ('<link rel="canonical" href="http://B.NET/es/1">', True), (f'<link rel="canonical" href="{block}1?a=1&amp;b=2">', True),
    ]
    rows = [(i, f"http://site{i}.org/x", page_with(links)) for i, (links, _) in enumerate(cases)] + [(99, "http://b.net/fr/x", page_with('<link rel="canonical" href="http://q.org/">')), (98, "http://q.org", None), (97, "http://b.com/x", page_with(f'<link rel="canonical" href="{block}1">'))]
    got = {r.page_id: (r.verdict, r.rule, r.alias_block) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i][0] == "block" for i in range(len(cases))} == {i: blocked for i, (_, blocked) in enumerate(cases)}
    assert got[98] == ("block", None, True) and got[97] == ("allow", "com/", False) and got[99] == ("block", "net/fr/", False)
    relative = {"/a/b": "http://s.org/a/b", "c": "http://s.org/d/c", "?q=1": "http://s.org/d/e?q=1", "./../x": "http://s.org/d/./../x"}
    from meshloom.llm.urls import declared_links

    frame = spark.createDataFrame([(0, "http://s.org/d/e?z#f", page_with("".join(f'<link rel="canonical" href="{r}">' for r in relative)))], "page_id long, url string, html string")
    assert {r.target for r in declared_links(frame).collect()} == set(relative.values())


def network(seed, n=300):
    """Pages in chains, rings and a star whose hub a third of all pages name; some redirects besides."""
    r = random.Random(seed)
    hosts = ["a.org", "b.org", "www.example.com", "x.example.com", "c.net", "net", "d.info"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'x'])}/{i}" for i in range(n)] + ["http://hub.org/"]
    edges = [(u, "http://hub.org/") for u in urls[: n // 3]] + [(urls[i], urls[i + 1]) for i in range(n // 3, n // 2) if i % 9] + [(u, r.choice(urls[n // 3 :])) for u in urls[n // 2 : n // 2 + 40]]
    return urls, edges


def test_components_by_brute_force_and_sql(spark):
    for seed in (1, 2):
        urls, edges = network(seed)
        by = {}
        for a, b in edges:
            by.setdefault(a, []).append(b)
        rows = [(i, u, page_with("".join(f'<link rel="canonical" href="{b}">' for b in by.get(u, [])))) for i, u in enumerate(urls)] * (1 + seed % 2)
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        want = brute([r[:2] for r in rows], edges)
        assert verdicts(frame) == want
        con = duckdb.connect()
        own = frame.toPandas()  # noqa: F841
        con.execute("CREATE VIEW pages AS SELECT * FROM own")
        cur = con.execute(queries.oracle_sql()["op12_url_verdicts"])
        names = [d[0] for d in cur.description]
        assert Counter(tuple(dict(zip(names, r))[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in cur.fetchall()) == want
        plain = spark.createDataFrame([(i, u, None) for i, u, _ in rows], "page_id long, url string, html string")
        table = spark.createDataFrame(edges, "from_url string, to_url string")
        assert verdicts(plain, redirects=table) == want


def test_long_lists_of_aliases(spark, monkeypatch):
    """Beyond the size that is broadcast, the salted join gives the same verdicts."""
    urls, edges = network(3)
    plain = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    redirects = spark.createDataFrame(edges, "from_url string, to_url string")
    monkeypatch.setattr("meshloom.llm.urls.HUBS", 0)
    assert verdicts(plain, redirects=redirects) == brute(list(enumerate(urls)), edges)


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    cur = con.execute(queries.oracle_sql()["op12_url_verdicts"])
    names = [d[0] for d in cur.description]
    got = queries.op12_url_verdicts(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(cur.fetchall())

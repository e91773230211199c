"""Registered queries of the geometric-graph engine and their DuckDB counterparts, by inventory id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.functions import geometry as G
from meshloom.functions import words as W
from meshloom.operators import category, exemplar, forest, grammar, graph, spatial, vector, words
from meshloom.operators.lineage import settle, small
from meshloom.plans import projections as P

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL where SQL can say it."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from meshloom.plans import details, generative, geometry, meshes  # noqa: F401  they register theirs on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# Common tables of the SQL side.
PARTS = "f AS (SELECT l_orderkey AS cell, l_partkey AS oid FROM lineitem), t AS (SELECT p_partkey AS oid, p_type AS type FROM part)"
SUPPLIERS = "f AS (SELECT l_orderkey AS cell, l_suppkey AS oid FROM lineitem), t AS (SELECT s_suppkey AS oid, 'n' || s_nationkey AS type, s_nationkey AS scene FROM supplier)"
EDGES = "m AS (SELECT DISTINCT cell, oid FROM f), e AS (SELECT DISTINCT a.oid AS src, b.oid AS dst FROM m a JOIN m b ON a.cell = b.cell AND a.oid <> b.oid)"
TYPED = "te AS (SELECT e.src, e.dst, s.type AS src_type, d.type AS dst_type FROM e JOIN t s ON s.oid = e.src JOIN t d ON d.oid = e.dst)"
POINTS = "pt AS (SELECT l_suppkey AS oid, l_quantity AS x, l_discount * 500 AS y, l_tax * 500 AS z, l_orderkey FROM lineitem)"
STATS = "s0 AS (SELECT oid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z, count(*) AS n FROM pt GROUP BY oid), st AS (SELECT *, sqrt((hi_x - lo_x) * (hi_x - lo_x) + (hi_y - lo_y) * (hi_y - lo_y) + (hi_z - lo_z) * (hi_z - lo_z)) AS size FROM s0)"
PROFILE = "by_type AS (SELECT src AS node, src_type AS type, dst_type, count(*) AS n FROM te GROUP BY ALL), pr AS (SELECT node, type, CAST(sum(n) AS BIGINT) AS degree, string_agg(dst_type || '=' || n, ';' ORDER BY dst_type || '=' || n) AS signature FROM by_type GROUP BY node, type)"
LINES = f"ln AS (SELECT l_orderkey AS scene, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(P.LINE_ORDER)}) AS rank, l_returnflag AS ch, l_returnflag || l_linestatus || l_linenumber AS type, l_quantity AS x, l_discount * 500 AS y, l_tax * 500 AS z FROM lineitem)"
WORDS = LINES + ", lc AS (SELECT *, count(*) OVER (PARTITION BY scene) AS k FROM ln), w AS (SELECT scene, 'O' || string_agg(CASE WHEN rank < k THEN '(' || ch || ')' ELSE ch END, '' ORDER BY rank) AS word FROM lc GROUP BY scene)"
EVENTS = "ew AS (SELECT user_id AS scene, string_agg(upper(substr(event_type, 1, 1)), '' ORDER BY ts, event_id) AS word FROM events GROUP BY user_id)"
VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
KNN = VECTORS + ", d AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM d)"
ROUND = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
E_CHARS = "CEPSV"


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


# ---- cells, collisions, nodes


@query(f"WITH {PARTS}, {EDGES}, {TYPED} SELECT src, dst, src_type, dst_type FROM te")
def collision_graph(spark, sf):
    """PR1, JN6, JN9: parts that share an order."""
    return P.part_graph(spark, sf)


@query(f"WITH {PARTS} SELECT cell, count(*) AS n_prims, count(DISTINCT oid) AS n_objects FROM f GROUP BY cell HAVING count(DISTINCT oid) > 1")
def cell_pruning(spark, sf):
    """JN2, JN5, PR14."""
    return spatial.prune_cells(P.part_fragments(spark, sf))


@query(f"SELECT l_suppkey AS oid, arg_min(l_returnflag, ROW(l_orderkey, {', '.join(P.LINE_ORDER)})) AS type FROM lineitem GROUP BY l_suppkey")
def face_to_object_type(spark, sf):
    """PR1, PR2."""
    return spatial.node_types(P.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s").select(F.col("s").alias("oid"), F.col("l_returnflag").alias("type"), "l_orderkey", *[F.col("s" if c == "l_suppkey" else c).alias(c) for c in P.LINE_ORDER]), ["l_orderkey", *P.LINE_ORDER])


@query(f"WITH {SUPPLIERS}, {EDGES} SELECT s_suppkey AS node, count(e.dst) AS degree FROM supplier LEFT JOIN e ON e.src = s_suppkey GROUP BY 1")
def node_degree(spark, sf):
    """GR3, GR4, GR12."""
    return graph.degrees(P.supplier_nodes(spark, sf), P.supplier_edges(spark, sf))


@query(f'WITH {SUPPLIERS}, {EDGES}, g AS (SELECT s_suppkey AS node, count(e.dst) AS degree FROM supplier LEFT JOIN e ON e.src = s_suppkey GROUP BY 1) SELECT node, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS "begin", CAST(sum(degree) OVER (ORDER BY node) AS BIGINT) AS "end" FROM g')
def adjacency_csr(spark, sf):
    """GR1, GR3."""
    return graph.csr(P.supplier_nodes(spark, sf), P.supplier_edges(spark, sf))


@query("WITH t AS (SELECT p_partkey AS oid, p_type AS type FROM part), f AS (SELECT l_orderkey AS cell, l_partkey AS oid FROM lineitem)," + f"{EDGES}, {TYPED}, y AS (SELECT type, row_number() OVER (ORDER BY type) AS i FROM (SELECT DISTINCT type FROM t)) SELECT DISTINCT a.i AS src, b.i AS dst FROM te JOIN y a ON a.type = src_type JOIN y b ON b.type = dst_type")
def adjacency_matrix_roundtrip(spark, sf):
    """GR1, GR2: the type graph as a matrix and back."""
    types = P.part_types(spark, sf).select("type").distinct().withColumn("i", F.row_number().over(Window.orderBy("type")).cast("long"))
    e = P.part_graph(spark, sf).select("src_type", "dst_type").distinct()
    e = e.join(types.select(F.col("type").alias("src_type"), F.col("i").alias("src")), "src_type").join(types.select(F.col("type").alias("dst_type"), F.col("i").alias("dst")), "dst_type").select("src", "dst")
    ids = list(range(1, types.count() + 1))
    out = graph.from_matrix(graph.to_matrix(e, ids), ids)
    return out.select("src", F.col("dst").cast("long").alias("dst"))


@query(f"WITH {SUPPLIERS}, {EDGES}, n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS edge_id FROM e) SELECT n.edge_id, n.src, n.dst, r.edge_id AS reverse_id FROM n LEFT JOIN n r ON r.src = n.dst AND r.dst = n.src")
def reverse_edge_lookup(spark, sf):
    """JN10, JN17."""
    return graph.with_reverse(P.supplier_edges(spark, sf))


# ---- graph grammar


@query(f"WITH {PARTS}, {EDGES}, {TYPED}, {PROFILE} SELECT DISTINCT type, degree FROM pr")
def grammar_degrees(spark, sf):
    """GC1."""
    return grammar.induce(P.part_graph(spark, sf))["degree"]


@query(f"WITH {PARTS}, {EDGES}, {TYPED} SELECT DISTINCT src_type AS type, dst_type AS nbr_type FROM te")
def grammar_pairs(spark, sf):
    """GC1, ST2."""
    return grammar.induce(P.part_graph(spark, sf))["pair"]


@query(f"WITH {PARTS}, {EDGES}, {TYPED}, {PROFILE} SELECT DISTINCT type, signature FROM pr")
def grammar_signatures(spark, sf):
    """GC1."""
    return grammar.induce(P.part_graph(spark, sf))["signature"]


def _parity(spark, sf, odd):
    f = P.part_fragments(spark, sf).filter(F.col("cell") % 2 == odd)
    return spatial.collision_graph(f, P.part_types(spark, sf))


def _halves(body):
    side = lambda n, p: f"m{n} AS (SELECT DISTINCT cell, oid FROM f WHERE cell % 2 = {p}), e{n} AS (SELECT DISTINCT a.oid AS src, b.oid AS dst FROM m{n} a JOIN m{n} b ON a.cell = b.cell AND a.oid <> b.oid), {TYPED.replace('te AS', f'te{n} AS').replace('FROM e ', f'FROM e{n} e ')}, {PROFILE.replace('by_type', f'by_type{n}').replace('pr AS', f'pr{n} AS').replace('FROM te', f'FROM te{n}')}"
    return f"WITH {PARTS}, {side(0, 0)}, {side(1, 1)} {body}"


_PAIRS_OK = "bool_and(EXISTS (SELECT 1 FROM te0 WHERE te0.src_type = te1.src_type AND te0.dst_type = te1.dst_type))"


@query(_halves(f"SELECT pr1.node, pr1.type, EXISTS (SELECT 1 FROM pr0 WHERE pr0.type = pr1.type AND pr0.degree = pr1.degree) AS degree_ok, p.ok AS pairs_ok, EXISTS (SELECT 1 FROM pr0 WHERE pr0.type = pr1.type AND pr0.signature = pr1.signature) AS signature_ok FROM pr1 JOIN (SELECT src AS node, {_PAIRS_OK} AS ok FROM te1 GROUP BY src) p USING (node)"))
def grammar_check(spark, sf):
    """GC3: orders of even number are the examples, odd ones are checked."""
    return grammar.check(_parity(spark, sf, 1), grammar.induce(_parity(spark, sf, 0)))


@query(_halves(f"SELECT pr1.node, pr1.type, coalesce(pr1.degree <= x.most, false) AS degree_ok, p.ok AS pairs_ok FROM pr1 LEFT JOIN (SELECT type, max(degree) AS most FROM pr0 GROUP BY type) x USING (type) JOIN (SELECT src AS node, {_PAIRS_OK} AS ok FROM te1 GROUP BY src) p USING (node)"))
def grammar_subcheck(spark, sf):
    """GC4."""
    return grammar.check_sub(_parity(spark, sf, 1), grammar.induce(_parity(spark, sf, 0)))


def _support(spark, sf):
    b = spatial.scene_bounds(P.points(spark, sf)).first()
    nodes = P.supplier_stats(spark, sf)
    return grammar.supported(nodes, P.supplier_edges(spark, sf), F.lit(b.lo_z), F.lit(b.hi_z))


_SUPPORT = f"{SUPPLIERS}, {EDGES}, {POINTS}, {STATS}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM pt), ok AS (SELECT st.oid, t.type, (st.cz < (SELECT lo + (hi - lo) * 0.01 FROM b)) OR coalesce(bool_or(st.cz - d.cz > st.size * 0.25), false) AS ok FROM st JOIN t ON t.oid = st.oid LEFT JOIN e ON e.src = st.oid LEFT JOIN st d ON d.oid = e.dst GROUP BY st.oid, t.type, st.cz)"


@query(f"WITH {_SUPPORT} SELECT type, bool_and(ok) AS needs_support FROM ok GROUP BY type")
def support_rule(spark, sf):
    """PR17, GC2."""
    return grammar.induce_support(_support(spark, sf))


@query(f"WITH {_SUPPORT}, r AS (SELECT type, bool_and(ok) AS needs FROM ok GROUP BY type) SELECT ok.oid, ok.ok OR NOT r.needs AS passes FROM ok JOIN r USING (type)")
def support_check(spark, sf):
    """GC5: objects of types that need support have it."""
    s = _support(spark, sf)
    return s.join(grammar.induce_support(s), "type").select("oid", (F.col("ok") | ~F.col("needs_support")).alias("passes"))


def _config(spark, sf, odd=None):
    ln = P.lines(spark, sf)
    ln = ln if odd is None else ln.filter(F.col("scene") % 2 == odd)
    own = ln.select("scene", "rank", "type", "x", "y", "z")
    left, right = (own.select("scene", *[F.col(c).alias(p + c) for c in ("rank", "type", "x", "y", "z")]) for p in ("l_", "r_"))
    size = ln.groupBy("scene").agg(*[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"]).select("scene", G.length([F.col(f"d{c}") for c in "xyz"]).alias("size"))
    d = G.length(G.sub(tuple(F.col(f"l_{c}") for c in "xyz"), tuple(F.col(f"r_{c}") for c in "xyz")))
    p = left.join(right, "scene").filter("l_rank < r_rank").select(F.col("scene").alias("node"), F.lit("O").alias("type"), F.col("l_rank").alias("l_dst"), F.col("r_rank").alias("r_dst"), F.least("l_type", "r_type").alias("b0"), F.greatest("l_type", "r_type").alias("b1"), d.alias("dist"))
    return p.join(size.withColumnRenamed("scene", "node"), "node")


_CONFIG = f"{LINES}, sz AS (SELECT scene, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))) AS size FROM ln GROUP BY scene), cf AS (SELECT a.scene AS node, 'O' AS type, a.rank AS l_dst, b.rank AS r_dst, least(a.type, b.type) AS b0, greatest(a.type, b.type) AS b1, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist, size FROM ln a JOIN ln b ON a.scene = b.scene AND a.rank < b.rank JOIN sz ON sz.scene = a.scene)"


@query(f"WITH {_CONFIG} SELECT node, type, l_dst, r_dst, b0, b1, {ROUND('dist', 'size')} FROM cf")
def neighbor_config(spark, sf):
    """GC7: orders as nodes, their line items as typed neighbours."""
    return rounded(_config(spark, sf), "dist", "size")


@query(f"WITH {_CONFIG}, t AS (SELECT * FROM cf WHERE node % 2 = 1), x AS (SELECT node AS x, b0, b1, dist AS xd FROM cf WHERE node % 2 = 0), h AS (SELECT node, x, count(DISTINCT l_dst * 1000 + r_dst) AS n FROM t JOIN x USING (b0, b1) WHERE abs(dist - xd) < size * 0.02 GROUP BY node, x), g AS (SELECT node, max(n) AS n FROM h GROUP BY node), c AS (SELECT node, count(*) AS need FROM t GROUP BY node) SELECT node, coalesce(n = need, false) AS ok FROM c LEFT JOIN g USING (node)")
def neighbor_config_subset(spark, sf):
    """GC8."""
    return grammar.config_subset(_config(spark, sf, 1), _config(spark, sf, 0))


_HIST = f"{LINES}, n AS (SELECT scene, ch, count(*) AS n FROM ln GROUP BY scene, ch), h AS (SELECT scene, string_agg(ch || '=' || n, ';' ORDER BY ch || '=' || n) AS hist FROM n GROUP BY scene)"


def _order_types(spark, sf):
    return P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_returnflag").alias("type"))


@query(f"WITH {_HIST} SELECT scene, hist FROM h")
def type_histogram(spark, sf):
    """AG1, D17."""
    return grammar.histogram_key(_order_types(spark, sf))


@query(f"WITH {_HIST} SELECT hist, min(scene) AS first, count(*) AS n FROM h GROUP BY hist")
def histogram_dedupe(spark, sf):
    """AG3."""
    return grammar.dedupe_histograms(grammar.histogram_key(_order_types(spark, sf)))


@query("WITH p AS (SELECT DISTINCT l_orderkey AS scene, l_returnflag AS type FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS scene, l_returnflag AS type FROM lineitem WHERE l_linestatus = 'O') SELECT scene, type FROM p EXCEPT SELECT scene, type FROM c")
def histogram_missing_type(spark, sf):
    """AG2: the open lines of an order as a variation of all its lines."""
    lines = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_returnflag").alias("type"), "l_linestatus")
    return grammar.missing_types(lines, lines.filter("l_linestatus = 'O'"))


# ---- edges by category


def _categorised(spark, sf, odd):
    """Part graph of a half of the orders: category from the type pair, reverse from the swapped pair."""
    return _parity(spark, sf, odd).select("src", "dst", F.concat_ws(">", "src_type", "dst_type").alias("category"), F.concat_ws(">", "dst_type", "src_type").alias("reverse"))


@query(_halves("SELECT category, reverse, EXISTS (SELECT 1 FROM te0 WHERE src_type || '>' || dst_type = category) AS found FROM (SELECT DISTINCT src_type || '>' || dst_type AS category, dst_type || '>' || src_type AS reverse FROM te1)"))
def category_pair_exists(spark, sf):
    """JN11."""
    t, x = _categorised(spark, sf, 1), _categorised(spark, sf, 0)
    gone = category.missing_category_pairs(t, x).withColumn("found", F.lit(False))
    return t.select("category", "reverse").distinct().join(gone, ["category", "reverse"], "left").select("category", "reverse", F.coalesce("found", F.lit(True)).alias("found"))


@query(_halves("SELECT x.category, c.src, c.dst FROM (SELECT DISTINCT src_type || '>' || dst_type AS category FROM te1) x LEFT JOIN (SELECT src_type || '>' || dst_type AS category, src, dst, row_number() OVER (PARTITION BY src_type || '>' || dst_type ORDER BY md5(src || ':' || dst), src, dst) AS r FROM te0) c ON c.category = x.category AND c.r = 1"))
def edge_by_category(spark, sf):
    """JN12, JN13: for each category of the target a hashed pick of the examples' edges."""
    x = _categorised(spark, sf, 0)
    pick = x.groupBy("category").agg(F.min(F.struct(F.md5(F.concat_ws(":", "src", "dst")).alias("h"), "src", "dst")).alias("m")).select("category", "m.src", "m.dst")
    return _categorised(spark, sf, 1).select("category").distinct().join(pick, "category", "left")


# ---- geometry


@query(f"WITH {POINTS}, {STATS} SELECT oid, {ROUND('cx', 'cy', 'cz')}, n FROM st")
def object_centers(spark, sf):
    """PR3, PR6."""
    return rounded(spatial.object_stats(P.points(spark, sf)), "cx", "cy", "cz").select("oid", "cx", "cy", "cz", "n")


@query(f"WITH {POINTS}, {STATS} SELECT oid, {ROUND('size')} FROM st")
def object_sizes(spark, sf):
    """PR4, MA17, MA18."""
    return rounded(spatial.object_stats(P.points(spark, sf)), "size").select("oid", "size")


@query(f"WITH {POINTS} SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM pt")
def scene_bounds(spark, sf):
    """PR5, AG11."""
    return spatial.scene_bounds(P.points(spark, sf))


_GRID = f"{POINTS}, {STATS}, b AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM pt), u AS (SELECT *, pow(8.0::DOUBLE * 500 / (greatest(hi_x - lo_x, 1e-6::DOUBLE) * greatest(hi_y - lo_y, 1e-6::DOUBLE) * greatest(hi_z - lo_z, 1e-6::DOUBLE)), 1.0::DOUBLE / 3.0::DOUBLE) AS unit FROM b), g AS (SELECT *, CAST(greatest(floor((hi_x - lo_x) * unit), 1) AS BIGINT) AS rx, CAST(greatest(floor((hi_y - lo_y) * unit), 1) AS BIGINT) AS ry, CAST(greatest(floor((hi_z - lo_z) * unit), 1) AS BIGINT) AS rz FROM u)"


def _grid(spark, sf):
    return spatial.grid_resolution(spatial.scene_bounds(P.points(spark, sf)), 500)


@query(f"WITH {_GRID} SELECT rx, ry, rz FROM g")
def grid_resolution(spark, sf):
    """JN3."""
    return _grid(spark, sf).select("rx", "ry", "rz")


def _order_boxes(spark, sf):
    """Orders as objects with the boxes of their points."""
    p = P.points(spark, sf).groupBy(F.col("l_orderkey").alias("oid"))
    return p.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


_CELL = lambda e, a: f"least(greatest(CAST(floor((bx.{e}_{a} - g.lo_{a}) / greatest(g.hi_{a} - g.lo_{a}, 1e-6::DOUBLE) * r{a}) AS BIGINT), 0), r{a} - 1)"
_FRAGMENTS = f"{_GRID}, bx AS (SELECT l_orderkey AS oid, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM pt GROUP BY l_orderkey), fr AS (SELECT oid, ix + iy * rx + iz * rx * ry AS cell FROM (SELECT oid, rx, ry, unnest(range({_CELL('lo', 'x')}, {_CELL('hi', 'x')} + 1)) AS ix, {_CELL('lo', 'y')} AS y0, {_CELL('hi', 'y')} AS y1, {_CELL('lo', 'z')} AS z0, {_CELL('hi', 'z')} AS z1 FROM bx, g) q, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS iy) r, LATERAL (SELECT unnest(range(z0, z1 + 1)) AS iz) s)"


@query(f"WITH {_FRAGMENTS} SELECT cell, count(*) AS n FROM fr GROUP BY cell")
def grid_fragments(spark, sf):
    """JN1, JN2, MA21: boxes of orders dealt to grid cells."""
    return spatial.fragments(_order_boxes(spark, sf), _grid(spark, sf)).groupBy("cell").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, g AS (SELECT oid, CAST(floor(x / 5) AS BIGINT) + 100 * CAST(floor(y / 5) AS BIGINT) + 10000 * CAST(floor(z / 4) AS BIGINT) AS cell FROM pt), m AS (SELECT DISTINCT cell, oid FROM g) SELECT a.oid AS a, b.oid AS b, count(*) AS shared FROM m a JOIN m b ON a.cell = b.cell AND a.oid < b.oid GROUP BY 1, 2")
def grid_pairs(spark, sf):
    """JN6, JN8: pairs of suppliers by the grid cells they share."""
    p = P.points(spark, sf)
    cell = F.floor(F.col("x") / 5) + 100 * F.floor(F.col("y") / 5) + 10000 * F.floor(F.col("z") / 4)
    return spatial.shared_cells(p.select("oid", cell.alias("cell")).distinct())


@query(f"WITH {SUPPLIERS}, {POINTS}, {STATS} SELECT x.scene, x.oid AS a, y.oid AS b, round(sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) + (p.cz - q.cz) * (p.cz - q.cz)), 6) AS d FROM t x JOIN t y ON x.scene = y.scene AND x.oid <> y.oid JOIN st p ON p.oid = x.oid JOIN st q ON q.oid = y.oid")
def distance_matrix(spark, sf):
    """JN16: within nations."""
    return rounded(spatial.pairwise_distance(P.supplier_stats(spark, sf)), "d")


_HALF = lambda n, p: f"p{n} AS (SELECT l_suppkey AS oid, l_quantity AS x, l_discount * 500 AS y, l_tax * 500 AS z FROM lineitem WHERE l_orderkey % 2 = {p}), " + STATS.replace("s0 AS", f"z{n} AS").replace("FROM pt", f"FROM p{n}").replace("st AS", f"st{n} AS").replace("FROM s0", f"FROM z{n}") + f", h{n} AS (SELECT st{n}.*, 'n' || s_nationkey AS type FROM st{n} JOIN supplier ON s_suppkey = oid)"
_ANTI = "kp AS (SELECT b.* FROM h1 b WHERE NOT EXISTS (SELECT 1 FROM h0 a WHERE a.type = b.type AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) < b.size * 0.03125))"


def _half_stats(spark, sf, odd):
    t = P.supplier_types(spark, sf)
    return spatial.object_stats(P.points(spark, sf).filter(F.col("l_orderkey") % 2 == odd)).join(t, "oid")


@query(f"WITH {_HALF(0, 0)}, {_HALF(1, 1)}, {_ANTI} SELECT oid, type FROM kp")
def overlap_anti_join(spark, sf):
    """JN4."""
    return spatial.overlap_anti_join(_half_stats(spark, sf, 1), _half_stats(spark, sf, 0)).select("oid", "type")


@query(f"WITH {_HALF(0, 0)}, {_HALF(1, 1)}, {_ANTI}, u AS (SELECT 0 AS part, oid FROM h0 UNION ALL SELECT 1, oid FROM kp) SELECT part, oid, row_number() OVER (ORDER BY part, oid) - 1 AS new_id FROM u")
def merge_scenes(spark, sf):
    """PR10, PR11 (ids), ST1."""
    return spatial.merge_scenes(_half_stats(spark, sf, 0), _half_stats(spark, sf, 1)).select("part", "oid", "new_id")


@query(f"WITH {POINTS} SELECT oid, round(avg(CASE WHEN oid % 3 = 0 THEN x + 1.5 ELSE x END), 6) AS cx, round(avg(CASE WHEN oid % 3 = 0 THEN y - 2 ELSE y END), 6) AS cy, round(avg(CASE WHEN oid % 3 = 0 THEN z + 0.25 ELSE z END), 6) AS cz FROM pt GROUP BY oid")
def translate_object(spark, sf):
    """PR13, MA1: a third of the objects moved."""
    moved = spatial.translate_objects(P.points(spark, sf), F.col("oid") % 3 == 0, (1.5, -2.0, 0.25))
    return moved.groupBy("oid").agg(*[F.round(F.avg(a), 6).alias(f"c{a}") for a in "xyz"])


@query(f"WITH {POINTS}, {STATS}, r AS (SELECT oid, cx, cy, cz, radians(oid * 7.0) / 2 AS h FROM st) SELECT oid, round(cx * (cos(h) * cos(h) - sin(h) * sin(h)) - cy * 2 * sin(h) * cos(h), 6) AS x, round(cx * 2 * sin(h) * cos(h) + cy * (cos(h) * cos(h) - sin(h) * sin(h)), 6) AS y, round(cz, 6) AS z FROM r")
def quaternion_rotate(spark, sf):
    """MA13, MA14: centres turned about the z axis."""
    s = spatial.object_stats(P.points(spark, sf))
    h = F.radians(F.col("oid") * 7.0) / 2
    v = G.rotate((F.lit(0.0), F.lit(0.0), F.sin(h), F.cos(h)), (F.col("cx"), F.col("cy"), F.col("cz")))
    return s.select("oid", *[F.round(x, 6).alias(a) for a, x in zip("xyz", v)])


def _turn(df, angle):
    """A unit quaternion about z for each row."""
    return (F.lit(0.0), F.lit(0.0), F.sin(angle / 2), F.cos(angle / 2))


def _poses(spark, sf):
    """src, dst, types, relative translation in src's frame and relative turn of supplier edges; frames turn with the id."""
    n = small(P.supplier_stats(spark, sf).select("oid", "type", "cx", "cy", "cz", "size"))
    a, b = spatial.prefixed(n, "a_"), spatial.prefixed(n, "b_")
    e = P.supplier_edges(spark, sf).join(a, F.col("src") == F.col("a_oid")).join(b, F.col("dst") == F.col("b_oid"))
    qa, qb = _turn(e, F.radians(F.col("src") * 7.0)), _turn(e, F.radians(F.col("dst") * 7.0))
    t = G.rotate(G.conjugate(qa), G.sub(tuple(F.col(f"b_c{x}") for x in "xyz"), tuple(F.col(f"a_c{x}") for x in "xyz")))
    r = G.product(G.conjugate(qb), qa)
    return e.select("src", "dst", F.col("a_type").alias("src_type"), F.col("b_type").alias("dst_type"), *[x.alias(c) for c, x in zip("xyz", t)], r[2].alias("rz"), r[3].alias("rw"), F.col("b_size").alias("size"))


_POSES = f"{SUPPLIERS}, {EDGES}, {POINTS}, {STATS}, ps AS (SELECT src, dst, ta.type AS src_type, tb.type AS dst_type, b.cx - a.cx AS dx, b.cy - a.cy AS dy, b.cz - a.cz AS z, radians(src * 7.0) AS ra, radians((src - dst) * 7.0) / 2 AS rr, b.size AS size FROM e JOIN st a ON a.oid = src JOIN st b ON b.oid = dst JOIN t ta ON ta.oid = src JOIN t tb ON tb.oid = dst), po AS (SELECT src, dst, src_type, dst_type, dx * cos(ra) + dy * sin(ra) AS x, dy * cos(ra) - dx * sin(ra) AS y, z, sin(rr) AS rz, cos(rr) AS rw, size FROM ps)"


@query(f"WITH {_POSES} SELECT src, dst, src_type, dst_type, {ROUND('x', 'y', 'z', 'rz', 'rw')} FROM po")
def relative_pose(spark, sf):
    """PO2, PO3, PO4."""
    return rounded(_poses(spark, sf), "x", "y", "z", "rz", "rw").drop("size")


@query(f"WITH {_POSES}, tl AS (SELECT 0.01 * sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))) AS tol FROM pt), mt AS (SELECT q.src, q.dst, p.src * 1000000 + p.dst AS ex, round(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)), 5) AS d, round(abs(abs(q.rw * p.rw + q.rz * p.rz) - 1), 5) AS dev FROM po q JOIN po p ON p.src_type = q.src_type AND p.dst_type = q.dst_type AND p.src <> q.src), n AS (SELECT *, min(d) OVER (PARTITION BY src, dst) AS near FROM mt) SELECT src, dst, arg_min(ex, ROW(dev, d, ex)) AS exemplar FROM n, tl WHERE d < near + tol GROUP BY src, dst")
def exemplar_best_match(spark, sf):
    """PO6, PO7: the nearest edge of the same types from another source; among those a hundredth of the diagonal further at most, the smallest turn."""
    zero = [F.lit(0.0).alias(c) for c in ("rx", "ry")]
    p = _poses(spark, sf).select((F.col("src") * 1000000 + F.col("dst")).alias("ex"), F.col("src").alias("scene"), "dst", "src_type", "dst_type", "x", "y", "z", *zero, "rz", "rw")
    p = settle(p)
    tol = exemplar.tolerance(P.points(spark, sf).withColumn("scene", F.lit(0)))
    best = exemplar.best_match(p.withColumnRenamed("ex", "id"), exemplar.library(p), tol)
    return best.join(p.select(F.col("ex").alias("id"), F.col("scene").alias("src"), "dst"), "id").select("src", "dst", F.col("ex").alias("exemplar"))


_COV = ", ".join(f"round(sum(({a} - c{a}) * ({b}2 - c{b}2)) + 0.0031::DOUBLE, 2) AS c{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz"))


@query(f"WITH q AS (SELECT l_suppkey AS oid, l_quantity AS x, l_discount * 500 AS y, l_tax * 500 AS z, l_tax * 300 AS x2, l_quantity / 2 AS y2, l_discount * 200 AS z2 FROM lineitem), m AS (SELECT oid, {', '.join(f'avg({c}) AS c{c}' for c in ('x', 'y', 'z', 'x2', 'y2', 'z2'))} FROM q GROUP BY oid) SELECT oid, {_COV} FROM q JOIN m USING (oid) GROUP BY oid")
def kabsch_covariance(spark, sf):
    """TK11: the nine sums between two matched point sets per object, shifted a little so that none lies on a rounding tie."""
    q = P.points(spark, sf).select("oid", "x", "y", "z", (F.col("z") * 0.6).alias("x2"), (F.col("x") / 2).alias("y2"), (F.col("y") * 0.4).alias("z2"))
    cols = ("x", "y", "z", "x2", "y2", "z2")
    m = q.groupBy("oid").agg(*[F.avg(c).alias(f"c{c}") for c in cols])
    j = q.join(m, "oid")
    return j.groupBy("oid").agg(*[F.round(F.sum((F.col(a) - F.col(f"c{a}")) * (F.col(f"{b}2") - F.col(f"c{b}2"))) + 0.0031, 2).alias(f"c{i}{k}") for i, a in enumerate("xyz") for k, b in enumerate("xyz")])


# ---- words


@query(f"WITH {WORDS} SELECT scene, word FROM w")
def encode_tree_word(spark, sf):
    """WD1, WD3."""
    return P.order_words(spark, sf)


@query(f"WITH {LINES}, n AS (SELECT scene, ch, rank FROM ln), k AS (SELECT scene, max(rank) AS k FROM n GROUP BY scene) SELECT n.scene, n.rank AS start, n.ch || CASE WHEN k.k = 1 THEN '' ELSE '' END || 'O' || coalesce((SELECT string_agg(CASE WHEN o.rank = (SELECT max(p.rank) FROM n p WHERE p.scene = n.scene AND p.rank <> n.rank) THEN o.ch ELSE '(' || o.ch || ')' END, '' ORDER BY o.rank) FROM n o WHERE o.scene = n.scene AND o.rank <> n.rank), '') AS word FROM n JOIN k USING (scene)")
def encode_leaf_start(spark, sf):
    """WD2: each order's word from each of its line items."""
    ln = P.lines(spark, sf).select("scene", "rank", "ch")
    other = ln.select("scene", F.col("rank").alias("r2"), F.col("ch").alias("c2"))
    j = ln.join(other, "scene").filter("rank <> r2").groupBy("scene", "rank", "ch").agg(F.array_sort(F.collect_list(F.struct("r2", "c2"))).alias("c"))
    head = F.transform(F.slice("c", 1, F.size("c") - 1), lambda x: F.concat(F.lit("("), x["c2"], F.lit(")")))
    word = F.concat("ch", F.lit("O"), F.array_join(head, ""), F.element_at("c", -1)["c2"])
    alone = ln.join(j.select("scene").distinct(), "scene", "left_anti").select("scene", F.col("rank").alias("start"), F.concat("ch", F.lit("O")).alias("word"))
    return j.select("scene", F.col("rank").alias("start"), word.alias("word")).unionByName(alone)


@query(f"WITH {WORDS}, c AS (SELECT scene, unnest(range(1, length(word) + 1)) AS p, word FROM w) SELECT scene, p AS child_pos, CAST(1 AS BIGINT) AS parent_pos FROM c WHERE p > 1 AND regexp_matches(substr(word, p, 1), '[A-Za-z]')")
def decode_word_edges(spark, sf):
    """WD7, GR14."""
    return words.tree_edges(P.order_words(spark, sf))


@query(f"WITH {WORDS}, c AS (SELECT DISTINCT ch FROM ln) SELECT 'O' AS a, ch AS b FROM c UNION SELECT ch, 'O' FROM c")
def word_grammar_pairs(spark, sf):
    """WD4."""
    return words.induce_words(P.order_words(spark, sf))["pair"]


@query(f"WITH {WORDS}, k AS (SELECT scene, count(*) AS degree FROM ln GROUP BY scene) SELECT DISTINCT 'O' AS ch, degree FROM k UNION SELECT DISTINCT ch, CAST(1 AS BIGINT) FROM ln")
def word_grammar_counts(spark, sf):
    """WD4, GC1."""
    return words.induce_words(P.order_words(spark, sf))["degree"]


@query(f"WITH {LINES}, k AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM ln GROUP BY scene)) SELECT 'O' AS ch, unnest(range(1, n + 1)) AS degree FROM k UNION SELECT DISTINCT ch, CAST(1 AS BIGINT) FROM ln")
def word_grammar_tree(spark, sf):
    """WD6, AG8."""
    return words.to_tree_grammar(words.induce_words(P.order_words(spark, sf))["degree"])


@query(f"WITH {WORDS}, x AS (SELECT scene, CASE WHEN scene % 3 = 0 THEN replace(word, '(N', '(N1') ELSE word END AS word FROM w) SELECT scene, word, length(replace(word, '(', '')) = length(replace(word, ')', '')) AND (length(word) - length(replace(word, '1', ''))) % 2 = 0 AS ok FROM x")
def check_word_fast(spark, sf):
    """WD5: the cheap checks on words of which a third get cycle labels."""
    w = P.order_words(spark, sf).withColumn("word", F.when(F.col("scene") % 3 == 0, F.regexp_replace("word", r"\(N", "(N1")).otherwise(F.col("word")))
    return w.select("scene", "word", W.well_formed(F.col("word")).alias("ok"))


@query(f"WITH {WORDS}, k AS (SELECT scene, count(*) AS degree FROM ln GROUP BY scene) SELECT w.scene, EXISTS (SELECT 1 FROM k x WHERE x.scene % 2 = 0 AND x.degree = k.degree) AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.scene = w.scene AND ln.ch NOT IN (SELECT ch FROM ln WHERE scene % 2 = 0)) AS ok FROM w JOIN k USING (scene) WHERE w.scene % 2 = 1")
def check_word(spark, sf):
    """WD5: words of even orders are the examples, odd ones are checked."""
    w = P.order_words(spark, sf)
    g = words.induce_words(w.filter(F.col("scene") % 2 == 0))
    return words.check_words(w.filter(F.col("scene") % 2 == 1), g).select("scene", "ok")


@query(f"WITH {WORDS} SELECT scene, regexp_replace(replace(word, '(A', '(A1%2'), '[0-9%]', '', 'g') AS word FROM w")
def strip_cycles(spark, sf):
    """PR19."""
    return P.order_words(spark, sf).select("scene", W.strip_cycles(F.regexp_replace("word", r"\(A", "(A1%2")).alias("word"))


_DIST = lambda a, b: "(" + " + ".join(f"abs((length({a}) - length(replace({a}, '{c}', ''))) - (length({b}) - length(replace({b}, '{c}', ''))))" for c in E_CHARS) + f")::DOUBLE / (length({a}) + length({b}))"


@query(f"WITH {EVENTS} SELECT x.scene AS a, y.scene AS b, round({_DIST('x.word', 'y.word')}, 6) AS d FROM ew x JOIN ew y ON x.scene < y.scene")
def word_distance(spark, sf):
    """AG4: users' event words."""
    return rounded(words.distances(P.event_words(spark, sf), "scene", E_CHARS), "d")


_SIG = f"{WORDS}, cn AS (SELECT scene, ch, count(*) AS n FROM ln GROUP BY scene, ch), sg AS (SELECT scene, string_agg(ch || n, ',' ORDER BY ch) FILTER (WHERE ch < 'O') AS lo, string_agg(ch || n, ',' ORDER BY ch) FILTER (WHERE ch > 'O') AS hi, string_agg(least('O', ch) || greatest('O', ch) || n, ',' ORDER BY least('O', ch) || greatest('O', ch)) AS e FROM cn GROUP BY scene), sw AS (SELECT scene, concat_ws(',', lo, 'O1', hi) || '||' || e AS sig FROM sg)"


@query(f"WITH {_SIG} SELECT scene, sig FROM sw")
def word_signature(spark, sf):
    """AG5."""
    return words.signatures(P.order_words(spark, sf)).select("scene", "sig")


@query(f"WITH {_SIG} SELECT sig, count(*) AS n, min(scene) AS first FROM sw GROUP BY sig")
def similar_groups(spark, sf):
    """AG5: equal signatures are one group, so no pairs are compared."""
    return words.signatures(P.order_words(spark, sf)).groupBy("sig").agg(F.count("*").alias("n"), F.min("scene").alias("first"))


@query(f"WITH {_SIG} SELECT sig, min(sw.scene) AS scene, arg_min(word, w.scene) AS word, count(*) AS n FROM sw JOIN w USING (scene) GROUP BY sig")
def signature_dedupe(spark, sf):
    """AG6, AG7."""
    return words.dedupe_by_signature(P.order_words(spark, sf), "scene")


@query(f"WITH {EVENTS}, d AS (SELECT x.scene AS query, y.scene AS match, round({_DIST('x.word', 'y.word')}, 9) AS d FROM ew x JOIN ew y ON x.scene <> y.scene) SELECT query, arg_min(match, ROW(d, match)) AS match, round(min(d), 6) AS d FROM d GROUP BY query")
def best_match_word(spark, sf):
    """TK6: each user's nearest other user."""
    return words.nearest_words(P.event_words(spark, sf), "scene", E_CHARS, 1).select("query", "match", F.round("d", 6).alias("d"))


@query()
def encode_multi_start(spark, sf):
    """WD2, WD10: suppliers' orders as small graphs with cycles, two shuffled words from each start."""
    ln = P.lines(spark, sf)
    nodes = ln.select("scene", F.col("rank").alias("node"), "ch").unionByName(ln.select("scene", F.lit(0).cast("long").alias("node"), F.lit("O").alias("ch")).distinct())
    star = ln.select("scene", F.lit(0).cast("long").alias("src"), F.col("rank").alias("dst"))
    ring = ln.filter("rank > 1").select("scene", (F.col("rank") - 1).alias("src"), F.col("rank").alias("dst"))
    pairs = star.unionByName(ring)
    edges = pairs.unionByName(pairs.select("scene", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return words.encode_graphs(nodes, edges, repeats=2).select("scene", "start", "repeat", "word", F.concat_ws(" ", F.col("node_ids").cast("array<string>")).alias("node_ids"))


@query()
def word_variants(spark, sf):
    """WD8: other words of the same order graphs."""
    return words.word_variants(P.order_words(spark, sf), 3)


@query()
def artificial_words(spark, sf):
    """WD9."""
    return words.mutate_words(P.order_words(spark, sf))


# ---- encodings


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch")
def charset(spark, sf):
    """AG13: characters of the corpus; only counts by character are shuffled."""
    return P.table(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS}, x AS (SELECT scene, rpad(word, 120, ' ') AS word FROM w) SELECT scene, p, instr(' ()ANOR', substr(word, p, 1)) - 1 AS idx FROM (SELECT scene, word, unnest(range(1, 121)) AS p FROM x)")
def pad_index(spark, sf):
    """EN1, EN2, WD12: padded words as indexes into the charset."""
    w = P.order_words(spark, sf).select("scene", F.posexplode(words.padded(F.col("word"), 120)).alias("p", "ch"))
    return w.select("scene", (F.col("p") + 1).cast("long").alias("p"), (F.instr(F.lit(" ()ANOR"), F.col("ch")) - 1).cast("long").alias("idx"))


@query(f"WITH {EVENTS}, x AS (SELECT scene, p, instr('{E_CHARS}', substr(word, p, 1)) - 1 AS idx FROM (SELECT scene, word, unnest(range(1, length(word) + 1)) AS p FROM ew)) SELECT scene, idx, count(*) AS n, min(p) AS first FROM x GROUP BY scene, idx")
def one_hot_sparse(spark, sf):
    """EN2, D21: event words as sparse one-hot positions, summed by column."""
    w = P.event_words(spark, sf).select("scene", F.posexplode(words.characters(F.col("word"))).alias("p", "ch"))
    return w.groupBy("scene", (F.instr(F.lit(E_CHARS), F.col("ch")) - 1).cast("long").alias("idx")).agg(F.count("*").alias("n"), (F.min("p") + 1).cast("long").alias("first"))


@query(f"WITH {LINES} SELECT scene, rank AS node, instr('ANOR', ch) - 1 AS type_idx, round(rank / 40.0::DOUBLE, 6) AS offset FROM ln UNION ALL SELECT DISTINCT scene, CAST(0 AS BIGINT), instr('ANOR', 'O') - 1, CAST(0 AS DOUBLE) FROM ln")
def graph_one_hot(spark, sf):
    """EN3: node type index and scaled offset to the parent."""
    ln = P.lines(spark, sf)
    idx = lambda c: (F.instr(F.lit("ANOR"), c) - 1).cast("long").alias("type_idx")
    own = ln.select("scene", F.col("rank").alias("node"), idx(F.col("ch")), F.round(F.col("rank") / 40.0, 6).alias("offset"))
    return own.unionByName(ln.select("scene").distinct().select("scene", F.lit(0).cast("long").alias("node"), idx(F.lit("O")), F.lit(0.0).alias("offset")))


_PREFIX = f"{PARTS}, {EDGES}, {TYPED}, pc AS (SELECT src_type, dst_type, count(*) AS n FROM te GROUP BY 1, 2), pf AS (SELECT src_type, dst_type, n, CAST(coalesce(sum(n) OVER (ORDER BY src_type, dst_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM pc)"


def _prefix(spark, sf):
    n = P.part_graph(spark, sf).groupBy("src_type", "dst_type").agg(F.count("*").alias("n"))
    return category.category_prefix(n)


@query(f"WITH {_PREFIX} SELECT src_type, dst_type, n, prefix FROM pf")
def category_prefix(spark, sf):
    """AG12."""
    return _prefix(spark, sf)


_WP = f"{LINES}, wp AS (SELECT 'O' AS src_type, ch AS dst_type, count(DISTINCT rank) AS n FROM ln GROUP BY ch), wf AS (SELECT src_type, dst_type, n, CAST(coalesce(sum(n) OVER (ORDER BY src_type, dst_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM wp), tot AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM wp), cb AS (SELECT scene, rank AS pos, prefix AS lo, prefix + n AS hi FROM ln JOIN wf ON dst_type = ch)"


def _word_bounds(spark, sf):
    ln = P.lines(spark, sf)
    p = category.category_prefix(ln.groupBy(F.lit("O").alias("src_type"), F.col("ch").alias("dst_type")).agg(F.countDistinct("rank").alias("n")))
    total = p.agg(F.sum("n")).first()[0]
    return category.category_bounds(ln.select("scene", F.col("rank").alias("pos"), F.lit("O").alias("src_type"), F.col("ch").alias("dst_type")), p, total), total


@query(f"WITH {_WP} SELECT scene, pos, lo, hi FROM cb")
def category_bounds(spark, sf):
    """CL6."""
    return _word_bounds(spark, sf)[0]


@query(f"WITH {_WP} SELECT scene, pos, array_to_string(list_transform(range(0, total), lambda k: CASE WHEN k >= lo AND k < hi THEN '1' ELSE '0' END), '') AS mask FROM cb, tot")
def category_masks(spark, sf):
    """EN5."""
    b, total = _word_bounds(spark, sf)
    m = category.mask(F.col("lo"), F.col("hi"), total)
    return b.select("scene", "pos", F.array_join(F.transform(m, lambda x: F.when(x, "1").otherwise("0")), "").alias("mask"))


@query(f"WITH {_WP}, a AS (SELECT scene, list(lo ORDER BY pos) AS c FROM cb GROUP BY scene) SELECT scene, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN i <= len(c) THEN CAST(c[i] AS VARCHAR) ELSE CAST(total AS VARCHAR) END), ' ') AS cats FROM a, tot")
def category_pad(spark, sf):
    """EN4: category arrays cut or filled to 12 with the dummy category."""
    b, total = _word_bounds(spark, sf)
    a = b.groupBy("scene").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lo"))), lambda x: x["lo"].cast("string")).alias("c"))
    full = F.slice(F.concat("c", F.array_repeat(F.lit(str(total)), 12)), 1, 12)
    return a.select("scene", F.array_join(full, " ").alias("cats"))


_CENTRES = "ce AS (SELECT s.type AS src_type, d.type AS dst_type, k AS category, (k - 1) * 0.8 AS cx, (1 - k) * 0.5 AS cy, (k % 2) * 0.4 AS cz FROM (SELECT DISTINCT type FROM t) s, (SELECT DISTINCT type FROM t) d, (SELECT unnest(range(0, 3)) AS k))"
_NEAREST = "round(sqrt((p.x - ce.cx) * (p.x - ce.cx) + (p.y - ce.cy) * (p.y - ce.cy) + (p.z - ce.cz) * (p.z - ce.cz)), 6)"


def _centres(spark, sf):
    """Three centres for each pair of types."""
    t = P.supplier_types(spark, sf).select("type").distinct()
    pairs = t.select(F.col("type").alias("src_type"), F.lit(1).alias("j")).join(t.select(F.col("type").alias("dst_type"), F.lit(1).alias("j")), "j").drop("j")
    k = F.col("category")
    c = pairs.withColumn("category", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    return c.select("src_type", "dst_type", "category", ((k - 1) * 0.8).alias("x"), ((1 - k) * 0.5).alias("y"), ((k % 2) * 0.4).alias("z"))


@query(f"WITH {_POSES}, {_CENTRES} SELECT p.src, p.dst, arg_min(category, ROW({_NEAREST}, category)) AS category FROM po p JOIN ce ON ce.src_type = p.src_type AND ce.dst_type = p.dst_type GROUP BY p.src, p.dst")
def nearest_category(spark, sf):
    """CL4."""
    return category.nearest_category(_poses(spark, sf), _centres(spark, sf))


@query(f"WITH {_POSES}, {_CENTRES}, h AS (SELECT src, dst, src_type, dst_type, x, y, z FROM po WHERE src < dst), p AS (SELECT * FROM h UNION ALL SELECT dst, src, dst_type, src_type, -x, -y, -z FROM h) SELECT p.src, p.dst, arg_min(category, ROW({_NEAREST}, category)) AS category FROM p JOIN ce ON ce.src_type = p.src_type AND ce.dst_type = p.dst_type GROUP BY p.src, p.dst")
def bidirectional_category(spark, sf):
    """CL5."""
    half = _poses(spark, sf).filter("src < dst").drop("size", "rz", "rw")
    return category.nearest_category(category.both_directions(half), _centres(spark, sf))


@query("WITH n AS (SELECT user_id, CAST(floor(value / 10) AS BIGINT) AS category, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_min(category, ROW(-n, category)) AS category FROM n GROUP BY user_id")
def majority_vote(spark, sf):
    """AG9."""
    e = P.table(spark, sf, "events").select("user_id", F.floor(F.col("value") / 10).cast("long").alias("category"))
    return category.majority_vote(e, ["user_id"])


@query()
def meanshift_categories(spark, sf):
    """CL1, CL2."""
    return category.edge_categories(_poses(spark, sf))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INT) < 13107 THEN 'test' ELSE 'train' END AS split FROM documents")
def train_test_split(spark, sf):
    """EN6."""
    return vector.hash_split(P.table(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample_rows(spark, sf):
    """TK7, TK12, TK13: a sampling operator; the limit is its feature."""
    return vector.sample_rows(P.table(spark, sf, "documents"), "doc_id", 50).select("doc_id")


@query(f"WITH {WORDS} SELECT scene, word FROM w WHERE length(word) > 0 AND length(word) <= 20 AND NOT contains(word, '9')")
def length_filter(spark, sf):
    """PR18."""
    return words.filter_words(P.order_words(spark, sf), 20)


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def exact_dedupe(spark, sf):
    """AG7, ST3: a digest stands for the text in the shuffle."""
    d = P.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


# ---- vectors


@query(f"WITH {VECTORS} SELECT id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS idx FROM v")
def argmax_decode(spark, sf):
    """EN8."""
    return P.vectors(spark, sf).select("id", (F.array_position("v", F.array_max("v")) - 1).cast("long").alias("idx"))


@query(f"WITH {KNN} SELECT a, b, rank, round(d, 6) AS d FROM k WHERE rank <= 4")
def knn_graph(spark, sf):
    """TK1."""
    return rounded(vector.knn(P.vectors(spark, sf), 4), "d")


@query(f"WITH {EVENTS}, d AS (SELECT x.scene AS a, y.scene AS b, round({_DIST('x.word', 'y.word')}, 9) AS d FROM ew x JOIN ew y ON x.scene <> y.scene), k AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM d) SELECT a, b, rank, round(d, 6) AS d FROM k WHERE rank <= 4")
def knn_word_graph(spark, sf):
    """TK2."""
    d = words.nearest_words(P.event_words(spark, sf), "scene", E_CHARS, 4)
    return d.select(F.col("query").alias("a"), F.col("match").alias("b"), "rank", F.round("d", 6).alias("d"))


def _pairs(spark, sf):
    """Ten pairs of vectors by the order of a hash."""
    top = vector.sample_rows(P.vectors(spark, sf), "id", 20).select("id", F.row_number().over(Window.orderBy(vector.hashed_rank(F.col("id")), "id")).alias("r"))
    a = top.filter("r % 2 = 1").select(((F.col("r") + 1) / 2).cast("long").alias("pair"), F.col("id").alias("a"))
    return settle(a.join(top.filter("r % 2 = 0").select((F.col("r") / 2).cast("long").alias("pair"), F.col("id").alias("b")), "pair"))


_PAIRS = VECTORS + ", tp AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM v), pp AS (SELECT (a.r + 1) // 2 AS pair, a.id AS a, b.id AS b FROM tp a JOIN tp b ON b.r = a.r + 1 WHERE a.r % 2 = 1 AND a.r < 20)"


@query(f"WITH {_PAIRS}, d AS (SELECT pair, x.id, round(list_distance(va.v, x.v) + list_distance(vb.v, x.v), 6) AS d FROM pp JOIN v va ON va.id = pp.a JOIN v vb ON vb.id = pp.b JOIN v x ON x.id <> pp.a AND x.id <> pp.b) SELECT pair, arg_min(id, ROW(d, id)) AS waypoint, min(d) AS d FROM d GROUP BY pair")
def waypoint(spark, sf):
    """TK3."""
    return vector.waypoints(P.vectors(spark, sf), _pairs(spark, sf))


@query()
def latent_path(spark, sf):
    """TK3: three rounds of waypoints."""
    return vector.latent_path(P.vectors(spark, sf), _pairs(spark, sf), 3)


@query(f"WITH {_PAIRS}, s AS (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS k) SELECT pair, k, round(list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * (1 - k) + z[2] * k)), 5) AS total FROM pp JOIN v x ON x.id = pp.a JOIN v y ON y.id = pp.b, s")
def latent_lerp(spark, sf):
    """TK4."""
    v = vector.interpolate(P.vectors(spark, sf), _pairs(spark, sf), [0.25, 0.5, 0.75])
    return v.select("pair", "k", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query()
def neighborhood_sample(spark, sf):
    """TK4, TK5: points near the first of each pair, with hashed noise."""
    p = _pairs(spark, sf).select("pair", "a", F.col("a").alias("b"))
    v = vector.interpolate(P.vectors(spark, sf), p, [0.1 * i for i in range(10)], noise=0.05)
    return v.select("pair", "k", F.round(vector.euclid(F.col("v"), F.transform("v", lambda x: F.lit(0.0))), 5).alias("norm"))


@query(f"WITH {EVENTS}, po AS (SELECT scene, word FROM ew ORDER BY md5(CAST(scene AS VARCHAR)), scene LIMIT 64), c AS (SELECT x.scene AS anchor, y.scene AS other, round({_DIST('x.word', 'y.word')}, 9) AS d, row_number() OVER (PARTITION BY x.scene ORDER BY md5(x.scene || ':' || y.scene), y.scene) AS r FROM ew x JOIN po y ON x.scene <> y.scene) SELECT anchor, arg_min(other, ROW(d, other)) AS positive, arg_max(other, ROW(d, other)) AS negative FROM c WHERE r <= 10 GROUP BY anchor")
def triplet_mining(spark, sf):
    """TK8: each user against ten of a sampled pool."""
    w = P.event_words(spark, sf).select(F.col("scene").alias("id"), F.col("word").alias("w"))
    return vector.mine_triplets(w, vector.sample_rows(w, "id", 64), lambda a, b: F.round(W.distance(a, b, E_CHARS), 9))


# ---- iterative graph operators


def _knn_edges(spark, sf, k):
    e = vector.knn(P.vectors(spark, sf), k).select("a", "b", F.round("d", 6).alias("weight"))
    return settle(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")).distinct())


def _vector_nodes(spark, sf):
    return P.vectors(spark, sf).select(F.col("id").alias("node"))


_KE = lambda k: f"{KNN}, ke AS (SELECT a AS src, b AS dst, round(d, 6) AS weight FROM k WHERE rank <= {k} UNION SELECT b, a, round(d, 6) FROM k WHERE rank <= {k})"
_CC = lambda k: f"RECURSIVE {_KE(k)}, cc(node, label) AS (SELECT id, id FROM v UNION SELECT ke.dst, cc.label FROM cc JOIN ke ON ke.src = cc.node), lb AS (SELECT node, min(label) AS label FROM cc GROUP BY node)"


@query(f"WITH {_CC(1)} SELECT node, label FROM lb")
def connected_components(spark, sf):
    """GR5, GR6 on the nearest-neighbour graph."""
    return graph.components(_vector_nodes(spark, sf), _knn_edges(spark, sf, 1))


@query(f"WITH {_CC(1)} SELECT count(DISTINCT label) = 1 AS connected, count(DISTINCT label) AS n_components FROM lb")
def is_connected(spark, sf):
    """GR6."""
    c = graph.components(_vector_nodes(spark, sf), _knn_edges(spark, sf, 1)).agg(F.countDistinct("label").alias("n_components"))
    return c.select((F.col("n_components") == 1).alias("connected"), "n_components")


@query(f"WITH {_CC(1)}, r AS (SELECT DISTINCT label AS dst FROM lb), x AS (SELECT lag(dst) OVER (ORDER BY dst) AS src, dst FROM r) SELECT src, dst FROM x WHERE src IS NOT NULL")
def component_augment(spark, sf):
    """GR10."""
    return graph.augment_components(graph.components(_vector_nodes(spark, sf), _knn_edges(spark, sf, 1)))


@query(f"WITH {_CC(1)}, n AS (SELECT label, count(*) AS n_nodes FROM lb GROUP BY label), u AS (SELECT DISTINCT src, dst FROM ke WHERE src < dst), g AS (SELECT label, count(*) AS m FROM u JOIN lb ON lb.node = u.src GROUP BY label) SELECT label, n_nodes, n_nodes - 1 AS n_tree, coalesce(m, 0) - (n_nodes - 1) AS n_cycle FROM n LEFT JOIN g USING (label)")
def spanning_forest_invariants(spark, sf):
    """GR5, GR7: one edge less than nodes, the rest close cycles."""
    return forest.forest_summary(_vector_nodes(spark, sf), _knn_edges(spark, sf, 1).select("src", "dst"))


_BFS = lambda stop="": f"RECURSIVE {_KE(3)}, bf(node, level) AS (SELECT min(id), CAST(0 AS BIGINT) FROM v UNION SELECT ke.dst, bf.level + 1 FROM bf JOIN ke ON ke.src = bf.node WHERE bf.level < 40 {stop}) SELECT node, min(level) AS level FROM bf GROUP BY node"


@query(f"WITH {_BFS()}")
def bfs_levels(spark, sf):
    """GR9."""
    v = _vector_nodes(spark, sf)
    return graph.bfs_levels(v, _knn_edges(spark, sf, 3), v.agg(F.min("node").alias("node")))


@query(f"WITH {_BFS('AND ke.dst % 5 <> 3')}")
def region_grow(spark, sf):
    """GR8: growth that stops at flagged nodes."""
    v = _vector_nodes(spark, sf)
    return graph.bfs_levels(v, _knn_edges(spark, sf, 3), v.agg(F.min("node").alias("node")), v.filter("node % 5 = 3"))


_SP = f"RECURSIVE {_KE(2)}, s0 AS (SELECT min(id) AS id FROM v), bf(node, dist, hops) AS (SELECT id, CAST(0 AS DOUBLE), 0 FROM s0 UNION SELECT node, dist, hops FROM (SELECT ke.dst AS node, round(min(bf.dist + ke.weight), 6) AS dist, bf.hops + 1 AS hops FROM bf JOIN ke ON ke.src = bf.node WHERE bf.hops < 60 GROUP BY ke.dst, bf.hops)), sp AS (SELECT node, round(min(dist), 6) AS dist FROM bf GROUP BY node)"


def _paths(spark, sf):
    v = _vector_nodes(spark, sf)
    return graph.shortest_paths(_knn_edges(spark, sf, 2), v.agg(F.min("node").alias("node")))


@query(f"WITH {_SP} SELECT node, dist FROM sp")
def shortest_path(spark, sf):
    """GR11."""
    return _paths(spark, sf).select("node", F.round("dist", 6).alias("dist"))


@query(f"WITH {_SP} SELECT count(*) AS n, round(avg(dist), 3) AS mean, round(max(dist), 3) AS longest FROM sp")
def path_stats(spark, sf):
    """AG10."""
    return _paths(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(F.round("dist", 6)), 3).alias("mean"), F.round(F.max(F.round("dist", 6)), 3).alias("longest"))


_SAME = "sg AS (SELECT id, concat_ws('/', CAST(label AS VARCHAR), CASE WHEN v[1] > 0 THEN '+' ELSE '-' END, CASE WHEN v[2] > 0 THEN '+' ELSE '-' END) AS sig FROM v), st AS (SELECT min(id) OVER (PARTITION BY sig) AS a, id AS b FROM sg)"


@query(f"WITH {KNN}, {_SAME}, x AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(d) AS w FROM k WHERE rank <= 2 GROUP BY 1, 2), u AS (SELECT a, b FROM x UNION SELECT a, b FROM st WHERE a <> b) SELECT u.a, u.b, round(coalesce(w, 0.0::DOUBLE), 6) AS weight FROM u LEFT JOIN x ON x.a = u.a AND x.b = u.b")
def latent_graph(spark, sf):
    """GR13, AG5: vectors of equal signature (label and two signs) are joined with weight 0, unless they are nearest neighbours, whose distance wins."""
    v = P.vectors(spark, sf)
    sign = lambda i: F.when(F.col("v")[i] > 0, "+").otherwise("-")
    same = graph.stars(v.select(F.concat_ws("/", F.col("label").cast("string"), sign(0), sign(1)).alias("group"), F.col("id").alias("node")))
    return rounded(graph.latent_edges(same, vector.knn(v, 2)), "weight")


@query(f"WITH f AS (SELECT l_partkey AS cell, l_suppkey AS oid FROM lineitem), t AS (SELECT s_suppkey AS oid, s_nationkey % 2 AS scene FROM supplier), {EDGES}, n AS (SELECT s_suppkey AS oid, s_nationkey AS nation FROM supplier), e2 AS (SELECT e.src, e.dst FROM e JOIN n a ON a.oid = e.src JOIN n b ON b.oid = e.dst AND abs(a.nation - b.nation) <= 1), sm AS (SELECT scene AS sample_id, oid AS node FROM t), br AS (SELECT s.sample_id, s.node, bool_or(o.node IS NULL) AS border FROM sm s JOIN e2 ON e2.src = s.node LEFT JOIN sm o ON o.sample_id = s.sample_id AND o.node = e2.dst GROUP BY 1, 2), fl AS (SELECT s.sample_id, s.node, coalesce(border, false) AS border FROM sm s LEFT JOIN br USING (sample_id, node)) SELECT f.sample_id, f.node, CASE WHEN f.border THEN 1 WHEN EXISTS (SELECT 1 FROM e2 JOIN fl g ON g.node = e2.dst AND g.sample_id = f.sample_id AND g.border WHERE e2.src = f.node) THEN 2 ELSE 0 END AS flag FROM fl f")
def subgraph_border_flags(spark, sf):
    """TK9: nations of even and odd number as two samples of the graph of suppliers that share a part, within neighbouring nations."""
    n = P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_nationkey").alias("n"))
    e = settle(spatial.symmetric(spatial.near_pairs(P.shared_parts(spark, sf), n)))
    s = P.table(spark, sf, "supplier").select((F.col("s_nationkey") % 2).alias("sample_id"), F.col("s_suppkey").alias("node"))
    return graph.border_flags(s, e)

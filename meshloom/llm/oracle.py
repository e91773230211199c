"""DuckDB SQL for the queries that SQL can express."""

SQL = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key
  FROM documents),
s AS (
  SELECT key, max(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
p AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s),
w AS (
  SELECT *, [5.0, 2.0, 1.0][CAST(pos % 3 AS INT) + 1]::DOUBLE AS w, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS top FROM p),
l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(top) OVER (ORDER BY top / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY top / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
v AS (
  SELECT max(lv) AS level FROM l WHERE lv * w <= top),
t AS (
  SELECT key, source_size, CASE WHEN level IS NULL OR level * w > top THEN top ELSE level * w END AS target,
         CAST(CAST('0x' || substr(md5('17:' || key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM l, v),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.key ORDER BY d.size DESC, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS rank
  FROM d JOIN t USING (key)),
c AS (
  SELECT *, CAST(floor(rate * rank + u) - floor(rate * (rank - 1) + u) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op12_url_verdicts": r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme
  FROM u),
rules(said, what, h, pre) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
plain AS (
  SELECT url, split_part(url, '://', 1) AS kind, host, path,
         regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g') AS html
  FROM p WHERE instr(url, '://') > 0 AND regexp_matches(html, '(?i)canonical|refresh')),
tags AS (
  SELECT url, kind, host, path, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag, 1 AS how FROM plain
  UNION ALL
  SELECT url, kind, host, path, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')), 2 FROM plain),
refs AS (
  SELECT url, kind, host, path, replace(trim(CASE how
    WHEN 1 THEN coalesce(nullif(regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1), ''),
                         nullif(regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2), ''),
                         nullif(regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3), ''))
    ELSE coalesce(nullif(regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[''\x20]*([^"'']*)|''\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["\x20]*([^"'']*))', 1), ''),
                  nullif(regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[''\x20]*([^"'']*)|''\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["\x20]*([^"'']*))', 2), '')) END), '&amp;', '&') AS ref
  FROM tags
  WHERE how = 1 AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?([^"''>]*\s)?canonical(\s[^"''>]*)?["''\s/>]')
     OR how = 2 AND regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?\s*refresh\s*["''\s/>]')),
goal AS (
  SELECT url, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref
    WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') OR ref = '' OR starts_with(ref, '#') THEN NULL
    WHEN starts_with(ref, '//') THEN kind || ':' || ref
    WHEN starts_with(ref, '/') THEN kind || '://' || host || ref
    WHEN starts_with(ref, '?') THEN kind || '://' || host || path || ref
    ELSE kind || '://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || ref END AS target
  FROM refs),
named AS (
  SELECT DISTINCT url FROM (SELECT url FROM goal WHERE target IS NOT NULL UNION ALL SELECT target FROM goal WHERE target IS NOT NULL UNION ALL SELECT url FROM p WHERE instr(url, '://') > 0)),
parts AS (
  SELECT url, translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS kind,
         translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^#]*)', 1) AS rest FROM named),
node AS (
  SELECT url, kind || '://' || host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS node, host,
         regexp_extract(CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END, '^[^?]*') AS path FROM parts),
edge AS (
  SELECT a.node AS a, b.node AS b FROM goal JOIN node a ON goal.url = a.url JOIN node b ON goal.target = b.url
  UNION SELECT b.node, a.node FROM goal JOIN node a ON goal.url = a.url JOIN node b ON goal.target = b.url),
bad AS (
  SELECT DISTINCT node FROM node JOIN (SELECT DISTINCT a FROM edge) e ON node.node = e.a
  WHERE (SELECT arg_max(what, length(said)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) = 'block'),
hit AS (
  SELECT node FROM bad UNION SELECT edge.b FROM hit JOIN edge ON edge.a = hit.node),
said AS (
  SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, hit.node IS NOT NULL AS aliased,
         (SELECT arg_max(said, length(said)) FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)) AS rule,
         (SELECT arg_max(what, length(said)) FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)) AS ruled
  FROM p LEFT JOIN node ON p.url = node.url LEFT JOIN hit ON node.node = hit.node)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN aliased THEN 'block' ELSE 'allow' END) AS verdict, ruled IS NULL AND aliased AS alias_block FROM said
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
t AS (
  SELECT doc, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
vocabulary AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
v AS (
  SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, (1 + 1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // CAST(g.total + v.v AS HUGEINT)) AS p
  FROM g JOIN vocabulary USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (
  SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + 1000000000 * CAST(n + 1 AS HUGEINT) // CAST(sum(n) OVER (PARTITION BY lang) + v AS HUGEINT) AS q FROM l JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON a.lang = pairs.lang AND a.source = pairs.source AND b.source = pairs.item
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}

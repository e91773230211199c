"""URL filters by redirect equivalence: rules judge urls, and block decisions reach a url's aliases. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HUBS, components, cut

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Parts of a url that many pages repeat, where the list of blocked aliases is too long to broadcast.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What can hold no link of its own: comments and scripts.
_ASIDE = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>"]
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_CANONICAL = r"""(?is)\srel\s*=\s*["']?([^"'>]*\s)?canonical(\s[^"'>]*)?["'\s/>]"""
_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\s*["'\s/>]"""
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)\scontent\s*=\s*(?:"\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['\x20]*([^"']*)|'\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["\x20]*([^"']*))"""


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def after_scheme(url: Column) -> Column:
    """What follows the first ://; '' where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; '' without ://."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; '' without ://."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path) and its verdict, both null where none fits. Of equal lengths the longer host comes first."""
    said = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        said, verdict = F.when(fits, h + p).otherwise(said), F.when(fits, what).otherwise(verdict)
    return said, verdict


def node_of(url: Column) -> Column:
    """A url as a node of the alias graph: its scheme and host in lower case, an empty path as /, no fragment. Null without ://."""

    def named(u: Column) -> Column:
        scheme = F.translate(F.substring_index(u, "://", 1), _UPPER, _LOWER)
        rest = F.regexp_replace(F.regexp_extract(after_scheme(u), r"^[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
        return F.when(F.instr(u, "://") > 0, F.concat(scheme, F.lit("://"), host_of(u), rest))

    return _let(url, named)


def resolved(base: Column, ref: Column) -> Column:
    """A reference of a page at base as a full url: absolute, //host, /path, ?query or relative to the page's folder."""

    def full(r: Column) -> Column:
        kind = F.substring_index(base, "://", 1)
        root = F.concat(kind, F.lit("://"), host_of(base))
        folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"^(.*/)", 1), F.lit("")), F.lit("/"))
        return (
            F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), r)
            .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (r == "") | F.startswith(r, F.lit("#")), F.lit(None))
            .when(F.startswith(r, F.lit("//")), F.concat(kind, F.lit(":"), r))
            .when(F.startswith(r, F.lit("/")), F.concat(root, r))
            .when(F.startswith(r, F.lit("?")), F.concat(root, path_of(base), r))
            .otherwise(F.concat(root, folder, r))
        )

    return _let(F.replace(F.trim(ref), F.lit("&amp;"), F.lit("&")), full)


def _first(tag: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, pattern, i), F.lit("")) for i in range(1, groups + 1)))


def declared_links(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, target): each page's canonical links and refresh redirects, resolved against its url.

    Comments and scripts are not read. Only pages that name canonical or refresh at all are searched.
    """
    html = F.col("html").cast("string")
    plain = html
    for aside in _ASIDE:
        plain = F.regexp_replace(plain, aside, " ")
    near = pages.select(F.col("url").cast("string").alias("url"), html.alias("html")).filter(F.instr("url", "://") > 0).filter(html.rlike(r"(?i)canonical|refresh"))
    tags = near.select("url", plain.alias("plain")).select(
        "url",
        F.explode(
            F.concat(
                F.transform(F.filter(F.regexp_extract_all("plain", F.lit(_LINK), 0), lambda t: t.rlike(_CANONICAL)), lambda t: _first(t, _HREF, 3)),
                F.transform(F.filter(F.regexp_extract_all("plain", F.lit(_META), 0), lambda t: t.rlike(_REFRESH)), lambda t: _first(t, _TARGET, 2)),
            )
        ).alias("ref"),
    )
    return tags.select("url", resolved(F.col("url"), F.col("ref")).alias("target")).filter("target IS NOT NULL")


def _id(node: Column) -> Column:
    """128 bits for a node, so that rounds shuffle no urls."""
    return F.unhex(F.md5(node))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per row page_id, host, path, rule, verdict and alias_block: each page's url judged by rules and by its aliases.

    Host: what follows the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #. The longest rule that
    fits decides: an explicit decision, allow or block, always stands. Urls that no rule fits take the decision of their
    aliases: urls are joined by canonical links and refresh redirects of pages and by redirects(from_url, to_url) where given,
    components of these edges are found distributedly, and a component with a url that a rule blocks (a page or a mere target)
    blocks its undecided members: alias_block. Members that a rule allows keep their allow and shield no one else. Undecided
    urls without a blocked alias get `default`.

    Only edges are shuffled, as 128-bit ids: pages without one, and a host that holds most pages, cost nothing but the scan. A
    canonical url that very many pages name is a hub, which components() treats apart.

    Null urls and urls without :// have empty host and path, no rule and no alias, hence default. Null and empty html: no
    links. Long html is searched whole. Repeated rows and ids are judged alike; null ids pass through; empty table: empty.
    Other columns are not read and may have any name.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    judged = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.select("page_id", "url", *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    links = declared_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").cast("string").alias("url"), F.col("to_url").cast("string").alias("target")))
    ends = cut(links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    if ends.isEmpty():
        out = judged.withColumn("alias_block", F.lit(False))
    else:
        root = components(ends.select(_id(F.col("a")).alias("a"), _id(F.col("b")).alias("b")))
        nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
        rule, verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
        # pages' own spelling may lack the path's /, which no rule's path then starts; nodes are judged with it
        bad = nodes.filter(verdict == "block").select(_id(F.col("node")).alias("id")).join(root, "id").select("root").distinct()
        hit = cut(root.join(bad, "root").select("id").distinct())
        keyed = judged.withColumn("id", _id(node_of(F.col("url"))))
        asked, rest = keyed.filter("ruled IS NULL AND id IS NOT NULL"), keyed.filter("ruled IS NOT NULL OR id IS NULL")
        if hit.count() <= HUBS:
            asked = asked.join(F.broadcast(hit.withColumn("alias_block", F.lit(True))), "id", "left")
        else:  # a url that many pages repeat is spread over SALTS tasks
            salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            asked = asked.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(hit.withColumn("salt", salt).withColumn("alias_block", F.lit(True)), ["id", "salt"], "left").drop("salt")
        asked, rest = asked.drop("id"), rest.drop("id").withColumn("alias_block", F.lit(False))
        out = asked.withColumn("alias_block", F.coalesce("alias_block", F.lit(False))).unionByName(rest)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("alias_block"), "block").otherwise(default)).alias("verdict"), "alias_block")

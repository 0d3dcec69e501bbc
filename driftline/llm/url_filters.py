"""URL filters with redirect equivalence, in Spark SQL functions.

A rule names a host, which stands for its subdomains too, and the start of a path; the longest rule that fits decides. URLs without a rule are judged by what they are
aliases of: redirects, refresh elements, canonical links and the URL's own plain form (no ``www.``, no tracking parameters) are the edges of a graph, and a block of any member
of a connected component holds for all of it, unless a member is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, components, table

# (host, start of the path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|ref)"  # query parameters that do not choose what is shown
_TAGS = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)|<(?:link|meta)\b[^>]*>"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as ``struct<rule, verdict>``; of equally long ones an allowing one, then the first by text. NULL if none fits."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(-len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for h, p, v in rules
    ]
    return F.array_min(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,verdict:string,rule:string>")


def node_of(url: Column) -> Column:
    """Name of what a URL asks for: host, path and query, without scheme and fragment. NULL without a host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)))


def plain_node(node: Column) -> Column:
    """The form of a node without ``www.`` and tracking parameters."""
    bare = F.regexp_replace(node, rf"([?&]){TRACKING}(?:=[^&]*)?(?=&|$)", "$1")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"&{2,}", "&"), r"\?&", "?"), r"[?&]$", "")
    return F.regexp_replace(bare, r"^www\.(?=[^/?]*\.)", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an element, in any of the three ways to quote it; empty without one."""
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.trim(F.replace(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]), F.lit("&amp;"), F.lit("&")))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    done = F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() AS array<string>)"), step), "/")
    return F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(F.regexp_replace(done, "/$", ""), F.lit("/"))).otherwise(done)


def resolved(link: Column, url: Column) -> Column:
    """Absolute form of a link that stands on the page of ``url``; NULL for an empty one, a fragment and other kinds of address."""
    root = F.concat(F.lit("http://"), host_of(url))
    path = path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    place = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(_SCHEME + "//"), link)
        .when(link.rlike(_SCHEME), None)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link.startswith("/"), F.concat(root, without_dots(place), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, place)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``url, target``: canonical links and refresh elements of pages, outside comments, scripts and styles; targets are absolute."""
    held = pages.filter(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    refresh = F.regexp_extract(attribute(tag, "content"), r"""(?i)^[0-9.\s]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    link = F.when(tag.rlike(r"(?i)^<link\b") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical"), attribute(tag, "href")).when(
        tag.rlike(r"(?i)^<meta\b") & (F.lower(attribute(tag, "http-equiv")) == "refresh"), F.trim(refresh))
    return held.select("url", resolved(link, F.col("url")).alias("target")).filter(F.col("target").isNotNull())


def alias_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``node, verdict`` of URLs with aliases of which one is decided by a rule: ``allow`` if any is allowed, else ``block``."""
    pairs = page_links(pages) if "html" in pages.columns else None
    if redirects is not None:
        given = redirects.select(F.col(redirects.columns[0]).alias("url"), F.col(redirects.columns[1]).alias("target"))
        pairs = given if pairs is None else pairs.unionByName(given)
    own = pages.select(node_of(F.col("url")).alias("a")).distinct()
    edges = own.select("a", plain_node(F.col("a")).alias("b"))
    if pairs is not None:
        linked = pairs.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).distinct()
        ends = linked.select(F.col("b").alias("a"), plain_node(F.col("b")).alias("b"))
        edges = edges.unionByName(linked).unionByName(ends)
    groups = materialize(components(edges.filter(F.col("a") != F.col("b"))))
    at = F.concat(F.lit("://"), F.col("node"))
    ruled = groups.withColumn("r", rule_of(host_of(at), path_of(at), rules)["verdict"])
    decided = ruled.groupBy("component").agg(F.min("r").alias("verdict")).filter(F.col("verdict").isNotNull())
    return materialize(groups.join(decided, "component").select("node", "verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES), redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``redirects`` holds URLs and, in its second column, what they redirect to.

    The verdict (``allow`` or ``block``) is that of the rule; without one that of the URL's aliases, where an explicit allow comes before a block; else ``allow``. A NULL URL
    or one without ``://`` has an empty host and path, no rule, and is allowed. Rows are judged one by one, so repeated ones all stay; an empty table stays empty. Pages of any
    length are searched whole. Other columns stay; columns named like the new ones are replaced. The rules are a parameter that travels with the plan.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    url = F.col("url")
    decided = alias_verdicts(pages, rules, redirects).toDF("alias_of_url", "verdict_of_alias")
    rows = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    met = rows.alias("p").join(decided.alias("d"), node_of(F.col("p.url")) == F.col("d.alias_of_url"), "left")
    verdict = F.coalesce(F.col("p.rule.verdict"), F.col("d.verdict_of_alias"), F.lit("allow"))
    return met.select(*[F.col(f"p.`{c}`") for c in pages.columns], "p.host", "p.path", F.col("p.rule.rule").alias("rule"), verdict.alias("verdict"))


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


# Links in the SQL are resolved if absolute or from the root, which all links of the test tables' kind are; the tests cover the others.
OP12_SQL = r"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) AS query
  FROM pages),
own AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '?' THEN '' ELSE query END END AS node FROM parts),
tags AS (SELECT host, node, unnest(regexp_extract_all(html, '(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)|<(?:link|meta)\b[^>]*>')) AS tag FROM own),
links AS (
  SELECT host, node, trim(replace(CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*(?:["''][^"'']*)?canonical') THEN regexp_extract(tag, '(?i)[\s"'']href\s*=\s*["'']?([^"''\s>]*)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)[\s"'']content\s*=\s*["''][0-9.\s]*[;,]\s*(?:url\s*=\s*)?([^"'']*)', 1) END, '&amp;', '&')) AS link
  FROM tags),
targets AS (
  SELECT node, CASE WHEN link LIKE '//%' THEN link WHEN link LIKE '/%' THEN '//' || host || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(link, '//.*') END AS t
  FROM links WHERE link <> ''),
linked AS (
  SELECT node AS a, lower(regexp_extract(t, '//([^/?#]*)', 1)) || CASE WHEN regexp_extract(t, '//[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(t, '//[^/?#]*([^?#]*)', 1) END
    || CASE WHEN regexp_extract(t, '//[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(t, '//[^?#]*(\?[^#]*)', 1) END AS b
  FROM targets WHERE t IS NOT NULL),
nodes AS (SELECT node AS n FROM own WHERE node IS NOT NULL UNION SELECT b FROM linked),
bare AS (
  SELECT n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '([?&])(?:utm_[^=&]*|gclid|fbclid|ref)(?:=[^&]*)?(&|$)', '\1\2', 'g'),
    '([?&])(?:utm_[^=&]*|gclid|fbclid|ref)(?:=[^&]*)?(&|$)', '\1\2', 'g'), '&{2,}', '&', 'g'), '\?&', '?', 'g'), '[?&]$', '') AS m FROM nodes),
edges AS (
  SELECT a, b FROM linked WHERE a <> b
  UNION SELECT n, CASE WHEN regexp_matches(m, '^www\.[^/?]*\.') THEN substr(m, 5) ELSE m END FROM bare WHERE n <> CASE WHEN regexp_matches(m, '^www\.[^/?]*\.') THEN substr(m, 5) ELSE m END),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
fit AS (
  SELECT n, min(verdict) AS verdict FROM (
    SELECT n, verdict, rank() OVER (PARTITION BY n ORDER BY length(host || path) DESC) AS r
    FROM (SELECT DISTINCT b AS n, regexp_extract(b, '^[^/?]*') AS h, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS p FROM reach)
    JOIN rules ON (h = host OR ends_with(h, '.' || host)) AND starts_with(p, path)) WHERE r = 1 GROUP BY n),
alias AS (SELECT a AS node, min(verdict) AS verdict FROM reach JOIN fit ON fit.n = reach.b GROUP BY a),
ruled AS (
  SELECT page_id, url, arg_min(struct_pack(rule := r.host || r.path, verdict := r.verdict), struct_pack(size := -length(r.host || r.path), v := r.verdict, t := r.host || r.path)) AS r
  FROM (SELECT DISTINCT page_id, url, host, path FROM own) o JOIN rules r ON (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path) GROUP BY page_id, url)
SELECT o.page_id, o.host, o.path, ruled.r.rule AS rule, coalesce(ruled.r.verdict, alias.verdict, 'allow') AS verdict
FROM own o LEFT JOIN ruled ON ruled.page_id IS NOT DISTINCT FROM o.page_id AND ruled.url = o.url LEFT JOIN alias ON alias.node = o.node
"""

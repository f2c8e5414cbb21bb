"""URL filtering with redirect equivalence.

A page's node is its url without scheme, fragment, tracking parameters, default index name and
trailing slash. Redirects (``meta refresh``) and ``link rel=canonical`` in the page give edges. Pages
of one component are aliases. A rule that fits a page decides it; a page without a rule is blocked
if any node of its component is blocked by a rule and none is explicitly allowed; else it is allowed.

Defined cases: a null url or one without ``://`` has empty host and path, no node and is allowed;
null html has no edges; repeated pages share a node; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
TRACKING = r"(?i)^(utm_[a-z]+|ref|gclid|fbclid|sessionid)="


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Null for a url without ``://``."""
    query = F.regexp_extract(F.regexp_extract(url, r"^([^#]*)", 1), r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    path = F.regexp_replace(path_of(url), r"(/index\.html?)?/*$", "")
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolve(href: Column, url: Column) -> Column:
    """An href as an absolute url; relative paths without a leading slash are resolved to the folder."""
    scheme, host, path = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), host_of(url), path_of(url)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), host, href))
        .when(href == "", F.lit(None))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/")), href))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and refresh redirects of the pages' HTML, attributes in any order."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<link\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\srel\s*=\s*["']?canonical\b""")
    )
    hrefs = F.transform(links, lambda t: F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?([^"'\s>]*)""", 1))
    metas = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b""")
    )
    moves = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*['"]?([^"'\s>]*)""", 1))
    return (
        pages.where("url is not null and html is not null")
        .select("url", F.explode(F.concat(hrefs, moves)).alias("href"))
        .select("url", resolve(F.col("href"), F.col("url")).alias("target"))
        .where("target is not null")
    )


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equal rules allow is taken."""
    ordered = sorted(rules or RULES, key=lambda r: (-len(r[0] + r[1]), r[2]))
    out = None
    for rule_host, rule_path, verdict in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def judge(pages: DataFrame, rules=None) -> DataFrame:
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = named.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    scratch = Scratch(pages.sparkSession)
    edges = scratch.write(link_edges(pages), "url-edges")
    labels = scratch.write(
        connected_components(edges.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")), scratch=scratch), "url-components"
    )
    scratch.drop_all_but("url-edges", "url-components")
    # decisions of all nodes: pages and edge targets
    said = judged.select("node", "own").unionByName(
        edges.select(node_of(F.col("target")).alias("node"), rule_of(host_of(F.col("target")), path_of(F.col("target")), rules).alias("own"))
    )
    by_node = (
        said.where("node is not null and own is not null")
        .groupBy("node")
        .agg(F.max((F.col("own.verdict") == "block").cast("int")).alias("blocks"), F.max((F.col("own.verdict") == "allow").cast("int")).alias("allows"))
    )
    group = F.coalesce(F.col("label"), F.col("node")).alias("component")
    by_component = (
        by_node.join(labels, "node", "left")
        .select(group, "blocks", "allows")
        .groupBy("component")
        .agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows"))
        .where("blocks = 1 and allows = 0")
        .select("component", F.lit(True).alias("listed"))
    )
    # pages without a node have no part in the joins: their null would be one key
    with_group = judged.where("node is not null").join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    alone = judged.where("node is null").withColumn("component", F.lit(None).cast("string")).withColumn("listed", F.lit(None).cast("boolean"))
    columns = ["page_id", "host", "path", "own", "component", "listed"]
    return with_group.join(by_component, "component", "left").select(*columns).unionByName(alone.select(*columns)).select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("component").alias("alias_of"),
    )

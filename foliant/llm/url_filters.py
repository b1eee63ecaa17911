"""URL filters with redirect equivalence.

A rule names a host and a path prefix; it fits its host and all subdomains, and of the rules that fit the
longest wins. Redirects and canonical links say that two URLs are one page: connected components over those
edges are classes of aliases. A URL without a rule of its own takes its class's decision: allow if a member
is explicitly allowed, else block if a member is blocked, else the default. An explicit rule always holds for
its own URL.

Edges come from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` in each page, outside comments, scripts
and styles, and from a table of redirects where there is one. Targets needn't be pages: a blocked target
blocks its aliases. A node is a URL with scheme and host in lower case and no fragment; relative targets
are resolved against the page.

Everything is a DataFrame expression. Pages are read once for their edges and once for the result; only URLs
with edges are shuffled. Rules are a list on the driver: up to ``MAX_INLINE`` they are one CASE
expression, beyond that a table joined on host suffixes.

A null or malformed URL (no ``://``) has an empty host and path, no rule, no edges, and the default verdict. Null HTML
has no edges. Repeated pages each get a row. An empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fits, written
from foliant.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
MAX_INLINE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node, null where it has no host."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when((scheme != "") & (host_of(url) != ""), F.concat(scheme, F.lit("://"), host_of(url), F.trim(rest)))


def _resolved(base: Column, href: Column) -> Column:
    href = F.trim(href)
    scheme, site = F.regexp_extract(base, r"^([^:]*:)", 1), F.regexp_extract(base, r"^([^:]*://[^/?]*)", 1)
    page, folder = F.regexp_extract(base, r"^([^?]*)", 1), F.regexp_extract(base, r"^([^:]*://[^?]*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when((href == "") | href.startswith("#"), base)
        .otherwise(F.concat(folder, href))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from each page to what its canonical link or refresh names."""

    def attribute(name: str) -> Column:
        return F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)

    # Tags are looked for only in pages that hold one of the two words; no other page can have an edge.
    some = pages.select(node_of(F.col(url)).alias("a"), F.col(html).alias("h")).where(
        F.col("a").isNotNull() & F.col("h").rlike("(?i)canonical|refresh")
    )
    tags = some.select("a", F.explode(F.regexp_extract_all(F.regexp_replace("h", _HIDDEN, " "), F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = F.when(
        F.col("tag").rlike(r"(?is)^<link\b") & F.col("tag").rlike(
            r"(?is)\srel\s*=\s*(?:canonical\b|\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b)"
        ),
        attribute("href")
    )
    refresh = F.when(
        F.col("tag").rlike(r"(?is)^<meta\b.*\shttp-equiv\s*=\s*[\"']?\s*refresh\b"),
        F.regexp_extract("tag", r"(?is)\scontent\s*=\s*[\"']?[^\"'>;,]*[;,]\s*url\s*=\s*[\"']?([^\"'>]+)", 1)
    )
    # The few targets are a written table, so that the long expressions below aren't repeated in one another.
    found = written(
        tags.select("a", F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&").alias("target")).where("target <> ''"),
        "targets"
    )
    return found.select("a", _once(_resolved(F.col("a"), F.col("target")), node_of).alias("b")).where("b IS NOT NULL")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls(host, path, ...)`` with ``rule`` and ``decision`` of the longest rule that fits, or nulls."""
    for _, _, verdict in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"no such verdict: {verdict}")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    if len(rules) <= MAX_INLINE:
        rule = decision = F.lit(None).cast("string")
        for host, path, verdict in reversed(ordered):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, decision = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decision)
        return urls.withColumns({"rule": rule, "decision": decision})
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(-i, *r) for i, r in enumerate(ordered)], "rank long, rule_host string, rule_path string, verdict string"
    )
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = urls.select("host", "path").distinct()
    fits = keyed.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct("rank", F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("decision"))).alias("best")
    )
    return urls.join(best.select("host", "path", "best.rule", "best.decision"), ["host", "path"], "left")


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    redirects: DataFrame | None = None,
    default: str = ALLOW,
    key: str = "page_id",
    url: str = "url",
    html: str = "html"
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every page. ``redirects``: (source, target) URLs."""
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    classes = written(connected_components(edges), "aliases")
    members = with_rule(
        classes.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules
    )
    decided = members.groupBy("component").agg(
        F.max(F.when(F.col("decision") == ALLOW, 2).when(F.col("decision") == BLOCK, 1).otherwise(0)).alias("said")
    )
    alias = classes.join(decided.where("said > 0"), "component").select(
        "node", F.when(F.col("said") == 2, ALLOW).otherwise(BLOCK).alias("inherited")
    )
    rows = with_rule(
        pages.select(
            F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node")
        ),
        rules
    )
    if fits(alias):
        joined = rows.join(F.broadcast(alias), "node", "left")
    else:  # pages without a node are dealt by a key of their own, which no alias has; a hot node is split
        spread = F.coalesce("node", F.concat(F.lit("\0"), F.xxhash64(key).cast("string")))
        joined = rows.withColumn("node", spread).join(alias.hint("rebalance"), "node", "left")
    return joined.select(key, "host", "path", "rule", F.coalesce("decision", "inherited", F.lit(default)).alias("verdict"))

"""URL block and allow rules that follow redirects and canonical links.

A page's own rule decides first. Addresses that redirect or canonical links tie together are one
class; a page without a rule of its own takes its class's decision: allow if some member is
allowed by a rule, else block if some member is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import materialize, prepare
from supportlake.llm.components import components

BLOCK, ALLOW = "block", "allow"
RULES = [
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def _without_dots(path: Column) -> Column:
    """`path` without its segments . and .., which stay inside the root."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda held, part: F.when(part == ".", held)
        .when(part == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1))))
        .otherwise(F.concat(held, F.array(part))),
    )
    end = F.when(path.rlike("/\\.\\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(
        path.rlike("/\\.\\.?(/|$)"), F.concat(F.array_join(parts, "/"), end)
    ).otherwise(path)


def address_of(url: Column) -> Column:
    """The address that a class joins: without fragment and dot segments, scheme and host in
    lower case."""
    bare = F.regexp_extract(url, "^[^#]*", 0)
    scheme = F.regexp_extract(bare, "^(.*?)://", 1)
    after = _after_scheme(bare)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, "^[^/?#]*[^?#]*(.*)$", 1)
    return F.when(
        F.instr(bare, "://") > 0,
        F.concat(
            F.translate(scheme, _UP, _LOW), F.lit("://"), host_of(bare), _without_dots(path), rest
        ),
    ).otherwise(bare)


def resolve(base: Column, link: Column) -> Column:
    """`link` as an absolute url, seen from the page `base`."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    root = F.regexp_extract(base, "^[^?#]*?://[^/?#]*", 0)
    page = F.regexp_extract(base, "^[^?#]*", 0)
    folder = F.regexp_extract(page, "^(.*?://[^/]*(?:/.*)?)/", 1)
    folder = F.when(F.length(folder) > 0, folder).otherwise(root)
    return (
        F.when((F.length(link) == 0) | link.startswith("#"), base)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]*:", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) addresses that a page's canonical link or refresh ties together."""
    tags = F.regexp_extract_all("html", F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0))
    value = "\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
    attribute = lambda tag, name: F.regexp_replace(
        F.regexp_extract(tag, f"(?is)[\\s\"']{name}{value}", 1), "^[\"']|[\"']$", ""
    )
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & attribute(tag, "rel").rlike("(?i)(^|\\s)canonical(\\s|$)")
    refresh = tag.rlike("(?i)^<meta") & attribute(tag, "http-equiv").rlike("(?i)^\\s*refresh\\s*$")
    target = F.regexp_extract(attribute(tag, "content"), "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1)
    link = F.when(canonical, attribute(tag, "href")).when(refresh, target)
    found = pages.select("url", F.explode(tags).alias("tag")).select("url", link.alias("link"))
    return (
        found.filter(F.length("link") > 0)
        .select(
            address_of(F.col("url")).alias("a"),
            address_of(resolve(F.col("url"), F.col("link"))).alias("b"),
        )
        .filter(F.col("a").isNotNull())
    )


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`urls` (key, url) -> (key, rule, verdict) where a rule fits; the longest rule wins.

    Every ending of the host is looked up in the rules, so long rule lists are one equi-join.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    parts = F.split(F.col("host"), "\\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    rule = F.concat("rule_host", "rule_path")
    return (
        urls.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("key", "path", F.explode(ends).alias("rule_host"))
        .join(table, "rule_host")
        .filter(F.col("path").startswith(F.col("rule_path")))
        .groupBy("key")
        .agg(
            F.max(
                F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("rule_verdict"))
            ).alias("best")
        )
        .select("key", "best.rule", F.col("best.rule_verdict").alias("verdict"))
    )


def judge_pages(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row per page.

    `redirects` (source, target) adds known redirects to the links of the pages' html. A null
    url has an empty host and path, no class and is allowed; a null html ties nothing. Repeated
    pages are answered each. An empty table gives no rows. Other columns are not used.
    """
    prepare(pages.sparkSession)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(
            redirects.select(
                address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b")
            )
        )
    classes = materialize(components(materialize(edges.distinct(), "url-edges")), "url-classes")
    members = classes.select(F.col("node").alias("key"), "component").unionAll(
        classes.select(F.col("component").alias("key"), "component")
    ).distinct()
    ruled = match_rules(members.select("key", F.col("key").alias("url")), rules)
    decided = (
        members.join(ruled, "key")
        .groupBy("component")
        .agg(F.max((F.col("verdict") == ALLOW).cast("int")).alias("allowed"))
        .select(
            "component",
            F.when(F.col("allowed") == 1, ALLOW).otherwise(BLOCK).alias("class_verdict"),
        )
    )
    by_address = members.join(decided, "component").select(
        F.col("key").alias("address"), "class_verdict"
    )
    # Rules are matched once for each url, however many pages have it.
    own = match_rules(
        pages.filter("url is not null").select(F.col("url").alias("key"), "url").distinct(), rules
    ).select(F.col("key").alias("url"), "rule", F.col("verdict").alias("own"))
    return (
        pages.select("page_id", "url", address_of(F.col("url")).alias("address"))
        .join(own, "url", "left")
        .join(by_address, "address", "left")
        .select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
            "rule", F.coalesce("own", "class_verdict", F.lit(ALLOW)).alias("verdict"),
        )
    )

"""URL rules carried across redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm.common import read_table, settled
from copyledger.llm.components import connected_components
from copyledger.operators.keyed import join_on_groups

MAX_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUOTED = r"""(?is)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


PRODUCTION_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _rest(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """The resource a url names: host, path and query, without scheme and fragment.
    Null where there is no host."""
    rest = F.regexp_extract(_rest(url), r"\A[^/?#]*([^#]*)", 1)
    host = url_host(url)
    return F.when(host != "", F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Of two
    equal rules the allowing one wins. At most MAX_RULES rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    found = [F.regexp_extract(tag, _QUOTED % name, i) for i in (1, 2, 3)]
    return F.concat(*found)


def _without_dots(rest: Column) -> Column:
    """A path and query with the segments . and .. resolved."""
    path = F.regexp_extract(rest, r"\A[^?#]*", 0)
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda have, part: F.when(part == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0))))
        .when(part == ".", have)
        .otherwise(F.concat(have, F.array(part))),
    )
    closed = F.when(path.rlike(r"/\.\.?\z") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), closed, F.regexp_extract(rest, r"\A[^?#]*(.*)", 1))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), clean).otherwise(rest)


def _resolved(target: Column, url: Column) -> Column:
    """``target`` of a link on the page ``url`` as an absolute url; null where it
    is a fragment, has another scheme (mailto:) or the page has no host."""
    target = F.trim(target)
    path = url_path(url)
    page = F.when(path == "", F.lit("/")).otherwise(path)
    folder = F.regexp_extract(page, r"(?s)\A.*/", 0)
    rest = (
        F.when(target.startswith("/"), target)
        .when(target.startswith("?"), F.concat(page, target))
        .when(~target.startswith("#") & ~target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), F.concat(folder, target))
    )
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(url_host(url) != "", F.concat(F.lit("http://"), url_host(url), _without_dots(rest)))
    )


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>])))[^>]*>"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>"""


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls: canonical links and immediate redirects that the
    html of ``pages`` (url, html) declares, of all such tags."""
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    onward = lambda tag: F.regexp_extract(
        _attribute(tag, "content"), r"(?i)\A\s*\d+\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1
    )
    targets = F.concat(F.transform(tags(_CANONICAL), lambda tag: _attribute(tag, "href")), F.transform(tags(_REFRESH), onward))
    declared = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    links = declared.select("url", F.explode(targets).alias("target")).where("target <> ''")
    target = F.regexp_replace("target", "(?i)&amp;", "&")
    return links.select(F.col("url").alias("source"), _resolved(target, F.col("url")).alias("target")).where(
        "target is not null"
    )


def url_verdicts(
    pages: DataFrame, rules: Sequence[Rule] = PRODUCTION_RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of ``pages`` (page_id, url, html).

    A url that a rule fits gets the verdict of the longest. The others belong to
    the connected component of their resource over canonical links and
    redirects, those in the html and those given as ``redirects`` (source,
    target): it is blocked if a rule blocks a resource in it and none explicitly
    allows one, else allowed. Resources that are linked to but are no pages
    count as well.

    Null urls and those without :// have an empty host and path, fit no rule,
    link with nothing and are allowed. Repeated rows are judged each; other
    columns are ignored.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        .withColumn("rule", rule)
        .withColumn("explicit", verdict)
    )
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    ends = [
        F.struct(
            F.xxhash64(url_node(F.col(c))).alias("node"),
            match_rule(url_host(F.col(c)), url_path(F.col(c)), rules)[1].alias("verdict"),
        ).alias(c)
        for c in ("source", "target")
    ]
    named = links.where(url_node(F.col("source")).isNotNull() & url_node(F.col("target")).isNotNull())
    edges = settled(named.select(*ends).distinct())
    components = connected_components(edges.select(F.col("source.node").alias("u"), F.col("target.node").alias("v")))
    marks = edges.select(F.explode(F.array("source", "target")).alias("e")).select(F.col("e.node").alias("id"), "e.verdict").distinct()
    judged_components = (
        components.join(marks, "id")
        .groupBy("component")
        .agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
        .where("block and not coalesce(allow, false)")
    )
    blocked = settled(components.join(judged_components, "component").select(F.col("id").alias("node")).distinct())

    ruled = judged.where("explicit is not null").select("page_id", "host", "path", "rule", F.col("explicit").alias("verdict"))
    open_ = judged.where("explicit is null").withColumn("node", F.xxhash64(url_node(F.col("url"))))
    aliased = join_on_groups(open_, blocked.withColumn("hit", F.lit(True)), ["node"], "left")
    return ruled.unionByName(
        aliased.select(
            "page_id", "host", "path", "rule",
            F.when(F.col("hit") & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        )
    )


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


# Holds where no page declares a canonical link or a redirect, as in the given
# tables: then only rules decide. Links are tested against brute force.
OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT s.page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
FROM split s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
GROUP BY s.page_id
"""

r"""URL filters: rules, and block decisions carried along redirects.

A rule is ``host/path`` with a verdict; it fits its host and every subdomain
when the url's path starts with the rule's path, and the longest rule wins.
A page that no rule fits takes the decision of its aliases: urls joined by
redirects or canonical links form a connected component, and a component that
holds a blocked url blocks its members, unless it also holds an explicitly
allowed one.  A page's own rule always stands.

Edges come from ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``
in the html, from a given redirect table, and from each url to the form it
resolves to (no fragment, no tracking parameters, no scheme, default port or
last slash).

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and is allowed; repeated rows give a row each; a null html has no links.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm.components import components

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TRACKING = r"(?<=[?&])(utm_[^=&]*|gclid|fbclid)(=[^&]*)?(&|$)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """The url without what does not change the page; null without ``://``."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(url_host(url), r":(80|443)$", "")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1), _TRACKING, ""), r"[?&]+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(tail, r"/+$", "")))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null.

    ``rules`` is a parameter of the job (host, path, verdict), tried longest
    first; of equally long ones the first in (host, path) order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    chain = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return out if chain is None else chain.otherwise(out)


def _resolve(base: Column, link: Column) -> Column:
    """An absolute url of a link found on page ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link != "", F.concat(F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """``(a, b)``: urls and where their canonical link or refresh leads."""
    attribute = r"""=\s*["']?([^"'\s>]+)"""
    canonical = F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    targets = F.array(F.regexp_extract(canonical, r"(?is)\bhref\s*" + attribute, 1),
                      F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    may = F.col("html").rlike("(?i)canonical|http-equiv")
    return (pages.where(F.col("url").isNotNull() & may).select("url", F.explode(targets).alias("link")).where("link <> ''")
            .select(F.col("url").alias("a"), _resolve(F.col("url"), F.col("link")).alias("b")).where("b is not null"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], *, redirects: DataFrame | None = None,
          default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` of every page.

    ``redirects(a, b)`` holds urls and where they lead.  ``component`` is the
    smallest canonical url of the page's aliases, null if it has no alias.
    Rules decide in a projection; only urls that have an edge to another
    canonical url are shuffled.
    """
    for h, p, v in rules:
        if v not in ("allow", "block") or re.search("[A-Z]", h):
            raise ValueError(f"rule {h}{p}: {v}")
    url = F.col("url")
    seen = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"), canonical_form(url).alias("node"))
    seen = seen.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("a", "b"))
    edges = links.select(canonical_form(F.col("a")).alias("a"), canonical_form(F.col("b")).alias("b")).where("a <> b")
    member = components(spark, edges)
    # every url that an edge names counts, whether a page has it or not; so
    # does every page whose url resolves to a node: rules see the urls themselves
    named = links.select(F.explode(F.array("a", "b")).alias("url")).unionByName(seen.select("url"))
    named = named.select(canonical_form(url).alias("node"), best_rule(url_host(url), url_path(url), rules)["verdict"].alias("v"))
    decided = (named.where("node is not null and v is not null").groupBy("node", "v").count()
               .select("node", "v"))
    alone = decided.groupBy("node").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    by_group = (member.join(alone, "node").groupBy("component")
                .agg(F.max("allowed").alias("g_allowed"), F.max("blocked").alias("g_blocked")))
    groups = member.join(by_group, "component", "left").select("node", "component", "g_allowed", "g_blocked")
    # a url that no edge joins to another is a component of its own forms
    info = (alone.join(groups, "node", "full")
            .select("node", "component", F.coalesce("g_allowed", "allowed", F.lit(False)).alias("any_allow"),
                    F.coalesce("g_blocked", "blocked", F.lit(False)).alias("any_block")))
    ruled = seen.where("best is not null or node is null").select(
        "page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    open_ = seen.where("best is null and node is not null").join(info, "node", "left")
    free = open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                        F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").otherwise(default).alias("verdict"), "component")
    return ruled.unionByName(free)

"""URL filters by redirect equivalence, in DataFrame operations only.

A rule `host/path` fits its host and all subdomains if the url's path starts
with the rule's; the longest fitting rule decides. Pages that name each other by
canonical links or redirects (meta refresh; all of a page's count) are aliases:
connected components over those edges. A url that no rule fits is blocked if a rule blocks any of its
aliases, else allowed; an explicit allow always stands.

Defined cases: null urls, or urls without `://`, have empty host and path, fit no
rule and have no aliases: allowed. Null html names no alias. Repeated pages each
get a row; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower
from nearfield.llm.components import components

#: (rule, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
REST = r"^(?s:.*?)://[^/?#]*([^#]*)"
LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""

#: Characters and what stands for them in attributes; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("<", "lt|#0*60|#x0*3c"), (">", "gt|#0*62|#x0*3e"), ('"', "quot|#0*34|#x0*22"), ("'", "apos|#0*39|#x0*27"), ("/", "sol|#0*47|#x0*2f"), (":", "colon|#0*58|#x0*3a"), ("=", "equals|#0*61|#x0*3d"), ("?", "quest|#0*63|#x0*3f"), ("&", "amp|#0*38|#x0*26"))


def decoded(target: Column) -> Column:
    for char, names in ENTITIES:
        target = F.regexp_replace(target, f"(?i)&(?:{names});", char)
    return target


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, PARTS, 1)), F.regexp_extract(u, PARTS, 2)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if there is none."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _node(url: Column) -> Column:
    """What names a page: host and all that follows but the fragment; null if
    there is no host."""
    host, _ = host_path(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), REST, 1)
    return F.when(host != "", F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def edges(pages: DataFrame) -> DataFrame:
    """(a, b): the page and what it names as canonical or redirects to."""
    host, _ = host_path(F.col("url"))
    none = F.array().cast("array<string>")
    named = [F.coalesce(F.when(F.contains(F.lower("html"), F.lit(word)), F.regexp_extract_all("html", F.lit(pattern), F.lit(1))), none) for word, pattern in (("canonical", LINK), ("refresh", REFRESH))]
    raw = pages.select(_node(F.col("url")).alias("a"), host.alias("_h"), F.explode(F.concat(*named)).alias("_to")).where("_to <> '' AND a IS NOT NULL")
    found = raw.select("a", "_h", F.explode(F.array(decoded(F.col("_to")))).alias("_to"))
    full = F.when(F.col("_to").contains("://"), F.col("_to")).when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), "_to")).when(F.col("_to").startswith("/"), F.concat(F.lit("http://"), "_h", "_to")).otherwise(F.concat(F.lit("http://"), F.regexp_replace("a", r"[^/]*$", ""), "_to"))
    # explode() keeps the optimizer from copying the long expressions into the filter.
    links = found.select("a", F.explode(F.array(full)).alias("_url")).select("a", F.explode(F.array(_node(F.col("_url")))).alias("b"))
    return links.where("b IS NOT NULL AND a <> b").distinct()


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict per page, and aliases: whether an
    alias decided."""
    host, path = host_path(F.col("url"))
    rule, says = match(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("_node")).withColumns({"rule": rule, "_says": says})
    same = components(edges(pages))
    h, p = host_path(F.concat(F.lit("http://"), F.col("node")))
    named = same.select("root", "node", h.alias("host"), p.alias("path"))
    blocked = named.groupBy("root").agg(F.max(F.coalesce(match(F.col("host"), F.col("path"), rules)[1] == "block", F.lit(False))).alias("_block")).where("_block").select("root")
    spread = same.join(blocked, "root", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_spread")).distinct()
    out = judged.join(spread, "_node", "left")
    by_alias = F.col("rule").isNull() & F.coalesce("_spread", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.when(by_alias, "block").otherwise(F.coalesce("_says", F.lit("allow"))).alias("verdict"), by_alias.alias("by_alias"))

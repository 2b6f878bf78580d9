"""URL filters: rules on hosts and paths, and verdicts that spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

#: (verdict, host, path) of the rules of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """Host, path and query: what must be equal for two urls to name one page. Null without host."""
    host = url_host(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, url_path(url), query))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the page's or above it and whose path the page's starts with;
    of equally long ones a block comes first. Rules are parameters, so this is a CASE of a fixed number of branches."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _without_dots(path: Column) -> Column:
    """An absolute path with its segments . and .. taken out."""
    parts = F.split(path, "/")
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    return F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), last), "/")


def resolved_url(target: Column, url: Column) -> Column:
    """A link's target as an absolute url, read from a page's url: with scheme, from // or / on, from ?, or beside the
    page's path. Null for other schemes, for a mere fragment and, unless it is absolute, on a page without host."""
    scheme, place = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    beside = F.concat(F.regexp_extract(F.concat(F.lit("/"), F.substring(url_path(url), 2, 1 << 30)), r"(?s)^(.*/)", 1), path)
    own = F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("?"), F.concat(place, url_path(url), target))
    own = own.otherwise(F.concat(place, _without_dots(F.when(target.startswith("/"), path).otherwise(beside)), rest))
    other = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#") | (target == "") | (url_host(url) == "")
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(~other, own)


def link_targets(html: Column, url: Column) -> Column:
    """The urls that a page's canonical links and meta refreshes name, resolved from the page's own url."""
    page = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    canonical = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    refresh = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bcontent\s*=[^>]*?\burl\s*=\s*['\"]?([^\"'\s>]+)", 1))
    found = F.transform(F.concat(canonical, refresh), lambda t: resolved_url(t, F.coalesce(url, F.lit(""))))
    return F.when(page.rlike(r"(?i)canonical|refresh"), F.filter(found, lambda u: u.isNotNull())).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_aliases) of every page.

    A page that a rule fits has that rule's verdict. Any other is judged with its aliases: pages and urls that redirects
    (columns src, dst), canonical links or refreshes join are one component; if a rule allows one of its urls, all are
    allowed; else if a rule blocks one, all are blocked; else they are allowed. Components are found by star steps over
    links alone, so pages without links never take part. n_aliases counts a component's urls (1 without links). Urls
    that are null or without :// have no host, no rule and no aliases, and are allowed. Rows that repeat an id are judged
    each. Only DataFrame functions are used.
    """
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string") if html_col else F.lit(None).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"rule": rule, "own": verdict, "alias": alias_key(F.col("url"))})
    links = pages.select(url.alias("src"), F.explode(link_targets(html, url)).alias("dst"))
    if redirects is not None:
        links = links.unionAll(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    links, _ = stored(links.select("src", "dst", alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b")).filter("a is not null and b is not null").distinct(), "links")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(1).cast("long").alias("n_aliases"))
    classes = connected_components(links, "a", "b", "aliases")
    ends = links.select(F.col("a").alias("id"), F.col("src").alias("url")).unionAll(links.select(F.col("b").alias("id"), F.col("dst").alias("url")))
    _, end_verdict = fitting_rule(url_host(F.col("url")), url_path(F.col("url")), rules)
    of_class = ends.select("id", end_verdict.alias("own")).groupBy("id").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    of_class = of_class.join(classes, "id").groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"), F.count("*").alias("n"))
    of_alias = classes.join(of_class, "component").select(F.col("id").alias("alias"), "allowed", "blocked", "n")
    spread = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    return judged.join(of_alias, "alias", "left").select("page_id", "host", "path", "rule", F.coalesce("own", spread).alias("verdict"), F.coalesce("n", F.lit(1)).cast("long").alias("n_aliases"))

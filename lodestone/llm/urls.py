"""URL filters with redirect equivalence.

A rule (action, host, path) fits its host and every subdomain when the URL's path starts with the rule's path; the
longest host + path wins. A page that no rule fits takes part in the alias graph: nodes are addresses (host, path and
query, without scheme and fragment), edges lead from a page to its canonical links and to its meta-refresh targets, and
further edges (logged redirects) can be given. Within a connected component an explicitly blocked address blocks its
aliases. An explicit allow has precedence: the page it fits is allowed whatever its component says.

Defined cases: a null url or one without "://" has empty host and path, no rule and no address, so it is allowed; a null
html gives no edges; all canonical and refresh tags of a page count but those in comments, scripts and styles; relative link targets are resolved against the page's
address as in RFC 3986 (host, directory of the path, "." and "..", queries), other schemes than http(s) are no addresses; repeated pages are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut

#: (action, host, path) of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Up to so many rules are compiled into one expression; more are joined by host suffix.
COMPILED_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """host, path and query; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def without_dots(path: Column) -> Column:
    """A path that starts with '/', its segments '.' and '..' resolved."""
    segments = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array().cast("array<string>"))
    left = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(left) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(left, "/"), end)).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The address of a link target found on the page of that url; null for what is no web address or the page itself."""
    target = F.trim(F.regexp_replace(target, "&amp;", "&"))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    at, folder = F.concat(F.lit("x://"), host_of(url)), F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))
    absolute = F.when(target.rlike("^(?i)https?://"), target).when(target.startswith("//"), F.concat(F.lit("x:"), target)).when(target.startswith("/"), F.concat(at, without_dots(path), rest))
    absolute = absolute.when(target.startswith("?"), F.concat(at, path_of(url), target)).when((path != "") & ~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(at, without_dots(F.concat(folder, path)), rest))
    return address_of(absolute)


def link_targets(html: Column) -> Column:
    """The hrefs of all canonical links and the URLs of all meta refreshes, an array; null for a null html. What stands in a
    comment, script or style (to the end of the page, if it isn't closed) is no tag."""
    html = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", "")
    canonical = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""), 1)
    return F.concat(canonical, refresh)


def with_rule(pages: DataFrame, host: str, path: str, rules) -> DataFrame:
    """pages with a column _rule: struct(name, action) of the longest rule that fits, or null. rules: (action, host, path) tuples."""
    rules = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[1], r[2], r[0]))
    if len(rules) <= COMPILED_RULES:
        expr = F.lit(None).cast("struct<name:string,action:string>")
        for action, h, p in reversed(rules):
            fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
            expr = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(action).alias("action"))).otherwise(expr)
        return pages.withColumn("_rule", expr)
    spark = pages.sparkSession
    listed = spark.createDataFrame(rules, "r_action string, r_host string, r_path string")
    places = pages.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = places.select("_h", "_p", F.explode(suffixes).alias("r_host")).join(listed, "r_host").where(F.col("_p").startswith(F.col("r_path")))
    name = F.concat("r_host", "r_path")
    best = fitting.groupBy("_h", "_p").agg(F.max(F.struct(F.length(name).alias("n"), name.alias("name"), F.col("r_action").alias("action"))).alias("b"))
    best = best.select("_h", "_p", F.struct("b.name", "b.action").alias("_rule"))
    return pages.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").drop("_h", "_p")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page. redirects: more edges, columns from_url and to_url."""
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address"))
    p = with_rule(p, "host", "path", rules)
    found = pages.select(address_of(F.col("url")).alias("a"), "url", F.explode(link_targets(F.col("html"))).alias("t")).where("a is not null")
    edges = found.select("a", resolved(F.col("t"), F.col("url")).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(address_of(F.col("from_url")), address_of(F.col("to_url"))))
    edges = cut(edges.where("a is not null and b is not null and a <> b").distinct())
    # every address gets a number of its own; they are written, so that the numbers stay
    names = cut(edges.select(F.col("a").alias("name")).union(edges.select("b")).distinct().withColumn("node", F.monotonically_increasing_id()))
    of = lambda end, number: names.select(F.col("name").alias(end), F.col("node").alias(number))
    parts = components(edges.join(of("a", "u"), "a").join(of("b", "v"), "b"), "u", "v")
    place = names.select("name", F.regexp_extract("name", r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract("name", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"), "node")
    member = with_rule(place, "host", "path", rules).join(parts, "node").select("name", "component", F.col("_rule.action").alias("action"))
    bad = member.where("action = 'block'").select("component").distinct()
    blocked = member.join(bad, "component", "left_semi").select("name")
    out = p.join(blocked.withColumn("alias", F.lit(True)), F.col("address") == F.col("name"), "left")
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("alias"), "block"), F.lit("allow"))
    return out.select("page_id", "url", "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM p),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (SELECT host, path, host || path || query AS a, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'g') AS html FROM q WHERE host <> ''),
tag AS (SELECT host, path, a, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)' AS target FROM tags
  UNION ALL SELECT host, path, a, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)' FROM tags),
targets AS (SELECT host, path, a, trim(replace(regexp_extract(tag, target, 1), '&amp;', '&')) AS t FROM tag),
parted AS (SELECT *, regexp_extract(t, '(?s)^([^?#]*)', 1) AS t_path, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS t_rest FROM targets WHERE t <> ''),
placed AS (SELECT *, CASE WHEN regexp_matches(t, '^(?i)https?://') OR starts_with(t, '//') OR starts_with(t, '?') OR t_path = '' THEN NULL WHEN starts_with(t, '/') THEN t_path
                          WHEN NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '/' || regexp_extract(path, '(?s)^/(.*/)', 1) || t_path END AS full_path FROM parted),
tidy AS (SELECT *, CASE WHEN regexp_matches(full_path, '/\.\.?(/|$)') THEN
                     list_reduce(string_split(substr(full_path, 2), '/'), lambda acc, s: CASE s WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END, '') || CASE WHEN regexp_matches(full_path, '/\.\.?$') THEN '/' ELSE '' END
                   ELSE full_path END AS tidy_path FROM placed),
links AS (SELECT a, CASE WHEN regexp_matches(t, '^(?i)https?://') THEN substr(t, strpos(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3) WHEN starts_with(t, '?') THEN host || path || t WHEN tidy_path IS NOT NULL THEN host || tidy_path || t_rest END AS rest FROM tidy),
edges AS (SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) AS b FROM links WHERE regexp_extract(rest, '^([^/?#]*)', 1) <> ''),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
nodes AS (SELECT DISTINCT a AS name, regexp_extract(a, '^([^/?#]*)', 1) AS host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM both_ways),
places AS (SELECT host, path FROM q UNION SELECT host, path FROM nodes),
fit AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
        FROM places, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
reached(name) AS (
  SELECT n.name FROM nodes n JOIN fit USING (host, path) WHERE action = 'block'
  UNION SELECT b FROM reached JOIN both_ways ON a = name)
SELECT q.page_id, q.host, q.path, fit.rule, CASE WHEN fit.action IS NOT NULL THEN fit.action WHEN q.host <> '' AND q.host || q.path || q.query IN (SELECT name FROM reached) THEN 'block' ELSE 'allow' END AS verdict
FROM q LEFT JOIN fit ON q.host = fit.host AND q.path = fit.path
"""

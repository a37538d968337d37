"""Operator 10: url rules, and block decisions carried to aliases over redirects and canonical links. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import cut, table

#: (verdict, host, path) of the stated query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Up to so many rules are one expression; more are joined by host.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def same_url(url: Column) -> Column:
    """``url`` with A-Z of scheme and host lower-cased: equal for urls that differ in nothing else."""
    start = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    return F.concat(F.translate(start, _UPPER, _LOWER), F.substring(url, F.length(start) + 1, F.length(url)))


def _without_dots(path: Column) -> Column:
    """An absolute path without its segments ``.`` and ``..``; each ``..`` takes the one before with it."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    step = lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(ends, "/"))


def resolved(target: Column, base: Column) -> Column:
    """The absolute url that a link to ``target`` has in the page at ``base`` (RFC 3986); null for schemes without a host
    (``mailto:``) and for relative targets where ``base`` is not absolute."""
    scheme, site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    rest = F.substring(base, F.length(site) + 1, F.length(base))
    path, asked = F.regexp_extract(rest, r"^[^?#]*", 0), F.regexp_extract(rest, r"^[^#]*", 0)
    own, tail = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"[?#](?s:.*)$", 0)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(?s:.*)/", 0))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (site == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, _without_dots(own), tail))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("#"), F.concat(site, asked, target))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), tail))
    )


def _free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]], own: str = "own") -> DataFrame:
    """``df`` (with url) and host, path, rule (host and path of the longest rule that fits; null without one), and its verdict
    as ``own``.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of rules equally long, allow wins. Few rules
    become one expression. Many are joined by each suffix of the host, the rules being a list that the driver holds.
    """
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    best = sorted(((len(h) + len(p), v == "allow", v, h.lower(), p) for v, h, p in rules), reverse=True)
    if len(best) <= INLINE_RULES:
        rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
        for _, _, v, h, p in reversed(best):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(said)
        return df.withColumn("rule", rule).withColumn(own, said)
    known = df.sparkSession.createDataFrame([(n, int(a), v, h, p) for n, a, v, h, p in best], "n int, a int, v string, rule_host string, rule_path string")
    parts = F.split("host", r"\.")
    pairs = df.select("host", "path").distinct()
    suffixes = pairs.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    best_of, w = F.max(F.struct("n", "a", "v", "rule_host", "rule_path")), _free(df, "w")
    won = suffixes.join(known, "rule_host").filter(F.expr("startswith(path, rule_path)")).groupBy("host", "path").agg(best_of.alias(w))
    return df.join(won, ["host", "path"], "left").withColumn("rule", F.concat(f"{w}.rule_host", f"{w}.rule_path")).withColumn(own, F.col(f"{w}.v")).drop(w)


def alias_edges(pages: DataFrame, relative: bool = False) -> DataFrame:
    """(a, b) urls tied by a canonical link or a refresh redirect of the page at a. Targets that are not absolute are resolved
    against a if ``relative``, else left out; null urls and pages are left out. Of several links in a page all count; attribute order
    and case do not matter, and ``&amp;`` stands for ``&``."""
    html = F.col("html")
    canonical = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<link\b([^>]*\brel\s*=\s*[\"']?canonical\b[^>]*)>"), F.lit(1)), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*)>"), F.lit(1)), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    # most pages hold neither word, and are done after a plain search
    found = pages.filter(F.col("url").isNotNull() & (F.lower(html).contains("canonical") | F.lower(html).contains("refresh")))
    targets = found.select(F.col("url").alias("a"), F.explode(F.concat(canonical, refresh)).alias("b")).withColumn("b", F.replace("b", F.lit("&amp;"), F.lit("&")))
    if relative:
        return targets.select("a", resolved(F.col("b"), F.col("a")).alias("b")).filter("b is not null")
    return targets.filter(F.col("b").contains("://"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, other columns of any names but host, path, rule and verdict) and host, path, rule, verdict.

    A url that a rule fits gets that rule's verdict. Any other gets it from its aliases, the urls that ``edges`` (a, b: redirects
    and canonical links, in either direction, of any length) tie to it: allow if a rule allows one of them, else block if a rule
    blocks one, else allow. Schemes and hosts of any case are the same. Aliases need not be pages themselves. Null urls and urls without ``://`` have an empty host and path,
    no rule unless one fits that, and are allowed. Repeated rows are judged alike; an empty table gives an empty one.
    """
    own, same, carry = _free(pages, "own"), _free(pages, "same"), _free(pages, "carried")
    judged = with_rules(pages, rules, own)
    edges = None if edges is None else cut(edges.select(same_url(F.col("a")).alias("a"), same_url(F.col("b")).alias("b")).distinct(), "aliases")
    if edges is None or edges.isEmpty():
        return judged.withColumn("verdict", F.coalesce(own, F.lit("allow"))).drop(own)
    tied = components(edges, one_task=0)
    ruled = with_rules(tied.withColumnRenamed("node", "url"), rules)
    carried = ruled.groupBy("root").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    said = tied.join(carried, "root").filter("coalesce(allowed, 0) = 0 and blocked = 1").select(F.col("node").alias(same), F.lit("block").alias(carry))
    return judged.withColumn(same, same_url(F.col("url"))).join(said, same, "left").withColumn("verdict", F.coalesce(own, carry, F.lit("allow"))).drop(own, same, carry)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), RULES, alias_edges(pages.select("url", "html"), relative=True)).select("page_id", "host", "path", "rule", "verdict")


_FITS = "when {c}(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{x}'"
_BEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_SITE = "[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*"
_SAME = f"translate(regexp_extract({{0}}, '^{_SITE}'), '{_UPPER}', '{_LOWER}') || substr({{0}}, len(regexp_extract({{0}}, '^{_SITE}')) + 1)"
OP10_SQL = f"""
with recursive p as (select page_id, url, html, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
e0 as (select url as a, unnest(list_transform(regexp_extract_all(html, '(?i)<link\\b([^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*)>', 1), lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1))
      || list_transform(regexp_extract_all(html, '(?i)<meta\\b([^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*)>', 1), lambda t: regexp_extract(t, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1))) as t from pages where url is not null),
e1 as (select a, replace(t, '&amp;', '&') as t, regexp_extract(a, '^{_SITE}') as site, substr(a, len(regexp_extract(a, '^{_SITE}')) + 1) as rest from e0),
e2 as (select *, regexp_extract(rest, '^[^?#]*') as up, regexp_extract(t, '^[^?#]*') as own, regexp_extract(t, '[?#](?s:.*)$') as tail from e1),
e3 as (select *, string_split(substr(case when starts_with(own, '/') then own when up = '' then '/' || own else regexp_extract(up, '^(?s:.*)/') || own end, 2), '/') as parts from e2),
e4 as (select *, list_reduce(parts, lambda s, x: case when x = '.' then s when x = '..' then regexp_replace(s, '/[^/]*$', '') else s || '/' || x end, '') || case when parts[-1] in ('.', '..') then '/' else '' end as way from e3),
e as (select a, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\\-]*://') then t when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\\-]*:') or site = '' then null
  when starts_with(t, '//') then regexp_extract(a, '^([A-Za-z][A-Za-z0-9+.\\-]*:)//', 1) || t
  when starts_with(t, '?') then site || up || t when starts_with(t, '#') then site || regexp_extract(rest, '^[^#]*') || t
  else site || way || tail end as b from e4),
s as (select {_SAME.format("a")} as a, {_SAME.format("b")} as b from e where b is not null),
b as (select a, b from s union select b, a from s),
r as (select a as node, a as seen from b union select r.node, b.b from r join b on r.seen = b.a),
n as (select node, seen, translate(coalesce(regexp_extract(seen, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(seen, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from r),
c as (select node, max((own = 'allow')::int) as allowed, max((own = 'block')::int) as blocked from (select node, case {' '.join(_FITS.format(c='', h=h, p=q, x=v) for v, h, q in _BEST)} end as own from n) group by node)
select page_id, host, path, case {' '.join(_FITS.format(c='', h=h, p=q, x=h + q) for v, h, q in _BEST)} end as rule,
  case {' '.join(_FITS.format(c='', h=h, p=q, x=v) for v, h, q in _BEST)} when coalesce(c.allowed, 0) = 0 and c.blocked = 1 then 'block' else 'allow' end as verdict
from p left join c on c.node = {_SAME.format("url")}
"""

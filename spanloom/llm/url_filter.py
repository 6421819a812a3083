"""URL filters with redirect equivalence.

A page's own rule, the longest that fits its url, decides first. Pages without one
share the fate of their aliases: canonical links, refresh redirects and equal urls make edges, their
connected components are classes of equivalence, and a class with a blocked member (a page, or an url that a link names)
blocks all members that no rule allows. An explicit allow of a page always wins for
that page; it does not lift the block from its aliases. Where nothing blocks, the
verdict is allow.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and no
aliases of its own, and is allowed. Null or broken html has no links. Repeated rows give repeated
results. Links of every canonical and refresh tag count; relative ones are resolved against the page's url (its
directory, or its path for a query alone), dot segments are removed, and a link of a scheme without ``//`` names no page.
A ``base`` tag is not read. Very long urls and pages are read whole. Rules of one length: the first named; classes have no
ties, as one blocked member decides. An empty table gives an empty result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, hot_keys, join_spread
from spanloom.llm.components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rule set of the registered query (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b[^>]*(?<![\w-])rel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (verdict, name); null if none does. Rules of equal length: the first named."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        this = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))
        out = F.when(fits, this).otherwise(out)
    return out


def _undotted(path: Column) -> Column:
    """``path``, which begins with a slash, without its dot segments."""
    steps = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    walk = lambda seen, s: F.when(s == ".", seen).when(s == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(s)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(kept, ends), "/"))).otherwise(path)


def _resolve(link: Column, scheme: Column, host: Column, path: Column) -> Column:
    """An absolute url for ``link`` as found on a page of ``host`` and ``path``; null where it names no page."""
    link = F.regexp_replace(F.replace(link, F.lit("&amp;"), F.lit("&")), r"^\s+|\s+$", "")
    site, folder = F.concat(scheme, F.lit("://"), host), F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | link.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def identity(url: Column) -> Column:
    """What makes two urls one node: host and the rest without its fragment and dot segments; the scheme does not count."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    return F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(_undotted(path(url))), query)


def links(pages: DataFrame) -> DataFrame:
    """(a, b): identities of each page and of what its canonical and refresh links name."""
    tags, metas = F.regexp_extract_all("html", F.lit(_LINK), 0), F.regexp_extract_all("html", F.lit(_REFRESH), 0)
    hrefs = F.transform(tags, lambda t: F.concat(*(F.regexp_extract(t, _HREF, k) for k in (1, 2, 3))))
    targets = F.transform(metas, lambda t: F.regexp_extract(t, _TARGET, 1))
    found = pages.filter(F.col("url").contains("://") & (F.col("html").rlike(_LINK) | F.col("html").rlike(_REFRESH)))
    named = found.select("url", F.explode(F.concat(hrefs, targets)).alias("link"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    ends = named.select(identity(F.col("url")).alias("a"), _resolve(F.col("link"), scheme, host(F.col("url")), path(F.col("url"))).alias("to"))
    return ends.filter(F.col("to").contains("://")).select("a", identity(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Verdicts on every row of ``pages`` (page_id, url, html). ``redirects`` (source, target urls) adds edges to those found in the html."""
    edges = links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(identity(F.col("source")).alias("a"), identity(F.col("target")).alias("b")))
    url = F.col("url")
    parts = pages.select("page_id", url, host(url).alias("host"), path(url).alias("path"))
    ruled = parts.withColumn("hit", best_rule(F.col("host"), F.col("path"), rules)).withColumn("node", F.when(url.contains("://"), identity(url)))
    ruled = cut(ruled.select("page_id", "host", "path", "hit", "node"))
    # one row an identity: pages of one url meet in partial sums, before any exchange
    nodes = cut(ruled.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("hit.verdict") == "block").cast("int")).alias("bad")))
    classes = components(edges)
    tied = nodes.join(classes.hint("merge"), "node")
    # what a link names need not be a page of the table: the rules know it all the same
    name = F.col("node")
    named = classes.withColumn("hit", best_rule(F.substring_index(name, "/", 1), F.regexp_extract(name, r"(?s)^[^/]*([^?]*)", 1), rules))
    tied = tied.select("root", "bad").unionByName(named.select("root", F.coalesce(F.col("hit.verdict") == "block", F.lit(False)).cast("int").alias("bad")))
    bad_roots = tied.groupBy("root").agg(F.max("bad").alias("bad")).filter("bad = 1").select("root", F.lit(True).alias("taken"))
    # a page that no edge touches is a class of its own: what is blocked there is blocked by a rule of one of its equal urls
    sizes = classes.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    reached = join_spread(classes, bad_roots, "root", hot_keys(sizes, "root", "n", classes.count())).filter("taken").select("node")
    tainted = reached.unionByName(nodes.filter("bad = 1").select("node")).distinct().withColumn("tainted", F.lit(True))
    out = join_spread(ruled, tainted, "node", hot_keys(nodes, "node", "n", ruled.count()))
    own = F.when(F.col("tainted"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("hit.name").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"))

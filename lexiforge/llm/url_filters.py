"""URL filters: host and path rules, carried over redirect equivalences.

1. Each url gets the longest rule that fits its host (or a parent domain) and
   the start of its path. The rule list is compiled into one projection.
2. Redirect and canonical-link edges join urls that name one page. Connected
   components over these edges (``components.connected_components``) carry
   decisions to aliases that no rule fits: an explicitly allowed alias makes
   its undecided aliases allowed; else a blocked alias makes them blocked;
   what nothing decides is allowed. A url's own rule always stands.

All of it is DataFrame work. Only urls that occur in an edge are shuffled.

Defined results: null url or no ``://``: host and path are empty and no rule
fits; null html: no edges; repeated rows are judged alike, each on its own
row; an empty table gives an empty result; clashing columns are kept apart,
since the operator only adds columns to a struct of the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str   # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules: verdict, host, path.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: ASCII letters, for lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Struct(rule, verdict) of the longest fitting rule; a longer host breaks ties."""
    found = []
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found.append(F.when(fits, F.struct(F.lit(r.name).alias("rule"),
                                           F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """One name for a url in edges: scheme and host lower-cased, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.translate(F.regexp_extract(bare, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(
        scheme, F.lit("://"), host_of(bare), F.when(rest.startswith("/"), rest)
        .otherwise(F.concat(F.lit("/"), rest))))


def resolve(href: Column, base: Column) -> Column:
    """An absolute url for ``href`` found on the page ``base``."""
    h = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (F.when(h.contains("://"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(site, h))
            .when(h != "", F.concat(folder, h)))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of all canonical links and meta refreshes of each page."""
    text = F.col(html)
    link = F.regexp_extract_all(text, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?(?<=[\s\"'/])href"
                                            r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), 1)
    meta = F.regexp_extract_all(text, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent"
                                            r"\s*=\s*[\"']?\s*[\d.]+\s*[;,]\s*url\s*=\s*'?([^\"'>\s]+)"), 1)
    some = F.col(html).rlike(r"(?i)canonical|http-equiv")   # most pages have neither
    hrefs = F.when(some, F.concat(link, meta)).otherwise(F.array().cast("array<string>"))
    href = F.regexp_replace("href", r"^[\"']|[\"']$", "")
    found = (pages.where(F.col(url).contains("://") & F.col(html).isNotNull())
             .select(F.col(url).alias("base"), F.explode(hrefs).alias("href"))
             .select("base", href.alias("href")).where("href != ''"))
    return (found.select(node_of(F.col("base")).alias("src"),
                         node_of(resolve(F.col("href"), F.col("base"))).alias("dst"))
            .where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct())


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url",
                html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Add host, path, rule, verdict and ``decided_by`` (rule, alias or default).

    ``redirects``: an optional table of further edges (src, dst: urls). Judged
    columns replace columns of the same name.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "decided_by")]
    # the row travels in a struct, so no column of the caller's can clash
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").alias("u"))
    d = d.select("row", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    d = d.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    edges = []
    if html is not None and html in pages.columns:
        edges.append(page_edges(pages, url, html))
    if redirects is not None:
        edges.append(redirects.select(node_of(F.col("src")).alias("src"),
                                      node_of(F.col("dst")).alias("dst"))
                     .where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct())
    all_edges = None
    for e in edges:
        all_edges = e if all_edges is None else all_edges.unionByName(e)
    comps = None if all_edges is None else connected_components(all_edges, python=False)
    if comps is None:
        d = d.withColumn("_alias", F.lit(None).cast("string"))
    else:
        own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
        said = comps.withColumn("own", own)
        by_comp = said.groupBy("component").agg(
            F.max(F.col("own") == "allow").alias("any_allow"),
            F.max(F.col("own") == "block").alias("any_block"))
        aliases = (said.select("node", "component").join(by_comp, "component")
                   .select("node", F.when(F.col("any_allow"), "allow")
                           .when(F.col("any_block"), "block").alias("_alias")))
        # rows whose url is no node (null, or without ://) are spread, not sent to one task
        n = node_of(F.col("u"))
        spread = F.concat(F.lit("\u0000"), F.xxhash64(
            *[F.col("row").getField(f.name) for f in pages.schema if "map<" not in f.dataType.simpleString()]).cast("string"))
        d = d.withColumn("_n", F.coalesce(n, spread)).join(aliases, F.col("_n") == F.col("node"), "left")
    rule, said = F.col("_r")["verdict"], F.col("_alias")
    return d.select(*[F.col("row").getField(c).alias(c) for c in keep], "host", "path", F.col("_r")["rule"].alias("rule"),
                    F.coalesce(rule, said, F.lit("allow")).alias("verdict"),
                    F.when(rule.isNotNull(), "rule").when(said.isNotNull(), "alias")
                    .otherwise("default").alias("decided_by"))

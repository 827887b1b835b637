"""URL verdicts: the longest fitting rule, else trust and distrust propagated over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _under(host: Column, parent: str) -> Column:
    return (host == parent) | host.endswith("." + parent)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(_under(host, h) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _parsed(url: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(host, path, rule, verdict, site): a host's pages that a rule judges are a site of their own, apart from its other pages."""
    host, path = host_of(url), path_of(url)
    judged = rule_of(host, path, rules)
    site = F.concat(host, F.lit(" "), F.coalesce(judged["verdict"], F.lit("")))
    return F.struct(host.alias("host"), path.alias("path"), judged["rule"].alias("rule"), judged["verdict"].alias("verdict"), site.alias("site"))


def site_edges(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst (struct host, verdict, site), links: absolute links between different hosts, counted; links within a host carry no judgement of another."""
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1)))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    end = lambda c: F.struct(c["host"].alias("host"), c["verdict"].alias("verdict"), c["site"].alias("site"))
    links = pages.select(F.col(url_col).alias("url"), link.alias("to")).select(end(_parsed(F.col("url"), rules)).alias("src"), end(_parsed(to, rules)).alias("dst"))
    return links.where("src.host <> '' and dst.host <> '' and src.host <> dst.host").groupBy("src", "dst").agg(F.count("*").alias("links"))


def listed(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, listed: the verdict in seeds (host, verdict) of the longest host that it equals or lies under; block, where both are given.

    hosts: host, distinct. A host of more than 253 characters is no name and has no parents. Hosts that nothing lists are left out.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.posexplode(F.when(F.length("host") <= 253, parents).otherwise(F.array("host"))).alias("skip", "parent"))
    named = seeds.select(_lower(F.col("host")).alias("parent"), F.col("verdict").alias("listed"))
    return each.join(named, "parent").groupBy("host").agg(F.min_by("listed", F.struct("skip", F.col("listed") != "block")).alias("listed"))


def trust_ranks(sites: DataFrame, share: DataFrame, damping: float, steps: int, tolerance: float) -> DataFrame:
    """site, trust: personalised PageRank with restarts at the trusted sites, in units of a seed (the sum is their number).

    rank = (1 - damping) * seed + damping * (what linking sites pass on, by their share of links); what sites without links
    hold returns to the seeds. sites: site, trusted; share: src, dst, part. Each round is a table in the shared folder, so a
    lost executor costs one round at most.
    """
    ends = share.select(F.col("src").alias("site")).distinct().withColumn("passes", F.lit(True))
    base = written(sites.join(ends, "site", "left").select("site", F.col("trusted").cast("double").alias("seed"), F.coalesce("passes", F.lit(False)).alias("passes")), "seeds")
    held = F.sum(F.when(F.col("passes"), 0.0).otherwise(F.col("rank")))
    rank = base.select("site", "passes", F.col("seed").alias("rank"))
    total, lost = rank.agg(F.sum("rank"), held).first()
    for _ in range(steps if total else 0):
        got = share.join(rank.select(F.col("site").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("part") * F.col("rank")).alias("got"))
        new = base.join(got, base.site == got.dst, "left").join(rank.select("site", F.col("rank").alias("old")), "site")
        new = new.select("site", "passes", "old", (F.col("seed") * (1 - damping + damping * lost / total) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = written(new, "trust")
        moved, lost = new.agg(F.max(F.abs(F.col("rank") - F.col("old"))), held).first()
        rank = new.select("site", "passes", "rank")
        if moved <= tolerance:
            break
    return rank.select("site", F.col("rank").alias("trust"))


def distrust_ranks(sites: DataFrame, share: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """site, distrust: 1 for blocked sites, 0 for trusted ones, else damping * the mean distrust of what the site links to, by links.

    That is the personalised PageRank that blocked seeds receive from a walk that starts at the site, found by passing distrust
    against the links: the damped chance that the walk ends up at a blocked site. It does not fall with the number
    of sites that link to the same one. Rounds only raise it, and each moves it by `damping` times the last at most, so they end.
    """
    now = sites.select("site", "trusted", F.col("blocked").cast("double").alias("distrust"))
    free = share.join(sites.where("not trusted and not blocked").select(F.col("site").alias("src")), "src", "left_semi")
    free = written(free, "free")
    while True:
        got = free.join(now.where("distrust > 0").select(F.col("site").alias("dst"), "distrust"), "dst").groupBy("src").agg(F.sum(F.col("part") * F.col("distrust")).alias("got"))
        new = now.withColumnRenamed("distrust", "old").join(got, F.col("site") == got.src, "left")
        new = written(new.select("site", "trusted", "old", F.greatest("old", damping * F.coalesce("got", F.lit(0.0))).alias("distrust")), "distrust")
        moved = new.agg(F.max(F.col("distrust") - F.col("old"))).first()[0]
        now = new.select("site", "trusted", "distrust")
        if moved is None or moved <= tolerance:
            return now.select("site", "distrust")


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    seeds: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    steps: int = 30,
    tolerance: float = 1e-3,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    Nodes of the link graph are hosts; the pages of a host that a rule allows or blocks are a node apart, so that a rule on
    one path says nothing about the host's other pages. Trusted and blocked seeds are the nodes that rules judge, and the
    hosts, with their subdomains, that `seeds` (host, verdict; any size, the longest host wins) lists. Trust is a personalised PageRank along
    links, distrust flows from blocked seeds against them. A page has the verdict of its rule; else that of its host in seeds;
    else it is blocked if its host's distrust is at least `threshold` and above its trust. A host that nothing speaks against is allowed.

    A null url, or one without "://", has empty host and path, fits no rule and is allowed. Null html has no links. Repeated
    pages are judged alike, and their links count as often.
    """
    parsed = pages.select(F.col(id_col), _parsed(F.col(url_col), rules).alias("p")).select(id_col, "p.*")
    edges = written(site_edges(pages, rules, url_col, html_col), "links")
    ends = parsed.select("host", "verdict", "site").union(edges.select("src.*")).union(edges.select("dst.*"))
    sites = ends.where("host <> ''").distinct()
    if seeds is None:
        sites = sites.withColumn("listed", F.lit(None).cast("string"))
    else:
        sites = sites.join(listed(sites.select("host").distinct(), seeds), "host", "left")
    fixed = F.coalesce("verdict", "listed")
    sites = written(sites.select("site", "listed", F.coalesce(fixed == "allow", F.lit(False)).alias("trusted"), F.coalesce(fixed == "block", F.lit(False)).alias("blocked")), "sites")
    out = edges.groupBy("src.site").agg(F.sum("links").alias("total")).withColumnRenamed("site", "src")
    share = edges.select(F.col("src.site").alias("src"), F.col("dst.site").alias("dst"), "links").join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("part"))
    share = written(share, "shares")
    ranks = trust_ranks(sites, share, damping, steps, tolerance).join(distrust_ranks(sites, share, damping, tolerance), "site").join(sites.select("site", "listed"), "site")
    none = F.lit(0.0)
    judged = parsed.join(ranks, "site", "left").withColumns({"trust": F.coalesce("trust", none), "distrust": F.coalesce("distrust", none)})
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("verdict", "listed", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")

"""URL filters: rules first, link-graph trust and distrust for the rest.

A url's host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; its path goes on to ``?``, ``#`` or the end. A rule (host, path) fits the host and all its
subdomains if the url's path starts with the rule's; the longest fitting rule wins.

Hosts are nodes; an edge leads from a page's host to a host that the page links to (href or src) or names in
its footer. Trust is personalised PageRank from the hosts of allowed pages along the edges, distrust the same
from the hosts of blocked pages against them (who links to bad hosts is suspect). Both start at seed weights
that are the share of a host's pages that rules allow or block. A page without a rule is blocked if its host's
distrust exceeds ``threshold`` times its trust. Hosts on no path from a seed have neither and are allowed.

Null urls and urls without ``://`` have an empty host and path and are allowed; the empty host is no node. Each row is a page,
also repeated ones, whose links count again. Pages are searched whole; an empty table gives an empty one. A host whose
distrust equals ``threshold`` times its trust is allowed. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, durable, salted_join

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    rule = verdict = None
    for at, start, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, at + start) if rule is None else rule.when(fits, at + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def judged_pages(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "by_rule": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight (pages): hosts that the pages of pages(host, html) link to or name in the footer."""
    html = F.coalesce("html", F.lit(""))
    links = F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z]+:)?//([^/?#"'\s>]+)"""), F.lit(1))
    footer = F.substring_index(html, "<footer", -1)
    named = F.regexp_extract_all(F.when(F.contains(html, F.lit("<footer")), footer).otherwise(""), F.lit(r"(?<![A-Za-z0-9.@-])((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![A-Za-z0-9-])"), F.lit(1))
    targets = F.array_distinct(F.transform(F.concat(links, named), ascii_lower))
    rows = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return rows.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def pageranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """kind, host, rank: personalised PageRank of seeds(kind, host, weight) along edges(kind, src, dst, weight).

    Each kind is a ranking of its own. Weights are scaled to shares on both sides. What a host without edges
    holds goes back to the seeds, so a kind's ranks sum to 1. After each round ranks go to a durable table.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = durable(seeds.join(F.broadcast(total), "kind").where("weight > 0").select("kind", "host", (F.col("weight") / F.col("all")).alias("seed")), "url-seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = durable(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")), "url-shares")
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        flow = ranks.join(shares, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        kept = flow.groupBy("kind").agg(F.sum("got").alias("kept"))  # a row a kind
        both = start.join(flow, ["kind", "host"], "full").join(F.broadcast(kept), "kind", "left")
        fresh = both.select("kind", "host", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping * F.coalesce("kept", F.lit(0.0))) * F.coalesce("seed", F.lit(0.0))).alias("rank"))
        nxt = durable(fresh, "url-ranks")
        discard(ranks)
        ranks = nxt
    return ranks


def host_scores(pages: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """host, trust, distrust for the hosts of pages(host, by_rule, html), and those they link to."""
    edges = durable(host_edges(pages), "url-edges")
    shares = [(F.count_if(F.col("by_rule") == what) / F.count("*")).alias(kind) for kind, what in (("trust", "allow"), ("distrust", "block"))]
    seeds = pages.where("host <> ''").groupBy("host").agg(*shares).unpivot("host", ["trust", "distrust"], "kind", "weight").where("weight > 0")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    ranks = pageranks(both, seeds, damping, rounds)
    return ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind) for kind in ("trust", "distrust")])


def filtered(pages: DataFrame, rules: tuple = RULES, threshold: float = 1.0, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page."""
    rows = judged_pages(pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")), rules)
    scores = host_scores(rows, **options)
    out = salted_join(rows.select("page_id", "host", "path", "rule", "by_rule"), scores, "host").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))

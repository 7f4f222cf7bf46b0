"""URL filters: rules first, then trust and distrust propagated over the host graph."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: (verdict, host, path prefix); fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link, or of one that takes its scheme from the page.
LINK = "(?i)href\\s*=\\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'<>\\s]+)"
DAMPING = 0.85
#: A walk ends when a round moves less than this much of the mass, or after ROUNDS, by which the damping alone has left less.
#: BETWEEN: rounds from one lineage cut to the next.
TOLERANCE, ROUNDS, BETWEEN = 1e-5, 100, 6
#: A host that no rule decides is blocked if its distrust exceeds RATIO times its trust, and LIFT times what reaches it in a
#: walk from all pages alike: where blocked pages are rare all around it, a little distrust says nothing.
RATIO, LIFT = 1.0, 0.25


def host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; null or no `://`: empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add host, path, rule (the longest that fits, else null) and its verdict (else null) as `ruled`."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumns({"rule": rule, "ruled": ruled})


def ancestors(hosts: DataFrame) -> DataFrame:
    """src, dst: each host, and each domain above it that has two labels or more, with the next one above. Numeric
    addresses have none above them."""
    labels = F.split("host", "\\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.where((F.size(labels) > 2) & ~F.col("host").rlike("^[0-9.]+(:[0-9]*)?$")).select(chain.alias("chain"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("chain") - 2), lambda i: F.struct(F.get("chain", i).alias("src"), F.get("chain", i + 1).alias("dst")))
    return named.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted edges src, dst, w between different hosts: links in html with a host of their own (w = pages that hold
    one), and an edge either way (w = 1) between a host or domain and the domain above it. Domains are nodes whether or
    not they have pages, so hosts under one domain are tied. Relative links stay on their host and add no edge.

    Distinct edges only: a third of all rows on one host collapses in the partial aggregation.
    """
    links = (
        pages.where((F.col("host") != "") & F.col("html").isNotNull())
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("raw"))
        .select("src", F.translate("raw", UPPER, LOWER).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    )
    linked = links.select(F.col("dst").alias("host"))
    up = ancestors(pages.where(F.col("host") != "").select("host").unionByName(linked).distinct())
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


class Walks(NamedTuple):
    """kind, host, score of some walks, the rounds that were run, and the mass that the last of them moved."""

    scores: DataFrame
    rounds: int
    moved: float


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> Walks:
    """Walks of several kinds side by side: edges (kind, src, dst, w), seed masses (kind, host, mass), scored once the
    scores have settled, or after the given rounds. Masses are normalised to 1 for each kind, and a kind without mass has
    no scores; what reaches a host without out-edges leaves the walk. Each round is one join, in which a host with very
    many out-edges can be split as any skewed join, and one sum with partial sums per task."""
    totals = seeds.where("mass > 0").groupBy("kind").agg(F.sum("mass").alias("total"))
    base = cut(seeds.where("mass > 0").join(F.broadcast(totals), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("score")), "seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("out_w"))
    shares = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("out_w")).alias("p")), "shares")
    restart = base.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    score, done, change = base, 0, float("inf")
    most = ROUNDS if rounds is None else rounds
    while done < most and (rounds is not None or change >= TOLERANCE):
        following, n = score, min(BETWEEN, most - done)
        for turn in range(n):
            before = following.select("kind", F.col("host").alias("src"), "score")
            moved = shares.join(before, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
            parts = moved.unionByName(restart).withColumn("old", F.lit(0.0))
            if turn == n - 1:
                parts = parts.unionByName(before.select("kind", F.col("src").alias("host"), F.lit(0.0).alias("score"), F.col("score").alias("old")))
            following = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
        following = cut(following, "rank")
        if done:
            discard(score)
        score, done = following, done + n
        change = following.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
    return Walks(score.select("kind", "host", "score"), done, change)


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, lift: float = LIFT, rounds: int | None = None) -> DataFrame:
    """Every row of pages (page_id, url, html) with host, path, rule, verdict, trust, distrust and reach.

    Trusted seeds are hosts with pages that an allow rule decides, blocked seeds those with pages that a block rule
    decides, each weighted by the number of such pages. Trust follows the links; distrust follows them backwards, to
    hosts that link to blocked ones; reach is what distrust would be if all pages were blocked. Where no rule decides, a
    host is blocked if distrust > ratio * trust and distrust > lift * reach, else allowed; hosts that no walk reaches, and
    rows without a host, are allowed. Null urls have empty host and path, repeated rows are judged alike, null html has
    no links, other columns are dropped, and an empty table gives an empty result.
    """
    ruled = with_rule(pages.select("page_id", "url", "html"), rules)
    by_host = cut(
        ruled.where("host <> ''").groupBy("host").agg(
            F.sum(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trust"),
            F.sum(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("distrust"),
            F.count("*").cast("double").alias("reach"),
        ), "hosts")
    edges = cut(host_edges(ruled), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    kinds = {"trust": edges, "distrust": back, "reach": back}
    ways = functools.reduce(DataFrame.unionByName, [e.select(F.lit(k).alias("kind"), "src", "dst", "w") for k, e in kinds.items()])
    seeds = functools.reduce(DataFrame.unionByName, [by_host.select(F.lit(k).alias("kind"), "host", F.col(k).alias("mass")) for k in kinds])
    walks = personalised_pagerank(ways, seeds, rounds)
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    scored = walks.scores.groupBy("host").agg(*map(score, kinds))
    spread = ruled.drop("html", "url").join(scored, "host", "left").fillna(0.0, list(kinds))
    verdict = F.coalesce("ruled", F.when((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > lift * F.col("reach")), "block").otherwise("allow"))
    return spread.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *kinds)

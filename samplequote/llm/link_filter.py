"""Operator 3: URL filter by rules and by trust in the link graph.

Rules name a host and a path; a rule fits the host and its subdomains where the
url's path starts with the rule's, and the longest rule wins. Pages without a
rule get their host's verdict from the link graph: links of the pages become
host edges, counted per pair of hosts before they shuffle. Trust is a
personalised PageRank from the hosts most of whose pages a rule allows;
distrust is the same on reversed edges from the hosts most of whose pages a rule
blocks, so that hosts linking to blocked ones share their fate. Both are iterated
until one more link adds no more than ``TOLERANCE`` to any host's score, as a part of
it (a host reached for the first time gets all of it), so chains of links count at
any length: as many rounds as the longest chain, and in cycles about 85 more. What
is left out is under 6 times ``TOLERANCE`` of all scores together. A host with
``distrust > block_share * (trust + distrust)`` is blocked, any other allowed.

Null urls and urls without ``://`` have empty host and path; they fit no rule
and have no links to judge them by, so they are allowed. Relative links stay on
their host and carry nothing. Repeated rows give one result row each; an empty
table gives none; a table without html is judged by its rules alone.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored

#: The rules of the registered query (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What the last round may add to a score, as a part of that score.
TOLERANCE = 1e-6
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, of (host, html) rows."""
    links = pages.select("host", F.explode(F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return (links.select(F.col("host").alias("src"), target.alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """host, score: PageRank over (src, dst, n) that restarts at ``seeds`` (host,
    share; shares sum to 1), after a fixed number of rounds. Mass that reaches a host
    without links goes back to the seeds."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    steps = stored(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("p")), "link-steps")
    score = seeds.select("host", F.col("share").alias("score"))
    for _ in range(rounds):
        moved = (steps.join(score, steps.src == score.host).groupBy("dst")
                 .agg(F.sum(F.col("p") * F.col("score")).alias("got")))
        moved = stored(moved, "rank-moved")
        kept = moved.agg(F.sum("got").alias("s")).first().s or 0.0
        back = 1.0 - damping * kept
        score = (moved.select(F.col("dst").alias("host"), (F.col("got") * damping).alias("score"))
                 .unionByName(seeds.select("host", (F.col("share") * back).alias("score")))
                 .groupBy("host").agg(F.sum("score").alias("score")))
    return score


def settled_rank(edges: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    """host, score: what ``personalised_rank`` tends to. As the mass without links goes
    back to the seeds, that is the sum of what walks of 0, 1, 2, ... links from the seeds
    bring to a host, divided by the total. Walks grow until one more link adds no more
    than ``TOLERANCE`` of any host's score."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    steps = stored(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out") * damping).alias("p")), "link-steps")
    walks = stored(seeds.select("host", F.col("share").alias("last"), F.col("share").alias("all")), "walks")
    while True:
        moved = steps.join(walks.where("last > 0"), steps.src == walks.host).select(
            F.col("dst").alias("host"), (F.col("p") * F.col("last")).alias("last"))
        both = moved.select("host", "last", F.col("last").alias("all")).unionByName(walks.select("host", F.lit(0.0).alias("last"), "all"))
        walks = stored(both.groupBy("host").agg(F.sum("last").alias("last"), F.sum("all").alias("all")), "walks")
        # a host reached for the first time changes by all of its score
        r = walks.where("all > 0").agg(F.max(F.col("last") / F.col("all")).alias("change"), F.sum("all").alias("total")).first()
        if (r.change or 0.0) <= TOLERANCE:
            break
    return walks.select("host", (F.col("all") / F.lit(r.total or 1.0)).alias("score"))


def _seeds(hosts: DataFrame, share: str) -> DataFrame:
    """Hosts of which more than half the pages are ruled so, their shares summing to 1."""
    chosen = hosts.where(F.col(share) > 0.5).select("host", F.col(share).alias("w"))
    total = chosen.agg(F.sum("w").alias("s")).first().s or 1.0
    return chosen.select("host", (F.col("w") / F.lit(total)).alias("share"))


def judge(pages: DataFrame, rules=RULES, rounds: int | None = None, damping: float = 0.85, block_share: float = 0.5,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each page."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    share = [F.avg(F.when(F.col("ruled") == k, 1.0).otherwise(0.0)).alias(k) for k in ("allow", "block")]
    hosts = stored(ruled.where("host <> ''").groupBy("host").agg(*share), "hosts")
    trust, distrust = _seeds(hosts, "allow"), _seeds(hosts, "block")
    edges = stored(host_edges(named), "host-edges")
    if not edges.isEmpty():
        def rank(links: DataFrame, seeds: DataFrame) -> DataFrame:
            return settled_rank(links, seeds, damping) if rounds is None else personalised_rank(links, seeds, rounds, damping)
        trust = rank(edges, trust).select("host", F.col("score").alias("share"))
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        distrust = rank(turned, distrust).select("host", F.col("score").alias("share"))
    scores = reduce(DataFrame.unionByName, [
        trust.select("host", F.col("share").alias("trust"), F.lit(0.0).alias("distrust")),
        distrust.select("host", F.lit(0.0).alias("trust"), F.col("share").alias("distrust"))])
    scores = scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
    method = F.when((F.col("distrust") > 0) & (F.col("distrust") > block_share * (F.col("trust") + F.col("distrust"))),
                    F.lit("block")).otherwise(F.lit("allow"))
    return (ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", "ruled", *zero)
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust"))


def op3_link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return judge(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))

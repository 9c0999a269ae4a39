"""URL filters: rules, and link-graph propagation for what no rule fits, with DataFrame functions only.

A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule wins.
Pages without a rule get their host's verdict: trust starts at hosts whose pages rules allow and flows along
links (personalised PageRank); distrust starts at hosts whose pages rules block and flows against links, to
those who link there. A host is blocked if its distrust exceeds its trust and reaches ``THRESHOLD`` times an
even share.

Input cases: null urls and urls without ``://`` have empty host and path and are judged by the method (an
empty host has no links); null html has no links; repeated rows count as pages each; very long pages are
read whole; extra columns are ignored; an empty table gives an empty result; without links scores stay at
the seeds.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import cut, table

#: (verdict, host, path) of the production query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Propagation ends when a step moves less than this share of the seeds' mass.
TOLERANCE = 1e-12
#: Steps that it takes at most, as each moves at most DAMPING of what the one before did.
ROUNDS = ceil(log(TOLERANCE) / log(DAMPING))
THRESHOLD = 1.0
#: Host rows that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule's text and verdict, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, f"{h}{p}").otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst) host pairs that a link joins, each once; hosts' links to themselves don't count."""
    found = F.expr(r"""regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["\']?((?:[a-z][a-z0-9+.-]*:)?//[^"\' >]+)', 1)""")
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(found).alias("to"))
    dst = url_host(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    return links.select("src", dst.alias("dst")).where("src != dst and src != '' and dst != ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score) from (host, seed) by personalised PageRank along (src, dst); seeds sum up to 1, or all are 0.

    What hosts without links hold goes back to the seeds, so that scores keep summing up to 1. Scores are thus
    in proportion to the sum of all that reaches a host from the seeds in 0, 1, 2, ... steps; steps are added up
    until one moves less than ``tolerance``.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = cut(edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("w")))
    total = step = cut(seeds.where("seed > 0").select("host", F.col("seed").alias("score")))
    moved, rounds = step.agg(F.sum("score")).first()[0] or 0.0, 0
    while moved > tolerance:
        step = cut(step.join(weighted, step["host"] == weighted["src"]).groupBy("dst").agg((F.sum(F.col("score") * F.col("w")) * damping).alias("score")).withColumnRenamed("dst", "host"))
        moved, rounds = step.agg(F.sum("score")).first()[0] or 0.0, rounds + 1
        total = total.union(step)
        if rounds % 16 == 0:
            total = cut(total.groupBy("host").agg(F.sum("score").alias("score")))
    total = cut(total.groupBy("host").agg(F.sum("score").alias("score")))
    held = total.agg(F.sum("score")).first()[0] or 1.0
    return seeds.select("host").join(total, "host", "left").select("host", (F.coalesce("score", F.lit(0.0)) / held).alias("score"))


def _seeds(hosts: DataFrame, name: str) -> DataFrame:
    total = hosts.agg(F.sum(name)).first()[0] or 0.0
    return hosts.select("host", (F.col(name) / total if total else F.lit(0.0)).alias("seed"))


def host_scores(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust (times an even share) of all hosts of pages or links."""
    share = (F.count_if(F.col("by_rule") == "allow") - F.count_if(F.col("by_rule") == "block")) / F.count(F.lit(1))
    own = judged.groupBy("host").agg(share.alias("share"))
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    hosts = cut(ends.join(own, "host", "full").select("host", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("good"), F.greatest(F.lit(0.0) - F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("bad")))
    n = hosts.count()
    good, bad = _seeds(hosts, "good"), _seeds(hosts, "bad")
    if edges.isEmpty():  # nothing flows: scores are the seeds
        trust, distrust = good.withColumnRenamed("seed", "score"), bad.withColumnRenamed("seed", "score")
    else:
        trust = propagate(good, edges)
        distrust = propagate(bad, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return trust.select("host", (F.col("score") * n).alias("trust")).join(distrust.select("host", (F.col("score") * n).alias("distrust")), "host")


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    edges = cut(host_links(pages))
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"rule": rule, "by_rule": by_rule})
    scores = cut(host_scores(judged, edges))
    scores = F.broadcast(scores) if scores.count() <= BROADCAST_HOSTS else scores
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold)
    method = F.when(bad, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))

"""URL filters by link-graph propagation.

Hosts and all their ancestor domains are the nodes, whether or not a page is there. Edges lead from a page's host to the hosts
it links to (absolute and "//host" links in its HTML), and both ways between each domain and the next shorter one, with the weight
of one link; repeated links add weight. Their numbers are logged (`edge_counts`). Trust is
a personalised PageRank that starts at hosts with a trusted page; distrust is one on the reversed edges that
starts at hosts with a blocked page: a host that links to bad hosts is itself suspect. A host
is blocked when its distrust outweighs its trust by the threshold.

Rules of host and path prefix come first: a rule fits its host and all subdomains if the path starts with its
path, the longest fitting rule wins (host, then path), and only pages without a rule take the host's verdict.

Defined results: a null URL or one without "://" has an empty host and path, no rule and no edges, and is allowed (no evidence);
null HTML has no links; repeated rows count again as links and stay as rows; user and port stay part of the host; an empty
table gives no rows; other columns are ignored. The domain of a host is its name without user and port; an address of numbers has no
ancestors.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import SMALL_BYTES, cut_lineage, fits
from .resources import beside

_LOG = logging.getLogger(__name__)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 1.0


def _lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, rule_host, rule_path = rule
    inside = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
    return inside & F.startswith(path, F.lit(rule_path))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add host, path, rule (host + path of the longest fitting rule) and rule_verdict. `rules`: (verdict, host, path)."""
    host, path = F.col("host"), F.col("path")
    first = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(first):
        rule = F.when(_fits(host, path, r), r[1] + r[2]).otherwise(rule)
        verdict = F.when(_fits(host, path, r), r[0]).otherwise(verdict)
    return (pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
            .withColumn("rule", rule).withColumn("rule_verdict", verdict))


def _steps_up(hosts: DataFrame) -> DataFrame:
    """(low, high): each host of `hosts` (host) and each of its ancestor domains with the next shorter one."""
    name = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":[0-9]*$", "")
    names = F.expr(r"""CASE WHEN _name RLIKE r'^([0-9.]+$|\[)' THEN array(_name) ELSE
        filter(transform(sequence(size(split(_name, r'\.')), 1, -1), i -> substring_index(_name, '.', -i)),
               s -> s <> '' AND NOT startswith(s, '.')) END""")
    chain = hosts.withColumn("_name", name).select(F.array_distinct(F.concat(F.array("host"), names)).alias("_chain"))
    pairs = F.expr("transform(slice(_chain, 1, size(_chain) - 1), (low, i) -> named_struct('low', low, 'high', _chain[i + 1]))")
    return chain.select(F.explode(pairs).alias("_pair")).select("_pair.low", "_pair.high").filter("high <> ''").distinct()


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, weight, links, domains) between different hosts or domains, each source's weights adding up to 1. `links` of
    the weight's parts are links, `domains` (0 or 1) is the step between a domain and the next shorter one."""
    known = judged.filter("host <> ''")
    found = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), 1)
    links = (known.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
             .select("src", _lower(F.col("dst")).alias("dst")).filter("dst <> src").groupBy("src", "dst").agg(F.count("*").alias("links")))
    links = cut_lineage(links)  # read twice, and the pages' HTML once
    up = _steps_up(known.select("host").union(links.select("dst")).distinct())
    both_ways = up.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(up.select("high", "low"))
    both = (links.withColumn("domains", F.lit(0)).unionByName(both_ways.withColumn("links", F.lit(0)).withColumn("domains", F.lit(1)))
            .groupBy("src", "dst").agg(F.sum("links").alias("links"), F.sum("domains").alias("domains")))
    out = both.groupBy("src").agg(F.sum(F.col("links") + F.col("domains")).alias("_all"))
    weight = ((F.col("links") + F.col("domains")) / F.col("_all")).alias("weight")
    return both.join(out, "src").select("src", "dst", weight, "links", "domains")


def edge_counts(edges: DataFrame) -> dict[str, int]:
    """Pairs with links, and steps between domains (each way is one), among `host_edges`."""
    return edges.agg(F.count_if(F.col("links") > 0).alias("links"), F.count_if(F.col("domains") > 0).alias("domains")).first().asDict()


def steps_needed(damping: float, tolerance: float) -> int:
    """Step k moves 2 * damping ** k at most, as seeds add up to 1; one more for rounding."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1


def personalised_rank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING,
                      tolerance: float = TOLERANCE, small: int = SMALL_BYTES) -> DataFrame:
    """(host, rank): the random walk that restarts at `seeds` (host, seed; shares of 1).

    Walks end at nodes without edges out. The steps stop when the ranks move by less than `tolerance` in all
    (`steps_needed` bounds them, and it is an error if they do not);
    each step's ranks are written to the shared folder, so a lost executor costs one step. A graph that is checked
    to be under `small` bytes is stepped on the driver.
    """
    start = nodes.join(seeds, "host", "left").select("host", F.coalesce("seed", F.lit(0.0)).alias("seed"))
    if fits(nodes, 200, small) and fits(edges, 400, small):
        return _rank_of_few(start, edges, damping, tolerance)
    ranks = cut_lineage(start.withColumn("rank", F.col("seed")))
    for _ in range(steps_needed(damping, tolerance)):
        sent = (edges.join(ranks.select(F.col("host").alias("src"), "rank"), "src")
                .groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("weight"))).alias("_got")))
        moved = cut_lineage(ranks.join(sent, "host", "left").select(
            "host", "seed", "rank", ((1 - damping) * F.col("seed") + F.coalesce("_got", F.lit(0.0))).alias("_next")))
        change = moved.agg(F.coalesce(F.sum(F.abs(F.col("_next") - F.col("rank"))), F.lit(0.0))).first()[0]
        ranks = moved.select("host", "seed", F.col("_next").alias("rank"))
        if change < tolerance:
            break
    else:
        raise RuntimeError("ranks did not settle")
    return ranks.select("host", "rank")


def _rank_of_few(start: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """The same steps on arrays, in a fixed order of edges."""
    rows, pairs = start.orderBy("host").toArrow(), edges.select("src", "dst", "weight").orderBy("src", "dst").toArrow()
    number = {h: i for i, h in enumerate(rows.column("host").to_pylist())}
    src, dst = (np.array([number.get(h, -1) for h in pairs.column(c).to_pylist()], dtype=np.int64) for c in ("src", "dst"))
    known = (src >= 0) & (dst >= 0)
    src, dst, weight = src[known], dst[known], pairs.column("weight").to_numpy()[known]
    seed = rows.column("seed").to_numpy()
    ranks = seed
    for _ in range(steps_needed(damping, tolerance)):
        before, ranks = ranks, (1 - damping) * seed + damping * np.bincount(dst, ranks[src] * weight, minlength=len(seed))
        if np.abs(ranks - before).sum() < tolerance:
            break
    else:
        raise RuntimeError("ranks did not settle")
    made = pa.table({"host": pa.array(list(number), pa.string()), "rank": pa.array(ranks, pa.float64())})
    return start.sparkSession.createDataFrame(made, "host string, rank double")


def _shares(counts: DataFrame) -> DataFrame:
    """Seeds in proportion to their pages."""
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select("host", (F.col("n") / F.col("_all")).alias("seed"))  # one row


def host_verdicts(judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, host_verdict) of every host that has pages or is linked to, and of their ancestor domains."""
    edges = cut_lineage(host_edges(judged))
    _LOG.info("host graph: %(links)d edges by links, %(domains)d between domains", edge_counts(edges))
    own = judged.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    own = cut_lineage(own)
    nodes = cut_lineage(own.select("host").union(edges.select("src")).union(edges.select("dst")).distinct())
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    all_back = back.groupBy("src").agg(F.sum("weight").alias("_all"))
    back = back.join(all_back, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("weight"))
    trust = personalised_rank(nodes, edges, _shares(own.filter("good > 0").select("host", F.col("good").alias("n"))))
    distrust = personalised_rank(nodes, cut_lineage(back), _shares(own.filter("bad > 0").select("host", F.col("bad").alias("n"))))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host")
    return both.withColumn("host_verdict", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    judged = ruled(pages.select("page_id", "url", "html"), rules)
    slim = ruled(pages.select("page_id", "url"), rules)
    verdicts = beside(cut_lineage(host_verdicts(judged, threshold)), 200)  # a host may hold a third of all pages
    return (slim.join(verdicts, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))

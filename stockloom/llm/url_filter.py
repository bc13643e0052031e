"""URL filters: longest matching rule, and trust and distrust spread over the graph of hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.session import discard, written

# Fixed values: (verdict, host and path) of the rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

DAMPING = 0.85
TOLERANCE = 1e-3
MOST_ROUNDS = 500
LEAST_TRUST = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or one above it and whose path begins the url's; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    return reduce(lambda c, r: F.when(rule == r[1], F.lit(r[0])).otherwise(c), rules, F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` between hosts, out of ``pages(host, html)``; weights of a source sum to 1.

    A host is linked to the hosts that its pages link to, once each, and with the domain above it in both
    directions, since both are run by the same owner. Hosts without any link point at themselves.
    """
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    links = written(linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst").distinct())
    hosts = written(pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).where("host <> ''").distinct())
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # every host with the one above it, up to two labels
    chain = hosts.where(F.size(labels) > 2).select(F.explode(above).alias("src")).distinct()
    up = chain.where(F.size(F.split("src", r"\.")) > 2).select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"))
    edges = written(links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    ends = written(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    sinks = hosts.unionByName(edges.select(F.col("dst").alias("host"))).distinct().join(ends, F.col("host") == F.col("src"), "left_anti")
    loops = sinks.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight"))
    return edges.join(ends, "src").select("src", "dst", (1 / F.col("n")).alias("weight")).unionByName(loops)


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank ``kind, host, rank`` of several kinds at once.

    ``edges(kind, src, dst, weight)`` and ``seeds(kind, host, share)``. In a round every host hands on its
    rank along its links and the seeds get their shares anew; hosts that nothing reaches have no row. Rounds go
    on until the ranks of every kind, which sum to 1, change by less than ``tolerance`` in all; as a round shrinks
    the change by ``damping`` at least, they end, and running on means wrong weights and raises. The ranks of each
    round are written, so that Spark can split the links of one host with very many.
    """
    ranks = seeds.select("kind", "host", F.col("share").alias("rank"))
    start = seeds.select("kind", "host", ((1 - damping) * F.col("share")).alias("rank"), F.lit(0.0).alias("before"))
    last = None
    for _ in range(MOST_ROUNDS):
        moved = edges.join(ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"])
        handed = moved.select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("weight")).alias("rank"), F.lit(0.0).alias("before"))
        old = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("before"))
        ranks = written(handed.unionByName(start).unionByName(old).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")))
        discard(edges.sparkSession, last)
        last = ranks
        change = ranks.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("change")).agg(F.max("change")).first()[0]
        if (change or 0.0) < tolerance:
            return ranks.select("kind", "host", "rank")
    raise RuntimeError(f"the ranks still change by {change} after {MOST_ROUNDS} rounds")


def judged_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, least: float = LEAST_TRUST) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust`` per page.

    The longest fitting rule decides. Where none fits, the host decides: trust spreads over the links of
    the host graph from the hosts with allowed pages, distrust against the links from the hosts with
    blocked pages, each by the number of such pages. ``trust`` is the share of trust in both; from
    ``least`` on a host is allowed, and so is a host that neither reaches (``trust`` is null).

    Rules are a parameter of moderate length; they become one expression. Nulls: a null url, or one
    without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links.
    Repeated rows get equal results. An empty table gives no rows; further columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = parsed.withColumn("decided", rule_verdict(F.col("rule"), rules))
    edges = host_edges(parsed.select("host", "html"))
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(
        _reversed(edges).select(F.lit("block").alias("kind"), "src", "dst", "weight")
    )
    counts = written(ruled.where("decided is not null and host <> ''").groupBy(F.col("decided").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = written(counts.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("share")))  # two rows
    ranks = spread(written(both), seeds, damping, tolerance)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    trust = written(ranks.groupBy("host").agg(of("allow").alias("t"), of("block").alias("d")).select("host", F.try_divide("t", F.col("t") + F.col("d")).alias("trust")))
    joined = ruled.drop("html").join(trust, "host", "left")
    by_host = F.when(F.col("trust") < least, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("decided", by_host).alias("verdict"), "trust")


def _reversed(edges: DataFrame) -> DataFrame:
    """The links turned round, with the weights of the new sources."""
    turned = written(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = written(turned.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    return turned.join(ends, "src").select("src", "dst", (1 / F.col("n")).alias("weight"))

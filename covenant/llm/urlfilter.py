"""Operator 3: URL filter by link-graph propagation.

Rules name a host and a path prefix to allow or to block. Urls that a rule
fits get its verdict. For the rest, trust spreads along the edges of the host
graph from hosts in proportion to their allowed pages (personalised PageRank),
and distrust spreads against the edges from hosts in proportion to their
blocked pages; a host is blocked when its distrust exceeds ``factor`` times
its trust.

Edges: a page's absolute links, from its host to theirs (weight: number of
links), and site edges of weight one both ways between a host and the host
without its first label, on and on while that keeps two labels; so all hosts of
a site hang together even if those between them have no pages. Relative links
stay on their host and say nothing. All of it is DataFrame operations; scores are
written to the shared folder after every step.

Defined cases: a null url, or one without ``://``, has empty host and path and
is allowed, as nothing speaks against it; so is a host that neither trust nor
distrust reaches; a null html has no links; repeated pages count each time; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import stored

STEPS, DAMPING = 8, 0.85
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str            # allow or block
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(verdict, host, "/" + path)

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` (page_id, url, html) with host, path, and the longest rule that fits with its verdict."""
    longest = sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    host, path = F.col("host"), F.col("path")
    at = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pick = [F.when(r.fits(host, path), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest]
    return (at.withColumn("r", F.coalesce(*pick) if pick else F.lit(None).cast("struct<rule:string,verdict:string>"))
            .select("page_id", "html", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled")))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts and site edges; self-loops are left out."""
    links = (pages.where("html is not null and host != ''")
             .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("url"))
             .select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("url", "^[a-zA-Z]*:", ""))).alias("dst"))
             .where("dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    known = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    parents = (known.withColumn("labels", F.split("host", "[.]")).where(F.size("labels") > 2)
               .select("labels", F.expr("explode(sequence(1, size(labels) - 2))").alias("i"))
               .selectExpr("array_join(slice(labels, i, size(labels)), '.') as src",
                           "array_join(slice(labels, i + 1, size(labels)), '.') as dst").distinct())
    site = parents.unionByName(parents.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (links.unionByName(site.withColumn("w", F.lit(1.0)))
            .groupBy("src", "dst").agg(F.sum("w").alias("w")))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``steps`` steps. ``seeds``: (host, trust0, distrust0), each summing to one.
    Trust divides over a host's links out, distrust over its links in."""
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    ways = stored(edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"),
                                                (F.col("w") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
                  .unionByName(edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"),
                                                              F.lit(0.0).alias("t"), (F.col("w") / F.col("total")).alias("d"))),
                  "ways")
    seeds = seeds.select("host", (F.col("trust0") * (1 - damping)).alias("trust"),
                         (F.col("distrust0") * (1 - damping)).alias("distrust"))
    rank = seeds
    for _ in range(steps):
        moved = (ways.join(rank, "host")
                 .select(F.col("to").alias("host"), (damping * F.col("t") * F.col("trust")).alias("trust"),
                         (damping * F.col("d") * F.col("distrust")).alias("distrust")))
        rank = stored(moved.unionByName(seeds).groupBy("host").agg(F.sum("trust").alias("trust"),
                                                                   F.sum("distrust").alias("distrust")), "rank")
    return rank


def judge(pages: DataFrame, rules: list[Rule], steps: int = STEPS, factor: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``."""
    at = ruled(pages, rules)
    hosts = stored(at.where("host != ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "hosts")
    sums = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    seeds = hosts.select("host", (F.col("good") / float(max(sums.g or 0, 1))).alias("trust0"),
                         (F.col("bad") / float(max(sums.b or 0, 1))).alias("distrust0"))
    scores = propagate(stored(host_edges(at, hosts), "edges"), seeds, steps)
    # hosts are far fewer than pages, but their number grows: the join is left to size-checked planning
    found = at.select("page_id", "host", "path", "rule", "ruled").join(scores, "host", "left")
    trust, distrust = (F.round(F.coalesce(F.col(c), F.lit(0.0)), 12) for c in ("trust", "distrust"))
    by_links = F.when(distrust > factor * trust, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_links).alias("verdict"),
                        trust.alias("trust"), distrust.alias("distrust"))

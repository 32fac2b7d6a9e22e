"""URL verdicts: rules, and beyond them trust and distrust that spread over the host graph.

Rules name a host and a path; the longest that fits a page decides. Hosts with pages that rules
allow are trusted seeds, hosts with pages that rules block are blocked seeds. Trust is personalised
PageRank along links between hosts, distrust is personalised PageRank against them. A host is blocked if its
distrust exceeds its trust by more than the share MARGIN of it. Seeds are shares of a host's own pages, so scores of one
place in the graph are the same however large the rest is; rounds go on until no host's score changes by more than a share TOLERANCE of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.work import stored

#: (verdict, host, path) of the rules that the query uses.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
STEP = 4
#: Greatest change of a host's score in STEP rounds, as a share of the score, at which rounds end; and the share by which distrust must exceed trust.
TOLERANCE = 1e-6
MARGIN = 1e-4
#: A score below this counts as none: a seed's, over more than some 170 links.
LEAST = 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url):
    """Host and path of a URL column; both empty without '://'."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules=RULES):
    """The fitting rule as a struct (verdict, rule), null if none: the longest host and path together wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*cases)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    named = pages.withColumn("host", host).withColumn("path", path)
    return named.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: each source host's links to other hosts, weighted to a sum of 1. pages: host, html."""
    links = pages.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    total = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    return edges.join(total, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, name: str, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, score: personalised PageRank from seeds (host, seed). What reaches a host without links is not passed on.

    Rounds go on until no host's score from LEAST on differs from that of STEP rounds ago by more than the share `tolerance` of itself. A score is a sum over
    paths from the seeds, and what paths of more than k links add to it falls with damping ** k, so the count of rounds has a bound that doesn't depend on the count of hosts.
    """
    seeds = stored(seeds, f"trust-{name}")
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    now = seeds.select("host", F.col("seed").alias("score"))
    while True:  # ends after some log(LEAST * tolerance) / log(damping) rounds
        before = now
        for _ in range(STEP):
            flow = edges.join(now, edges.src == now.host).select(F.col("dst").alias("host"), (F.col("weight") * F.col("score") * damping).alias("score"))
            now = flow.union(base).groupBy("host").agg(F.sum("score").alias("score"))
        now = stored(now, f"trust-{name}")
        both = now.select("host", "score", F.lit(0.0).alias("was")).union(before.select("host", F.lit(0.0), "score")).groupBy("host").agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
        if both.where((F.greatest("score", "was") >= LEAST) & (F.abs(F.col("score") - F.col("was")) > tolerance * F.greatest("score", "was"))).isEmpty():
            return now


def host_scores(pages: DataFrame) -> DataFrame:
    """host, trust, distrust of every host with a score. pages: host, html, fit.

    A host's seed is the share of its judged pages that are allowed (for distrust: blocked), so neither the count of hosts nor of pages elsewhere enters
    its score. Pages without a host and null html give none; repeated rows count as often as they occur. An empty table gives none.
    """
    sums = pages.where("host <> ''").groupBy("host").agg(F.sum((F.col("fit.verdict") == "allow").cast("double")).alias("allowed"), F.sum((F.col("fit.verdict") == "block").cast("double")).alias("blocked"))
    sums = stored(sums.na.fill(0.0), "trust-seeds")
    judged_pages = F.col("allowed") + F.col("blocked")
    edges = stored(host_edges(pages), "trust-edges")
    trust = spread(edges, sums.where("allowed > 0").select("host", (F.col("allowed") / judged_pages).alias("seed")), "trust")
    distrust = spread(reversed_edges(edges), sums.where("blocked > 0").select("host", (F.col("blocked") / judged_pages).alias("seed")), "distrust")
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "score"))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def verdicts(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html).

    A null url, or one without '://', has an empty host and path, fits no rule and is allowed, as is
    any host that neither trust nor distrust reaches. A null html has no links. Repeated rows
    get the same verdict. An empty table gives an empty result.
    """
    rows = judged(pages.select("page_id", "url", "html"), rules)
    bad = host_scores(rows).where((F.col("distrust") >= LEAST) & (F.col("distrust") > F.col("trust") * (1 + margin))).select(F.col("host").alias("bad_host"))
    fitted = rows.select("page_id", "host", "path", "fit")
    bad = stored(bad, "trust-bad")
    named = fitted.join(bad, fitted.host == bad.bad_host, "left")
    own = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return named.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"))

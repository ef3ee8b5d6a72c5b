"""URL filters by trust and distrust that spread over the links between hosts. DataFrame functions only.

Trust is personalised PageRank along the links from the hosts of pages that a rule allows; distrust is personalised
PageRank against the links from the hosts of pages that a rule blocks, since who links to blocked hosts is suspect.
A host is blocked where its share of distrust exceeds its share of trust and a threshold; it holds for its pages that
no rule decides.

Edges are the distinct (host, host) pairs of the pages' links, each with its number of links. Ranks are iterated until they move by less
than a tolerance, however long the ways are on which they spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.shared import stored

#: (host, path, verdict) of each rule.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING = 0.85
#: How far (summed over all hosts, of shares that sum to 1) the ranks of a kind may still move when they are taken as settled.
TOLERANCE = 1e-7
#: A host's distrust must exceed this many times an even share, and its trust, for the host to be blocked.
LEAST_DISTRUST = 1.0
#: Rounds after which the ranks are written and held against those before, so that no plan or lineage grows with the rounds.
ROUNDS_A_TABLE = 4


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between hosts of ``pages`` (host, html): links from one to another, none to itself. Null html has none."""
    links = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?(?:[a-z]+:)?(//[^\s\"'<>]+)"), 1))
    linked = pages.select(F.col("host").alias("src"), links.alias("url")).select("src", host_of(F.concat(F.lit(":"), F.col("url"))).alias("dst"))
    return linked.filter("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): for each kind, PageRank over ``links`` (kind, src, dst, n) that starts and restarts at the hosts of
    ``seeds`` (kind, host, seed) in proportion to seed, until no kind's ranks move by more than ``tolerance`` in ``ROUNDS_A_TABLE``
    rounds; as a round shrinks what moves by ``damping``, that is reached. A kind without seeds has rank 0.

    What hosts without links hold is lost in each round and made up for at the end, when the ranks of a kind are scaled
    to sum to 1: that is the fixed point which gives it back to the seeds.
    """
    totals = {r.kind: float(r.total) for r in seeds.groupBy("kind").agg(F.sum("seed").alias("total")).collect()}  # one row a kind

    def scaled(column: str, by: dict) -> Column:
        out = F.lit(0.0)
        for kind, total in by.items():
            out = F.when(F.col("kind") == kind, F.col(column) / (total or 1.0)).otherwise(out)
        return out

    out = links.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    shares = stored(links.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    base = stored(seeds.select("kind", "host", scaled("seed", totals).alias("start")), "seeds")
    rank = base.select("kind", "host", F.col("start").alias("rank"))
    before, moves = base.select("kind", "host", F.lit(0.0).alias("was")), True
    while moves:
        for _ in range(ROUNDS_A_TABLE):
            sent = rank.filter("rank > 0").join(shares, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            rank = base.join(sent, ["kind", "host"], "left").select("kind", "host", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) * F.col("start")).alias("rank"))
        rank = stored(rank, "ranks")
        moved = rank.join(before, ["kind", "host"]).groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("by")).collect()  # one row a kind
        moves = any(r.by > tolerance for r in moved)
        before = rank.select("kind", "host", F.col("rank").alias("was"))
    sums = {r.kind: r.total for r in rank.groupBy("kind").agg(F.sum("rank").alias("total")).collect()}
    return rank.select("kind", "host", scaled("rank", sums).alias("rank"))


def filtered(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of ``pages`` (page_id, url, html).

    trust and distrust are the host's ranks in multiples of an even share, rounded to 6 places. Null urls and html are
    empty; the empty host takes no part in the graph and its pages are allowed. Without seeds of a kind that rank is 0
    everywhere. Ties (distrust no larger than trust) are allowed. Repeated rows are judged alike; other columns are ignored.
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    links = stored(edges(parsed.select("host", "html")), "edges")
    ruled = stored(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "ruled")
    hosts = ruled.filter("host != ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    ends = links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).distinct()
    nodes = stored(hosts.join(ends, "host", "full").select("host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")), "hosts")
    trust, distrust = F.lit("trust").alias("kind"), F.lit("distrust").alias("kind")
    seeds = nodes.select(trust, "host", F.col("good").alias("seed")).union(nodes.select(distrust, "host", "bad"))
    ways = links.select(trust, "src", "dst", "n").union(links.select(distrust, "dst", "src", "n"))
    ranks = personalised(seeds, ways, tolerance)
    n = nodes.count()
    scored = ranks.groupBy("host").agg(*[F.round(F.sum(F.when(F.col("kind") == k, F.col("rank") * n).otherwise(0.0)), 6).alias(k) for k in ("trust", "distrust")])
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > LEAST_DISTRUST)
    out = ruled.join(scored, "host", "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )

"""Operator 2: URL verdicts from rules and from trust over the host graph.

The longest fitting rule decides a page. Hosts of pages that a rule allows are trusted seeds, hosts of blocked pages are
distrusted seeds, each weighted by its pages. Personalised PageRank carries trust along the links between hosts, and distrust
against them (a host that links to blocked hosts is suspect). A page without a rule is blocked if its host's share of distrust
is more than ``RATIO`` times its share of trust, else allowed.

Edges are counted per pair of hosts before anything is joined; the ranks are a table, joined with the edges in each step and
staged every few steps. They start from the seeds' own mass and only grow; the steps end when no host is new and no host's rank
has grown by more than the share ``TOLERANCE`` since the last staging, so a host at any distance from a seed is reached and ratios of small
ranks are settled too (at more than about 4,000 links a rank is zero in double precision). Links inside a host are no edges. Mass
of hosts without links ends there.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links. Repeated
rows are judged alike, and their links count each time. Equal trust and distrust allow. Very long html is read whole, its distinct links
count once a page. Other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.session import release, stage

# Fixed rules: action, host, beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
STAGED_STEPS = 4
TOLERANCE = 1e-6
RATIO = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits, and its action; null if none does."""
    rule = action = F.lit(None).cast("string")
    for name, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, action = F.when(fits, domain + start).otherwise(rule), F.when(fits, name).otherwise(action)
    return rule, action


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: how many links the pages of one host have to another."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = links.select(F.col("host").alias("src"), host_of(whole).alias("dst"))
    return pairs.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``kind, host, rank``: trust along the edges and distrust against them, from ``seeds(kind, host, n)``.

    Each kind's seeds share one unit of teleport mass by ``n``; ends when no rank grows by more than the share ``tolerance``.
    """
    along = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    moves = stage(along.unionByName(against))
    total = moves.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    weighted = stage(moves.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total")).alias("w")))
    release(moves)
    sums = {r.kind: float(r.n) for r in seeds.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows
    mass = F.lit(0.0)
    for kind, n in sums.items():
        mass = F.when(F.col("kind") == kind, F.col("n") / n).otherwise(mass)
    start = stage(seeds.filter("n > 0").select("kind", "host", (mass * (1 - damping)).alias("rank")))
    rank = last = start
    while True:
        for _ in range(STAGED_STEPS):
            moved = rank.join(weighted, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("w") * damping).alias("rank"))
            rank = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = stage(rank)
        before = last.select("kind", "host", F.col("rank").alias("before"))
        grown = F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0))) > F.col("rank") * tolerance
        settled = rank.join(before, ["kind", "host"], "left").filter(grown).isEmpty()
        if last is not start:
            release(last)
        last = rank
        if settled:
            release(start, weighted)
            return rank


def url_verdicts(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages(page_id, url, html)``."""
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    judged = placed.withColumn("rule", rule).withColumn("action", action)
    kind = F.when(F.col("action") == "allow", "trust").otherwise("distrust")
    seeds = judged.filter("action IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    ranks = propagate(host_links(placed), seeds)
    trust = F.coalesce(F.max(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0))
    distrust = F.coalesce(F.max(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0))
    hosts = ranks.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))
    out = judged.drop("html").join(hosts, "host", "left")
    own = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    zero = F.lit(0.0)
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")
    )

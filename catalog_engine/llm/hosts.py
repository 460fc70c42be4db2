"""URL filter: rules on host and path, and for the rest personalised PageRank over links between hosts.

Trust starts at hosts whose pages the rules mostly allow and follows links; distrust starts at hosts whose pages they mostly
block and follows links backwards, to whoever points there. Both are measured against plain ranks over the same links.
Everything is DataFrame and SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.workspace import staged


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty like the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. Of equally long ones the first in order of name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def links_between(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): absolute links of pages to other hosts, counted; a page counts once for a host it links to."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1)), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))))
    found = pages.select(F.col(host).alias("src"), F.explode(targets).alias("dst"))
    return found.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    links: DataFrame, seeds: DataFrame, rounds: int = 40, damping: float = 0.85,
    ahead: tuple[str, ...] = ("trust",), behind: tuple[str, ...] = ("distrust",), back: DataFrame | None = None, tolerance: float = 1e-3,
) -> DataFrame:
    """(host, *ahead, *behind): personalised PageRanks, each returning to the weights in its column of ``seeds`` with probability 1 - damping.

    The columns ``ahead`` follow the links (src, dst, n); those ``behind`` go against them, or against the links ``back``, dealt out
    among those who link to a host. What is on its way after a round is written to the shared folder, so that a lost executor costs
    a round at most; contributions are added up before they are shuffled. It ends when no more than ``tolerance`` of the seeds'
    weight is on its way, or after ``rounds``.
    """
    def shares(edges: DataFrame, source: str, target: str, onward: bool) -> DataFrame:
        steps = edges.select(F.col(source).alias("from"), F.col(target).alias("to"), "n")
        whole = steps.groupBy("from").agg(F.sum("n").alias("all"))
        return steps.join(whole, "from").select("from", "to", (F.col("n") / F.col("all")).alias("share"), F.lit(onward).alias("onward"))

    names = [*ahead, *behind]
    weight = lambda df: df.agg(F.sum(sum((F.col(c) for c in names), F.lit(0.0)))).first()[0] or 0.0
    arcs = staged(shares(links, "src", "dst", True).unionByName(shares(links if back is None else back, "dst", "src", False)), "arcs")
    moved = staged(seeds.select("host", *names), "seeds")
    start, passed = weight(moved), []
    on_its_way = start
    while len(passed) < rounds and on_its_way > tolerance * start:
        passed.append(moved)
        steps = arcs.join(moved.withColumnRenamed("host", "from"), "from")
        carried = steps.select(F.col("to").alias("host"), *[F.when(F.col("onward") == F.lit(c in ahead), damping * F.col("share") * F.col(c)).otherwise(0.0).alias(c) for c in names])
        moved = staged(carried.groupBy("host").agg(*[F.sum(c).alias(c) for c in names]), "moved")
        on_its_way = weight(moved)
    for earlier in passed:
        moved = moved.unionByName(earlier.select("host", *[((1 - damping) * F.col(c)).alias(c) for c in names]))
    return moved.groupBy("host").agg(*[F.sum(c).alias(c) for c in names])


def judge_hosts(pages: DataFrame, links: DataFrame, least: float = 0.3) -> DataFrame:
    """(host, trust, distrust, blocked) from pages with host, path and the rules' verdict, and the links between hosts.

    A host is decided if the rules settle most of its pages, more of them one way than the other; its trust or distrust is that
    surplus, and links do not sway it. Any other host is judged by two ranks against the links that undecided hosts make: distrust
    returns to the blocked hosts, the plain rank to all hosts where such links end; the quotient is the part of what a host points
    at, near or far, that is blocked. Seeds weigh as many times as they are linked to, so every link brings the same however
    popular its target is. Trust is the like quotient along the links to undecided hosts. Blocked: distrust of at least ``least`` that outweighs
    the trust. A host without such links has neither.
    """
    per_host = pages.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    surplus = lambda a, b: F.greatest(F.lit(0.0), (F.col(a) - F.col(b)) / F.col("pages"))
    settled = per_host.filter("2 * (good + bad) >= pages AND good <> bad")
    decided = staged(settled.select("host", surplus("good", "bad").alias("good"), surplus("bad", "good").alias("bad")), "decided")
    toward = links.join(decided.select(F.col("host").alias("dst")), "dst", "left_anti")
    away = links.join(decided.select(F.col("host").alias("src")), "src", "left_anti")
    ends = [(toward, "src", "out"), (toward, "dst", "fed"), (away, "dst", "into"), (away, "src", "feeds")]
    sums = [edges.select(F.col(end).alias("host"), *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for _, _, c in ends]) for edges, end, name in ends]
    nodes = sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3]).groupBy("host").agg(*[F.sum(c).alias(c) for _, _, c in ends])
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    seeds = nodes.join(decided, "host", "left").select(
        "host",
        (known("good") * F.col("out")).alias("trust"), F.when(F.col("fed") == 0, F.col("out")).otherwise(0).cast("double").alias("reached"),
        (known("bad") * F.col("into")).alias("distrust"), F.when(F.col("feeds") == 0, F.col("into")).otherwise(0).cast("double").alias("reaching"),
    )
    ranks = propagate(toward, seeds, ahead=("trust", "reached"), behind=("distrust", "reaching"), back=away)
    part = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 9)
    spread = ranks.join(decided.select("host"), "host", "left_anti").select("host", part("trust", "reached").alias("trust"), part("distrust", "reaching").alias("distrust"))
    judged = spread.withColumn("blocked", (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")))
    return judged.unionByName(decided.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"), (F.col("bad") > 0).alias("blocked")))


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", least: float = 0.3) -> DataFrame:
    """key, host, path, rule, verdict (allow or block) and how it was found (``by``: rule or links).

    A null url, or one without ``://``, has an empty host and path and is allowed unless a rule fits. Pages without html link
    nowhere. Repeated rows are judged alike.
    """
    shown = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shown = shown.withColumns({"rule": name, "verdict": verdict})
    links = staged(links_between(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))), "links")
    hosts = judge_hosts(shown, links, least).filter("blocked").select("host", F.lit("block").alias("spread"))
    judged = shown.join(hosts, "host", "left")
    return judged.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").otherwise("links").alias("by"))

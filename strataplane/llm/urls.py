"""URL filters: host and path rules, then trust and distrust propagated over the host graph.

Trust is a personalised PageRank from trusted seeds along links; distrust is
one from blocked seeds against links, as who links to bad hosts is suspect.
A host is a seed of either by the share of its pages that rules allow or block.
Edges are the links between hosts in the markup, and ties between a host and
its parent domain.
Hosts are compared on both; only DataFrame operations run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: SETTLED is the share of all seeds' score that a round may still move at the end.
DAMPING, SETTLED = 0.85, 1e-5
#: Rounds between two written tables and looks at the change.
STRIDE = 8
#: A host is blocked by the graph if its distrust reaches this and is above its trust.
BLOCK_AT = 0.1
#: Blocked seeds beside the rules: hosts with one of these names in them start as distrusted as a whole.
BLOCKED_NAMES = r"(?:^|[.-])(?:spam|pills?|casino|viagra|malware|phishing|warez|porn|adult|bets?)(?:[.-]|$)"
#: An address of another host: ``//`` after http(s), an equals sign or a quote, in any attribute or in the text.
LINKS = r"(?i)(?:https?:|[=\"'][ \t]?)//([^/?#\"'\s<>]+)"
#: Links that a tie to the parent domain counts as.
TIE = 1


@dataclass(frozen=True)
class Rule:
    """``allow`` or block; ``text`` is host and path, as ``example.com/en/``."""

    allow: bool
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits_host(self, host: Column) -> Column:
        return (host == self.host) | host.endswith("." + self.host)


RULES = (Rule(True, "com/"), Rule(False, "example.com/en/"), Rule(True, "www.example.com/en/"), Rule(False, "net/es/"), Rule(False, "net/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; '' for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The text of the longest rule that fits, else null; of equally long ones the first by text."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        out = F.when(rule.fits_host(host) & path.startswith(rule.path), F.lit(rule.text)).otherwise(out)
    return out


def parent_of(host: Column) -> Column:
    """The domain above a host, of two names at least; null for others and for addresses."""
    up = F.regexp_extract(host, r"^[^.]+\.([^.].*)$", 1)
    return F.when(up.contains(".") & ~host.rlike(r"^[0-9.:]+$"), up)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted over all pages before the shuffle, and ties to parent domains.

    Links are the addresses that ``LINKS`` finds.  A host that
    has pages or links and its parent domain, and so on up to two names, are
    linked both ways, TIE links each: who runs a domain answers for its hosts.
    """
    links = F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))
    each = pages.select(host_of(F.col("url")).alias("src"), F.explode_outer(links).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    counted = each.where("src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    found = counted.where("dst is not null and dst <> '' and src <> dst")
    hosts = counted.select(F.col("src").alias("host")).unionByName(counted.where("dst is not null").select(F.col("dst").alias("host"))).distinct()
    # a host of k names has at most k - 2 domains above it
    names = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    up = hosts.select(F.explode(chain).alias("src")).distinct().select("src", parent_of(F.col("src")).alias("dst")).where("dst is not null")
    ties = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(TIE).cast("long"))
    return found.unionByName(ties).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host, weight), each with weight 1 if there is no such column.

    Edges (src, dst, n) carry a host's score on in proportion to n; what
    reaches a host without edges goes no further.  With x = Mx + b for the
    scores, rounds are those of the Chebyshev semi-iteration over
    [-DAMPING, DAMPING], where the spectrum lies if links are mutual, as ties
    are: a round takes 0.56 of the error instead of 0.85.  A round is one join
    and one aggregate; the round before travels along the rows of hosts to
    themselves.  Every STRIDE rounds the state is written and what a plain
    round would still change is summed.  Where that fell by less than plain
    rounds are sure of (one-way links), plain rounds go on from the better
    state.  It ends when the sum is at most SETTLED of all seeds' score; the
    result is off by at most DAMPING / (1 - DAMPING) of that, over all hosts.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("out"))
    weight = F.max("weight") if "weight" in seeds.columns else F.lit(1.0)
    start = seeds.groupBy("host").agg((weight * (1.0 - DAMPING)).alias("b"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("b"))
    own = start.unionByName(ends).groupBy("host").agg(F.sum("b").alias("b"))
    moves = edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("out") * DAMPING).alias("w"), F.lit(0.0).alias("b"), F.lit(False).alias("own"))
    links = scratch.save(moves.unionByName(own.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("w"), "b", F.lit(True).alias("own"))))
    zero = F.lit(0.0)
    now = links.where("own").select(F.col("src").alias("host"), F.col("b").alias("score"), zero.alias("before"), zero.alias("older"))
    mass = now.agg(F.sum("score")).first()[0]
    if not mass:
        return now.select("host", "score")

    def stepped(state: DataFrame, omega: float) -> DataFrame:
        held = F.when(F.col("own"), omega * F.col("b") + (1.0 - omega) * F.col("before")).otherwise(zero)
        each = state.join(links, state.host == links.src).select(
            F.col("dst").alias("host"),
            (omega * F.col("score") * F.col("w") + held).alias("score"),
            F.when(F.col("own"), F.col("score")).otherwise(zero).alias("before"),
            F.when(F.col("own"), F.col("before")).otherwise(zero).alias("older"),
        )
        return each.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("score", "before", "older")])

    def plain(state: DataFrame, omega: float) -> DataFrame:
        """The state with the score that a plain round gives from ``before``."""
        return state.withColumn("score", F.col("older") + (F.col("score") - F.col("older")) / omega)

    omega, left, fast = 0.0, mass, True
    while True:
        last, was = now, omega
        for _ in range(STRIDE):
            omega = (1.0 if not omega else 1.0 / (1.0 - DAMPING**2 / (2.0 if omega == 1.0 else 4.0 / omega))) if fast else 1.0
            now = stepped(now, omega)
        now = scratch.save(now)
        change = plain(now, omega).agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0]
        if change <= SETTLED * mass:
            return plain(now, omega).select("host", F.greatest("score", zero).alias("score"))
        if fast and change > left * DAMPING**STRIDE:
            fast = False
            now = plain(now, omega) if change < left else plain(last, was) if was else last
            left = min(left, change)
        else:
            left = change


def seed_weights(read: DataFrame, edges: DataFrame, rules: tuple[Rule, ...], blocked_names: str) -> DataFrame:
    """(host, good, bad): the shares of a host's pages that allow rules and block rules decide.

    A host that is linked but has no page has 1 for the rule that covers it
    whole.  A host of a blocked name has 0 and 1.
    """
    allowed = [r.text for r in rules if r.allow]
    placed = read.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(1).alias("n"))
    linked = edges.select(F.col("dst").alias("host"), F.lit("/").alias("path"), F.lit(0).alias("n"))
    each = placed.unionByName(linked).where("host <> ''").withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    is_good = F.col("rule").isNotNull() & F.col("rule").isin(allowed)
    is_bad = F.col("rule").isNotNull() & ~F.col("rule").isin(allowed)
    sums = [F.sum("n").alias("pages"), F.sum(F.when(is_good, F.col("n")).otherwise(0)).alias("goods"), F.sum(F.when(is_bad, F.col("n")).otherwise(0)).alias("bads")]
    whole = [F.max(is_good.cast("double")).alias("whole_good"), F.max(is_bad.cast("double")).alias("whole_bad")]
    shares = each.groupBy("host").agg(*sums, *whole)
    named = F.col("host").rlike(blocked_names)
    good = F.when(named, 0.0).when(F.col("pages") > 0, F.col("goods") / F.col("pages")).otherwise(F.col("whole_good"))
    bad = F.when(named, 1.0).when(F.col("pages") > 0, F.col("bads") / F.col("pages")).otherwise(F.col("whole_bad"))
    return shares.select("host", good.alias("good"), bad.alias("bad"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked_names: str = BLOCKED_NAMES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of ``pages`` (page_id, url, html).

    The longest rule that fits decides; else the host's scores do.  Hosts are
    seeds with the weights of ``seed_weights``.  Pages without a host are
    allowed.  Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = scratch.save(host_edges(read))
    allowed = [r.text for r in rules if r.allow]
    seeded = scratch.save(seed_weights(read, edges, rules, blocked_names))
    # both walks in one table: hosts of trust are marked +, those of distrust, which goes against the links, -
    plus, minus = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    walked = edges.select(plus("src").alias("src"), plus("dst").alias("dst"), "n").unionByName(edges.select(minus("dst").alias("src"), minus("src").alias("dst"), "n"))
    seeds = seeded.where("good > 0").select(plus("host").alias("host"), F.col("good").alias("weight")).unionByName(seeded.where("bad > 0").select(minus("host").alias("host"), F.col("bad").alias("weight")))
    score = propagate(walked, seeds, scratch)
    pick = lambda sign: F.sum(F.when(F.col("host").startswith(sign), F.col("score")))
    scores = scratch.save(score.groupBy(F.expr("substring(host, 2)").alias("h")).agg(pick("+").alias("trust"), pick("-").alias("distrust")).withColumnRenamed("h", "host"))
    placed = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    both = placed.withColumn("rule", ruled(F.col("host"), F.col("path"), rules)).join(scores, "host", "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((d >= BLOCK_AT) & (d > t), F.lit("block")).otherwise(F.lit("allow"))
    by_rule = F.when(F.col("rule").isin(allowed), F.lit("allow")).otherwise(F.lit("block"))
    return both.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_graph).alias("verdict"), t.alias("trust"), d.alias("distrust"))

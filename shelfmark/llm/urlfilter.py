"""Operator 4: URL filters by rules and link-graph propagation.

Rules of a host (with its subdomains) and a path prefix judge the urls they fit;
the longest wins. All other urls are judged by their host: personalised PageRank
spreads trust from trusted hosts along the edges of the host graph, and
distrust from blocked hosts against them (who links to a blocked host is
suspect). A host whose share of distrust, distrust / (trust + distrust), is over
``threshold`` is blocked; other hosts, also those that neither reaches, are
allowed.

Seeds: a host is trusted by the number of its pages that a rule allows, and
distrusted by the number that a rule blocks; it can be both. More seeds can be
named; a named host is only what it is named.

Edges. A page's host links to every other host of a url in its html (``href``,
``src``, ``action``, ``cite``, ``content``, ``data`` and ``poster`` attributes) and
of a url carried in its own url's query, with weight 1. Besides, every host of
three labels and more is tied to the domain above it, up to two labels, both ways
with weight ``DOMAIN_WEIGHT``: who runs a domain answers for its subdomains. A pair
counts once, with its largest weight. Every node divides its score among its
edges by weight; scores that reach a node without edges end there.

Both ranks are propagated together by joins and sums over one (host, trust,
distrust) table; STEP rounds are one plan, whose result is written to the shared
folder to cut lineage. What a step adds to a rank shrinks by the damping of its rounds with every
one more, once it has spread; the geometric sum of all that is to come is added as an
estimate. Steps go on until no new host is reached and no host's share of distrust, by
these estimates, changes by more than ``settled``, however small its ranks are (of a single rank:
until it changes by no more than ``settled`` of itself). Nothing but the largest change reaches
the driver.

Defined results: a null url, or one without ``://``, has empty host and path and
fits no rule; it is judged by the host "" like any other. Null html has no
links. Repeated rows count as pages each; their edges are distinct. No pages
give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, THRESHOLD = 0.85, 0.5
#: Weight of the tie between a host and the domain above it, where a link weighs 1.
DOMAIN_WEIGHT = 0.25
#: Largest change in a step at which ranks are settled, and the rounds of a step.
SETTLED, STEP = 1e-4, 6
LINK = r"""(?i)\b(?:href|src|action|cite|content|data|poster)\s*=\s*["']?(?:\s*//|[^"'<>]*?[a-z][a-z0-9+.-]*://)(?:[^/?#"'\s<>@]*@)?([^/?#"'\s<>@]+)"""
#: A url in a query, plain or with its marks escaped.
QUERY_LINK = r"""(?i)[?&;][^=&#]*=[a-z][a-z0-9+.-]*(?::|%3a)(?:/|%2f){2}([^/?#&;"'\s<>%@]+)"""


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        """The rule as text."""
        return self.host + self.path


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], part: str = "name") -> Column:
    """Name or verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, part))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs of hosts; ``pages`` has host, url and html."""
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(F.regexp_extract_all("html", F.lit(LINK), 1), none), F.coalesce(F.regexp_extract_all("url", F.lit(QUERY_LINK), 1), none))
    found = F.array_distinct(F.transform(found, lambda h: F.translate(h, UPPER, LOWER)))
    pairs = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return pairs.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct()


def domain_ties(hosts: DataFrame) -> DataFrame:
    """(src, dst) pairs of each host and the domains above it, step by step up to two labels, both ways."""
    named = hosts.select("host").filter(F.col("host").rlike(r"^[^:@\[\]]+$") & ~F.col("host").rlike(r"^[0-9.]+$")).distinct()
    labels = F.split("host", r"\.")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 2),
        lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("dst")),
    )
    up = named.filter(F.size(labels) >= 3).select(F.explode(steps).alias("e")).select("e.src", "e.dst").filter("src <> '' AND dst <> ''").distinct()
    return up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _shares(edges: DataFrame, damping: float, name: str) -> DataFrame:
    """Of each edge (src, dst, weight): the damped share of its source's rank."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    return edges.join(out, "src").select("src", "dst", (damping * F.col("weight") / F.col("all")).alias(name))


def _spread(base: DataFrame, moves: DataFrame, names: list[str], damping: float, settled: float) -> DataFrame:
    """Ranks ``names`` of each host: (1 - damping) * base plus what ``moves`` (src, dst and a share for each name) bring, settled."""
    start = base.select("host", *[((1 - damping) * F.col(n)).alias(n) for n in names])
    first = start.select("host", *names, *[F.col(n).alias(f"{n}_end") for n in names], *[F.lit(0.0).alias(f"{n}_was") for n in names])
    last = store.written(first, "rank")
    if not moves.limit(1).count():
        return last.select("host", *names)
    # What a step adds shrinks by so much in the next one: all that is to come is a geometric sum.
    rest = damping**STEP / (1 - damping**STEP)
    while True:
        rank = last.select("host", *names)
        for _ in range(STEP):
            moved = moves.alias("m").join(rank.alias("r"), F.col("m.src") == F.col("r.host")).select(F.col("m.dst").alias("host"), *[(F.col(f"m.{n}") * F.col(f"r.{n}")).alias(n) for n in names])
            rank = moved.unionByName(start).groupBy("host").agg(*[F.sum(n).alias(n) for n in names])
        joined = rank.alias("n").join(last.alias("l"), "host", "left")
        before = lambda n: F.coalesce(f"l.{n}", F.lit(0.0))
        end = [(F.col(f"n.{n}") + rest * F.greatest(F.lit(0.0), F.col(f"n.{n}") - before(n))).alias(f"{n}_end") for n in names]
        new = store.written(joined.select("host", *[F.col(f"n.{n}") for n in names], *end, *[before(f"{n}_end").alias(f"{n}_was") for n in names]), "rank")
        store.drop(last)
        last = new
        share = lambda end: F.col(names[-1] + end) / sum((F.col(n + end) for n in names), F.lit(0.0))
        fresh = sum((F.col(f"{n}_was") for n in names), F.lit(0.0)) == 0
        if len(names) > 1:
            change = F.when(fresh, F.lit(1.0)).otherwise(F.abs(share("_end") - share("_was")))
        else:
            change = F.when(fresh, F.lit(1.0)).otherwise(F.abs(F.col(f"{names[0]}_end") / F.col(f"{names[0]}_was") - 1))
        reached = sum((F.col(f"{n}_end") for n in names), F.lit(0.0)) > 0
        if (last.agg(F.max(F.when(reached, change).otherwise(F.lit(0.0))).alias("c")).first()["c"] or 0.0) <= settled:
            return last.select("host", *[F.col(f"{n}_end").alias(n) for n in names])


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank: (host, rank) from ``seeds`` (host, seed >= 0) along ``edges`` (src, dst, and weight if not all alike)."""
    total = seeds.agg(F.sum("seed").alias("total"))
    base = store.written(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("seed") / F.col("total")).alias("rank")), "seeds")  # one row of totals
    weighed = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    return _spread(base, store.written(_shares(weighed, damping, "rank"), "edges"), ["rank"], damping, settled)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    trusted: list[str] | None = None,
    blocked: list[str] | None = None,
    threshold: float = THRESHOLD,
    damping: float = DAMPING,
    domain_weight: float = DOMAIN_WEIGHT,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    parsed = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias("url"), F.col(html).alias("html"))
    narrow = parsed.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), rule_of(F.col("host"), F.col("path"), rules, "verdict").alias("_by_rule"))
    hosts = narrow.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_by_rule") == "allow").alias("good"), F.count_if(F.col("_by_rule") == "block").alias("bad")
    )
    named_good, named_bad = F.col("host").isin(list(trusted or [])), F.col("host").isin(list(blocked or []))
    seeds = store.written(
        hosts.filter(F.col("host") != "").select(
            "host",
            F.when(named_good, F.col("n")).when(named_bad, F.lit(0)).otherwise(F.col("good")).alias("good"),
            F.when(named_bad, F.col("n")).when(named_good, F.lit(0)).otherwise(F.col("bad")).alias("bad"),
        ).filter("good + bad > 0"),
        "seeds",
    )
    linked = store.written(links(parsed), "links")
    nodes = hosts.select("host").union(linked.select("dst"))
    ties = domain_ties(nodes).withColumn("weight", F.lit(float(domain_weight))).filter("weight > 0")
    edges = linked.withColumn("weight", F.lit(1.0)).union(ties).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    edges = store.written(edges, "edges")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust, distrust = _shares(edges, damping, "trust"), _shares(against, damping, "distrust")
    moves = trust.join(distrust, ["src", "dst"], "full").select("src", "dst", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    totals = seeds.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    base = seeds.crossJoin(F.broadcast(totals)).select("host", part("good", "all_good").alias("trust"), part("bad", "all_bad").alias("distrust"))  # one row of totals
    ranks = _spread(store.written(base, "seeds"), store.written(moves, "moves"), ["trust", "distrust"], damping, SETTLED)
    joined = narrow.join(ranks, "host", "left")
    good, bad = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((good + bad > 0) & (bad > threshold * (good + bad)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_graph).alias("verdict"), good.alias("trust"), bad.alias("distrust"))

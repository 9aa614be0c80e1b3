"""URL filters: rules, and link-graph propagation of trust and distrust.

Rules name a host and a path prefix; the longest that fits a URL decides it.
All other URLs are decided by their host.  Hosts are the nodes of a graph with
these weighted edges:

* the links from the pages of a host to another host, by their number;
* the relative links of a host's pages, which lead to the host itself;
* a host and the host one label up, both ways, once for each page of the lower
  one, where the upper one has pages or at least ``SITE_LABELS`` labels: a site
  answers for its subdomains, and siblings meet in it.

Trust is a personalised PageRank from the hosts of allowed pages; distrust is
one over the reversed edges, from the hosts of blocked pages, so that a host
that links to blocked ones inherits it.  Both have mass 1, and seeds are
weighted by their pages.  Each is the sum of what flows from the seeds in 0, 1,
2, ... steps, damped; steps go on until what is still on its way is at most
``TOLERANCE`` of all mass, and that residual is reported.  Hosts without edges
would hand their mass back to the seeds, which scales the sum: it is scaled in
the end.  A host is blocked where its distrust is at least ``THRESHOLD`` of the
mean mass of a host and more than its trust.

Everything is DataFrame code.  Pages are read twice, each time narrowly; only
host pairs and their counts are shuffled, after partial aggregation.

Defined results: a null URL or one without ``://`` has empty host and path and
no host in the graph, and is allowed; repeated pages are decided each, and
their links count each; null html has no links; links of other schemes are
none; with no seeds nothing is blocked by the graph; of rules of one length the
one that sorts last wins; an empty table gives no rows; html of any length is
searched whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Chance that a step follows a link.
DAMPING = 0.85
#: Mass that may still be on its way when a propagation ends.
TOLERANCE = 1e-5
#: Steps after which the lineage is cut and the residual looked at.
CUT_EVERY = 6
#: Ways into which the pages of one host are dealt.
SALTS = 32
#: Labels from which a host is a site even if it has no page of its own.
SITE_LABELS = 3
#: Share of the mean mass of a host from which distrust counts.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """Allows or blocks what lies below a host and a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): the links of the pages of each host, those to the host itself included."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    found = pages.select(url_host(F.col("url")).alias("src"), F.explode(links).alias("link")).filter("src != ''")
    absolute = F.col("link").rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//")
    other = F.col("link").rlike(r"(?i)^[a-z][a-z0-9+.-]*:")
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    found = found.select("src", F.when(absolute, url_host(link)).when(~other, F.col("src")).alias("dst"))
    return found.filter("dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, w): hosts and the hosts one label up, both ways; ``hosts`` has each host and its pages."""
    up = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    pairs = hosts.select("host", up.alias("up"), F.col("pages").cast("double").alias("w")).filter("up != ''")
    known = hosts.select(F.col("host").alias("up"), F.lit(True).alias("known"))
    pairs = pairs.join(known, "up", "left").filter(F.col("known") | (F.size(F.split("up", r"\.")) >= SITE_LABELS))
    return pairs.select(F.col("host").alias("src"), F.col("up").alias("dst"), "w").unionByName(pairs.select(F.col("up").alias("src"), F.col("host").alias("dst"), "w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(kind, host, mass) and the residual: personalised PageRanks, one for each kind of edge.

    ``seeds`` has (kind, host, s), the s of a kind summing up to 1; ``edges``
    has (kind, src, dst, share), share being the part of the source's mass that
    an edge carries.
    """
    # one more row for each host, without a share: what it has got stays with it
    own = edges.select("kind", F.col("src").alias("h")).union(edges.select("kind", "dst")).union(seeds.select("kind", "host")).distinct()
    ways = cut(edges.unionByName(own.select("kind", F.col("h").alias("src"), F.col("h").alias("dst"), F.lit(None).cast("double").alias("share"))))
    flow = cut(seeds.select("kind", "host", F.col("s").alias("moving"), F.col("s").alias("mass")))
    while True:
        before = flow
        for _ in range(CUT_EVERY):
            sent = F.col("moving") * F.col("share") * damping
            moved = flow.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), F.coalesce(sent, F.lit(0.0)).alias("moving"), F.coalesce(sent, "mass").alias("mass"),
            )
            flow = moved.groupBy("kind", "host").agg(F.sum("moving").alias("moving"), F.sum("mass").alias("mass"))
        flow = cut(flow)
        drop_cut(before)
        # what is on its way goes on for 1 / (1 - damping) of itself at most
        residual = flow.groupBy("kind").agg((F.sum("moving") * damping / (1 - damping) / F.sum("mass")).alias("r")).agg(F.max("r")).first()[0] or 0.0
        if residual <= tolerance:
            break
    total = flow.groupBy("kind").agg(F.sum("mass").alias("total"))  # two rows
    return flow.join(F.broadcast(total), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass")), residual


def host_verdicts(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """(host, trust, distrust, residual, host_blocked) of every host that has a page or an edge."""
    counts = judged.filter("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    counts = cut(counts)
    edges = cut(host_links(pages).unionByName(domain_links(counts)).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).union(counts.select("host")).distinct()
    ways = [("trust", "src", "dst", "allowed"), ("distrust", "dst", "src", "blocked")]
    both = reduce(DataFrame.unionByName, [edges.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "w") for kind, a, b, _ in ways])
    shares = cut(both.join(both.groupBy("kind", "src").agg(F.sum("w").alias("all")), ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("share")))
    seeds = reduce(DataFrame.unionByName, [counts.filter(F.col(n) > 0).select(F.lit(kind).alias("kind"), "host", F.col(n).alias("s")) for kind, _, _, n in ways])
    total = seeds.groupBy("kind").agg(F.sum("s").alias("all"))  # two rows
    seeds = seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("s") / F.col("all")).alias("s"))
    mass, residual = propagate(seeds, shares)
    masses = mass.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind) for kind, _, _, _ in ways])
    n = linked.agg(F.count("*").alias("n"))  # one row
    scored = linked.join(masses, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")).join(F.broadcast(n))
    blocked = (F.col("distrust") * F.col("n") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return scored.select("host", "trust", "distrust", F.lit(residual).alias("residual"), blocked.alias("host_blocked"))


def judge_pages(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust, residual."""
    pages = pages.select("page_id", "url", "html")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": name, "by_rule": verdict})
    hosts = host_verdicts(pages, judged)
    # a third of all pages may be of one host
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(hosts, ["host", "salt"], "left")
    by_host = F.when(F.coalesce("host_blocked", F.lit(False)), "block").otherwise("allow")
    measures = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "residual")]
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), *measures)

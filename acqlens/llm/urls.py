"""URL filter: allow and block rules, and link-graph propagation for hosts that no rule decides.

Rules are ``host/path`` strings: a rule fits its host and all subdomains where
the url's path starts with the rule's path; the longest fitting rule wins.

Hosts inherit the rest. Links between different hosts are summed to weighted
host edges. Two personalised PageRanks run together over them: trust starts from
hosts by their number of allowed pages and follows the links, distrust starts
from hosts by their number of blocked pages and follows the links backwards (who
links to a blocked host is distrusted). Rounds go on until no new host is reached
and the sum of all ranks has settled. A page without rule is blocked if its
host's distrust exceeds RATIO times its trust. All steps are DataFrame joins and
sums: edges and seeds are pre-aggregated per host pair, every iteration sums
partially before its shuffle, and a hub's join is left to adaptive skew splitting.

Defined cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is allowed; null html has no links; repeated rows count as pages of
their own; without cross-host links only the seeds decide; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acqlens.llm.storage import few, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
TOLERANCE = 1e-9  # least share of all mass that five rounds must add for the propagation to go on
RATIO = 1.0
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, or nulls. ``rules``: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts; relative links stay on their host and are no edges."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""), F.lit(1))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (
        pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(target).alias("dst"))
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trusted, distrusted).

    Row (walk, host): walk 0 carries trust along links, walk 1 distrust against them.
    Rounds start from (1 - damping) of the seeds; then ranks only grow, and the growth
    of their sum is the summed change.
    """
    both = edges.select(F.lit(0).alias("walk"), "src", "dst", "n").union(
        edges.select(F.lit(1).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    steps = settle(both.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    start = settle(seeds.select(F.expr("stack(2, 0, host, double(trusted), 1, host, double(distrusted)) as (walk, host, mass)"))
                   .where("mass > 0"))
    rank = given = start.select("walk", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    hosts, total = 0, 0.0
    for step in count():
        moved = steps.join(rank.withColumnRenamed("host", "src"), ["walk", "src"]).select(
            "walk", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        rank = moved.union(given).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
        if step % 5 == 4:
            rank = settle(rank)
            before, (hosts, total) = (hosts, total), rank.agg(F.count(F.lit(1)), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
            if hosts == before[0] and total - before[1] <= TOLERANCE * total:
                break
    return rank.groupBy("host").agg(
        F.sum(F.when(F.col("walk") == 0, F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("walk") == 1, F.col("mass")).otherwise(0.0)).alias("distrust"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    url = F.col(url_col)
    by_url = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = by_url.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = ruled.where("by_rule is not null").groupBy("host").agg(
        F.count_if(F.col("by_rule") == ALLOW).alias("trusted"), F.count_if(F.col("by_rule") == BLOCK).alias("distrusted"))
    scores = few(propagate(host_edges(pages, url_col, html_col), seeds))  # few hosts are broadcast, many joined by shuffle
    zero = F.lit(0.0)
    out = ruled.join(scores, "host", "left").select(
        id_col, "host", "path", "rule", "by_rule",
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    return out.select(id_col, "host", "path", "rule", F.coalesce(
        "by_rule", F.when(F.col("distrust") > ratio * F.col("trust"), BLOCK).otherwise(ALLOW)).alias("verdict"),
        "trust", "distrust")

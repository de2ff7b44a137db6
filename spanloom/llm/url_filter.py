"""URL rules and trust propagated over the link graph of hosts, in DataFrame operations only.

Rules (host, path) decide where one fits; the longest wins. All other hosts are judged by their
links: personalised PageRank walks forward from hosts with allowed pages (trust) and, over reversed
edges, from hosts with blocked pages (distrust: who links to blocked hosts is suspect), each by the share
of its pages that rules of the kind decide. Hosts whose
distrust is more than LIMIT times their trust are blocked, others allowed.

Edges are counted per pair of hosts before they are shuffled, so a host with a third of all pages
is a few rows. Each round joins ranks to edges; every few rounds are written to the shared folder. Defined
results: a null url or one without "://" has an empty host and path and no rule, and is allowed;
null html has no links; links of a host to itself and repeated links on a page don't count; without
links only seeds have rank; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES: tuple[tuple[str, str], ...] = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Rounds that are planned at once; they end when a step moves ranks by less in sum.
STEP = 8
CHANGE = 1e-4
LIMIT = 1.0
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def edges_of(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, n): pages of src that link to dst."""
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
    return links.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, change: float = CHANGE) -> DataFrame:
    """(walk, host, rank) by power iteration; edges: (walk, src, dst, n); seeds: (walk, host, mass) with masses that sum to 1 in each walk.

    Mass without an exit goes back to the seeds, which is the same as to let it go and to scale the result to 1. All walks
    go on together, STEP rounds at a time, until a step moves none by ``change`` in sum; the movement falls by ``damping`` in each round
    at least, so that comes.
    """
    out = edges.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    share = written(edges.join(out, ["walk", "src"]).select(F.col("walk").alias("w_"), "src", "dst", (F.col("n") / F.col("total")).alias("share")), "rank-share")
    start = seeds.select("walk", "host", (F.col("mass") * (1 - damping)).alias("part"))
    rank = written(seeds.select("walk", "host", F.col("mass").alias("rank")), "rank")
    while share.take(1):
        new = rank
        for _ in range(STEP):
            moved = share.join(new, (F.col("w_") == F.col("walk")) & (F.col("src") == F.col("host"))).select("walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("part"))
            new = moved.unionByName(start).groupBy("walk", "host").agg(F.sum("part").alias("rank"))
        new = written(new, "rank")
        both = new.unionByName(rank.select("walk", "host", (-F.col("rank")).alias("rank"))).groupBy("walk", "host").agg(F.sum("rank").alias("d"))
        by = max((r.by for r in both.groupBy("walk").agg(F.sum(F.abs("d")).alias("by")).collect()), default=0.0)  # a row for each walk
        discard(rank)
        rank = new
        if by < change:
            break
    discard(share)
    whole = rank.groupBy("walk").agg(F.sum("rank").alias("whole"))
    return rank.join(F.broadcast(whole), "walk").select("walk", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def _seeds(hosts: DataFrame, what: str) -> DataFrame | None:
    """Hosts of which rules of this kind decide any pages, by the share that they decide."""
    some = hosts.where(F.col(what) > 0).select("host", (F.col(what) / F.col("pages")).alias("w"))
    total = some.agg(F.sum("w")).first()[0]
    return some.select("host", (F.col("w") / total).alias("mass")) if total else None


def host_ranks(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(host, trust, distrust) of hosts that have any."""
    host = host_of(F.col(url_col))
    ruled = pages.select(host.alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = ruled.withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)[1])
    hosts = written(ruled.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")), "hosts")
    edges = written(edges_of(pages, host, F.col(html_col)), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    walks, seeds = None, None
    for walk, what, links in (("trust", "allow", edges), ("distrust", "block", back)):
        some = _seeds(hosts, what)
        if some is not None:
            some, links = some.withColumn("walk", F.lit(walk)), links.withColumn("walk", F.lit(walk))
            seeds, walks = (some, links) if seeds is None else (seeds.unionByName(some), walks.unionByName(links))
    if seeds is None:
        return hosts.limit(0).select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    ranks = personalised(walks, written(seeds, "rank-seeds"))
    of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("rank")).otherwise(0.0)).alias(walk)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust."""
    ranks = host_ranks(pages, url_col=url_col, html_col=html_col, rules=rules).withColumnRenamed("host", "ranked_")
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled_": verdict}).join(ranks, F.col("host") == F.col("ranked_"), "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > limit * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce("ruled_", method).alias("verdict"), "trust", "distrust")


def oracle(rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, damping: float = DAMPING, rounds: int = 64) -> str:
    """DuckDB SQL with page_id, host, path, rule and verdict of ``judged``, ranks by so many rounds one after the other."""
    rest = r"CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
    fits = ", ".join(f"('{what}', '{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')" for what, text in rules)
    link = LINK.replace("'", "''")
    steps = "".join(
        f"r{k + 1} AS MATERIALIZED (SELECT walk, host, sum(part) AS rank FROM (SELECT s.walk, dst AS host, rank * share * {damping} AS part FROM share s JOIN r{k} ON r{k}.walk = s.walk AND r{k}.host = s.src UNION ALL SELECT walk, host, mass * {1 - damping} FROM seed) GROUP BY ALL),\n"
        for k in range(rounds)
    )
    low = lambda t: f"translate({t}, '{UPPER}', '{LOWER}')"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, html, {rest} AS rest FROM pages),
p AS (SELECT r, page_id, html, coalesce({low("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM u),
rules(what, rule, h, start) AS (VALUES {fits}),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY r),
j AS (SELECT p.*, rule, what FROM p LEFT JOIN fit USING (r)),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (what = 'allow') AS allow, count(*) FILTER (what = 'block') AS block FROM j WHERE host <> '' GROUP BY host),
mass AS (SELECT 'trust' AS walk, host, allow / n AS w FROM hosts WHERE allow > 0 UNION ALL SELECT 'distrust', host, block / n FROM hosts WHERE block > 0),
seed AS MATERIALIZED (SELECT walk, host, w / sum(w) OVER (PARTITION BY walk) AS mass FROM mass),
link AS (SELECT host AS src, {low("unnest(list_distinct(regexp_extract_all(html, '" + link + "', 1)))")} AS dst, r FROM j WHERE host <> ''),
e AS (SELECT src, dst, count(DISTINCT r) AS n FROM link WHERE src <> dst GROUP BY ALL),
way AS (SELECT 'trust' AS walk, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
share AS MATERIALIZED (SELECT walk, src, dst, n / sum(n) OVER (PARTITION BY walk, src) AS share FROM way),
r0 AS MATERIALIZED (SELECT walk, host, mass AS rank FROM seed),
{steps}k AS (SELECT walk, host, rank / sum(rank) OVER (PARTITION BY walk) AS rank FROM r{rounds}),
v AS (SELECT host, coalesce(sum(rank) FILTER (walk = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (walk = 'distrust'), 0) AS distrust FROM k GROUP BY host)
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN coalesce(distrust, 0) > {limit} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN v USING (host)
"""

"""Mixing sources to target weights as a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; each pattern
offers its words once for a low cost and again, up to MAX_REPEATS times, for rising (convex) costs;
every source demands its quota. The flow from patterns to sources is solved on the driver: it has
a node for each pattern and source and none for documents. Each pattern's flow then selects
documents in a seeded order: whole repeats for all, and one use more for documents up to the
place where the rest of the flow is used up (the document at that place gives its first words). That place is found in two steps, by a histogram of
hash buckets and by the order inside one bucket, so no source is ever gathered in one task.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; an
empty membership takes nothing; rows that repeat in all columns used are interchangeable; an
empty table gives no rows; further columns are carried on request and otherwise not read; carried columns of the
result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

MAX_REPEATS = 3
#: Cost of a word's first, second, third ... use.
REPEAT_COST = (1, 4, 9)
BUCKETS = 65536
#: Patterns that the driver's flow takes; more is an error, since nothing may be dropped.
MAX_PATTERNS = 200_000
RESULT = ("members", "size", "source_size", "target", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of all words by weight; none above ``most`` times its source, the excess shared anew by weight."""
    out: dict[str | None, float] = {}
    total, free = float(sum(sizes.values())), list(sizes)
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if total * weights[s] / w > most * sizes[s]] if w > 0 else []
        if not over:
            out |= {s: total * weights[s] / w if w > 0 else 0.0 for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            total -= out[s]
            free.remove(s)
    return out


def min_cost_flow(offers: Sequence[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], costs: Sequence[int] = REPEAT_COST) -> list[dict[str | None, int]]:
    """For each pattern (members, words): words routed to each member.

    An arc start -> pattern of each cost carries one use of the pattern's words; arcs pattern -> source are free,
    source -> end hold the quotas. All arcs but the first cost nothing, and a use costs the same in every pattern. The
    cost of an augmenting path is thus that of its first arc, and cheapest paths come in order of the uses: a largest
    flow with one use of all patterns, made larger with two, then three, has least cost. Each of these is found
    by blocking flows over levels.
    """
    if list(costs) != sorted(costs):
        raise ValueError("costs of repetition must not fall")
    sources = list(quotas)
    n = len(offers) + len(sources) + 2
    start, end = n - 2, n - 1
    at = {s: len(offers) + i for i, s in enumerate(sources)}
    to: list[int] = []  # of each arc; the reverse arc is at index ^ 1
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, cap: int) -> int:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((cap, 0))
        return len(to) - 2

    uses = [arc(start, i, 0) for i in range(len(offers))]
    routes = [{s: arc(i, at[s], size * len(costs)) for s in dict.fromkeys(members) if s in at} for i, (members, size) in enumerate(offers)]
    for s, q in quotas.items():
        arc(at[s], end, q)
    for _ in costs:
        for k, (_, size) in zip(uses, offers, strict=True):
            left[k] += size
        while True:
            level = [-1] * n
            level[start] = 0
            line = [start]
            for a in line:
                for k in out[a]:
                    if left[k] > 0 and level[to[k]] < 0:
                        level[to[k]] = level[a] + 1
                        line.append(to[k])
            if level[end] < 0:
                break
            place = [0] * n
            path: list[int] = []
            a = start
            while True:
                if a == end:
                    push = min(left[k] for k in path)
                    for k in path:
                        left[k] -= push
                        left[k ^ 1] += push
                    first = next(i for i, k in enumerate(path) if left[k] == 0)
                    a = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while place[a] < len(out[a]):
                    k = out[a][place[a]]
                    if left[k] > 0 and level[to[k]] == level[a] + 1:
                        break
                    place[a] += 1
                else:
                    if a == start:
                        break
                    k = path.pop()
                    a = to[k ^ 1]
                    place[a] += 1
                    continue
                path.append(k)
                a = to[k]
    return [{s: left[k ^ 1] for s, k in r.items()} for r in routes]


def mix(docs: DataFrame, *, members: Column, size: Column, identity: Sequence[Column], weights=None, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of docs with the columns of ``carry``, and members, size, source_size, target, taken (words, repeats counted), which replace columns of these names.

    members: array of sources. weights: from the sorted sources to their weights; by default 1, 2, 3, repeating.
    The columns source_size and target are those of the first member.
    """
    spark = docs.sparkSession
    held = [(f"c{i}_", c) for i, c in enumerate(carry) if c not in RESULT]
    slim = written(
        docs.select(*[docs[c].alias(n) for n, c in held], F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("m"))).alias("pattern_"), members.alias("members_"), size.alias("size"), F.xxhash64(F.lit(seed), *identity).alias("order_"), F.xxhash64(F.lit(seed + 1), *identity).alias("tie_")),
        "mix-slim",
    )
    by = slim.groupBy("pattern_").agg(F.first(F.array_sort(F.array_distinct("members_"))).alias("m"), F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(by) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    by.sort(key=lambda r: r.pattern_)  # the flow depends on the order of patterns
    names = sorted({s for r in by for s in r.m}, key=lambda s: (s is None, s or ""))
    sizes = {s: 0 for s in names}
    for r in by:
        for s in r.m:
            sizes[s] += r.words
    weigh = weights(names) if weights else {s: 1 + i % 3 for i, s in enumerate(names)}
    aim = targets(sizes, weigh)
    flows = min_cost_flow([(tuple(r.m), r.words) for r in by], {s: round(t) for s, t in aim.items()})
    rows = []
    for r, f in zip(by, flows, strict=True):
        flow = sum(f.values())
        whole = min(MAX_REPEATS, flow // r.words) if r.words else 0
        rows.append((r.pattern_, int(whole), int(flow - whole * r.words), sizes[r.m[0]] if r.m else 0, aim[r.m[0]] if r.m else 0.0))
    plan = spark.createDataFrame(rows, "pattern_ string, whole_ bigint, rest_ bigint, source_size bigint, target double") if rows else spark.createDataFrame([], "pattern_ string, whole_ bigint, rest_ bigint, source_size bigint, target double")
    plan = F.broadcast(plan)  # a row for each pattern, at most MAX_PATTERNS
    bucket = F.pmod("order_", F.lit(BUCKETS)).alias("bucket_")
    sums = slim.groupBy("pattern_", bucket).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern_").orderBy("bucket_")
    edge = (
        sums.withColumn("upto_", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0))).join(plan.select("pattern_", "rest_"), "pattern_")
        .where("upto_ > rest_ and upto_ - words <= rest_ and rest_ > 0").select("pattern_", F.col("bucket_").alias("edge_"), (F.col("rest_") - F.col("upto_") + F.col("words")).alias("room_"))
    )
    # a row for each pattern, at most; words are positive inside it, so it is unique but for empty buckets
    edge = edge.groupBy("pattern_").agg(F.min(F.struct("edge_", "room_")).alias("e")).select("pattern_", "e.*")
    edge = written(edge, "mix-edge")
    rows_ = slim.withColumn("bucket_", F.pmod("order_", F.lit(BUCKETS))).join(plan, "pattern_").join(F.broadcast(edge), "pattern_", "left")
    within = rows_.where("bucket_ = edge_")
    line = Window.partitionBy("pattern_").orderBy("order_", "tie_", "size")
    within = within.withColumn("sum_", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # the last document chosen gives only its first words, so that the flow is met to the word
    within = within.withColumn("more_", F.greatest(F.lit(0), F.least("size", F.col("room_") - F.col("sum_") + F.col("size")))).drop("sum_")
    apart = rows_.where("edge_ is null or bucket_ <> edge_").withColumn("more_", F.when(F.col("bucket_") < F.col("edge_"), F.col("size")).otherwise(F.lit(0)))
    out = apart.unionByName(within)
    return out.select(*[F.col(n).alias(c) for n, c in held], F.col("members_").alias("members"), "size", "source_size", "target", (F.col("whole_") * F.col("size") + F.col("more_")).cast("bigint").alias("taken"))


def by_source(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None, seed: int = 17) -> DataFrame:
    """Each document in the one source that it names; see the module."""
    return mix(docs, members=F.array(docs[source_col]), size=words(docs[text_col]), identity=[docs[id_col], F.xxhash64(docs[text_col])], carry=[id_col] if carry is None else carry, seed=seed)


__all__ = ["by_source", "discard", "min_cost_flow", "mix", "targets", "words"]

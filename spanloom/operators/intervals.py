"""Algebra of half-open intervals, row-wise by owner: (owner columns, start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Union of each owner's intervals as disjoint ones; touching intervals become one."""
    line = Window.partitionBy(*owner).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = F.sum("new_").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*owner, "start", "end").distinct().withColumn("new_", new).withColumn("island_", island)
    return rows.groupBy(*owner, "island_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island_")


def length(rows: DataFrame, owner: Sequence[str], name: str = "length") -> DataFrame:
    return rows.groupBy(*owner).agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias(name))


def union(a: DataFrame, b: DataFrame, owner: Sequence[str]) -> DataFrame:
    return merged(a.select(*owner, "start", "end").unionByName(b.select(*owner, "start", "end")), owner)


def _segments(a: DataFrame, b: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Pieces between neighbouring endpoints with the number of a's and b's intervals over each."""

    def ends(df: DataFrame, name: str, other: str) -> DataFrame:
        up = df.select(*owner, F.col("start").alias("at"), F.lit(1).alias(name), F.lit(0).alias(other))
        return up.unionByName(df.select(*owner, F.col("end").alias("at"), F.lit(-1).alias(name), F.lit(0).alias(other)))

    steps = ends(a, "x", "y").unionByName(ends(b, "y", "x")).groupBy(*owner, "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    line = Window.partitionBy(*owner).orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*owner, F.col("at").alias("start"), F.lead("at").over(line).alias("end"), F.sum("x").over(upto).alias("x"), F.sum("y").over(upto).alias("y")).where(F.col("end").isNotNull())


def intersection(a: DataFrame, b: DataFrame, owner: Sequence[str]) -> DataFrame:
    return merged(_segments(a, b, owner).where("x > 0 and y > 0"), owner)


def difference(a: DataFrame, b: DataFrame, owner: Sequence[str]) -> DataFrame:
    """What is in a and not in b."""
    return merged(_segments(a, b, owner).where("x > 0 and y = 0"), owner)


def overlapping(a: DataFrame, b: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Intervals of a that share a point with one of b of the same owner, found by one sweep over both."""
    steps = _segments(a, b, owner).where("x > 0 and y > 0").select(*owner, F.col("start").alias("at"), F.lit(None).cast("bigint").alias("to")).distinct()
    line = Window.partitionBy(*owner).orderBy(F.desc("at"), F.col("to").isNotNull())
    rows = a.select(*owner, F.col("start").alias("at"), F.col("end").alias("to")).unionByName(steps)
    near = rows.withColumn("near", F.last(F.when(F.col("to").isNull(), F.col("at")), ignorenulls=True).over(line))
    return near.where("to is not null and near < to").select(*owner, F.col("at").alias("start"), F.col("to").alias("end"))


def scheduled(rows: DataFrame, owner: Sequence[str], tie: str | None = None) -> DataFrame:
    """A largest set of disjoint intervals of each owner: by end, then start, then ``tie``, take what starts at or after the last end.

    An owner's intervals are folded in one row; owners are sequences, so that is bounded by their length.
    """
    extra = [tie] if tie else []
    item = F.struct("end", "start", *extra)
    kind = rows.select(item.alias("x")).schema["x"].dataType.simpleString()
    zero = F.struct(F.lit(None).cast(rows.schema["end"].dataType).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda a, x: F.when(a["last"].isNull() | (x["start"] >= a["last"]), F.struct(x["end"].alias("last"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    fold = F.aggregate(F.array_sort(F.collect_list(item)), zero, step, lambda a: a["out"])
    return rows.groupBy(*owner).agg(fold.alias("x")).select(*owner, F.explode("x").alias("x")).select(*owner, "x.start", "x.end", *[f"x.{c}" for c in extra])


def depth(rows: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Pieces of each owner with the number of intervals over them: (owner, start, end, depth), where it isn't 0."""
    return _segments(rows, rows.limit(0), owner).select(*owner, "start", "end", F.col("x").alias("depth")).where("depth > 0")


def sliding_depth(depth_: DataFrame, sizes: DataFrame, owner: Sequence[str], window: int, stride: int) -> DataFrame:
    """Mean depth in windows at 0, stride, ... below the owner's size: (owner, middle, depth).

    A window over the end is moved back; one longer than the owner is the whole owner (its mean is over the actual width).
    """
    start = F.greatest(F.lit(0), F.least(F.col("w"), F.col("size") - window))
    wins = sizes.where("size > 0").withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(stride).cast("bigint"))))
    wins = wins.select(*owner, start.alias("ws"), F.least(start + window, F.col("size")).alias("we")).distinct()
    # pieces meet windows through the buckets they lie in
    bucket = lambda a, z: F.explode(F.sequence(F.floor(a / window), F.floor((z - 1) / window)))
    pieces = depth_.withColumn("bucket_", bucket(F.col("start"), F.col("end")))
    cut = wins.withColumn("bucket_", bucket(F.col("ws"), F.col("we"))).join(pieces, [*owner, "bucket_"])
    low = F.greatest("ws", "start", F.col("bucket_") * window)
    high = F.least("we", "end", (F.col("bucket_") + 1) * window)
    sums = cut.where(high > low).groupBy(*owner, "ws", "we").agg(F.sum(F.col("depth") * (high - low)).alias("total"))
    out = wins.join(sums, [*owner, "ws", "we"], "left")
    return out.select(*owner, (F.col("ws") + F.lit(window) / 2).alias("middle"), (F.coalesce("total", F.lit(0)) / (F.col("we") - F.col("ws"))).alias("depth"))

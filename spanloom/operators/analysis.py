"""How well probes cover genomes: covered letters, depth, sliding depth, and hits of each probe.

Covers are in genome coordinates: (group_id, genome_id, rc, probe_id, start, end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import depth, length, merged, sliding_depth

OWNER = ["group_id", "genome_id", "rc"]


def report(covers: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each genome and strand: bp_covered, frac, frac_unambig, depth, depth_unambig; shares of nothing are null."""
    bp = length(merged(covers, OWNER), OWNER, "bp")
    raw = length(covers, OWNER, "raw")
    rows = sizes.withColumn("rc", F.explode(F.array(F.lit(False), F.lit(True)))).join(bp, OWNER, "left").join(raw, OWNER, "left").na.fill(0, ["bp", "raw"])
    share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of))
    return rows.select(*OWNER, F.col("bp").alias("bp_covered"), share("bp", "size").alias("frac"), share("bp", "unambiguous").alias("frac_unambig"), share("raw", "size").alias("depth"), share("raw", "unambiguous").alias("depth_unambig"))


def depth_profile(covers: DataFrame) -> DataFrame:
    return depth(covers, OWNER)


def sliding(covers: DataFrame, sizes: DataFrame, window: int = 50, stride: int = 25) -> DataFrame:
    by = sizes.select("group_id", "genome_id", "size").withColumn("rc", F.explode(F.array(F.lit(False), F.lit(True))))
    return sliding_depth(depth(covers, OWNER), by, OWNER, window, stride)


def map_counts(covers: DataFrame, probes: DataFrame, *, with_zero: bool = True) -> DataFrame:
    """Sequences that each probe covers on the forward strand: (probe_id, seq, count)."""
    keys = [c for c in ("group_id", "genome_id", "chr_idx") if c in covers.columns]
    n = covers.where("not rc").groupBy("probe_id").agg(F.countDistinct(F.struct(*keys)).alias("count"))
    out = probes.select("probe_id", "seq").join(n, "probe_id", "left" if with_zero else "inner")
    return out.na.fill(0, ["count"])


def percent(x: Column) -> Column:
    """A share as text, with a floor for tiny ones."""
    return F.when(x == 0, F.lit("0%")).when(x < 0.0001, F.lit("<0.01%")).otherwise(F.format_string("%.2f%%", x * 100))


def two_decimals(x: Column) -> Column:
    return F.when(x == 0, F.lit("0")).when(x < 0.01, F.lit("<0.01")).otherwise(F.format_string("%.2f", x))


def console(report_: DataFrame, *more: str) -> DataFrame:
    """The report as text columns, and columns ``more``."""
    return report_.select(*OWNER, *more, F.concat("bp_covered", F.lit(" ("), percent(F.col("frac")), F.lit(" / "), percent(F.col("frac_unambig")), F.lit(")")).alias("covered"), F.concat(two_decimals(F.col("depth")), F.lit(" / "), two_decimals(F.col("depth_unambig"))).alias("depth"))


def table_text(rows: list[list[str]], align: list[str]) -> str:
    """Justified text of a table whose cells may have several lines; align has left, center or right for each column."""
    cells = [[str(c).split("\n") for c in r] for r in rows]
    width = [max((len(line) for r in cells for line in r[i]), default=0) for i in range(len(align))]
    put = {"left": str.ljust, "right": str.rjust, "center": str.center}
    lines = []
    for r in cells:
        for k in range(max(len(c) for c in r)):
            lines.append(" ".join(put[align[i]](c[k] if k < len(c) else "", width[i]) for i, c in enumerate(r)).rstrip())
    return "\n".join(lines)

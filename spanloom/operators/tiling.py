"""Candidate windows of sequences, fragments, and genome sizes.

Sequences are rows (group_id, genome_id, chr_idx, seq); windows carry the order in which a genome's
candidates are numbered: kind (0 strided, 1 tail, 2 flank) and position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import windows

from .shared import materialized

KEYS = ("group_id", "genome_id", "chr_idx")


def starts(length: Column, window: int, stride: int) -> Column:
    """0, stride, 2 stride ... while the window fits; empty if it never does."""
    return F.when(length >= window, F.sequence(F.lit(0), length - window, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def pieces(seqs: DataFrame, overlap: int, sizes: tuple[int, ...] = (20_000, 250)) -> DataFrame:
    """seqs in pieces (``from``, ``part`` instead of seq) that overlap by so many letters.

    Substrings are found by walking over a text from its start, so windows are cut from short pieces, these from longer ones.
    """
    keys = [c for c in seqs.columns if c != "seq"]
    out = seqs.select(*keys, F.lit(0).alias("from"), F.col("seq").alias("part"))
    for size in sizes:
        n = F.char_length("part")
        at = F.when(n > overlap, F.sequence(F.lit(0), n - overlap - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        out = out.select(*keys, "from", "part", F.explode(at).alias("at")).select(*keys, (F.col("from") + F.col("at")).alias("from"), F.substring("part", F.col("at") + 1, F.lit(size + overlap)).alias("part"))
    return out


def pieces_around(seqs: DataFrame, reach: int, sizes: tuple[int, ...] = (20_000, 250)) -> DataFrame:
    """seqs in pieces that know their surroundings (n, from, size, lead, part instead of seq).

    A piece is letters from .. from + size of the sequence's n; ``part`` begins ``lead`` letters before it and goes on
    behind it, both ``reach`` letters, or to the sequence's ends.
    """
    keys = [c for c in seqs.columns if c != "seq"]
    n = F.char_length("seq")
    out = seqs.select(*keys, n.alias("n"), F.lit(0).alias("from"), n.alias("size"), F.lit(0).alias("lead"), F.col("seq").alias("part"))
    for size in sizes:
        at = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        out = out.select(*keys, "n", "from", "size", "lead", "part", F.explode(at).alias("at"))
        lead = F.least(F.lit(reach), F.col("lead") + F.col("at"))
        out = out.select(*keys, "n", (F.col("from") + F.col("at")).alias("from"), F.least(F.lit(size), F.col("size") - F.col("at")).alias("size"), lead.alias("lead"), F.substring("part", F.col("lead") + F.col("at") - lead + 1, lead + size + reach).alias("part"))
    return out


def candidates(seqs: DataFrame, window: int, stride: int, *, n_run: int = 2, allow_small: int | None = None, skip: int | None = None, flanks: bool = True) -> DataFrame:
    """Windows (keys, kind, pos, seq): strided, the tail where length is no multiple of stride, and next to runs of N.

    Windows with a run of ``n_run`` N are left out. A sequence below the window is an error, or whole if it has
    at least ``allow_small`` letters and no run; sequences of at most ``skip`` letters are passed over.
    """
    kinds = ", ".join(f"{c} {seqs.schema[c].dataType.simpleString()}" for c in KEYS)
    return seqs.select(*KEYS, "seq").mapInArrow(windows.tiling(KEYS, window, stride, n_run, allow_small, skip, flanks), f"{kinds}, kind int, pos int, seq string")


def spelt(texts: DataFrame) -> DataFrame:
    """texts (keys, text) as sequences (keys, seq) by ``sequences.dna_of_text``; null is an empty sequence."""
    keys = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != "text")
    return texts.withColumn("text", F.lower("text")).mapInArrow(windows.spelling(keys, "text"), f"{kinds}, seq string")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of all substrings of k letters; tasks count theirs, so that few rows are added up."""
    return seqs.select("seq").mapInArrow(windows.counting(k), "kmer string, n bigint").groupBy("kmer").agg(F.sum("n").alias("n"))


def fragments(seqs: DataFrame, size: int, *, full_end: bool = False) -> DataFrame:
    """Consecutive pieces (keys, pos, seq); the last one is short, or with ``full_end`` the last ``size`` letters."""
    reach = size if full_end else 0
    cut = pieces_around(seqs.where(F.char_length("seq") > 0).select(*KEYS, "seq"), reach, (size * max(1, 20_000 // size), size))
    short = F.lit(full_end) & (F.col("size") < size)
    pos = F.when(short, F.greatest(F.col("n") - size, F.lit(0))).otherwise(F.col("from"))
    return cut.select(*KEYS, pos.alias("pos"), F.substring("part", pos - F.col("from") + F.col("lead") + 1, F.when(short, F.lit(size)).otherwise(F.col("size"))).alias("seq"))


def genome_sizes(seqs: DataFrame) -> DataFrame:
    """(group_id, genome_id, size, unambiguous, chromosomes)."""
    from spanloom.functions.sequences import unambiguous_length

    return seqs.groupBy("group_id", "genome_id").agg(F.sum(F.char_length("seq")).cast("bigint").alias("size"), F.sum(unambiguous_length(F.col("seq"))).cast("bigint").alias("unambiguous"), F.count(F.lit(1)).alias("chromosomes"))


def offsets(seqs: DataFrame) -> DataFrame:
    """seqs with the length of the genome's earlier chromosomes as ``offset``."""
    before = Window.partitionBy("group_id", "genome_id").orderBy("chr_idx").rowsBetween(Window.unboundedPreceding, -1)
    return seqs.withColumn("offset", F.coalesce(F.sum(F.char_length("seq")).over(before), F.lit(0)).cast("bigint"))


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """rows with their place (from 0) in the order of their group, as a table; a group is sorted by many tasks.

    Rows are dealt by ranges, sorted and counted there; ``order`` must tell rows apart.
    """
    some = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    some = materialized(some.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "placed")
    starts = some.groupBy(group, "part_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("before_", F.coalesce(before, F.lit(0)))
    return some.join(starts, [group, "part_"]).select(*rows.columns, (F.col("before_") + F.col("at_") - F.col("first_")).cast("bigint").alias(name))


def numbered(candidates_: DataFrame) -> DataFrame:
    """Distinct windows of each group in order of first occurrence: (group_id, probe_id, seq, times)."""
    first = F.min(F.struct("genome_id", "chr_idx", "kind", "pos"))
    once = candidates_.groupBy("group_id", "seq").agg(first.alias("first"), F.count(F.lit(1)).alias("times")).select("group_id", "seq", "times", "first.*")
    return placed(once, "group_id", ["genome_id", "chr_idx", "kind", "pos", "seq"], "probe_id").select("group_id", "probe_id", "seq", "times")

"""Analysis of how a probe set covers target genomes, and its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.sequences import identifier
from spanloom.operators import analysis, cover, filters, tiling
from spanloom.operators.shared import materialized
from spanloom.sources.tables import write_tsv

from .pipeline import DesignConfig, covers_of


@dataclass
class Analysis:
    """Results of one analysis: report by genome and strand, sliding depth, and sequences that each probe maps to."""

    report: DataFrame
    sliding: DataFrame
    map_counts: DataFrame
    probes: DataFrame

    def matrix(self) -> DataFrame:
        """The report as a table (Genome, Num bases covered, ...), genomes in order, each strand a row."""
        line = ["group_id", "genome_id", "rc"]
        return self.report.orderBy(*line).select(
            _named().alias("Genome"), F.col("bp_covered").alias("Num bases covered"), F.col("frac").alias("Frac bases covered"), F.col("frac_unambig").alias("Frac bases covered over unambig"),
            F.col("depth").alias("Average coverage/depth"), F.col("depth_unambig").alias("Average coverage/depth over unambig"),
        )

    def windows(self) -> DataFrame:
        """(genome, position, depth) of sliding windows, in order; written without a header."""
        return self.sliding.orderBy("group_id", "genome_id", "rc", "middle").select(_named().alias("genome"), "middle", "depth")

    def counts(self) -> DataFrame:
        """(Probe identifier, Probe sequence, Number sequences mapped to)."""
        return self.map_counts.select(identifier(F.col("seq")).alias("Probe identifier"), F.col("seq").alias("Probe sequence"), F.col("count").alias("Number sequences mapped to"))

    def write(self, matrix: str | None = None, windows: str | None = None, counts: str | None = None) -> None:
        if matrix:
            write_tsv(self.matrix(), matrix)
        if windows:
            write_tsv(self.windows(), windows, header=False)
        if counts:
            write_tsv(self.counts(), counts)

    def text(self) -> str:
        """The number of probes and the report as a justified table; a line for each genome and strand comes to the driver."""
        rows = analysis.console(self.report.withColumn("named", _named()), "named").orderBy("group_id", "genome_id", "rc").select("named", "covered", "depth").collect()
        cells = [["Genome", "Num bases covered\n[over unambig]", "Average coverage/depth\n[over unambig]"], *[list(r) for r in rows]]
        return f"NUMBER OF PROBES: {self.probes.count()}\n\n" + analysis.table_text(cells, ["left", "right", "right"])


def _named() -> Column:
    """<group>, genome <number>, and (rc) for the other strand."""
    return F.concat(F.coalesce(F.col("group_name"), F.concat(F.lit("Group "), "group_id")), F.lit(", genome "), F.col("genome_id"), F.when(F.col("rc"), F.lit(" (rc)")).otherwise(F.lit("")))


def analysed(seqs: DataFrame, probes: DataFrame, config: DesignConfig, *, window: int = 50, stride: int = 25, rc_too: bool = True) -> Analysis:
    """How probes (seq) cover sequences (group_id, group_name?, genome_id, chr_idx, seq), under the cover model of ``config``."""
    if config.limit_genomes:
        seqs = filters.first_per_group(seqs, config.limit_genomes)
    names = seqs.select("group_id", *(["group_name"] if "group_name" in seqs.columns else [F.lit(None).cast("string").alias("group_name")])).distinct()
    probes = probes.select("seq").distinct().select(F.lit(0).alias("group_id"), F.xxhash64("seq").alias("probe_id"), "seq")
    plain = seqs.select("group_id", "genome_id", "chr_idx", "seq")
    found = covers_of(probes, cover.both_strands(plain, rc_too), config)
    found = cover.extended(found, plain, config.cover_extension) if config.cover_extension else found
    found = materialized(found, "analysis-covers")
    whole = cover.in_genome(found, tiling.offsets(plain))
    sizes = tiling.genome_sizes(plain)
    keep = F.lit(True) if rc_too else ~F.col("rc")
    return Analysis(analysis.report(whole, sizes).where(keep).join(names, "group_id"), analysis.sliding(whole, sizes, window, stride).where(keep).join(names, "group_id"), analysis.map_counts(found, probes, with_zero=False), probes)

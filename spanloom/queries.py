"""Queries over the driver's tables for the library's own operators, with SQL where SQL can express them.

Documents are genomes (group: language) over a DNA encoding of their text; benchmark items give probes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.sequences import identifier, jaccard_of_mash, jaccard_of_mash_column, reverse_complement, round_down, round_up, signature
from spanloom.operators import adapters, analysis, cluster, cover, design, filters, index, intervals, near_duplicates, tiling
from spanloom.operators.shared import materialized, scratch
from spanloom.plans import coverage, pipeline, pool
from spanloom.sources import ranges

L, S = 30, 15
#: Sequences shorter than windows are taken whole from so many letters on.
SMALL = 5
GROUPS = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.lit(len(GROUPS))
    for i, g in enumerate(GROUPS):
        group = F.when(F.col("lang") == g, i).otherwise(group)
    return tiling.spelt(table(spark, sf_dir, "documents").select(group.alias("group_id"), F.col("doc_id").alias("genome_id"), F.lit(0).alias("chr_idx"), "text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.spelt(table(spark, sf_dir, "benchmark").select(F.lit(0).alias("group_id"), F.col("item_id").alias("genome_id"), F.lit(0).alias("chr_idx"), "text"))


def windows(seqs: DataFrame) -> DataFrame:
    return tiling.candidates(seqs, L, S, skip=L - 1)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct windows of benchmark items; a probe's id is the hash of its sequence, alike in all groups."""
    return windows(items(spark, sf_dir)).select("seq").distinct().select(F.lit(0).alias("group_id"), F.xxhash64("seq").alias("probe_id"), "seq", F.lit(1).alias("times"))


def benchmark_covers(spark: SparkSession, sf_dir: str, m: int = 0, strands: bool = False) -> DataFrame:
    seqs = genomes(spark, sf_dir)
    return cover.covers_full(probes(spark, sf_dir), cover.both_strands(seqs) if strands else seqs, L, m)


def named(covers: DataFrame, probes_: DataFrame) -> DataFrame:
    return covers.join(probes_.select("probe_id", "seq"), "probe_id")


def seq_stats(spark, sf_dir):
    return tiling.genome_sizes(genomes(spark, sf_dir))


def seq_reverse_complement(spark, sf_dir):
    return genomes(spark, sf_dir).select("genome_id", F.md5(reverse_complement(F.col("seq"))).alias("rc_md5"))


def seq_fragments(spark, sf_dir):
    return tiling.fragments(genomes(spark, sf_dir), 500).select("genome_id", F.col("pos").cast("bigint").alias("pos"), F.md5("seq").alias("part_md5"))


def seq_kmer_counts(spark, sf_dir):
    return tiling.kmer_counts(genomes(spark, sf_dir), 6)


def small_or_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes without short ones that have a run of N, which are an error."""
    return genomes(spark, sf_dir).where((F.char_length("seq") >= L) | ~F.contains("seq", F.lit("NN")))


def seq_candidates_small(spark, sf_dir):
    return tiling.candidates(small_or_tall(spark, sf_dir), L, S, allow_small=SMALL, skip=SMALL - 1).select("group_id", "genome_id", "kind", F.col("pos").cast("bigint").alias("pos"), "seq")


def join_short(spark, sf_dir):
    """Where sequences that are shorter than windows occur."""
    n = F.char_length("seq")
    p = small_or_tall(spark, sf_dir).where((n >= SMALL) & (n < L)).select("seq").distinct().select(F.lit(0).alias("group_id"), F.xxhash64("seq").alias("probe_id"), "seq")
    found = cover.covers_whole(p, genomes(spark, sf_dir))
    return named(found, p).select("genome_id", "seq", "start", "end")


def seq_candidates(spark, sf_dir):
    return windows(genomes(spark, sf_dir)).select("group_id", "genome_id", "kind", F.col("pos").cast("bigint").alias("pos"), "seq")


def dedup_multiplicity(spark, sf_dir):
    return near_duplicates.multiplicity(windows(genomes(spark, sf_dir)))


def dedup_union_distinct(spark, sf_dir):
    return filters.union_distinct(windows(genomes(spark, sf_dir)))


def filter_fasta_membership(spark, sf_dir):
    fasta = windows(items(spark, sf_dir)).select(F.lit("").alias("header"), "seq", F.col("genome_id").alias("seq_index"))
    return filters.in_fasta(windows(genomes(spark, sf_dir)), fasta).select("genome_id", F.col("pos").cast("bigint").alias("pos"), "kind", "seq", "place")


def filter_poly(spark, sf_dir):
    return filters.without_poly(windows(genomes(spark, sf_dir)), 9, 1).select("genome_id", "kind", F.col("pos").cast("bigint").alias("pos"))


def filter_first_per_group(spark, sf_dir):
    return filters.first_per_group(genomes(spark, sf_dir), 20).select("group_id", "genome_id")


def filter_sample_per_group(spark, sf_dir):
    return filters.sample_per_group(genomes(spark, sf_dir), 25, 3)


def expand_n(spark, sf_dir):
    return filters.expanded(windows(genomes(spark, sf_dir)).select("seq").distinct(), 2).distinct()


def probe_identifier(spark, sf_dir):
    return probes(spark, sf_dir).select("seq", identifier(F.col("seq")).alias("identifier"))


def probe_reverse_complements(spark, sf_dir):
    return filters.with_reverse_complements(probes(spark, sf_dir).select("seq")).select("seq", F.length("header").alias("n_header"))


def hamming_pairs(spark, sf_dir):
    rows = windows(genomes(spark, sf_dir)).select("seq").distinct().select(F.lit(0).alias("group_id"), "seq")
    return near_duplicates.hamming_pairs(rows, L, 2).select("a", "b", "mismatches")


def jaccard_pairs(spark, sf_dir):
    rows = items(spark, sf_dir).select("group_id", F.col("genome_id").alias("probe_id"), "seq")
    return near_duplicates.jaccard_pairs(rows, 6, 0.99).select("a", "b", F.round("distance", 9).alias("distance"))


def minhash_signatures(spark, sf_dir):
    return items(spark, sf_dir).select("genome_id", F.array_join(signature(F.col("seq"), 10, 20, cluster.A, cluster.B).cast("array<string>"), ",").alias("sig"))


def mash_distances(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(jaccard_of_mash_column((F.col("n_nationkey") + 1) / 100, 12), 9).alias("distance"), round_up(F.col("n_nationkey"), 7).alias("up"), round_down(F.col("n_nationkey"), 7).alias("down"))


def join_exact(spark, sf_dir):
    return named(benchmark_covers(spark, sf_dir), probes(spark, sf_dir)).select("genome_id", "start", "end", "seq")


def join_mismatch(spark, sf_dir):
    return named(benchmark_covers(spark, sf_dir, 2), probes(spark, sf_dir)).select("genome_id", "start", "end", "seq")


def join_persisted(spark, sf_dir):
    """One index of the probes, written once and joined with two targets: the documents and their reverse complements."""
    made = index.save(probes(spark, sf_dir), scratch(spark, "probe-index"), L)
    strands = cover.both_strands(genomes(spark, sf_dir))
    hits = [index.covers(made, strands.where("rc" if rc else "not rc")) for rc in (False, True)]
    return named(hits[0].unionByName(hits[1]), probes(spark, sf_dir)).select("genome_id", "rc", "start", "end", "seq")


def join_seeded(spark, sf_dir):
    p = probes(spark, sf_dir)
    return cover.covers_seeded(p, genomes(spark, sf_dir), cover.full_index(p, 8), 8, cover.predicate(2, 24)).select("genome_id", "probe_id", "start", "end")


def _lines(spark, sf_dir):
    at = F.pmod("l_partkey", F.lit(1000))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", at.cast("bigint").alias("start"), (at + F.col("l_quantity").cast("bigint")).cast("bigint").alias("end"), "l_returnflag", "l_linestatus")


def interval_merge(spark, sf_dir):
    return intervals.merged(_lines(spark, sf_dir), ["l_suppkey"])


def _two(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.where("l_returnflag = 'R'"), rows.where("l_linestatus = 'O'")


def interval_union(spark, sf_dir):
    return intervals.union(*_two(spark, sf_dir), ["l_suppkey"])


def interval_intersection(spark, sf_dir):
    return intervals.intersection(*_two(spark, sf_dir), ["l_suppkey"])


def interval_difference(spark, sf_dir):
    return intervals.difference(*_two(spark, sf_dir), ["l_suppkey"])


def interval_lengths(spark, sf_dir):
    return intervals.length(intervals.merged(_lines(spark, sf_dir), ["l_suppkey"]), ["l_suppkey"])


def interval_schedule(spark, sf_dir):
    return intervals.scheduled(_lines(spark, sf_dir), ["l_suppkey"]).select("l_suppkey", "start", "end")


def coverage_report(spark, sf_dir):
    found = benchmark_covers(spark, sf_dir, strands=True).drop("chr_idx")
    r = analysis.report(found, tiling.genome_sizes(genomes(spark, sf_dir)))
    return r.select("genome_id", "rc", "bp_covered", *[F.round(c, 9).alias(c) for c in ("frac", "frac_unambig", "depth", "depth_unambig")])


def coverage_depth(spark, sf_dir):
    return analysis.depth_profile(benchmark_covers(spark, sf_dir, strands=True).drop("chr_idx")).select("genome_id", "rc", "start", "end", F.col("depth").cast("bigint").alias("depth"))


def coverage_sliding(spark, sf_dir):
    found = benchmark_covers(spark, sf_dir, strands=True).drop("chr_idx")
    return analysis.sliding(found, tiling.genome_sizes(genomes(spark, sf_dir)), 500, 250).select("genome_id", "rc", "middle", F.round("depth", 9).alias("depth"))


def coverage_map_counts(spark, sf_dir):
    return analysis.map_counts(benchmark_covers(spark, sf_dir).withColumn("rc", F.lit(False)), probes(spark, sf_dir)).select("seq", "count")


def coverage_console(spark, sf_dir):
    found = benchmark_covers(spark, sf_dir, strands=True).drop("chr_idx")
    return analysis.console(analysis.report(found, tiling.genome_sizes(genomes(spark, sf_dir))))


def analysis_matrix(spark, sf_dir):
    name = F.lit("other")
    for i, g in enumerate(GROUPS):
        name = F.when(F.col("group_id") == i, g).otherwise(name)
    found = coverage.analysed(genomes(spark, sf_dir).withColumn("group_name", name), probes(spark, sf_dir), pipeline.DesignConfig(probe_length=L, probe_stride=S, kmer=15, small_skip=L - 1)).matrix()
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def rank_groups_hit(spark, sf_dir):
    return named(design.groups_hit(benchmark_covers(spark, sf_dir, strands=True)), probes(spark, sf_dir)).select("seq", "hits")


def rank_avoided(spark, sf_dir):
    return named(design.avoided_letters(benchmark_covers(spark, sf_dir, strands=True)), probes(spark, sf_dir)).select("seq", "bp")


def rank_probes(spark, sf_dir):
    found = benchmark_covers(spark, sf_dir, strands=True)
    avoided = design.avoided_letters(found.where("group_id = 0"))
    p = probes(spark, sf_dir)
    return named(design.ranks(p, design.groups_hit(found), avoided).drop("group_id"), p).select("seq", F.col("rank").cast("bigint").alias("rank"))


def graph_components(spark, sf_dir):
    rows = windows(genomes(spark, sf_dir)).select("seq").distinct().select(F.lit(0).alias("group_id"), "seq")
    pairs = materialized(near_duplicates.hamming_pairs(rows, L, 1).select(F.col("a").alias("i"), F.col("b").alias("j")), "graph-pairs")
    nodes = pairs.select(F.col("i").alias("node")).unionByName(pairs.select(F.col("j").alias("node"))).distinct()
    return cluster.components(nodes, pairs)


def _grid(spark, sf_dir):
    cell = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.floor(F.col("p_size") / 10).cast("double").alias("m"), (F.pmod("p_partkey", F.lit(4)) * 10).cast("double").alias("e"))
    return cell.groupBy("dataset", "m", "e").agg(F.count(F.lit(1)).alias("num_probes"))


def pool_interpolation(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    at = grid.select("dataset").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("dataset", (F.col("k") * 0.5).alias("m"), (F.col("k") * 3.0 + 1).alias("e"))
    return pool.rectangle_interpolated(at, grid, "m", "e").select("dataset", "m", "e", F.round("num_probes", 9).alias("num_probes"))


def pool_bounds(spark, sf_dir):
    return pool.bounds(_grid(spark, sf_dir), ["m", "e"])


def pool_standard_bounds(spark, sf_dir):
    b = pool.standard_bounds(_grid(spark, sf_dir), "m", "e")
    return b.select("dataset", "m_low", F.round("m_high", 9).alias("m_high"), "e_low", F.round("e_high", 9).alias("e_high"))


def pool_search(spark, sf_dir):
    counts = pool.counts_of(_grid(spark, sf_dir), ["m", "e"])
    # more tolerant parameters never need more probes
    counts = {d: {k: sum(v for q, v in c.items() if all(a >= b for a, b in zip(q, k, strict=True))) for k in c} for d, c in counts.items()}
    limit = 0.6 * sum(max(c.values()) for c in counts.values()) + 1
    best = pool.search(counts, limit, coefficients=(1.0, 0.01))
    return spark.createDataFrame([(d, float(x), float(y), int(counts[d][(x, y)])) for d, (x, y) in sorted(best.items())], "dataset string, m double, e double, num_probes bigint")


def near_hamming(spark, sf_dir):
    return near_duplicates.without_near(tiling.numbered(windows(genomes(spark, sf_dir))), hamming=2).select("group_id", "probe_id", "seq")


def near_jaccard(spark, sf_dir):
    rows = tiling.numbered(windows(items(spark, sf_dir)))
    return near_duplicates.without_near(rows, jaccard=0.5, kmer=6).select("probe_id", "seq")


def near_redundant(spark, sf_dir):
    rows = tiling.numbered(windows(items(spark, sf_dir)))
    pairs = near_duplicates.redundant_pairs(rows, near_duplicates.common_stretch_redundant(15, 1), 10)
    return near_duplicates.without_redundant(rows, pairs).select("probe_id", "seq")


def near_dominating(spark, sf_dir):
    rows = tiling.numbered(windows(items(spark, sf_dir)))
    pairs = near_duplicates.redundant_pairs(rows, near_duplicates.common_stretch_redundant(15, 1), 10)
    return near_duplicates.dominating(rows, pairs).select("probe_id", "seq")


def design_probes(spark, sf_dir):
    return pipeline.designed(genomes(spark, sf_dir), pipeline.DesignConfig(probe_length=L, probe_stride=S, kmer=15, small_skip=L - 1)).select("seq")


def design_adapters(spark, sf_dir):
    """Probes are pooled over all languages: every document is a sequence of the probes' group."""
    p = probes(spark, sf_dir)
    found = benchmark_covers(spark, sf_dir).withColumn("group_id", F.lit(0))
    return adapters.assigned(p, found).select("seq", "votes_a", "votes_b", "adapter")


def cluster_simple(spark, sf_dir):
    return cluster.simple(items(spark, sf_dir).select(F.col("genome_id").alias("seq_id"), "seq"), 0.1)


def cluster_average(spark, sf_dir):
    return cluster.hierarchical(items(spark, sf_dir).select(F.col("genome_id").alias("seq_id"), "seq"), 0.1)


def _named_documents(spark, sf_dir):
    return genomes(spark, sf_dir).select(F.col("genome_id").alias("seq_id"), "seq")


def cluster_simple_documents(spark, sf_dir):
    return cluster.simple(_named_documents(spark, sf_dir), 0.1)


def cluster_average_documents(spark, sf_dir):
    return cluster.hierarchical(_named_documents(spark, sf_dir), 0.1)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a probe set over genomes."""
    return coverage_report(spark, sf_dir)


def fasta_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sequences as the FASTA source reads them from files that its sink wrote, by genome."""
    ranges.register(spark)
    path = scratch(spark, "fasta")
    genomes(spark, sf_dir).select(F.concat_ws("|", "genome_id", "group_id").alias("header"), "seq").write.format("fasta").mode("overwrite").save(path)
    rows = spark.read.format("fasta").option("splitBytes", 8 << 20).load(path)
    part = F.split("header", r"\|")
    return rows.select(part[0].cast("bigint").alias("genome_id"), part[1].cast("int").alias("group_id"), F.length("seq").alias("length"), F.md5("seq").alias("seq_md5"))


_NAMES = """seq_stats fasta_written seq_reverse_complement seq_fragments seq_kmer_counts seq_candidates dedup_multiplicity dedup_union_distinct filter_fasta_membership
filter_poly filter_first_per_group filter_sample_per_group expand_n probe_identifier probe_reverse_complements hamming_pairs jaccard_pairs minhash_signatures
mash_distances join_exact join_mismatch join_persisted join_seeded join_short seq_candidates_small analysis_matrix pool_standard_bounds interval_merge interval_union interval_intersection interval_difference interval_lengths interval_schedule
coverage_report coverage_depth coverage_sliding coverage_map_counts coverage_console rank_groups_hit rank_avoided rank_probes graph_components pool_interpolation
pool_bounds pool_search near_hamming near_jaccard near_redundant near_dominating design_probes design_adapters cluster_simple cluster_average cluster_simple_documents cluster_average_documents""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


def _dna(text: str) -> str:
    return f"translate(regexp_replace(replace(replace(lower({text}), '. ', '##'), ' ', ''), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


_CASE = "CASE lang " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GROUPS)) + f" ELSE {len(GROUPS)} END"
_G = f"g AS (SELECT {_CASE} AS group_id, doc_id AS genome_id, coalesce({_dna('text')}, '') AS seq FROM documents)"
_I = f"i AS (SELECT 0 AS group_id, item_id AS genome_id, coalesce({_dna('text')}, '') AS seq FROM benchmark)"


def _w(name: str, source: str) -> str:
    """All windows of a source: strided, tail, flanks."""
    n = "length(seq)"
    return f"""{name} AS (
  SELECT group_id, genome_id, kind, pos, substr(whole, pos + 1, {L}) AS seq FROM (
    SELECT group_id, genome_id, 0 AS kind, unnest(range(0, {n} - {L} + 1, {S})) AS pos, seq AS whole FROM {source} WHERE {n} >= {L}
    UNION ALL SELECT group_id, genome_id, 1, {n} - {L}, seq FROM {source} WHERE {n} >= {L} AND {n} % {S} <> 0
    UNION ALL SELECT group_id, genome_id, 2, p - 1 - {L}, seq FROM (SELECT *, unnest(range(1, {n} + 1)) AS p FROM {source} WHERE {n} >= {L})
      WHERE substr(seq, p, 2) = 'NN' AND (p = 1 OR substr(seq, p - 1, 1) <> 'N') AND p - 1 >= {L}
    UNION ALL SELECT group_id, genome_id, 2, p, seq FROM (SELECT *, unnest(range(2, {n} + 1)) AS p FROM {source} WHERE {n} >= {L})
      WHERE substr(seq, p - 1, 2) = 'NN' AND (p = {n} OR substr(seq, p + 1, 1) <> 'N') AND p + {L} <= {n}
  ) WHERE NOT contains(substr(whole, pos + 1, {L}), 'NN'))"""


_P = f"{_w('iw', 'i')}, p AS (SELECT DISTINCT seq FROM iw)"
_ALL = f"a AS (SELECT group_id, genome_id, s AS start, s + {L} AS \"end\", substr(seq, s + 1, {L}) AS win FROM (SELECT *, unnest(range(0, length(seq) - {L} + 1)) AS s FROM g WHERE length(seq) >= {L}))"
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_BOTH = f"b AS (SELECT group_id, genome_id, false AS rc, seq FROM g UNION ALL SELECT group_id, genome_id, true, {_RC} FROM g)"
_C = f"c AS (SELECT group_id, genome_id, rc, s AS start, s + {L} AS \"end\", p.seq FROM (SELECT *, unnest(range(0, length(seq) - {L} + 1)) AS s FROM b WHERE length(seq) >= {L}) x JOIN p ON p.seq = substr(x.seq, s + 1, {L}))"
_NAME = "CASE group_id " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GROUPS)) + " ELSE 'other' END"
_COVERS = f"{_G}, {_I}, {_P}, {_BOTH}, {_C}"
_LINES = "l AS (SELECT l_suppkey, (l_partkey % 1000)::BIGINT AS start, (l_partkey % 1000 + l_quantity::BIGINT)::BIGINT AS \"end\", l_returnflag, l_linestatus FROM lineitem)"


def _points(where: str) -> str:
    return f"SELECT DISTINCT l_suppkey, unnest(range(start, \"end\")) AS x FROM l WHERE {where}"


def _islands(points: str) -> str:
    return f"""WITH {_LINES}, pts AS ({points}),
o AS (SELECT l_suppkey, x, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS k FROM pts)
SELECT l_suppkey, min(x) AS start, max(x) + 1 AS "end" FROM o GROUP BY l_suppkey, k"""


_RUN = "list_max(list_transform(range(1, len({e}) - 1), lambda q: {e}[q + 2] - {e}[q] - 1))"


def _poly(letter: str) -> str:
    ends = f"list_concat([-1], list_concat(list_filter(range(0, {L}), lambda q: substr(seq, q + 1, 1) <> '{letter}'), [{L}]))"
    return f"(CASE WHEN len({ends}) <= 3 THEN {L} ELSE {_RUN.format(e=ends)} END >= 9)"


SQL: dict[str, str] = {
    "seq_stats": f"WITH {_G} SELECT group_id, genome_id, length(seq) AS size, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS unambiguous, 1::BIGINT AS chromosomes FROM g",
    "fasta_written": f"WITH {_G} SELECT genome_id, group_id, length(seq) AS length, md5(seq) AS seq_md5 FROM g",
    "seq_reverse_complement": f"WITH {_G} SELECT genome_id, md5({_RC}) AS rc_md5 FROM g",
    "seq_fragments": f"WITH {_G} SELECT genome_id, pos, md5(substr(seq, pos + 1, 500)) AS part_md5 FROM (SELECT *, unnest(range(0, length(seq), 500)) AS pos FROM g)",
    "seq_kmer_counts": f"WITH {_G} SELECT kmer, count(*) AS n FROM (SELECT substr(seq, q, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS q FROM g WHERE length(seq) >= 6)) GROUP BY kmer",
    "seq_candidates": f"WITH {_G}, {_w('w', 'g')} SELECT group_id, genome_id, kind, pos, seq FROM w",
    "dedup_multiplicity": f"WITH {_G}, {_w('w', 'g')} SELECT group_id, seq, count(*) AS times FROM w GROUP BY ALL",
    "dedup_union_distinct": f"WITH {_G}, {_w('w', 'g')} SELECT DISTINCT seq FROM w",
    "filter_fasta_membership": f"WITH {_G}, {_I}, {_w('w', 'g')}, {_w('iw', 'i')}, f AS (SELECT seq, max(genome_id) AS place FROM iw GROUP BY seq) SELECT genome_id, pos, kind, seq, place FROM w JOIN f USING (seq)",
    "filter_poly": f"WITH {_G}, {_w('w', 'g')} SELECT genome_id, kind, pos FROM w WHERE NOT ((contains(seq, 'AAAAAA') OR contains(seq, 'TTTTTT')) AND ({_poly('A')} OR {_poly('T')}))",
    "filter_first_per_group": f"WITH {_G} SELECT group_id, genome_id FROM (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY genome_id) AS r FROM g) WHERE r <= 20",
    "hamming_pairs": f"""WITH {_G}, {_w('w', 'g')}, d AS (SELECT DISTINCT seq FROM w), k AS (SELECT seq, unnest([0, 10, 20]) AS o FROM d), h AS (SELECT seq, o, substr(seq, o + 1, 10) AS b FROM k)
SELECT DISTINCT x.seq AS a, y.seq AS b, hamming(x.seq, y.seq)::INTEGER AS mismatches FROM h x JOIN h y ON x.o = y.o AND x.b = y.b AND x.seq < y.seq WHERE hamming(x.seq, y.seq) <= 2""",
    "jaccard_pairs": f"""WITH {_I}, k AS (SELECT genome_id, list_distinct(list_transform(range(1, length(seq) - 4), lambda q: substr(seq, q, 6))) AS w FROM i WHERE length(seq) >= 6)
SELECT x.genome_id AS a, y.genome_id AS b, round(1 - len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 9) AS distance FROM k x JOIN k y ON x.genome_id < y.genome_id
WHERE 1 - len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) <= 0.99""",
    "minhash_signatures": f"""WITH {_I}, h AS (SELECT genome_id, list_transform(range(1, length(seq) - 8), lambda q: (({cluster.A}::HUGEINT * ('0x' || substr(md5(substr(seq, q, 10)), 1, 8))::BIGINT + {cluster.B}) % 2147483647)::BIGINT) AS h FROM i)
SELECT genome_id, array_to_string(list_sort(flatten(list_transform(range(0, ceil(20 / greatest(len(h), 1))::INT), lambda q: h)))[1:20], ',') AS sig FROM h""",
    "cluster_simple_documents": f"""WITH RECURSIVE {_G}, h AS (SELECT genome_id AS seq_id, list_transform(range(1, length(seq) - 10), lambda q: (({cluster.A}::BIGINT * ('0x' || substr(md5(substr(seq, q, 12)), 1, 8))::BIGINT + {cluster.B}) % 2147483647)::BIGINT) AS h FROM g),
s AS (SELECT seq_id, list_sort(flatten(list_transform(range(0, ceil(100 / greatest(len(h), 1))::INT), lambda q: h)))[1:100] AS sig FROM h), r AS (SELECT sig, min(seq_id) AS rep FROM s GROUP BY sig),
u AS (SELECT rep, list_distinct(sig) AS x FROM r), k AS (SELECT rep, unnest(x) AS h FROM u), p AS (SELECT DISTINCT a.rep AS i, b.rep AS j FROM k a JOIN k b ON a.h = b.h AND a.rep < b.rep),
d AS (SELECT i, j, a.x AS x, b.x AS y, list_sort(list_distinct(list_concat(a.x, b.x)))[1:len(a.x)] AS low FROM p JOIN u a ON a.rep = i JOIN u b ON b.rep = j),
e AS MATERIALIZED (SELECT i, j FROM d WHERE 1 - len(list_intersect(list_intersect(x, y), low)) / len(low) <= {jaccard_of_mash(0.1, 12)!r}), w AS MATERIALIZED (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
c AS (SELECT rep AS node, rep AS seen FROM r UNION SELECT c.node, w.j FROM c JOIN w ON w.i = c.seen)
SELECT s.seq_id, cluster FROM s JOIN r USING (sig) JOIN (SELECT node, min(seen) AS cluster FROM c GROUP BY node) t ON t.node = r.rep""",
    "mash_distances": "SELECT n_nationkey, round(1 - 1 / (2 * exp(12 * ((n_nationkey + 1) / 100)) - 1), 9) AS distance, (ceil(n_nationkey / 7) * 7)::BIGINT AS up, (floor(n_nationkey / 7) * 7)::BIGINT AS down FROM nation",
    "join_exact": f"WITH {_G}, {_I}, {_P}, {_ALL} SELECT genome_id, start, \"end\", seq FROM a JOIN p ON win = seq",
    "join_persisted": f"WITH {_COVERS} SELECT genome_id, rc, start, \"end\", seq FROM c",
    "join_mismatch": f"""WITH {_G}, {_I}, {_P}, {_ALL}, s AS (SELECT *, unnest([0, 10, 20]) AS o FROM p), k AS (SELECT seq, o, substr(seq, o + 1, 10) AS b FROM s),
x AS (SELECT *, unnest([0, 10, 20]) AS o FROM a)
SELECT DISTINCT genome_id, start, "end", seq FROM x JOIN k ON x.o = k.o AND substr(win, x.o + 1, 10) = b WHERE hamming(win, seq) <= 2""",
    "interval_merge": f"""WITH {_LINES}, m AS (SELECT DISTINCT l_suppkey, start, "end" FROM l),
f AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY l_suppkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
k AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT l_suppkey, min(start) AS start, max("end") AS "end" FROM k GROUP BY l_suppkey, island""",
    "interval_union": _islands(_points("l_returnflag = 'R' OR l_linestatus = 'O'")),
    "interval_intersection": _islands(_points("l_returnflag = 'R'") + " INTERSECT " + _points("l_linestatus = 'O'")),
    "interval_difference": _islands(_points("l_returnflag = 'R'") + " EXCEPT " + _points("l_linestatus = 'O'")),
    "interval_lengths": f"WITH {_LINES} SELECT l_suppkey, count(*) AS length FROM ({_points('true')}) GROUP BY l_suppkey",
    "interval_schedule": f"""WITH RECURSIVE {_LINES}, o AS (SELECT DISTINCT l_suppkey, start, "end" FROM l),
r AS (SELECT l_suppkey, min({{'e': "end", 's': start}}) AS x FROM o GROUP BY l_suppkey
  UNION ALL SELECT l_suppkey, x FROM (SELECT o.l_suppkey, min({{'e': o."end", 's': o.start}}) AS x FROM r JOIN o ON o.l_suppkey = r.l_suppkey AND o.start >= r.x.e GROUP BY o.l_suppkey))
SELECT l_suppkey, x.s AS start, x.e AS "end" FROM r""",
    "coverage_report": f"""WITH {_COVERS}, n AS (SELECT genome_id, rc, count(*) AS bp FROM (SELECT DISTINCT genome_id, rc, unnest(range(start, "end")) AS x FROM c) GROUP BY ALL),
d AS (SELECT genome_id, rc, sum("end" - start) AS raw FROM c GROUP BY ALL), z AS (SELECT genome_id, rc, length(seq) AS size, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS u FROM b)
SELECT genome_id, rc, coalesce(bp, 0)::BIGINT AS bp_covered, round(coalesce(bp, 0) / nullif(size, 0), 9) AS frac, round(coalesce(bp, 0) / nullif(u, 0), 9) AS frac_unambig,
  round(coalesce(raw, 0)::DOUBLE / nullif(size, 0), 9) AS depth, round(coalesce(raw, 0)::DOUBLE / nullif(u, 0), 9) AS depth_unambig FROM z LEFT JOIN n USING (genome_id, rc) LEFT JOIN d USING (genome_id, rc)""",
    "coverage_depth": f"""WITH {_COVERS}, e AS (SELECT genome_id, rc, start AS z, 1 AS v FROM c UNION ALL SELECT genome_id, rc, "end", -1 FROM c),
s AS (SELECT genome_id, rc, z, sum(v) AS v FROM e GROUP BY ALL), q AS (SELECT genome_id, rc, z AS start, lead(z) OVER w AS "end", sum(v) OVER w AS depth FROM s WINDOW w AS (PARTITION BY genome_id, rc ORDER BY z))
SELECT genome_id, rc, start, "end", depth::BIGINT AS depth FROM q WHERE depth > 0""",
    "coverage_sliding": f"""WITH {_COVERS}, z AS (SELECT DISTINCT genome_id, rc, greatest(0, least(s, size - 500)) AS a, least(greatest(0, least(s, size - 500)) + 500, size) AS z FROM (SELECT genome_id, rc, length(seq) AS size, unnest(range(0, length(seq), 250)) AS s FROM b)),
t AS (SELECT z.genome_id, z.rc, z.a, z.z, sum(least(c."end", z.z) - greatest(c.start, z.a)) AS n FROM z JOIN c ON c.genome_id = z.genome_id AND c.rc = z.rc AND c.start < z.z AND c."end" > z.a GROUP BY ALL)
SELECT genome_id, rc, a + 250.0::DOUBLE AS middle, round(coalesce(n, 0)::DOUBLE / (z - a), 9) AS depth FROM z LEFT JOIN t USING (genome_id, rc, a, z)""",
    "analysis_matrix": f"""WITH {_COVERS}, n AS (SELECT genome_id, rc, count(*) AS bp FROM (SELECT DISTINCT genome_id, rc, unnest(range(start, "end")) AS x FROM c) GROUP BY ALL),
d AS (SELECT genome_id, rc, sum("end" - start) AS raw FROM c GROUP BY ALL), z AS (SELECT group_id, genome_id, rc, length(seq) AS size, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS u FROM b)
SELECT {_NAME} || ', genome ' || genome_id || CASE WHEN rc THEN ' (rc)' ELSE '' END AS "Genome", coalesce(bp, 0)::BIGINT AS "Num bases covered", round(coalesce(bp, 0) / nullif(size, 0), 9) AS "Frac bases covered",
  round(coalesce(bp, 0) / nullif(u, 0), 9) AS "Frac bases covered over unambig", round(coalesce(raw, 0)::DOUBLE / nullif(size, 0), 9) AS "Average coverage/depth", round(coalesce(raw, 0)::DOUBLE / nullif(u, 0), 9) AS "Average coverage/depth over unambig"
FROM z LEFT JOIN n USING (genome_id, rc) LEFT JOIN d USING (genome_id, rc)""",
    "seq_candidates_small": f"""WITH {_G}, t AS (SELECT * FROM g WHERE length(seq) >= {L} OR NOT contains(seq, 'NN')), {_w('w', 't')}
SELECT group_id, genome_id, kind, pos, seq FROM w UNION ALL SELECT group_id, genome_id, 0, 0, seq FROM t WHERE length(seq) >= {SMALL} AND length(seq) < {L}""",
    "join_short": f"""WITH {_G}, p AS (SELECT DISTINCT seq FROM g WHERE length(seq) >= {SMALL} AND length(seq) < {L} AND NOT contains(seq, 'NN')), k AS (SELECT DISTINCT length(seq) AS k FROM p),
o AS (SELECT genome_id, s AS start, s + k AS "end", substr(seq, s + 1, k) AS seq FROM (SELECT genome_id, seq, k, unnest(range(0, length(seq) - k + 1)) AS s FROM g JOIN k ON length(seq) >= k) x WHERE substr(x.seq, s + 1, k) IN (SELECT seq FROM p)),
f AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY genome_id, seq ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
i AS (SELECT *, sum(new) OVER (PARTITION BY genome_id, seq ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT genome_id, seq, min(start) AS start, max("end") AS "end" FROM i GROUP BY genome_id, seq, island""",
    "pool_standard_bounds": """WITH t AS (SELECT p_brand AS dataset, floor(p_size / 10)::DOUBLE AS m, ((p_partkey % 4) * 10)::DOUBLE AS e FROM part GROUP BY ALL),
x AS (SELECT dataset, min(e) AS lo, max(e) AS hi FROM t GROUP BY dataset), b AS (SELECT t.dataset, m, lo, hi FROM t JOIN x USING (dataset) WHERE e = lo OR e = hi GROUP BY ALL HAVING min(e) = lo AND max(e) = hi)
SELECT dataset, min(m) AS m_low, round(max(m) - 0.001, 9) AS m_high, any_value(lo) AS e_low, round(any_value(hi) - 0.001, 9) AS e_high FROM b GROUP BY dataset""",
    "coverage_map_counts": f"WITH {_COVERS} SELECT p.seq, count(DISTINCT c.genome_id) AS count FROM p LEFT JOIN c ON c.seq = p.seq AND NOT rc GROUP BY p.seq",
    "rank_groups_hit": f"WITH {_COVERS} SELECT seq, count(DISTINCT group_id) AS hits FROM c GROUP BY seq",
    "rank_avoided": f"WITH {_COVERS} SELECT seq, count(*) AS bp FROM (SELECT DISTINCT seq, genome_id, rc, unnest(range(start, \"end\")) AS x FROM c) GROUP BY seq",
    "rank_probes": f"""WITH {_COVERS}, h AS (SELECT seq, count(DISTINCT group_id) AS hits FROM c GROUP BY seq), v AS (SELECT seq, count(*) AS bp FROM (SELECT DISTINCT seq, genome_id, rc, unnest(range(start, "end")) AS x FROM c WHERE group_id = 0) GROUP BY seq)
SELECT seq, dense_rank() OVER (ORDER BY (bp IS NOT NULL)::INT, coalesce(bp, hits, 0)) - 1 AS rank FROM p LEFT JOIN h USING (seq) LEFT JOIN v USING (seq)""",
    "graph_components": f"""WITH RECURSIVE {_G}, {_w('w', 'g')}, d AS (SELECT DISTINCT seq FROM w), k AS (SELECT seq, unnest([0, 15]) AS o FROM d), h AS (SELECT seq, o, substr(seq, o + 1, 15) AS b FROM k),
e AS (SELECT DISTINCT x.seq AS i, y.seq AS j FROM h x JOIN h y ON x.o = y.o AND x.b = y.b AND x.seq <> y.seq WHERE hamming(x.seq, y.seq) <= 1),
r AS (SELECT i AS node, i AS seen FROM e UNION SELECT r.node, e.j FROM r JOIN e ON e.i = r.seen) SELECT node, min(seen) AS label FROM r GROUP BY node""",
    "pool_interpolation": """WITH t AS (SELECT p_brand AS dataset, floor(p_size / 10)::DOUBLE AS x, ((p_partkey % 4) * 10)::DOUBLE AS y, count(*) AS n FROM part GROUP BY ALL),
q AS (SELECT DISTINCT dataset, k * 0.5::DOUBLE AS m, k * 3.0::DOUBLE + 1 AS e FROM t, range(0, 9) r(k)),
f AS (SELECT q.*, ll.x AS x0, hh.x AS x1, ll.y AS y0, hh.y AS y1, ll.n AS ll, lh.n AS lh, hl.n AS hl, hh.n AS hh FROM q JOIN t ll ON ll.dataset = q.dataset AND ll.x <= m AND ll.y <= e JOIN t hh ON hh.dataset = q.dataset AND hh.x >= m AND hh.y >= e
  JOIN t lh ON lh.dataset = q.dataset AND lh.x = ll.x AND lh.y = hh.y JOIN t hl ON hl.dataset = q.dataset AND hl.x = hh.x AND hl.y = ll.y),
b AS (SELECT *, row_number() OVER (PARTITION BY dataset, m, e ORDER BY (x1 - x0 + 0.001) * (0.1 * (y1 - y0) + 0.001), x0, y0) AS r FROM f),
u AS (SELECT *, CASE WHEN x1 > x0 THEN (m - x0) / (x1 - x0) ELSE 0.0 END AS u, CASE WHEN y1 > y0 THEN (e - y0) / (y1 - y0) ELSE 0.0 END AS v FROM b WHERE r = 1)
SELECT dataset, m, e, round(((1 - u) * (1 - v) * ll + (1 - u) * v * lh + u * (1 - v) * hl + u * v * hh)::DOUBLE, 9) AS num_probes FROM u""",
    "pool_bounds": "WITH t AS (SELECT DISTINCT p_brand AS dataset, floor(p_size / 10)::DOUBLE AS m, ((p_partkey % 4) * 10)::DOUBLE AS e FROM part) SELECT dataset, min(m) AS m_low, max(m) AS m_high, min(e) AS e_low, max(e) AS e_high FROM t GROUP BY dataset",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

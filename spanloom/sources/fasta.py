"""FASTA as a data source and a sink, batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.sequences import clean
from spanloom.operators.tiling import placed

from . import ranges


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(header, sequence) in order; a blank line ends a record, what follows it must be a header."""
    header, parts, ended = None, [], True
    for line in text.splitlines():
        line = line.strip()
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts)
            header, parts, ended = line[1:], [], False
        elif not line:
            ended = True
        elif ended:
            raise ValueError("a sequence without a header")
        else:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq_index, header, seq) of one or more files, in order, each record parsed where it is read.

    Records are what stands between line ends before ">", so a plain file is split over tasks like any text; a blank line
    ends a record, and what follows it must be a header.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = placed(rows, "path", ["block", "at"], "place")
    first, blank = F.col("place") == 0, F.trim(F.regexp_replace("value", "[\\r\\n]", "")) == ""
    # blank lines before the first record are a piece of their own
    lead = rows.where(first & blank).select(F.col("path").alias("path_"), F.lit(1).alias("lead"))
    rows = rows.where(~(first & blank)).join(F.broadcast(lead), F.col("path") == F.col("path_"), "left")
    value = F.when(~first, F.col("value")).when(F.col("value").rlike(r"^\s*>"), F.regexp_replace("value", r"^\s*>", "")).otherwise(F.raise_error(F.lit("a sequence without a header")))
    rows = rows.select("path", (F.col("place") - F.coalesce("lead", F.lit(0))).alias("seq_index"), value.alias("value"))
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    loose = body.rlike(r"(?:^|\n)[ \t\r]*\n\s*\S")
    seq = F.when(loose, F.raise_error(F.lit("a sequence without a header"))).otherwise(F.regexp_replace(body, r"\s", ""))
    return rows.select("path", "seq_index", F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", "")).alias("header"), seq.alias("seq"))


def read(spark: SparkSession, path: str, *, upper: bool = True, degenerate: bool = True, gaps: bool = True) -> DataFrame:
    """Sequences of one or more files, through Spark's own file systems. Of a repeated header the last body is at the first place."""
    once = records(spark, path).groupBy("path", "header").agg(F.min("seq_index").alias("seq_index"), F.max_by("seq", "seq_index").alias("seq"))
    return once.select("path", "seq_index", "header", clean(F.col("seq"), upper=upper, degenerate=degenerate, gaps=gaps).alias("seq"))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Sequences as written but for degenerate bases; empty ones are passed over, repeated headers kept."""
    return records(spark, path).where("seq <> ''").withColumn("seq", clean(F.col("seq"), upper=False, gaps=False))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, header, seq) of the files of a folder as a stream: files that arrive or grow, each record once."""
    ranges.register(spark)
    return spark.readStream.format("fasta").load(path)


def genomes(rows: DataFrame, group_id: int = 0, group_name: str = "Group 0") -> DataFrame:
    """One genome for each record: sequences (group_id, group_name, genome_id, chr_idx, chr_name, header, seq)."""
    return rows.select(F.lit(group_id).alias("group_id"), F.lit(group_name).alias("group_name"), F.col("seq_index").alias("genome_id"), F.lit(0).alias("chr_idx"), F.lit(None).cast("string").alias("chr_name"), "header", "seq")


def chromosomes(rows: DataFrame, chromosome: Callable[[Column], Column], genome: Callable[[Column], Column] | None = None, *, group_id: int = 0, group_name: str = "Group 0") -> DataFrame:
    """Genomes of several chromosomes: sequences (group_id, group_name, genome_id, chr_idx, chr_name, header, seq).

    ``chromosome`` and ``genome`` tell both from a header; without ``genome`` a file is a genome. Genomes and their
    chromosomes are numbered by first occurrence; of a chromosome that a genome has twice, the last sequence is at the first place.
    """
    name = F.col("path") if genome is None else genome(F.col("header"))
    keyed = rows.select(name.alias("genome_"), chromosome(F.col("header")).alias("chr_name"), F.struct("path", "seq_index").alias("at_"), "header", "seq")
    once = keyed.groupBy("genome_", "chr_name").agg(F.min("at_").alias("first_"), F.max_by(F.struct("header", "seq"), "at_").alias("x")).select("genome_", "chr_name", "first_", "x.*")
    order = once.groupBy("genome_").agg(F.min("first_").alias("g_")).select(F.lit(group_id).alias("group_id"), "genome_", F.col("g_.path").alias("p_"), F.col("g_.seq_index").alias("i_"))
    ids = placed(order, "group_id", ["p_", "i_", "genome_"], "genome_id").select("genome_", "genome_id")
    place = F.row_number().over(Window.partitionBy("genome_id").orderBy("first_")) - 1
    out = once.join(ids, once["genome_"].eqNullSafe(ids["genome_"])).withColumn("chr_idx", place)
    return out.select(F.lit(group_id).alias("group_id"), F.lit(group_name).alias("group_name"), "genome_id", "chr_idx", "chr_name", "header", "seq")


def datasets(spark: SparkSession, names: Sequence[str], fetch: Callable[[str, str | None], str] | None = None) -> DataFrame:
    """Genomes of several data sets, one group each: paths of FASTA files, or download:<taxon>[-<segment>].

    Nothing is downloaded here: ``fetch`` (taxon, segment) is called and returns the path of a FASTA file.
    """
    out = None
    for i, name in enumerate(names):
        if name.startswith("collection:"):
            raise ValueError("collections of data sets aren't taken; name files or taxa")
        if name.startswith("download:"):
            if fetch is None:
                raise ValueError("a taxon needs a function that fetches it")
            taxon, _, segment = name.removeprefix("download:").partition("-")
            path, label = fetch(taxon, segment or None), f"taxid:{taxon}"
        else:
            path, label = name, name.rstrip("/").rpartition("/")[2]
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                raise ValueError(f"{path} is neither a file nor download:<taxon>")
        one = genomes(read(spark, path), i, label)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no data sets")
    return out


def write(probes: DataFrame, path: str) -> None:
    """Records with their header, or probe_<identifier>, and the sequence in one line."""
    from spanloom.functions.sequences import identifier

    name = F.concat(F.lit("probe_"), identifier(F.col("seq")))
    header = F.coalesce("header", name) if "header" in probes.columns else name
    probes.select(F.concat(F.lit(">"), header, F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)

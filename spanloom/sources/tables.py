"""Tab-separated tables: probe counts, weights, neighbours, influenza accessions; and sinks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from datetime import date
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def probe_counts(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The table (dataset, parameters ..., num_probes) and its parameters; its header and keys are checked."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = rows.columns
    if len(names) < 3 or names[0] != "dataset" or names[-1] != "num_probes":
        raise ValueError("the header must be dataset, parameters ..., num_probes")
    params = names[1:-1]
    if rows.groupBy("dataset", *params).count().where("count > 1").take(1):
        raise ValueError("a dataset has parameters twice")
    return rows.select("dataset", *[F.col(p).cast("double").alias(p) for p in params], F.col("num_probes").cast("bigint").alias("num_probes")), params


def dataset_weights(spark: SparkSession, path: str, datasets: DataFrame | None = None) -> DataFrame:
    """(dataset, weight); each dataset once, and all of them."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    if rows.columns != ["dataset", "weight"]:
        raise ValueError("the header must be dataset, weight")
    if rows.groupBy("dataset").count().where("count > 1").take(1):
        raise ValueError("a dataset has two weights")
    rows = rows.select("dataset", F.col("weight").cast("double").alias("weight"))
    if datasets is not None and datasets.select("dataset").distinct().join(rows, "dataset", "left_anti").take(1):
        raise ValueError("a dataset has no weight")
    return rows


def neighbors(spark: SparkSession, path: str) -> DataFrame:
    """(rep_acc, nbr_acc, hosts, lineage, tax_name, segment) of a neighbour table with its ## header."""
    lines = spark.read.text(path)
    named = lines.where(F.col("value").startswith("## Columns:")).select(F.regexp_replace(F.regexp_replace("value", "^## Columns:\\s*", ""), '"', "")).first()
    if named is None:
        raise ValueError("the table has no line that names its columns")
    columns = [c.strip() for c in named[0].split("\t")]
    cells = F.split("value", "\t")
    at = {c: cells[i] for i, c in enumerate(columns)}
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    pick = lambda c: at[c] if c in at else F.lit(None).cast("string")
    out = rows.select(F.explode(F.split(pick("Representative"), ",")).alias("rep_acc"), pick("Neighbor").alias("nbr_acc"), F.split(pick("Host"), ",").alias("hosts"), F.split(pick("Selected lineage"), ",").alias("lineage"), pick("Taxonomy name").alias("tax_name"), pick("Segment name").alias("segment_name"))
    return out.withColumn("segment", F.regexp_replace("segment_name", "^segment\\s*", "")).drop("segment_name")


def influenza(spark: SparkSession, path: str, species: str, *, this_year: int | None = None) -> DataFrame:
    """(accession, host, segment, subtype, country, year, name) of sequences whose name or species holds the text; without missing or future years."""
    columns = ["accession", "host", "segment", "subtype", "country", "date", "length", "name"]
    rows = spark.read.option("sep", "\t").csv(path).toDF(*columns) if not isinstance(path, DataFrame) else path
    year = F.regexp_extract("date", r"^(\d{4})", 1)
    rows = rows.where(F.lower("name").contains(species.lower())).withColumn("year", F.when(year != "", year.cast("int")))
    return rows.where(F.col("year").isNotNull() & (F.col("year") <= (this_year or date.today().year))).drop("date", "length")


def of_segment(rows: DataFrame, segment: str) -> DataFrame:
    out = rows.where(F.col("segment") == segment)
    if not out.take(1):
        raise ValueError(f"nothing has segment {segment}")
    return out


def accession_url(base: str, accessions: Sequence[str], key: str | None = None) -> str:
    return base + "?" + urlencode({"db": "nuccore", "rettype": "fasta", "retmode": "text", "id": ",".join(accessions), **({"api_key": key} if key else {})})


def neighbors_url(base: str, taxon: int | str) -> str:
    """Where the neighbour table of a taxon is."""
    return base + "?" + urlencode({"taxid": taxon, "cmd": "download2"})


def influenza_url(base: str, database: str = "genomeset") -> str:
    """Where the influenza table of a database (genomeset or influenza) is."""
    if database not in ("genomeset", "influenza"):
        raise ValueError("the database is genomeset or influenza")
    return f"{base.rstrip('/')}/{database}.dat.gz"


def fetched(accessions: Sequence[str], fetch: Callable[[list[str]], str], *, batch: int = 100, per_second: float = 2, tries: int = 5, wait: float = 5, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> list[str]:
    """Texts of batches of accessions from an injected function; waits double after failures, with jitter."""
    rng, out = random.Random(seed), []
    for i in range(0, len(accessions), batch):
        delay = wait
        for attempt in range(tries):
            try:
                out.append(fetch(list(accessions[i : i + batch])))
                break
            except OSError:
                if attempt + 1 == tries:
                    raise
                sleep(delay + rng.uniform(1, 60))
                delay *= 2
        sleep(1 / per_second)
    return out


def write_tsv(rows: DataFrame, path: str, *, header: bool = True) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def parameter_lines(params: DataFrame, names: Sequence[str], whole: bool) -> DataFrame:
    """dataset and parameters as text, %d or %f, by dataset."""
    return params.orderBy("dataset").select("dataset", *[F.format_string("%d", F.col(n).cast("bigint")).alias(n) if whole else F.format_string("%f", F.col(n).cast("double")).alias(n) for n in names])


def write_accessions(rows: DataFrame, path: str, column: str = "accession") -> None:
    rows.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)

"""A persisted index of probes, against which any number of targets are joined without shuffling it again.

The blocks of the probes (as in ``cover.covers_full``) are one row each: b (the block's number), kmer,
probe_id, probe. They are a table bucketed and sorted by b and kmer, under a folder that all executors share; a one-row table beside
it has the probes' length, the mismatches, the buckets and the numbers of probes and blocks. It is written last, so a folder
without it (a save that was cut short) isn't an index, and ``load`` says so. Any session can load the folder.

Of a target's windows only those that have a block with a hash of the index become rows (all, if it has more than
``cover.BROADCAST_ROWS`` different ones). They are made distinct first, in each map task and then by their letters, so that a window which a third
of all places share meets the index once; its places are joined with what it met afterwards, a join that Spark may broadcast
or, where it is skewed, split. The index side of the join has no exchange.

Defined results: probes of other lengths (null ones too) aren't indexed; an index without probes, and a target without windows of
the length, give no covers; equal probes with several ids are all told.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.sequences import mismatches

from .cover import block_rows, exact_blocks, first_block, hashes_of, windows_of
from .tiling import KEYS

#: Blocks of a bucket, about: what a task sorts.
BUCKET_ROWS = 1_000_000
_BLOCKS = "b int, kmer string, probe_id {id}, probe string"
_META = "length int, mismatches int, buckets int, probes bigint, blocks bigint, id string"


@dataclass(frozen=True)
class Index:
    """An index that a session can read: its bucketed table, and what it was made for."""

    table: DataFrame
    length: int
    mismatches: int
    buckets: int
    probes: int
    blocks: int


def _name(path: str) -> str:
    return "probe_index_" + hashlib.md5(path.encode()).hexdigest()


def _create(spark: SparkSession, path: str, id_: str, buckets: int) -> str:
    name = _name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_BLOCKS.format(id=id_)}) USING parquet CLUSTERED BY (b, kmer) SORTED BY (b, kmer) INTO {buckets} BUCKETS LOCATION '{path}/blocks'")
    return name


def save(probes: DataFrame, path: str, length: int, mismatches_: int = 0, buckets: int | None = None) -> Index:
    """Write the index of probes (probe_id, seq) of one length to a folder that has none yet, and load it."""
    spark = probes.sparkSession
    path = path.rstrip("/")
    rows = probes.where(F.char_length("seq") == length).select("probe_id", F.col("seq").alias("probe"))
    n = rows.count()
    blocks = n * len(exact_blocks(length, mismatches_))
    # a target's windows are dealt into as many tasks as there are buckets, however small the index
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BUCKET_ROWS))
    out = rows.select("probe_id", "probe", F.explode(block_rows(F.col("probe"), length, mismatches_)).alias("x"))
    out = out.select("x.b", "x.kmer", "probe_id", "probe")
    id_ = rows.schema["probe_id"].dataType.simpleString()
    # dealt as the buckets are, so that each bucket is one file
    out = out.repartition(buckets, "b", "kmer")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    out.write.mode("error").option("path", f"{path}/blocks").bucketBy(buckets, "b", "kmer").sortBy("b", "kmer").saveAsTable(_name(path))
    spark.createDataFrame([(length, mismatches_, buckets, n, blocks, id_)], _META).coalesce(1).write.mode("error").parquet(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """The index in a folder; its table is made known to the session's catalog where it isn't yet."""
    path = path.rstrip("/")
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    if meta is None:
        raise ValueError(f"{path} has no index")
    return Index(spark.table(_create(spark, path, meta["id"], meta["buckets"])), meta["length"], meta["mismatches"], meta["buckets"], meta["probes"], meta["blocks"])


def covers(index: Index, seqs: DataFrame) -> DataFrame:
    """Covers of the index's probes that match whole, with at most its mismatches: (keys, rc?, probe_id, start, end), as by ``covers_full``."""
    extra = [c for c in ("rc",) if c in seqs.columns]
    blocks = [(index.length, a, k) for a, k in exact_blocks(index.length, index.mismatches)]
    wins = windows_of(seqs, blocks, hashes_of(index.table), once=True)
    seeds = wins.select("window").distinct().withColumn("x", F.explode(block_rows(F.col("window"), index.length, index.mismatches)))
    # joined by the columns of the buckets and no others, or else Spark would shuffle the index
    hit = seeds.select("window", "x.b", "x.kmer").join(index.table.hint("merge"), ["b", "kmer"]).where(first_block(index.length, index.mismatches))
    if index.mismatches:
        hit = hit.where(mismatches(F.col("window"), F.col("probe")) <= index.mismatches)
    rows = wins.join(hit.select("window", "probe_id"), "window")
    return rows.select(*KEYS, *extra, "probe_id", F.col("start").cast("bigint").alias("start"), (F.col("start") + index.length).cast("bigint").alias("end"))

"""Exact deduplication as a stateful stream, in DataFrame operations only.

Arriving documents become slim rows (digest, identifier, content locator) in an append-only
inbox table. A Structured Streaming query folds the inbox into keyed state: for each digest the
largest identifier with its locator, and the number of rows. State lives in RocksDB on disk,
is checkpointed to the shared folder and never expires, so later arrivals (another call with the
same ``state_dir``) meet all earlier ones. The stream aggregates before its shuffle, so a text
that holds a third of all rows costs one row per task.

The digest only proposes: on hits the full bytes are compared. Texts of digests that arrive more than once, or that
the state knows, are told apart by their bytes (equal ones collapse in each map task, so a group of copies is never
gathered); of digests that the state knows, the retained row's text is fetched through its locator and is one of
them. Where one digest has several texts, state is kept by (digest, variant): the variant is empty for the text that
the digest retained first, and the text itself for any other. Locators are a file, a row in it, and a column. What isn't a
plain scan gets files of its own, with ``state_dir`` inside it, since later calls read them.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays
(null id last; of rows with equal ids the one with the largest locator, so exactly one stays);
an empty table gives no rows; other columns are carried by ``deduplicate`` and otherwise unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, exists, new_path, without, written

#: State on disk; without space set aside in advance, of which each of many partitions would hold megabytes.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Inbox files folded in one micro-batch.
FILES_PER_BATCH = 4096
#: Digests that may be broadcast (as 8-byte hashes) to find the rows whose bytes are compared; beyond, a shuffle join does it.
BROADCAST_DIGESTS = 1_000_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator(column: str) -> Column:
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"), F.lit(column))


def _located(docs: DataFrame, id_col: str, text_col: str, own: str | None) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text, row, loc): loc names the file, row and column that hold the content. Also a table to discard, if one was needed and isn't to stay in ``own``."""
    pick = lambda df, i, t: df.select(df[i].alias("doc_id"), F.coalesce(df[t], F.lit("")).alias("text"), F.xxhash64(df[t]).alias("row"), _locator(t).alias("loc"))
    try:
        return pick(docs, id_col, text_col), None
    except AnalysisException:  # not a plain scan: give it files of its own
        rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        if own is None:
            table = written(rows, "dedup-content")
            return pick(table, "doc_id", "text"), table
        rows.write.parquet(own)
        return pick(docs.sparkSession.read.schema(rows.schema).parquet(own), "doc_id", "text"), None


def _fetched(spark: SparkSession, known: DataFrame) -> DataFrame:
    """(digest, text) of known (digest, loc), read from the files that the locators name."""
    parts = known.select("digest", "loc", *[F.regexp_extract("loc", "^(.*)#([0-9]+)#([^#]*)$", i).alias(n) for i, n in ((1, "file"), (3, "column"))])
    files: dict[str, list[str]] = {}
    for r in parts.select("column", "file").distinct().collect():  # the files of earlier inputs, not their rows
        files.setdefault(r["column"], []).append(r["file"])
    out = None
    for column, names in files.items():
        rows = spark.read.parquet(*names)
        text = rows.select(F.coalesce(F.col(column), F.lit("")).alias("text"), _locator(column).alias("loc"))
        one = text.join(parts.select("digest", "loc"), "loc").select("digest", "text")
        out = one if out is None else out.unionByName(one)
    return out


def _latest(spark: SparkSession, groups: str, id_kind: str) -> DataFrame:
    """(digest, variant, keep, group_size) from all that the stream has put out."""
    kind = f"digest string, variant string, keep struct<doc_id:{id_kind},loc:string>, group_size bigint, batch bigint"
    # counts only grow, so the largest is the latest
    return spark.read.schema(kind).parquet(groups).groupBy("digest", "variant").agg(F.max_by(F.struct("keep", "group_size"), "group_size").alias("g")).select("digest", "variant", "g.*")


def _fold(inbox: str, schema, state: str, groups: str, spark: SparkSession) -> None:
    """Run the stream over what is new in the inbox."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(inbox)
            .groupBy("digest", "variant").agg(F.max(F.struct("doc_id", "loc")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state)
            .foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{groups}/batch={number}")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _variants(here: DataFrame, arrived: DataFrame, old: DataFrame | None, digest) -> DataFrame | None:
    """(loc, variant) of arrived rows whose bytes aren't those that their digest retains; None if there are none."""
    spark = here.sparkSession
    counts = arrived.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max_by("loc", F.struct("doc_id", "loc")).alias("loc"))
    known = None if old is None else written(old.where("variant = ''").join(counts.select("digest"), "digest", "left_semi").select("digest", F.col("keep.loc").alias("loc")), "dedup-known")
    again = counts.where("n > 1").select("digest")
    again = written(again if known is None else again.unionByName(known.select("digest")).distinct(), "dedup-again")
    n = again.count()
    if not n:
        return None
    rows = here.select("loc", "text", digest(F.col("text")).alias("digest"))
    if n <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(again.select(F.xxhash64("digest").alias("h")).distinct()), F.xxhash64("digest") == F.col("h"), "left_semi")
    else:
        rows = rows.join(again, "digest", "left_semi")
    earlier = _fetched(spark, known) if known is not None else None
    texts = rows.select("digest", "text").distinct()
    texts = texts if earlier is None else texts.unionByName(earlier).distinct()
    clash = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-clash")
    if not clash.take(1):
        discard(again, clash)
        return None
    # the text that the digest retained before, or that of the largest row of this call
    first = rows.join(counts.select("digest", F.col("loc").alias("ref")), "digest").where("loc = ref").select("digest", F.col("text").alias("first"))
    if earlier is not None:
        first = earlier.select("digest", F.col("text").alias("first")).unionByName(first.join(known.select("digest"), "digest", "left_anti"))
    out = rows.join(clash, "digest", "left_semi").join(first, "digest").where("text <> first").select("loc", F.col("text").alias("variant"))
    return written(out, "dedup-variants")


def decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, digest: Callable[[Column], Column] = sha256, row: bool = False) -> DataFrame:
    """One row per document of this call: doc_id, loc, keep_id, group_size, kept, text_sha256, and with ``row`` the text's hash.

    With a ``state_dir`` of an earlier call, groups include all documents of earlier calls; what these calls read must still be there.
    """
    spark = docs.sparkSession
    base = state_dir or new_path(spark, "dedup")
    inbox, state, groups_at = f"{base}/inbox", f"{base}/state", f"{base}/groups"
    here, own = _located(docs, id_col, text_col, f"{base}/content/{uuid.uuid4().hex}" if state_dir else None)
    more = ["row"] if row else []
    slim = here.select("doc_id", "loc", *more, digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"))
    arrived = written(slim, "dedup-arrived")
    if not arrived.take(1):
        return arrived.select("doc_id", "loc", F.col("doc_id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *more)
    id_kind = arrived.schema["doc_id"].dataType.simpleString()
    old = _latest(spark, groups_at, id_kind) if exists(spark, groups_at) else None
    odd = _variants(here, arrived, old, digest)
    rows = arrived.withColumn("variant", F.lit("")) if odd is None else arrived.join(odd, "loc", "left").na.fill("", ["variant"])
    slim = rows.select("digest", "variant", "doc_id", "loc")
    slim.write.mode("append").parquet(inbox)
    _fold(inbox, slim.schema, state, groups_at, spark)
    groups = written(_latest(spark, groups_at, id_kind), "dedup-groups")
    out = rows.join(groups, ["digest", "variant"])
    if own is not None:
        discard(own)
    return out.select("doc_id", "loc", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("loc") == F.col("keep.loc")).alias("kept"), "text_sha256", *more)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts, the one with the largest id.

    Null and empty texts are equal to each other. Of rows with one id and text a single one stays.
    """
    judged = decisions(docs, id_col=id_col, text_col=text_col, row=True, **how).select(F.col("doc_id").alias("id"), "row", "kept")
    keys = judged.where("not kept").select("id", "row")
    # a repeated row has the key of the row that stays
    twice = written(judged.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 and kept").select("id", "row"), "dedup-twice")
    if not twice.take(1):
        return without(docs, keys, id_col, text_col)
    again = twice.select(F.col("id").alias("t_id_"), F.col("row").alias("t_row_"))
    hit = docs[id_col].eqNullSafe(F.col("t_id_")) & (F.xxhash64(docs[text_col]) == F.col("t_row_"))
    once = docs.join(again, hit, "left_semi").dropDuplicates([id_col, text_col])
    return without(docs.join(again, hit, "left_anti"), keys, id_col, text_col).unionByName(once)

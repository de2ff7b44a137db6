"""The FASTA data source: byte ranges against the parser, growing files read once, a sink whose files are in order."""

import gzip
import io
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom import queries
from spanloom.sources import fasta, ranges


def _text(rng: random.Random, n: int) -> str:
    seq = lambda: "\n".join("".join(rng.choices("ACGT", k=60)) for _ in range(rng.randrange(9)))
    return "\n\n" + "".join(f">r{i} é\r\n{seq()}\n" + "\n" * rng.randrange(3) for i in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([">a\n", ">\n", ">b", "AC\n", "G", "\n", "T>\n"]), max_size=12).map("".join), st.integers(1, 9), st.integers(1, 5))
def test_ranges_give_every_record_once(text, split, chunk):
    try:
        want = list(fasta.parse(text))
    except ValueError:
        want = None
    raw, was = text.encode(), ranges.CHUNK
    ranges.CHUNK = chunk
    try:
        got = [(at, *ranges.record(r)) for x in ranges.ranges("f", 0, len(raw), split) for at, r in ranges.cut(io.BytesIO(raw), x.start, x.end, x.until)]
    except ValueError:
        got = None
    finally:
        ranges.CHUNK = was
    assert (got is None) == (want is None)
    if want is not None:
        assert [x[1:] for x in got] == want and all(raw[x[0] : x[0] + 1] == b">" for x in got)


def test_batch_in_many_tasks(spark, tmp_path):
    ranges.register(spark)
    text = _text(random.Random(1), 300)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(text, newline="")
    with gzip.open(tmp_path / "in" / "b.fasta.gz", "wt", newline="") as f:
        f.write(text)
    (tmp_path / "in" / "_SUCCESS").write_text("no header")
    rows = spark.read.format("fasta").option("splitBytes", 4096).load(str(tmp_path / "in"))
    assert rows.where(F.col("path").endswith("a.fasta")).select(F.spark_partition_id().alias("p")).distinct().count() > 10
    want = list(fasta.parse(text))
    for end in ("a.fasta", "b.fasta.gz"):
        assert [(r.header, r.seq) for r in rows.where(F.col("path").endswith(end)).orderBy("start").collect()] == want
    assert spark.read.format("fasta").load(f"file://{tmp_path}/in/a.fasta").count() == len(want)
    (tmp_path / "empty").mkdir()
    assert spark.read.format("fasta").load(str(tmp_path / "empty")).count() == 0


def test_growing_files_are_read_once(spark, tmp_path):
    ranges.register(spark)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.fasta").write_text(">a\nAC\n>b\nG")

    def arrive() -> Counter:
        rows = fasta.stream(spark, str(src))
        q = rows.select("header", "seq").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return Counter((r.header, r.seq) for r in spark.read.schema("header string, seq string").parquet(out).collect())

    assert arrive() == {("a", "AC"): 1}
    with (src / "a.fasta").open("a") as f:
        f.write("GT\n>c\nTT\n>d\n")
    (src / "b.fasta").write_text(">e\nAA\n\n")
    assert arrive() == {("a", "AC"): 1, ("b", "GGT"): 1, ("c", "TT"): 1, ("e", "AA"): 1}
    with (src / "a.fasta").open("a") as f:
        f.write("CC\n\n")
    with gzip.open(src / "z.fasta.gz", "wt") as f:
        f.write(">z\nA\n>y\nC\n")
    want = {("a", "AC"): 1, ("b", "GGT"): 1, ("c", "TT"): 1, ("e", "AA"): 1, ("d", "CC"): 1, ("z", "A"): 1, ("y", "C"): 1}
    assert arrive() == want and arrive() == want


def test_sink_in_order(spark, tmp_path):
    ranges.register(spark)
    rows = spark.range(500).select(F.format_string("h%d", "id").alias("header"), F.repeat(F.lit("AC"), (F.col("id") % 4).cast("int")).alias("seq"), "id")
    one, many = str(tmp_path / "one.fasta"), str(tmp_path / "many")
    sorted_ = rows.repartition(5).orderBy(F.desc("id")).drop("id")
    sorted_.write.format("fasta").mode("append").option("single", "true").save(one)
    sorted_.write.format("fasta").mode("overwrite").save(many)
    want = [(f"h{i}", "AC" * (i % 4)) for i in reversed(range(500))]
    with open(one) as f:
        assert list(fasta.parse(f.read())) == want
    got = spark.read.format("fasta").load(many)
    assert [(r.header, r.seq) for r in got.orderBy("path", "start").collect()] == want
    sorted_.limit(2).write.format("fasta").mode("overwrite").save(many)
    assert got.count() == 2 and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    with pytest.raises(Exception, match="null"):
        sorted_.withColumn("seq", F.lit(None).cast("string")).write.format("fasta").mode("overwrite").save(many)
    assert got.count() == 2 and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    with pytest.raises(Exception, match="many"):
        sorted_.write.format("fasta").mode("append").save(many)


def test_query_reads_what_it_wrote(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    want = {(r.genome_id, len(r.seq), hashlib.md5(r.seq.encode()).hexdigest()) for r in queries.genomes(spark, sf).collect()}
    assert {tuple(r) for r in queries.fasta_written(spark, sf).select("genome_id", "length", "seq_md5").collect()} == want

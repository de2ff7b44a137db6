import gzip
import random

import pytest
from pyspark.sql import functions as F

from spanloom.plans.pipeline import load_function
from spanloom.sources import fasta, tables

TEXT = ">g1\nATAC\n\n>g2 x\natrg\nTT-A\n\n\n>g1\nCC\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(TEXT)
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(TEXT)
    for name in ("a.fasta", "b.fasta.gz"):
        rows = fasta.read(spark, str(tmp_path / name)).orderBy("seq_index").collect()
        assert [(r.header, r.seq) for r in rows] == [("g1", "CC"), ("g2 x", "ATNGTTA")]
    assert fasta.read_plain(spark, str(tmp_path / "a.fasta")).count() == 3
    fasta.write(fasta.read(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    assert fasta.read(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        list(fasta.parse(">a\nA\n\nC\n"))
    for bad in (">a\nA\n\nC\n", "AC\n>b\nG\n"):
        (tmp_path / "bad.fasta").write_text(bad)
        with pytest.raises(Exception, match="without a header"):
            fasta.read(spark, str(tmp_path / "bad.fasta")).collect()


def test_fasta_is_split_by_records(spark, tmp_path):
    """A file over several tasks gives the records of the parser, in order."""
    rng = random.Random(1)
    seq = lambda: "\n".join("".join(rng.choices("ACGT", k=60)) for _ in range(rng.randrange(1, 9)))
    text = "\n\n" + "".join(f">r{i} a\r\n{seq()}\n" + "\n" * rng.randrange(3) for i in range(400))
    (tmp_path / "big.fasta").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = fasta.records(spark, str(tmp_path / "big.fasta"))
        assert spark.read.option("lineSep", "\n>").text(str(tmp_path / "big.fasta")).rdd.getNumPartitions() > 4
        assert [(r.header, r.seq) for r in rows.orderBy("seq_index").collect()] == list(fasta.parse(text))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chromosomes_and_datasets(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">g2|s1\nAA\n>g1|s1\nCC\n>g2|s2\nGG\n>g2|s1\nTT\n")
    (tmp_path / "b.fasta").write_text(">g1|s2\nAC\n")
    rows = fasta.read(spark, str(tmp_path / "a.fasta")).unionByName(fasta.read(spark, str(tmp_path / "b.fasta")))
    part = lambda i: lambda h: F.split(h, r"\|")[i]
    got = fasta.chromosomes(rows, part(1), part(0))
    assert sorted((r.genome_id, r.chr_idx, r.chr_name, r.seq) for r in got.collect()) == [(0, 0, "s1", "TT"), (0, 1, "s2", "GG"), (1, 0, "s1", "CC"), (1, 1, "s2", "AC")]
    by_file = fasta.chromosomes(rows, lambda h: h)
    assert sorted((r.genome_id, r.chr_idx, r.seq) for r in by_file.collect()) == [(0, 0, "TT"), (0, 1, "CC"), (0, 2, "GG"), (1, 0, "AC")]
    asked = []

    def fetch(taxon, segment):
        asked.append((taxon, segment))
        return str(tmp_path / "b.fasta")

    sets = fasta.datasets(spark, [str(tmp_path / "a.fasta"), "download:123-4"], fetch)
    assert asked == [("123", "4")] and sorted({(r.group_id, r.group_name) for r in sets.collect()}) == [(0, "a.fasta"), (1, "taxid:123")]
    for bad in ("collection:x", "download:1", str(tmp_path / "no.fasta")):
        with pytest.raises(ValueError):
            fasta.datasets(spark, [bad])
    assert tables.neighbors_url("http://h/x", 5) == "http://h/x?taxid=5&cmd=download2" and tables.influenza_url("ftp://h/I/").endswith("/I/genomeset.dat.gz")


def test_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("dataset\tm\te\tnum_probes\na\t0\t0\t10\na\t1\t0\t5\n")
    df, params = tables.probe_counts(spark, str(tmp_path / "c.tsv"))
    assert params == ["m", "e"] and df.count() == 2
    (tmp_path / "d.tsv").write_text("dataset\tm\tnum_probes\na\t0\t10\na\t0\t5\n")
    with pytest.raises(ValueError):
        tables.probe_counts(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "w.tsv").write_text("dataset\tweight\na\t2\n")
    assert tables.dataset_weights(spark, str(tmp_path / "w.tsv"), df).first().weight == 2
    (tmp_path / "n.tsv").write_text('## Columns:\t"Representative"\t"Neighbor"\t"Host"\t"Selected lineage"\t"Taxonomy name"\t"Segment name"\nA,B\tC\th1,h2\tx,y\tz\tsegment S\n')
    rows = tables.neighbors(spark, str(tmp_path / "n.tsv")).collect()
    assert len(rows) == 2 and rows[0].hosts == ["h1", "h2"] and rows[0].segment == "S"
    (tmp_path / "i.tsv").write_text("a1\thuman\t1\tH1N1\tX\t2001/02/03\t100\tInfluenza A virus\na2\thuman\t1\tH1N1\tX\t\t100\tInfluenza A virus\n")
    assert [r.accession for r in tables.influenza(spark, str(tmp_path / "i.tsv"), "influenza a").collect()] == ["a1"]
    tables.write_accessions(spark.createDataFrame([("b",), ("a",)], "accession string"), str(tmp_path / "acc"))


def test_fetch_retries():
    calls = []

    def fetch(batch):
        calls.append(batch)
        if len(calls) == 1:
            raise OSError
        return ",".join(batch)

    assert tables.fetched(["a", "b", "c"], fetch, batch=2, sleep=lambda s: None) == ["a,b", "c"]


def test_plugin(tmp_path):
    (tmp_path / "f.py").write_text("def fn(x):\n    return x + 1\n")
    assert load_function(str(tmp_path / "f.py"), "fn")(1) == 2
    with pytest.raises(AttributeError):
        load_function(str(tmp_path / "f.py"), "no")

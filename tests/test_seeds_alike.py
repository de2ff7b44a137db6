"""Places whose probes can't have enough equal letters are no rows; hashes tell the order of letters."""

import random

from spanloom.functions import windows
from spanloom.operators import cover


def test_places_without_an_alike_probe_are_no_rows(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("ACGT", k=20_000))
    p = spark.createDataFrame([(i, text[500 * i : 500 * i + 30]) for i in range(20)], "probe_id bigint, seq string")
    seqs = spark.createDataFrame([(0, 0, 0, text), (0, 1, 0, text[520:540] + "G" * 9), (0, 2, 0, "")], "group_id int, genome_id bigint, chr_idx int, seq string")
    index = cover.full_index(p, 4)
    model = cover.predicate(2, 24)
    named = index.join(p.withColumnRenamed("seq", "probe"), "probe_id")
    wanted = cover.hashes_of(named.selectExpr("0 AS b", "kmer"))[0]
    cut = lambda seeds: seqs.select("genome_id", "seq").mapInArrow(windows.seeding(["genome_id"], 4, 30, wanted, seeds), "genome_id bigint, i int, n int, lead int, part string").count()
    assert cut(None) > 10_000 and 20 * 27 <= cut(cover._seeds(named, model)) < 800
    rows = lambda m: sorted(tuple(r) for r in cover.covers_seeded(p, seqs, index, 4, m).collect())
    got = rows(model)
    assert got == rows(lambda *a: model(*a)) and len(got) >= 20


def test_hashes_of_swapped_letters_differ():
    assert windows.hash_of("ACGTACGT") != windows.hash_of("AGCTACGT") and windows.hash_of("ACGTACGT") != windows.hash_of("ACGTGCAT")
    assert len({windows.hash_of("A" * i + "C" + "A" * (15 - i)) for i in range(16)}) == 16

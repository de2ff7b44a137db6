"""Covers by seeds: many at once are those one after the other, on both ways of the join."""

import random

from spanloom.operators import cover


def test_many_seeds_at_once(spark, monkeypatch):
    rng = random.Random(5)
    genomes = ["".join(rng.choices("ACGTN", k=n)) for n in (0, 5, 21, 300, 900)] + ["é" + "ACGT" * 9]
    probes = [(i, i % 2, "".join(rng.choice("ACGT") if rng.random() < 0.08 else c for c in g[a : a + n])) for i, (g, a, n) in enumerate((rng.choice(genomes[2:]), rng.randrange(250), rng.randrange(6, 30)) for _ in range(60))]
    p = spark.createDataFrame([x for x in probes if len(x[2]) >= 6], "probe_id bigint, group_id int, seq string")
    seqs = spark.createDataFrame([(i % 2, i, 0, g) for i, g in enumerate(genomes)], "group_id int, genome_id bigint, chr_idx int, seq string")
    index = cover.full_index(p, 4)
    for model, own in ((cover.predicate(2, 12), False), (cover.predicate(1, 9, 6), True)):
        rows = lambda m: sorted(tuple(r) for r in cover.covers_seeded(p, seqs, index, 4, m, merge=False, own_group=own).collect())  # noqa: B023, E731
        got = rows(model)
        assert got == rows(lambda *a: model(*a)) and got  # noqa: B023
        monkeypatch.setattr(cover, "BROADCAST_ROWS", 1)
        assert got == rows(model)
        monkeypatch.undo()


def test_only_places_of_the_index_are_rows(spark):
    """Before, every k-mer of the sequences became a row of the join by an expression."""
    p = spark.createDataFrame([(0, "ACGTACGTAC")], "probe_id bigint, seq string")
    seqs = spark.createDataFrame([(0, 0, 0, "G" * 500 + "ACGTACGTAC")], "group_id int, genome_id bigint, chr_idx int, seq string")
    found = cover.covers_seeded(p, seqs, cover.full_index(p, 8), 8, cover.predicate(0, 10))
    assert [(r.start, r.end) for r in found.collect()] == [(500, 510)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # the index's k-mers

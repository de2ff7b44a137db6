"""op7_jaccard_join where exact copies of near copies lie in an even number of partitions."""

import random

import numpy as np

from spanloom.llm import jaccard_join


def spread(spark, triples):
    """All of each triple in one partition, its second texts again in another, its third texts in one more."""
    texts = [[t for x in triples for t in x], [x[1] for x in triples], [x[2] for x in triples]]
    rows = [(1000 * k + i, t) for k, part in enumerate(texts) for i, t in enumerate(part)]
    return spark.createDataFrame(rows, "doc_id long, text string").rdd.map(lambda r: (r.doc_id // 1000, r)).partitionBy(3, int).values().toDF("doc_id long, text string")


def triples():
    """A text of five shingles, and the first and the last four of them; these two link through the first alone."""
    rng = random.Random(4)
    out = []
    for _ in range(200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        out.append((" ".join(w), " ".join(w[:-1]), " ".join(w[1:])))
    return out


def test_points_of_a_region_are_distinct(spark):
    rings = jaccard_join.Rings(80, 100)
    common = np.packbits(np.zeros(1 << jaccard_join.BITS, dtype=np.uint8))
    packed = jaccard_join._signatures(spread(spark, triples()[:5]), "text", 5, rings, 4, common)
    got = list(map(tuple, jaccard_join._regions(packed, 4).collect()))
    assert got and len(got) == len(set(got))


def test_copies_in_an_even_number_of_partitions(spark):
    some = triples()
    least = {t: 3 * i for i, x in enumerate(some) for t in x}
    df = spread(spark, some)
    assert df.rdd.getNumPartitions() == 3
    got = {r.doc_id: r.component_id for r in jaccard_join.clusters(df).collect()}
    assert {r.doc_id: least[r.text] for r in df.collect()} == got


def test_a_region_of_several_blocks_meets_no_pivots(spark, monkeypatch):
    """Near copies, of which few link, in a region larger than a block: pivots would meet up to PIVOTS times its points."""
    monkeypatch.setattr(jaccard_join, "BLOCK_POINTS", 8)
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    centre = say(300)
    rows = []
    for k in range(40):
        w = list(centre)
        at = rng.randrange(200)
        w[at : at + 14 + k % 3] = say(14 + k % 3)
        rows.append((k, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    told = {}
    got = {r.doc_id: r.component_id for r in jaccard_join.clusters(spark.createDataFrame(rows, "doc_id long, text string"), told=told).collect()}
    assert got == dict(enumerate(label))
    assert told["leaves"] > 0 and told.get("pivots", 0) == 0, told

"""Regions that once were too large for blocks, and components with few rounds."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join


def test_a_region_of_more_than_4096_points_meets_no_pivots(spark, monkeypatch):
    """Before, such a region met 32 pivots a round, and hardly got smaller. Texts of one family, and links between some of them."""
    monkeypatch.setattr(jaccard_join, "MOST_POINTS", 1_000)
    rng = random.Random(2)
    word = lambda: f"x{rng.randrange(10**9)}"
    base, rows, want = [f"w{i}" for i in range(60)], [], {}
    for i in range(0, 4_600, 2):
        # two texts that differ in the last word, and from the others of the family in four places
        t = list(base)
        for at in (5, 6, 30, 31):
            t[at] = word()
        rows += [(i, " ".join(t)), (i + 1, " ".join([*t[:-1], word()]))]
        want |= {i: i, i + 1: i}
    told, sizes, leaves = {}, [], jaccard_join._leaves
    monkeypatch.setattr(jaccard_join, "_leaves", lambda points, rings: [sizes.append(points.agg(F.max("m")).first()[0] or 0), leaves(points, rings)][1])
    got = {r.doc_id: r.component_id for r in jaccard_join.clusters(spark.createDataFrame(rows, "doc_id long, text string"), told=told).collect()}
    assert got == want and told["leaves"] > 0 and told.get("pivots", 0) == 0, told
    assert max(sizes) > 4_096


def test_tasks_connect_their_own_edges(monkeypatch):
    monkeypatch.setattr(jaccard_join, "FOREST_NODES", 1_000)
    chain = list(range(100))
    random.Random(1).shuffle(chain)
    edges = pa.RecordBatch.from_arrays([pa.array(chain[:-1]), pa.array(chain[1:])], names=["u", "v"])
    out = [r for b in jaccard_join._forest(iter([edges])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(out) == [(x, 0) for x in range(1, 100)]

"""The persisted index of probes: the same covers as without it, by several targets, and no exchange of the index."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import cover, index
from spanloom.operators.shared import scratch

LENGTH = 12
SEQS = "group_id int, genome_id bigint, chr_idx int, seq string"


def _targets(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    rows = []
    for g in range(n):
        s = list(base)
        for _ in range(rng.randrange(6)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        rows.append((0, g, 0, "".join(s)))
    # one window at very many places, a short, an empty and a missing sequence, and a repeated row
    return [*rows, (1, n, 0, "A" * 500), (1, n + 1, 0, "ACG"), (1, n + 2, 0, ""), (1, n + 3, 0, None), rows[0]]


def _probes(spark):
    s = _targets(1, 1)[0][3]
    rows = [(i, s[i : i + LENGTH]) for i in range(0, 48, 5)] + [(100, "A" * LENGTH), (101, "A" * LENGTH), (102, "ACGT"), (103, None)]
    return spark.createDataFrame(rows, "probe_id bigint, seq string")


def _plain(probes: list, seqs: list, most: int) -> list[tuple]:
    out = []
    for group, genome, chromosome, seq in seqs:
        for at in range(len(seq or "") - LENGTH + 1):
            window = seq[at : at + LENGTH]
            for p in probes:
                if p["seq"] and len(p["seq"]) == LENGTH and sum(a != b for a, b in zip(window, p["seq"], strict=True)) <= most:
                    out.append((group, genome, chromosome, p["probe_id"], at, at + LENGTH))
    return sorted(out)


@pytest.mark.parametrize("most", [0, 2])
def test_two_targets_of_one_index(spark, most):
    probes = _probes(spark)
    path = scratch(spark, "index")
    index.save(probes, path, LENGTH, most, buckets=3)
    # as another session would find it
    spark.sql(f"DROP TABLE {index._name(path)}")
    made = index.load(spark, path)
    assert (made.length, made.mismatches, made.buckets, made.probes, made.blocks) == (LENGTH, most, 3, 12, 12 * (most + 1))
    for seed in (2, 3):
        rows = _targets(seed, 4) + _targets(1, 3)
        seqs = spark.createDataFrame(rows, SEQS)
        got = sorted(map(tuple, index.covers(made, seqs).collect()))
        assert got == _plain(probes.collect(), rows, most)
        assert got == sorted(map(tuple, cover.covers_full(probes, seqs, LENGTH, most).collect()))


def test_the_index_is_not_shuffled(spark):
    made = index.save(_probes(spark), scratch(spark, "index"), LENGTH, 1, buckets=3)
    seqs = spark.createDataFrame(_targets(2, 4), SEQS)
    plan = index.covers(made, seqs)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "SortMergeJoin [b#" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scan = next(k for k, line in enumerate(plan) if k > at and "FileScan parquet" in line and "Bucketed: true" in line)
    # from the scan up to the join
    above, level = [], depth(plan[scan])
    for line in reversed(plan[at:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert "SortMergeJoin" in above[-1] and not [line for line in above if "Exchange" in line], above


def test_empty_index_and_unfinished_one(spark):
    none = _probes(spark).where(F.lit(False))
    made = index.save(none, scratch(spark, "index"), LENGTH)
    assert made.probes == 0 and index.covers(made, spark.createDataFrame(_targets(2, 2), SEQS)).count() == 0
    path = scratch(spark, "index")
    _probes(spark).write.parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="(?i)path.*exist|no index"):
        index.load(spark, path)

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions.kernels import Cover, average_linkage, cover_elements
from spanloom.operators import adapters, analysis, cluster, cover, design, intervals, tiling
from spanloom.plans import coverage, pipeline, pool


def rows(spark, values, owner="x"):
    return spark.createDataFrame([(owner, a, b) for a, b in values], "owner string, start bigint, end bigint")


def got(df):
    return sorted((r.start, r.end) for r in df.collect())


def points(values):
    return {x for a, b in values for x in range(a, b)}


def islands(xs):
    out = []
    for x in sorted(xs):
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [tuple(r) for r in out]


def test_algebra(spark):
    """Against sets of points."""
    rng = random.Random(10)
    some = lambda: [(a, a + rng.randrange(1, 12)) for a in (rng.randrange(120) for _ in range(9))]
    for _ in range(2):
        x, y = some(), some()
        a, b = rows(spark, x), rows(spark, y)
        assert got(intervals.merged(a, ["owner"])) == islands(points(x))
        assert got(intervals.intersection(a, b, ["owner"])) == islands(points(x) & points(y))
        assert got(intervals.difference(b, a, ["owner"])) == islands(points(y) - points(x))
        assert got(intervals.union(a, b, ["owner"])) == islands(points(x) | points(y))
        assert got(intervals.overlapping(a, b, ["owner"])) == sorted(v for v in x if points([v]) & points(y))


def test_schedule_is_largest(spark):
    values = [(1, 4), (3, 5), (0, 6), (5, 7), (3, 8), (5, 9), (6, 10), (8, 11)]
    assert got(intervals.scheduled(rows(spark, values), ["owner"])) == [(1, 4), (5, 7), (8, 11)]


def test_coverage(spark):
    """Two genomes, one of two chromosomes, against counts letter by letter."""
    chroms = {0: ["TTGACCATTGACNCCATTGATTGA"], 1: ["GGGGGGG", "CATTGANC"]}
    probes = ["TTGACC", "CATTGA", "TCAATG", "AAAAAA"]
    seqs = spark.createDataFrame([(0, g, i, t) for g, c in chroms.items() for i, t in enumerate(c)], "group_id int, genome_id int, chr_idx int, seq string")
    p = spark.createDataFrame(list(enumerate(probes)), "probe_id bigint, seq string")
    # the reverse complement of a genome is that of its chromosomes, each at its place
    found = cover.in_genome(cover.covers_full(p, cover.both_strands(seqs), 6), tiling.offsets(seqs))
    sizes = tiling.genome_sizes(seqs)
    r = {(x.genome_id, x.rc): x for x in analysis.report(found, sizes).collect()}
    slide = {(x.genome_id, x.rc, x.middle): x.depth for x in analysis.sliding(found, sizes, 6, 3).collect()}
    flip = str.maketrans("ACGT", "TGCA")
    for g, c in chroms.items():
        for rc in (False, True):
            texts = [t.translate(flip)[::-1] if rc else t for t in c]
            n, depth, at = sum(map(len, texts)), [], 0
            depth = [0] * n
            for t in texts:
                for s in range(len(t) - 5):
                    if t[s : s + 6] in probes:
                        for x in range(at + s, at + s + 6):
                            depth[x] += 1
                at += len(t)
            known = sum(x in "ACGT" for t in texts for x in t)
            assert (r[g, rc].bp_covered, r[g, rc].depth, r[g, rc].depth_unambig) == (sum(d > 0 for d in depth), sum(depth) / n, sum(depth) / known)
            starts = {max(0, min(w, n - 6)) for w in range(0, n, 3)}
            assert {m: round(v, 9) for (x, y, m), v in slide.items() if (x, y) == (g, rc)} == {w + 3: round(sum(depth[w : w + 6]) / 6, 9) for w in starts}
    assert analysis.console(analysis.report(found, sizes)).count() == 4


def test_analysis_tables(spark, tmp_path):
    texts = [("x", 0, 0, "TTGACCATTGACCA"), ("x", 1, 0, "GGGGGGTTGACC"), ("y", 0, 0, "AAAAAAA")]
    seqs = spark.createDataFrame([(i // 2, n, g, c, t) for i, (n, g, c, t) in enumerate(texts)], "group_id int, group_name string, genome_id int, chr_idx int, seq string")
    probes = spark.createDataFrame([("TTGACC",), ("CCCCCC",)], "seq string")
    out = coverage.analysed(seqs, probes, pipeline.DesignConfig(probe_length=6, probe_stride=3, kmer=3))
    m = {r[0]: r[1] for r in out.matrix().collect()}
    assert m == {"x, genome 0": 12, "x, genome 0 (rc)": 0, "x, genome 1": 6, "x, genome 1 (rc)": 6, "y, genome 0": 0, "y, genome 0 (rc)": 0}
    assert {r[1]: r[2] for r in out.counts().collect()} == {"TTGACC": 2}  # probes that cover nothing have no row
    out.write(f"{tmp_path}/m", f"{tmp_path}/w", f"{tmp_path}/c")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/m").columns[0] == "Genome" and spark.read.csv(f"{tmp_path}/w").count() > 0
    assert out.text().startswith("NUMBER OF PROBES: 2\n\nGenome")
    longer = coverage.analysed(seqs, probes, pipeline.DesignConfig(probe_length=6, probe_stride=3, kmer=3, cover_extension=2), rc_too=False)
    assert {r[0]: r[1] for r in longer.matrix().collect()} == {"x, genome 0": 14, "x, genome 1": 8, "y, genome 0": 0}


def test_table_text():
    assert analysis.table_text([["a", "1\n2"], ["bcd", "10"]], ["left", "right"]) == "a    1\n     2\nbcd 10"


def test_set_cover():
    sets = {0: {"u0": [(1, 100)], "u1": [(1, 5)]}, 1: {"u0": [(20, 30)]}, 2: {"u0": [(40, 50)], "u1": [(20, 50)]}}
    assert Cover(sets, share={"u0": 1.0, "u1": 0.1}).solve() == [0]
    assert cover_elements({0: {1, 2}, 1: {1, 2, 3, 4}, 2: {4, 5}}) == [1, 2]
    with pytest.raises(ValueError):
        cover_elements({0: {1}}, share=1.5)
    with pytest.raises(ValueError):
        cover_elements({0: {1}}, {0: -1})


def plain_cover(sets, cost, share, rank):
    """The definition, without a heap."""
    universe = {u: set().union(*[s.get(u, set()) for s in sets.values()]) for u in {u for s in sets.values() for u in s}}
    left = {u: len(v) - int(len(v) - share[u] * len(v)) for u, v in universe.items()}
    picked = []
    for r in sorted(set(rank.values())):
        while any(v > 0 for v in left.values()):
            best = min(((cost[s] / g, s) for s in sets if rank[s] == r and (g := sum(min(left[u], len(e & universe[u])) for u, e in sets[s].items() if left[u] > 0)) > 0), default=None)
            if best is None:
                break
            picked.append(best[1])
            for u, e in sets[best[1]].items():
                left[u] -= len(e & universe[u])
                universe[u] -= e
    return picked


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_set_cover_against_definition(seed):
    rng = random.Random(seed)
    sets = {i: {u: {x for x in range(12) if rng.random() < 0.3} for u in range(2) if rng.random() < 0.8} for i in range(8)}
    cost, rank = {i: rng.choice((1.0, 2.0, 3.0)) for i in sets}, {i: rng.randrange(2) for i in sets}
    share = {u: rng.choice((0.3, 0.5, 1.0)) for u in range(2)}
    as_ranges = {i: {u: [(x, x + 1) for x in e] for u, e in s.items()} for i, s in sets.items()}
    assert Cover(as_ranges, cost, share, rank).solve() == plain_cover(sets, cost, share, rank)


def test_small_kernels():
    import numpy as np

    d = np.array([[0, 1, 100], [1, 0, 2], [100, 2, 0]], dtype=float)
    assert average_linkage(d, 10) == [[0, 1], [2]]
    same = np.array([[0, 0, 4, 8], [0, 0, 4, 8], [4, 4, 0, 6], [8, 8, 6, 0]], dtype=float)
    one = same[1:, 1:]
    for cut in (3, 5, 7, 9):
        assert [[x + 1 for x in c] for c in average_linkage(one, cut, [2, 1, 1])] == [[x for x in c if x] for c in average_linkage(same, cut)]


def test_design_covers_enough(spark):
    text = "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEF"
    seqs = spark.createDataFrame([(0, i, 0, text) for i in range(2)], "group_id int, genome_id int, chr_idx int, seq string")
    config = dict(probe_length=6, probe_stride=1, kmer=6)
    sizes = [pipeline.designed(seqs, pipeline.DesignConfig(coverage=c, **config)).count() for c in (0.5, 1.0)]
    assert sizes == [2, 5]
    assert [pipeline.designed(seqs, pipeline.DesignConfig(coverage=c, **config)).count() for c in (10, 20)] == [1, 3]
    with pytest.raises(ValueError):
        pipeline.DesignConfig(hamming=1, minhash=0.5)


def covered(seqs, probes, m=0):
    """Letters of each sequence under a probe that lies in it, or it in the probe, with at most m mismatches."""
    out = {}
    for g, t in seqs:
        for p in probes:
            short, long = sorted((p, t), key=len)
            for at in range(len(long) - len(short) + 1):
                if sum(a != b for a, b in zip(short, long[at : at + len(short)], strict=True)) <= m:
                    out.setdefault(g, set()).update(range(at, at + len(p)) if short is p else range(len(t)))
    return out


@pytest.mark.parametrize("m", [0, 1])
def test_short_sequences_are_covered(spark, m):
    """Sequences shorter than probes give probes of their own, and set cover keeps what they need."""
    rows_ = [(0, "ACGTTGCAACGGTTAACCGT"), (1, "TTGACCA"), (2, "GGATTCC"), (3, "GCAACGG")]
    seqs = spark.createDataFrame([(0, g, 0, t) for g, t in rows_], "group_id int, genome_id int, chr_idx int, seq string")
    config = pipeline.DesignConfig(probe_length=10, probe_stride=5, kmer=4, small_min=5, mismatches=m)
    probes = [r.seq for r in pipeline.designed(seqs, config).collect()]
    every = [r.seq for r in pipeline.designed(seqs, pipeline.DesignConfig(probe_length=10, probe_stride=5, kmer=4, small_min=5, mismatches=m, skip_set_cover=True)).collect()]
    assert covered(rows_, probes, m) == {g: set(range(len(t))) for g, t in rows_}
    assert set(probes) < set(every) or set(probes) == set(every)
    assert "GCAACGG" not in probes  # a whole probe holds it


def test_cover_kernel_is_linear():
    import time

    def took(n):
        sets = {i: {u: [(x, x + 30) for x in range(i % 40, 400, 97)] for u in (i % n, (i * 7) % n)} for i in range(20 * n)}
        began = time.process_time()
        Cover(sets).solve()
        return time.process_time() - began

    took(20)
    assert took(800) < 8 * max(took(200), 0.05)


def test_parts_are_solved_apart(spark):
    rng = random.Random(3)
    rows_ = []
    for g in range(2):
        for c in range(12):
            for p in range(6):
                rows_ += [(g, 3 * c + rng.randrange(3), 100 * c + p, s, s + rng.randrange(2, 9)) for s in rng.sample(range(30), 2)]
    covers = spark.createDataFrame(rows_, "group_id int, genome_id int, probe_id bigint, start bigint, end bigint")
    shares = covers.select("group_id", "genome_id").distinct().selectExpr("*", "0.8D p")
    got_ = {(r.group_id, r.probe_id) for r in design.solved(covers, shares).collect()}
    want = set()
    for g in range(2):
        sets = {}
        for q, u, p, a, b in rows_:
            if q == g:
                sets.setdefault(p, {}).setdefault(u, set()).update(range(a, b))
        universes = {u for s in sets.values() for u in s}
        want |= {(g, p) for p in plain_cover(sets, dict.fromkeys(sets, 1.0), dict.fromkeys(universes, 0.8), dict.fromkeys(sets, 0))}
    assert got_ == want


def test_cluster_mode_merges_before_adapters(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("ACGT", k=300)) for _ in range(3)]
    seqs = spark.createDataFrame([(i, i, 0, t) for i, t in enumerate([*base, base[0][:299]])], "group_id int, genome_id int, chr_idx int, seq string")
    config = pipeline.DesignConfig(probe_length=40, probe_stride=20, kmer=20, cluster_distance=0.15, add_adapters=True)
    probes = [r.seq for r in pipeline.designed(seqs, config).collect()]
    inner = [p[20:-20] for p in probes]
    assert {p[:20] for p in probes} == {adapters.ADAPTER_A[0], adapters.ADAPTER_B[0]} and len(set(inner)) == len(inner)
    assert covered(list(enumerate([*base, base[0][:299]])), inner) == {i: set(range(len(t))) for i, t in enumerate([*base, base[0][:299]])}
    assert cluster.chosen_method(seqs, 100) == "hierarchical" and cluster.chosen_method(seqs, 500) == cluster.chosen_method(seqs, None) == "simple"


def test_ranks(spark):
    p = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "group_id int, probe_id bigint")
    hits = spark.createDataFrame([(1, 2), (2, 1)], "probe_id bigint, hits bigint")
    avoided = spark.createDataFrame([(2, 7)], "probe_id bigint, bp bigint")
    assert {r.probe_id: r.rank for r in design.ranks(p, hits, avoided).collect()} == {3: 0, 1: 1, 2: 2}


def test_adapters(spark):
    text = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    seqs = spark.createDataFrame([(0, 0, 0, text)], "group_id int, genome_id int, chr_idx int, seq string")
    probes = tiling.numbered(tiling.candidates(seqs, 6, 3))
    out = adapters.assigned(probes, cover.covers_full(probes, seqs, 6))
    assert {r.seq for r in out.collect() if r.adapter == "A"} == {"ABCDEF", "GHIJKL", "MNOPQR", "STUVWX"}
    # groups don't bear on each other
    two = seqs.unionByName(seqs.selectExpr("1 as group_id", "genome_id", "chr_idx", "reverse(seq) seq"))
    both = tiling.numbered(tiling.candidates(two, 6, 3))
    both = adapters.assigned(both, cover.covers_full(both.withColumn("probe_id", F.xxhash64("seq")), two, 6, own_group=True).withColumnRenamed("probe_id", "h").join(both.select("group_id", "probe_id", F.xxhash64("seq").alias("h")), ["group_id", "h"]))
    assert {r.seq for r in both.collect() if r.adapter == "A" and r.group_id == 0} == {"ABCDEF", "GHIJKL", "MNOPQR", "STUVWX"}
    votes = [(s, p, a, 1 - a) for s, (first, second) in enumerate([(0, 1), (1, 0), (0, 1)]) for p, a in ((0, 1 - first), (1, 1 - second))]
    assert adapters.tally([((s,), p, a, b) for s, p, a, b in votes]) == {0: (3, 0), 1: (0, 3)}


def test_clusters(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("ACGT", k=400)) for _ in range(2)]
    df = spark.createDataFrame([(0, base[0]), (1, base[0][:395]), (2, base[1]), (3, base[1][5:]), (4, "".join(rng.choices("ACGT", k=400)))], "seq_id bigint, seq string")
    for f in (cluster.simple, cluster.hierarchical):
        assert {r.seq_id: r.cluster for r in f(df, 0.1).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_pool():
    counts = {"a": {(m, e): 1000 - 100 * m - 5 * e for m in range(5) for e in (0, 10, 20)}, "b": {(m, e): 2000 - 200 * m - 10 * e for m in range(5) for e in (0, 10, 20)}}
    best = pool.standard(counts, 2400)
    assert 0.9 * 2400 < pool.total(counts, best) < 2400
    with pytest.raises(pool.OverLimit):
        pool.search(counts, 100, coefficients=(1, 0.01))
    assert abs(pool.interpolate({(3.0, 10.0): 5000, (3.0, 20.0): 3000, (5.0, 10.0): 3000, (5.0, 20.0): 1000}, (3, 15)) - 4000) < 1e-6
    assert pool.total(counts, pool.descended(counts, 2400, coefficients=(1, 0.01))) < 2400

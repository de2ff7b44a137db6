import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import kernels, sequences as sq
from spanloom.operators import cover, filters, near_duplicates, tiling


def seqs(spark, *texts):
    return spark.createDataFrame([(0, i, 0, t) for i, t in enumerate(texts)], "group_id int, genome_id int, chr_idx int, seq string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    assert value(spark, sq.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert value(spark, sq.mismatches(F.lit("ATCG"), F.lit("AACC"))) == 2
    assert value(spark, sq.mismatches_at(F.lit("ABCDE"), F.lit("XABCD"), -1)) == 0
    assert value(spark, sq.least_mismatches(F.lit("ABCDE"), F.lit("XABCD"), 1)) == 0
    assert value(spark, sq.kmers(F.lit("ABCD"), 3)) == ["ABC", "BCD"]
    assert value(spark, sq.kmers(F.lit("AB"), 3)) == []
    assert value(spark, sq.clean(F.lit("ac-gry"))) == "ACGNN"
    assert len(value(spark, sq.identifier(F.lit("ACGT")))) == 10
    assert abs(value(spark, sq.jaccard_distance(F.lit("ABCD"), F.lit("ABCE"), 2)) - 0.5) < 1e-9
    assert sq.tables_needed(1.0, 3, 0.8) == 1
    with pytest.raises(ValueError):
        sq.tables_needed(0.0, 3, 0.8)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("ATCGTCGCGGATCG", ["ATCGTC", "GTCGCG", "GCGGAT", "GGATCG"]),
        ("ATCGNCGCGGATCG", ["ATCGNC", "GNCGCG", "GCGGAT", "GGATCG"]),
        ("ATCGNCGNNTCG", ["ATCGNC", "TCGNCG"]),
        ("ATCGNCGNNTCGATAT", ["ATCGNC", "TCGNCG", "TCGATA", "TCGATA", "CGATAT"]),
    ],
)
def test_candidates(spark, text, expected):
    assert sorted(r.seq for r in tiling.candidates(seqs(spark, text), 6, 3).collect()) == sorted(expected)


def test_small_sequences(spark):
    assert [r.seq for r in tiling.candidates(seqs(spark, "CCGG"), 6, 3, allow_small=4).collect()] == ["CCGG"]
    assert tiling.candidates(seqs(spark, "CCGG"), 6, 3, skip=4).count() == 0
    with pytest.raises(Exception, match="shorter"):
        tiling.candidates(seqs(spark, "CCGG"), 6, 3).collect()


def test_candidates_are_numbered(spark):
    text = "A" * 100 + "B" * 100 + "A" * 100
    found = tiling.candidates(seqs(spark, text), 100, 50)
    assert (found.count(), tiling.numbered(found).count()) == (5, 4)


def test_pieces_hold_every_window(spark):
    text = "".join(random.Random(1).choices("ACGT", k=300))
    got = tiling.pieces(seqs(spark, text, "ACG", ""), 4, (100, 16)).select("genome_id", F.explode(sq.kmers(F.col("part"), 5)).alias("w")).where("genome_id = 0").collect()
    assert sorted(r.w for r in got) == sorted(text[i : i + 5] for i in range(296))


def test_fragments_and_sizes(spark):
    df = seqs(spark, "ABCDEFGH")
    assert [r.seq for r in tiling.fragments(df, 3).orderBy("pos").collect()] == ["ABC", "DEF", "GH"]
    assert [r.seq for r in tiling.fragments(df, 3, full_end=True).orderBy("pos").collect()] == ["ABC", "DEF", "FGH"]
    r = tiling.genome_sizes(seqs(spark, "ACGTN")).first()
    assert (r.size, r.unambiguous, r.chromosomes) == (5, 4, 1)


def test_longest_common():
    assert [kernels.longest_common("ABCABCDEFGHIJKLM", "DEFGABCDEFGHIJKLN", k) for k in (0, 1, 2)] == [(12, 3, 4), (13, 2, 3), (14, 1, 2)]
    assert kernels.longest_common("ABC", "DEF", 1) == (1, 0, 2)
    assert kernels.longest_around("ABCDEFGHIJKLM", "XYCDEFGTUVWXY", 3, 6, 0) == (5, 2)
    with pytest.raises(ValueError):
        kernels.longest_around("AAA", "BBB", 0, 1, 0)


def test_poly_and_expansion(spark):
    df = spark.createDataFrame([("CCGGAAGAACC",)], "seq string")
    runs = [df.select(filters.longest_tolerant_run(F.col("seq"), "A", m)).first()[0] for m in (0, 1, 2)]
    assert runs == [2, 5, 6]
    kept = filters.without_poly(spark.createDataFrame([("AAAAAAACGT",), ("ACGTACGTAC",)], "seq string"), 7, 0)
    assert [r.seq for r in kept.collect()] == ["ACGTACGTAC"]
    got = filters.expanded(spark.createDataFrame([("ANCG",)], "seq string"))
    assert [r.seq for r in got.collect()] == ["AACG", "ATCG", "ACCG", "AGCG"]
    assert filters.expanded(spark.createDataFrame([("NNNNN",)], "seq string"), 2).count() == 16


def plain_windows(text, window, stride):
    """Strided windows, the tail, and those beside runs of two N or more, by walking the text."""
    n, out = len(text), []
    if n >= window:
        out += [(0, i) for i in range(0, n - window + 1, stride)] + [(1, n - window)] * (n % stride != 0)
        i = 0
        while i < n:
            j = i
            while j < n and text[j] == "N":
                j += 1
            if j - i >= 2:
                out += [(2, i - window)] * (i >= window) + [(2, j)] * (j + window <= n)
            i = max(j, i + 1)
    return sorted((k, p, text[p : p + window]) for k, p in out if "NN" not in text[p : p + window])


def test_windows_of_long_texts(spark):
    """Windows, fragments and pieces are those of the whole text, over the borders of pieces."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("ACGTN", [6, 6, 6, 6, 5], k=k)) for k in (251, 600, 2003, 45_000)] + ["N" * 700, "A" * 300 + "N" * 600 + "C" * 301, "ACGT" * 7 + "AC"]
    df = seqs(spark, *texts)
    got = {}
    for r in tiling.candidates(df, 30, 15).collect():
        got.setdefault(r.genome_id, []).append((r.kind, r.pos, r.seq))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, t in enumerate(texts) if (w := plain_windows(t, 30, 15))}
    for size, full in ((500, False), (500, True), (30_000, True)):
        parts = sorted((r.genome_id, r.pos, r.seq) for r in tiling.fragments(df, size, full_end=full).collect())
        want = []
        for i, t in enumerate(texts):
            for p in range(0, len(t), size):
                q = max(0, len(t) - size) if full and p + size > len(t) else p
                want.append((i, q, t[q : q + size]))
        assert parts == sorted(want)
    first = {}
    for i, t in enumerate(texts):
        for w in plain_windows(t, 30, 15):
            first.setdefault(w[2], (i, w[0], w[1]))
    order = sorted(first, key=lambda w: (first[w], w))
    assert [r.seq for r in tiling.numbered(tiling.candidates(df, 30, 15)).orderBy("probe_id").collect()] == order


def test_blocks():
    assert cover.exact_blocks(10, 2) == [(0, 3), (3, 3), (6, 4)]
    with pytest.raises(ValueError):
        cover.exact_blocks(3, 3)


def test_seeded_covers_in_long_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ACGT", k=k)) for k in (40, 700, 21_000)]
    found = [(i, p, texts[i][p : p + 30]) for i, t in enumerate(texts) for p in rng.sample(range(len(t) - 29), 8)]
    probes = spark.createDataFrame([(k, s) for k, (_, _, s) in enumerate(found)], "probe_id bigint, seq string")
    want = {(g, k, t.find(s, at)) for k, (_, _, s) in enumerate(found) for g, t in enumerate(texts) for at in range(len(t)) if t.startswith(s, at)}
    for few in (1, 10**6):
        old, cover.BROADCAST_ROWS = cover.BROADCAST_ROWS, few
        try:
            got = {(r.genome_id, r.probe_id, r.start) for r in cover.covers_seeded(probes, seqs(spark, *texts), cover.full_index(probes, 12), 12, cover.predicate(0, 30)).collect()}
            exact = {(r.genome_id, r.probe_id, r.start) for r in cover.covers_full(probes, seqs(spark, *texts), 30).collect()}
        finally:
            cover.BROADCAST_ROWS = old
        assert got == exact == want


def test_shifted_pairs_miss_none(spark):
    rng = random.Random(9)
    texts = sorted({"".join(rng.choices("AC", k=12)) for _ in range(60)})
    df = spark.createDataFrame([(0, i, t, 1) for i, t in enumerate(texts)], "group_id int, probe_id bigint, seq string, times int")
    near = lambda a, b: any(sum(x != y for x, y in zip(a[d:], b, strict=False)) <= 1 for d in range(4))
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(texts[i], texts[j]) or near(texts[j], texts[i])}
    assert {(r.a, r.b) for r in near_duplicates.shifted_pairs(df, 3, 1).collect()} == want


def test_hamming_pairs_and_hashes(spark):
    """The block join misses none; hashes report about what they promise, and nothing else."""
    rng = random.Random(2)
    base = ["".join(rng.choices("ACGT", k=40)) for _ in range(40)]
    flip = lambda t, k: "".join(rng.choice("ACGT".replace(c, "")) if i in at else c for at in [set(rng.sample(range(40), k))] for i, c in enumerate(t))
    texts = sorted({x for t in base for x in (t, *(flip(t, rng.randrange(1, 4)) for _ in range(6)))})
    df = spark.createDataFrame([(0, i, t, 1) for i, t in enumerate(texts)], "group_id int, probe_id bigint, seq string, times int")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sum(a != b for a, b in zip(texts[i], texts[j], strict=True)) <= 3}
    pairs = lambda d: {(r.a, r.b) for r in d.collect()}
    assert pairs(near_duplicates.hamming_pairs(df, 40, 3)) == want
    some = pairs(near_duplicates.hamming_lsh_pairs(df, 40, 3, k=8, report=0.9))
    assert some <= want and len(some) >= 0.8 * len(want)
    k = {i: {t[x : x + 6] for x in range(35)} for i, t in enumerate(texts)}
    alike = {(i, j) for i in k for j in k if i < j and 1 - len(k[i] & k[j]) / len(k[i] | k[j]) <= 0.5}
    some = pairs(near_duplicates.minhash_lsh_pairs(df, 0.5, kmer=6, k=2, report=0.9))
    assert some <= alike and len(some) >= 0.8 * len(alike)
    assert pairs(near_duplicates.jaccard_pairs(df, 6, 0.5)) == alike


def test_full_covers_miss_none(spark):
    rng = random.Random(3)
    genome = "".join(rng.choices("ACGT", k=4000))
    rows, truth = [], set()
    for i in range(60):
        at = rng.randrange(3900)
        p = list(genome[at : at + 40])
        for j in rng.sample(range(40), rng.randrange(4)):
            p[j] = rng.choice("ACGT")
        rows.append((i, "".join(p)))
    for i, p in rows:
        truth |= {(i, a) for a in range(len(genome) - 39) if sum(x != y for x, y in zip(p, genome[a : a + 40], strict=True)) <= 3}
    probes = spark.createDataFrame(rows, "probe_id bigint, seq string")
    got = {(r.probe_id, r.start) for r in cover.covers_full(probes, seqs(spark, genome), 40, 3).collect()}
    assert got == truth


def test_seeded_covers(spark):
    fn = cover.predicate(0, 6)
    assert fn("ABCGHIJKLXYZ", "ABCGHIJKLXYZ", 3, 6, 12, 12) == (0, 12)
    probes = spark.createDataFrame([(0, "ABCDEFGHIJKL")], "probe_id bigint, seq string")
    whole = seqs(spark, "ZZZABCDEFGHIXYZ")
    got = cover.covers_seeded(probes, whole, cover.full_index(probes, 3), 3, fn).collect()
    assert [(r.start, r.end) for r in got] == [(3, 12)]


def test_near_duplicates(spark):
    texts = ["ATCGTCGCGG", "ATCGTGGCGG", "TTCGTCGCGG", "ATCGGCGCGG"]
    df = spark.createDataFrame([(0, i, t, 1) for i, t in enumerate(texts)], "group_id int, probe_id bigint, seq string, times int")
    assert near_duplicates.without_near(df, hamming=2).count() == 1
    assert near_duplicates.without_near(df, hamming=0).count() == 4
    more = spark.createDataFrame([(0, 10 + i, t, 1) for i, t in enumerate(["GGCTTACTGA", "GGCTTACTGA", "GGCTTTCTGA", "GGCTTACTAT"])], df.schema)
    got = {r.seq for r in near_duplicates.without_near(df.unionByName(more), hamming=2).collect()}
    assert len(got) == 2 and "GGCTTACTGA" in got
    pairs = near_duplicates.redundant_pairs(df, near_duplicates.common_stretch_redundant(8, 1), 3)
    near = {(a, b) for a in range(4) for b in range(a + 1, 4) if kernels.longest_common(texts[a], texts[b], 1)[0] >= 8}
    assert {(r.a, r.b) for r in pairs.collect()} == near and near
    kept = []
    for i in range(4):
        if not any((j, i) in near for j in kept):
            kept.append(i)
    assert sorted(r.probe_id for r in near_duplicates.without_redundant(df, pairs).collect()) == kept
    chosen = {r.probe_id for r in near_duplicates.dominating(df, pairs).collect()}
    assert all(i in chosen or any((min(i, j), max(i, j)) in near for j in chosen) for i in range(4))

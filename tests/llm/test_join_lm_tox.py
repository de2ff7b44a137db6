import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import brown_lm, jaccard_join, toxicity
from spanloom.llm.common import ALNUM, SPACE, text_words, texts_of


def shingles(t):
    w = (t or "").encode().lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    to = list(range(len(rows)))

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            to[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = say(60)
    rows = []
    for i in range(25):
        base = say(rng.choice((3, 6, 9, 20, 60, 200, 500)))
        if rng.random() < 0.3:
            base = base + passage
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 15))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(1000)}"
            rows.append(" ".join(w[: len(w) - rng.randrange(0, max(1, len(w) // 8))]))
    rows += [None, "", " \n ", "One", "one", "a b c d e", "A b c d e", "x " * 20_000, rows[0]]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "points"), [(1, 4096), (2, 3)])
def test_join_is_exact(spark, seed, points):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, point int")
    told = {}
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.clusters(df, leaf_points=points, pivots=3, told=told).collect())
    assert got == brute(rows)
    assert told["pivots"] > 0


def test_voronoi_regions_decide(spark):
    """Families of texts that share most of a passage, but not enough to link: only pivots and their regions tell them apart."""
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(6):
        centre = say(300)
        for k in range(16):
            w = list(centre)
            at = rng.randrange(200)
            w[at : at + 14 + k % 3] = say(14 + k % 3)  # two of these differ in about 30 to 40 of 296 shingles
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for leaf in (2,):
        told = {}
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.clusters(df, leaf_points=leaf, told=told).collect())
        assert got == brute(rows)
        assert told["pivots"] > 0, told


def test_one_of_each(spark):
    rows = [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, None), (5, "z")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, row string")
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]
    assert jaccard_join.clusters(df.limit(0)).count() == 0


def test_signatures_meet():
    """Linked sets share a signature, whatever is common."""
    rng = np.random.default_rng(0)
    rings = jaccard_join.Rings(80, 100)
    for n in (5, 6, 9, 14, 30, 77, 200):
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, len(a) // 5 + 1)
            b = np.sort(rng.permutation(a)[drop:])
            both = len(np.intersect1d(a, b))
            common = (rng.random(1 << jaccard_join.BITS) < rng.choice((0, 0.5, 0.95))).astype(np.uint8)
            if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) != len(b):
                assert np.intersect1d(rings.signatures(a, common), rings.signatures(b, common)).size


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(20)]
    got = dict(map(tuple, jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    to = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            to[a] = to[b] = min(to[a], to[b])
    assert got == {x: v for x, v in to.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.fixture(scope="module")
def lm_rows():
    rng = random.Random(9)
    kinds = [[f"{p}{i}" for i in range(30)] for p in "ABc"]
    rows = []
    for i in range(400):
        k = i % 2
        rows.append((i, " ".join(rng.choice(kinds[(k + j) % 2] if j % 3 else kinds[2]) for j in range(rng.randrange(40)))))
    return rows + [(900, None), (901, ""), (902, "unseenword " * 3000), (903, "a1"), (903, "a1"), (None, "A2 b3")]


def plain_scores(rows, counts, m):
    """Every text's score word by word from the model's numbers."""
    cls = dict(zip(m.keys.tolist(), m.classes.tolist(), strict=True))
    out = []
    for _, t in rows:
        before, score = m.end, 0.0
        for h in [*text_words(t, SPACE).tolist(), brown_lm.END]:
            k = cls.get(h, m.rare)
            score += m.transitions[before, k] + math.log10(counts.get(h, 0) + brown_lm.ADD) - m.totals[k]
            before = k
        out.append(score)
    return out


@pytest.mark.parametrize("frequent", [4_000_000, 60])
def test_brown_scores_against_plain_ones(spark, lm_rows, frequent):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in lm_rows], "doc_id long, text string, score double, key int")
    tok = lambda t: (t or "").encode().lower().split() + [None]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    train = [t for d, t in lm_rows if not out(d)]
    c = Counter(w for t in train for w in tok(t))
    n, v = sum(c.values()), len(c)
    rare, m = brown_lm.train_model(df, classes=6, seeds=40, frequent=frequent)
    assert len(m.keys) <= frequent and all(k < 6 or h == brown_lm.END for h, k in zip(m.keys.tolist(), m.classes.tolist(), strict=True))
    counts = {r.h % 2**64: r.n for r in rare.collect()} | dict(zip(m.keys.tolist(), m.counts.tolist(), strict=True))
    assert sorted(counts.values()) == sorted(c.values())
    one = brown_lm.scored(df, rare, m)
    got = one.collect()
    key = lambda r: (r[0] is not None, r[0] or 0, -r[2])
    want = [(d, out(d), len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok(t)), s) for (d, t), s in zip(lm_rows, plain_scores(lm_rows, counts, m), strict=True)]
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(r)[:5] == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-9)
    p = brown_lm.perplexity(one).first()
    assert p.model < 0.9 * p.base
    assert brown_lm.score_all(df.limit(0)).count() == 0
    # nothing to learn from: the score is that of the class of unseen words alone
    alone = df.where("doc_id = 900 or doc_id = 901").where(brown_lm.held_out(F.col("doc_id")))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in brown_lm.score_all(alone).collect())


def test_brown_probabilities_sum_to_one(spark, lm_rows):
    df = spark.createDataFrame(lm_rows, "doc_id long, text string")
    rare, m = brown_lm.train_model(df, classes=6, seeds=40, frequent=100)
    words = [(m.rare, r.n) for r in rare.collect()] + list(zip(m.classes.tolist(), m.counts.tolist(), strict=True)) + [(m.rare, 0)]
    for c in (m.end, 0, 3, m.rare):
        total = sum(10 ** (m.transitions[c, k] + math.log10(n + brown_lm.ADD) - m.totals[k]) for k, n in words)
        assert abs(total - 1) < 1e-3  # classes without words hold next to nothing


def test_brown_sweeps_place_all_frequent_words(spark):
    """Words that aren't seeds get the class of the words that they stand among."""
    rng = random.Random(2)
    kinds = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[j % 2]) for j in range(40))) for i in range(600)]
    _, m = brown_lm.train_model(spark.createDataFrame(rows, "doc_id long, text string"), classes=2, seeds=20)
    cls = dict(zip(m.keys.tolist(), m.classes.tolist(), strict=True))
    of = [{cls[int(text_words(w, SPACE)[0])] for w in k} for k in kinds]
    assert len(m.keys) == 121 and [len(x) for x in of] == [1, 1] and of[0] != of[1]


def test_words_are_those_of_a_split():
    rng = random.Random(8)
    texts = [None, "", " ", "a", " a\tB\x0b\x0cc\n", "é\u00a0É x", "x" * 50_000] + ["".join(rng.choices("aB é\n-9\u212a", k=rng.randrange(30))) for _ in range(300)]
    col = pa.array(texts)
    for apart, split in ((SPACE, lambda t: t.encode().lower().split()), (ALNUM, lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower()))):
        name = {}
        for t, got in zip([*texts, *texts[5:]], [*texts_of(col, apart), *texts_of(col.slice(5), apart)], strict=True):
            words = split(t or "")
            assert len(got) == len(words)
            for w, h in zip(words, got.tolist(), strict=True):
                assert name.setdefault(w, h) == h
        assert len(set(name.values())) == len(name)


def test_exchange_finds_classes():
    rng = random.Random(0)
    n = np.zeros((22, 22))
    for _ in range(4000):
        a = rng.randrange(20)
        n[a, rng.randrange(10) + (0 if a >= 10 else 10)] += 1
    fixed = np.zeros(22, dtype=bool)
    fixed[-2:] = True
    cls = brown_lm.exchange(n, 2, fixed)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10]


def test_toxicity(spark):
    rng = random.Random(3)
    clean, bad = [f"w{i}" for i in range(300)], ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(clean, k=rng.randrange(5, 60))
        toxic = i % 5 == 0
        if toxic:
            w += rng.choices(bad, k=3)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, int(rng.random() < 0.7), int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "w1 " * 20_000), (2003, rows[0][1])]
    labels += [(None, 0, 1), (5000, 0, 1), (3, None, None), (0, 0, 1)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, tox_ double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(df, lab).collect()}
    wrong = [i for i in range(600, 900) if got[i].toxic != (i % 5 == 0)]
    assert len(wrong) <= 6 and not got[2000].toxic and not got[2001].toxic and got[2003].p_toxic == got[0].p_toxic
    stay = toxicity.not_toxic(df, lab)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == {d for d, r in got.items() if not r.toxic}
    assert toxicity.judged(df.limit(0), lab).count() == 0
    assert toxicity.judged(df, lab.limit(0)).where("toxic").count() == 0


def test_toxicity_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    rows = [np.array([1 if v else 2], dtype=np.int32) for v in y]
    chain = toxicity.train(rows, np.stack([y, y], axis=1), ["a", "b"], rng.integers(0, toxicity.FOLDS, 600))
    assert chain.weights[1][1 << toxicity.BITS] > 0
    assert (chain.scores(toxicity.Rows.of(rows))[:, 1].round() == y).all()
    assert re.fullmatch("a|b", chain.names[0]) and F is not None


def test_training_holds_little_on_the_driver():
    """Arrays are as long as the features that can have a weight, not 2^BITS; the models are those of all features."""
    rng = np.random.default_rng(5)
    common = np.sort(rng.choice(1 << toxicity.BITS, 3_000, replace=False))
    y = rng.random(2_000) < 0.5
    rows = []
    for yes in y:
        some = common[:1_500] if yes else common[500:]
        rows.append(np.unique(np.r_[rng.choice(some, 40), rng.integers(0, 1 << toxicity.BITS, 100)]).astype(np.int32))
    labels, fold = y[:, None].astype(int), rng.integers(0, toxicity.FOLDS, len(rows))
    tracemalloc.start()
    try:
        chain = toxicity.train(rows, labels, ["a"], fold)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20_000_000
    every = toxicity.fit(toxicity.Rows.of(rows), np.zeros((len(rows), 0)), y.astype(float), np.ones(len(rows), dtype=bool))
    assert np.array_equal(chain.weights[0], every)
    scores = toxicity.sigmoid(toxicity.Rows.of(rows).dot(every[:-1]) + every[-1])
    assert np.allclose(chain.scores(toxicity.Rows.of(rows))[:, 0], scores, rtol=0, atol=1e-12)

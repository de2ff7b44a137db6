"""Min-max hashing, token alignment and hard negatives against brute force, on odd tables; main text on odd marks."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import align, html_main, jaccard_join, minmax, mixing, negatives


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# min-max hashing


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_clusters(rows):
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if of[k] == of[i] and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


def near_copies(seed, n=90):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([2, 4, 8, 9, 30, 80, 200]))] for _ in range(9)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO")]
    for i in range(5, n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"w{r.randrange(400)}"
        rows.append((i, " ".join(w)))
    return [*rows, (7, rows[8][1]), (7, rows[7][1])]


@pytest.mark.parametrize(("leaf_points", "block_points"), [(2, 512), (1_024, 512), (1_024, 4)])
def test_minmax_links_are_all_links(spark, monkeypatch, leaf_points, block_points):
    monkeypatch.setattr(jaccard_join, "BLOCK_POINTS", block_points)
    rows = near_copies(3)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, component_id string, point int")
    got = minmax.clusters(docs, leaf_points=leaf_points).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got), key=key) == sorted(plain_clusters(rows), key=key)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)


def test_minmax_of_no_rows(spark):
    assert minmax.clusters(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_minmax_estimates_are_unbiased_and_vary_less_than_smallest_values():
    r = np.random.default_rng(1)
    errors, plain = [], []
    for k in range(60):
        x = r.integers(0, 1 << 63, 50).astype(np.uint64)
        y = np.concatenate([x[:40], r.integers(0, 1 << 63, 10).astype(np.uint64)])
        true = 40 / 60
        one = minmax.MinMax(miss=1e-9)
        one.by = r.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        one.plus = r.integers(0, 1 << 63, 200).astype(np.uint64)
        errors.append(one.estimate(x, y) - true)
        (a, _), (c, _) = one.ends(x), one.ends(y)
        plain.append((a == c).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < np.var(plain)


def test_minmax_bands_miss_less_than_promised():
    one = minmax.MinMax()
    assert (1 - one.chance() ** one.pairs) ** one.bands <= minmax.MISS
    assert not one.links(5) and one.links(6) and len(one.signatures(np.arange(5, dtype=np.uint64))) == 0
    assert len(one.signatures(np.arange(500_000, dtype=np.uint64))) == one.bands


# alignment


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.B_PATH)
    letters = align._byte_letters()
    out, links = [], []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False) if t else None
        y = b.encode(t) if t else []
        xs = [bytes(letters[c] for c in w) for w in x.tokens] if t else []
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not t or not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        at, spans = 0, []
        for k, words in enumerate((xs, ys)):
            at = 0
            for i, w in enumerate(words):
                spans.append((k, i, at, at + len(w)))
                at += len(w)
        left, right = ([s for s in spans if s[0] == k] for k in (0, 1))
        own = [(x.ids[i], y[j]) for _, i, s, e in left for _, j, s2, e2 in right if s < e2 and s2 < e]
        ends = sorted({s[3] for s in left} & {s[3] for s in right})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(ids[i]) for _, i, s, e in side if before <= s and e <= end) for side, ids in ((left, x.ids), (right, y))))
            before = end
        out.append((len(xs), len(ys), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = Counter(p for own in links for p in own)
    top = {}
    for (_, q), n in count.items():
        top[q] = max(n, top.get(q, 0))
    return [(*o, sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own)) for o, own in zip(out, links, strict=True)]


def test_alignment_is_that_of_all_pairs(spark):
    texts = ["Hello  world, it's 12345!", "", None, "naïve 日本語 🙂 text\n\n\tend ", "<|endoftext|> <s> </s> <0x41>", "a▁b", "x", "Hello  world, it's 12345!", "   ", "words " * 300, "ünüberträgliche Größenordnungen à côté " * 4, " odd　space\x00zero", "ﬁ ligature é"]
    rows = [(i if i != 5 else None, t, "n", [1]) for i, t in enumerate(texts)] + [(0, texts[0], "n", [1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, pairs array<int>")
    want = plain_alignment([t for _, t, _, _ in rows])
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    key = lambda x: tuple((v is None, v) for v in x)
    for bundle in (1, align.BUNDLE):
        got = [(r["doc_id"], *(r[c] for c in names)) for r in align.measured(docs, bundle=bundle).collect()]
        assert sorted(got, key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
    assert sum(w[0] > 0 for w in want) >= 10 and want[5][:5] == (0, 0, 0, 0, "")
    assert align.measured(docs.limit(0)).count() == 0


# hard negatives


def plain_negatives(rows, anchors, k=5, m=3):
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    for i, (a, label, v) in enumerate(rows):
        if not anchors(a):
            continue
        s = [(-dot(v, w), b, other) for j, (b, other, w) in enumerate(rows) if j != i]
        for n, p, _ in sorted(x for x in s if x[2] == label)[:k]:
            fit = sorted((x, b) for x, b, other in s if other != label and 50 * -n <= 100 * -x <= 95 * -n)[:m]
            out += [(a, p, r + 1, b, -n, -x) for r, (x, b) in enumerate(fit)]
    return sorted(out)


def mined(df, **how):
    rows = negatives.quantised(df, "vec_id", "label", "embedding")
    return sorted(map(tuple, negatives.mined(rows, F.col("id") % 5 == 0, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"block": 8, "blocks": 2, "group": 3}])
def test_negatives_are_those_of_all_pairs(spark, how):
    r = random.Random(4)
    rows = []
    for i in range(150):
        c = r.randrange(3)
        v = [round((2.0 if d == c else 0.7) + r.gauss(0, 0.4), 1) * r.choice([0.25, 1, 1, 4]) for d in range(6)]
        rows.append((i, c, v))
    rows += [(150, 1, [0.0] * 6), (155, 1, [0.0] * 6), (160, 2, [-1.0] * 6), (165, 0, [1.0, 1.0]), (5, 0, rows[5][2]), (170, 0, [])]
    odd = [(None, 1, [1.0] * 6), (180, None, [1.0] * 6), (185, 1, None), (190, 1, [1.0, None, 1.0]), (195, 1, [1.0, float("nan")]), (200, 1, [float("inf")] * 6)]
    df = spark.createDataFrame([(*x, "y") for x in [*rows, *odd]], "vec_id bigint, label int, embedding array<double>, row string").repartition(3)
    whole = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in rows]
    want = plain_negatives(whole, lambda i: i % 5 == 0)
    got = mined(df, **how)
    assert len(want) > 100 and got == want


def test_negatives_of_huge_numbers_and_of_no_rows(spark):
    df = spark.createDataFrame([(0, 0, [1e12, 1.0]), (1, 0, [1e12, 3.0]), (2, 1, [8e11, 1.0]), (3, 1, [1.0, 1.0])], "vec_id bigint, label int, embedding array<double>")
    whole = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in map(tuple, df.collect())]
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    got = mined(df)
    want = [(a, p, k, n, long(ps), long(ns)) for a, p, k, n, ps, ns in plain_negatives(whole, lambda i: i % 5 == 0)]
    # all large scores are cut off at the limit, where no negative is below 95 hundredths of its positive
    assert [g for g in got if g[4] < (1 << 63) - 1] == [w for w in want if w[4] < (1 << 63) - 1]
    assert mined(df.limit(0)) == []


# main text and mixing


@pytest.mark.parametrize(
    "inner",
    ['<p title="a hidden gem">kept words here</p>', '<p data-id="menu" data-role="navigation">kept words here</p>', '<h1 class="page-header">kept words here</h1>', '<div class="ad-hoc committee">kept words here</div>', '<div class="notice-of-meeting">kept words here</div>', '<section class="navigation">kept words here</section>'],
)
def test_main_text_keeps_parts_of_articles(inner):
    page = f"<html><body><nav><a>menu</a></nav><article><p>first words of the article</p>{inner}<p>last words of it</p></article></body></html>"
    assert html_main.main_text(page, {}) == "first words of the article\nkept words here\nlast words of it"


@pytest.mark.parametrize("inner", ['<p hidden>gone</p>', '<div id="menu">gone</div>', '<div role="navigation">gone</div>', '<div class="ad">gone</div>', '<div class="cookie-banner">gone</div>', '<section class="comments">gone</section>', "<div style='display: none'>gone</div>"])
def test_main_text_leaves_other_parts_out(inner):
    page = f"<html><body><article><p>first words of the article</p>{inner}<p>last words of it</p></article></body></html>"
    assert html_main.main_text(page, {}) == "first words of the article\nlast words of it"


def test_main_text_without_sidebars_and_with_links():
    page = "<body><article><p>the article has these words</p></article><aside><article>a teaser of other words</article></aside></body>"
    assert html_main.main_text(page, {}) == "the article has these words"
    weights = {"<a": -5.0, "<p": 0.0, "<li": -5.0, "<ul": -5.0}
    page = "<body><p>one <a>two</a> three</p><p>then a paragraph of more words follows it here</p><ul><li><a>home</a></li><li><a>more</a></li></ul></body>"
    assert html_main.main_text(page, weights) == "one two three\nthen a paragraph of more words follows it here"


def test_mix_does_not_depend_on_the_order_of_patterns(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"], ["a", "b"], ["b", "c"], ["c"], ["a", "c"]] * 4)]
    taken = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, m array<string>").repartition(3)
        out = mixing.mix(df, members=F.col("m"), size=mixing.words(F.col("text")), identity=[F.col("doc_id")], carry=["doc_id"])
        taken.add(tuple(sorted((r["doc_id"], r["taken"]) for r in out.collect())))
    assert len(taken) == 1

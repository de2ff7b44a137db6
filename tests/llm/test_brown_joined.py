import math
import random
from collections import Counter

from spanloom.llm import brown_lm
from spanloom.llm.common import SPACE, text_words


def test_words_beyond_the_held_ones_are_clustered(spark):
    """How many words are held in the tasks doesn't change the model or the scores: all words seen twice have their classes."""
    rng = random.Random(4)
    kinds = [[f"{p}{i}" for i in range(60)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[(i + j) % 2] if j % 3 else kinds[2]) if rng.random() < 0.99 else f"once{rng.random()}" for j in range(rng.randrange(1, 40)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, m = brown_lm.train_model(df, classes=4, seeds=20)
    part, few = brown_lm.train_model(df, classes=4, seeds=20, held=50)
    cls = dict(zip(m.keys.tolist(), m.classes.tolist(), strict=True))
    got = dict(zip(few.keys.tolist(), few.classes.tolist(), strict=True)) | {r.h % 2**64: r.cls for r in part.collect()}
    assert 20 < len(few.keys) <= 50 and len(m.keys) == 181
    assert got == cls | {r.h % 2**64: m.rare for r in whole.collect()}
    assert len({got[int(text_words(w, SPACE)[0])] for w in kinds[0]}) == 1 and all(got[int(text_words(w, SPACE)[0])] < 4 for k in kinds for w in k)
    assert (abs(few.transitions - m.transitions) < 1e-9).all() and (abs(few.totals - m.totals) < 1e-9).all()
    scores = [sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in brown_lm.scored(df, x, y).collect()) for x, y in ((whole, m), (part, few))]
    assert scores[0] == scores[1] and len(scores[0]) == len(rows)


def test_without_sweeps_probabilities_sum_to_one(spark):
    rows = [(i, f"a{i % 9} b{i % 7} c{i}") for i in range(60)]
    rest, m = brown_lm.train_model(spark.createDataFrame(rows, "doc_id long, text string"), classes=3, seeds=4, sweeps=0, held=8)
    words = [(r.cls, r.n) for r in rest.collect()] + list(zip(m.classes.tolist(), m.counts.tolist(), strict=True)) + [(m.rare, 0)]
    assert Counter(k for k, _ in words)[m.rare] > 40
    for c in (m.end, 0, m.rare):
        assert abs(sum(10 ** (m.transitions[c, k] + math.log10(n + brown_lm.ADD) - m.totals[k]) for k, n in words) - 1) < 1e-3

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, exact_dedup, mixing

DOCS = "doc_id long, text string, source string, kept string, hit_ string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


ODD = [(1, "a", "s"), (1, "a", "s"), (2, "a", "t"), (2, "a", "t"), (3, None, None), (4, "", "s"), (None, "b", "s"), (5, "word " * 30_000, "t")]


def test_exact_dedup(spark):
    rows = [r.asDict() for r in exact_dedup.decisions(docs(spark, ODD)).collect()]
    assert len(rows) == len(ODD)
    by = {}
    for _, t, _ in ODD:
        by[t or ""] = by.get(t or "", 0) + 1
    for r in rows:
        text = next(t or "" for i, t, _ in ODD if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == by[text]
        assert r["keep_id"] == max((i for i, t, _ in ODD if (t or "") == text), key=lambda i: (i is not None, i or 0))
    assert sum(r["kept"] for r in rows) == len(by)
    stay = exact_dedup.deduplicate(docs(spark, ODD))
    assert stay.columns == docs(spark, ODD).columns and sorted((r.doc_id or 0) for r in stay.collect()) == [0, 2, 4, 5]
    empty = docs(spark, ODD).limit(0)
    assert exact_dedup.decisions(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_compares_bytes(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abc", k=2)), "s") for i in range(200)]
    weak = exact_dedup.decisions(docs(spark, rows), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).select("doc_id", "keep_id", "group_size", "kept")
    full = exact_dedup.decisions(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, full.collect()))


def test_exact_dedup_keeps_state(spark, tmp_path):
    at = str(tmp_path / "state")
    first = exact_dedup.decisions(docs(spark, [(1, "a", "s"), (2, "b", "s")]), state_dir=at).collect()
    later = {r.doc_id: r for r in exact_dedup.decisions(docs(spark, [(3, "a", "s"), (4, "c", "s")]), state_dir=at).collect()}
    assert len(first) == 2 and later[3].group_size == 2 and later[3].keep_id == 3 and later[4].group_size == 1


@pytest.mark.parametrize("plain", [True, False])
def test_exact_dedup_compares_bytes_with_earlier_calls(spark, tmp_path, plain):
    """All texts have one digest; only bytes tell them apart, in one call and over two."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["aa", "bb", "cc", None, ""]), "s") for i in range(40)]
    constant = lambda t: F.lit("d")
    seen = {}
    for k in range(2):
        part = rows[20 * k : 20 * k + 20]
        df = docs(spark, part)
        if plain:
            df.write.parquet(f"{tmp_path}/in{k}")
            df = spark.read.parquet(f"{tmp_path}/in{k}")
        got = {r.doc_id: r for r in exact_dedup.decisions(df, state_dir=f"{tmp_path}/state", digest=constant).collect()}
        for i, t, _ in part:
            seen.setdefault(t or "", []).append(i)
        assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {i: (max(seen[t or ""]), len(seen[t or ""]), i == max(seen[t or ""])) for i, t, _ in part}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    win = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if s := win.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_decontamination(spark, block):
    rng = random.Random(4)
    vocab = ["ab", "cd", "Éa", "x1", "the", "of", "qq"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.choice((3, 9, 10, 11, 25, 40)))) for i in range(20)] + [(50, None), (51, ""), (52, "..."), (None, say(12))]
    rows = [(i, say(rng.randrange(80))) for i in range(150)] + [(200, None), (201, ""), (202, "x " * 50_000)]
    rows += [(300 + i, f"{say(5)} {t.upper() if t else ''}, {say(5)}") for i, t in items[:20]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.judged(df, bench, block_bytes=block).collect()}
    want = brute(rows, items)
    assert got == want
    clean = decontaminate.decontaminate(df, bench, block_bytes=block)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, x in want.items() if not x[4]}
    assert decontaminate.judged(df.limit(0), bench).count() == 0
    assert decontaminate.judged(df, bench.limit(0)).where("contaminated").count() == 0


def test_winnowing_keeps_every_shared_span():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        h = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        got = set(decontaminate.winnow(h, 6).tolist())
        want = {k + 5 - int(np.argmin(h[k : k + 6][::-1])) for k in range(len(h) - 5)} if len(h) >= 6 else {len(h) - 1 - int(np.argmin(h[::-1]))}
        assert got == want


def test_targets_and_flow():
    assert mixing.targets({"a": 100, "b": 100, None: 10}, {"a": 1, "b": 2, None: 3}) == {"a": 60, "b": 120, None: 30}
    assert mixing.targets({}, {}) == {}
    flows = mixing.min_cost_flow([(("a",), 10), (("b",), 10), (("a", "b"), 10)], {"a": 15, "b": 15})
    assert sum(sum(f.values()) for f in flows) == 30 and all(sum(f.values()) == 10 for f in flows)
    flows = mixing.min_cost_flow([(("a",), 10)], {"a": 100})
    assert flows == [{"a": 30}]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "b"), (902, "x y", "c"), (902, "x y", "c")]
    out = mixing.by_source(docs(spark, rows)).collect()
    again = mixing.by_source(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again) and len(out) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = mixing.targets(dict(sorted(size.items(), key=lambda x: (x[0] is None, x[0] or ""))), {"a": 1, "b": 2, "c": 3, None: 1})
    took = {}
    for r in out:
        s = r.members[0]
        took[s] = took.get(s, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(took[s] - want[s]) <= 1 for s in size)
    assert mixing.by_source(docs(spark, rows).limit(0)).count() == 0

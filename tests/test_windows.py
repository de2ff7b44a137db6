"""Kernels over the letters of a batch, against plain Python; and that only windows with a probe's hash become rows."""

import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences, windows
from spanloom.operators import cover, tiling

KINDS = [(["ACGT" * 5 + "NN" + "ACGTT" * 4, "", "ACG", "NNNNACGTACGTANNA" * 3, "N" * 20, "ACGTNACGTNNNNNNACGTA"]), (["AÄC\U0001d11eGNN" * 9, "ACGT" * 7, "", "äN"])]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "seq"])


def rows(run, texts):
    return [tuple(r.values()) for b in run(iter([batch(texts)])) for r in b.to_pylist()]


def tiles(text, window, stride, n_run):
    n, out = len(text), []
    if n >= window:
        out += [(0, p) for p in range(0, n - window + 1, stride)] + ([(1, n - window)] if n % stride else [])
        for r in re.finditer(f"N{{{n_run},}}", text):
            out += [(2, r.start() - window)] * (r.start() >= window) + [(2, r.end())] * (r.end() + window <= n)
    return [(k, p, text[p : p + window]) for k, p in out if "N" * n_run not in text[p : p + window]]


@pytest.mark.parametrize("span", [3, 16, 1 << 18])
@pytest.mark.parametrize("texts", KINDS)
def test_kernels(monkeypatch, span, texts):
    monkeypatch.setattr(windows, "SPAN", span)
    monkeypatch.setattr(windows, "COUNT_SPAN", span)
    for window, stride, n_run in ((8, 3, 2), (8, 4, 3), (5, 7, 1)):
        got = rows(windows.tiling(["id"], window, stride, n_run, None, window - 1, True), texts)
        assert sorted(got) == sorted((i, *t) for i, text in enumerate(texts) for t in tiles(text, window, stride, n_run))
    for k in (1, 3, 6, 11):
        counts = Counter()
        for word, n in rows(windows.counting(k), texts):
            counts[word] += n
        assert counts == Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    blocks = [(6, 0, 3), (6, 3, 3)]
    every = {(i, b, p, t[p : p + 6]) for i, t in enumerate(texts) for b in range(2) for p in range(len(t) - 5)}
    assert set(rows(windows.windowing(["id"], blocks, None), texts)) == every
    pick = [w for *_, w in sorted(every)][::4]
    wanted = [windows.Wanted(windows.np.array([windows.hash_of(w[a : a + k]) for w in pick], "uint64")) for _, a, k in blocks]
    assert set(rows(windows.windowing(["id"], blocks, wanted), texts)) == {x for x in every if x[3][3 * x[1] : 3 * x[1] + 3] in {w[3 * x[1] : 3 * x[1] + 3] for w in pick}}


def test_short_and_null():
    with pytest.raises(ValueError, match="shorter"):
        rows(windows.tiling(["id"], 8, 3, 2, None, None, True), ["ACG"])
    with pytest.raises(ValueError, match="too short"):
        rows(windows.tiling(["id"], 8, 3, 2, 3, None, True), ["ACNNG"])
    assert rows(windows.tiling(["id"], 8, 3, 2, 3, 2, True), ["AC", None, "ACGT"]) == [(2, 0, 0, "ACGT")]


def test_only_wanted_windows(spark):
    """Before, every window of every sequence became a row of the join."""
    r = random.Random(5)
    texts = ["".join(r.choice("ACGT") for _ in range(3_000)) for _ in range(4)]
    seqs = spark.createDataFrame([(0, i, 0, t) for i, t in enumerate(texts)], "group_id int, genome_id bigint, chr_idx int, seq string")
    probes = spark.createDataFrame([(0, p, texts[p][100 * p : 100 * p + 30]) for p in range(4)], "group_id int, probe_id bigint, seq string")
    index = probes.select(F.lit(0).alias("b"), F.col("seq").alias("kmer"))
    assert cover.windows_of(seqs, [(30, 0, 30)], cover.hashes_of(index)).count() == 4
    assert cover.windows_of(seqs, [(30, 0, 30)]).count() == 4 * 2_971
    for m in (0, 2):
        assert {(x["genome_id"], x["probe_id"], x["start"]) for x in cover.covers_full(probes, seqs, 30, m).collect()} == {(p, p, 100 * p) for p in range(4)}


@pytest.mark.parametrize("span", [2, 1 << 18])
def test_expanding(monkeypatch, span):
    monkeypatch.setattr(windows, "SPAN", span)
    texts = ["ANNC", "ACGT", "", "NäNN", "NNGT", "TTTN"]
    want = [(i, "".join(c)) for i, t in enumerate(texts) for c in itertools.product(*["ATCG" if x == "N" else x for x in t])]
    assert sorted(rows(windows.expanding(["id"]), texts)) == sorted(want)


def test_texts_strands_and_whole_probes(spark):
    texts = ["Ab. cd .. x. ", None, "İstanbul ß. Ä 𝄞. z", "", " ", ". . .  .", " a.\n b"]
    df = spark.createDataFrame(list(enumerate(texts)), "genome_id int, text string")
    plain = dict(df.select("genome_id", F.coalesce(sequences.dna_of_text(F.col("text")), F.lit(""))).collect())
    assert dict(tiling.spelt(df).collect()) == plain
    seqs = spark.createDataFrame([(0, i, 0, t) for i, t in enumerate(["ACGTNNäAC", None, "", "AACAACA"])], "group_id int, genome_id int, chr_idx int, seq string")
    both = {(r["genome_id"], r["rc"]): r["seq"] for r in cover.both_strands(seqs).collect()}
    assert both == {(0, False): "ACGTNNäAC", (0, True): "GTäNNACGT", (1, False): None, (1, True): None, (2, False): "", (2, True): "", (3, False): "AACAACA", (3, True): "TGTTGTT"}
    probes = spark.createDataFrame([(1, "AC"), (2, "AACA"), (3, "GG"), (4, "")], "probe_id int, seq string")
    assert sorted(tuple(r)[1:] for r in cover.covers_whole(probes, seqs).select("group_id", "genome_id", "probe_id", "start", "end").collect()) == [(0, 1, 0, 2), (0, 1, 7, 9), (3, 1, 1, 3), (3, 1, 4, 6), (3, 2, 0, 7)]
    assert cover.covers_whole(probes.limit(0), seqs).count() == 0

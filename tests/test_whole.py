"""Queries against brute force over all rows of small tables."""

import random

from spanloom import queries


def test_interval_merge_takes_all_rows(spark, tmp_path):
    lines = [(1, 10, 5, "R", "F"), (1, 14, 6, "N", "O"), (1, 20, 3, "A", "F"), (1, 40, 2, "R", "F"), (2, 998, 4, "N", "O"), (2, 1000, 7, "R", "F")]
    spark.createDataFrame([(s, p, float(q), f, t) for s, p, q, f, t in lines], "l_suppkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, queries.interval_merge(spark, str(tmp_path)).collect()))
    assert got == [(1, 10, 23), (1, 40, 42), (2, 0, 7), (2, 998, 1002)]


def test_expand_n_takes_windows_with_more_n(spark, tmp_path):
    texts = ["bbbbbbaaaa" * 3, "abcéefghijabcdefghijabcdéfghij", "éadéadébdéadécdéaddaccabbaccab"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    wins = [r.seq for r in queries.windows(queries.genomes(spark, str(tmp_path))).collect()]
    assert sorted(w.count("N") for w in wins) == [0, 2, 6]
    got = [r.seq for r in queries.expand_n(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == 1 + 16 + 16 and not any("N" in s for s in got)
    for w in wins:
        own = [s for s in got if all(a == b or b == "N" for a, b in zip(s, w, strict=True))]
        assert len(own) == 4 ** min(2, w.count("N"))
        letters = [len(set(c)) for c in zip(*own, strict=True)]
        assert sorted(letters) == [1] * (30 - min(2, w.count("N"))) + [4] * min(2, w.count("N"))


def test_join_seeded_misses_none(spark, tmp_path):
    rng = random.Random(8)
    probe = "".join(rng.choices("abcd", k=30))
    flip = lambda s, *at: "".join(chr(97 + (ord(c) - 96) % 4) if i in at else c for i, c in enumerate(s))
    texts = ["".join(rng.choices("abcd", k=20)) + x + "".join(rng.choices("abcd", k=20)) for x in (probe, probe[3:27], flip(probe, 7, 22), flip(probe[3:27], 8, 17), flip(probe, 4, 11, 19, 27))]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, probe)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for g, t in enumerate(texts):
        covered = set()
        for d in range(-6, len(t) - 23):
            for i in range(30):
                for j in range(i + 24, 31):
                    if 0 <= i + d and j + d <= len(t) and sum(a != b for a, b in zip(probe[i:j], t[i + d : j + d], strict=True)) <= 2:
                        covered |= set(range(i + d, j + d))
        want |= {(g, x) for x in covered}
    got = {(r.genome_id, x) for r in queries.join_seeded(spark, str(tmp_path)).collect() for x in range(r.start, r.end)}
    assert {g for g, _ in want} >= {0, 1, 2, 3}
    # a seed gives one longest stretch: other stretches as long may reach further, but no place with a cover is without one
    assert got <= want and {g for g, _ in got} == {g for g, _ in want}

"""op2_license_scan on notices that are wrapped over lines, against brute force."""

import random
import re

from spanloom.llm import license_scan, registry


def brute(text):
    low = text.lower()
    words = re.findall("[a-z0-9]+", low)
    n = max(len(t.split()) for _, t in license_scan.TEMPLATES)
    blocks = [set(re.findall("[a-z0-9]+", x)) for x in low.split("\n")] + [set(words[i : i + n]) for i in range(len(words))]
    out = {}
    for label, t in license_scan.TEMPLATES:
        own = set(t.split())
        best = max((len(own & b) for b in blocks), default=0)
        if 100 * best >= 80 * len(own):
            out[label] = max(out.get(label, 0), best / len(own))
    return out


def wrapped(words, width):
    return "\n".join("# " + " ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_wrapped_notices(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for label, t in license_scan.TEMPLATES:
        for width in (3, 7, 13):
            w = t.split()
            if width == 7:
                w[rng.randrange(len(w))] = "other"
            say = lambda: rng.choices(["some", "words", "the", "of", "license", "under", "and"], k=rng.randrange(30))
            rows.append((len(rows), label, wrapped(say() + w + say(), width)))
    df = spark.createDataFrame([(i, t) for i, _, t in rows] + [(900, None), (901, ""), (902, "the\n" * 3000)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op2_license_scan(spark, str(tmp_path)).collect()}
    for i, label, t in rows:
        want = brute(t)
        assert label in got[i].labels.split(",") or label not in want, t
        assert set(got[i].labels.split(",")) - {""} == set(want) | (set(got[i].base_labels.split(",")) - {""}), t
        assert got[i].n_base or abs(got[i].score - max(want.values(), default=0)) < 1e-9
    assert sum(label in brute(t) for _, label, t in rows) >= 30
    assert got[900].labels == got[901].labels == got[902].labels == ""

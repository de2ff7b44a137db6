"""License notices by phrases and by an exact set-similarity join, in DataFrame operations only.

Phrases: places where a phrase's words stand consecutively in the text.

Join: a text block is a line or, with ``wrapped``, also any run of as many words as the longest template
has, over line ends: a notice may be wrapped. Runs matter only from a template word on, and only in texts that
hold enough of some template's words at all, so no others are made. A block meets a template if it holds at least NUM/DEN of the template's
distinct words. Template words are ordered by how many blocks have them, rarest first. A block that
meets a template of m words with need n has one of the first m - n + 1 of these (prefix filter), has at
least n template words at all (length filter), and behind the first common word both orders must
have enough left (positional filter); what passes is counted exactly. Only template words of a block are
kept, as a table in the shared folder; templates are a fixed list, so the broadcast side of the join
is bounded by their words.

Defined results: a null text has no words; empty lines are no blocks; of equal lines each counts as a
block; first_word and last_word are null without a phrase; label strings are empty without labels;
repeated rows are each answered; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text, and the same before A-Z are lower-cased; told by what they
#: hold, as the matcher is several times slower over what they don't hold.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
ANY_CASE = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
#: The one other letter whose lower case is ASCII, and one that stands for it.
KELVIN, OTHER = "\u212a", "\u00e5"
NUM, DEN = 80, 100
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Wordings of license notices, in words.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission"),
)


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def matchable(text: Column) -> Column:
    """The text with letters lower-cased, which finds the same ASCII words as A-Z lower-cased, and is faster."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER)))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the phrase among the words."""
    parts = phrase.split()
    n = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == p)
        return found

    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), here)).otherwise(F.array().cast("array<int>"))


def needed(words: int, num: int, den: int) -> int:
    """How many of a template's distinct words a block must have."""
    return -(-num * words // den)


def blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: Sequence[str], least: int) -> DataFrame:
    """(doc_id, row, words): the distinct template words of each line that has ``least`` of them; row is the hash of the text."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.explode(F.split(matchable(F.col(text_col)), "\n")).alias("line"))
    words = F.array_distinct(F.filter(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), lambda w: w.isin(list(vocabulary))))
    return lines.select("doc_id", "row", words.alias("words")).where(F.size("words") >= least)


def runs(docs: DataFrame, id_col: str, text_col: str, templates: Sequence[tuple[str, str]], num: int, den: int) -> DataFrame:
    """(doc_id, row, words): the distinct template words of each run of words as long as the longest template, if any template needs no more."""
    own = [sorted(set(t.split())) for _, t in templates]
    vocabulary = sorted({w for o in own for w in o})
    least = min(needed(len(o), num, den) for o in own)
    length = max(len(t.split()) for _, t in templates)
    at = F.transform(F.regexp_extract_all(matchable(F.col(text_col)), F.lit(WORD), F.lit(0)), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.filter(at, lambda x: x["w"].isin(vocabulary)).alias("at"))
    rows = rows.where(F.size("at") >= least).withColumn("held", F.array_distinct(F.transform("at", lambda x: x["w"])))
    enough = F.lit(False)
    for o in own:
        enough = enough | (F.size(F.array_intersect("held", strings(o))) >= needed(len(o), num, den))
    rows = rows.where(enough)
    run = lambda x, q: F.array_sort(F.array_distinct(F.transform(F.filter(F.slice("at", q + 1, length), lambda y: y["i"] < x["i"] + length), lambda y: y["w"])))
    every = F.array_distinct(F.filter(F.transform("at", run), lambda w: F.size(w) >= least))
    return rows.select("doc_id", "row", F.explode(every).alias("words"))


def similar(blocks_: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, row, label, score) of every block and template that meet; score is the share of the template's words."""
    spark = blocks_.sparkSession
    counts = {r.w: r.n for r in blocks_.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # template words alone
    rank = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w)))}
    prefix, whole = [], []
    for k, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(len(own), num, den)
        whole.append((k, label, own))
        prefix += [(w, k, p, len(own), need) for p, w in enumerate(own[: len(own) - need + 1])]
    rows = ", ".join(f"('{w}', {k}, {p}, {m}, {need})" for w, k, p, m, need in prefix)
    probe = spark.sql(f"SELECT * FROM VALUES {rows} AS t(probe, template, p, m, need)")
    rows = ", ".join(f"({k}, '{label}', array({', '.join(repr(w) for w in own)}))" for k, label, own in whole)
    sets = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, own)")
    order = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    probes = strings(sorted({x[0] for x in prefix}))
    b = blocks_.where(F.arrays_overlap("words", probes)).withColumn("sorted", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(order, w).alias("i"), w.alias("w")))), lambda x: x["w"]))
    hit = b.withColumn("at", F.explode(F.filter(F.transform("sorted", lambda w, q: F.struct(w.alias("w"), q.alias("q"))), lambda x: F.array_contains(probes, x["w"]))))
    hit = hit.join(F.broadcast(probe), F.col("at.w") == F.col("probe")).where(F.size("words") >= F.col("need"))
    # the first common word of a pair is the one for which no earlier template word is in the block; others fail here or repeat it
    hit = hit.where("need <= 1 + least(m - p - 1, size(words) - at.q - 1)")
    hit = hit.join(F.broadcast(sets), "template")
    both = F.size(F.array_intersect("words", "own"))
    return hit.withColumn("both", both).where(f"{den} * both >= {num} * m").select("doc_id", "row", "label", (F.col("both") / F.col("m")).alias("score"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, num: int = NUM, den: int = DEN, wrapped: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    least = min(needed(len(set(t.split())), num, den) for _, t in templates)
    table = blocks(docs, id_col, text_col, vocabulary, least)
    table = written(table.unionByName(runs(docs, id_col, text_col, templates, num, den)) if wrapped else table, "license-blocks")
    found = similar(table, templates, num, den).groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    found = written(found, "license-found")
    discard(table)
    # words in an array only where a phrase's last word is
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = F.lit(False)
    for w in sorted({p.split()[-1] for p, _ in phrases}):
        last = last | F.contains(F.lower(text), F.lit(w))
    words = F.when(last, F.regexp_extract_all(lower(text), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.regexp_count(text, F.lit(ANY_CASE)).cast("bigint").alias("n_words"), words.alias("words"))
    places = F.array(*[F.struct(F.lit(label).alias("label"), phrase_places(F.col("words"), p).alias("at")) for p, label in phrases])
    rows = rows.select("doc_id", "row", "n_words", places.alias("places"))
    at = F.flatten(F.transform("places", lambda x: x["at"]))
    base = F.array_distinct(F.transform(F.filter("places", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]))
    rows = rows.select("doc_id", "row", "n_words", at.alias("at"), base.alias("base"))
    out = rows.join(found.select(F.col("doc_id").alias("d_"), F.col("row").alias("r_"), "more", "score"), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("row") == F.col("r_")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", F.size("at").cast("bigint").alias("n_base"), F.array_min("at").cast("bigint").alias("first_word"), F.array_max("at").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def oracle(phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, num: int = NUM, den: int = DEN) -> str:
    """DuckDB SQL with the rows of ``scan``: every line against every template, without filters."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    ph = ", ".join(f"({p.split()!r}, '{label}')" for p, label in phrases)
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in templates)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{word}') AS words FROM d),
p(parts, label) AS (VALUES {ph}),
hit AS (
  SELECT r, label, i - 1 AS pos FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE list_contains(words, 'license')), p
  WHERE words[i : i + len(parts) - 1] = parts
),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS labels FROM hit GROUP BY r),
t(label, own) AS (VALUES {rows}),
line AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{word}')) AS words FROM d),
met AS (SELECT r, label, len(list_intersect(words, own)) / len(own) AS s FROM line, t WHERE {den} * len(list_intersect(words, own)) >= {num} * len(own)),
more AS (SELECT r, list(DISTINCT label) AS labels, max(s) AS s FROM met GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""

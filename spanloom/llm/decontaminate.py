"""Benchmark decontamination by winnowing.

Each benchmark item is cut into windows: GUARANTEE consecutive words, or the whole item
if it has fewer. Winnowing keeps, of every w consecutive k-gram hashes, the smallest (the
rightmost on ties); with k + w - 1 = GUARANTEE every shared span of at least GUARANTEE words
has a kept k-gram in common, because both sides choose from the same hashes. Fingerprints of
documents are joined with those of the benchmark and every hit is extended word by word to the
whole shared span. Items below the guarantee are joined on the hash of all their words.

The benchmark side is read in blocks of at most BLOCK_ITEM_BYTES of text; each block is
broadcast and held against all documents, so what is broadcast is bounded at any size of the
benchmark. Documents are never shuffled: a block's hits are tiny and are merged by row.

Defined results: null and empty texts have no words and are not contaminated; repeated rows
are each judged; a repeated item_id counts once; items with a null id have the id "" in lists;
an empty benchmark hits nothing. All other columns of documents are carried unchanged by
``decontaminate``; only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, ngram_hashes, slices, small_batches, text_words, texts_of

GUARANTEE = 10
K = 5
#: Benchmark text in one broadcast block.
BLOCK_ITEM_BYTES = 16_000_000
SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: the rightmost smallest of every w consecutive hashes (of all, if fewer)."""
    n = len(grams)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))])
    ends = np.arange(w - 1, n)
    least, at = grams[w - 1 :].copy(), ends.copy()
    for back in range(1, w):
        other = grams[w - 1 - back : n - back]
        less = other < least
        least[less] = other[less]
        at[less] = ends[less] - back
    return np.unique(at)


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], k: int, guarantee: int) -> None:
        self.k, self.w, self.guarantee = k, guarantee - k + 1, guarantee
        self.ids = [i for i, _ in items]
        self.words = [text_words(t, ALNUM) for _, t in items]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, words in enumerate(self.words):
            if len(words) >= guarantee:
                grams = ngram_hashes(words, k)
                for p in winnow(grams, self.w):
                    places[int(grams[p])].append((j, int(p)))
            elif len(words):
                short[len(words)][int(ngram_hashes(words, len(words))[0])].append(j)
        self.places, self.short = dict(places), {n: dict(x) for n, x in short.items()}
        self.keys = np.array(sorted(self.places), dtype=np.uint64)
        self.short_keys = {n: np.array(sorted(x), dtype=np.uint64) for n, x in self.short.items()}

    @staticmethod
    def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(h):
            return np.empty(0, dtype=np.int64)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.flatnonzero(keys[at] == h)

    def search(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) spans of words inside a window's occurrence, and the items that occur."""
        spans, items = set(), set()
        grams = ngram_hashes(words, self.k)
        kept = winnow(grams, self.w)
        done: dict[tuple[int, int], int] = {}  # item and diagonal: end of the last span there
        for i in kept[self._among(grams[kept], self.keys)]:
            i = int(i)
            for j, p in self.places[int(grams[i])]:
                if i < done.get((j, i - p), -1):
                    continue
                item = self.words[j]
                back = min(i, p)
                a = np.flatnonzero(words[i - back : i][::-1] != item[p - back : p][::-1])
                s = i - (int(a[0]) if len(a) else back)
                ahead = min(len(words) - i, len(item) - p)
                a = np.flatnonzero(words[i : i + ahead] != item[p : p + ahead])
                e = i + (int(a[0]) if len(a) else ahead)
                done[j, i - p] = max(e, i + 1)
                if e - s >= self.guarantee:
                    spans.add((s, e))
                    items.add(j)
        for n, keys in self.short_keys.items():
            h = ngram_hashes(words, n)
            for i in self._among(h, keys):
                spans.add((int(i), int(i) + n))
                items.update(self.short[n][int(h[i])])
        merged: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


_built: dict[int, Index] = {}


def _index(number: int, block) -> Index:
    """The index of a broadcast block, built once in each Python worker."""
    if number not in _built:
        _built.clear()
        _built[number] = Index(*block.value)
    return _built[number]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str]]]:
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).where(F.col(text_col).isNotNull())
    for i, text in rows.toLocalIterator():
        block.append((i, text))
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, guarantee: int = GUARANTEE, block_bytes: int = BLOCK_ITEM_BYTES) -> DataFrame:
    """docs with the struct HIT added as ``hit_``; rows keep all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs
    names = []
    for b, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        name = f"hit_{b}"
        names.append(name)
        out = _search_block(out, spark.sparkContext.broadcast((block, k, guarantee)), text_col, name)
    merged = names[0]
    if len(names) == 1:
        return out.withColumnRenamed(merged, "hit_")
    hit = F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        F.flatten(F.array(*[F.col(n)["hits"] for n in names])).alias("hits"),
        F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names]))).alias("items"),
    )
    return out.withColumn("hit_", hit).drop(*names)


def _search_block(docs: DataFrame, block, text_col: str, name: str) -> DataFrame:
    schema = docs.schema
    at = schema.names.index(text_col)
    number = uuid.uuid4().int
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(number, block)
        for b in slices(batches):
            found = []
            for words in texts_of(b.column(at), ALNUM):
                spans, hit = index.search(words)
                found.append({"n_words": len(words), "hits": [{"s": s, "e": e} for s, e in spans], "items": sorted({index.ids[j] for j in hit})})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, type=kind)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, HIT)]))


def _covered(spans: str) -> str:
    """SQL: words in the union of the spans of ``hit_`` (each block's spans are merged, blocks may overlap)."""
    return (
        f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0), "
        "(a, x) -> named_struct('n', a.n + cast(greatest(x.e - greatest(x.s, a.to), 0) as bigint), 'to', greatest(a.to, x.e)), a -> a.n)"
    )


def judged(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    hits = find_hits(slim, benchmark, text_col=text_col, **how)
    return hits.select(
        id_col,
        F.col("hit_.n_words").alias("n_words"),
        F.expr(_covered("hit_.hits")).alias("n_hit"),
        F.size("hit_.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_.items"), ","), 256).alias("items_sha256"),
        (F.size("hit_.hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns."""
    renamed = docs.select([F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(docs.columns)])
    hits = find_hits(renamed, benchmark, text_col=f"c{docs.columns.index(text_col)}_", **how)
    return hits.where(F.size("hit_.hits") == 0).select([F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)])


def oracle(guarantee: int = GUARANTEE) -> str:
    """DuckDB SQL with the rows of ``judged``: every window of items against every window of documents."""
    low = lambda t: f"translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda t: rf"regexp_extract_all({low(t)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {words("text")} AS w FROM benchmark),
n AS (SELECT id, w, least({guarantee}, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM n)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, p, dw.k, id FROM dw JOIN win ON win.k = dw.k AND win.g = dw.g),
covered AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + k)) AS x FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS s FROM (SELECT DISTINCT r, id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, coalesce(found.s, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

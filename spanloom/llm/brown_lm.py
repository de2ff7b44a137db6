"""Brown class-based bigrams: exchange clustering, and smoothed perplexity from class transitions and word emissions.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end for each text, which is a class of its
own and also stands before the first word. The model is P(w | v) = P(class w | class v) * P(w | class w).

Counts. Every training text is counted. Words that occur at least twice are clustered, whatever the corpus. At most HELD
of these, the most frequent ones, are held by all tasks (broadcast, 13 bytes each); the others are joined words:
their classes are a table, and so is what stands beside them. Words that occur once form one class, the
rare one, which also stands for words that were never seen. Joined and rare words keep counts of their own, in a table
that is joined and never gathered.

Exchange clustering. The SEEDS most frequent words are first clustered by the exchange algorithm, one word
at a time, on their bigram counts: each moves to the class that raises the likelihood of the class
bigrams most. From there on all words that occur twice take part, in distributed exchange sweeps over the whole
corpus: in each sweep every word moves to the class that gains most likelihood from the classes of all its
neighbours, with the class bigrams as they were before the sweep; then these are counted anew. Joined words
take part by a table of their neighbours, joined with the classes in each sweep; it tells the same counts as the texts, so
how many words are held doesn't change the model. Sweeps
end when the likelihood of the class bigrams rises by less than RISE of itself.

Smoothing. Transitions back off to class frequencies (Dirichlet weight ALPHA); emissions add ADD, in the
rare class also for one unseen word. Probabilities of a text's continuations thus sum to 1, as do the
base's.

Scores. A text's held words and the transitions between them are added up where it is read. Its other words, with
the classes beside them, are joined with counts and classes and added by text.

Words are told apart by 64-bit hashes. Defined results: a null text counts as empty (one end); with no
training texts every probability is that of an empty model (uniform over the unseen word); repeated
rows are each scored, and each counted in training; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, small_batches, words_of, written

CLASSES = 32
#: Words that are held by all tasks, at most.
HELD = 4_000_000
#: Counts from here on are not told apart when the least count of held words is looked for.
COUNTED = 1 << 16
SEEDS = 1_600
SEED_SWEEPS = 6
#: Sweeps go on while they raise the likelihood by this share of itself; SWEEPS is a bound that isn't met in practice (5 sweeps on 24,000,000 tokens).
RISE = 0.0003
SWEEPS = 30
ADD = 0.1
ALPHA = 20.0
#: Hash of the end.
END = 1
#: Tokens, and neighbours of words, that a map task counts before it passes them on.
COUNT_TOKENS, NEAR_TOKENS = 2_000_000, 4_000_000
#: Held words whose neighbours one reducer row holds.
BUCKET_WORDS = 8_192


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 10 (of the empty text for a null id)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, starts of the texts and the end) of consecutive texts, each with its end."""
    for at, words in words_of(column, SPACE):
        n = len(words.ends) - 1
        stops = words.ends[1:] + np.arange(n)  # places of the ends
        out = np.empty(len(words.hashes) + n, dtype=np.uint64)
        rest = np.ones(len(out), dtype=bool)
        rest[stops] = False
        out[stops], out[rest] = np.uint64(END), words.hashes
        yield at, out, np.r_[0, stops + 1]


def _counts(train: DataFrame) -> DataFrame:
    """(h, n): every word's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for _, t, _ in tokens(b.column(0)):
                held.append(t)
                size += len(t)
                if size >= COUNT_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return train.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class Lookup:
    """Sorted hashes to their places; -1 for others. A table over the leading bits says where to look first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(16, len(keys).bit_length()))
        self.starts = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        n = len(self.keys)
        if not n or not len(h):
            return out
        at = self.starts[h >> self.shift].astype(np.int64)
        rows = np.flatnonzero(at < n)
        at, h = at[rows], h[rows]
        while len(rows):
            k = self.keys[at]
            hit = k == h
            out[rows[hit]] = at[hit]
            on = (k < h) & (at + 1 < n)
            rows, at, h = rows[on], at[on] + 1, h[on]
        return out


_found: dict[str, Lookup] = {}


def _lookup(name: str, keys: np.ndarray) -> Lookup:
    """The lookup of such keys, made once in each Python worker."""
    if name not in _found:
        _found.clear()
        _found[name] = Lookup(keys)
    return _found[name]


def _name(keys: np.ndarray) -> str:
    return f"{len(keys)}-{xxhash.xxh3_64_hexdigest(keys.tobytes())}"


def _bigrams(train: DataFrame, keys: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Bigram counts of groups: of the keys by ``group``, of all other words k - 1."""
    held, name = train.sparkSession.sparkContext.broadcast((keys, np.append(group, k - 1).astype(np.int32))), _name(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, of = _lookup(name, held.value[0]), held.value[1]
        total = np.zeros(k * k, dtype=np.int64)
        end = int(of[find(np.array([END], dtype=np.uint64))[0]])
        for b in batches:
            for _, t, _ in tokens(b.column(0)):
                s = of[find(t)]
                before = np.append(end, s[:-1])  # a text follows an end
                total += np.bincount(before.astype(np.int64) * k + s, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = train.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    out = np.zeros(k * k)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _likelihood(pair: np.ndarray) -> float:
    """What of the likelihood of class bigrams depends on the classes."""
    return float(_xlogx(pair).sum() - _xlogx(pair.sum(axis=0)).sum() - _xlogx(pair.sum(axis=1)).sum())


def exchange(bigrams: np.ndarray, classes: int, fixed: np.ndarray, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """Class of each word by exchange clustering; words of ``fixed`` keep classes of their own behind the others.

    The likelihood of class bigrams is the sum of n log n over pairs of classes less twice that over classes.
    """
    v = len(bigrams)
    free = np.flatnonzero(~fixed)
    totals = bigrams.sum(axis=0)
    cls = np.empty(v, dtype=np.int64)
    cls[free[np.argsort(-totals[free], kind="stable")]] = np.arange(len(free)) % classes
    cls[fixed] = classes + np.arange(int(fixed.sum()))
    c = classes + int(fixed.sum())
    one = np.eye(c)[cls]
    pair = one.T @ bigrams @ one
    right, left = bigrams @ one, bigrams.T @ one  # by word: classes after it and before it
    own = np.diag(bigrams)
    for _ in range(sweeps):
        moved = 0
        for w in free[np.argsort(-totals[free], kind="stable")]:
            a, r, l, s = cls[w], right[w].copy(), left[w].copy(), own[w]
            r[a] -= s
            l[a] -= s
            # without the word
            pair[a] -= r
            pair[:, a] -= l
            pair[a, a] -= s
            rows, cols = pair.sum(axis=1), pair.sum(axis=0)
            # gains of adding it to each class: its row, its column, the crossing cell, and the class totals
            new_row, new_col = pair + r[None, :], pair + l[:, None]
            gain = (_xlogx(new_row) - _xlogx(pair)).sum(axis=1) + (_xlogx(new_col) - _xlogx(pair)).sum(axis=0)
            d = np.diag(pair)
            gain += _xlogx(d + r + l + s) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
            gain -= _xlogx(rows + r.sum() + s) - _xlogx(rows) + _xlogx(cols + l.sum() + s) - _xlogx(cols)
            gain[classes:] = -np.inf
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b] += r
            pair[:, b] += l
            pair[b, b] += s
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return cls


def _gains(pair: np.ndarray, classes: int) -> np.ndarray:
    """What a word gains in each class from a neighbour: rows are classes before it, then classes behind it."""
    smooth = pair + 0.5
    rows, cols = smooth.sum(axis=1), smooth.sum(axis=0)
    # a neighbour l before the word gains log P(l | class), a neighbour r behind it log P(r | class)
    return np.concatenate([np.log(smooth / cols[None, :])[:, :classes], np.log(smooth / rows[:, None]).T[:, :classes]])


def _least_held(counts: DataFrame, size: int, held: int) -> int:
    """The least count of held words: at least 2, and so that they, with the end, are no more than ``held``."""
    by = counts.where("n > 1").groupBy(F.least("n", F.lit(COUNTED)).alias("n")).count().toArrow()  # at most COUNTED rows
    n, words = (by.column(k).to_numpy() for k in range(2))
    order = np.argsort(-n)
    few = n[order][np.cumsum(words[order]) < held]
    return int(min([max(2, -(-size // held)), *few]))


def _edges(train: DataFrame, keys: np.ndarray) -> DataFrame:
    """(w, side, i, x) for each token w that isn't one of the keys: what stands before it (side 0) and behind it (side 1), a key by its place i, else (i = -1) the word x."""
    held, name = train.sparkSession.sparkContext.broadcast(keys), _name(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _lookup(name, held.value)
        for b in batches:
            for _, t, _ in tokens(b.column(0)):
                s = find(t)
                at = np.flatnonzero(s < 0)  # the end is a key, so something stands behind
                for side, near in enumerate((np.append(np.uint64(END), t[:-1])[at], t[at + 1] if len(at) else t[:0])):
                    i = find(near)
                    yield pa.RecordBatch.from_arrays([pa.array(t[at].view(np.int64)), pa.array(np.full(len(at), side, np.int8)), pa.array(i.astype(np.int32)), pa.array(near.view(np.int64))], names=["w", "side", "i", "x"])

    return train.mapInArrow(run, "w bigint, side tinyint, i int, x bigint")


def _known(edges: DataFrame, joined: DataFrame, rare: int) -> DataFrame:
    """(w, side, i, cls, k, own) of edges: class of w, class k of a word x (rare if it occurs once), and whether x is a joined word."""
    words = edges.where("i < 0").join(joined.select(F.col("h").alias("x"), F.col("cls").alias("k")), "x", "left")
    words = words.select("w", "side", "i", F.coalesce("k", F.lit(rare)).alias("k"), F.col("k").isNotNull().alias("own"))
    both = edges.where("i >= 0").select("w", "side", "i", F.lit(rare).alias("k"), F.lit(False).alias("own")).unionByName(words)
    return both.join(joined.select(F.col("h").alias("w"), "cls"), "w").select("w", "side", "i", "cls", "k", "own")


def _moved_bigrams(known: DataFrame, cls: np.ndarray, c: int) -> np.ndarray:
    """What the classes of joined words change in bigram counts that have all of these as rare, the last class."""
    held = known.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, total = held.value, np.zeros(c * c, dtype=np.int64)
        for b in batches:
            side, i, k, x, own = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("side", "i", "cls", "k", "own"))
            once = (side == 0) | ~own  # of two joined words both tell of the bigram
            side, i, k, x, own = side[once], i[once], k[once].astype(np.int64), x[once].astype(np.int64), own[once]
            x[i >= 0] = by[i[i >= 0]]
            was = np.where(own, c - 1, x)
            total += np.bincount(np.where(side == 0, x * c + k, k * c + x), minlength=c * c)
            total -= np.bincount(np.where(side == 0, was * c + c - 1, (c - 1) * c + was), minlength=c * c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = known.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    out = np.zeros(c * c)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(c, c)


def _swept_joined(known: DataFrame, joined: DataFrame, cls: np.ndarray, pair: np.ndarray, classes: int) -> DataFrame:
    """Joined words (h, n, cls) with their new classes. A word has few neighbours, as it isn't held."""
    c = len(pair)
    held = known.sparkSession.sparkContext.broadcast((cls, _gains(pair, classes)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = held.value[0]
        for b in batches:
            side, i, k = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("side", "i", "k"))
            k = k.astype(np.int32)
            k[i >= 0] = by[i[i >= 0]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((k + side.astype(np.int32) * c).astype(np.int32))], names=["h", "cell"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                some = b.column(1)
                value = np.add.reduceat(held.value[1][some.flatten().to_numpy()], some.offsets.to_numpy()[:-1] - some.offsets[0].as_py(), axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.argmax(value, axis=1).astype(np.int32))], names=["h", "new"])

    # in order, so that equal neighbours add up to equal sums
    near = known.mapInArrow(cells, "h bigint, cell int").groupBy("h").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return joined.join(near.mapInArrow(best, "h bigint, new int"), "h").select("h", "n", F.col("new").alias("cls"))


def _swept(train: DataFrame, keys: np.ndarray, cls: np.ndarray, pair: np.ndarray, classes: int, known: DataFrame | None = None) -> np.ndarray:
    """New classes of the keys: each word goes where it gains most from the classes of its neighbours; the end stays.

    Map tasks count neighbours' classes by word and deal them out by ranges of words; a reducer row holds a
    range's counts as one dense table, so its memory is the same for any corpus. Neighbours that are joined words are counted as rare
    in the texts, and moved to their classes by ``known``.
    """
    c = len(pair)
    held = train.sparkSession.sparkContext.broadcast((keys, np.append(cls, c - 1).astype(np.uint8), _gains(pair, classes)))
    n, width, name = len(keys), 2 * c, _name(keys)
    buckets = -(-n // BUCKET_WORDS)

    def dealt(cell: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        cuts = np.searchsorted(cell, np.arange(buckets + 1, dtype=np.int64) * (BUCKET_WORDS * width))
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        data = [(cell[cuts[k] : cuts[k + 1]] - int(k) * BUCKET_WORDS * width).astype(np.int32).tobytes() + times[cuts[k] : cuts[k + 1]].astype(np.int32).tobytes() for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, by = _lookup(name, held.value[0]), held.value[1]
        end = int(by[find(np.array([END], dtype=np.uint64))[0]])
        cells: list[np.ndarray] = []
        size = 0
        for b in batches:
            for _, t, _ in tokens(b.column(0)):
                s = find(t)
                k = by[s].astype(np.int64)
                here = np.flatnonzero(s >= 0)
                at = s[here] * width
                cells.append(at + np.append(end, k[:-1])[here])
                cells.append(at + c + np.append(k[1:], end)[here])
                size += 2 * len(here)
                if size >= NEAR_TOKENS:
                    yield dealt(*np.unique(np.concatenate(cells), return_counts=True))
                    cells, size = [], 0
        if size:
            yield dealt(*np.unique(np.concatenate(cells), return_counts=True))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, side, k = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("i", "side", "cls"))
            # what stands before a joined word has that behind it
            at = i.astype(np.int64) * width + np.where(side == 0, c, 0)
            cell, of = np.unique(np.concatenate([at + k, at + c - 1]), return_inverse=True)
            if len(cell):
                yield dealt(cell, np.bincount(of, weights=np.repeat([1, -1], len(at))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value[2]
        last, table = None, np.zeros(BUCKET_WORDS * width)

        def out() -> pa.RecordBatch:
            value = table.reshape(BUCKET_WORDS, width) @ gain
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.argmax(value, axis=1).astype(np.uint8).tobytes()], pa.binary())], names=["bucket", "cls"])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != last:
                    if last is not None:
                        yield out()
                    last, table = k, np.zeros(BUCKET_WORDS * width)
                m = len(data) // 8
                table[np.frombuffer(data, np.int32, m)] += np.frombuffer(data, np.int32, m, 4 * m)
        if last is not None:
            yield out()

    rows_ = train.mapInArrow(gather, "bucket int, data binary")
    if known is not None:
        rows_ = rows_.unionByName(known.where("i >= 0").select("i", "side", "cls").mapInArrow(move, "bucket int, data binary"))
    rows_ = rows_.repartition(min(buckets, 256), "bucket").sortWithinPartitions("bucket")
    new = cls.copy()
    for r in rows_.mapInArrow(best, "bucket int, cls binary").collect():  # a byte for each held word
        part = np.frombuffer(r.cls, np.uint8)[: min(BUCKET_WORDS, n - r.bucket * BUCKET_WORDS)]
        new[r.bucket * BUCKET_WORDS : r.bucket * BUCKET_WORDS + len(part)] = part
    held.destroy()
    new[keys == np.uint64(END)] = classes
    return new


@dataclass
class Model:
    """Held words with their counts and classes, sizes, class transitions and emission totals."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    words: int
    transitions: np.ndarray  # log10 P(class | class)
    totals: np.ndarray  # log10 of each class's smoothed tokens
    end: int
    rare: int


def train_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, seeds: int = SEEDS, frequent: int | None = None, held: int = HELD, sweeps: int = SWEEPS) -> tuple[DataFrame, Model]:
    """(h, n, cls) of words that aren't held, and the model. With ``frequent`` only so many words are clustered at most, and all of these are held."""
    if classes > 250:
        raise ValueError("classes are kept in a byte")
    spark = docs.sparkSession
    small_batches(spark)
    train = docs.where(~held_out(docs[id_col])).select(docs[text_col].alias("text"))
    counts = written(_counts(train), "lm-counts")
    words, size = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    end, rare, c = classes, classes + 1, classes + 2
    if not words:
        none = np.empty(0, dtype=np.int64)
        return counts.withColumn("cls", F.lit(rare)), Model(none.view(np.uint64), none, none, 0, 0, np.full((c, c), -np.log10(c)), np.zeros(c), end, rare)
    often = (F.col("n") >= _least_held(counts, size, held if frequent is None else frequent)) | (F.col("h") == END)
    got = counts.where(often).select("h", "n").toArrow()  # at most ``held`` words
    keys, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at_end = int(np.searchsorted(keys, np.uint64(END)))
    top = np.lexsort((keys, -n))
    top = np.sort(top[top != at_end][:seeds])
    # seeds by exchange; the end and all other words have classes of their own
    some = np.sort(np.append(top, at_end))
    fixed = np.r_[some == at_end, True]
    seed = exchange(_bigrams(train, keys[some], np.arange(len(some)), len(some) + 1), classes, fixed)
    cls = np.full(len(keys), rare, dtype=np.uint8)
    cls[some] = seed[:-1]
    rest = counts.where(~often)
    joined = edges = known = None
    if frequent is None and rest.where("n > 1").take(1):
        joined = written(rest.where("n > 1").withColumn("cls", F.lit(rare)), "lm-joined")
        edges = written(_edges(train, keys).join(joined.select(F.col("h").alias("w")), "w", "left_semi"), "lm-edges")
    pair = _bigrams(train, keys, cls, c)
    was = _likelihood(pair)
    for _ in range(sweeps):
        if joined is not None:
            known = written(_known(edges, joined, rare), "lm-known") if known is None else known
            after = written(_swept_joined(known, joined, cls, pair, classes), "lm-joined")
        cls = _swept(train, keys, cls, pair, classes, known)
        pair = _bigrams(train, keys, cls, c)
        if joined is not None:
            discard(known, joined)
            joined = after
            known = written(_known(edges, joined, rare), "lm-known")
            pair += _moved_bigrams(known, cls, c)
        now = _likelihood(pair)
        if now - was <= RISE * abs(was):
            break
        was = now
    class_tokens = np.bincount(cls, weights=n, minlength=c)
    class_words = np.bincount(cls, minlength=c).astype(float)
    some_words = some_tokens = 0
    if joined is not None:
        for k, w, t in joined.groupBy("cls").agg(F.count(F.lit(1)), F.sum("n")).collect():  # a row for each class
            class_words[k] += w
            class_tokens[k] += t
            some_words, some_tokens = some_words + w, some_tokens + t
        rest = rest.join(joined.select("h", "cls"), "h", "left").select("h", "n", F.coalesce("cls", F.lit(rare)).alias("cls"))
        discard(*[x for x in (known, edges) if x is not None])
    else:
        rest = rest.select("h", "n", F.lit(rare).alias("cls"))
    class_tokens[rare] += size - n.sum() - some_tokens
    class_words[rare] += words - len(keys) - some_words + 1  # and the unseen word
    totals = np.log10(np.maximum(class_tokens + ADD * class_words, 1e-300))
    share = (class_tokens + 1e-6) / (class_tokens + 1e-6).sum()
    trans = np.log10((pair + ALPHA * share[None, :]) / (pair.sum(axis=1, keepdims=True) + ALPHA))
    return rest, Model(keys, n, cls, int(size), int(words), trans, totals, end, rare)


def scored(docs: DataFrame, rest: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    m = model
    total = float(np.log10(m.tokens + ADD * (m.words + 1))) if m.words else 0.0
    logs = np.log10(m.counts + ADD)
    held = docs.sparkSession.sparkContext.broadcast((m.keys, np.append(m.classes, m.rare).astype(np.uint8), np.append(logs, 0.0)))
    small, name = (m.transitions, m.totals, m.end), _name(m.keys)
    empty = not m.words
    kind = f"key bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, often bigint, base double, score double, h array<bigint>, before array<int>, behind array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, (_, by, log) = _lookup(name, held.value[0]), held.value
        trans, totals, end = small
        for b in batches:
            for at, t, starts in tokens(b.column(2)):
                d = len(starts) - 1
                s = find(t)
                k = by[s].astype(np.int64)
                if empty:
                    k[t == np.uint64(END)] = end
                here = (s >= 0) | empty
                before = np.append(end, k[:-1])
                there = np.append(True, here[:-1])
                sums = lambda x: np.add.reduceat(x, starts[:-1])
                base = sums(log[s])
                score = base + sums(np.where(here & there, trans[before, k], 0.0) - np.where(here, totals[k], 0.0))
                text = np.repeat(np.arange(d), np.diff(starts))
                low = np.flatnonzero(s < 0)
                cuts = np.searchsorted(text[low], np.arange(d + 1)).astype(np.int32)
                behind = np.append(np.where(here, k, -1), end)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x))
                n = np.diff(starts).astype(np.int64)
                part = b.slice(at, d)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(n - np.diff(cuts)), pa.array(base), pa.array(score), lists(t[low].view(np.int64)), lists(np.where(there, before, -1)[low].astype(np.int32)), lists(behind[low + 1].astype(np.int32))],
                    names=["key", "doc_id", "n_tokens", "often", "base", "score", "h", "before", "behind"],
                )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trans, totals, _ = small
        for b in batches:
            k, before, last, behind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            # between two such words the second tells of the transition
            value = trans[np.where(before >= 0, before, last), k] - totals[k] + np.where(behind >= 0, trans[k, behind], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), b.column(5), b.column(6)], names=["key", "value", "rare", "log"])

    part = written(rows.mapInArrow(run, kind), "lm-scores")
    each = part.select("key", F.posexplode(F.arrays_zip("h", "before", "behind")).alias("at", "x")).select("key", "at", "x.*")
    line = each.join(rest, "h", "left").withColumn("cls", F.coalesce("cls", F.lit(m.rare)))
    line = line.withColumn("last", F.coalesce(F.lag("cls").over(Window.partitionBy("key").orderBy("at")), F.lit(m.rare)))
    line = line.select("key", "cls", "before", "last", "behind", F.col("n").isNotNull().cast("bigint").alias("rare"), F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD)).alias("log"))
    more = line.mapInArrow(opened, "key bigint, value double, rare bigint, log double").groupBy("key").agg(*[F.sum(x).alias(x) for x in ("value", "rare", "log")])
    both = part.drop("h", "before", "behind").join(more, "key", "left").na.fill(0, ["rare"]).na.fill(0.0, ["value", "log"])
    if empty:
        # one unseen word of probability 1 in its class, and a base that is uniform over it
        both = both.withColumns({x: F.lit(0.0) for x in ("value", "log", "base")})
    return both.select(
        F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("often") + F.col("rare")).cast("bigint").alias("n_known"), F.lit(m.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("log") - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("score") + F.col("value") + F.col("log")).alias("score"),
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the base and of the model over all held-out tokens."""
    x = scores.where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n"))
    return x.select(F.pow(F.lit(10.0), -F.col("b") / F.col("n")).alias("base"), F.pow(F.lit(10.0), -F.col("s") / F.col("n")).alias("model"))


def score_all(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Learn from the training texts, score all."""
    rest, model = train_model(docs, id_col=id_col, text_col=text_col, **how)
    return scored(docs, rest, model, id_col=id_col, text_col=text_col)



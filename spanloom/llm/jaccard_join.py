"""Exact n-gram Jaccard self-join by pivots in a metric space.

A document is the set of its word shingles; two documents link when their Jaccard distance is at
most tau = 1 - NUM/DEN. Texts with one and the same set are one point of the space from the start.

1. Rings: the first pivot is the empty set, from which a set is as far as it is large (the metric is
   the symmetric difference). A ring holds sizes [L, 1.5 L); points just below it, within the window of
   the triangle inequality (size >= L * NUM/DEN), are replicated into it, so every linked pair meets in
   the ring of the larger point.
2. A filter inside the rings. The symmetric difference of a linked pair is at most D, the floor of
   (1 - t) / (1 + t) times the sum of the sizes. Shingles are dealt by hash into somewhat more than D
   classes; some class that isn't empty has no difference at all, if one of the two points has shingles in
   more than D classes. So linked points have the hash of some class in common, and points that share none
   with any other are done. A point with shingles in too few classes is dealt again with another seed,
   until it has enough; of a linked pair, both points are dealt with the first seed that is enough for
   either, so they meet. Shingles found in several documents of a sample are common; a first dealing leaves
   them out of all points, so texts that share a passage and little else don't meet. Points with too little
   left are dealt again with all their shingles. The sample decides speed alone.
   Points with one class hash in common are a region to begin with. Equal regions are one.
3. Pivots. Each point is first held against the smallest point of the region that it shares most hashes
   with, which settles near copies. Regions that aren't one component yet and overlap are taken together. In each, about the square
   root of its points become pivots (PIVOTS at most), and all its points are held against them: coordinates
   (counts of shingles in COORDINATES classes, whose L1 distance is at most the symmetric difference)
   exclude most, and sets decide.
4. Voronoi regions. The other points go to the region of their nearest pivot in these coordinates, and are
   replicated into every region whose pivot is within twice their largest possible difference of the
   nearest one, the window of the triangle inequality. Where replication would not make regions smaller, the
   rest stays one region, smaller by its pivots.
5. Regions are joined recursively: all regions in rounds of 3 and 4 by all tasks, until a region is one
   component or small (LEAF_POINTS, LEAF_BYTES); one of more than BLOCK_POINTS points that is small from the start meets
   no pivots, since these would meet up to PIVOTS times its points. Then it is dealt into up to BLOCKS blocks of about BLOCK_POINTS points,
   or more points if these don't do, and a task for each two blocks joins these: each point in turn is the pivot for the points in the window of its size
   that aren't in its component yet.

Copies never meet as pairs: equal sets are one point, and a region of near copies is one star around
a pivot. Class hashes are combined in each map task before they are dealt out, so one that a third of
all rows share costs a row per task. Every link between different sets is either computed or joins points
that are already in one component.

Identity of sets and shingles is by 64-bit hash (two different sets are taken for one with
probability 2^-64 a pair). Defined results: null, empty and blank texts have no shingles and are
components of their own; a text of fewer than N words is one shingle; rows with equal ids are each
answered; the component id is the smallest id in it (nulls aside); an empty table gives no rows; other
columns aren't read, and ``one_of_each`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, mix, ngram_hashes, slices, small_batches, texts_of, without, written

N = 5
NUM, DEN = 80, 100
RING = 1.5
#: Classes for each one needed, since some stay empty.
SPARE = 1.15
#: Signatures that one reducer sorts at once.
BUCKET_SIGNATURES = 400_000
#: Signatures that a map task combines before it deals them out.
COMBINE_SIGNATURES = 500_000
#: Bytes of signatures in one row of the shuffle.
ROW_BYTES = 1 << 17
#: Documents of a region that become pivots at once, at most.
PIVOTS = 32
#: Classes whose counts are a point's coordinates.
COORDINATES = 256
#: Documents, chosen by a hash of their text, in which common shingles are looked for, and in how many they must be.
SAMPLE, COMMON = 12_000, 2
#: Common shingles are kept as a bitmap of 2^BITS bits; others that fall on a set bit count as common, too.
BITS = 24
MOST_COMMON = 1 << 20
#: Points and bytes of shingles of a region that is joined in blocks, without further pivots.
LEAF_POINTS, LEAF_BYTES = 65_536, 256_000_000
#: Points of a block of such a region; a task joins two blocks. A region has no more than BLOCKS of these (a point goes to a task for each)
#: unless they would have more than MOST_POINTS points or MOST_BYTES of shingles.
BLOCK_POINTS, BLOCKS = 512, 16
MOST_POINTS, MOST_BYTES = 4_096, 16_000_000
#: Keys (8 bytes each) that may be broadcast to pick out the sets of candidates; beyond, a shuffle join does it.
BROADCAST_KEYS = 2_000_000
#: Nodes of edges that a task connects before it passes them on.
FOREST_NODES = 1_000_000
_MAX_ROUNDS = 10_000


def shingle_set(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words; of all its words, if it has fewer."""
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(n, len(words))))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    return (shingle_set(words, n) for words in texts_of(column, SPACE))


def digest(points: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(points.tobytes()) - (1 << 63)


class Rings:
    """Where a set of some size has signatures, and in how many classes."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.from_, self.classes = [1], []
        while self.from_[-1] < 1 << 40:
            low = self.from_[-1]
            up = max(low + 1, math.ceil(low * RING))
            while num * up < den * low:  # a pair spans two rings at most
                up += 1
            self.from_.append(up)
            most = self.differing(up - 1, up - 1)
            self.classes.append(math.ceil(SPARE * (most + 1)) if most else 1)
        self._from = np.array(self.from_)

    def differing(self, a: int, b: int) -> int:
        """The largest symmetric difference of a linked pair of such sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(ring, classes, largest difference) of the size's own ring and, in the window below it, of the next."""
        r = int(np.searchsorted(self._from, size, "right")) - 1
        rings = [r, r + 1] if self.den * size >= self.num * self.from_[r + 1] else [r]
        out = [(r, self.classes[r], self.differing(size, min(self.from_[r + 1] - 1, size * self.den // self.num))) for r in rings]
        # no difference: only equal points link, and they are one already
        return [x for x in out if x[2]]

    def signatures(self, whole: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = []
        rare = whole[common[whole >> np.uint64(64 - BITS)] == 0]
        for ring, k, most in self.of(len(whole)):
            for seed in range(1 << 20):
                points = whole if seed else rare
                if len(points) == 0:
                    continue
                salt = np.uint64(((ring + 1) << 32) + seed)
                cls = (mix(points + salt) % np.uint64(k)).astype(np.uint16 if k < 1 << 16 else np.uint32)
                order = np.argsort(cls, kind="stable")
                cls = cls[order]
                starts = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
                sums = np.add.reduceat(points[order], starts)
                out.append(mix(sums ^ mix(cls[starts].astype(np.uint64) + (salt << np.uint64(12)))))
                if len(starts) > most:
                    break
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


class Signer(Protocol):
    """What tells candidates: sets that link from num / den on have a signature in common."""

    num: int
    den: int

    def signatures(self, whole: np.ndarray, common: np.ndarray) -> np.ndarray: ...


def slim_of(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = list(shingle_sets(b.column(1), n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "row", "n_shingles", "point"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row bigint, n_shingles bigint, point bigint")


def _combined(sig: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A task's signatures: one head for each (flag 1 if it has followers), and followers (flag 2)."""
    order = np.argsort(sig, kind="stable")
    sig, point = sig[order], point[order]
    head = np.r_[True, sig[1:] != sig[:-1]]
    flag = np.where(head, 0, 2).astype(np.uint8)
    flag[:-1][head[:-1] & ~head[1:]] = 1
    return sig, point, flag


def _common(docs: DataFrame, text_col: str, n: int, rows: int, sample: int) -> np.ndarray:
    """Bitmap of the shingles that several of the sampled documents have; 1 MB at most comes to the driver."""
    every = max(1, rows // sample)
    some = docs.select(text_col).where(F.pmod(F.xxhash64(text_col, F.lit(5)), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in slices(batches):
            sets = []
            for s in shingle_sets(b.column(0), n):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    sets.append(s)
            if sets:
                h, k = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int64))], names=["h", "k"])

    found = some.mapInArrow(run, "h bigint, k bigint").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") >= COMMON)
    bits = found.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("bit"), "k").orderBy(F.desc("k"), "bit").limit(MOST_COMMON).select("bit").toArrow()
    out = np.zeros(1 << BITS, dtype=np.uint8)
    out[bits.column(0).to_numpy()] = 1
    return np.packbits(out)


def _signatures(docs: DataFrame, text_col: str, n: int, rings: Signer, buckets: int, common: np.ndarray | None) -> DataFrame:
    """Signatures in packed rows (bucket, data); heads are dealt by signature, followers evenly."""

    held_common = docs.sparkSession.sparkContext.broadcast(np.zeros(0, dtype=np.uint8) if common is None else common)

    def pack(sig: list[np.ndarray], point: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sig:
            return
        s, p, flag = _combined(np.concatenate(sig), np.concatenate(point))
        at = np.where(flag == 2, mix(s ^ p.view(np.uint64)), s) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        s, p, flag, at = s[order], p[order], flag[order], at[order]
        cuts = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
        step = max(1, ROW_BYTES // 17)
        number, data = [], []
        for k in range(buckets):
            for a in range(cuts[k], cuts[k + 1], step):
                z = min(a + step, cuts[k + 1])
                number.append(k)
                data.append(s[a:z].tobytes() + p[a:z].tobytes() + flag[a:z].tobytes())
        for a in range(0, len(data), 64):
            yield pa.RecordBatch.from_arrays([pa.array(number[a : a + 64], pa.int32()), pa.array(data[a : a + 64], pa.binary())], names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sig, point, held = set(), [], [], 0
        common = np.unpackbits(held_common.value)
        for b in slices(batches):
            for s in shingle_sets(b.column(0), n):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                x = rings.signatures(s, common)
                sig.append(x)
                point.append(np.full(len(x), d, dtype=np.int64))
                held += len(x)
                if held >= COMBINE_SIGNATURES:
                    yield from pack(sig, point)
                    seen, sig, point, held = set(), [], [], 0
        yield from pack(sig, point)

    return docs.select(text_col).mapInArrow(run, "bucket int, data binary")


def _regions(packed: DataFrame, buckets: int) -> DataFrame:
    """Distinct (region, point) for each signature that two points or more have."""

    def shared(data: list[bytes]) -> pa.RecordBatch:
        sizes = [len(d) // 17 for d in data]
        sig = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, sizes, strict=True)])
        point = np.concatenate([np.frombuffer(d, np.int64, n, 8 * n) for d, n in zip(data, sizes, strict=True)])
        flag = np.concatenate([np.frombuffer(d, np.uint8, n, 16 * n) for d, n in zip(data, sizes, strict=True)])
        out_s, out_p = [sig[flag == 2]], [point[flag == 2]]
        sig, point, flag = sig[flag != 2], point[flag != 2], flag[flag != 2]
        if len(sig):
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            same = s[1:] == s[:-1]
            near = np.r_[False, same] | np.r_[same, False] | (flag[order] == 1)
            s, p, f = s[near], point[order][near], flag[order][near]
            order = np.lexsort((p, s))
            s, p, f = s[order], p[order], f[order]
            new = np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])][: len(s)]
            followed = np.add.reduceat(f, np.flatnonzero(new)) > 0 if len(s) else f
            s, p = s[new], p[new]
            same = s[1:] == s[:-1]
            keep = (np.r_[False, same] | np.r_[same, False])[: len(s)] | followed
            out_s.append(s[keep])
            out_p.append(p[keep])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_s).view(np.int64)), pa.array(np.concatenate(out_p))], names=["region", "point"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data = None, []
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != at:
                    if data:
                        yield shared(data)
                    at, data = k, []
                data.append(d)
        if data:
            yield shared(data)

    # copies of a text in several map tasks repeat its point, as a head and as a follower
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "region bigint, point bigint").distinct()


def _sets(docs: DataFrame, text_col: str, n: int, points: DataFrame) -> DataFrame:
    """(point, n, at, data): size, coordinates and shingles of the given points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in slices(batches):
            rows = []
            for s in shingle_sets(b.column(0), n):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    at = np.bincount((s % np.uint64(COORDINATES)).astype(np.int64), minlength=COORDINATES)
                    rows.append((d, len(s), np.minimum(at, 255).astype(np.uint8).tobytes(), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["point", "n", "at", "data"])

    every = docs.select(text_col).mapInArrow(run, "point bigint, n bigint, at binary, data binary")
    if points.count() <= BROADCAST_KEYS:
        points = F.broadcast(points)
    return every.join(points, "point", "left_semi").dropDuplicates(["point"])


def _apart(pairs: DataFrame, sets: DataFrame, rings: Signer) -> DataFrame:
    """(point, pivot, d, most, maybe): L1 distance of the coordinates, the point's largest difference to anything it links with, and whether a link is possible."""
    here = sets.select("point", F.col("n").alias("n0"), F.col("at").alias("at0"))
    there = sets.select(F.col("point").alias("pivot"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    rows = pairs.join(here, "point").join(there, "pivot").select("point", "pivot", "n0", "n1", "at0", "at1")
    num, den = rings.num, rings.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            if not b.num_rows:
                continue
            n0, n1 = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES).astype(np.int16) for k in (4, 5))
            d = np.abs(x - y).sum(axis=1, dtype=np.int64)
            maybe = (d <= (n0 + n1) * (den - num) // (den + num)) & (den * np.minimum(n0, n1) >= num * np.maximum(n0, n1))
            most = (n0 + n0 * den // num) * (den - num) // (den + num)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d), pa.array(most), pa.array(maybe)], names=["point", "pivot", "d", "most", "maybe"])

    return rows.mapInArrow(run, "point bigint, pivot bigint, d bigint, most bigint, maybe boolean")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) for the pairs (point, pivot) whose sets link."""
    rows = (
        pairs.select("point", "pivot").join(sets.select("point", F.col("data").alias("x")), "point")
        .join(sets.select(F.col("point").alias("pivot"), F.col("data").alias("y")), "pivot").select("point", "pivot", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            keep = []
            last, y = None, None
            for q, x, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if q != last:
                    last, y = q, np.frombuffer(z, np.uint64)
                x = np.frombuffer(x, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as fewer ones that connect the same nodes: each with the smallest that it reaches within the task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        if len(root) >= FOREST_NODES:
            yield _stars(root, find)
            root.clear()
    yield _stars(root, find)


def _stars(root: dict[int, int], find: Callable[[int], int]) -> pa.RecordBatch:
    nodes = list(root)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of an edge can reach.

    Tasks first connect what their own edges connect. In each round nodes take the label of their smallest neighbour and of its label; then labels become the
    nodes and only edges between different labels are left, so rounds get smaller fast.
    """
    forest = lambda e: e.mapInArrow(_forest, "u bigint, v bigint").where("u <> v")
    e = forest(edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v"))
    # dealt out by the smaller node and connected again, so that few rounds are left
    e = written(forest(e.repartition("v")).distinct(), "cc-edges")
    total = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lab = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))
        lab = written(lab, "cc-labels")
        to = lab.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = written(lab.join(to, "label").select("node", F.col("further").alias("label")), "cc-labels")
        discard(lab)
        if total is None:
            new = jumped
        else:
            new = written(total.join(jumped.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", F.coalesce("further", "label").alias("label")), "cc-total")
            discard(total)
        left = e.join(jumped.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(jumped.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v").where("lu <> lv")
        left = written(forest(left.select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v"))).distinct(), "cc-edges")
        discard(e)
        total, e = new, left
        if not e.take(1):
            discard(e)
            return total


def _families(rows: DataFrame) -> DataFrame:
    """(region, point) of the same regions, or of what they are together where that meets fewer pivots than they do apart, as it mostly does: they overlap. rows: (region, point)."""
    met = F.col("m") * F.least(F.lit(float(PIVOTS)), F.ceil(F.sqrt("m")))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("point").alias("pivot"))
    edges = rows.join(sizes, "region").where("point <> pivot").select(F.col("point").alias("a"), F.col("pivot").alias("b"))
    family = components(edges).withColumnRenamed("label", "family")
    apart = sizes.join(family, F.col("pivot") == F.col("node")).groupBy("family").agg(F.sum(met).alias("apart"))
    of = family.join(family.groupBy("family").agg(F.count(F.lit(1)).alias("m")).join(apart, "family").select("family", (met <= F.col("apart")).alias("whole")), "family").withColumnRenamed("node", "point")
    one = of.where("whole").select(F.xxhash64("family", F.lit("family")).alias("region"), "point")
    return one.unionByName(rows.join(of.where("not whole").select("point"), "point").select("region", "point"))


def _grown(links: DataFrame, new: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links with the new ones, and their components."""
    if not new.take(1):
        return links, labels
    more = written(links.unionByName(new), "links")
    discard(links, new)
    return more, components(more)


def _leaves(points: DataFrame, rings: Signer) -> DataFrame:
    """(a, b) links that join components within small regions; points: (region, m, bytes, point, label, n, at, data), m being the region's points and bytes that of their shingles.

    A task has two blocks of a region, or one, so no task has more than about 2 * MOST_POINTS points.
    """
    num, den = rings.num, rings.den

    def joined(block: list[int], across: bool, point: list[int], label: list[int], n: list[int], at: list[bytes], data: list[bytes]) -> Iterator[tuple[int, int]]:
        order = np.lexsort((np.array(point), np.array(n)))
        size, names = np.array(n)[order], np.array(point)[order]
        x = np.frombuffer(b"".join(at), np.uint8).reshape(-1, COORDINATES)[order].astype(np.int16)
        sets = [np.frombuffer(data[i], np.uint64) for i in order]
        of = np.unique(np.array(label)[order], return_inverse=True)[1]
        side = np.array(block)[order]
        for i in range(len(order) - 1):
            end = int(np.searchsorted(size * num, size[i] * den, "right"))
            others = np.arange(i + 1, end)
            others = others[(of[others] != of[i]) & ((side[others] != side[i]) | (not across))]
            if not len(others):
                continue
            apart = np.abs(x[others] - x[i]).sum(axis=1, dtype=np.int64)
            for j in others[apart <= (size[others] + size[i]) * (den - num) // (den + num)]:
                if of[j] == of[i]:
                    continue
                p = np.searchsorted(sets[j], sets[i])
                p[p == len(sets[j])] = 0
                both = int(np.count_nonzero(sets[j][p] == sets[i]))
                if den * both >= num * (int(size[i]) + int(size[j]) - both):
                    of[of == of[j]] = of[i]
                    yield int(names[i]), int(names[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [], [], [])
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64())], names=["a", "b"])

        for b in slices(batches, 500):
            for region, low, high, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (region, low, high) != at:
                    if len(held[0]) > 1:
                        found += joined(held[0], at[1] != at[2], *held[1:])
                    at, held = (region, low, high), ([], [], [], [], [], [])
                for h, v in zip(held, row, strict=True):
                    h.append(v)
            if found:
                yield out()
                found = []
        if len(held[0]) > 1:
            found += joined(held[0], at[1] != at[2], *held[1:])
        yield out()

    blocks = F.greatest(F.least(F.ceil(F.col("m") / BLOCK_POINTS), F.lit(BLOCKS)), F.ceil(F.col("m") / MOST_POINTS), F.ceil(F.col("bytes") / MOST_BYTES)).cast("int")
    dealt = points.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("point", F.lit(3)), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "point", "label", "n", "at", "data")
    rows = rows.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _joined(regions: DataFrame, sets: DataFrame, rings: Signer, pivots: int, leaf_bytes: int, leaf_points: int, told: dict[str, int] | None, leaves_first: bool = False) -> DataFrame:
    """(node, label) of all points that have a link, in rounds over all regions at once; regions: (region, point, pivot, times), without equal ones."""
    num, den = rings.num, rings.den
    # first the star around the pivot that each point shares most regions with
    near = regions.where("pivot < point").groupBy("point", "pivot").agg(F.sum("times").alias("times"))
    home = near.groupBy("point").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot"))
    links = written(_links(_apart(home, sets, rings).where("maybe"), sets, num, den), "links")
    labels = components(links)
    open_ = regions.join(labels.withColumnRenamed("node", "point"), "point", "left").groupBy("region").agg(F.min(F.coalesce("label", "point")).alias("l0"), F.max(F.coalesce("label", "point")).alias("l1")).where("l0 <> l1")
    left = written(regions.select("region", "point").join(open_.select("region"), "region", "left_semi"), "join-open")
    active, asked, held_asked = written(_families(left), "join-families"), None, []
    held = [left, active]
    for round_ in range(_MAX_ROUNDS):
        rows = active.join(labels.withColumnRenamed("node", "point"), "point", "left").select("region", "point", F.coalesce("label", "point").alias("label"))
        open_ = rows.groupBy("region").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("m")).where("l0 <> l1").select("region", "m")
        rows = written(rows.join(open_, "region"), "join-active")
        discard(*held)
        # what is small ends here; at first only what is larger than a block, as pivots would meet more points of it than blocks have
        least = 0 if round_ or leaves_first else BLOCK_POINTS
        sizes = rows.join(sets.select("point", "n"), "point").groupBy("region").agg((F.sum("n") * 8).alias("bytes"))
        fits = sizes.where(f"bytes <= {leaf_bytes}")
        leaves = written(rows.where(f"m > {least} and m <= {leaf_points}").join(fits, "region"), "join-leaves")
        new = written(_leaves(leaves.select("region", "m", "bytes", "point", "label").join(sets, "point"), rings), "links")
        if told is not None:
            told["leaves"] = told.get("leaves", 0) + leaves.select("region").distinct().count()
        links, labels = _grown(links, new, labels)
        rest = written(rows.join(leaves.select("region").distinct(), "region", "left_anti"), "join-active")
        discard(rows, leaves)
        rows = rest
        if not rows.take(1):
            discard(rows, *held_asked)
            return labels
        # pivots come from the smallest components: once they are gone, a region is often one component, and needs no more of them
        sizes = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("size"))
        others = sizes.groupBy("region").agg((F.sum("size") - F.max("size")).alias("others"))
        line = Window.partitionBy("region").orderBy("size", F.xxhash64("point"), "point")
        some = rows.join(sizes, ["region", "label"]).withColumn("place", F.row_number().over(line)).where(F.col("place") <= pivots).where("place <= ceil(sqrt(m))").join(others, "region").where("place <= others")
        some = written(some.select("region", F.col("point").alias("pivot"), F.col("label").alias("of")), "join-pivots")
        met = rows.join(some, "region").where("point <> pivot")
        pairs = met.groupBy("point", "pivot").agg(F.max(F.col("label") != F.col("of")).alias("open"))
        apart = written(_apart(pairs, sets, rings), "join-apart")
        # only pairs of different components can matter, and each of them once
        ask = apart.where("maybe").join(pairs.where("open"), ["point", "pivot"], "left_semi")
        ask = ask.select(F.greatest("point", "pivot").alias("point"), F.least("point", "pivot").alias("pivot")).distinct()
        ask = written(ask.join(asked, ["point", "pivot"], "left_anti") if asked else ask, "join-asked")
        if ask.take(1):
            new = written(_links(ask, sets, num, den), "links")
            links, labels = _grown(links, new, labels)
            asked = asked.unionByName(ask) if asked else ask
            held_asked.append(ask)
        rest = met.select("region", "point", "pivot").join(some.select("region", F.col("pivot").alias("point")), ["region", "point"], "left_anti").join(apart, ["point", "pivot"])
        rest = rest.select("region", "point", "pivot", "d", "most")
        rest = rest.join(rest.groupBy("region", "point").agg(F.min("d").alias("least")), ["region", "point"]).withColumn("in_", F.expr("cast(d <= least + 2 * most as int)"))
        # replicate to Voronoi regions only where that leaves less than the plain rest
        gain = rest.groupBy("region").agg(F.sum("in_").alias("copies"), F.countDistinct("point").alias("points"))
        rest = rest.join(gain.where("points > 1"), "region")
        cells = rest.where("in_ = 1 and 2 * copies <= 3 * points").select(F.xxhash64("region", "pivot", F.lit(round_)).alias("region"), "point", F.lit(True).alias("cell"))
        whole = rest.where("2 * copies > 3 * points").select("region", "point", F.lit(False).alias("cell")).distinct()
        left = written(cells.unionByName(whole), "join-left")
        if told is not None:
            told["pivots"] = told.get("pivots", 0) + some.count()
            told["cells"] = told.get("cells", 0) + left.where("cell").select("region").distinct().count()
            told["rounds"] = round_ + 1
        discard(rows, some, apart)
        held, active = [left], left.select("region", "point")
    raise RuntimeError("the regions did not get smaller")


def grouped(docs: DataFrame, slim: DataFrame, signer: Signer, buckets: int, common: np.ndarray | None, *, text_col: str, n: int, pivots: int, leaf_points: int, leaf_bytes: int, told: dict[str, int] | None, leaves_first: bool = False) -> DataFrame:
    """One row for each of slim's: doc_id, row, n_shingles, component_id. Points with a signature of ``signer`` in common are candidates.

    With ``leaves_first`` small regions don't meet pivots at all.
    """
    shared = written(_regions(_signatures(docs, text_col, n, signer, buckets, common), buckets), "join-regions")
    # regions with the same members are one
    marks = shared.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("point").alias("pivot"), F.bit_xor(F.xxhash64("point")).alias("x"), F.bit_xor(F.xxhash64("point", F.lit(7))).alias("y"))
    one = marks.groupBy("n", "pivot", "x", "y").agg(F.min("region").alias("region"), F.count(F.lit(1)).alias("times")).select("region", "pivot", "times")
    regions = written(shared.join(one, "region"), "join-regions1")
    discard(shared)
    labels = None
    if regions.take(1):
        sets = written(_sets(docs, text_col, n, regions.select("point").distinct()), "join-sets")
        labels = _joined(regions, sets, signer, pivots, leaf_bytes, leaf_points, told, leaves_first)
        discard(sets)
    first = slim.where("point is not null").groupBy("point").agg(F.min("doc_id").alias("least"))
    first = first.withColumn("label", F.col("point")) if labels is None else first.join(labels.withColumnRenamed("node", "point"), "point", "left").withColumn("label", F.coalesce("label", "point"))
    ids = first.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(first.join(ids, "label").select("point", "component_id"), "join-named")
    discard(regions)
    out = slim.join(named, "point", "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("point").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def clusters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN, pivots: int = PIVOTS, leaf_points: int = LEAF_POINTS, leaf_bytes: int = LEAF_BYTES, told: dict[str, int] | None = None) -> DataFrame:
    """One row per document: doc_id, row (hash of its text), n_shingles, component_id. ``told`` gets the numbers of rounds, pivots, Voronoi regions and leaves."""
    small_batches(docs.sparkSession)
    rings = Rings(num, den)
    slim = written(slim_of(docs, id_col, text_col, n), "join-slim")
    total = slim.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, int(total * 0.5) // BUCKET_SIGNATURES + 1)
    buckets = max(buckets, docs.sparkSession.sparkContext.defaultParallelism)
    common = _common(docs, text_col, n, slim.count(), SAMPLE)
    return grouped(docs, slim, rings, buckets, common, text_col=text_col, n=n, pivots=pivots, leaf_points=leaf_points, leaf_bytes=leaf_bytes, told=told)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with the smallest id.

    Rows without shingles all stay. Of repeated rows with the smallest id and one text a single one stays.
    """
    c = clusters(docs, id_col=id_col, text_col=text_col, **how)
    goes = c.where("n_shingles > 0 and not (doc_id <=> component_id)").select(F.col("doc_id").alias("id"), "row")
    heads = c.where("n_shingles > 0 and doc_id <=> component_id").select("doc_id", "row", "component_id")
    # ids may repeat with different texts of one component: the smallest hash of a text stays
    twice = heads.groupBy("doc_id").agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(heads.join(twice, "doc_id"), "join-again")
    goes = goes.unionByName(again.where("row <> stays").select(F.col("doc_id").alias("id"), "row"))
    out = without(docs, goes, id_col, text_col)
    if not again.take(1):
        return out
    same = again.select(F.col("doc_id").alias("i_"), F.col("stays").alias("r_")).distinct()
    hit = (out[id_col] == F.col("i_")) & (F.xxhash64(out[text_col]) == F.col("r_"))
    return out.join(same, hit, "left_anti").unionByName(out.join(same, hit, "left_semi").dropDuplicates([id_col, text_col]))

"""Hard negatives of anchors, by pruning with length buckets and sorted coordinate lists (as LEMP does).

Vectors are cut into blocks of alike length. A block holds its vectors and, for each coordinate, the list of its
unit vectors' values in order. An anchor that needs scores of at least t meets a block whose longest vector has length
n only with cosines of at least t / (|anchor| n): blocks for which that is above 1 are left out, and in the others the
anchor's focus coordinates (its largest ones) each admit a range of values, the part of the sphere within that angle.
The ranges are looked up in the sorted lists, what is in all of them is a candidate, and candidates are scored exactly.
Blocks come longest first, and t rises with what an anchor has found.

An anchor's positives are its first vectors of its own label, so they are looked for in blocks of that label; negatives in
blocks of all labels, with t the least score that any of the anchor's positives still admits. Anchors are a stated set
of queries: groups of anchors meet parts of the index in tasks of their own, and what they find is merged by anchor.

Defined results: rows with a null id, label or vector, or with a component that is null, NaN or infinite, take no part;
vectors of unequal lengths count as if filled up with zeros; repeated rows are rows of their own (an anchor's copy may be
its positive, and an anchor that occurs twice is answered twice); scores beyond 64 bits are cut off at the limit; ties go by
the smaller id; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

POSITIVES, NEGATIVES = 5, 3
#: A negative scores so many hundredths of its positive.
LOW, HIGH = 50, 95
#: Vectors of a block, and ratio of lengths in a bucket.
BLOCK, BUCKET = 4_096, 1.05
#: Anchors and blocks that meet in one task, at most.
ANCHORS, BLOCKS = 2_048, 4
#: Coordinates of an anchor that are looked up.
FOCUS = 4
#: Products of lengths below which sums of doubles are exact.
_EXACT = float(1 << 52)
_LONG = 1 << 63
_INDEX = "part bigint, n bigint, top double, label binary, id binary, row binary, data binary, unit binary, place binary"


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, *, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part; v has whole numbers, the floor of scale times each component."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(m.astype(np.float64)).sum(axis=1))


def _block(part: int, table: pa.Table) -> pa.Table:
    """One row of an index, longest vectors first: with unit vectors' values in order, and whose they are, for each coordinate."""
    m = _matrix(table.column("v"))
    lengths = _lengths(m)
    order = np.argsort(-lengths, kind="stable")
    m, lengths = m[order], lengths[order]
    unit = m / np.where(lengths > 0, lengths, 1)[:, None]
    place = np.argsort(unit, axis=0, kind="stable")
    long = {c: np.ascontiguousarray(table.column(c).to_numpy()[order].astype(np.int64)).tobytes() for c in ("label", "id", "row")}
    values = [part, len(m), float(lengths[0]), *long.values(), m.tobytes(), np.take_along_axis(unit, place, axis=0).T.tobytes(), place.T.astype(np.int32).tobytes()]
    kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 6]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])


def index(rows: DataFrame, owner: Column, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(owner, part, n, top, ...) blocks of alike length, each of one owner; a part is some of an owner's blocks."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("owner", owner).withColumn("bucket", F.when(size > 0, F.floor(F.log(size) / F.log(F.lit(BUCKET)))).otherwise(-1))
    many = rows.groupBy("owner", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = rows.join(many, ["owner", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))

    def pack(table: pa.Table) -> pa.Table:
        out = _block(0, table)
        return out.append_column("owner", table.column("owner").slice(0, 1))

    packed = rows.select("owner", "bucket", "block", "label", "id", "row", "v").groupBy("owner", "bucket", "block").applyInArrow(pack, f"{_INDEX}, owner bigint")
    packed = written(packed, "negatives-blocks")
    # parts are drawn by hash, so that each has blocks of all lengths
    many = packed.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / blocks).alias("parts"))
    out = written(packed.join(many, "owner").withColumn("part", F.pmod(F.xxhash64("top", "n", F.col("row")), "parts")), "negatives-index")
    discard(packed)
    return out


class Block:
    """A row of an index in a task."""

    def __init__(self, row: dict) -> None:
        self.n, self.top = row["n"], row["top"]
        self.label, self.id, self.row = (np.frombuffer(row[c], np.int64) for c in ("label", "id", "row"))
        self.data = np.frombuffer(row["data"], np.int64).reshape(self.n, -1)
        self.real = self.data.astype(np.float64)
        self.unit = np.frombuffer(row["unit"], np.float64).reshape(-1, self.n)
        self.place = np.frombuffer(row["place"], np.int32).reshape(-1, self.n)

    def candidates(self, v: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray | None:
        """Places that may score ``least`` or more with a vector; None: all of them."""
        most = length * self.top
        if least == -np.inf:
            return None
        if most <= 0:
            return None if least <= 0 else np.empty(0, dtype=np.int64)
        cosine = least / most - 1e-9
        if cosine > 1:
            return np.empty(0, dtype=np.int64)
        if cosine <= 0:
            # a shorter vector has a smaller product, so of those below 0 more could reach it
            return None
        within = np.arccos(cosine)
        of = v[: len(self.unit)] / length
        counts = np.zeros(self.n, dtype=np.int8)
        asked = 0
        for f in np.argsort(-np.abs(of), kind="stable")[:focus]:
            at = np.arccos(np.clip(of[f], -1, 1))
            low, high = np.cos(min(np.pi, at + within)) - 1e-9, np.cos(max(0.0, at - within)) + 1e-9
            a, z = np.searchsorted(self.unit[f], low, "left"), np.searchsorted(self.unit[f], high, "right")
            if z - a == self.n:
                continue
            counts[self.place[f, a:z]] += 1
            asked += 1
        return np.flatnonzero(counts == asked) if asked else None

    def scores(self, v: np.ndarray, length: float, which: np.ndarray | None) -> np.ndarray:
        d = min(len(v), self.data.shape[1])
        if length * self.top < _EXACT:
            m = self.real if which is None else self.real[which]
            return (m[:, :d] @ v[:d].astype(np.float64)).astype(np.int64)
        m = self.data if which is None else self.data[which]
        return np.array([max(-_LONG, min(_LONG - 1, sum(x * y for x, y in zip(r, v[:d].tolist(), strict=True)))) for r in m[:, :d].tolist()], dtype=np.int64)


def first(score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones those of the smallest ids."""
    if len(score) > 8 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((id_[some], -score[some]))[:k]]
    return np.lexsort((id_, -score))[:k]


class Best:
    """The first k (score, id) with scores of low to high of one anchor."""

    def __init__(self, k: int, low: int = -_LONG, high: int = _LONG - 1) -> None:
        self.k, self.low, self.high = k, low, high
        self.score, self.id = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def least(self) -> float:
        """Scores below can't come in."""
        if self.low > self.high:
            return np.inf
        if len(self.score) == self.k:
            return float(self.score[-1])
        return float(self.low) if self.low > -_LONG else -np.inf

    def add(self, score: np.ndarray, id_: np.ndarray) -> None:
        here = (score >= self.low) & (score <= self.high)
        if len(self.score) == self.k:
            here &= score >= self.score[-1]
        if here.any():
            score, id_ = np.concatenate([self.score, score[here]]), np.concatenate([self.id, id_[here]])
            at = first(score, id_, self.k)
            self.score, self.id = score[at], id_[at]


def _met(anchors: DataFrame, index_: DataFrame, bests: Callable[[dict], list[Best]], same: bool, group: int) -> DataFrame:
    """(row, place, id, score): of each anchor's lists what each part of the index gives; anchors: (owner, row, label, v, ...)."""
    sizes = anchors.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / group).cast("bigint").alias("groups"))
    parts = index_.groupBy("owner").agg((F.max("part") + 1).alias("parts"))
    cell = ["owner", "group", "part"]
    mine = [c for c in anchors.columns if c != "owner"]
    asked = anchors.join(sizes, "owner").withColumn("group", F.pmod(F.xxhash64("row"), "groups")).join(parts, "owner").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    blocks = index_.join(sizes, "owner").withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
    held = [c for c in index_.columns if c not in ("owner", "part", "parts")]
    both = asked.select(*cell, F.lit(float("inf")).alias("rank"), F.struct(*mine).alias("anchor"), F.lit(None).cast(blocks.select(F.struct(*held)).schema[0].dataType).alias("block"))
    both = both.unionByName(blocks.select(*cell, F.col("top").alias("rank"), F.lit(None).cast(asked.select(F.struct(*mine)).schema[0].dataType).alias("anchor"), F.struct(*held).alias("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, []

        def found() -> pa.RecordBatch:
            out = [(a["row"], i, x, s) for a, _, _, b in lists for i, one in enumerate(b) for x, s in zip(one.id.tolist(), one.score.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["row", "place", "id", "score"])

        for b in batches:
            for r in range(b.num_rows):  # a row is an anchor, or a block of thousands of vectors
                key = tuple(b.column(i)[r].as_py() for i in range(3))
                if key != at:
                    if lists:
                        yield found()
                    at, lists = key, []
                if (a := b.column(4)[r].as_py()) is not None:
                    v = np.array(a["v"], dtype=np.int64)
                    lists.append((a, v, float(_lengths(v[None, :])[0]), bests(a)))
                    continue
                if not lists:
                    continue
                block = Block(b.column(5)[r].as_py())
                for a, v, length, own in lists:
                    which = block.candidates(v, length, min(x.least for x in own))
                    if which is not None and not len(which):
                        continue
                    if which is not None and 2 * len(which) > block.n:
                        which = None
                    score = block.scores(v, length, which)
                    id_, row, label = (x if which is None else x[which] for x in (block.id, block.row, block.label))
                    here = (label == a["label"]) & (row != a["row"]) if same else label != a["label"]
                    for x in own:
                        x.add(score[here], id_[here])
        if lists:
            yield found()

    line = both.repartition(*cell).sortWithinPartitions(*[F.asc(c) for c in cell], F.desc("rank"))
    return line.mapInArrow(run, "row bigint, place int, id bigint, score bigint")


def mined(vectors: DataFrame, anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, blocks: int = BLOCKS, group: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, v); ``anchor`` tells which are anchors."""
    spark = vectors.sparkSession
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = written(vectors.select("id", F.xxhash64("label").alias("label"), "v", anchor.alias("is_anchor")).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    asked = rows.where("is_anchor").select("row", "id", "label", "v")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(int(old), 2 * blocks))  # a row may be a whole block
        by_label = index(rows, F.col("label"), block, blocks)
        k = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
        near = _met(asked.withColumn("owner", F.col("label")), by_label, lambda a: [Best(positives)], True, group)
        near = written(near.withColumn("k", k).where(F.col("k") <= positives).select("row", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        discard(by_label)
        one = F.shiftright("row", 63)  # one owner of all
        every = index(rows, one, block, blocks)
        windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "positive_score"))).alias("p"))
        again = asked.join(windows, "row").select(one.alias("owner"), "row", "id", "label", "v", "p")
        bests = lambda a: [Best(negatives, -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100) for x in a["p"]]
        far = _met(again, every, bests, False, group).withColumn("k", F.col("place") + 1)
        rank = F.row_number().over(Window.partitionBy("row", "k").orderBy(F.desc("score"), "id"))
        far = written(far.withColumn("rank", rank).where(F.col("rank") <= negatives).select("row", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives-found")
        discard(every)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    out = far.join(near, ["row", "k"]).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

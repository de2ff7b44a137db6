"""Near duplicates by min-max hashing.

Each permutation of the shingles (64-bit hashes, times an odd number, plus a number) gives two values of a set: its smallest and
its largest. Both agree between two sets with the probability of their Jaccard similarity, so a signature needs half the
permutations, and as both ends of one permutation tend to differ at different pairs, the share of values that
agree is an unbiased estimate with a lower variance than that of as many smallest values.

A band is both values of PAIRS permutations. Two sets that link agree in a band with a probability of at least p
(computed from the threshold, small sets included); so many bands are taken that a link shares none with a probability
of MISS. Sets with a band in common are candidates. Bands are combined in each map task before they are dealt out, so one that
a third of all rows share costs a row per task, and equal sets are one point from the start.

Candidates are confirmed on full sets: the regions of bands go through the exact region join of ``jaccard_join`` (stars
around each region's smallest point, pivots, Voronoi regions, leaves), in which no link between different sets of a
band is lost and no pair inside one component is compared again.

Defined results: as in ``jaccard_join``: null, empty and blank texts have no shingles and are components of their own; a
text of fewer than N words is one shingle; rows with equal ids are each answered; a component's id is its smallest id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, written
from .jaccard_join import BUCKET_SIGNATURES, LEAF_BYTES, LEAF_POINTS, PIVOTS, grouped, slim_of

N = 3
NUM, DEN = 85, 100
#: Permutations of a band; each gives two values.
PAIRS = 3
#: Probability that a link has no band in common.
MISS = 1e-9
#: Values that are permuted at once.
CELLS = 1 << 16
_SEED = 0x5851F42D4C957F2D
_P = np.uint64(0x9E3779B97F4A7C15)


class MinMax:
    """Signatures of sets, for sets that link from a similarity of num / den on."""

    def __init__(self, num: int = NUM, den: int = DEN, pairs: int = PAIRS, miss: float = MISS) -> None:
        self.num, self.den, self.pairs = num, den, pairs
        self.bands = math.ceil(math.log(miss) / math.log1p(-self.chance() ** pairs)) if num < den else 1
        numbers = mix(np.arange(1, 2 * self.bands * pairs + 1, dtype=np.uint64) * np.uint64(_SEED))
        self.by, self.plus = numbers[::2] | np.uint64(1), numbers[1::2]

    def chance(self) -> float:
        """The least probability that both ends of a permutation agree for different sets that link."""
        out = 1.0
        for union in range(2, 10_000):
            shared = -(-self.num * union // self.den)
            if shared < union:
                out = min(out, shared * (shared - 1) / (union * (union - 1)))
        return min(out, (self.num / self.den) ** 2)

    def links(self, size: int) -> bool:
        """Whether a set of this size can link with a different one."""
        return self.den * size >= self.num * (size + 1)

    def ends(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest value of a set under each permutation."""
        n = len(self.by)
        low, high = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for at in range(0, len(whole), CELLS):
            some = whole[at : at + CELLS]
            step = max(1, CELLS // len(some))
            for k in range(0, n, step):
                x = self.by[k : k + step, None] * some + self.plus[k : k + step, None]
                np.minimum(low[k : k + step], x.min(axis=1), out=low[k : k + step])
                np.maximum(high[k : k + step], x.max(axis=1), out=high[k : k + step])
        return low, high

    def estimate(self, x: np.ndarray, y: np.ndarray) -> float:
        """The share of values of two sets that agree."""
        (a, b), (c, d) = self.ends(x), self.ends(y)
        return float(((a == c).mean() + (b == d).mean()) / 2)

    def signatures(self, whole: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """One hash for each band; none for a set that can't link."""
        if not self.links(len(whole)):
            # a smaller set can be linked only if this one can
            return np.empty(0, dtype=np.uint64)
        low, high = self.ends(whole)
        h = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        for x in (*low.reshape(self.bands, -1).T, *high.reshape(self.bands, -1).T):
            h = mix(h * _P + x)
        return h


def clusters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN, pairs: int = PAIRS, miss: float = MISS, pivots: int = PIVOTS, leaf_points: int = LEAF_POINTS, leaf_bytes: int = LEAF_BYTES, told: dict[str, int] | None = None) -> DataFrame:
    """One row per document: doc_id, row (hash of its text), n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    signer = MinMax(num, den, pairs, miss)
    slim = written(slim_of(docs, id_col, text_col, n), "minmax-slim")
    buckets = max(slim.count() * signer.bands // BUCKET_SIGNATURES + 1, spark.sparkContext.defaultParallelism)
    out = grouped(docs, slim, signer, buckets, None, text_col=text_col, n=n, pivots=pivots, leaf_points=leaf_points, leaf_bytes=leaf_bytes, told=told, leaves_first=True)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

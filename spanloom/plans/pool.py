"""Parameters for many datasets so that their probes together stay under a limit.

The count table is long: (dataset, parameters ..., num_probes). It is small, so the search runs on the driver;
bounds, lookups and the interpolation of whole tables are DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Counts = Mapping[str, Mapping[tuple[float, ...], float]]


class OverLimit(ValueError):
    """No parameters keep the number of probes below the limit."""


def counts_of(table: DataFrame, params: Sequence[str]) -> dict[str, dict[tuple[float, ...], float]]:
    out: dict[str, dict[tuple[float, ...], float]] = {}
    for r in table.select("dataset", *params, "num_probes").collect():
        out.setdefault(r[0], {})[tuple(float(x) for x in r[1:-1])] = float(r[-1])
    return out


def bounds(table: DataFrame, params: Sequence[str]) -> DataFrame:
    """(dataset, <param>_low, <param>_high) of computed values."""
    return table.groupBy("dataset").agg(*[f(p).alias(f"{p}_{n}") for p in params for f, n in ((F.min, "low"), (F.max, "high"))])


def standard_bounds(table: DataFrame, m: str, e: str, step: float = 0.001) -> DataFrame:
    """(dataset, m_low, m_high, e_low, e_high) between which every point has computed values around it.

    Values of m count only if they were computed with both the least and the largest e of the dataset. Upper bounds are
    less by ``step``, which a search may go over them.
    """
    ends = table.groupBy("dataset").agg(F.min(e).alias("e_low"), F.max(e).alias("e_high"))
    both = table.join(ends, "dataset").where((F.col(e) == F.col("e_low")) | (F.col(e) == F.col("e_high"))).groupBy("dataset", m).agg(F.min((F.col(e))).alias("a"), F.max(F.col(e)).alias("z"), F.first("e_low").alias("e_low"), F.first("e_high").alias("e_high"))
    full = both.where("a = e_low and z = e_high").groupBy("dataset").agg(F.min(m).alias("m_low"), F.max(m).alias("m_high"), F.first("e_low").alias("e_low"), F.first("e_high").alias("e_high"))
    return full.select("dataset", "m_low", (F.col("m_high") - step).alias("m_high"), "e_low", (F.col("e_high") - step).alias("e_high"))


def rectangle_interpolated(points: DataFrame, table: DataFrame, x: str, y: str) -> DataFrame:
    """points (dataset, x, y) with num_probes, bilinear in the smallest computed rectangle around each.

    Rectangles are weighed (width + 0.001) * (0.1 * height + 0.001), ties by their corner.
    """
    t = table.select("dataset", F.col(x).alias("px"), F.col(y).alias("py"), "num_probes")
    corner = lambda n, xs, ys: t.select("dataset", F.col("px").alias(xs), F.col("py").alias(ys), F.col("num_probes").alias(n))
    low = points.join(corner("ll", "x0", "y0"), "dataset").where((F.col("x0") <= F.col(x)) & (F.col("y0") <= F.col(y)))
    both = low.join(corner("hh", "x1", "y1"), "dataset").where((F.col("x1") >= F.col(x)) & (F.col("y1") >= F.col(y)))
    four = both.join(corner("lh", "x0", "y1"), ["dataset", "x0", "y1"]).join(corner("hl", "x1", "y0"), ["dataset", "x1", "y0"])
    area = (F.col("x1") - F.col("x0") + 0.001) * (0.1 * (F.col("y1") - F.col("y0")) + 0.001)
    best = four.withColumn("area", area).groupBy("dataset", x, y).agg(F.min_by(F.struct("x0", "x1", "y0", "y1", "ll", "lh", "hl", "hh"), F.struct("area", "x0", "y0")).alias("b")).select("dataset", x, y, "b.*")
    u = F.when(F.col("x1") > F.col("x0"), (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    v = F.when(F.col("y1") > F.col("y0"), (F.col(y) - F.col("y0")) / (F.col("y1") - F.col("y0"))).otherwise(0.0)
    value = (1 - u) * (1 - v) * F.col("ll") + (1 - u) * v * F.col("lh") + u * (1 - v) * F.col("hl") + u * v * F.col("hh")
    return best.select("dataset", x, y, value.alias("num_probes"))


def interpolate(counts: Mapping[tuple[float, ...], float], at: Sequence[float]) -> float:
    """Multilinear in the smallest computed box around a point; of two parameters the second weighs a tenth."""
    n = len(at)
    values = [sorted({k[i] for k in counts}) for i in range(n)]
    scale = [1.0, 0.1] if n == 2 else [1.0 / max(v[-1] - v[0], 1e-9) for v in values]
    lows = [[x for x in v if x <= a + 1e-12][::-1] for v, a in zip(values, at, strict=True)]
    highs = [[x for x in v if x >= a - 1e-12] for v, a in zip(values, at, strict=True)]
    best, least = None, math.inf
    for low in product(*lows):
        for high in product(*highs):
            area = math.prod(s * (h - lo) + 0.001 for s, h, lo in zip(scale, high, low, strict=True))
            if area < least and all(c in counts for c in product(*zip(low, high, strict=True))):
                best, least = (low, high), area
    if best is None:
        raise ValueError(f"no computed values around {tuple(at)}")
    share = [0.0 if h == lo else (a - lo) / (h - lo) for a, lo, h in zip(at, *best, strict=True)]
    return sum(math.prod(u if bit else 1 - u for u, bit in zip(share, bits, strict=True)) * counts[tuple((h if bit else lo) for lo, h, bit in zip(*best, bits, strict=True))] for bits in product((0, 1), repeat=n) if all(u > 0 or not bit for u, bit in zip(share, bits, strict=True)))


def total(counts: Counts, at: Mapping[str, Sequence[float]]) -> float:
    return sum(interpolate(counts[d], at[d]) for d in sorted(counts))


def loss(at: Mapping[str, Sequence[float]], weights: Mapping[str, float], coefficients: Sequence[float]) -> float:
    """Weighted sum of squares: large parameters are bad."""
    return sum(weights[d] * sum(c * v * v for c, v in zip(coefficients, x, strict=True)) for d, x in at.items())


def barrier(used: float, limit: float, eps: float) -> float:
    if math.isnan(used):
        return 1e7
    return 9999 + 1e4 * math.log(used - limit + 1) if used >= limit else -eps * math.log(limit - used)


def search(counts: Counts, limit: float, *, coefficients: Sequence[float], weights: Mapping[str, float] | None = None, sweeps: int = 200) -> dict[str, tuple[float, ...]]:
    """Computed parameters with little loss whose counts stay strictly below the limit.

    Starts from the parameters of fewest probes of each dataset and walks, one dataset at a time, to the computed
    neighbour that lowers the loss most for the probes it costs, until none fits; then single moves of any length.
    """
    weights = weights or dict.fromkeys(counts, 1.0)
    at = {d: min(c, key=lambda k: (c[k], k)) for d, c in counts.items()}
    used = sum(counts[d][x] for d, x in at.items())
    if used >= limit:
        raise OverLimit(f"{used:g} probes at least; the limit is {limit:g}")
    own = lambda d, x: weights[d] * sum(c * v * v for c, v in zip(coefficients, x, strict=True))
    for _ in range(sweeps * len(counts)):
        best, value = None, 0.0
        for d, table in counts.items():
            for x, n in table.items():
                less, more = own(d, at[d]) - own(d, x), n - table[at[d]]
                if less > 1e-12 and used + more < limit and (gain := less / max(more, 0.5)) > value:
                    best, value = (d, x), gain
        if best is None:
            break
        used += counts[best[0]][best[1]] - counts[best[0]][at[best[0]]]
        at[best[0]] = best[1]
    return at


def standard(counts: Counts, limit: float, *, rounding: tuple[float, float] = (1, 10), weights: Mapping[str, float] | None = None, coefficients: Sequence[float] = (1.0, 0.01)) -> dict[str, tuple[float, ...]]:
    """Two parameters (mismatches, extension): the search, then exchanges of single datasets, then rounding."""
    weights = weights or dict.fromkeys(counts, 1.0)
    at = search(counts, limit, coefficients=coefficients, weights=weights)
    return rounded(counts, improved(counts, at, limit, weights, coefficients), limit, rounding, weights, coefficients)


def improved(counts: Counts, at: dict[str, tuple[float, ...]], limit: float, weights: Mapping[str, float], coefficients: Sequence[float]) -> dict[str, tuple[float, ...]]:
    """Exchanges: one dataset gives up probes so that another gains more."""
    at = dict(at)
    own = lambda d, x: weights[d] * sum(c * v * v for c, v in zip(coefficients, x, strict=True))
    used = sum(counts[d][x] for d, x in at.items())
    moved = True
    while moved:
        moved = False
        moves = [(d, x, own(d, x) - own(d, at[d]), n - counts[d][at[d]]) for d, c in counts.items() for x, n in c.items() if x != at[d]]
        gains = sorted((m for m in moves if m[2] < 0), key=lambda m: m[2])
        gives = sorted((m for m in moves if m[3] < 0), key=lambda m: m[2])
        for d, x, less, more in gains:
            pair = next((g for g in [(None, None, 0.0, 0.0), *gives] if g[0] != d and less + g[2] < -1e-9 and used + more + g[3] < limit), None)
            if pair:
                at[d] = x
                used += more + pair[3]
                if pair[0]:
                    at[pair[0]] = pair[1]
                moved = True
                break
    return at


def rounded(counts: Counts, at: Mapping[str, Sequence[float]], limit: float, rounding: Sequence[float], weights: Mapping[str, float], coefficients: Sequence[float], eps: float = 0.01) -> dict[str, tuple[float, ...]]:
    """Parameters as multiples of ``rounding``: down if within eps of one, else up; then single steps down with least loss while strictly below the limit."""
    snap = lambda v, b: math.floor(v / b) * b if v - math.floor(v / b) * b <= eps else math.ceil(v / b) * b
    out = {d: tuple(float(snap(v, b)) for v, b in zip(x, rounding, strict=True)) for d, x in at.items()}
    most = {d: tuple(max(k[i] for k in counts[d]) for i in range(len(rounding))) for d in counts}
    out = {d: tuple(min(v, m) for v, m in zip(x, most[d], strict=True)) for d, x in out.items()}
    if total(counts, out) >= limit:
        raise OverLimit("rounding goes over the limit")
    while True:
        best, value = None, math.inf
        for d, x in out.items():
            for i, b in enumerate(rounding):
                y = tuple(v - b if j == i else v for j, v in enumerate(x))
                try:
                    trial = {**out, d: y}
                    if y[i] < 0 or total(counts, trial) >= limit:
                        continue
                except ValueError:
                    continue
                if (now := loss(trial, weights, coefficients)) < value:
                    best, value = (d, y), now
        if best is None:
            return out
        out[best[0]] = best[1]


def descended(counts: Counts, limit: float, *, coefficients: Sequence[float], weights: Mapping[str, float] | None = None, seed: int = 0, steps: int = 400) -> dict[str, tuple[float, ...]]:
    """Any parameters between computed ones: projected descent on the loss with a falling log barrier, from a computed start."""
    weights = weights or dict.fromkeys(counts, 1.0)
    start = search(counts, limit, coefficients=coefficients, weights=weights)
    names = sorted(counts)
    low = np.array([[min(k[i] for k in counts[d]) for i in range(len(coefficients))] for d in names])
    high = np.array([[max(k[i] for k in counts[d]) for i in range(len(coefficients))] for d in names]) - 0.001
    high = np.maximum(high, low)
    x = np.clip(np.array([start[d] for d in names]), low, high)
    rng = np.random.default_rng(seed)

    def value(y: np.ndarray, eps: float) -> float:
        at = {d: tuple(r) for d, r in zip(names, y, strict=True)}
        try:
            return loss(at, weights, coefficients) + barrier(total(counts, at), limit, eps)
        except ValueError:
            return 1e7

    best = x
    for eps in (10, 1, 0.1, 0.01):
        now = value(x, eps)
        step = (high - low) * 0.1
        for _ in range(steps):
            i, j = rng.integers(len(names)), rng.integers(len(coefficients))
            y = x.copy()
            y[i, j] = np.clip(y[i, j] + rng.choice((-1, 1)) * step[i, j] * rng.random(), low[i, j], high[i, j])
            if (other := value(y, eps)) < now:
                x, now = y, other
        best = x
    out = {d: tuple(map(float, r)) for d, r in zip(names, best, strict=True)}
    if total(counts, out) >= limit:
        return {d: tuple(v) for d, v in start.items()}
    return out

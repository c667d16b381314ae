"""Spherical and one-dimensional k-means, their initialisations, and outlier annealing.

Each step sends the centers to all tasks (k * d numbers, a parameter of the model, not of the
data) and brings back one partial sum per task and center.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.sampling import bottom_k
from orrery.operators.search import stacked

EPS = 1e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n * n < EPS, x, x / np.maximum(n, 1e-300))


@dataclass
class KMeansModel:
    centers: np.ndarray
    cost: float
    rounds: int


def partial_sums(vectors: DataFrame, centers: np.ndarray, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Per center the weighted sum and weight of the unit vectors assigned to it, and the weighted mean of 1 - dot."""
    k, d = centers.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights, cost = np.zeros((k, d)), np.zeros(k), 0.0
        for batch in batches:
            x = unit_rows(stacked(batch.column(0)))
            w = batch.column(1).to_numpy() if weight else np.ones(len(x))
            score = x @ centers.T
            at = np.argmax(np.round(score, 12), axis=1)
            np.add.at(sums, at, w[:, None] * x)
            np.add.at(weights, at, w)
            cost += float((w * (1 - score[np.arange(len(x)), at])).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(sums), pa.list_(pa.float64())), pa.array(weights), pa.array([cost] + [0.0] * (k - 1))], ["code", "s", "w", "cost"])

    parts = vectors.select("x", *([weight] if weight else [])).mapInArrow(part, "code long, s array<double>, w double, cost double")
    rows = parts.groupBy("code").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"), F.sum("w").alias("w"), F.sum("cost").alias("cost")).orderBy("code").collect()  # k rows
    sums, weights = np.array([r["s"] for r in rows]), np.array([r["w"] for r in rows])
    return sums, weights, sum(r["cost"] for r in rows) / max(weights.sum(), EPS)


def spherical_kmeans(vectors: DataFrame, centers: np.ndarray, rounds: int = 10, tolerance: float = 1e-6, weight: str | None = None, seed: int = 1) -> KMeansModel:
    """From given centers: assign by the greatest dot product, average, renormalise. A center without vectors takes a sampled one."""
    centers = unit_rows(np.asarray(centers, dtype=np.float64))
    last = np.inf
    for done in range(1, rounds + 1):
        sums, weights, cost = partial_sums(vectors, centers, weight)
        empty = weights <= 0
        centers = unit_rows(np.where(empty[:, None], centers, sums / np.maximum(weights, EPS)[:, None]))
        if empty.any():
            spare = bottom_k(vectors.select("vec_id", "x"), int(empty.sum()), seed=seed + done).select("x").toArrow()
            got = unit_rows(stacked(spare.column(0).combine_chunks()))
            centers[np.flatnonzero(empty)[: len(got)]] = got
        if abs(last - cost) < tolerance:
            break
        last = cost
    return KMeansModel(centers, cost, done)


def init_random(vectors: DataFrame, k: int, seed: int = 12345) -> np.ndarray:
    return stacked(bottom_k(vectors.select("vec_id", "x"), k, seed=seed).orderBy("vec_id").select("x").toArrow().column(0).combine_chunks())


def plus_plus(x: np.ndarray, k: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ on unit vectors by D^2 = 2 - 2 * (best dot so far)."""
    rng = np.random.default_rng(seed)
    x, w = unit_rows(x), np.ones(len(x)) if weights is None else weights
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        d2 = w * np.maximum(2 - 2 * best, 0)
        d2[chosen] = 0
        if d2.sum() <= 0:
            d2 = np.ones(len(x))
            d2[chosen] = 0
        chosen.append(int(rng.choice(len(x), p=d2 / d2.sum())))
        best = np.maximum(best, x @ x[chosen[-1]])
    return x[chosen]


def init_plus_plus(vectors: DataFrame, k: int, samples: int = 4096, seed: int = 1) -> np.ndarray:
    """k-means++ over a bounded sample."""
    return plus_plus(init_random(vectors, max(k, samples), seed), k, seed)


def init_parallel(vectors: DataFrame, k: int, rounds: int = 3, oversample: float = 2.0, seed: int = 1) -> np.ndarray:
    """k-means||: rounds of keeping each vector with chance l d^2 / sum d^2, by a hash of its id, then k-means++ over what was kept."""
    found = unit_rows(init_random(vectors, 1, seed))
    most = int(min(16 * k, 1_000_000))
    for r in range(rounds):
        held = found

        def distances(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit_rows(stacked(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.maximum(2 - 2 * (x @ held.T).max(1), 0))], ["vec_id", "x", "d2"])

        near = vectors.select("vec_id", "x").mapInArrow(distances, "vec_id long, x array<double>, d2 double")
        phi = near.agg(F.sum("d2")).first()[0] or 0.0
        if phi <= 0:
            break
        chance = F.pmod(F.xxhash64("vec_id", F.lit(seed + r)), F.lit(1 << 30)) / float(1 << 30)
        # Beyond the method's own limit those with the smallest hashes stay, whatever their ids.
        kept = near.where(chance < oversample * k * F.col("d2") / phi).orderBy(chance, "vec_id").limit(most).orderBy("vec_id").select("x").toArrow()
        if kept.num_rows:
            found = np.vstack([found, unit_rows(stacked(kept.column(0).combine_chunks()))])
    if len(found) < k:
        found = np.vstack([found, unit_rows(init_random(vectors, k, seed + 99))])
    return plus_plus(found, k, seed)


def lower_quantile(rows: DataFrame, value: str, q: float) -> Column | float:
    """The value of rank floor(q (n - 1)), from 0, in ascending order. Exact, by a histogram of distinct values' ranks."""
    n = rows.count()
    at = int(q * (n - 1))
    # Counts of equal values are few beside the rows; the running count is taken over ranges of values, not one sort.
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    edges = counted.select(F.expr(f"percentile_approx({value}, array({', '.join(str(i / 32) for i in range(1, 32))}))").alias("e")).first()["e"] or []
    bucket = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    sums = dict(counted.withColumn("b", bucket).groupBy("b").agg(F.sum("n")).collect())  # a row per bucket
    b = 0
    for b in sorted(sums):
        if at < sums[b]:
            break
        at -= sums[b]
    w = Window.orderBy(value)
    inside = counted.withColumn("b", bucket).where(F.col("b") == b)
    return inside.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") > at).agg(F.min(value)).first()[0]


def histogram_quantile(rows: DataFrame, cost: str, q: float, bins: int = 200) -> DataFrame:
    """The upper edge of the first bin over [0, 2] up to which a share q of the rows lies."""
    counts = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(cost) / 2 * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin")
    run = counts.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return run.where(F.col("upto") >= q * F.col("total")).agg(((F.min("bin") + 1) * 2.0 / bins).alias("threshold"))


def anneal(rows: DataFrame, threshold: float, factor: float, floor: float, weight: str = "w", cost: str = "cost") -> DataFrame:
    """Outliers weigh less and inliers more, within [floor, 1]."""
    out = F.greatest(F.lit(floor), F.col(weight) * (1 - factor))
    return rows.withColumn(weight, F.when(F.col(cost) > threshold, out).otherwise(F.least(F.lit(1.0), F.col(weight) * (1 + factor / 2))))


def annealing_factor(factor: float, it: int, warmup: int, rounds: int) -> float:
    return 0.0 if it <= warmup else factor * (1 - float(np.exp(-(it - warmup) / max(1, rounds - warmup))))


def mixed_bits(x: int) -> int:
    """The mixing steps of splitmix64."""
    most = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & most
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & most
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & most
    return x ^ (x >> 31)


def farthest_first(x: np.ndarray, k: int, start: int) -> np.ndarray:
    """From row `start`, each time the row farthest from those chosen, never one of them; ties to the first."""
    chosen = [start]
    d = ((x - x[start]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        d[chosen] = -1.0
        chosen.append(int(np.argmax(np.round(d, 12))))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def euclidean_kmeans(x: np.ndarray, k: int, rounds: int, code: int = 0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's means from a farthest-first start, whose first row the seed and the root code draw; an empty center takes the row of the largest error."""
    centers = farthest_first(x, k, mixed_bits(seed ^ code) % len(x))
    for _ in range(rounds):
        d = ((x[:, None] - centers) ** 2).sum(2)
        at = np.argmin(d, axis=1)
        for c in range(len(centers)):
            if (at == c).any():
                centers[c] = x[at == c].mean(0)
            else:
                centers[c] = x[int(np.argmax(d[np.arange(len(x)), at]))]
    return centers, np.argmin(((x[:, None] - centers) ** 2).sum(2), axis=1)


def scalar_kmeans(values: np.ndarray, k: int, rounds: int = 25, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-dimensional k-means from quantiles i n / k of the sorted values; stops when no center moves by 1e-6. counts tells how often each value stands for a row."""
    order = np.argsort(values, kind="stable")
    v = np.asarray(values, dtype=np.float64)[order]
    n = np.ones(len(v)) if counts is None else np.asarray(counts, dtype=np.float64)[order]
    w = n if weights is None else n * np.asarray(weights, dtype=np.float64)[order]
    centers = v[np.minimum(np.searchsorted(np.cumsum(n), np.floor(np.arange(k) * n.sum() / k), side="right"), len(v) - 1)].copy()
    for _ in range(rounds):
        at = np.searchsorted((centers[1:] + centers[:-1]) / 2, v, side="left")
        total, mass = np.bincount(at, w * v, k), np.bincount(at, w, k)
        moved = np.where(mass > 0, total / np.maximum(mass, 1e-300), centers)
        moved.sort()
        done = np.abs(moved - centers).max() < 1e-6
        centers = moved
        if done:
            break
    return centers, np.searchsorted((centers[1:] + centers[:-1]) / 2, np.asarray(values), side="left")


def tail_weights(values: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """4 above the 99th percentile of the rows, 16 above the 99.9th."""
    if counts is None:
        hi, top = np.quantile(values, [0.99, 0.999])
    else:
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(counts[order]) / counts.sum()
        hi, top = (values[order][min(int(np.searchsorted(upto, q)), len(values) - 1)] for q in (0.99, 0.999))
    return np.where(values > top, 16.0, np.where(values > hi, 4.0, 1.0))

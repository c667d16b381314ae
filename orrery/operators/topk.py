"""Ordered selections: top-k by window, where the planner limits each group before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, key: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key, ranked from 1."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def nearest(rows: DataFrame, k: int, key: str = "qid", dist: str = "dist", ident: str = "vec_id") -> DataFrame:
    """The k nearest per query, ties by id."""
    return top_k(rows, key, [F.col(dist), F.col(ident)], k)


def merge_top_k(parts: list[DataFrame], k: int, key: str = "qid") -> DataFrame:
    """Top-k of several tables that hold the top-k of their parts."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return nearest(rows.drop("rank"), k, key)


def pad(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows per query: what is missing has id -1 at an infinite distance."""
    wanted = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    filled = wanted.join(ranked.select("qid", "rank", "vec_id", "dist"), ["qid", "rank"], "left")
    return filled.select("qid", "rank", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


def pareto(runs: DataFrame, speed: str = "qps", quality: str = "recall", eps: float = 1e-12) -> DataFrame:
    """Runs that no other beats in speed and quality. The runs of a grid are few; each is held against all."""
    other = runs.select(F.col(speed).alias("s"), F.col(quality).alias("q"))
    better = (F.col("s") >= F.col(speed) - eps) & (F.col("q") >= F.col(quality) - eps) & ((F.col("s") > F.col(speed) + eps) | (F.col("q") > F.col(quality) + eps))
    return runs.join(F.broadcast(other), better, "left_anti").orderBy(F.desc(speed))

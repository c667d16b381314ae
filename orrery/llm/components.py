"""Connected components of a table of links, without gathering any of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import spool, unspool

#: Links that a task contracts at once.
CONTRACTED = 1 << 20


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node of a link between two whole numbers.

    Each task contracts what it reads to stars around the smallest nodes, by itself. What spans
    tasks takes large-star and small-star steps in turn: a node's greater neighbours are linked
    to the smallest node it knows of, then its smaller ones. It ends when only stars are left.
    Rows never outnumber the links, and a step aggregates a node's neighbours with a map-side
    combine, so that hubs need no large task. Null ends and links of a node to itself are left out.
    """
    edges = spool(_contracted(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")), "edges")
    while not _only_stars(edges):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        stepped = spool(small, "edges")
        unspool(edges)
        edges = spool(_contracted(stepped), "edges")
        unspool(stepped)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_stars, "u long, v long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, some at a time, as one link from each node to the smallest that they connect it to."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([*held, np.zeros((2, 0), np.int64)], axis=1), return_inverse=True)
        held.clear()
        u, v = at.reshape(2, -1)
        low = np.arange(len(nodes))
        while (low[u] != low[v]).any():  # every tree with a neighbour joins one, so the trees halve at least
            least = np.minimum(low[u], low[v])
            np.minimum.at(low, np.concatenate([low[u], low[v]]), np.concatenate([least, least]))
            while (low != low[low]).any():
                low = low[low]
        leaf = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[low[leaf]])], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
        if sum(x.shape[1] for x in held) >= CONTRACTED:
            yield stars()
    yield stars()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(0).alias("into")).union(edges.select("v", F.lit(None).cast("long"), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.max("into").alias("into"))
    return not nodes.agg(F.max((F.col("x").isNotNull()) & ((F.col("x") < F.col("y")) | (F.col("into") > 0)))).first()[0]

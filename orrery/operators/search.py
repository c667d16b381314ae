"""Nearest-neighbour joins: exact scans, list probes, table-lookup scans, and rerank.

The stated side (queries, centers) is a block of checked size held by every task; the base is
read once, in Arrow batches, and each batch keeps its own top-k per query, so that what is
shuffled is queries * k rows per batch however large the base is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import add, dot, l2sq, norm2, scale
from orrery.operators.topk import nearest, top_k

#: Bytes of the block that every task holds, at most; larger sets of queries or centers are gone through block by block.
MOST_BLOCK_BYTES = 64 << 20


class BlockTooLarge(ValueError):
    """A side that every task would hold is larger than its limit."""


def matrix(rows: DataFrame, ident: str, x: str, most: int = MOST_BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a table whose size is checked before it is gathered."""
    head = rows.select(x).first()
    width = 8 * (len(head[0]) if head else 1)
    limit = max(1, most // width)
    got = rows.select(ident, x).limit(limit + 1).toArrow()
    if got.num_rows > limit:
        raise BlockTooLarge(f"more than {limit} vectors; split them into blocks")
    ids = got.column(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], stacked(got.column(1).combine_chunks())[order]


def stacked(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def listed(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    flat = pa.array(np.ascontiguousarray(rows).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def exact_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest base vectors of each query: qid, rank, vec_id, dist; ties by id. metric is l2 (squared) or ip (negated)."""
    return _union([_exact_block(base, block, k, metric) for block in blocks(queries, "qid", "q")])


def blocks(rows: DataFrame, ident: str, x: str, most: int | None = None) -> list[DataFrame]:
    """rows by ranges of their ids, each range small enough to be held by every task."""
    head = rows.select(x).first()
    limit = max(1, (most or MOST_BLOCK_BYTES) // (8 * (len(head[0]) if head else 1)))
    n = rows.count()
    if n <= limit:
        return [rows]
    # Ends of ranges with half the limit in each, which leaves room for what the quantiles lack in precision.
    parts = -(-2 * n // limit)
    ends = rows.select(F.expr(f"percentile_approx({ident}, array({', '.join(str(i / parts) for i in range(1, parts))}), 100000)").alias("e")).first()["e"]
    edges = [None, *sorted(set(ends)), None]
    return [rows.where((F.lit(True) if a is None else F.col(ident) > a) & (F.lit(True) if b is None else F.col(ident) <= b)) for a, b in zip(edges, edges[1:])]


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def _exact_block(base: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    qids, q = matrix(queries, "qid", "q")
    q2 = (q * q).sum(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), stacked(batch.column(1))
            if not len(ids) or not len(qids):
                continue
            d = -(q @ x.T) if metric == "ip" else np.maximum(q2[:, None] + (x * x).sum(1) - 2 * (q @ x.T), 0.0)
            n = min(k, len(ids))
            # What ties with the k-th could still come first by id, so all of it stays for the merge.
            edge = np.partition(d, n - 1, axis=1)[:, n - 1 : n] + 1e-9
            row, col = np.nonzero(d <= edge)
            dist = -(q[row] * x[col]).sum(1) if metric == "ip" else ((q[row] - x[col]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[col]), pa.array(dist)], ["qid", "vec_id", "dist"])

    kind = dict(base.dtypes)["vec_id"]
    return nearest(base.select("vec_id", "x").mapInArrow(scan, f"qid long, vec_id {kind}, dist double"), k)


def assign(rows: DataFrame, centers: DataFrame, ident: str = "vec_id", x: str = "x") -> DataFrame:
    """The center with the greatest dot product for each row, ties to the lowest: ident, code, dot."""
    parts = [_assign_block(rows, block, ident, x) for block in blocks(centers, "cid", "c")]
    if len(parts) == 1:
        return parts[0]
    return top_k(_union(parts), ident, [F.desc("dot"), F.col("code")], 1, "nth").drop("nth")


def _assign_block(rows: DataFrame, centers: DataFrame, ident: str, x: str) -> DataFrame:
    codes, c = matrix(centers, "cid", "c")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = stacked(batch.column(1)) @ c.T
            at = np.argmax(score, axis=1) if len(score) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes[at].astype(np.int64)), pa.array(score[np.arange(len(at)), at])], [ident, "code", "dot"])

    return rows.select(ident, x).mapInArrow(best, f"{ident} {dict(rows.dtypes)[ident]}, code long, dot double")


def assign_two_level(rows: DataFrame, centers: DataFrame, group_size: int, n_groups: int) -> DataFrame:
    """As `assign`, but only within the n_groups groups of centers whose mean fits best. Groups are runs of group_size centers."""
    codes, c = matrix(centers, "cid", "c")
    groups = [np.arange(i, min(i + group_size, len(codes))) for i in range(0, len(codes), group_size)]
    means = np.stack([c[g].mean(0) for g in groups])
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column(1))
            coarse = np.argsort(-(x @ means.T), axis=1, kind="stable")[:, :n_groups]
            allowed = (coarse[:, :, None] == group_of[None, None, :]).any(1)
            score = np.where(allowed, x @ c.T, -np.inf)
            at = np.argmax(score, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes[at].astype(np.int64)), pa.array(score[np.arange(len(at)), at])], ["vec_id", "code", "dot"])

    return rows.select("vec_id", "x").mapInArrow(best, "vec_id long, code long, dot double")


def probe(queries: DataFrame, centers: DataFrame, nprobe: int) -> DataFrame:
    """The lists to look into: the nprobe greatest <q, c> / |c| of each query. Lists without a direction are left out."""
    scored = queries.crossJoin(F.broadcast(centers.where(norm2("c") > 0))).select("qid", "q", "cid", (dot("q", "c") / F.sqrt(norm2("c"))).alias("score"))
    return top_k(scored, "qid", [F.desc("score"), F.col("cid")], nprobe, "probe_rank")


def probe_two_level(queries: DataFrame, centers: DataFrame, group_of: DataFrame, n_groups: int, nprobe: int, by_norm: bool = False) -> DataFrame:
    """Probes only the lists of each query's best groups. group_of: cid, grp, and the group's center g."""
    groups = group_of.select("grp", "g").dropDuplicates(["grp"])
    score = 2 * dot("q", "g") - norm2("g") if by_norm else dot("q", "g")
    coarse = top_k(queries.crossJoin(F.broadcast(groups)).withColumn("gs", score), "qid", [F.desc("gs"), F.col("grp")], n_groups, "gr")
    members = group_of.select("grp", "cid").join(centers, "cid")
    scored = coarse.select("qid", "q", "grp").join(members, "grp").select("qid", "q", "cid", (dot("q", "c") / F.sqrt(norm2("c"))).alias("score"))
    return top_k(scored, "qid", [F.desc("score"), F.col("cid")], nprobe, "probe_rank")


def probe_graph(queries: DataFrame, centers: DataFrame, nprobe: int, neighbours: int = 16, ef: int = 64) -> DataFrame:
    """As `probe`, by walking a graph of the centers instead of scoring all of them: qid, cid, score, probe_rank.

    Centers are linked to their `neighbours` nearest by cosine, both ways, and along the order of
    ids, which keeps the graph in one piece. A walk holds the ef best centers seen and goes on from
    the best not yet left, until none of these could improve what it holds.
    """
    import heapq

    codes, c = matrix(centers.where(norm2("c") > 0), "cid", "c")
    unit = c / np.linalg.norm(c, axis=1, keepdims=True) if len(c) else c
    links: list[set[int]] = [set() for _ in codes]
    for at in range(0, len(codes), 1024):
        score = unit[at : at + 1024] @ unit.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        for i, row in enumerate(np.argsort(-score, axis=1, kind="stable")[:, : min(neighbours, len(codes) - 1)], at):
            for j in row.tolist():
                links[i].add(j)
                links[j].add(i)
    for i in range(1, len(codes)):
        links[i].add(i - 1)
        links[i - 1].add(i)
    near = [np.array(sorted(x), dtype=np.int64) for x in links]
    ef = max(ef, nprobe)

    def walk(q: np.ndarray) -> list[tuple[float, int]]:
        first = float(unit[0] @ q)
        seen, open_, best = {0}, [(-first, 0)], [(first, 0)]
        while open_:
            score, at = heapq.heappop(open_)
            if len(best) >= ef and -score < best[0][0]:
                break
            new = [j for j in near[at].tolist() if j not in seen]
            seen.update(new)
            for j, s in zip(new, (unit[new] @ q).tolist() if new else []):
                if len(best) < ef or s > best[0][0]:
                    heapq.heappush(open_, (-s, j))
                    heapq.heappush(best, (s, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted(((s, int(codes[-j])) for s, j in best), key=lambda x: (-x[0], x[1]))[:nprobe]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, cid, s, r + 1) for i, q in zip(batch.column(0).to_pylist(), stacked(batch.column(1))) for r, (s, cid) in enumerate(walk(q) if len(codes) else [])]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["qid", "cid", "score", "probe_rank"])

    return queries.select("qid", "q").mapInArrow(walked, "qid long, cid long, score double, probe_rank int")


def in_list_knn(rows: DataFrame, k: int, key: str = "cid", ident: str = "vec_id") -> DataFrame:
    """The k nearest others within each list: cid, ident, neighbour, rank, dist2."""

    def near(part: pa.Table) -> pa.Table:
        ids, x = part.column(ident).to_numpy(), stacked(part.column("x").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        near_k = min(k, len(ids) - 1)
        found, exact = [np.zeros((0, near_k), dtype=np.int64)], [np.zeros((0, near_k))]
        for at in range(0, len(ids), 1024):  # blocks of rows against the list, in ids' order so that ties keep it
            d = np.maximum((x[at : at + 1024] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[at : at + 1024] @ x.T, 0.0)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            best = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :near_k]
            found.append(best)
            exact.append(((x[at : at + 1024, None] - x[best]) ** 2).sum(2) if near_k else np.zeros((len(d), 0)))
        cid, n = part.column(key)[0].as_py(), len(ids) * near_k
        ranks = np.tile(np.arange(1, near_k + 1), len(ids))
        return pa.table({
            key: pa.array(np.full(n, cid), pa.int64()), ident: pa.array(np.repeat(ids, near_k), pa.int64()), "neighbour": pa.array(ids[np.concatenate(found).ravel()], pa.int64()),
            "rank": pa.array(ranks, pa.int32()), "dist2": pa.array(np.concatenate(exact).ravel(), pa.float64()),
        })

    narrow = rows.select(F.col(key).cast("long").alias(key), F.col(ident).cast("long").alias(ident), "x")
    return narrow.groupBy(key).applyInArrow(near, f"{key} long, {ident} long, neighbour long, rank int, dist2 double")


def reconstructed(encoded: DataFrame) -> DataFrame:
    """Adds xh, the sum of each layer's coefficient times its codeword."""
    return encoded.withColumn("xh", add(scale("c", F.col("a0")), scale("atom", F.col("a1"))))


def adc_scan(encoded: DataFrame, queries: DataFrame, centers: DataFrame, atoms: DataFrame, k: int, probes: DataFrame | None = None) -> DataFrame:
    """Top-k by table lookup: dot products of queries with codewords once, then sums per code: qid, rank, vec_id, dist.

    dist is |xh|^2 - 2 <q, xh>, the squared distance less |q|^2, which is the same for all of a
    query's rows. encoded has vec_id, cid, code1, a0, a1, norm and is read once, in batches that
    keep their own top-k. With probes, only the lists probed are read; a query whose lists hold
    fewer than k rows scans everything.
    """
    return _union([_adc_block(encoded, block, centers, atoms, k, probes) for block in blocks(queries, "qid", "q")])


def _adc_block(encoded: DataFrame, queries: DataFrame, centers: DataFrame, atoms: DataFrame, k: int, probes: DataFrame | None) -> DataFrame:
    qids, q = matrix(queries, "qid", "q")
    (cids, c), (codes, a) = matrix(centers, "cid", "c"), matrix(atoms, "code", "atom")
    root, small = q @ c.T, q @ a.T
    allowed = np.ones((len(qids), len(cids)), dtype=bool)
    rows = encoded.select("vec_id", "cid", "code1", "a0", "a1", "norm")
    if probes is not None:
        sizes = dict(encoded.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per list, as many as centers
        pairs = probes.join(queries.select("qid"), "qid", "left_semi").select("qid", "cid").toArrow()  # at most queries x lists, both of checked size
        allowed[:] = False
        allowed[np.searchsorted(qids, pairs.column(0).to_numpy()), np.searchsorted(cids, pairs.column(1).to_numpy())] = True
        allowed[allowed @ np.array([sizes.get(int(x), 0) for x in cids]) < k] = True
        wanted = cids[allowed.any(0)]
        if len(wanted) < len(cids):
            rows = rows.where(F.col("cid").isin([int(x) for x in wanted]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cid, code, a0, a1, norm = (batch.column(i).to_numpy() for i in range(6))
            if not len(ids) or not len(qids):
                continue
            at, layer = np.searchsorted(cids, cid), np.searchsorted(codes, code)
            d = np.round(norm - 2 * (a0 * root[:, at] + a1 * small[:, layer]), 12)
            d[~allowed[:, at]] = np.inf
            n = min(k, len(ids))
            row, col = np.nonzero((d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]) & np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[col]), pa.array(d[row, col])], ["qid", "vec_id", "dist"])

    return nearest(rows.mapInArrow(scan, "qid long, vec_id long, dist double"), k)


def rerank(shortlist: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A shortlist in the order of true squared distances."""
    near = shortlist.select("qid", "vec_id").distinct().join(base.select("vec_id", "x"), "vec_id").join(F.broadcast(queries), "qid")
    return nearest(near.select("qid", "vec_id", l2sq("q", "x").alias("dist")), k)

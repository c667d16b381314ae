"""Residual forests within lists: parents, depths, reconstruction along parents.

Forests are tables of parent pointers. Depths come from pointer doubling, in as many joins as
the logarithm of the depth. What has to see a whole list at once runs per list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.encoding import Codebooks, greedy_abs, iterated_local_search
from orrery.operators.search import blocks, in_list_knn, listed, matrix, stacked
from orrery.operators.topk import top_k
from orrery.sources.stores import spooled


def radial_layers(rows: DataFrame, inner_share: float, n_layers: int, cid: str = "cid", cos: str = "cos", ident: str = "vec_id") -> DataFrame:
    """Layer 0 has the first max(1, floor(p n)) by cosine; the rest is split evenly, extras to the earliest layers."""
    nth = F.row_number().over(Window.partitionBy(cid).orderBy(F.desc(cos), F.col(ident))) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(cid))
    first = F.greatest(F.lit(1), F.floor(inner_share * n))
    rest, outer = n - first, n_layers - 1
    small, extra = F.floor(rest / outer), rest % outer
    place = nth - first
    layer = F.when(place < extra * (small + 1), 1 + F.floor(place / (small + 1))).otherwise(1 + extra + F.floor((place - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return rows.withColumn("layer", F.when(nth < first, F.lit(0)).otherwise(layer).cast("int"))


def candidates(knn: DataFrame, layers: DataFrame, depth_k: int, per_layer: int) -> DataFrame:
    """Neighbours in inner layers within depth_k layers, the nearest per_layer of each layer: vec_id, parent, layer, dist2."""
    own = layers.select("vec_id", F.col("layer").alias("own"))
    other = layers.select(F.col("vec_id").alias("neighbour"), "layer")
    rows = knn.join(own, "vec_id").join(other, "neighbour").where((F.col("layer") < F.col("own")) & (F.col("layer") >= F.col("own") - depth_k))
    best = top_k(rows.withColumn("d", F.round("dist2", 12)), ["vec_id", "layer"], [F.col("d"), F.col("neighbour")], per_layer, "nth")
    return best.select("vec_id", F.col("neighbour").alias("parent"), "layer", "dist2")


def nearest_parents(vectors: DataFrame) -> DataFrame:
    """Each vector's nearest other of its list, ties to the lowest id; a list's only vector has none."""
    near = in_list_knn(vectors, 1).select("vec_id", F.col("neighbour").alias("parent"))
    return vectors.select("vec_id", "cid").join(near, "vec_id", "left")


def cut_mutual(parents: DataFrame) -> DataFrame:
    """Of two vectors that are each other's parent, the one with the lower id becomes a root. Nearest neighbours have no other cycles."""
    back = parents.select(F.col("vec_id").alias("parent"), F.col("parent").alias("grandparent"))
    joined = parents.join(back, "parent", "left")
    root = (F.col("grandparent") == F.col("vec_id")) & (F.col("vec_id") < F.col("parent"))
    return joined.select("vec_id", "cid", F.when(root, F.lit(None)).otherwise(F.col("parent")).alias("parent"))


def depths(parents: DataFrame) -> DataFrame:
    """Depth and root of each vector by pointer doubling: every round joins the table with itself once, until no pointer moves."""
    rows = spooled(parents.select("vec_id", F.coalesce("parent", "vec_id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    for _ in range(rows.count().bit_length() + 1):  # a path is no longer than the rows
        above = rows.select(F.col("vec_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        joined = rows.join(above, "up").select("vec_id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        rows = spooled(joined, "depths", rows)
        if rows.where("moved").isEmpty():
            return rows.select("vec_id", F.col("up").alias("root"), "depth")
    raise ValueError("the parents form a cycle")


def sums_along_parents(rows: DataFrame) -> DataFrame:
    """vec_id and y, the sum of the arrays y of a row and all its ancestors, of rows with vec_id, parent and y: with each doubling a row takes on its ancestor's sum."""
    rows = spooled(rows.select("vec_id", F.col("parent").alias("up"), "y"), "sums")
    for _ in range(rows.count().bit_length() + 2):
        if rows.where("up is not null").isEmpty():
            return rows.select("vec_id", "y")
        above = rows.select(F.col("vec_id").alias("up"), F.col("up").alias("next"), F.col("y").alias("more"))
        total = F.when(F.col("more").isNull(), F.col("y")).otherwise(F.zip_with("y", "more", lambda a, b: a + b))
        rows = spooled(rows.join(above, "up", "left").select("vec_id", F.col("next").alias("up"), total.alias("y")), "sums", rows)
    raise ValueError("the parents form a cycle")


def subtree_sizes(parents: DataFrame) -> DataFrame:
    """vec_id and size, the number of rows of its tree from there on: sums go up level by level, each level's rows once."""
    rows = spooled(parents.select("vec_id", "parent").join(depths(parents).select("vec_id", "depth"), "vec_id"), "levels")
    most = rows.agg(F.max("depth")).first()[0]
    done, below = None, None
    for level in range(most if most is not None else -1, -1, -1):
        here = rows.where(F.col("depth") == level).select("vec_id", "parent")
        if below is None:
            sized = here.withColumn("size", F.lit(1).cast("long"))
        else:
            more = below.groupBy(F.col("parent").alias("vec_id")).agg(F.sum("size").alias("more"))
            sized = here.join(more, "vec_id", "left").select("vec_id", "parent", (F.coalesce("more", F.lit(0)) + 1).alias("size"))
        below = spooled(sized, "sizes")
        done = below if done is None else done.unionByName(below)
    return (done if done is not None else rows.withColumn("size", F.lit(1).cast("long"))).select("vec_id", "size")


def cut_deep(parents: DataFrame, max_depth: int) -> DataFrame:
    """Vectors whose depth would pass max_depth start trees of their own."""
    deep = depths(parents).select("vec_id", "depth")
    joined = parents.join(deep, "vec_id")
    level = F.col("depth") % (max_depth + 1)
    return joined.select("vec_id", "cid", F.when(level == 0, F.lit(None)).otherwise(F.col("parent")).alias("parent"), level.alias("depth"))


def random_parent(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A parent for each place of a list of n, never itself, from the mixed bits of seed and place."""
    x = i.astype(np.uint64) ^ np.uint64(seed)
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    if n < 2:
        return np.full(len(i), -1)
    p = (x % np.uint64(n - 1)).astype(np.int64)
    return p + (p >= i)


def cut_cycles(parent: np.ndarray) -> np.ndarray:
    """The lowest node of each cycle of a parent array (-1: none) becomes a root.

    After n or more steps along the pointers, the nodes that are still reached are those on
    cycles; the least node met on the way is, for them, the least of their cycle. Pointers and
    minima are doubled, for all nodes at once.
    """
    n = len(parent)
    up = np.append(np.where(parent < 0, n, parent), n)
    least = np.arange(n + 1)
    for _ in range(n.bit_length() + 1):
        least = np.minimum(least, least[up])
        up = up[up]
    on_cycle = np.zeros(n + 1, dtype=bool)
    on_cycle[up] = True
    return np.where(on_cycle[:n] & (least[:n] == np.arange(n)), -1, parent)


def breadth_first(parent: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """parent, depth and order, roots first; a child beyond max_depth becomes a root."""
    parent = parent.copy()
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent.tolist()):
        children.setdefault(p, []).append(i)
    depth, order = np.zeros(len(parent), dtype=int), []
    level = children.get(-1, [])
    while level:
        order += level
        later, fresh = [], []
        for p in level:
            for c in children.get(p, []):
                if depth[p] + 1 > max_depth:
                    parent[c], depth[c] = -1, 0
                    fresh.append(c)
                else:
                    depth[c] = depth[p] + 1
                    later.append(c)
        level = later + fresh
    place = np.empty(len(parent), dtype=int)
    place[order] = np.arange(len(order))
    return parent, depth, np.lexsort((place, depth))


def renumbered(ids: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list breadth first, by depth, then the parent's new number, then id; and each such row's parent as a number from 1, 0 for none."""
    new = np.zeros(len(ids) + 1, dtype=int)
    order = np.zeros(0, dtype=int)
    for level in range(int(depth.max(initial=0)) + 1):
        rows = np.flatnonzero(depth == level)
        rows = rows[np.lexsort((ids[rows], np.where(parent[rows] < 0, 0, new[parent[rows]])))]
        new[rows] = len(order) + 1 + np.arange(len(rows))
        order = np.concatenate([order, rows])
    return order, np.where(parent[order] < 0, 0, new[parent[order]])


def numbered(parents: DataFrame) -> DataFrame:
    """The rows of parents (vec_id, cid, parent), renumbered breadth first in each list: cid, local_id, vec_id, parent_local, depth."""

    def one_list(part: pa.Table) -> pa.Table:
        ids = part.column("vec_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, up = ids[by_id], part.column("parent").combine_chunks()
        root = up.is_null().to_numpy(zero_copy_only=False)[by_id]
        parent = np.where(root, -1, np.searchsorted(ids, up.fill_null(0).to_numpy()[by_id]))
        depth, at = np.zeros(len(ids), dtype=int), parent
        while (at >= 0).any():
            depth += at >= 0
            at = np.where(at >= 0, parent[at], -1)
        order, local = renumbered(ids, parent, depth)
        return pa.table({
            "cid": pa.array(np.full(len(ids), part.column("cid")[0].as_py()), pa.int64()), "local_id": pa.array(np.arange(1, len(ids) + 1), pa.int32()), "vec_id": pa.array(ids[order], pa.int64()),
            "parent_local": pa.array(local, pa.int32()), "depth": pa.array(depth[order], pa.int32()),
        })

    rows = parents.select(F.col("cid").cast("long").alias("cid"), "vec_id", F.col("parent").cast("long").alias("parent"))
    return rows.groupBy("cid").applyInArrow(one_list, "cid long, local_id int, vec_id long, parent_local int, depth int")


FOREST = "cid long, local_id int, vec_id long, parent_local int, depth int, codes array<int>, coeffs array<double>, error double"


def build_forest(vectors: DataFrame, root: Codebooks, one: Codebooks, policy: str = "structured", max_depth: int = 4, knn_k: int = 8, seed: int = 1) -> DataFrame:
    """Per list, a vector is stored by its root encoding or as a residual on a parent, whichever errs less.

    structured: from the center outwards, trying the knn_k nearest of those already placed.
    nn_forest and random_forest fix the parents first; all_roots has none. Ids in a list are
    local, from 1; parent 0 is none.
    """

    def one_list(part: pa.Table) -> pa.Table:
        cid = part.column("cid")[0].as_py()
        ids, x = part.column("vec_id").to_numpy(), stacked(part.column("x").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        return finalised(cid, ids, *linked_list(ids, x, root, one, policy, max_depth, knn_k, seed))

    return vectors.select(F.col("cid").cast("long").alias("cid"), "vec_id", "x").groupBy("cid").applyInArrow(one_list, FOREST)


def linked_list(ids: np.ndarray, x: np.ndarray, root: Codebooks, one: Codebooks, policy: str, max_depth: int, knn_k: int, seed: int) -> tuple[np.ndarray, ...]:
    """parent, depth, codes, coeffs and error of each row of a list in the order of ids, as many rows in a call as don't wait for each other."""
    n = len(ids)
    codes, coeffs = greedy_abs(root, x)
    codes, coeffs, error = iterated_local_search(root, x, ids, codes, 1, 2, 1, seed)
    rebuilt = root.reconstruct(codes, coeffs)
    parent, depth = np.full(n, -1), np.zeros(n, dtype=int)

    def link(rows: np.ndarray, nth: np.ndarray, trial: np.ndarray) -> None:
        """Holds each of the rows against its trials, which are settled: rows[nth[j]] against trial[j], in the order in which ties are broken."""
        for at in range(0, len(rows), 4096):
            few = slice(*np.searchsorted(nth, [at, at + 4096]))
            if few.start == few.stop:
                continue  # without trials
            of, up = nth[few], trial[few]
            rest = x[rows[of]] - rebuilt[up]
            c, a = greedy_abs(one, rest)
            c, a, e = iterated_local_search(one, rest, ids[rows[of]], c, 0, 1, 1, seed)
            best = np.lexsort((np.arange(len(of)), np.round(e, 12), of))
            best = best[np.unique(of[best], return_index=True)[1]]
            best = best[e[best] + 1e-6 < error[rows[of[best]]]]
            i, p = rows[of[best]], up[best]
            parent[i], depth[i], error[i], codes[i], coeffs[i] = p, depth[p] + 1, e[best], c[best], a[best]
            rebuilt[i] = rebuilt[p] + one.reconstruct(c[best], a[best])

    if policy == "structured":
        center = x.mean(0)
        cos = x @ center / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(center), 1e-12)
        walk, at = np.lexsort((ids, -np.round(cos, 12))), 0
        while at < n and max_depth > 0:
            block = walk[at : at + max(16, min(512, at // 4))]
            # Rows that can't have children any more are out of reach. Ties keep the order in which rows were placed.
            placed = walk[:at][depth[walk[:at]] < max_depth]
            nth, trial, d2 = _nearest_placed(x, block, placed, knn_k)
            later, sooner, between = _nearer_in_block(x, block, nth, d2, knn_k)
            waiting = np.ones(len(block), dtype=bool)
            while waiting.any():
                # The rows whose possible parents are all settled.
                ready = waiting.copy()
                ready[later[waiting[sooner]]] = False
                old, new = ready[nth], ready[later] & (depth[block[sooner]] < max_depth)
                of = np.concatenate([nth[old], later[new]])
                order = np.lexsort((np.concatenate([np.arange(len(nth))[old], len(nth) + sooner[new]]), np.concatenate([d2[old], between[new]]), of))
                order = order[_firsts(of[order], knn_k)]
                link(block, of[order], np.concatenate([trial[old], block[sooner[new]]])[order])
                waiting &= ~ready
            at += len(block)
    elif policy != "all_roots":
        if policy == "nn_forest":
            wanted = _nearest_rows(x) if n > 1 else np.full(n, -1)
        else:
            wanted = random_parent(np.arange(n), n, seed)
        wanted, level, _ = breadth_first(cut_cycles(wanted), max_depth)
        # A level's parents are settled with the level before it.
        for rows in (np.flatnonzero(level == k) for k in range(1, int(level.max(initial=0)) + 1)):
            link(rows, np.arange(len(rows)), wanted[rows])
    return parent, depth, codes, coeffs, error


def _firsts(of: np.ndarray, k: int) -> np.ndarray:
    """Which are among the k first of their group, for groups in order."""
    return np.arange(len(of)) - np.searchsorted(of, of) < k


def _slack(*n2: np.ndarray) -> float:
    """More than products of vectors of such squared lengths can be off, and than distances are rounded by."""
    return 1e-9 * max(1.0, *(float(np.nan_to_num(v).max(initial=0.0)) for v in n2))


def _rounded_d2(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [((x[a[at : at + 65536]] - x[b[at : at + 65536]]) ** 2).sum(1) for at in range(0, len(a), 65536)]
    return np.round(np.concatenate(parts), 12) if parts else np.zeros(0)


def _nearest_placed(x: np.ndarray, rows: np.ndarray, placed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest placed ones of each of the rows by rounded distance, then by place: nth of rows, row, distance."""
    nth, at, d2, n2 = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), (x[rows] ** 2).sum(1)
    for start in range(0, len(placed) if k else 0, 8192):
        some = x[placed[start : start + 8192]]
        other = (some**2).sum(1)
        d, few = n2[:, None] + other - 2 * x[rows] @ some.T, min(k, len(some))
        row, col = np.nonzero(~(d > np.partition(d, few - 1, axis=1)[:, few - 1 : few] + _slack(n2, other)))
        col += start
        nth, at, d2 = np.concatenate([nth, row]), np.concatenate([at, col]), np.concatenate([d2, _rounded_d2(x, rows[row], placed[col])])
        order = np.lexsort((at, d2, nth))
        order = order[_firsts(nth[order], k)]
        nth, at, d2 = nth[order], at[order], d2[order]
    return nth, placed[at], d2


def _nearer_in_block(x: np.ndarray, rows: np.ndarray, nth: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row with a sooner one of its block that is nearer than its k-th placed one: later, sooner (nth of rows), distance."""
    limit = np.full(len(rows), np.inf)
    last = np.searchsorted(nth, np.arange(len(rows)), side="right") - 1
    full = np.bincount(nth, minlength=len(rows)) >= max(k, 1)
    limit[full] = d2[last[full]]
    n2 = (x[rows] ** 2).sum(1)
    d = n2[:, None] + n2 - 2 * x[rows] @ x[rows].T
    later, sooner = np.nonzero(np.tril(~(d > limit[:, None] + _slack(n2)), -1)) if k else (np.zeros(0, dtype=int),) * 2
    between = _rounded_d2(x, rows[later], rows[sooner])
    keep = ~(between >= limit[later])
    return later[keep], sooner[keep], between[keep]


def _nearest_rows(x: np.ndarray) -> np.ndarray:
    """The nearest other row of each row, in blocks of rows, so that no table of all pairs is held."""
    found, n2 = [], (x**2).sum(1)
    step = max(1, min(1024, (1 << 22) // len(x)))
    for at in range(0, len(x), step):
        d2 = np.maximum(n2[at : at + step, None] + n2 - 2 * x[at : at + step] @ x.T, 0)
        d2[np.arange(len(d2)), np.arange(at, at + len(d2))] = np.inf
        found.append(np.argmin(np.round(d2, 12), axis=1))
    return np.concatenate(found)


def finalised(cid: int, ids: np.ndarray, parent: np.ndarray, depth: np.ndarray, codes: np.ndarray, coeffs: np.ndarray, error: np.ndarray) -> pa.Table:
    """Rows renumbered breadth first: by depth, then the parent's new number, then id."""
    order, up = renumbered(ids, parent, depth)
    return pa.table({
        "cid": pa.array([cid] * len(order), pa.int64()), "local_id": pa.array(range(1, len(order) + 1), pa.int32()), "vec_id": pa.array(ids[order], pa.int64()),
        "parent_local": pa.array(up, pa.int32()), "depth": pa.array(depth[order], pa.int32()), "codes": listed(codes[order].astype(np.int32)),
        "coeffs": listed(coeffs[order]), "error": pa.array(error[order], pa.float64()),
    })


def linked_vectors(parent: np.ndarray, codes: np.ndarray, coeffs: np.ndarray, root: Codebooks, one: Codebooks) -> np.ndarray:
    """Reconstructions of a list in breadth-first order: a root from its codes, a child from its parent's vector and its own."""
    out = np.empty((len(parent), root.all.shape[1]))
    for books, rows in ((root, parent == 0), (one, parent > 0)):
        out[rows] = books.reconstruct(codes[rows], coeffs[rows])
    # Level by level: those whose parent is done.
    done = parent == 0
    left = np.flatnonzero(~done)
    while len(left):
        ready = done[parent[left] - 1]
        if not ready.any():
            raise ValueError("the parents form a cycle")
        now, left = left[ready], left[~ready]
        out[now] += out[parent[now] - 1]
        done[now] = True
    return out


def reconstruct_forest(forest: DataFrame, root: Codebooks, one: Codebooks) -> DataFrame:
    """cid, vec_id and xh of each row of a forest."""

    def one_list(part: pa.Table) -> pa.Table:
        part = part.sort_by("local_id")
        codes, coeffs = (stacked(part.column(c).combine_chunks()) for c in ("codes", "coeffs"))
        xh = linked_vectors(part.column("parent_local").to_numpy(), codes.astype(int), coeffs, root, one)
        return pa.table({"cid": part.column("cid"), "vec_id": part.column("vec_id"), "xh": listed(xh)})

    return forest.select("cid", "local_id", "vec_id", "parent_local", "codes", "coeffs").groupBy("cid").applyInArrow(one_list, "cid long, vec_id long, xh array<double>")


def linked_scan(forest: DataFrame, queries: DataFrame, probes: DataFrame, root: Codebooks, one: Codebooks, k: int) -> DataFrame:
    """Top-k over the probed lists of a forest: qid, vec_id, dist (|xh|^2 - 2 <q, xh>), rank; ties by id."""

    def near(q: np.ndarray, xh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm = (xh * xh).sum(1)
        found = []
        step = max(1, (1 << 17) // len(xh))
        for at in range(0, len(q), step):
            d = norm - 2 * (q[at : at + step] @ xh.T)
            n = min(k, len(xh))
            # What ties with the k-th could still come first by id.
            row, col = np.nonzero(~(d > np.partition(d, n - 1, axis=1)[:, n - 1 : n] + _slack(norm, (q * q).sum(1))))
            row += at
            found.append((row, col, norm[col] - 2 * (q[row] * xh[col]).sum(1)))
        return tuple(np.concatenate(c) for c in zip(*found))

    return scan_lists(reconstruct_forest(forest, root, one), queries, probes, k, near)


def scan_lists(rebuilt: DataFrame, queries: DataFrame, probes: DataFrame, k: int, near) -> DataFrame:
    """Top-k over the rows (cid, vec_id, xh) of the lists that each query probes: qid, vec_id, dist, rank; ties by id.

    near(q, xh) gives what may be among the k nearest of some queries in some rows of a list: the
    places of queries and of rows, and their distances. The lists are read in batches that keep
    their own top-k; queries that are too many to be held by every task are gone through block by block.
    """
    from orrery.operators.topk import nearest

    parts = blocks(queries, "qid", "q")
    if len(parts) > 1:
        rebuilt = spooled(rebuilt, "rebuilt")
    found = [_scan_block(rebuilt, part, probes, k, near) for part in parts]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return nearest(rows, k)


def _scan_block(rebuilt: DataFrame, queries: DataFrame, probes: DataFrame, k: int, near) -> DataFrame:
    qids, q = matrix(queries, "qid", "q")
    pairs = probes.join(queries.select("qid"), "qid", "left_semi").select("qid", F.col("cid").cast("long").alias("cid")).toArrow()  # at most queries x lists, both of checked size
    at, cids = np.searchsorted(qids, pairs.column(0).to_numpy()), pairs.column(1).to_numpy()
    order = np.lexsort((at, cids))
    lists, starts = np.unique(cids[order], return_index=True)
    probing = dict(zip(lists.tolist(), np.split(at[order], starts[1:])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, ids, xh = batch.column(0).to_numpy(), batch.column(1).to_numpy(), stacked(batch.column(2))
            for c in np.unique(cid).tolist():
                here = np.flatnonzero(cid == c)
                if c not in probing:
                    continue
                row, col, dist = near(q[probing[c]], xh[here])
                row, col = probing[c][row], ids[here][col]
                first = np.lexsort((col, dist, row))
                first = first[_firsts(row[first], k)]
                yield pa.RecordBatch.from_arrays([pa.array(qids[row[first]], pa.int64()), pa.array(col[first], pa.int64()), pa.array(dist[first], pa.float64())], ["qid", "vec_id", "dist"])

    return rebuilt.select("cid", "vec_id", "xh").mapInArrow(scan, "qid long, vec_id long, dist double")


def global_parents(forest: DataFrame) -> DataFrame:
    """vec_id and its parent's vec_id, -1 for a root."""
    up = forest.select("cid", F.col("local_id").alias("parent_local"), F.col("vec_id").alias("parent"))
    return forest.select("cid", "vec_id", "parent_local").join(up, ["cid", "parent_local"], "left").select("vec_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


def depth_stats(rows: DataFrame) -> DataFrame:
    """Per list: rows, share of children, mean and greatest depth."""
    child: Column = (F.col("depth") > 0).cast("double")
    return rows.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.avg(child).alias("child_share"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"))


def child_residuals(forest: DataFrame, vectors: DataFrame, root: Codebooks, one: Codebooks) -> DataFrame:
    """Of each child: x less its parent's reconstruction, with its codes and coefficients. Roots are left out."""
    rebuilt = reconstruct_forest(forest, root, one).select(F.col("vec_id").alias("parent"), "xh")
    children = global_parents(forest).where("parent >= 0").join(rebuilt, "parent")
    rows = children.join(forest.select("vec_id", "cid", "codes", "coeffs"), "vec_id").join(vectors.select("vec_id", "x"), "vec_id")
    return rows.select("vec_id", "cid", F.zip_with("x", "xh", lambda a, b: a - b).alias("x"), "codes", "coeffs")


def update_child_books(forest: DataFrame, vectors: DataFrame, root: Codebooks, one: Codebooks, bad: DataFrame | None = None, alpha: float = 1.0) -> list[np.ndarray]:
    """The children's codebooks that fit their residuals best; children of bad clusters weigh alpha. Without children, the root's books."""
    from orrery.operators.codebooks import update_codebooks

    rows = child_residuals(forest, vectors, root, one)
    if rows.isEmpty():
        return root.layers
    if bad is None:
        return update_codebooks(rows, one.layers)
    marks = bad.select(F.col("cid").cast("long").alias("cid"), F.when(F.col("bad"), F.lit(alpha)).otherwise(1.0).alias("w"))
    return update_codebooks(rows.join(marks, "cid", "left").withColumn("w", F.coalesce("w", F.lit(1.0))), one.layers, "w")


def quantised_forest(forest: DataFrame, bits: int = 8) -> DataFrame:
    """The forest with coefficients of that many bits; steps are those of each list, of roots and children apart, and of each layer."""
    from orrery.operators.compression import quantise

    group = F.when(F.col("parent_local") == 0, 0).otherwise(1).alias("grp")
    flat = forest.select("cid", "vec_id", group, F.posexplode("coeffs").alias("layer", "a"))
    coded = quantise(flat, ["cid", "grp", "layer"], "a", 1.0, bits).withColumn("a", F.col("q") * F.col("step"))
    coeffs = coded.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "a"))), lambda s: s["a"]).alias("coeffs"))
    return forest.drop("coeffs").join(coeffs, "vec_id")


def quantised_error(forest: DataFrame, vectors: DataFrame, root: Codebooks, one: Codebooks, bits: int = 8) -> DataFrame:
    """vec_id and the squared error of its reconstruction from coefficients of that many bits."""
    from orrery.functions.vectors import l2sq

    rebuilt = reconstruct_forest(quantised_forest(forest, bits), root, one)
    return rebuilt.join(vectors.select("vec_id", "x"), "vec_id").select("vec_id", l2sq("x", "xh").alias("se"))


def union_linkages(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One linkage of two built apart; no list may be in both."""
    return good.unionByName(bad.select(*good.columns))


def real_only(found: DataFrame) -> DataFrame:
    """Results without virtual rows, whose ids are below 0."""
    return found.where("vec_id >= 0")

"""Codebook learning: layered residual initialisation, joint least squares, rotations, cluster masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.encoding import Codebooks
from orrery.operators.kmeans import init_random, spherical_kmeans
from orrery.operators.search import stacked

EPS = 1e-6


def rotate(vectors: DataFrame, r: np.ndarray, x: str = "x") -> DataFrame:
    """R x for each row; a rotation that changes nothing is skipped."""
    if np.allclose(r, np.eye(len(r)), atol=EPS):
        return vectors
    others = [c for c in vectors.columns if c != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = stacked(batch.column(len(others))) @ r.T
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(list(y), pa.list_(pa.float64()))], [*others, x])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*others, x).schema)
    return vectors.select(*others, x).mapInArrow(run, schema)


def residual_init(vectors: DataFrame, sizes: list[int], rounds: int = 8, seed: int = 12345) -> tuple[list[np.ndarray], DataFrame]:
    """A codebook for each layer by spherical k-means on what the layers before leave, and that rest.

    The residual is a lazy column over the vectors: each layer's projection is taken off as the
    rows are read again, and nothing is gathered but the centers.
    """
    books, rest = [], vectors.select("vec_id", "x")
    for layer, k in enumerate(sizes):
        centers = spherical_kmeans(rest, init_random(rest, k, seed + layer), rounds).centers
        books.append(centers)
        rest = _take_off(rest, centers)
    return books, rest


def _take_off(rest: DataFrame, centers: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column(1))
            score = x @ centers.T
            at = np.argmax(score, axis=1)
            x = x - score[np.arange(len(x)), at, None] * centers[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "x"])

    return rest.mapInArrow(run, "vec_id long, x array<double>")


def normal_equations(encoded: DataFrame, sizes: list[int], d: int, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """G = sum w s s' and T = sum w s x' over rows with x, codes, coeffs; s has the coefficients at the codes' places."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    h = int(offsets[-1])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, t = np.zeros((h, h)), np.zeros((h, d))
        for batch in batches:
            x, codes, a = stacked(batch.column(0)), stacked(batch.column(1)).astype(int), stacked(batch.column(2))
            if not len(x):
                continue
            s = np.zeros((len(x), h))
            np.put_along_axis(s, codes + offsets[:-1], a, 1)
            w = batch.column(3).to_numpy()[:, None] if weight else 1.0
            g += s.T @ (w * s)
            t += s.T @ (w * x)
        both = np.hstack([g, t])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(h)), pa.array(list(both), pa.list_(pa.float64()))], ["row", "v"])

    parts = encoded.select("x", "codes", "coeffs", *([weight] if weight else [])).mapInArrow(part, "row long, v array<double>")

    def summed(table: pa.Table) -> pa.Table:
        total = stacked(table.column("v").combine_chunks()).sum(0)
        return pa.table({"row": table.column("row")[:1], "v": pa.array([total], pa.list_(pa.float64()))})

    rows = parts.groupBy("row").applyInArrow(summed, "row long, v array<double>").orderBy("row").toArrow()  # one row per codeword
    both = stacked(rows.column("v").combine_chunks())
    return both[:, :h], both[:, h:]


def solve_bumped(g: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """G C = T by Cholesky; up to ten diagonal bumps, each ten times the last; None if all fail."""
    bump = 0.0
    for k in range(11):
        try:
            low = np.linalg.cholesky(g + bump * np.eye(len(g)))
            return np.linalg.solve(low.T, np.linalg.solve(low, t))
        except np.linalg.LinAlgError:
            bump = EPS * 10.0**k
    return None


def update_codebooks(encoded: DataFrame, books: list[np.ndarray], weight: str | None = None) -> list[np.ndarray]:
    """The codebooks that fit the rows best for their codes and coefficients. Codewords nothing uses stay as they are."""
    sizes, d = [len(b) for b in books], books[0].shape[1]
    g, t = normal_equations(encoded, sizes, d, weight)
    used = np.diag(g) > 0
    new = np.vstack(books)
    solved = solve_bumped(g[np.ix_(used, used)], t[used]) if used.any() else None
    if solved is not None:
        new[used] = solved
    return np.split(new, np.cumsum(sizes)[:-1])


def update_two_pass(encoded: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The small layers that fit best beside the old root, then in closed form the root that fits best beside them."""
    den, right, cross, g, t = _root_sums(encoded, books)
    small = np.vstack(books[1:])
    live = np.diag(g) > 0
    if live.any():
        small[live] = np.linalg.lstsq(g[np.ix_(live, live)], (t - cross.T @ books[0])[live], rcond=None)[0]
    return [_root_beside(den, right, cross, small, books[0]), *np.split(small, np.cumsum([len(b) for b in books[1:]])[:-1])]


def _root_beside(den: np.ndarray, right: np.ndarray, cross, small: np.ndarray, old: np.ndarray) -> np.ndarray:
    return np.where((den > 0)[:, None], (right - cross @ small) / np.where(den > 0, den, 1.0)[:, None], old)


def _root_sums(encoded: DataFrame, books: list[np.ndarray]):
    """Sums over rows with x, codes, coeffs, by parts of the normal equations.

    Of the root layer: its diagonal (no row has two of its codes), its right sides, and its
    products with the small layers; of the small layers: their matrix and right sides. A task
    gives out one row for each root code that it met, so that nothing has the root's size squared.
    """
    h0, d = books[0].shape
    sizes = [len(b) for b in books[1:]]
    offsets, h = np.concatenate([[0], np.cumsum(sizes)])[:-1], sum(sizes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        g, t = np.zeros((h, h)), np.zeros((h, d))
        for batch in batches:
            x, codes, a = stacked(batch.column(0)), stacked(batch.column(1)).astype(int), stacked(batch.column(2))
            if not len(x):
                continue
            s = np.zeros((len(x), h))
            np.put_along_axis(s, codes[:, 1:] + offsets, a[:, 1:], 1)
            g += s.T @ s
            t += s.T @ x
            values, at = np.unique(codes[:, 0], return_inverse=True)
            both = np.hstack([a[:, :1] ** 2, a[:, :1] * x, a[:, :1] * s])
            sums = np.zeros((len(values), both.shape[1]))
            np.add.at(sums, at, both)
            for v, row in zip(values.tolist(), sums):
                met[v] = met[v] + row if v in met else row
        rows = [*met.items(), *((-1 - i, np.concatenate([[0.0], t[i], g[i]])) for i in range(h))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["row", "v"])

    def summed(table: pa.Table) -> pa.Table:
        return pa.table({"row": table.column("row")[:1], "v": pa.array([stacked(table.column("v").combine_chunks()).sum(0)], pa.list_(pa.float64()))})

    parts = encoded.select("x", "codes", "coeffs").mapInArrow(part, "row long, v array<double>")
    got = parts.groupBy("row").applyInArrow(summed, "row long, v array<double>").toArrow()  # one row per codeword
    rows, v = got.column("row").to_numpy(), stacked(got.column("v").combine_chunks())
    table, own = np.zeros((h0, 1 + d + h)), np.zeros((h, 1 + d + h))
    table[rows[rows >= 0]], own[-1 - rows[rows < 0]] = v[rows >= 0], v[rows < 0]
    return table[:, 0], table[:, 1 : 1 + d], table[:, 1 + d :], own[:, 1 + d :], own[:, 1 : 1 + d]


def update_root_by_elimination(encoded: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The optimum of all layers, with the (large) root layer eliminated: its block is diagonal, so the small layers solve a Schur complement."""
    den, right, cross, g, t = _root_sums(encoded, books)
    if len(books) == 1:
        return [np.where((den > 0)[:, None], right / np.where(den > 0, den, 1.0)[:, None], books[0])]
    scaled = cross / np.where(den > 0, den, 1.0)[:, None]
    schur, rest = g - cross.T @ scaled, t - scaled.T @ right
    live, small = np.diag(g) > 0, np.vstack(books[1:])
    if live.any():
        small[live] = np.linalg.lstsq(schur[np.ix_(live, live)], rest[live], rcond=None)[0]
    root = _root_beside(den, right, cross, np.where(live[:, None], small, 0.0), books[0])
    return [root, *np.split(small, np.cumsum([len(b) for b in books[1:]])[:-1])]


def procrustes_moment(pairs: DataFrame, d: int) -> np.ndarray:
    """M = sum xh x' over rows with xh and x, by partial sums of d * d numbers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                m += stacked(batch.column(0)).T @ stacked(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(m), pa.list_(pa.float64()))], ["row", "v"])

    parts = pairs.select("xh", "x").mapInArrow(part, "row long, v array<double>")
    rows = parts.select("row", F.posexplode("v").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).orderBy("row", "col").toArrow()  # d * d rows
    return rows.column("v").to_numpy().reshape(d, d)


def procrustes(m: np.ndarray) -> np.ndarray:
    """The orthogonal R that brings R x nearest to xh: U V' of M."""
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def bad_clusters(errors: DataFrame, good_share: float, cid: str = "cid", mse: str = "mse") -> DataFrame:
    """cid, mean, bad: bad are the clusters whose mean error is above that at rank round(good_share n), ascending."""
    means = errors.groupBy(cid).agg(F.avg(mse).alias("mean"))
    w = Window.orderBy("mean", cid)  # one row per cluster
    ranked = means.withColumn("nth", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    cut = ranked.where(F.col("nth") == F.least(F.col("n") - 1, F.round(good_share * F.col("n")).cast("int"))).select(F.col("mean").alias("cut"))
    return ranked.crossJoin(F.broadcast(cut)).select(cid, "mean", (F.col("mean") > F.col("cut")).alias("bad"))


def train(vectors: DataFrame, sizes: list[int], rounds: int = 2, width: int = 4) -> tuple[Codebooks, np.ndarray]:
    """Residual codebooks, then rounds of encoding, rotation and joint update. Returns the books and the rotation."""
    from orrery.operators.encoding import encode

    books, _ = residual_init(vectors, sizes)
    d = books[0].shape[1]
    r = np.eye(d)
    for _ in range(rounds):
        rotated = rotate(vectors, r)
        coded = encode(rotated, Codebooks(books), width=width, ils_rounds=1).join(rotated, "vec_id")
        books = update_codebooks(coded, books)
        model = Codebooks(books)

        def rebuilt(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xh = model.reconstruct(stacked(batch.column(0)).astype(int), stacked(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(list(xh), pa.list_(pa.float64())), batch.column(2)], ["xh", "x"])

        plain = coded.select("vec_id", "codes", "coeffs").join(vectors, "vec_id")
        pairs = plain.select("codes", "coeffs", "x").mapInArrow(rebuilt, "xh array<double>, x array<double>")
        r = procrustes(procrustes_moment(pairs, d))
    return Codebooks(books), r

"""Codes and coefficients for vectors: greedy, least squares, beam search, and local search.

Kernels work on whole batches with numpy; the SQL-expressible ones are column expressions.
Random choices are keyed by the vector's id, so that partitioning never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, norm2
from orrery.operators.search import stacked
from orrery.operators.topk import top_k

EPS = 1e-6


def greedy_atom(rows: DataFrame, atoms: DataFrame, residual: str = "r", ident: str = "vec_id") -> DataFrame:
    """The atom that takes most off each residual, by |<r, atom>| / |atom|: adds code1, atom, a1. Atoms of no length are left out."""
    atoms = atoms.where(norm2("atom") > 0)
    scored = rows.crossJoin(F.broadcast(atoms)).withColumn("gain", F.round(F.abs(dot(residual, "atom")) / F.sqrt(norm2("atom")), 9))
    best = top_k(scored, ident, [F.desc("gain"), F.col("code")], 1, "pick")
    return best.withColumn("a1", dot(residual, "atom") / norm2("atom")).withColumnRenamed("code", "code1").drop("gain", "pick")


class Codebooks:
    """Layers of codewords with their Gram matrix: layers[l] is a matrix of one row per code."""

    def __init__(self, layers: list[np.ndarray]) -> None:
        self.layers = [np.asarray(c, dtype=np.float64) for c in layers]
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in self.layers])])
        self.all = np.vstack(self.layers)
        self.gram = self.all @ self.all.T
        norms = np.diag(self.gram)
        self.inverse = np.where(norms > EPS, 1 / np.maximum(norms, EPS), 0.0)

    @property
    def m(self) -> int:
        return len(self.layers)

    def flat(self, codes: np.ndarray) -> np.ndarray:
        return codes + self.offsets[: codes.shape[1]]

    def reconstruct(self, codes: np.ndarray, coeffs: np.ndarray) -> np.ndarray:
        return np.einsum("nm,nmd->nd", coeffs, self.all[self.flat(codes)])

    def cost(self, x: np.ndarray, codes: np.ndarray, coeffs: np.ndarray) -> np.ndarray:
        """|x|^2 - 2 sum a <x, c> + sum a a' <c, c'>, by the Gram matrix."""
        at = self.flat(codes)
        xc = np.take_along_axis(x @ self.all.T, at, 1)
        g = self.gram[at[:, :, None], at[:, None, :]]
        return (x * x).sum(1) - 2 * (coeffs * xc).sum(1) + np.einsum("ni,nij,nj->n", coeffs, g, coeffs)

    def solve(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Least-squares coefficients for fixed codes; a singular system gets a growing ridge, up to three times."""
        at = self.flat(codes)
        xc = np.take_along_axis(x @ self.all.T, at, 1)
        g = self.gram[at[:, :, None], at[:, None, :]]
        try:
            out = np.linalg.solve(g, xc[:, :, None])[:, :, 0]
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        # By codes, so that no row gets the ridge of another's system.
        order = np.lexsort(codes.T)
        starts = np.flatnonzero(np.r_[True, (np.diff(codes[order], axis=0) != 0).any(1)])
        out = np.empty(xc.shape)
        for rows in np.split(order, starts[1:]):
            out[rows] = _ridged(g[rows[0]], xc[rows])
        return out


def _ridged(g: np.ndarray, xc: np.ndarray) -> np.ndarray:
    ridge = 0.0
    for t in range(4):
        try:
            out = np.linalg.solve(g + ridge * np.eye(len(g)), xc.T).T
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        ridge = EPS * 10.0**t
    return np.linalg.lstsq(g, xc.T, rcond=None)[0].T


def beam_search(books: Codebooks, x: np.ndarray, width: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes by a beam over layers in turn, each prefix scored with its least-squares error. root fixes the first code."""
    n = len(x)
    gain = (x @ books.layers[0].T) ** 2 * books.inverse[: len(books.layers[0])]
    if root is not None:
        beams = root[:, None, None]
    else:
        beams = np.argsort(-np.round(gain, 12), axis=1, kind="stable")[:, :width, None]
    for layer in range(1, books.m):
        h = len(books.layers[layer])
        grown = np.concatenate([np.repeat(beams, h, axis=1), np.tile(np.arange(h), beams.shape[1])[None, :, None].repeat(n, 0)], axis=2)
        flat = grown.reshape(-1, layer + 1)
        xs = np.repeat(x, grown.shape[1], axis=0)
        part = Codebooks(books.layers[: layer + 1])
        errors = np.maximum(part.cost(xs, flat, part.solve(xs, flat)), 0.0).reshape(n, -1)
        keep = np.argsort(np.round(errors, 12), axis=1, kind="stable")[:, :width]
        beams = np.take_along_axis(grown, keep[:, :, None], 1)
    codes = beams[:, 0]
    return codes, books.solve(x, codes)


def _uniforms(seed: int, ids: np.ndarray, n: int) -> np.ndarray:
    """n numbers in [0, 1) for each id, by splitmix64."""
    state = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((state ^ (state >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def iterated_modes(books: Codebooks, x: np.ndarray, codes: np.ndarray, rounds: int, first_layer: int = 1, signed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Conditional modes: each layer in turn takes the code that fits its residual best, if the cost falls."""
    codes = codes.copy()
    coeffs = books.solve(x, codes)
    cost = books.cost(x, codes, coeffs)
    for _ in range(rounds):
        changed = False
        for layer in range(first_layer, books.m):
            book = books.layers[layer]
            inverse = np.sqrt(books.inverse[books.offsets[layer] : books.offsets[layer + 1]])
            rest = x - books.reconstruct(codes, coeffs) + coeffs[:, layer, None] * book[codes[:, layer]]
            score = rest @ book.T * inverse
            trial = codes.copy()
            trial[:, layer] = np.argmax(score if signed else np.abs(score), axis=1)
            solved = books.solve(x, trial)
            new = books.cost(x, trial, solved)
            better = new + EPS < cost
            codes[better], coeffs[better], cost[better] = trial[better], solved[better], new[better]
            changed |= bool(better.any())
        if not changed:
            break
    return codes, coeffs


def iterated_local_search(books: Codebooks, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, rounds: int, icm_rounds: int, perturbed: int, seed: int, signed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conditional modes, then rounds of perturbing some layers by id-keyed draws and keeping what improves."""
    codes, coeffs = iterated_modes(books, x, codes, icm_rounds, signed=signed)
    cost = books.cost(x, codes, coeffs)
    sizes = np.array([len(c) for c in books.layers])
    for outer in range(rounds if books.m > 1 else 0):
        u = _uniforms(seed + 7919 * outer, ids, 2 * perturbed)
        trial = codes.copy()
        for p in range(perturbed):
            layer = 1 + (u[:, 2 * p] * (books.m - 1)).astype(int)
            trial[np.arange(len(x)), layer] = (u[:, 2 * p + 1] * sizes[layer]).astype(int)
        trial, solved = iterated_modes(books, x, trial, icm_rounds, signed=signed)
        new = books.cost(x, trial, solved)
        better = new + EPS < cost
        codes[better], coeffs[better], cost[better] = trial[better], solved[better], new[better]
    return codes, coeffs, cost


def greedy_abs(books: Codebooks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each time the unused layer whose best codeword takes most off the residual."""
    codes, coeffs = np.zeros((len(x), books.m), dtype=int), np.zeros((len(x), books.m))
    rest, used = x.copy(), np.zeros((len(x), books.m), dtype=bool)
    rows = np.arange(len(x))
    layer_of = np.repeat(np.arange(books.m), np.diff(books.offsets))
    for _ in range(books.m):
        score = np.abs(rest @ books.all.T) * np.sqrt(books.inverse)
        score[used[:, layer_of]] = -1.0
        at = np.argmax(score, axis=1)
        a = (rest * books.all[at]).sum(1) * books.inverse[at]
        layer = layer_of[at]
        codes[rows, layer], coeffs[rows, layer] = at - books.offsets[layer], a
        used[rows, layer] = True
        rest -= a[:, None] * books.all[at]
    return codes, coeffs


def greedy_forced(books: Codebooks, x: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `greedy_abs`, with the root's code given and taken off first."""
    codes, coeffs = np.zeros((len(x), books.m), dtype=int), np.zeros((len(x), books.m))
    codes[:, 0], coeffs[:, 0] = root, (x * books.layers[0][root]).sum(1) * books.inverse[root]
    if books.m > 1:
        rest = x - coeffs[:, :1] * books.layers[0][root]
        codes[:, 1:], coeffs[:, 1:] = greedy_abs(Codebooks(books.layers[1:]), rest)
    return codes, coeffs


def greedy_encode(vectors: DataFrame, books: Codebooks, root: str) -> DataFrame:
    """vec_id, codes and coeffs of each vector, greedily after the root code that a column names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, coeffs = greedy_forced(books, stacked(batch.column(1)), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(coeffs), pa.list_(pa.float64()))], ["vec_id", "codes", "coeffs"])

    return vectors.select("vec_id", "x", root).mapInArrow(run, "vec_id long, codes array<int>, coeffs array<double>")


def encode(vectors: DataFrame, books: Codebooks, width: int = 4, icm_rounds: int = 2, ils_rounds: int = 2, perturbed: int = 2, seed: int = 1, root: str | None = None) -> DataFrame:
    """vec_id, cid (the first code), codes, coeffs and mse of each vector. root names a column with the first code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, x = part.column(0).to_numpy(), stacked(part.column(1))
                codes, coeffs = beam_search(books, x, width, part.column(2).to_numpy() if root else None)
                codes, coeffs, cost = iterated_local_search(books, x, ids, codes, ils_rounds, icm_rounds, perturbed, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(codes[:, 0].astype(np.int32)), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(coeffs), pa.list_(pa.float64())), pa.array(cost)],
                    ["vec_id", "cid", "codes", "coeffs", "mse"],
                )

    columns = ["vec_id", "x", *([root] if root else [])]
    return vectors.select(*columns).mapInArrow(run, "vec_id long, cid int, codes array<int>, coeffs array<double>, mse double")

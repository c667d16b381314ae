"""Coefficient quantizers, canonical Huffman codes, level-order trees, and norm tables."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.kmeans import scalar_kmeans, tail_weights


def levels(bits: int) -> int:
    """The greatest code of a signed midtread quantizer."""
    return 2 ** (bits - 1) - 1


def quantise(rows: DataFrame, key: list[str], value: str, percentile: float, bits: int) -> DataFrame:
    """Adds step, q (clipped to +-Q) and clipped: the step is the percentile of |value| over Q, per key."""
    top = levels(bits)
    span = rows.groupBy(*key).agg(F.percentile(F.abs(F.col(value)), percentile).alias("span"))
    step = F.greatest(F.col("span"), F.lit(1e-12)) / top
    raw = F.rint(F.col(value) / step)
    q = F.greatest(F.lit(-top), F.least(F.lit(top), raw))
    return rows.join(span, key).withColumns({"step": step, "q": q.cast("int"), "clipped": F.abs(raw) > top}).drop("span")


def fitted_scale(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The scale s = sum a q / sum q^2 that fits values best by their codes, and the error it leaves."""
    aq, qq, aa = F.sum(F.col(value) * F.col("q")), F.sum(F.col("q") * F.col("q")), F.sum(F.col(value) * F.col(value))
    return rows.groupBy(*key).agg(F.when(qq > 0, aq / qq).otherwise(0.0).alias("scale"), (aa - F.when(qq > 0, aq * aq / qq).otherwise(0.0)).alias("error"))


def best_percentile(rows: DataFrame, key: list[str], value: str, percentiles: list[float], bits: int) -> DataFrame:
    """Per key the percentile that leaves the least error after fitting the scale; ties to the lowest."""
    tried = None
    for p in percentiles:
        one = fitted_scale(quantise(rows, key, value, p, bits), key, value).withColumn("percentile", F.lit(p))
        tried = one if tried is None else tried.unionByName(one)
    w = Window.partitionBy(*key).orderBy(F.round("error", 9), "percentile")
    return tried.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def weighted_quantile(rows: DataFrame, key: str, value: str, weight: str, p: float) -> DataFrame:
    """The first value whose cumulated weight reaches p of the key's."""
    w = Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("upto", F.sum(weight).over(w)).withColumn("all", F.sum(weight).over(Window.partitionBy(key)))
    return run.where(F.col("upto") >= p * F.col("all")).groupBy(key).agg(F.min(value).alias("quantile"))


def expand(values: list, m: int) -> list:
    """One value for all layers, two for the first and the rest, or one each, cut or padded with the last."""
    if len(values) == 2 and m > 2:
        return [values[0]] + [values[1]] * (m - 1)
    return [*values, *[values[-1]] * m][:m]


def joint_scales(q: np.ndarray, a: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Per-layer scales s that bring sum s q C nearest to sum a C over a group: m normal equations. gram: n, m, m."""
    left = np.einsum("ni,nij,nj->ij", q, gram, q)
    right = np.einsum("ni,nij,nj->i", q, gram, a)
    return np.linalg.lstsq(left, right, rcond=None)[0]


def refine_codes(q: np.ndarray, a: np.ndarray, gram: np.ndarray, scales: np.ndarray, top: int, sweeps: int = 2, limit: int = 1) -> np.ndarray:
    """Coordinate sweeps over the layers: each integer moves by at most `limit` to its best place."""
    q = q.astype(np.float64).copy()
    for _ in range(sweeps):
        for layer in range(q.shape[1]):
            error = np.einsum("nij,nj->ni", gram, a - q * scales)[:, layer]
            move = error / np.maximum(gram[:, layer, layer] * scales[layer], 1e-12)
            q[:, layer] = np.clip(q[:, layer] + np.clip(np.rint(move), -limit, limit), -top, top)
    return q.astype(int)


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths; equal frequencies in the order of the smallest symbol. A single symbol has length 1."""
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    lengths = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (n1, s1, a), (n2, s2, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (n1 + n2, min(s1, s2), a + b))
    return lengths


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol, in the order of (length, symbol)."""
    code, last, out = 0, 0, {}
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def huffman_encode(symbols: np.ndarray) -> tuple[dict[int, int], bytes]:
    if not len(symbols):
        return {}, b""
    lengths = huffman_lengths(Counter(symbols.tolist()))
    codes = {s: format(c, f"0{n}b") for s, (c, n) in canonical_codes(lengths).items()}
    bits = "".join([codes[s] for s in symbols.tolist()])
    return lengths, np.packbits(np.frombuffer(bits.encode(), dtype=np.uint8) - 48).tobytes()


def huffman_decode(lengths: dict[int, int], payload: bytes, n: int) -> np.ndarray:
    table = {(c, k): s for s, (c, k) in canonical_codes(lengths).items()}
    out, code, k = [], 0, 0
    for bit in np.unpackbits(np.frombuffer(payload, dtype=np.uint8)).tolist():
        if len(out) == n:
            break
        code, k = code << 1 | bit, k + 1
        if (code, k) in table:
            out.append(table[code, k])
            code, k = 0, 0
    return np.array(out, dtype=int)


CODEC = "cid long, grp int, layer int, symbols array<int>, lens array<int>, payload binary, n_sym int"


def compress_lists(rows: DataFrame) -> DataFrame:
    """Rows cid, grp, layer, vec_id, q as one Huffman stream for each list, group and layer, in the order of ids."""

    def stream(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        lengths, payload = huffman_encode(part.column("q").to_numpy())
        first = {c: part.column(c)[:1] for c in ("cid", "grp", "layer")}
        return pa.table({**first, "symbols": pa.array([sorted(lengths)], pa.list_(pa.int32())), "lens": pa.array([[lengths[s] for s in sorted(lengths)]], pa.list_(pa.int32())), "payload": pa.array([payload], pa.binary()), "n_sym": pa.array([part.num_rows], pa.int32())})

    narrow = rows.select(F.col("cid").cast("long").alias("cid"), F.col("grp").cast("int").alias("grp"), F.col("layer").cast("int").alias("layer"), "vec_id", "q")
    return narrow.groupBy("cid", "grp", "layer").applyInArrow(stream, CODEC)


def louds(parent: np.ndarray) -> bytes:
    """A level-order tree of 1-based parents (0: a child of the super root): each node's children as ones, then a zero."""
    n = len(parent)
    degree = np.bincount(parent, minlength=n + 1)
    ends = np.cumsum(degree + 1) - 1
    bits = np.ones(2 * n + 1, dtype=np.uint8)
    bits[ends] = 0
    return np.packbits(bits).tobytes()


def louds_parents(bits: bytes, n: int) -> np.ndarray:
    """All parents: the zeros before a node's one."""
    b = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: 2 * n + 1]
    return np.cumsum(b == 0)[b == 1]


def louds_parent(bits: bytes, n: int, v: int) -> int:
    """One node's parent (v from 1)."""
    return Louds(bits, n).parent(v)


class Louds:
    """A level-order tree with an index: the ones before each block of bits, so that one node's parent needs one block."""

    MAGIC, BLOCK = b"LTR1", 64  # bytes

    def __init__(self, bits: bytes, n: int) -> None:
        self.bits, self.n = bits, n
        data = np.frombuffer(bits, dtype=np.uint8)
        counts = np.add.reduceat(np.bitwise_count(data).astype(np.int64), np.arange(0, len(data), self.BLOCK)) if len(data) else np.zeros(0, dtype=np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, parent: np.ndarray) -> Louds:
        return cls(louds(np.asarray(parent)), len(parent))

    def parents(self) -> np.ndarray:
        return louds_parents(self.bits, self.n)

    def parent(self, v: int) -> int:
        """The zeros before the v-th one (v from 1): its place less the ones before it."""
        if not 1 <= v <= self.n:
            raise IndexError(v)
        block = int(np.searchsorted(self.before, v, side="left")) - 1
        inside = np.unpackbits(np.frombuffer(self.bits[block * self.BLOCK : (block + 1) * self.BLOCK], dtype=np.uint8))
        at = int(np.flatnonzero(inside)[v - 1 - int(self.before[block])])
        return block * self.BLOCK * 8 + at - (v - 1)

    def serialise(self) -> bytes:
        return self.MAGIC + self.n.to_bytes(8, "little") + self.bits

    @classmethod
    def deserialise(cls, data: bytes) -> Louds:
        n = int.from_bytes(data[4:12], "little")
        if data[:4] != cls.MAGIC or len(data) != 12 + -(-(2 * n + 1) // 8):
            raise ValueError("no stored tree")
        return cls(data[12:], n)


_MAPS = {
    "lut": (lambda v: v, lambda c: c),
    "lut_cluster": (lambda v: v, lambda c: c),
    "lut_sqrt": (lambda v: np.sqrt(np.maximum(v, 0)), lambda c: c * c),
    "lut_log1p": (lambda v: np.log1p(np.maximum(v, 0)), np.expm1),
    "lut_tail_weighted": (lambda v: v, lambda c: c),
}


def norm_table(values: np.ndarray, mode: str = "lut", n_centers: int = 256, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Up to 256 centers for squared norms, and each value's center. counts tells how often each value stands for a row.

    lut_piecewise parts the values at the middle and at 0.95 of the rows and has bins of equal count in each part.
    """
    values = np.asarray(values, dtype=np.float64)
    n = np.ones(len(values)) if counts is None else np.asarray(counts, dtype=np.float64)
    k = min(n_centers, 256, len(values))
    if mode == "lut_piecewise":
        order = np.argsort(values, kind="stable")
        v, w = values[order], n[order]
        upto = np.cumsum(w) / w.sum()
        centers, low = [], 0.0
        for high, share in ((0.5, 0.5), (0.95, 0.375), (1.0, 0.125)):
            inside = (upto > low) & (upto <= high + 1e-12)
            if inside.any():
                bins = max(1, round(k * share))
                place = np.minimum(((np.cumsum(w[inside]) - w[inside] / 2) / w[inside].sum() * bins).astype(int), bins - 1)
                mass = np.bincount(place, w[inside], bins)
                centers += list((np.bincount(place, w[inside] * v[inside], bins) / np.maximum(mass, 1e-300))[mass > 0])
            low = high + 1e-12
        centers = np.sort(centers)
    else:
        there, back = _MAPS[mode]
        weights = tail_weights(values, n) if mode == "lut_tail_weighted" else None
        centers = np.sort(back(scalar_kmeans(there(values), k, weights=weights, counts=n)[0]))
    return centers, np.searchsorted((centers[1:] + centers[:-1]) / 2, values, side="left")


def value_histogram(rows: DataFrame, value: str, bins: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of the values of all rows in bins of equal width: at most `bins` rows come to the driver."""
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if ends["low"] is None:
        return np.zeros(0), np.zeros(0)
    width = max((ends["high"] - ends["low"]) / bins, 1e-300)
    place = F.least(F.floor((F.col(value) - ends["low"]) / width), F.lit(bins - 1))
    got = rows.groupBy(place.alias("bin")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("bin").toArrow()
    return got.column("mean").to_numpy(), got.column("n").to_numpy().astype(float)


def joint_scale_sums(rows: DataFrame, key: str) -> DataFrame:
    """Scales s0, s1 of two layers for each key, from rows with codes q0, q1, values a0, a1 and products g00, g01, g11: the normal equations as sums over all rows."""
    l00, l01, l11 = F.sum(F.expr("q0 * q0 * g00")), F.sum(F.expr("q0 * q1 * g01")), F.sum(F.expr("q1 * q1 * g11"))
    r0, r1 = F.sum(F.expr("q0 * (g00 * a0 + g01 * a1)")), F.sum(F.expr("q1 * (g01 * a0 + g11 * a1)"))
    det = l00 * l11 - l01 * l01
    return rows.groupBy(key).agg(((l11 * r0 - l01 * r1) / det).alias("s0"), ((l00 * r1 - l01 * r0) / det).alias("s1"))


def norm_codes(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """Adds norm_code, the nearest center of each row's norm, as an expression over at most 256 constants."""
    edges = F.array(*[F.lit(float(e)) for e in (centers[1:] + centers[:-1]) / 2])
    return rows.withColumn("norm_code", F.size(F.filter(edges, lambda e: e < F.col("norm"))))


def budget(forest: DataFrame, codec: DataFrame, n_layers: int, code_bits: int = 8) -> DataFrame:
    """Bits for each vector, by part: codes, coefficient streams, tree."""
    n = forest.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cid").alias("lists"))
    bits = codec.agg((F.sum(F.length("payload")) * 8 + F.sum(F.size("lens")) * 8).alias("coeff"))
    both = n.crossJoin(bits)
    return both.select(F.explode(F.array(
        F.struct(F.lit("codes").alias("part"), F.lit(float(n_layers * code_bits)).alias("bits")),
        F.struct(F.lit("coefficients").alias("part"), (F.col("coeff") / F.col("n")).alias("bits")),
        F.struct(F.lit("tree").alias("part"), ((2 * F.col("n") + F.col("lists")) / F.col("n")).alias("bits")),
    )).alias("r")).select("r.*")



"""Vector arithmetic as column expressions, in double precision and inside code generation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The smallest squared norm that counts as more than nothing.
EPS = 1e-6


def as_double(x: Column | str) -> Column:
    return F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda u, v: u * v))


def norm2(x: Column | str) -> Column:
    return dot(x, x)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda u, v: u - v)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda u, v: u + v)


def scale(x: Column | str, by: Column | float) -> Column:
    return F.transform(_c(x), lambda v: v * by)


def l2sq(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda u, v: (u - v) * (u - v)))


def normalise(x: Column | str) -> Column:
    """x / |x|; a vector whose squared norm is below EPS stays as it is."""
    n2 = norm2(x)
    return F.when(n2 < EPS, _c(x)).otherwise(scale(x, 1.0 / F.sqrt(n2)))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(norm2(a)), F.lit(floor)) * F.greatest(F.sqrt(norm2(b)), F.lit(floor)))


def angle_degrees(a: Column | str, b: Column | str) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b)))))


def mean_vectors(rows: DataFrame, key: str, x: str, out: str = "c") -> DataFrame:
    """The mean vector of each key, in one pass with a map-side combine."""
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(x)))).alias(out))

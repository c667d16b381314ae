"""Samples that depend on ids and a seed alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bottom_k(rows: DataFrame, k: int, ident: str = "vec_id", seed: int = 12345) -> DataFrame:
    """k rows with the smallest multiplicative hashes of their ids: one pass, each task keeps its own k."""
    # (id * 2654435761 + seed) mod 2^32, with the id's low and high 16 bits apart so that no product leaves 64 bits.
    by, most = F.lit(2654435761).cast("long"), F.lit(4294967296).cast("long")
    low32 = F.pmod(F.col(ident).cast("long"), most)
    high, low = F.shiftright(low32, 16), low32.bitwiseAND(F.lit(65535).cast("long"))
    key = ((high * by) % most * 65536 + low * by + seed) % most
    return rows.orderBy(key, ident).limit(k)

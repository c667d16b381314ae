"""Best-fit packing with Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most `capacity` of them. The pieces of all
documents are counted by length (a table of at most `capacity` rows, whatever the corpus), and
the instance is solved on those counts, each step for all pieces of a length at once:

1. Reduction. For the longest open length a, with r = capacity - a left beside it, the set {a} or
   {a, b} is fixed for good where it dominates every other set that holds a: nothing fits
   beside a; or b fills r; or no two pieces fit in r; or no two or more pieces that fit in r
   sum to more than b, b being the longest that fits. The rest is a smaller instance with the
   same optimum. Rounds go on until no length reduces.
2. Best fit, longest first, of the remainder.

The solution is a list of ranges: the pieces of one length with ranks lo..hi go to sequences
base.. at an offset. Its size depends on the capacity, not on the corpus. Ranks come from
counts by (block of the table, length), so that no length, however common, is sorted in one
task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.shared import documents, spool
from orrery.llm.units import WordIds

CAPACITY = 4096
END_ID = 1


def _sums_of_two_or_more(lengths: list[int], capacity: int) -> int:
    """Bit s is set if two or more of the lengths, each as often as you like, can sum to s."""
    mask = (1 << (capacity + 1)) - 1
    single = sum(1 << x for x in lengths)
    any_sum = 1
    for x in lengths:
        step = x
        while step <= capacity:
            any_sum |= (any_sum << step) & mask
            step *= 2
    more = 0
    for x in lengths:
        more |= ((any_sum & ~1) << x) & mask
    return more & ~(single & ~more)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed for good with their number, and the counts of what remains open."""
    left = {x: n for x, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        sums, known = 0, -1
        for a in sorted(left, reverse=True):
            while left.get(a):
                room = capacity - a
                others = sorted(x for x in left if x <= room and (x != a or left[a] > 1))
                if not others:
                    fixed.append(((a,), left.pop(a)))
                    changed = True
                    break
                b, low = others[-1], others[0]
                two_low = 2 * low if left[low] - (a == low) > 1 else low + (others[1] if len(others) > 1 else capacity)
                if b != room and two_low <= room:
                    if b + low <= room:
                        break
                    if known != len(left):
                        sums, known = _sums_of_two_or_more(sorted(left), capacity), len(left)
                    if (sums >> (b + 1)) & ((1 << (room - b)) - 1):
                        break
                n = left[a] // 2 if a == b else min(left[a], left[b])
                fixed.append(((a, b), n))
                changed = True
                for x in (a, b):
                    left[x] -= n
                for x in {a, b}:
                    if not left[x]:
                        del left[x]
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first: sets as (length, times) with the number of such sets."""
    open_sets: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for x in sorted(counts, reverse=True):
        n = counts[x]
        for room in sorted(r for r in open_sets if r >= x and open_sets[r]):
            if not n:
                break
            times, after = room // x, []
            for content, m in open_sets.pop(room):
                full = min(m, n // times)
                if full:
                    open_sets[room - times * x].append(([*content, (x, times)], full))
                    n -= full * times
                if m > full and n:
                    open_sets[room - n * x].append(([*content, (x, n)], 1))
                    full, n = full + 1, 0
                if m > full:
                    after.append((content, m - full))
            if after:
                open_sets[room] = open_sets.get(room, []) + after
        if n:
            times = capacity // x
            if n // times:
                open_sets[capacity - times * x].append(([(x, times)], n // times))
            if n % times:
                open_sets[capacity - n % times * x].append(([(x, n % times)], 1))
    return [s for sets in open_sets.values() for s in sets]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    sets = [([(s[0], len(s))] if s[0] == s[-1] else [(x, 1) for x in s], n) for s, n in fixed]
    return sets + best_fit(left, capacity)


def ranges(sets: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows (lo, base, offset, times). Rank r from lo on has sequence base + (r - lo) // times."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranked: dict[int, int] = defaultdict(int)
    base = 0
    for content, n in sets:
        offset = 0
        for x, times in content:
            rows[x].append((ranked[x], base, offset, times))
            ranked[x] += n * times
            offset += x * times
        base += n
    return {x: np.array(r, dtype=np.int64) for x, r in rows.items()}


@cache
def _ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path).ids
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                whole = ids(text or "") + end
                for k in range(0, len(whole), 4 * capacity):
                    part = whole[k : k + 4 * capacity]
                    at.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def _place(plan: dict[int, np.ndarray]):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            values, firsts = np.unique(length[order], return_index=True)
            for x, rows in zip(values, np.split(order, firsts[1:])):
                table = plan[int(x)]
                lo, base, off, times = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1].T
                sequence[rows] = base + (rank[rows] - lo) // times
                offset[rows] = off + (rank[rows] - lo) % times * x
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return placed


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text has the end id alone. Only documents longer than the capacity are cut.
    Null and repeated ids are packed row by row like any other. Other columns of docs are left
    out. An empty table gives an empty table.
    """
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {two.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    cut = spool(two.mapInArrow(_pieces(tokenizer_path, capacity, end_id), schema).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    cut = cut.withColumn("block", F.shiftright("rid", 33))
    by_block = cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = ranges(solve(counts, capacity))
    before = by_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = (
        cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "block").orderBy("rid")) - 1)
        .join(before, ["length", "block"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    )
    return ranked.mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))

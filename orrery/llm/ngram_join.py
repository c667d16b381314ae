"""Near-duplicate documents by an exact Jaccard join on word shingles, with a token-group matrix.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two documents link
when their sets' Jaccard similarity is 0.75 or more.

1. Common shingles are counted over all documents in blocks of a few MB; shingles repeated
   within blocks are summed up, and the most frequent of them (a bounded number) come last in
   the order of shingles. Any order gives the same links; this one keeps a passage that many
   documents share from making candidates.
2. Groups. Within a block, documents that link are put in one group (equal sets fold into one
   member). A group stands for its documents from here on.
3. Candidates. A document that links to another shares with it one of its first
   n - ceil(0.75 n) + 1 shingles. These prefixes, joined over a group's members, are dealt out by
   shingle as packed arrays. Groups that meet at a shingle have their common prefix shingles
   counted, and that count plus the longest remainder bounds the overlap of any two members;
   pairs of groups below what a link needs are never opened.
4. Opening. A qualifying group is rebuilt as a matrix: the union of its members' shingles, and a
   bit row for each member. Each member's overlap with the other group's union is bounded
   first; only members that could link are multiplied out. One link joins two groups.
5. Two rounds: neighbours in each shingle's list first, which joins the large groups of near
   copies in linear work; then groups that meet and lie in different components still. A
   shingle that only one component has by now can add to no overlap between components, so a
   group's count of the other ones bounds its overlap with all groups at once. That bound drops
   the fringe of a family of near copies before any pair of it is spelled out.
6. Hot shingles. What is counted as common in more than LONGEST_LIST sets is dealt out in parts,
   and a list that is still longer than that in the second round is cut into chunks of like
   sizes, of which pairs are joined whose bounds let them link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.components import connected_components
from orrery.llm.shared import _MULTIPLIER, Names, documents, join_unique, mix, spool, text_slices, unspool, windows, without, words

WIDTH = 5
#: A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that come last in the order, at most; this bounds what is sent to all tasks (1 MB).
MOST_COMMON = 1 << 17
#: Documents that share a shingle before it counts as common.
COMMON = 8
#: Shingles that a task counts together.
COUNTED_SHINGLES = 3_000_000
#: Text bytes of a block, in which groups are formed, and prefix shingles of a bucket.
BLOCK_BYTES, BUCKET_SHINGLES = 3 << 19, 1_000_000
#: Prefix shingles that a task deals out at once.
DEALT_SHINGLES = 300_000
#: Groups of a list that one task looks at together, and rows of them that are compared with the others at once.
LONGEST_LIST, COMPARED = 1 << 15, 256
#: Members of a group. A larger cluster is cut into several, which the first round joins again.
MOST_MEMBERS = 256
#: In the first round: the next so many groups of a list, by size, are a group's neighbours; and as
#: they aren't neighbours in all lists they share, what is seen in common counts so many times.
NEAR, SEEN_OF = 4, 3
ADDED = ["n_shingles", "component_id"]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, where, counts = words(texts, fold=True)
    runs, at = windows(hashes, where, WIDTH)
    bounds = np.searchsorted(where[at], np.arange(len(texts) + 1))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sets = []
    for i, n in enumerate(counts):
        if n >= WIDTH:
            sets.append(np.unique(runs[bounds[i] : bounds[i + 1]]))
        elif n:
            total = np.full(1, n, dtype=np.uint64)
            for h in hashes[firsts[i] : firsts[i] + n]:
                total = mix(total * np.uint64(_MULTIPLIER) + h)
            sets.append(total)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def needed(a, b):
    """The overlap that sets of a and b shingles need to link: i >= p (a + b) / (100 + p)."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


class Order:
    """Shingles by hash, but the common ones last, from the least to the most frequent."""

    def __init__(self, common: np.ndarray, counts: np.ndarray) -> None:
        by_hash = np.argsort(common)
        self.common, self.counts = common[by_hash], counts[by_hash]
        #: Shingles dealt out in several parts, and the number of these.
        hot = self.counts > LONGEST_LIST
        self.split, self.parts = self.common[hot], -(-self.counts[hot] // LONGEST_LIST)

    def bucket(self, shingle: np.ndarray, gid: np.ndarray, n_buckets: int) -> np.ndarray:
        """The bucket of each entry: that of its shingle, or of a part of it drawn by the group."""
        key = shingle.copy()
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, shingle), len(self.split) - 1)
            hot = np.flatnonzero(self.split[at] == shingle)
            part = mix(gid[hot].astype(np.uint64) ^ shingle[hot]) % self.parts[at[hot]].astype(np.uint64)
            key[hot] = mix(shingle[hot] + part)
        return (key % np.uint64(n_buckets)).astype(np.int64)

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        k = prefix_size(len(shingles))
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
            late = self.common[at] == shingles
            if late.any():
                last = shingles[late][np.argsort(self.counts[at[late]], kind="stable")]
                return np.concatenate([shingles[~late], last])[:k]
        return shingles[:k]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two or more different sets of a task's texts have, and how many."""
    seen: set[int] = set()
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        shingles, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        held.clear()
        more = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(shingles[more].astype(np.int64)), pa.array(counts[more])], ["shingle", "n"])

    for batch in batches:
        for _, _, texts in text_slices(batch, 0, BLOCK_BYTES):
            for s in shingle_sets(texts):
                key = xxhash.xxh3_64_intdigest(s.tobytes())
                if key not in seen:
                    seen.add(key)
                    held.append(s)
            if sum(map(len, held)) >= COUNTED_SHINGLES:
                yield counted()
    yield counted()


def _cluster(sets: list[np.ndarray], prefixes: list[np.ndarray]) -> np.ndarray:
    """The cluster of each set: linked neighbours in the lists of the block's prefix shingles."""
    parent = np.arange(len(sets))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    shingles = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
    owners = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
    order = np.lexsort((owners, sizes[owners], shingles))
    shingles, owners = shingles[order], owners[order]
    met = shingles[1:] == shingles[:-1]
    pairs, counts = np.unique(np.stack([owners[:-1][met], owners[1:][met]]), axis=1, return_counts=True) if met.any() else (np.zeros((2, 0), int), [])
    for a, b, n in zip(*pairs, counts):
        rest = max(sizes[a] - len(prefixes[a]), sizes[b] - len(prefixes[b]))
        if n + rest >= needed(sizes[a], sizes[b]) and (x := find(a)) != (y := find(b)) and links(sets[a], sets[b]):
            parent[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))], dtype=np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, laid out by byte planes so that what repeats compresses away."""
    planes = b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(blob: bytes, n_arrays: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return [np.ascontiguousarray(part.reshape(8, -1).T).view("<i8").ravel() for part in np.split(data, n_arrays)]


def _sketch(order: Order, n_buckets: int):
    """Rows of two kinds: a document with its size, its group and whether it is the first in its block with its set, and a bucket's packed prefixes."""
    names = ["rid", "id", "n", "gid", "first", "bucket", "blob"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_group = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        for batch in batches:
            kind = batch.schema.field(1).type
            gathered: list[np.ndarray] = []

            def dealt(gathered=gathered, kind=kind) -> pa.RecordBatch:
                gid, shingle, low, high, rest = np.concatenate(gathered, axis=1)
                gathered.clear()
                bucket = order.bucket(shingle.astype(np.uint64), gid, n_buckets)
                by = np.lexsort((gid, bucket))
                values, firsts = np.unique(bucket[by], return_index=True)
                blobs = [_pack(shingle[rows], np.diff(gid[rows], prepend=0), low[rows], high[rows] - low[rows], rest[rows]) for rows in np.split(by, firsts[1:])]
                n = len(blobs)
                return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(values, pa.int32()), pa.array(blobs, pa.binary())], names)

            for a, b, texts in text_slices(batch, 2, BLOCK_BYTES):
                sets = shingle_sets(texts)
                distinct: dict[bytes, int] = {}
                member = np.array([distinct.setdefault(s.tobytes(), len(distinct)) for s in sets], dtype=np.int64)
                kept = [np.frombuffer(k, dtype=np.uint64) for k in distinct]
                prefixes = [order.prefix(s) for s in kept]
                cluster = _cluster(kept, prefixes)
                gids, names_of = np.zeros(len(kept), dtype=np.int64), {}
                for i, c in enumerate(cluster):  # clusters beyond MOST_MEMBERS go on under a new name
                    name, n = names_of.get(c, (-1, MOST_MEMBERS))
                    if n >= MOST_MEMBERS:
                        name, n, next_group = next_group, 0, next_group + 1
                    names_of[c] = (name, n + 1)
                    gids[i] = name
                sizes = np.array([len(s) for s in kept], dtype=np.int64)
                n_rows, n_of = b - a, sizes[member]
                first = np.zeros(n_rows, dtype=bool)
                first[np.unique(member, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n_rows), batch.column(1).slice(a, n_rows), pa.array(n_of),
                        pa.array(gids[member], mask=n_of == 0), pa.array(first), pa.nulls(n_rows, pa.int32()), pa.nulls(n_rows, pa.binary()),
                    ],
                    names,
                )
                rest = sizes - np.array([len(p) for p in prefixes], dtype=np.int64)
                owner = np.repeat(np.arange(len(kept)), [len(p) for p in prefixes])
                if len(owner):
                    table = pd.DataFrame({"gid": gids, "low": sizes, "high": sizes, "rest": rest}).groupby("gid").agg({"low": "min", "high": "max", "rest": "max"})
                    entry = np.unique(np.stack([gids[owner], np.concatenate(prefixes).astype(np.int64)]), axis=1)
                    gathered.append(np.vstack([entry, table.loc[entry[0]].to_numpy().T]))
                if sum(g.shape[1] for g in gathered) >= DEALT_SHINGLES:
                    yield dealt()
            if gathered:
                yield dealt()

    return sketched


LISTS = "gids array<long>, low array<long>, high array<long>, rest array<long>, weight long, split long"


def _met_sizes(shingle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each entry has another of its shingle that is near enough in size, of entries by shingle and least size."""
    near = (shingle[1:] == shingle[:-1]) & (low[1:] * PERCENT <= high[:-1] * 100)
    # An entry of wide range may reach past its neighbour, so runs of entries are told apart by the greatest size so far.
    if (high > low).any():
        new = np.append(True, shingle[1:] != shingle[:-1])
        step = high.max() + 1
        so_far = np.maximum.accumulate(np.cumsum(new) * step + high) - np.cumsum(new) * step
        near = (shingle[1:] == shingle[:-1]) & (low[1:] * PERCENT <= so_far[:-1] * 100)
    return np.append(False, near) | np.append(near, False)


def _lists(hot: np.ndarray):
    """The groups that have a shingle of a bucket in common, by size; equal lists once, with the number of their shingles. A list of a hot shingle names it."""

    def listed(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, 5) for b in table.column("blob").to_pylist()]
        shingle, gid, low, span, rest = (np.concatenate(x) for x in zip(*([p[0], np.cumsum(p[1]), *p[2:]] for p in parts)))
        order = np.lexsort((gid, low, shingle))
        elsewhere = np.isin(shingle, hot.astype(np.int64))  # other parts of the list are in other buckets
        order = order[_met_sizes(shingle[order], low[order], (low + span)[order]) | elsewhere[order]]
        shingle = shingle[order]
        firsts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        ends = np.append(firsts[1:], len(shingle))
        split = np.isin(shingle[firsts], hot.astype(np.int64))
        several = (ends - firsts > 1) | split
        ordered = np.ascontiguousarray(gid[order])
        weights: dict[tuple, int] = {}
        where: dict[tuple, np.ndarray] = {}
        for i, j, name in zip(firsts[several], ends[several], split[several]):
            key = (int(shingle[i]) if name else None, ordered[i:j].tobytes())
            weights[key] = weights.get(key, 0) + 1
            where.setdefault(key, order[i:j])
        lists = [[column[at] for at in where.values()] for column in (gid, low, low + span, rest)]
        kind = pa.list_(pa.int64())
        return pa.table({
            **{name: pa.array(x, kind) for name, x in zip(("gids", "low", "high", "rest"), lists)},
            "weight": pa.array(list(weights.values()), pa.int64()), "split": pa.array([k for k, _ in weights], pa.int64()),
        })

    return listed


#: Words of 64 bits of the filter over a group's live lists.
FILTER_WORDS = 8
BITS = [f"bits{k}" for k in range(FILTER_WORDS)]
MET = ["gid", "component", "low", "high", "rest", "live", "before", *BITS]


def _meeting(one: dict[str, np.ndarray], two: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """The pairs of a list's groups, or of two chunks of it, that could link by their sizes and by what is live of them.

    Two groups share at most what is live of either, less the lists that its filter shows and the
    other's doesn't. And if they share as much as a link needs, then the first list that they share
    leaves enough behind it: a pair comes out there, and where it could be that list.
    """
    x = {c: v[np.argsort(one["low"], kind="stable")] for c, v in one.items()}
    y = x if two is None else two
    for at in range(0, len(x["gid"]), COMPARED):
        a = {c: v[at : at + COMPARED, None] for c, v in x.items()}
        b = {c: v[at:] for c, v in y.items()} if two is None else y
        # Prefix shingles in common that a link needs.
        wanted = needed(a["low"], b["low"]) - np.maximum(a["rest"], b["rest"])
        could = (a["component"] != b["component"]) & (a["low"] * PERCENT <= b["high"] * 100) & (b["low"] * PERCENT <= a["high"] * 100)
        could &= (a["live"] - a["before"] >= wanted) & (b["live"] - b["before"] >= wanted)
        if two is None:
            could &= np.arange(len(a["gid"]))[:, None] < np.arange(len(b["gid"]))
        i, j = np.nonzero(could)
        only_a, only_b = (sum(np.bitwise_count((p[c][m].ravel() & ~q[c][k].ravel()).view(np.uint64)).astype(np.int64) for c in BITS) for p, m, q, k in ((a, i, b, j), (b, j, a, i)))
        share = np.minimum(a["live"][i, 0] - only_a, b["live"][j] - only_b) >= wanted[i, j]
        one_, other = a["gid"][i[share], 0], b["gid"][j[share]]
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one_, other)), pa.array(np.maximum(one_, other))], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with one or two arrays of groups."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = [batch.column(c).slice(k, 1).flatten() for c in range(batch.num_columns)]
            yield from _meeting(*([{c: s.field(c).to_numpy() for c in MET} for s in sides] + [None])[:2])


def _matrix(table: pa.Table) -> pa.Table:
    """A group as the union of its members' shingles and a packed bit row for each member."""
    sets = list({s.tobytes(): s for s in shingle_sets(_texts(table, 1))}.values())
    union = np.unique(np.concatenate(sets))
    bits = np.zeros((len(sets), len(union)), dtype=bool)
    for i, s in enumerate(sets):
        bits[i, np.searchsorted(union, s)] = True
    return pa.table({
        "gid": pa.array([table.column(0)[0].as_py()], pa.int64()), "members": pa.array([len(sets)], pa.int32()),
        "tokens": pa.array([union.astype("<u8").tobytes()], pa.binary()), "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
    })


def _opened(group: dict) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.frombuffer(group["tokens"], dtype="<u8")
    rows = np.frombuffer(group["bits"], dtype=np.uint8).reshape(group["members"], -1)
    return tokens, np.unpackbits(rows, axis=1, count=len(tokens)).astype(np.float32)


def groups_link(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether any member of one group links to any of the other."""
    (t1, m1), (t2, m2) = one, two
    _, at1, at2 = np.intersect1d(t1, t2, assume_unique=True, return_indices=True)
    n1, n2, c1, c2 = m1.sum(1), m2.sum(1), m1[:, at1], m2[:, at2]
    # A member's overlap with the other group's union bounds its overlap with any member there.
    may1, may2 = (100 * c.sum(1) >= PERCENT * n for c, n in ((c1, n1), (c2, n2)))
    if not (may1.any() and may2.any()):
        return False
    common = c1[may1] @ c2[may2].T
    return bool((100 * common >= PERCENT * (n1[may1][:, None] + n2[may2] - common)).any())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for at in range(0, batch.num_rows, 32):
            rows = batch.slice(at, 32).to_pylist()
            found += [(r["a"], r["b"]) for r in rows if groups_link(_opened(r["x"]), _opened(r["y"]))]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Join:
    def __init__(self, texts: DataFrame, sketch: DataFrame) -> None:
        self.texts, self.sketch = texts, sketch

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs of groups that hold a link, of the pairs a, b given."""
        pairs = spool(pairs.select("a", "b"), "pairs")
        wanted = pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct()
        members = self.sketch.where("gid is not null and first").select("rid", "gid").join(wanted, "gid")
        matrices = spool(
            self.texts.join(members.hint("shuffle_hash"), "rid")
            .select("gid", "text")
            .groupBy("gid")
            .applyInArrow(_matrix, "gid long, members int, tokens binary, bits binary"),
            "matrices",
        )
        whole = matrices.select(F.col("gid"), F.struct("members", "tokens", "bits").alias("m"))
        both = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
        found = spool(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")
        unspool(pairs)
        unspool(matrices)
        return found


def _renamed(sketch: DataFrame, merged: DataFrame) -> DataFrame:
    rows = sketch.where("gid is not null and first").select("rid", "gid", "first").join(merged.select("gid", "name"), "gid", "left")
    return rows.select("rid", F.coalesce("name", "gid").alias("gid"), "first")


def _met(named: DataFrame) -> DataFrame:
    """The pairs of groups of different components that could link, from some of the lists they meet in."""
    group, pair = F.collect_list(F.struct(*MET)).alias("g"), "a long, b long"
    met = named.where(F.col("n_groups") <= LONGEST_LIST).groupBy("list").agg(group).select("g").mapInArrow(_meet, pair)
    # Chunks of like sizes and like live shares, none longer than a list may be.
    chunk = F.struct(
        F.floor(F.log(1.15, F.col("low"))).alias("size"), F.floor(8 * F.least(F.col("live") / F.col("low"), F.lit(1.0))).alias("share"),
        F.pmod(F.xxhash64("gid"), F.ceil(F.col("n_groups") / LONGEST_LIST)).alias("salt"),
    )
    bounds = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"), F.max("live").alias("live")]
    long = named.where(F.col("n_groups") > LONGEST_LIST).withColumn("chunk", chunk).groupBy("list", "chunk").agg(*bounds, group)
    x, y = (long.select("list", *[F.col(c).alias(f"{c}_{k}") for c in ("chunk", "low", "high", "rest", "live", "g")]) for k in "ab")
    overlap = F.least("live_a", "live_b") + F.greatest("rest_a", "rest_b")
    could = (F.col("low_a") * PERCENT <= F.col("high_b") * 100) & (F.col("low_b") * PERCENT <= F.col("high_a") * 100) & ((100 + PERCENT) * overlap >= PERCENT * (F.col("low_a") + F.col("low_b")))
    apart = x.join(y, "list").where((F.col("chunk_a") < F.col("chunk_b")) & could)
    return met.union(long.select("g").mapInArrow(_meet, pair)).union(apart.select("g_a", "g_b").mapInArrow(_meet, pair))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(*[x[c].alias(f"{c}_{k}") for x, k in ((a, "a"), (b, "b")) for c in ("gid", "low", "high", "rest")])


def _fits(a: Column, b: Column) -> Column:
    """Whether members of both could be near enough in size."""
    return (a["low"] * PERCENT <= b["high"] * 100) & (b["low"] * PERCENT <= a["high"] * 100)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid (place in docs), id, n (shingles) and component, null without shingles, of each row."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    common = (
        texts.select("text").mapInArrow(_common, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toPandas()
    )
    order = Order(common["shingle"].to_numpy().astype(np.uint64), common["n"].to_numpy())
    # Buckets by the bytes of text: about one shingle for 6 bytes, of which a quarter is prefix. As few as
    # a task's memory allows, since equal lists fold within a bucket.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, math.ceil(size / 24 / BUCKET_SHINGLES))
    schema = f"rid long, id {texts.schema['id'].dataType.simpleString()}, n long, gid long, first boolean, bucket int, blob binary"
    sketch = spool(texts.mapInArrow(_sketch(order, n_buckets), schema), "sketch")
    lists = sketch.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_lists(order.split), LISTS)
    lists = lists.groupBy("gids", "split").agg(*[F.first(c).alias(c) for c in ("low", "high", "rest")], F.sum("weight").alias("weight"))
    # Parts of one hot shingle's list have one number, below 0.
    number = F.when(F.col("split").isNotNull(), -1 - F.shiftrightunsigned("split", 1)).otherwise(F.monotonically_increasing_id())
    lists = spool(lists.withColumn("list", number), "lists")
    join = _Join(texts.select("rid", "text"), sketch)

    groups = F.arrays_zip(F.col("gids").alias("gid"), "low", "high", "rest")
    near = F.flatten(F.transform(groups, lambda a, i: F.transform(F.filter(F.slice(groups, i + 2, F.lit(NEAR)), lambda b: _fits(a, b)), lambda b: _pair(a, b))))
    first = join.linked(_counted(lists.select("weight", F.inline(near))))
    component = spool(connected_components(first), "component")
    # Groups of one component become one group, or a few of bounded size, before all pairs are looked at.
    sizes = sketch.where("gid is not null and first").groupBy("gid").agg(F.count(F.lit(1)).alias("k"))
    parts = sizes.join(component.withColumnRenamed("node", "gid"), "gid").select("gid", "component", "k")
    totals = parts.groupBy("component").agg(F.ceil(F.sum("k") / MOST_MEMBERS).alias("n"))
    parts = parts.join(totals, "component").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("n")))
    names = parts.groupBy("component", "part").agg(F.min("gid").alias("name"))
    merged = spool(parts.join(names, ["component", "part"]).select("gid", "component", "name"), "merged")
    named = lists.select("list", "weight", F.inline(groups)).join(merged, "gid", "left")
    named = named.withColumns({"component": F.coalesce("component", "gid"), "gid": F.coalesce("name", "gid")})
    named = named.groupBy("list", "gid").agg(F.first("weight").alias("weight"), F.first("component").alias("component"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"))
    # A list whose groups are in one component already has nothing to add.
    mixed = named.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n_groups")).where("x <> y")
    named = spool(named.join(mixed.select("list", "n_groups"), "list"), "named")
    own = Window.partitionBy("gid")
    place = F.pmod(F.xxhash64("list"), F.lit(64 * FILTER_WORDS)).cast("int")
    bits = [F.bit_or(F.when(F.floor(place / 64) == k, F.expr("shiftleft(1L, CAST(pmod(xxhash64(list), 64) AS INT))")).otherwise(F.lit(0).cast("long"))).over(own).alias(c) for k, c in enumerate(BITS)]
    before = F.sum("weight").over(own.orderBy("list")) - F.col("weight")
    live = named.select("*", F.sum("weight").over(own).alias("live"), before.alias("before"), *bits)
    second = _Join(join.texts, _renamed(sketch, merged)).linked(_met(live).distinct())
    whole = _joined(component, connected_components(_between(second, component)))
    rows = sketch.where("bucket is null").select("rid", "id", "n", "gid").join(whole.withColumnRenamed("node", "gid"), "gid", "left")
    rows = spool(rows.select("rid", "id", "n", F.coalesce("component", "gid").alias("component")), "rows")
    unspool(sketch, lists, first, component, merged, named, second)
    return rows


def _between(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Links of groups as links of the components they are in so far; a group without one stands for itself."""
    for end in "ab":
        pairs = pairs.join(component.toDF(end, "c"), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return pairs


def _joined(component: DataFrame, again: DataFrame) -> DataFrame:
    """node and component of all groups, of their components so far and of the components of these."""
    moved = join_unique(component.toDF("node", "at"), again.toDF("at", "last"), ["at"], "node", "left").select("node", F.coalesce("last", "at").alias("component"))
    return moved.union(again.join(component.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs, less its text, with n_shingles and component_id.

    docs has to be a stored table. Words are runs of anything but ASCII white space, A-Z
    lower-cased. A text with fewer than 5 words has its whole word sequence as its one shingle;
    one without words, or null, has none and stays alone with its own id. Repeated rows fall
    into one component. A null id takes part, and is never the component's id unless all its ids
    are null. Columns of docs named like an added column, in any case, are replaced; all other
    names are free. An empty table gives an empty table.
    """
    own = without(docs, [text_col, *ADDED]).columns
    names = Names(own)
    rows = _classes(docs, id_col, text_col)
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    alone = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    found = rows.join(smallest, "component", "left").select("rid", "id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    if own == [id_col]:
        return found.select(F.col("id").alias(id_col), *ADDED)
    kept = docs.select(F.monotonically_increasing_id().alias("rid"), names.pack().alias("row"))
    return kept.join(found, "rid").select(*names.unpack(), *ADDED)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less near duplicates: of each component the row with the smallest id stays.

    Null ids count as the largest; of rows that repeat the smallest id, the first in the table
    stays. Rows without shingles all stay. The columns are those of docs, whatever their names. An
    empty table gives an empty table.
    """
    rows = _classes(docs, id_col, text_col)
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid"))["rid"].alias("rid"))
    stay = first.select("rid").union(rows.where("component is null").select("rid"))
    names = Names(docs.columns)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), names.pack().alias("row"))
    return numbered.join(stay.hint("shuffle_hash"), "rid", "left_semi").select(*names.unpack())


def _counted(meetings: DataFrame) -> DataFrame:
    """The pairs of groups that could link by the prefix shingles at which they meet, taken for 1 of SEEN_OF."""
    pairs = meetings.groupBy(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")).agg(
        F.sum("weight").alias("common"), *[F.min(c).alias(c) for c in ("low_a", "low_b")], *[F.max(c).alias(c) for c in ("rest_a", "rest_b")]
    )
    return pairs.where((100 + PERCENT) * (SEEN_OF * F.col("common") + F.greatest("rest_a", "rest_b")) >= PERCENT * (F.col("low_a") + F.col("low_b")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))

"""Repeated substrings by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has its top bits zero, so
that a cut depends on the bytes before it alone: an insertion moves the cuts near it, and the
chunks after it come out as before. Chunks get 128-bit digests. Of the chunks with one digest,
the first (in order of the table's rows, then of place) stays and the others are repeats.

Chunks are first folded within blocks of a few MB, so that one common passage reaches a bucket
once for each block, however many documents share it. What is left is dealt out by digest as
packed arrays. Neighbouring repeats join into spans.

A shared passage yields the chunks that lie wholly inside it. So each span is then extended to
both sides, byte by byte, as far as the text around it equals the text around the first place
of its outer chunks. Texts give out the bytes around the places asked of them, a few hundred at
first and more for those edges that are still equal at the end of these. Extended spans of at
least `min_bytes` count. Each of their bytes stands in an earlier place too, so that cutting
all spans out loses no passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.ngram_join import _pack, _unpack
from orrery.llm.shared import Names, documents, join_unique, mix, slices, spool, struct_of, unspool

#: A cut may fall where the hash's top CUT_BITS are zero, at least MIN_CHUNK bytes after the last place where it might; longer chunks are cut at MAX_CHUNK.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 5, 16, 512
#: Spans of repeats shorter than this stay: about 20 words.
MIN_BYTES = 120
BLOCK_BYTES, BUCKET_CHUNKS = 4 << 20, 500_000
#: Bytes compared around an edge of a span in the first round. Rounds go on until no edge is open, with 8 times the bytes each,
#: up to WIDE_REACH, or beyond it as long as all open edges together stay within ROUND_BYTES.
FIRST_REACH, WIDE_REACH, ROUND_BYTES = 256, 4096, 64 << 20
_SPAN = "rid long, start long, length long, first_rid long, first_start long"
_EDGE = "start long, right boolean, place long, to_rid long, to_place long, gained long"
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_GEAR[0] = 0
_WINDOW = 32


def cuts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each chunk's first and last place in it, and its text."""
    gap = bytes(_WINDOW)
    data = gap.join([b"", *texts])
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    firsts = np.cumsum(sizes + _WINDOW) - sizes
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    step = 1
    while step < _WINDOW:  # the hash of twice as many bytes, out of two neighbouring ones
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    may = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    where = np.searchsorted(firsts, may, side="right") - 1
    inside = (where >= 0) & (may < (firsts + sizes)[where]) & (may > firsts[where])
    may, where = may[inside], where[inside]
    far = np.diff(may, prepend=-MIN_CHUNK) >= MIN_CHUNK
    full = sizes > 0
    starts = np.concatenate([firsts[full], may[far]])
    owner = np.concatenate([np.flatnonzero(full), where[far]])
    order = np.argsort(starts, kind="stable")
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:], len(data))
    ends = np.minimum(ends, (firsts + sizes)[owner])
    parts = -(-(ends - starts) // MAX_CHUNK)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    owner, ends, starts = np.repeat(owner, parts), np.repeat(ends, parts), np.repeat(starts, parts) + nth * MAX_CHUNK
    return data, starts, np.minimum(starts + MAX_CHUNK, ends), owner


def _chunks(n_buckets: int):
    """Rows of two kinds: a repeat within its block, and a bucket's packed first chunks."""
    names = ["rid", "start", "length", "first_rid", "first_start", "bucket", "blob"]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, BLOCK_BYTES):
                data, starts, ends, owner = cuts(texts[a:b])
                if not len(starts):
                    continue
                sizes = np.fromiter((len(t) for t in texts[a:b]), dtype=np.int64, count=b - a)
                place = starts - (np.cumsum(sizes + _WINDOW) - sizes)[owner]
                rid, length = rids[a:b][owner], ends - starts
                seen: dict[bytes, int] = {}
                digest = xxhash.xxh3_128_digest
                first = np.fromiter((seen.setdefault(digest(data[i:j]), k) for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist()))), dtype=np.int64, count=len(starts))
                again = np.flatnonzero(first != np.arange(len(first)))
                new = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
                high, low = np.frombuffer(b"".join(seen), dtype=">u8").reshape(-1, 2).astype(np.int64).T
                bucket = (high.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
                by = np.lexsort((new, bucket))
                values, at = np.unique(bucket[by], return_index=True)
                blobs = [_pack(high[x], low[x], np.diff(rid[new[x]], prepend=0), place[new[x]], length[new[x]]) for x in np.split(by, at[1:])]
                n, m = len(again), len(blobs)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (rid[again], place[again], length[again], rid[first[again]], place[first[again]])), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names,
                )
                yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 5, pa.array(values, pa.int32()), pa.array(blobs, pa.binary())], names)

    return chunked


def _repeats(table: pa.Table) -> pa.Table:
    """All but the first chunk of each digest of a bucket."""
    parts = [_unpack(b, 5) for b in table.column("blob").to_pylist()]
    high, low, rid, start, length = (np.concatenate(x) for x in zip(*([*p[:2], np.cumsum(p[2]), *p[3:]] for p in parts)))
    order = np.lexsort((start, rid, low, high))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]][~new]
    at = order[~new]
    return pa.table({"rid": rid[at], "start": start[at], "length": length[at], "first_rid": rid[first], "first_start": start[first]})


def _runs(texts: DataFrame) -> DataFrame:
    """Runs of neighbouring repeats, a spooled table: rid, start, length, n_chunks, first_rid and first_start of the run's first chunk, last_rid and last_end of its last."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 48 / BUCKET_CHUNKS))
    chunks = spool(texts.mapInArrow(_chunks(n_buckets), f"{_SPAN}, bucket int, blob binary"), "chunks")
    across = spool(chunks.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_repeats, _SPAN), "across")
    # The first chunk of its block may be the repeat of one before the block.
    before = across.select(F.col("rid").alias("first_rid"), F.col("start").alias("first_start"), F.col("first_rid").alias("far_rid"), F.col("first_start").alias("far_start"))
    inside = join_unique(chunks.where("bucket is null").drop("bucket", "blob"), before, ["first_rid", "first_start"], "rid", "left").select(
        "rid", "start", "length", F.coalesce("far_rid", "first_rid").alias("first_rid"), F.coalesce("far_start", "first_start").alias("first_start")
    )
    along = Window.partitionBy("rid").orderBy("start")
    apart = F.when(F.lag(F.col("start") + F.col("length")).over(along) == F.col("start"), 0).otherwise(1)
    first, last = F.min(F.struct("start", "first_rid", "first_start")), F.max(F.struct("start", "first_rid", (F.col("first_start") + F.col("length")).alias("end")))
    runs = (
        inside.unionByName(across)
        .withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "run")
        .agg(first.alias("first"), last.alias("last"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_chunks"))
        .select("rid", "first.start", "length", "n_chunks", "first.first_rid", "first.first_start", F.col("last.first_rid").alias("last_rid"), F.col("last.end").alias("last_end"))
    )
    kept = spool(runs, "runs")
    unspool(chunks, across)
    return kept


def _around(reach: int):
    """The bytes before (or after, if right) each place asked for, `reach` at most."""
    names = ["rid", "start", "right", "place", "to_rid", "to_place", "gained", "bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                asked = part.column(2)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy())
                edge = asked.flatten()
                fields = [edge.field(n) for n in names[1:7]]
                places, rights = edge.field("place").to_pylist(), edge.field("right").to_pylist()
                for a in range(0, len(owner), step := max(1, (8 << 20) // reach)):
                    cut = [texts[k][p : p + reach] if r else texts[k][max(0, p - reach) : p] for k, p, r in zip(owner[a : a + step].tolist(), places[a : a + step], rights[a : a + step])]
                    rids = part.column(0).take(pa.array(owner[a : a + step]))
                    yield pa.RecordBatch.from_arrays([rids, *[f.slice(a, step) for f in fields], pa.array(cut, pa.binary())], names)

    return read


def common(a: bytes, b: bytes, right: bool) -> int:
    """How many bytes two texts have in common at their beginnings (right) or at their ends."""
    n = min(len(a), len(b))
    x, y = (a[:n], b[:n]) if right else (a[len(a) - n :][::-1], b[len(b) - n :][::-1])
    if x == y:
        return n
    low = 0
    while n - low > 1:  # x[:low] equals y[:low], x[:n] differs from y[:n]
        mid = (low + n) // 2
        low, n = (mid, n) if x[low:mid] == y[low:mid] else (low, mid)
    return low


def _compare(reach: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, others, right = (batch.column(n).to_pylist() for n in ("bytes", "other", "right"))
            more = np.fromiter(map(common, own, others, right), dtype=np.int64, count=len(own))
            by = np.where(batch.column("right").to_numpy(zero_copy_only=False).astype(bool), more, -more)
            moved = {"place": by, "to_place": by, "gained": more}
            columns = [pa.array(batch.column(n).to_numpy() + moved[n]) if n in moved else batch.column(n) for n in ("rid", "start", "right", "place", "to_rid", "to_place", "gained")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(more == reach)], ["rid", "start", "right", "place", "to_rid", "to_place", "gained", "open"])

    return compare


def _gains(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """rid, start, left and right of each run: by how many bytes it goes on to either side as around its first place."""
    left = runs.select("rid", "start", F.lit(False).alias("right"), F.col("start").alias("place"), F.col("first_rid").alias("to_rid"), F.col("first_start").alias("to_place"))
    right = runs.select("rid", "start", F.lit(True).alias("right"), (F.col("start") + F.col("length")).alias("place"), F.col("last_rid").alias("to_rid"), F.col("last_end").alias("to_place"))
    edges = left.unionByName(right).withColumn("gained", F.lit(0).cast("long"))
    # At a text's beginning nothing is left to compare.
    edges = edges.where("right or place > 0 and to_place > 0")
    reach, done = FIRST_REACH, None
    while True:
        edge = F.struct(*[F.col(c) for c in ("start", "right", "place", "to_rid", "to_place", "gained")])
        places = edges.select(F.col("to_rid").alias("rid"), "right", F.col("to_place").alias("place")).distinct()
        nothing = F.lit(None).cast("long")
        asked = edges.select("rid", edge.alias("edge")).unionByName(
            places.select("rid", F.struct(nothing.alias("start"), "right", "place", nothing.alias("to_rid"), nothing.alias("to_place"), nothing.alias("gained")).alias("edge"))
        )
        # A text's own places alone come together here.
        lists = asked.groupBy("rid").agg(F.collect_list("edge").alias("asked"))
        around = spool(texts.join(lists, "rid").select("rid", "text", "asked").mapInArrow(_around(reach), f"rid long, {_EDGE}, bytes binary"), "around")
        others = around.where("to_rid is null").select(F.col("rid").alias("to_rid"), F.col("place").alias("to_place"), "right", F.col("bytes").alias("other"))
        pairs = join_unique(around.where("to_rid is not null"), others, ["to_rid", "to_place", "right"], "rid")
        compared = spool(pairs.mapInArrow(_compare(reach), f"rid long, {_EDGE}, open boolean"), "edges")
        unspool(around)
        closed = compared.where("not open").select("rid", "start", "right", "gained")
        done = closed if done is None else done.unionByName(closed)
        edges = compared.where("open").drop("open")
        n_open = edges.count()
        if not n_open:
            break
        reach = min(reach * 8, max(WIDE_REACH, ROUND_BYTES // n_open))
    gained = {side: F.sum(F.when(F.col("right") == F.lit(side == "right"), F.col("gained")).otherwise(0)).alias(side) for side in ("left", "right")}
    return done.groupBy("rid", "start").agg(*gained.values())


def _spans(docs: DataFrame, text_col: str, min_bytes: int) -> DataFrame:
    """rid (place of the row in docs), start, length, n_chunks and first_rid of each span."""
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{text_col}`").alias("text"))
    runs = _runs(texts)
    left, right = F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))
    extended = (
        runs.join(_gains(texts, runs), ["rid", "start"], "left")
        .select("rid", (F.col("start") - left).alias("start"), (F.col("start") + F.col("length") + right).alias("end"), "n_chunks", "first_rid")
        .where(F.col("end") - F.col("start") >= min_bytes)
    )
    # Spans that met each other become one.
    along = Window.partitionBy("rid").orderBy("start", "end")
    apart = F.when(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start"), 0).otherwise(1)
    return (
        extended.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "span")
        .agg(
            F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.sum("n_chunks").alias("n_chunks"),
            F.min(F.struct("start", "end", "first_rid"))["first_rid"].alias("first_rid"),
        )
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per span that repeats earlier text: id_col, start, length (in bytes), n_chunks and
    first_<id_col>, the first row that holds the span's first chunk. Spans are whole repeated
    stretches, up to the bytes where the texts differ; of a character cut in two the bytes on the
    equal side count.

    docs has to be a stored table. Null and empty texts have no spans. A repeated row repeats the
    earlier one whole. A text that repeats itself has spans whose first row is its own. Null ids
    stay null. Other columns of docs are left out, whatever their names. An empty table gives an
    empty table.
    """
    ids = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"))
    return (
        _spans(docs, text_col, min_bytes)
        .join(ids, "rid")
        .join(ids.select(F.col("rid").alias("first_rid"), F.col("id").alias("first_id")), "first_rid")
        .select(F.col("id").alias(id_col), "start", "length", "n_chunks", F.col("first_id").alias(f"first_{id_col}"))
    )


def without_repeats(docs: DataFrame, text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Every row of docs, with the spans that repeat earlier text cut out of its text.

    docs has to be a stored table. Null and empty texts stay, and so does a text without such
    spans. Of a repeated row the later ones come out empty. Ids aren't used; all names of columns
    are free. An empty table gives an empty table.
    """
    names = Names([c for c in docs.columns if c != text_col])
    # A text's own spans alone come together here.
    spans = _spans(docs, text_col, min_bytes).groupBy("rid").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{text_col}`").alias("text"), names.pack().alias("row"))
    packed = rows.join(spans, "rid", "left").select("text", "spans", "row")
    cut = packed.mapInArrow(_cut, struct_of(packed, text="string"))
    columns = dict(zip(names.columns, names.unpack()))
    return cut.select(*[columns.get(c, F.col("text").alias(c)) for c in docs.columns])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [without_spans(t, [(s["start"], s["length"]) for s in spans or ()]) for t, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(2)], ["text", "row"])


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text less the byte spans (start, length); bytes of a character cut in two go with them."""
    if not text:
        return text
    data, kept, at = text.encode(), [], 0
    for start, length in sorted(spans):
        kept.append(data[at:start])
        at = max(at, start + length)
    return b"".join([*kept, data[at:]]).decode(errors="ignore")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir).select("doc_id", "text"))

"""Quality rules with compression bands.

Repetitive text compresses too well and noise hardly at all. Each text is compressed by
zstandard as a whole and in fixed chunks; the ratio (raw bytes / compressed bytes) has to lie
in a band that depends on the length compressed, since a longer text gives the compressor more
context. What is left behind the last full chunk is a chunk too, so that all of a text is in one.
The base rules on words and repeated word windows come first; among the rest the bands decide.
Symbols and repeated lines are counted and reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Names, documents, mix, struct_of, text_slices, windows, words

LEVEL = 3
CHUNK_BYTES = 4096
#: Upper end of a length (bytes) and the band of ratios allowed up to it. From 256 bytes to 32 KB the ends are 0.97 of the least
#: and 1.05 of the greatest ratio of the rows labelled clean at sf0.1 that pass the base rules and have few symbols. No such row is
#: shorter or longer: longer texts keep the low end of 32 KB, as more context only raises a ratio, and wide high ends. Below 64
#: bytes the compressor's own header hides the text.
WHOLE_BANDS = [
    (64, 0.0, 3.0), (256, 0.80, 3.0), (384, 1.33, 1.75), (512, 1.37, 1.94), (768, 1.42, 2.0), (1024, 1.55, 2.08), (1536, 1.67, 2.15), (2048, 1.78, 2.26),
    (3072, 1.86, 2.27), (4096, 1.96, 2.33), (8192, 2.05, 2.46), (16384, 2.14, 2.53), (32768, 2.26, 2.61), (65536, 2.26, 12.0), (float("inf"), 2.26, 16.0),
]
#: Fitted in the same way to the full chunks of those rows.
CHUNK_BAND = (2.01, 2.37)
#: A text fails by its chunks when more than this share of them leaves its band: CHUNK_BAND, or for a shorter last chunk that of its length.
CHUNK_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50

SCHEMA = (
    "id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, whole_ratio double, n_chunks long, n_odd_chunks long, kept boolean"
)
ADDED = [f.strip().split(" ")[0] for f in SCHEMA.split(",")][1:]
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_STARTS = np.ones(256, dtype=np.int64)
_STARTS[128:192] = 0
_STARTS[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = 0


def band_of(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in WHOLE_BANDS if n_bytes <= most)


def _repeats(hashes: np.ndarray, where: np.ndarray, n_texts: int) -> np.ndarray:
    """By text: its words that lie in a 3-word window found twice or more in that text."""
    runs, at = windows(hashes, where, 3)
    keyed = mix(runs ^ mix(where[at].astype(np.uint64) + np.uint64(1)))
    _, back, counts = np.unique(keyed, return_inverse=True, return_counts=True)
    twice = at[counts[back] > 1]
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    return np.bincount(where[covered], minlength=n_texts)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _compressed(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Ratio of the whole text, its chunks, and those outside their band."""
    if not text:
        return 0.0, 0, 0
    ratio = len(text) / len(packer.compress(text))
    odd, starts = 0, range(0, len(text), CHUNK_BYTES)
    for i in starts:
        chunk = text[i : i + CHUNK_BYTES]
        low, high = CHUNK_BAND if len(chunk) == CHUNK_BYTES else band_of(len(chunk))
        odd += not low <= (len(chunk) / len(packer.compress(chunk)) if len(chunk) < len(text) else ratio) <= high
    return ratio, len(starts), odd


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures and the verdict for each text."""
    hashes, where, n_words = words(texts, fold=False)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)

    def by_text(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return sums[ends] - sums[ends - sizes]

    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    packed = [_compressed(t, packer) for t in texts]
    ratio = np.array([p[0] for p in packed], dtype=float)
    chunks, odd = (np.array([p[k] for p in packed], dtype=np.int64) for k in (1, 2))
    bands = np.array([band_of(n) for n in sizes], dtype=float).reshape(-1, 2)
    repeat, symbols = _repeats(hashes, where, len(texts)), by_text(_SYMBOLS)
    failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    fits = (ratio >= bands[:, 0]) & (ratio <= bands[:, 1]) & (odd <= CHUNK_SHARE * chunks)
    return {
        "n_words": n_words,
        "word_chars": by_text(_STARTS),
        "n_symbols": symbols,
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "whole_ratio": ratio,
        "n_chunks": chunks,
        "n_odd_chunks": odd,
        "kept": ~failed & fits,
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_slices(batch, 1):
            figures = measure(texts)
            rest = [batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *(pa.array(v) for v in figures.values()), *rest],
                ["id", *figures, *batch.schema.names[2:]],
            )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the figures and verdicts of each row of docs.

    A null or empty text has no words and fails the base rules. Ids may be null or repeat: each
    row is judged by itself. Texts are read whole. Other columns of docs are left out; see
    `keep_good` for a filter that keeps them. An empty table gives an empty table.
    """
    kind = dict(docs.dtypes)[id_col]
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return two.mapInArrow(_measured, SCHEMA.format(id=kind)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs and no others, whatever their names."""
    names = Names(docs.columns)
    packed = docs.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text"), names.pack().alias("row"))
    added = dict(f.strip().split(" ") for f in SCHEMA.format(id="int").split(","))
    return packed.mapInArrow(_measured, struct_of(packed, **added)).where("kept").select(*names.unpack())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text"))

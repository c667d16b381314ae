"""Token counts behind a digest cache.

Each text has a key: the SHA-256 of its content, beside a digest of the tokenizer's file. Counts
are stored under those keys. The keys of a table are joined to the stored counts, one text for
each distinct missing key is encoded, its count is appended to the cache, and all rows take
their counts from there. The content is normalised as far as the tokenizer permits without a
change of counts: null becomes empty, and nothing else changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.shared import Names, documents, join_unique, own_folder, without
from orrery.llm.units import ByteCounts

ADDED = ["n_bytes", "n_tokens", "over_limit"]
CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


@cache
def _counter(path: str) -> ByteCounts:
    return ByteCounts(path)


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path).count
        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encoded


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_dir: str,
    limit: int = 1024,
    text_col: str = "text",
) -> DataFrame:
    """Every row of docs, less its text, with n_bytes, n_tokens and over_limit.

    docs has to be a stored table. cache_dir is a folder that all executors share; it may be
    missing or hold the counts of earlier runs, of any tokenizer. A null text counts as empty
    and has no tokens. Repeated rows all get their counts. Columns of docs named like an added
    column, in any case, are replaced; all other names are free. An empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = Names(without(docs, [text_col, *ADDED]).columns)
    keyed = docs.select(
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("rid"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        names.pack().alias("row"),
        text.alias("text"),
    )
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_dir)

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version)
        return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = keyed.groupBy("digest").agg(F.min("rid").alias("rid")).join(stored(), "digest", "left_anti")
    one_each = keyed.select("rid", "text").join(misses.hint("shuffle_hash"), "rid").select("digest", "text")
    counted = one_each.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    counted = join_unique(keyed.select("digest", "rid", "n_bytes", "row"), stored(), ["digest"], "rid", "left")
    return counted.select(*names.unpack(), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # A cache of the run's own, empty at first, that goes with the session: the figures are those of misses.
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), own_folder(spark, "token-cache"))

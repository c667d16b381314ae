"""Incremental encoding: new files of vectors are encoded as they come and appended to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def encode_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], on_commit: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Reads what is new in a folder of Parquet files, encodes it and appends it to the target, then stops.

    Each batch is written under its own number and replaces what a failed try left there, so
    that a restart neither loses nor doubles rows. on_commit is called after each batch is
    written, in their order.
    """

    def commit(batch: DataFrame, number: int) -> None:
        place = f"{target}/batch={number}"
        encode(batch).write.mode("overwrite").parquet(place)
        if on_commit:
            on_commit(number, batch.sparkSession.read.parquet(place))

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(lists: DataFrame, done: DataFrame) -> DataFrame:
    """The lists that a build has yet to do: those not in the table of finished ones."""
    return lists.select("cid").distinct().join(done.select(F.col("cid").cast("long").alias("cid")).distinct(), "cid", "left_anti")


def build_remaining(rows: DataFrame, target: str, build: Callable[[DataFrame], DataFrame], lists_at_once: int = 1024) -> int:
    """Builds lists group by group, each group written as a whole; lists found there are skipped. Returns groups written."""
    spark = rows.sparkSession
    grouped = rows.withColumn("group", F.floor(F.col("cid") / lists_at_once))
    groups = [r[0] for r in grouped.select("group").distinct().orderBy("group").collect()]  # a number for each lists_at_once lists
    jvm = spark.sparkContext._jvm
    written = 0
    for g in groups:
        place = jvm.org.apache.hadoop.fs.Path(f"{target}/group={g}/_SUCCESS")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            continue
        build(grouped.where(F.col("group") == g).drop("group")).write.mode("overwrite").parquet(f"{target}/group={g}")
        written += 1
    return written


def encode_blocks(rows: DataFrame, target: str, block: int, encode: Callable[[DataFrame], DataFrame], on_commit: Callable[[int], None] | None = None) -> int:
    """Encodes rows in blocks of `block` ids, in their order, each written under the id that follows it; goes on behind the blocks found there.

    on_commit is called with that id after each block is written. Returns the id to go on from.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    if ends["low"] is None:
        return 0
    jvm, at = spark.sparkContext._jvm, (ends["low"] // block) * block
    while at <= ends["high"]:
        place = f"{target}/next_id={at + block}"
        done = jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            encode(rows.where((F.col("vec_id") >= at) & (F.col("vec_id") < at + block))).write.mode("overwrite").parquet(place)
            if on_commit:
                on_commit(at + block)
        at += block
    return at

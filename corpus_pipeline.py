"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), with the stage before it written and read again as docs,
and returns its own table: the kept documents with the columns of `documents`, and at last one
row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.exact_dedup import exact_dedup
from orrery.llm.ngram_join import one_of_each
from orrery.llm.packing import pack
from orrery.llm.quality import keep_good
from orrery.llm.secrets import redact, trained
from orrery.llm.shared import documents, spool, unspool

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, trained(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", secrets), ("best-fit packing", packing)]

#: Compression ratios, a random forest and a tokenizer have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, spool(stage(spark, docs, sf_dir), "stage")
        unspool(before)
    return STAGES[-1][1](spark, docs, sf_dir)

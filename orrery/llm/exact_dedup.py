"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive digits of their normalised text, from the front. A digit
is the UTF-8 bytes of the next `width` code points, and whether the text ends there. A group
that a digit leaves with one document is settled, so is a group whose texts have all ended:
its members are equal, byte for byte, with no digest involved. Only the others go on to the
next digit, which is wider, so that the number of rounds grows as the logarithm of the
longest text.

Each round counts its (group, digit) pairs with a map-side combine, and joins the counts back
to the rows by a shuffled join that deals a hot group (a common opening, thousands of copies)
over several tasks. Rounds are written to the shared folder; a lost executor costs its tasks of
the current round alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Names, ascii_lower, documents, join_unique, spool, without

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
#: Code points of the first digit, and the factor by which digits widen.
FIRST_WIDTH, WIDEN = 64, 8


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    first_width: int = FIRST_WIDTH,
) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256.

    docs has to be a stored table, or otherwise yield the same rows in the same order when it
    is computed again. Texts are equal if identical after lower-casing A-Z. The largest id of a
    group stays (a null id counts as the smallest); of rows that repeat that id, one stays. A
    null text counts as empty, and empty texts are equal to each other. Columns of docs named
    like an added column, in any case, are replaced; all other names are free. An empty table
    gives an empty table.
    with_text=False leaves the text column out of the result.
    """
    names = Names(without(docs, [text_col, *ADDED]).columns)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.lit(0).cast("long").alias("grp"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        names.pack().alias("row"),
        F.sha2(ascii_lower(text), 256).alias("sha"),
    )
    settled, at, width = [], 0, first_width
    while True:
        done = _round(rows, at, width, with_text)
        settled.append(done.where("done"))
        rows = done.where("not done").select("rid", "top.rid", "id", "text", "row", "sha").toDF("rid", "grp", "id", "text", "row", "sha")
        if rows.isEmpty():
            break
        at, width = at + width, width * WIDEN
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    found = {
        **dict(zip(names.columns, names.unpack())),
        **({text_col: F.col("text").alias(text_col)} if with_text else {}),
    }
    return result.select(
        *[found[c] for c in docs.columns if c in found],
        F.col("top.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("top.rid") == F.col("rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _round(rows: DataFrame, at: int, width: int, with_text: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumns(
        {
            "digit": ascii_lower(F.substring(text, at + 1, width)).cast("binary"),
            "ended": F.char_length(text) <= at + width,
        }
    )
    groups = rows.groupBy("grp", "digit", "ended").agg(
        F.max(F.struct("id", "rid")).alias("top"), F.count(F.lit(1)).alias("size")
    )
    joined = join_unique(rows, groups, ["grp", "digit", "ended"], "rid").withColumn("done", F.col("ended") | (F.col("size") == 1))
    kept_text = F.col("text") if with_text else F.when(~F.col("done"), F.col("text"))
    return spool(joined.select("rid", "id", kept_text.alias("text"), "row", "sha", "top", "size", "done"), f"radix{at}")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs, with_text=False).select("doc_id", *ADDED)


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n
  FROM documents
), g AS (
  SELECT doc_id, n, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""

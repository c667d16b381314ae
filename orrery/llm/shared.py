"""What the operators of this subpackage share: spooled tables, column guards, word hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six ASCII white-space bytes that separate words: \x20 and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Texts are hashed in slices of about this many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 2 << 20

#: Rows of one key from which a join spreads them, the keys it does so for at most, and the parts of each.
HOT_ROWS, MOST_HOT, SALTS = 1000, 256, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a folder of the machine serves, on a local master only.
    """
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local") or "cluster" in conf.get("spark.master"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    place = tempfile.mkdtemp(prefix="orrery-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def own_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What is there goes when the driver's JVM ends, or by `unspool` before that."""
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    system, target = _hadoop(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._orrery_path = path
    return back


def unspool(*tables: DataFrame) -> None:
    """Deletes spooled tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_orrery_path", None):
            system, target = _hadoop(df.sparkSession, path)
            system.delete(target, True)


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row for each key, with the rows of hot keys spread.

    The keys of more than HOT_ROWS rows, at most MOST_HOT of them and the most frequent first, are
    found by counting their hashes; their rows are dealt over SALTS parts by the column spread, and
    the other side's row to each part. Any further key has fewer rows than each of these.
    """
    key = F.xxhash64(*keys)
    counts = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = [r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()]  # at most MOST_HOT numbers
    if not hot:
        return rows.join(unique.hint("shuffle_hash"), keys, how)
    salted = rows.withColumn("salt", F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(unique.withColumn("salt", F.explode(every)).hint("shuffle_hash"), [*keys, "salt"], how).drop("salt")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that would clash with the names given, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


class Names:
    """Columns under numbers while an operator has columns of its own, so that no name of theirs can clash or needs quoting."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def pack(self) -> Column:
        """The columns as one struct, never an empty one."""
        return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.columns)])

    def unpack(self, struct: str = "row") -> list[Column]:
        return [F.col(struct)[f"c{i}"].alias(c) for i, c in enumerate(self.columns)]


def struct_of(df: DataFrame, **added: str) -> StructType:
    """A schema of the added columns, in their order, and df's column row."""
    return StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items())).add(df.schema["row"])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the quicker way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text has a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a batch's rows with their texts in UTF-8, about `most` bytes at once; only those are in Python's hands."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end, [(t or "").encode() for t in texts.slice(start, end - start).to_pylist()]
        start = end


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False


class _Powers:
    """Powers of an odd number modulo 2**64, kept as far as they were needed."""

    def __init__(self, base: int) -> None:
        self.base, self.have = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            step = np.uint64(pow(self.base, len(self.have), 1 << 64))
            self.have = np.concatenate([self.have, self.have * step])
        return self.have[:n]


_UP, _DOWN = _Powers(_MULTIPLIER), _Powers(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, which spread each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, the text each stands in, and word counts by text.

    Word hashes are differences of a prefix sum of byte * M**position, divided by
    M**start, so that equal words get equal hashes wherever they stand.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends_of_text = np.cumsum(sizes + 1)
    if fold:
        data = _FOLD[data]
    inside = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP.upto(len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _DOWN.upto(len(data))[starts])
    where = np.searchsorted(ends_of_text, starts, side="right")
    return hashes, where, np.bincount(where, minlength=len(texts))


def windows(hashes: np.ndarray, where: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words within one text, and the place of each run's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(where[:n] == where[width - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(_MULTIPLIER) + hashes[at + k]
    return mix(total), at

"""Vector file formats as Spark tables: records of a length and its values, or one header and a dense block.

A file is split into ranges of whole records, one task each, so that a file of any size is read
in parallel. Tasks read through pyarrow's file systems where the path has a scheme that they
know, and through the local file system otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by suffix: the type of the values, and whether the file has one header.
FORMATS = {
    "bvecs": (np.dtype("u1"), False),
    "siftbin": (np.dtype("u1"), False),
    "fvecs": (np.dtype("<f4"), False),
    "ivecs": (np.dtype("<i4"), False),
    "fbin": (np.dtype("<f4"), True),
    "ibin": (np.dtype("<i4"), True),
}
#: The order in which formats are tried on a file without a telling suffix.
PROBED = ("fvecs", "fbin", "bvecs")
SPLIT_BYTES = 32 << 20


@dataclass(frozen=True)
class Shape:
    kind: str
    n: int
    d: int

    @property
    def record(self) -> int:
        dtype, headed = FORMATS[self.kind]
        return self.d * dtype.itemsize + (0 if headed else 4)

    @property
    def header(self) -> int:
        return 8 if FORMATS[self.kind][1] else 0


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inner


def shape_of(path: str, kind: str) -> Shape:
    """Rows and width of a file, checked against its size."""
    system, inner = _open(path)
    size = system.get_file_info(inner).size
    with system.open_input_file(inner) as f:
        head = np.frombuffer(f.read(8), dtype="<i4")
    dtype, headed = FORMATS[kind]
    if headed:
        n, d = (int(x) for x in head)
        fits = size == 8 + n * d * dtype.itemsize
    else:
        d = int(head[0])
        record = 4 + d * dtype.itemsize
        n, fits = size // record, d > 0 and size % record == 0
    if not fits:
        raise ValueError(f"{path} is no {kind} file")
    return Shape(kind, n, d)


def detect(path: str, kind: str | None = None) -> str:
    """The format: as told, else by suffix, else the first that fits the file's size."""
    if kind:
        if kind not in FORMATS:
            raise ValueError(f"unknown format: {kind}")
        return kind
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in FORMATS:
        return suffix
    for trial in PROBED:
        try:
            shape_of(path, trial)
            return trial
        except ValueError:
            continue
    raise ValueError(f"the format of {path} can't be told")


def _records(path: str, shape: Shape):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, headed = FORMATS[shape.kind]
        for batch in batches:
            for start, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = _open(path)
                with system.open_input_file(inner) as f:
                    raw = np.frombuffer(f.read_at(count * shape.record, shape.header + start * shape.record), dtype="u1").reshape(count, -1)
                if not headed:
                    if (raw[:, :4].copy().view("<i4") != shape.d).any():
                        raise ValueError(f"{path}: records differ in width")
                    raw = raw[:, 4:]
                values = np.ascontiguousarray(raw).view(dtype).astype(np.float32 if dtype.kind != "i" else np.int32)
                kind = pa.float32() if dtype.kind != "i" else pa.int32()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * shape.d + 1, shape.d), pa.int32()), pa.array(values.ravel(), kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + count)), lists], ["vec_id", "x"])

    return read


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, start: int = 0, count: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """vec_id (the place in the file) and x of a range of records; bytes become floats."""
    shape = shape_of(path, detect(path, kind))
    end = shape.n if count is None else min(shape.n, start + count)
    per = max(1, split_bytes // shape.record)
    splits = max(1, -(-(end - start) // per))
    ranges = spark.range(0, splits, 1, splits).select((F.lit(start) + F.col("id") * per).alias("start"))
    ranges = ranges.select("start", F.least(F.lit(per), F.lit(end) - F.col("start")).alias("count")).where("count > 0")
    element = "int" if FORMATS[shape.kind][0].kind == "i" else "float"
    return ranges.mapInArrow(_records(path, shape), f"vec_id long, x array<{element}>")


def read_ground_truth(spark: SparkSession, path: str, k: int | None = None, shift: int = 0, kind: str | None = None) -> DataFrame:
    """qid, rank (from 1), vec_id of an integer file, with ids shifted."""
    rows = read_vectors(spark, path, kind).select(F.col("vec_id").alias("qid"), F.posexplode("x").alias("rank", "vec_id"))
    rows = rows.select("qid", (F.col("rank") + 1).alias("rank"), (F.col("vec_id") + shift).cast("long").alias("vec_id"))
    return rows.where(F.col("rank") <= k) if k else rows


def gather(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of a table of ids; Spark sends the ids to all tasks if they are small."""
    return vectors.join(ids.select("vec_id").distinct(), "vec_id")


#: Train, base, query and truth files of known collections below a root folder (fixed names), with the folder they may stand in.
#: None: the collection has no file of its own to train on, and the base serves.
PRESETS = {
    "SIFT1M": ("sift", "sift_learn.fvecs", "sift_base.fvecs", "sift_query.fvecs", "sift_groundtruth.ivecs"),
    "SIFTSMALL": ("siftsmall", "siftsmall_learn.fvecs", "siftsmall_base.fvecs", "siftsmall_query.fvecs", "siftsmall_groundtruth.ivecs"),
    "GIST1M": ("gist", "gist_learn.fvecs", "gist_base.fvecs", "gist_query.fvecs", "gist_groundtruth.ivecs"),
    "SIFT1B": ("bigann", "learn.bvecs", "1milliard.p1.siftbin", "queries.bvecs", "bigann_gnd/idx_{m}M.ivecs"),
    "DEEP10M": ("deep10m", None, "base.10M.fbin", "query.public.10K.fbin", "groundtruth.{m}M.ibin"),
    "MSONG": ("msong", None, "msong_base.fvecs", "msong_query.fvecs", "msong_groundtruth.ivecs"),
    "GLOVE100": ("glove100/converted", None, "glove100_base.fvecs", "glove100_query.fvecs", "glove100_groundtruth.ivecs"),
    "DEEP1M": ("deep1m", "learn.fvecs", "base.fvecs", "deep1B_queries.fvecs", "deep1M_groundtruth.ivecs"),
}


def preset(name: str, root: str, n_base: int | None = None, **own: str) -> dict[str, str]:
    """Paths by role; own paths take the place of the collection's, and are all that a collection of another name has.

    Files stand below root or below the collection's folder in it: the folder is taken unless the
    base is found without it. The truth of a subset is that of the largest listed subset up to n_base.
    """
    roles = ("train", "base", "query", "truth")
    if name not in PRESETS:
        if not {"base", "query"} <= own.keys():
            raise ValueError(f"unknown collection: {name}; give its paths")
        return {"train": own["base"], **own}
    folder, *files = PRESETS[name]
    if name == "DEEP10M" and "truth" not in own and n_base not in (None, 1_000_000, 10_000_000):
        raise ValueError("DEEP10M has truth for subsets of 1 and 10 million only")
    millions = (n_base or 10_000_000) // 1_000_000 if name == "DEEP10M" else subset_millions(n_base or 1_000_000_000)
    system, inner = _open(f"{root.rstrip('/')}/{files[1]}")
    place = root.rstrip("/") if system.get_file_info(inner).type == fs.FileType.File else f"{root.rstrip('/')}/{folder}"
    paths = {role: f"{place}/{f.format(m=millions)}" for role, f in zip(roles, files) if f}
    return {"train": paths["base"], **paths, **own}


def subset_millions(n: int) -> int:
    """The largest of 1, 2, 5, 10, ..., 1000 million up to n; at least 1."""
    sizes = [m * 10**e for e in range(4) for m in (1, 2, 5) if m * 10**e <= 1000]
    return max([1, *(s for s in sizes if s * 1_000_000 <= n)])

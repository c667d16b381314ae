"""Stored tables: encodings by list, linkage, codecs, with identity hashes and reuse rules."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new place that all executors share: under spark.checkpoint.dir, or a local one on a local master. It goes with the driver's JVM."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, target = _hadoop(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def spooled(df: DataFrame, name: str, before: DataFrame | None = None) -> DataFrame:
    """df written as Parquet and read back, where its lineage ends; then deletes the spooled table before it."""
    place = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(place)
    back = df.sparkSession.read.schema(df.schema).parquet(place)
    back._orrery_place = place
    if before is not None and hasattr(before, "_orrery_place"):
        delete(df.sparkSession, before._orrery_place)
    return back


def write_encodings(rows: DataFrame, path: str, mode: str = "error", per_list: str = "cid") -> None:
    """Lists lie in ranges of files, sorted, so that reading a list skips the other files and row groups."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, per_list, "vec_id").sortWithinPartitions(per_list, "vec_id").write.mode(mode).parquet(path)


def read_encodings(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("cid").isin(lists)) if lists is not None else rows


LINKAGE = "cid long, vec_ids array<long>, tree binary, depth_offsets array<int>, width int, codes array<int>, coeffs array<double>, errors array<double>"


def write_linkage(forest: DataFrame, path: str, mode: str = "error") -> None:
    """A forest as one row for each list: ids in breadth-first order, the parents as a level-order tree, the first place of each depth, and codes."""
    from orrery.operators.compression import Louds

    def stored(part: pa.Table) -> pa.Table:
        part = part.sort_by("local_id")
        depth = part.column("depth").to_numpy()
        tree = Louds.build(part.column("parent_local").to_numpy())
        codes, coeffs = (part.column(c).combine_chunks() for c in ("codes", "coeffs"))
        lists = {
            "vec_ids": (part.column("vec_id").to_numpy(), pa.int64()), "depth_offsets": (np.searchsorted(depth, np.arange(depth.max(initial=0) + 2)), pa.int32()),
            "codes": (codes.flatten().to_numpy(), pa.int32()), "coeffs": (coeffs.flatten().to_numpy(), pa.float64()), "errors": (part.column("error").to_numpy(), pa.float64()),
        }
        rows = {name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for name, (x, kind) in lists.items()}
        rows |= {"cid": part.column("cid")[:1], "tree": pa.array([tree.serialise()], pa.binary()), "width": pa.array([len(codes.flatten()) // len(codes)], pa.int32())}
        return pa.table({name: rows[name] for name in ("cid", "vec_ids", "tree", "depth_offsets", "width", "codes", "coeffs", "errors")})

    forest.groupBy("cid").applyInArrow(stored, LINKAGE).repartitionByRange("cid").sortWithinPartitions("cid").write.mode(mode).parquet(path)


def read_linkage(spark: SparkSession, path: str, lists: list[int] | None = None, depths: tuple[int, int] | None = None) -> DataFrame:
    """The rows of a stored forest, of some lists and of a span of depths (both ends in it) if told; parents come from the trees' bits."""
    from orrery.operators.compression import Louds
    from orrery.operators.linkage import FOREST
    from orrery.operators.search import listed

    low, high = depths or (0, 1 << 30)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                starts, ids, codes, coeffs, errors = (r[c].values.to_numpy() for c in ("depth_offsets", "vec_ids", "codes", "coeffs", "errors"))
                width = r["width"].as_py()
                a, b = int(starts[min(low, len(starts) - 1)]), int(starts[min(high + 1, len(starts) - 1)])
                n, parent = len(ids), Louds.deserialise(r["tree"].as_py()).parents()
                depth = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, r["cid"].as_py()), pa.int64()), pa.array(np.arange(a + 1, b + 1), pa.int32()), pa.array(ids[a:b], pa.int64()), pa.array(parent[a:b], pa.int32()), pa.array(depth[a:b], pa.int32()),
                        listed(codes.reshape(n, width)[a:b].astype(np.int32)), listed(coeffs.reshape(n, width)[a:b].astype(float)), pa.array(errors[a:b], pa.float64()),
                    ],
                    ["cid", "local_id", "vec_id", "parent_local", "depth", "codes", "coeffs", "error"],
                )

    return read_encodings(spark, path, lists).select(*[f.split(" ")[0] for f in LINKAGE.split(", ")]).mapInArrow(rows, FOREST)


def write_codec(streams: DataFrame, path: str, mode: str = "error") -> None:
    """Coefficient streams as `compress_lists` makes them."""
    streams.repartitionByRange("cid").sortWithinPartitions("cid", "grp", "layer").write.mode(mode).parquet(path)


def read_codec(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """cid, grp, layer, nth (in the order of ids) and q of the symbols of stored streams."""
    from orrery.operators.compression import huffman_decode

    def symbols(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q = huffman_decode(dict(zip(r["symbols"], r["lens"])), r["payload"], r["n_sym"])
                same = [pa.array(np.full(len(q), r[c]), kind) for c, kind in (("cid", pa.int64()), ("grp", pa.int32()), ("layer", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(q)), pa.int64()), pa.array(q, pa.int32())], ["cid", "grp", "layer", "nth", "q"])

    return read_encodings(spark, path, lists).mapInArrow(symbols, "cid long, grp int, layer int, nth long, q int")


def identity(part: str, settings: dict, parent: str | None = None) -> str:
    """The hash of a store: its own settings and the hash of the store it was made from."""
    text = json.dumps({"part": part, "settings": settings, "parent": parent}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


class Decision(Enum):
    BUILD = "build"
    REUSE = "reuse"
    REBUILD = "rebuild"


@dataclass
class Choice:
    decision: Decision
    warning: str = ""


def decide(stored: str | None, wanted: str, evaluate_only: bool = False, rebuild: bool = False) -> Choice:
    """What to do with a store: reuse it on the same hash; when only evaluating, reuse another with a warning and fail without one."""
    if rebuild and not evaluate_only:
        return Choice(Decision.REBUILD)
    if stored is None:
        if evaluate_only:
            raise FileNotFoundError("there is no store to evaluate")
        return Choice(Decision.BUILD)
    if stored == wanted:
        return Choice(Decision.REUSE)
    return Choice(Decision.REUSE, "the store was made with other settings") if evaluate_only else Choice(Decision.REBUILD)


#: Steps after which parts of a build can go, in order; a preset holds all up to its own.
CLEANUP = {
    "none": (),
    "dev_all": ("layers",),
    "eval_both": ("layers", "buckets"),
    "eval_float_min": ("layers", "buckets", "codec"),
    "eval_int8_min": ("layers", "buckets", "coefficients"),
}


def delete(spark: SparkSession, path: str) -> bool:
    system, target = _hadoop(spark, path)
    return system.delete(target, True)


def clean(spark: SparkSession, places: dict[str, str], preset: str) -> list[str]:
    """Deletes the parts that a preset can do without; returns their names."""
    gone = [part for part in CLEANUP[preset] if part in places]
    for part in gone:
        delete(spark, places[part])
    return gone

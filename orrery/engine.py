"""The whole engine behind one call: train, build lists and forests, evaluate."""

from __future__ import annotations

import dataclasses
import itertools
import json
import logging
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.vectors import as_double
from orrery.operators import codebooks, linkage, metrics, search
from orrery.operators.encoding import Codebooks, encode
from orrery.sources import stores, vector_files


log = logging.getLogger(__name__)


class RunMode(Enum):
    FULL = "full"
    TRAIN = "train-only"
    BASE = "build-base-only"
    LINKAGE = "build-linkage-only"
    EVAL = "eval-only"


@dataclass
class Config:
    """Settings; `key = value` lines and overrides set them by these names."""

    base: str = ""
    query: str = ""
    out: str = ""
    sizes: list[int] = field(default_factory=lambda: [16, 16])
    h0_one: int = 16
    rounds: int = 1
    beam: int = 4
    policy: str = "structured"
    max_depth: int = 4
    knn_k: int = 8
    nprobe: list[int] = field(default_factory=lambda: [4])
    ef_search: list[int] = field(default_factory=lambda: [64])
    k: int = 10
    gt_k: list[int] = field(default_factory=lambda: [10])
    seed: int = 1
    rebuild: int = 0
    cleanup: str = "none"

    def check(self) -> None:
        if not 1 <= self.h0_one <= 256:
            raise ValueError("h0_one has to be within 1..256")
        if not 1 <= len(self.sizes) <= 20:
            raise ValueError("1 to 20 layers are possible")
        if any(h > 256 for h in self.sizes[1:]):
            raise ValueError("layers after the root have 256 codes at most")
        if self.cleanup not in stores.CLEANUP:
            raise ValueError(f"unknown cleanup: {self.cleanup}")
        if self.policy not in ("structured", "nn_forest", "random_forest", "all_roots"):
            raise ValueError(f"unknown policy: {self.policy}")

    def set(self, key: str, value: str) -> None:
        fields = {f.name: f for f in dataclasses.fields(self)}
        key = key.strip()
        if key == "h0":  # short for the root's size
            self.sizes = [int(value), *self.sizes[1:]]
            return
        if key not in fields:
            raise KeyError(f"unknown setting: {key}")
        now, text = getattr(self, key), value.strip().strip("\"'")
        if isinstance(now, list):
            setattr(self, key, [int(x) for x in text.strip("[]").split(",") if x.strip()])
        else:
            setattr(self, key, type(now)(text))

    @classmethod
    def load(cls, text: str, overrides: list[str] | None = None) -> Config:
        config = cls()
        for line in [*text.splitlines(), *(overrides or [])]:
            line = line.split("#", 1)[0].strip()
            if line:
                config.set(*line.split("=", 1))
        config.check()
        return config

    def dump(self) -> str:
        return "\n".join(f"{k} = {','.join(map(str, v)) if isinstance(v, list) else v}" for k, v in dataclasses.asdict(self).items())

    def signature(self, part: str = "model") -> str:
        """The identity of a part's store, chained to that of the part it is made from."""
        now = dataclasses.asdict(self)
        settings = {"model": ("base", "sizes", "h0_one", "rounds", "beam", "seed"), "encodings": ("beam", "seed"), "forest": ("policy", "max_depth", "knn_k", "seed")}
        before = None
        for name, keys in settings.items():
            before = stores.identity(name, {k: now[k] for k in keys}, before)
            if name == part:
                return before
        raise ValueError(f"unknown part: {part}")


@dataclass
class RunResult:
    ok: bool
    error: str
    config: Config
    metrics: DataFrame | None = None


def read(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and x of Parquet (embedding or x) or of a vector file."""
    if path.endswith(tuple(f".{k}" for k in vector_files.FORMATS)):
        return vector_files.read_vectors(spark, path).select("vec_id", as_double("x").alias("x"))
    rows = spark.read.parquet(path)
    return rows.select("vec_id", as_double("x" if "x" in rows.columns else "embedding").alias("x"))


def _stored_signature(spark: SparkSession, place: str) -> str | None:
    """The identity noted beside a store once it was whole; None without a whole store."""
    system, target = stores._hadoop(spark, f"{place}-meta/_SUCCESS")
    return json.loads(spark.read.text(f"{place}-meta").first()[0])["signature"] if system.exists(target) else None


def _build(spark: SparkSession, config: Config, part: str, place: str, make, evaluate_only: bool = False) -> bool:
    """Makes a part unless a store of the same settings is there; notes its identity when it is whole. Tells whether it was made."""
    wanted = config.signature(part)
    choice = stores.decide(_stored_signature(spark, place), wanted, evaluate_only, bool(config.rebuild))
    if choice.warning:
        log.warning("%s: %s", place, choice.warning)
    if choice.decision is stores.Decision.REUSE:
        return False
    stores.delete(spark, f"{place}-meta")  # until it is whole, the store counts as missing
    make()
    spark.createDataFrame([(json.dumps({"signature": wanted}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}-meta")
    return True


def _save(spark: SparkSession, books: Codebooks, r: np.ndarray, one: Codebooks, place: str) -> None:
    rows = [(name, layer, code, [float(v) for v in w]) for name, b in (("root", books.layers), ("one", one.layers), ("rotation", [r])) for layer, c in enumerate(b) for code, w in enumerate(c)]
    spark.createDataFrame(rows, "book string, layer int, code int, c array<double>").write.mode("overwrite").parquet(place)


def load_model(spark: SparkSession, place: str) -> tuple[Codebooks, np.ndarray, Codebooks]:
    rows = spark.read.parquet(place).orderBy("book", "layer", "code").collect()  # one row per codeword
    found: dict[str, dict[int, list]] = {}
    for r in rows:
        found.setdefault(r["book"], {}).setdefault(r["layer"], []).append(r["c"])
    root, one, rotation = ([np.array(found[b][k]) for k in sorted(found[b])] for b in ("root", "one", "rotation"))
    return Codebooks(root), rotation[0], Codebooks(one)


def run(spark: SparkSession, config: Config, mode: RunMode = RunMode.FULL) -> RunResult:
    """Runs the stages that the mode asks for; each reads what the one before wrote below config.out.

    A stage whose store has the identity of the settings is not run again. An evaluation takes
    stores of other settings with a warning, and fails without one. Results go to the archive.
    """
    model, lists, forest = (f"{config.out}/{p}" for p in ("model", "encodings", "forest"))

    def train() -> None:
        rows = read(spark, config.base)
        books, r = codebooks.train(rows, config.sizes, config.rounds, config.beam)
        _, rest = codebooks.residual_init(codebooks.rotate(rows, r), config.sizes[:1], 3, config.seed)
        one, _ = codebooks.residual_init(rest, [config.h0_one, *config.sizes[1:]], 3, config.seed + 1)
        _save(spark, books, r, Codebooks(one), model)

    def encode_base() -> None:
        books, r, _ = load_model(spark, model)
        stores.write_encodings(encode(codebooks.rotate(read(spark, config.base), r), books, config.beam, seed=config.seed), lists, "overwrite")

    def link() -> None:
        books, r, one = load_model(spark, model)
        rows = codebooks.rotate(read(spark, config.base), r).join(stores.read_encodings(spark, lists).select("vec_id", "cid"), "vec_id")
        stores.write_linkage(linkage.build_forest(rows, books, one, config.policy, config.max_depth, config.knn_k, config.seed), forest, "overwrite")

    stages = [("model", model, train, RunMode.TRAIN), ("encodings", lists, encode_base, RunMode.BASE), ("forest", forest, link, RunMode.LINKAGE)]
    try:
        config.check()
        for part, place, make, own in stages:
            if mode in (RunMode.FULL, own):
                _build(spark, config, part, place, make)
            elif mode is RunMode.EVAL and part != "encodings":
                _build(spark, config, part, place, make, evaluate_only=True)
        found = None
        if mode in (RunMode.FULL, RunMode.EVAL):
            found = archive(spark, config, evaluate(spark, config, model, forest))
            stores.clean(spark, {"layers": f"{config.out}/layers", "buckets": lists}, config.cleanup)
        return RunResult(True, "", config, found)
    except (OSError, ValueError, KeyError, PySparkException) as e:
        return RunResult(False, str(e), config)


def archive(spark: SparkSession, config: Config, found: DataFrame) -> DataFrame:
    """Writes the metrics of a run with its settings under a name that these decide; a later run of the same settings replaces them."""
    found = spark.createDataFrame(found.collect(), found.schema)  # a few numbers for each case of the grid
    name = stores.identity("evaluation", dataclasses.asdict(config), config.signature("forest"))[:16]
    place = f"{config.out}/evaluations/{name}"
    found.withColumn("settings", F.lit(config.dump())).coalesce(1).write.mode("overwrite").json(place)
    return found


def run_grid(spark: SparkSession, config: Config, grid: dict[str, list[str]], mode: RunMode = RunMode.FULL) -> list[RunResult]:
    """A run for each combination of settings; keys joined by commas vary together, with values joined the same way.

    Each combination has a folder of its own below config.out, by its settings.
    """
    results = []
    for values in itertools.product(*grid.values()):
        one = Config.load(config.dump())
        for keys, value in zip(grid, values):
            for key, v in zip(keys.split(","), str(value).split(";") if "," in keys else [str(value)], strict=True):
                one.set(key, v)
        one.out = f"{config.out}/{stores.identity('grid', dataclasses.asdict(one))[:12]}"
        results.append(run(spark, one, mode))
    return results


def evaluate(spark: SparkSession, config: Config, model: str, forest: str) -> DataFrame:
    """nprobe, metric, k, value for each case of the grid."""
    books, r, one = load_model(spark, model)
    base = codebooks.rotate(read(spark, config.base), r)
    queries = codebooks.rotate(read(spark, config.query), r).select(F.col("vec_id").alias("qid"), F.col("x").alias("q"))
    truth = stores.spooled(search.exact_knn(base, queries, max([config.k, *config.gt_k])), "truth")
    centers = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(books.layers[0])], "cid long, c array<double>")
    ks = [k for k in (1, 10, 100) if k <= config.k]
    cases = None
    for nprobe, _ in metrics.plan_grid(config.nprobe, config.ef_search, False):
        found = linkage.linked_scan(stores.read_linkage(spark, forest), queries, search.probe(queries, centers, nprobe), books, one, config.k)
        one_case = metrics.recall_curve(truth, found, ks).select(F.lit(nprobe).alias("nprobe"), F.lit("r").alias("metric"), "k", "value")
        for g in metrics.gt_sizes(config.gt_k, config.k):
            one_case = one_case.unionByName(metrics.top_recall(truth, found, g, ks).select(F.lit(nprobe).alias("nprobe"), F.lit(f"top{g}_r").alias("metric"), "k", "value"))
        cases = one_case if cases is None else cases.unionByName(one_case)
    return cases

"""Retrieval metrics and structural reports over ground truth, rankings and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gt_sizes(wanted: list[int], most: int) -> list[int]:
    """The sizes of ground truth to report: those within 1..most; else 10 and 50; else most."""
    kept = sorted({k for k in wanted if 1 <= k <= most}) or [k for k in (10, 50) if k <= most]
    return kept or [most]


def first_hits(gt: DataFrame, pred: DataFrame, g: int = 1) -> DataFrame:
    """Per query the ranks at which distinct members of its top-g truth were first found."""
    truth = gt.where((F.col("rank") <= g) & (F.col("vec_id") >= 0)).select("qid", "vec_id").distinct()
    first = pred.where("vec_id >= 0").groupBy("qid", "vec_id").agg(F.min("rank").alias("rank"))
    return truth.join(first, ["qid", "vec_id"], "left")


def recall_curve(gt: DataFrame, pred: DataFrame, ks: list[int]) -> DataFrame:
    """r@k: the share of queries whose nearest neighbour is among the first k."""
    hits = first_hits(gt, pred, 1)
    return hits.agg(*[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"k{k}") for k in ks]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("value")) for k in ks])).alias("r")).select("r.*")


def top_recall(gt: DataFrame, pred: DataFrame, g: int, ks: list[int]) -> DataFrame:
    """top<g>_r@k: found members of the top-g truth over its distinct valid members (at least 1), averaged over queries."""
    per = first_hits(gt, pred, g).groupBy("qid").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"), *[F.sum((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"k{k}") for k in ks])
    every = gt.select("qid").distinct().join(per, "qid", "left")
    means = every.agg(*[F.avg(F.coalesce(F.col(f"k{k}") / F.col("n"), F.lit(0.0))).alias(f"k{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("value")) for k in ks])).alias("r")).select("r.*")


def ndcg(gt: DataFrame, pred: DataFrame, g: int, k: int) -> DataFrame:
    """Binary ndcg: gains 1 / log2(rank + 1) of found members over those of an ideal order; 0 without truth."""
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = first_hits(gt, pred, g).groupBy("qid").agg(F.sum(gain).alias("dcg"), F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    every = gt.select("qid").distinct().join(per, "qid", "left")
    return every.select("qid", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def valid_truth(truth: DataFrame) -> DataFrame:
    """Truth without invalid ids, each member once, at its first rank."""
    return truth.where("vec_id >= 0").groupBy("qid", "vec_id").agg(F.min("rank").alias("rank"))


def compare_truths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query of either: ranks with the same id, ids in common, and these as a share of the longer one's."""
    ours, theirs = (valid_truth(t) for t in (a, b))
    ranks = ours.join(theirs.select("qid", "rank", F.col("vec_id").alias("other")), ["qid", "rank"], "full")
    same = ranks.groupBy("qid").agg(F.sum((F.col("vec_id") == F.col("other")).cast("long")).alias("same_rank"), F.greatest(F.count("vec_id"), F.count("other")).alias("n"))
    common = ours.join(theirs.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("common"))
    got = same.join(common, "qid", "left").select("qid", F.coalesce("same_rank", F.lit(0)).alias("same_rank"), F.coalesce("common", F.lit(0)).alias("common"), "n")
    return got.withColumn("overlap", F.col("common") / F.col("n"))


def reranked(found: DataFrame, k: int) -> DataFrame:
    """The k first of what is left of ranked results, with ranks from 1 again."""
    w = Window.partitionBy("qid").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def throughput(run, n_queries: int, warm_up: int = 1, repeats: int = 3) -> dict[str, float]:
    """Median and mean queries a second of a run, after some that don't count."""
    import time
    from statistics import mean, median

    speeds = []
    for k in range(warm_up + repeats):
        start = time.perf_counter()
        run()
        if k >= warm_up:
            speeds.append(n_queries / (time.perf_counter() - start))
    return {"median_qps": median(speeds), "mean_qps": mean(speeds)}


def summary(name: str, value: float) -> str:
    return f"{name} {value:.4f}" if name.startswith("ndcg") else f"{name} {100 * value:.2f}%"


def plan_grid(nprobe: list[int], ef: list[int], graph: bool, fallback: tuple[int, int] = (8, 64)) -> list[tuple[int, int]]:
    """Cases of an evaluation, nprobe by ef: positive values once each in their order; ef matters for graph probes only."""
    probes = list(dict.fromkeys(x for x in nprobe if x > 0)) or [fallback[0]]
    efs = list(dict.fromkeys(x for x in ef if x > 0)) or [fallback[1]]
    return [(p, e) for p in probes for e in (efs if graph else efs[:1])]


def coefficient_runs(mode: str, has_codec: bool) -> list[str]:
    """Which coefficients to evaluate with: auto prefers the codec's."""
    runs = {"auto": ["int8" if has_codec else "float"], "float": ["float"], "int8": ["int8"], "both": ["float", "int8"]}
    if mode not in runs:
        raise ValueError(f"unknown coefficient mode: {mode}")
    return runs[mode]


def depth_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def mean_depth_buckets(rows: DataFrame, width: float) -> DataFrame:
    means = rows.groupBy("cid").agg(F.avg("depth").alias("mean"))
    return means.groupBy(F.floor(F.col("mean") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("lists"))


def child_degrees(parents: DataFrame) -> DataFrame:
    """Children of each vector, zero included."""
    n = parents.where("parent is not null").groupBy(F.col("parent").alias("vec_id")).agg(F.count(F.lit(1)).alias("children"))
    return parents.select("vec_id", "cid").join(n, "vec_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def gini(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The Gini coefficient of a value within each key, from counts of its distinct values, so that a key's rows are never sorted."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy(value)) - F.col("n")
    ranked = counts.withColumn("ranks", F.col("n") * before + F.col("n") * (F.col("n") + 1) / 2)
    total, n = F.sum(F.col("n") * F.col(value)), F.sum("n")
    return ranked.groupBy(key).agg(F.when(total > 0, 2 * F.sum(F.col("ranks") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def calibrate(rows: DataFrame, bucket: str, error: str, split: str, least: int = 50) -> DataFrame:
    """Scores less the mean error of their bucket in the training rows, or the overall mean where it has under `least` rows."""
    training = rows.where(F.col(split))
    means = training.groupBy(bucket).agg(F.avg(error).alias("own"), F.count(F.lit(1)).alias("n"))
    overall = training.agg(F.avg(error).alias("all"))
    joined = rows.join(means, bucket, "left").crossJoin(F.broadcast(overall))
    return joined.withColumn("correction", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("all"))).drop("own", "n", "all")


def weighted_correlation(rows: DataFrame, a: str, b: str, w: str) -> DataFrame:
    sums = rows.agg(F.sum(w).alias("w"), *[F.sum(F.col(w) * x).alias(n) for n, x in (("a", F.col(a)), ("b", F.col(b)), ("ab", F.col(a) * F.col(b)), ("aa", F.col(a) * F.col(a)), ("bb", F.col(b) * F.col(b)))])
    cov = F.col("ab") / F.col("w") - F.col("a") * F.col("b") / F.col("w") ** 2
    va, vb = F.col("aa") / F.col("w") - (F.col("a") / F.col("w")) ** 2, F.col("bb") / F.col("w") - (F.col("b") / F.col("w")) ** 2
    return sums.select(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0).alias("correlation"))


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float) -> DataFrame:
    """Ridge regression on standardised features by normal equations: weights (in the features' own units) and intercept."""
    import numpy as np

    spark = rows.sparkSession
    names = [*features, target]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *products).first()
    n, m, k = got["n"], np.array([got[f"m{i}"] for i in range(len(names))]), len(features)
    cov = np.array([[got[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))]) / n - np.outer(m, m)
    std = np.sqrt(np.maximum(np.diag(cov)[:k], 1e-300))
    z = cov[:k, :k] / np.outer(std, std) + penalty / n * np.eye(k)
    w = np.linalg.solve(z, cov[:k, k] / std) / std
    return spark.createDataFrame([([float(x) for x in w], float(m[k] - w @ m[:k]))], "weights array<double>, intercept double")

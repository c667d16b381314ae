"""Queries over children's codebooks, virtual roots, compressed forests and regressions."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, l2sq, norm2
from orrery.operators import codebooks, compression, kmeans, linkage, metrics, search, virtual
from orrery.operators.encoding import Codebooks, encode
from orrery.plans.catalog import BASE, CENTERS, ENCODED, atoms, base, centers, ddot, encodings, holds, query, queries_of, vectors
from orrery.plans.core import normed, r6
from orrery.plans.core import NEIGHBOURS
from orrery.plans.structure import AGREES, COEFFS, FINE, FUZZY, _books, _coeffs, _fit, _fuzzy, _scan_agrees
from orrery.sources import stores


def _built(spark, d, policy="nn_forest"):
    root, one = _books(spark, d)
    return stores.spooled(linkage.build_forest(base(spark, d), root, one, policy), "forest"), root, one


@query("vec13_root_to_one_by_kmeans", f"WITH {CENTERS} SELECT count(*) AS centers, true AS nearest, 4 AS groups FROM c")
def vec13(spark, d):
    rows = centers(spark, d).select(F.col("cid").cast("long").alias("vec_id"), F.col("c").alias("x"))
    model = kmeans.spherical_kmeans(rows, kmeans.init_plus_plus(rows, 4, samples=1 << 12), 30)
    table = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.centers)], "cid long, c array<double>")
    codes = [r["code"] for r in search.assign(rows, table).orderBy("vec_id").collect()]  # a row per center
    x = search.matrix(rows, "vec_id", "x")[1]
    return holds(spark, centers=len(codes), nearest=bool(((x @ model.centers.T).argmax(1) == codes).all()), groups=len(set(codes)))


@query("jn13_linked_scan_with_virtual_roots", f"WITH {BASE} SELECT true AS real_only, 0 AS differing")
def jn13(spark, d):
    root, one = _books(spark, d)
    extra = virtual.sub_centers(base(spark, d), 2, 4).select((-F.col("cid") * 10 - F.col("local_id")).alias("vec_id"), "x", F.col("cid").cast("int").alias("cid"))
    forest = stores.spooled(linkage.build_forest(base(spark, d).unionByName(extra), root, one), "forest")
    q = queries_of(spark, d)
    probes = search.probe(q, centers(spark, d), 4)
    # As many rows more than wanted as there are virtual ones, so that enough real ones are left.
    most = 5 + forest.where("vec_id < 0").count()
    found = linkage.real_only(linkage.linked_scan(forest, q, probes, root, one, most))
    found = stores.spooled(metrics.reranked(found, 5), "found")
    return holds(spark, real_only=found.where("vec_id < 0").isEmpty(), differing=_scan_agrees(spark, d, forest, probes, found, root, one, 5))


@query("jn14_linked_scan_quantised", AGREES)
def jn14(spark, d):
    forest, root, one = _built(spark, d)
    coarse = stores.spooled(linkage.quantised_forest(forest, 8), "forest")
    q = queries_of(spark, d)
    probes = search.probe(q, centers(spark, d), 4)
    found = stores.spooled(linkage.linked_scan(coarse, q, probes, root, one, 5), "found")
    return holds(spark, found=found.count(), differing=_scan_agrees(spark, d, coarse, probes, found, root, one, 5))


def _child_fit(forest, rows, root, one, books, marks=None, alpha=1.0):
    """The squared error of the children's rests under codebooks, those of bad lists weighed."""
    rests = linkage.child_residuals(forest, rows, root, one)
    if marks is not None:
        rests = rests.join(marks.select(F.col("cid").cast("long").alias("cid"), "bad"), "cid").withColumn("s", F.when(F.col("bad"), F.lit(alpha**0.5)).otherwise(1.0))
        rests = rests.withColumns({"x": F.transform("x", lambda v: v * F.col("s")), "coeffs": F.transform("coeffs", lambda v: v * F.col("s"))})
    return _fit(rests.select("x", "codes", "coeffs"), books)


@query("cb05_child_books", "SELECT 18 AS codes, true AS fits_better")
def cb05(spark, d):
    forest, root, one = _built(spark, d)
    books = linkage.update_child_books(forest, base(spark, d), root, one)
    return holds(spark, codes=sum(map(len, books)), fits_better=_child_fit(forest, base(spark, d), root, one, books) <= _child_fit(forest, base(spark, d), root, one, one.layers) + 1e-9)


@query("cb06_weighted_child_books", "SELECT 18 AS codes, true AS fits_better")
def cb06(spark, d):
    forest, root, one = _built(spark, d)
    bad = codebooks.bad_clusters(forest.select("cid", F.col("error").alias("mse")), 0.5)
    books, plain = (linkage.update_child_books(forest, base(spark, d), root, one, *extra) for extra in ((bad, 4.0), ()))
    return holds(spark, codes=sum(map(len, books)), fits_better=_child_fit(forest, base(spark, d), root, one, books, bad, 4.0) <= _child_fit(forest, base(spark, d), root, one, plain, bad, 4.0) + 1e-9)


@query("cb08_train_rounds", "SELECT true AS orthogonal, true AS error_falls")
def cb10(spark, d):
    """Rounds of encoding, rotation and joint update leave less error than the codebooks they start from."""
    books, r = codebooks.train(base(spark, d), [10, 8], rounds=1)
    start = codebooks.residual_init(base(spark, d), [10, 8])[0]
    after, before = (encode(codebooks.rotate(base(spark, d), m), b).agg(F.avg("mse")).first()[0] for m, b in ((r, books), (np.eye(64), Codebooks(start))))
    return holds(spark, orthogonal=bool(np.allclose(r @ r.T, np.eye(64), atol=1e-8)), error_falls=after <= before)


@query("vir05_barycenters", f"WITH {BASE}, {FUZZY}, s AS (SELECT i, j, max(w) AS w FROM sy GROUP BY i, j), tk AS (SELECT i AS seed, j AS vec_id, w FROM s WHERE i % 50 = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(w, 12) DESC, j) <= 3), al AS (SELECT * FROM tk UNION ALL SELECT vec_id, vec_id, 1.0 FROM b WHERE vec_id % 50 = 0) SELECT seed, round(sum(w * x[1]) / sum(w), 6) AS x0, round(sum(w * x[64]) / sum(w), 6) AS x63 FROM al JOIN b USING (vec_id) GROUP BY seed")
def vir05(spark, d):
    chosen = base(spark, d).where("vec_id % 50 = 0").select("vec_id")
    edges = _fuzzy(spark, d).withColumn("w", F.round("w", 12))
    return virtual.barycenters(chosen, edges, base(spark, d), 3).select("seed", r6(F.col("x")[0]).alias("x0"), r6(F.col("x")[63]).alias("x63"))


@query("vir02_scales", f"WITH {BASE}, {NEIGHBOURS} SELECT vec_id, round(sqrt(min(dist2)), 6) AS rho, 3.0 AS mass FROM nb WHERE rank <= 8 GROUP BY vec_id")
def vir02(spark, d):
    """Memberships under the scales found sum to log2 of the number of neighbours."""
    knn = stores.spooled(search.in_list_knn(base(spark, d), 8), "knn")
    near = knn.join(virtual.local_scales(knn), "vec_id")
    mass = F.sum(F.exp(-F.greatest(F.sqrt("dist2") - F.col("rho"), F.lit(0.0)) / F.col("sigma")))
    return near.groupBy("vec_id").agg(r6(F.first("rho")).alias("rho"), F.round(mass, 3).alias("mass"))


@query("km11_scalar_kmeans", f"WITH {BASE} SELECT count(*) AS n, 8 AS centers, true AS ordered, true AS each_the_mean FROM b")
def km11(spark, d):
    values, counts = compression.value_histogram(normed(spark, d), "norm")
    centers_, at = kmeans.scalar_kmeans(values, 8, 500, counts=counts)
    means = np.bincount(at, counts * values, 8) / np.maximum(np.bincount(at, counts, 8), 1e-300)
    return holds(spark, n=int(counts.sum()), centers=len(centers_), ordered=bool((np.diff(centers_) >= 0).all()), each_the_mean=bool(np.allclose(means, centers_, atol=1e-4)))


JOINT = f"{{st}} AS (SELECT cid, max(abs(a0)) / 7 AS s0, max(abs(a1)) / 7 AS s1 FROM e GROUP BY cid), z AS (SELECT e.cid, round_even(a0 / st.s0, 0) AS q0, round_even(a1 / st.s1, 0) AS q1, a0, a1, {ddot('c', 'c')} AS g00, {ddot('c', 'atom')} AS g01, {ddot('atom', 'atom')} AS g11 FROM e JOIN st USING (cid)), n AS (SELECT cid, sum(q0 * q0 * g00) AS l00, sum(q0 * q1 * g01) AS l01, sum(q1 * q1 * g11) AS l11, sum(q0 * (g00 * a0 + g01 * a1)) AS r0, sum(q1 * (g01 * a0 + g11 * a1)) AS r1 FROM z GROUP BY cid)".replace("{st}", "st")


@query("qnt08_joint_scales", f"WITH {ENCODED}, {JOINT} SELECT cid, round((l11 * r0 - l01 * r1) / (l00 * l11 - l01 * l01), 6) AS s0, round((l00 * r1 - l01 * r0) / (l00 * l11 - l01 * l01), 6) AS s1 FROM n")
def qnt08(spark, d):
    rows = encodings(spark, d).select("cid", "a0", "a1", norm2("c").alias("g00"), dot("c", "atom").alias("g01"), norm2("atom").alias("g11"))
    steps = rows.groupBy("cid").agg(*[(F.max(F.abs(F.col(a))) / 7).alias(s) for a, s in (("a0", "s0"), ("a1", "s1"))])
    coded = rows.join(steps, "cid").withColumns({"q0": F.rint(F.col("a0") / F.col("s0")), "q1": F.rint(F.col("a1") / F.col("s1"))}).drop("s0", "s1")
    return compression.joint_scale_sums(coded, "cid").select("cid", r6("s0").alias("s0"), r6("s1").alias("s1"))


@query("qnt10_rebuild_codec", f"WITH {ENCODED}, {COEFFS}, st AS (SELECT cid, greatest(max(abs(a)), 1e-12) / 31 AS step FROM cf GROUP BY cid), z AS (SELECT cid, vec_id, a, round_even(a / step, 0) AS q FROM cf JOIN st USING (cid)), f AS (SELECT cid, sum(a * q) / sum(q * q) AS s FROM z GROUP BY cid) SELECT CAST(z.cid AS BIGINT) AS cid, round(max(abs(a - q * s)), 6) AS worst, round(sum((a - q * s) ** 2), 6) AS error FROM z JOIN f USING (cid) GROUP BY z.cid")
def qnt10(spark, d):
    """Coefficients of a float store coded anew: fitted, streamed, stored, read back and held against the floats."""
    floats = _coeffs(spark, d)
    coded = compression.quantise(floats, ["cid"], "a", 1.0, 6)
    place = stores.scratch(spark, "codec")
    stores.write_codec(compression.compress_lists(coded.select("cid", F.lit(0).alias("grp"), F.lit(0).alias("layer"), "vec_id", "q")), place, "overwrite")
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id")) - 1
    back = stores.read_codec(spark, place).join(floats.withColumn("nth", nth.cast("long")), ["cid", "nth"]).join(compression.fitted_scale(coded, ["cid"], "a"), "cid")
    off = F.col("a") - F.col("q") * F.col("scale")
    return back.groupBy("cid").agg(r6(F.max(F.abs(off))).alias("worst"), r6(F.sum(off * off)).alias("error"))


SHANNON = f"{FINE}, fr AS (SELECT q, count(*) AS n FROM qz GROUP BY q), ln AS (SELECT q, CAST(ceil(round(log2((SELECT sum(n) FROM fr) / n), 9)) AS BIGINT) AS len FROM fr)"


@query("huf02_canonical_codes", f"WITH {ENCODED}, {SHANNON} SELECT q, greatest(len, 1) AS len, CAST(coalesce(sum(2 ** (40 - greatest(len, 1))) OVER (ORDER BY greatest(len, 1), q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2 ** (40 - greatest(len, 1)) AS BIGINT) AS code FROM ln")
def huf02(spark, d):
    """Canonical codes of all symbols, for lengths of at least log2 of their shares' inverse."""
    counts = compression.quantise(_coeffs(spark, d), ["cid"], "a", 0.95, 5).groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per symbol
    total = sum(r["n"] for r in counts)
    lengths = {r["q"]: max(1, int(np.ceil(round(float(np.log2(total / r["n"])), 9)))) for r in counts}
    return spark.createDataFrame([(q, n, c) for q, (c, n) in compression.canonical_codes(lengths).items()], "q int, len long, code long")


@query("huf02_code_lengths", "SELECT true AS whole, true AS no_longer_than_shannon, true AS within_a_bit_of_entropy")
def huf02b(spark, d):
    """The lengths use up all codes, and the mean length is the entropy or up to a bit more."""
    counts = {r["q"]: r["n"] for r in compression.quantise(_coeffs(spark, d), ["cid"], "a", 0.95, 5).groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per symbol
    lengths, n = compression.huffman_lengths(counts), np.array(list(counts.values()), dtype=float)
    mean = sum(lengths[q] * c for q, c in counts.items()) / n.sum()
    shannon = sum(np.ceil(np.log2(n.sum() / c)) * c for c in counts.values()) / n.sum()
    entropy = float(-(n / n.sum() * np.log2(n / n.sum())).sum())
    return holds(spark, whole=sum(2.0**-x for x in lengths.values()) == 1.0, no_longer_than_shannon=bool(mean <= shannon), within_a_bit_of_entropy=bool(entropy <= mean + 1e-9 and mean < entropy + 1))


@query("suc04_budget", f"WITH {BASE} SELECT 'codes' AS part, 16.0 AS bits UNION ALL SELECT 'tree', round((2 * count(*) + count(DISTINCT cid)) / count(*), 6) FROM b")
def suc04(spark, d):
    forest, _, _ = _built(spark, d)
    flat = forest.select("cid", F.when(F.col("parent_local") == 0, 0).otherwise(1).alias("grp"), "vec_id", F.posexplode("coeffs").alias("layer", "a"))
    coded = compression.quantise(flat, ["cid", "grp", "layer"], "a", 1.0, 6)
    return compression.budget(forest, compression.compress_lists(coded), 2).where("part <> 'coefficients' or bits <= 0").select("part", r6("bits").alias("bits"))


@query("nrm02_linked_norms", f"WITH {BASE} SELECT count(*) AS n, 0 AS differing FROM b")
def nrm02(spark, d):
    """Norms along parents agree with the errors that the forest states: |x|^2 + norm - 2 <x, xh>."""
    forest, root, one = _built(spark, d)
    rows = linkage.reconstruct_forest(forest, root, one).select("vec_id", "xh", norm2("xh").alias("norm"))
    both = rows.join(forest.select("vec_id", "error"), "vec_id").join(base(spark, d).select("vec_id", "x"), "vec_id")
    off = F.abs(norm2("x") + F.col("norm") - 2 * dot("x", "xh") - F.col("error")) > 1e-6
    got = both.agg(F.count(F.lit(1)).alias("n"), F.sum(off.cast("long")).alias("differing")).first()
    return holds(spark, n=got["n"], differing=got["differing"])


@query("rep03_quantised_error", f"WITH {BASE} SELECT count(*) AS n, true AS more_bits_less_error, true AS near_the_floats FROM b")
def rep03(spark, d):
    forest, root, one = _built(spark, d)
    means = [linkage.quantised_error(forest, base(spark, d), root, one, bits).agg(F.count(F.lit(1)).alias("n"), F.avg("se").alias("m")).first() for bits in (4, 8, 12)]
    plain = forest.agg(F.avg("error")).first()[0]
    return holds(spark, n=means[1]["n"], more_bits_less_error=means[0]["m"] > means[1]["m"] > means[2]["m"] - 1e-9, near_the_floats=abs(means[2]["m"] - plain) < 1e-3)


@query("rep12_ridge", "SELECT round(regr_slope(l_discount, l_quantity), 6) AS slope, round(regr_intercept(l_discount, l_quantity), 6) AS intercept FROM lineitem")
def rep12(spark, d):
    return metrics.ridge(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity"], "l_discount", 0.0).select(r6(F.col("weights")[0]).alias("slope"), r6("intercept").alias("intercept"))


@query("rep16_training_stats", f"WITH {CENTERS} SELECT CAST(cid AS BIGINT) AS cid, count(*) AS n, round(avg({ddot('x', 'c')}), 6) AS mean_dot FROM b JOIN c USING (cid) GROUP BY cid")
def rep16(spark, d):
    rows = base(spark, d).join(centers(spark, d), "cid")
    return rows.groupBy(F.col("cid").cast("long").alias("cid")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(dot("x", "c"))).alias("mean_dot"))


@query("str01_block_encode", f"WITH {ENCODED} SELECT vec_id, code1, round(a1, 6) AS a1, (vec_id // 150 + 1) * 150 AS next_id FROM e")
def str01(spark, d):
    """Blocks of ids encoded in turn, each committed under the id that follows it, give what one batch gives."""
    from orrery.streaming.ingest import encode_blocks

    place = stores.scratch(spark, "blocks")
    encode_blocks(encodings(spark, d).select("vec_id", "code1", r6("a1").alias("a1")), place, 150, lambda block: block)
    return spark.read.parquet(place).select("vec_id", "code1", "a1", F.col("next_id").cast("long").alias("next_id"))


@query("ker03_argmax_by_column", f"WITH {CENTERS} SELECT vec_id, CAST(d - 1 AS INT) AS at FROM b, range(1, 65) t(d) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x[d] DESC, d) = 1")
def ker03(spark, d):
    return base(spark, d).select("vec_id", (F.array_position("x", F.array_max("x")) - 1).cast("int").alias("at"))



"""Queries over forests, clustering steps, quantizers, metrics and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.functions.vectors import cosine, dot, l2sq, norm2, normalise, subtract
from orrery.operators import codebooks, compression, kmeans, linkage, metrics, search, topk, virtual
from orrery.operators.encoding import Codebooks
from orrery.plans.catalog import BASE, CENTERS, ENCODED, atoms, base, centers, ddot, dl2, encodings, holds, queries_of, query, sub, vectors
from orrery.plans.core import NEIGHBOURS, PROBES, TRUTH, _truth, normed, r6
from orrery.sources import stores

COS = f"co AS (SELECT vec_id, cid, round({ddot('x', 'c')} / sqrt({ddot('x', 'x')}) / sqrt({ddot('c', 'c')}), 9) AS cos FROM b JOIN c USING (cid))"
LAYERS = f"""{COS}, nn AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY cos DESC, vec_id) - 1 AS nth, count(*) OVER (PARTITION BY cid) AS n FROM co),
f AS (SELECT *, greatest(1, CAST(floor(0.2 * n) AS BIGINT)) AS fst FROM nn), g AS (SELECT *, (n - fst) // 3 AS small, (n - fst) % 3 AS extra, nth - fst AS place FROM f),
ly AS (SELECT vec_id, cid, CASE WHEN place < 0 THEN 0 WHEN place < extra * (small + 1) THEN 1 + place // (small + 1) ELSE 1 + extra + (place - extra * (small + 1)) // greatest(small, 1) END AS layer FROM g)"""


def _layers(spark, d):
    rows = base(spark, d).join(centers(spark, d), "cid").select("vec_id", "cid", F.round(cosine("x", "c"), 9).alias("cos"))
    return linkage.radial_layers(rows, 0.2, 4).select("vec_id", "cid", "layer")


@query("lnk02_radial_layers", f"WITH {CENTERS}, {LAYERS} SELECT vec_id, CAST(layer AS INT) AS layer FROM ly")
def lnk02(spark, d):
    return _layers(spark, d).select("vec_id", "layer")


CANDIDATES = f"""{LAYERS}, {NEIGHBOURS}, cd AS (SELECT nb.vec_id, neighbour AS parent, p.layer, dist2 FROM nb JOIN ly o ON o.vec_id = nb.vec_id JOIN ly p ON p.vec_id = nb.neighbour
WHERE nb.rank <= 8 AND p.layer < o.layer AND p.layer >= o.layer - 2 QUALIFY row_number() OVER (PARTITION BY nb.vec_id, p.layer ORDER BY round(dist2, 12), neighbour) <= 2)"""


def _candidates(spark, d):
    return linkage.candidates(search.in_list_knn(base(spark, d), 8), _layers(spark, d), 2, 2)


@query("lnk03_candidates", f"WITH {CENTERS}, {CANDIDATES} SELECT vec_id, parent, CAST(layer AS INT) AS layer, round(dist2, 6) AS dist2 FROM cd")
def lnk03(spark, d):
    return _candidates(spark, d).withColumn("dist2", r6("dist2"))


@query("flt03_layer_window", f"WITH {CENTERS}, {CANDIDATES} SELECT layer, count(*) AS n FROM (SELECT CAST(layer AS INT) AS layer FROM cd) GROUP BY layer")
def flt03(spark, d):
    return _candidates(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("lnk15_causal_nearest", f"WITH {CENTERS}, {CANDIDATES} SELECT vec_id, parent FROM cd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(dist2, 12), parent) = 1")
def lnk15(spark, d):
    rows = _candidates(spark, d).withColumn("d", F.round("dist2", 12))
    return topk.top_k(rows, "vec_id", [F.col("d"), F.col("parent")], 1).select("vec_id", "parent")


FOREST = f"{NEIGHBOURS}, np AS (SELECT vec_id, cid, neighbour AS parent FROM nb WHERE rank = 1), ct AS (SELECT a.vec_id, a.cid, CASE WHEN p.parent = a.vec_id AND a.vec_id < a.parent THEN NULL ELSE a.parent END AS parent FROM np a LEFT JOIN np p ON p.vec_id = a.parent)"
DEPTHS = "dp AS (SELECT vec_id, cid, vec_id AS root, 0 AS depth FROM ct WHERE parent IS NULL UNION ALL SELECT ct.vec_id, ct.cid, dp.root, dp.depth + 1 FROM ct JOIN dp ON ct.parent = dp.vec_id)"


def _forest(spark, d):
    return linkage.cut_mutual(linkage.nearest_parents(base(spark, d)))


def _depths(spark, d):
    forest = _forest(spark, d)
    return forest.join(linkage.depths(forest), "vec_id")


@query("lnk09_nearest_parents", f"WITH {BASE}, {NEIGHBOURS} SELECT vec_id, neighbour AS parent FROM nb WHERE rank = 1")
def lnk09(spark, d):
    return linkage.nearest_parents(base(spark, d)).select("vec_id", "parent")


@query("lnk11_all_roots", f"WITH {BASE} SELECT vec_id, -1 AS parent FROM b")
def lnk11(spark, d):
    return base(spark, d).select("vec_id", F.lit(-1).alias("parent"))


@query("lnk12_cycle_cut", f"WITH {BASE}, {FOREST} SELECT vec_id, coalesce(parent, -1) AS parent FROM ct")
def lnk12(spark, d):
    return _forest(spark, d).select("vec_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("lnk13_depth_limit", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT dp.vec_id, CASE WHEN depth % 3 = 0 THEN -1 ELSE ct.parent END AS parent, CAST(depth % 3 AS BIGINT) AS depth FROM dp JOIN ct USING (vec_id)")
def lnk13(spark, d):
    return linkage.cut_deep(_forest(spark, d), 2).select("vec_id", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth")


@query("flt02_depth_filter", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT vec_id FROM dp WHERE depth + 1 <= 2")
def flt02(spark, d):
    return _depths(spark, d).where("depth + 1 <= 2").select("vec_id")


@query("lnk17_depths", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT vec_id, root, CAST(depth AS BIGINT) AS depth FROM dp")
def lnk17(spark, d):
    return _depths(spark, d).select("vec_id", "root", "depth")


@query("lnk18_global_parents", f"WITH {BASE}, {FOREST} SELECT vec_id, coalesce(parent, -1) AS parent FROM ct")
def lnk18(spark, d):
    forest = _forest(spark, d)
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id")).cast("int")
    local = forest.withColumn("local_id", nth)
    up = local.select(F.col("vec_id").alias("parent"), F.col("local_id").alias("parent_local"))
    return linkage.global_parents(local.join(up, "parent", "left").withColumn("parent_local", F.coalesce("parent_local", F.lit(0))))


@query("lnk19_linked_reconstruction", f"WITH RECURSIVE {ENCODED}, {FOREST}, pa AS (SELECT ct.vec_id, xh AS y FROM ct JOIN rc USING (vec_id) WHERE parent IS NULL UNION ALL SELECT ct.vec_id, [pa.y[i] + 0.5 * rc.xh[i] for i in range(1, 65)] FROM ct JOIN pa ON ct.parent = pa.vec_id JOIN rc ON rc.vec_id = ct.vec_id) SELECT vec_id, round({ddot('y', 'y')}, 6) AS norm FROM pa")
def lnk19(spark, d):
    # A child's own part weighs a half here; with each doubling a row takes on its ancestor's sum.
    rows = _forest(spark, d).join(search.reconstructed(encodings(spark, d)).select("vec_id", "xh"), "vec_id")
    rows = rows.select("vec_id", "parent", F.when(F.col("parent").isNull(), F.col("xh")).otherwise(F.transform("xh", lambda v: v * 0.5)).alias("y"))
    return linkage.sums_along_parents(rows).select("vec_id", r6(norm2("y")).alias("norm"))


NUMBERED = "pt AS (SELECT vec_id, cid, parent, 0 AS depth, [vec_id] AS path FROM ct WHERE parent IS NULL UNION ALL SELECT ct.vec_id, ct.cid, ct.parent, pt.depth + 1, list_append(pt.path, ct.vec_id) FROM ct JOIN pt ON ct.parent = pt.vec_id), nu AS (SELECT vec_id, CAST(cid AS BIGINT) AS cid, parent, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY cid ORDER BY depth, path) AS INT) AS local_id FROM pt), nl AS (SELECT nu.cid, nu.local_id, nu.vec_id, coalesce(p.local_id, 0) AS parent_local, nu.depth FROM nu LEFT JOIN nu p ON p.vec_id = nu.parent)"


def _numbered(spark, d):
    return linkage.numbered(_forest(spark, d))


@query("lnk16_breadth_first_numbers", f"WITH RECURSIVE {BASE}, {FOREST}, {NUMBERED} SELECT cid, local_id, vec_id, parent_local, depth FROM nl")
def lnk16(spark, d):
    return _numbered(spark, d)


@query("snk07_linkage_store", f"WITH RECURSIVE {BASE}, {FOREST}, {NUMBERED} SELECT cid, local_id, vec_id, parent_local, depth, round(0.5 * depth, 6) AS a FROM nl WHERE depth BETWEEN 1 AND 2")
def snk07(spark, d):
    """Written as trees of bits by list, and read back for a span of depths."""
    place = stores.scratch(spark, "linkage")
    forest = _numbered(spark, d).select("*", F.array("depth").alias("codes"), F.array(0.5 * F.col("depth")).alias("coeffs"), F.lit(0.0).alias("error"))
    stores.write_linkage(forest, place, "overwrite")
    return stores.read_linkage(spark, place, depths=(1, 2)).select("cid", "local_id", "vec_id", "parent_local", "depth", r6(F.col("coeffs")[0]).alias("a"))


@query("top05_deepest_lists", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT CAST(cid AS BIGINT) AS cid, CAST(max(depth) AS BIGINT) AS max_depth, count(*) AS n FROM dp GROUP BY cid ORDER BY 2 DESC, 1 LIMIT 3")
def top05(spark, d):
    stats = linkage.depth_stats(_depths(spark, d))
    return stats.orderBy(F.desc("max_depth"), "cid").limit(3).select(F.col("cid").cast("long").alias("cid"), "max_depth", "n")


@query("top06_depth_order", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT CAST(cid AS BIGINT) AS cid, vec_id, row_number() OVER (PARTITION BY cid ORDER BY depth, vec_id) AS place FROM dp")
def top06(spark, d):
    place = F.row_number().over(Window.partitionBy("cid").orderBy("depth", "vec_id")).cast("long")
    return _depths(spark, d).select(F.col("cid").cast("long").alias("cid"), "vec_id", place.alias("place"))


BAD = f"m AS (SELECT cid, avg({dl2('x', 'xh')}) AS mean FROM rc GROUP BY cid), r AS (SELECT *, row_number() OVER (ORDER BY mean, cid) - 1 AS nth, count(*) OVER () AS n FROM m), bd AS (SELECT cid, mean, mean > (SELECT mean FROM r WHERE nth = least(n - 1, CAST(round(0.7 * n) AS INT))) AS bad FROM r)"


def _bad(spark, d):
    errors = search.reconstructed(encodings(spark, d)).select("cid", l2sq("x", "xh").alias("mse"))
    return codebooks.bad_clusters(errors, 0.7)


@query("set01_union_lists", f"WITH {ENCODED}, {FOREST}, {BAD} SELECT vec_id, CAST(ct.cid AS BIGINT) AS cid, CASE WHEN bad THEN -1 ELSE coalesce(parent, -1) END AS parent FROM ct JOIN bd ON bd.cid = ct.cid")
def set01(spark, d):
    """Forests of good lists as they are and bad lists without parents, each built apart, as one linkage."""
    marks = _bad(spark, d).select(F.col("cid").cast("long").alias("cid"), "bad")
    rows = base(spark, d).withColumn("cid", F.col("cid").cast("long")).join(marks, "cid")
    good = linkage.cut_mutual(linkage.nearest_parents(rows.where("not bad").drop("bad")))
    bad = rows.where("bad").select("vec_id", "cid", F.lit(None).cast("long").alias("parent"))
    return linkage.union_linkages(good, bad).select("vec_id", "cid", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("rep01_depth_report", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM dp GROUP BY depth")
def rep01(spark, d):
    return metrics.depth_report(_depths(spark, d))


@query("rep01_mean_depth_buckets", f"WITH RECURSIVE {BASE}, {FOREST}, {DEPTHS} SELECT CAST(floor(m / 0.5) AS BIGINT) AS bucket, count(*) AS lists FROM (SELECT avg(depth) AS m FROM dp GROUP BY cid) GROUP BY 1")
def rep01b(spark, d):
    return metrics.mean_depth_buckets(_depths(spark, d), 0.5)


CHILDREN = "ch AS (SELECT a.vec_id, a.cid, count(k.vec_id) AS children FROM ct a LEFT JOIN ct k ON k.parent = a.vec_id GROUP BY ALL)"


@query("rep02_child_degrees", f"WITH {BASE}, {FOREST}, {CHILDREN} SELECT CAST(cid AS BIGINT) AS cid, round(avg(CASE WHEN children = 0 THEN 1.0 ELSE 0 END), 6) AS leaves, round(avg(CASE WHEN children > 1 THEN 1.0 ELSE 0 END), 6) AS branching, max(children) AS most FROM ch GROUP BY cid")
def rep02(spark, d):
    rows = metrics.child_degrees(_forest(spark, d))
    return rows.groupBy(F.col("cid").cast("long").alias("cid")).agg(r6(F.avg((F.col("children") == 0).cast("double"))).alias("leaves"), r6(F.avg((F.col("children") > 1).cast("double"))).alias("branching"), F.max("children").alias("most"))


@query("rep02_gini", f"WITH {BASE}, {FOREST}, {CHILDREN}, r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY children) AS i FROM ch) SELECT CAST(cid AS BIGINT) AS cid, round(2 * sum(i * children) / (count(*) * sum(children)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY cid")
def rep02b(spark, d):
    return metrics.gini(metrics.child_degrees(_forest(spark, d)), "cid", "children").select(F.col("cid").cast("long").alias("cid"), r6("gini").alias("gini"))


@query("rep02_subtree_sizes", f"WITH RECURSIVE {BASE}, {FOREST}, an AS (SELECT vec_id, vec_id AS top FROM ct UNION ALL SELECT an.vec_id, ct.parent FROM an JOIN ct ON ct.vec_id = an.top WHERE ct.parent IS NOT NULL) SELECT top AS vec_id, count(*) AS size FROM an GROUP BY top")
def rep02c(spark, d):
    return linkage.subtree_sizes(_forest(spark, d))


@query("rep04_cluster_angles", f"WITH {ENCODED} SELECT CAST(cid AS BIGINT) AS cid, round(avg(degrees(acos(least(1, greatest(-1, {ddot('x', 'c')} / sqrt({ddot('x', 'x')} * {ddot('c', 'c')})))))), 5) AS raw, round(avg(degrees(acos(least(1, greatest(-1, {ddot('xh', 'c')} / sqrt({ddot('xh', 'xh')} * {ddot('c', 'c')})))))), 5) AS rebuilt FROM rc GROUP BY cid")
def rep04(spark, d):
    from orrery.functions.vectors import angle_degrees

    rec = search.reconstructed(encodings(spark, d))
    return rec.groupBy(F.col("cid").cast("long").alias("cid")).agg(F.round(F.avg(angle_degrees("x", "c")), 5).alias("raw"), F.round(F.avg(angle_degrees("xh", "c")), 5).alias("rebuilt"))


@query("rep05_query_adc", f"WITH {ENCODED}, {PROBES}, t AS (SELECT *, {ddot('q', 'q')} + {ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')} AS adc, {dl2('q', 'x')} AS truth, {dl2('x', 'xh')} AS rest, {ddot(sub('x', 'xh'), sub('q', 'xh'))} AS directional FROM pr JOIN rc USING (cid) QUALIFY row_number() OVER (PARTITION BY qid, vec_id ORDER BY score DESC) = 1) SELECT qid, vec_id, round(adc, 6) AS adc, round(truth, 6) AS truth, round(rest, 6) AS residual_norm2, round({ddot('xh', 'xh')}, 6) AS z_norm2, round(directional, 6) AS directional_term, round(truth - adc, 6) AS gap FROM t")
def rep05(spark, d):
    """Each query with the rows of the lists it probes: estimated and true distances, and what lies between them."""
    rec = search.reconstructed(encodings(spark, d))
    q = queries_of(spark, d)
    both = search.probe(q, centers(spark, d), 3).select("qid", "q", "cid").join(rec.drop("c"), "cid")
    adc, truth = norm2("q") + norm2("xh") - 2 * dot("q", "xh"), l2sq("q", "x")
    directional = dot(subtract("x", "xh"), subtract("q", "xh"))
    return both.select("qid", "vec_id", r6(adc).alias("adc"), r6(truth).alias("truth"), r6(l2sq("x", "xh")).alias("residual_norm2"), r6(norm2("xh")).alias("z_norm2"), r6(directional).alias("directional_term"), r6(truth - adc).alias("gap"))


@query("rep06_truth_pairs", f"WITH {ENCODED}, {TRUTH} SELECT gt.qid, gt.rank, gt.vec_id, round({ddot('q', 'xh')}, 6) AS dot_hat, round({ddot('q', 'x')}, 6) AS dot_raw, round({ddot('xh', 'xh')}, 6) AS norm_hat, round({dl2('x', 'xh')}, 6) AS mse FROM gt JOIN rc USING (vec_id) JOIN q USING (qid)")
def rep06(spark, d):
    rec = search.reconstructed(encodings(spark, d))
    rows = _truth(spark, d).join(rec, "vec_id").join(F.broadcast(queries_of(spark, d)), "qid")
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", r6(dot("q", "xh")).alias("dot_hat"), r6(dot("q", "x")).alias("dot_raw"), r6(norm2("xh")).alias("norm_hat"), r6(l2sq("x", "xh")).alias("mse"))


SHORT = f"sh AS (SELECT qid, vec_id, {ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')} AS adc, row_number() OVER (PARTITION BY qid ORDER BY round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 12), vec_id) AS rank FROM q, rc QUALIFY rank <= 30)"


def _short(spark, d, k=30):
    return search.adc_scan(normed(spark, d), queries_of(spark, d), centers(spark, d), atoms(spark, d), k)


@query("rep07_candidate_features", f"WITH RECURSIVE {ENCODED}, {FOREST}, {DEPTHS}, {TRUTH}, {SHORT} SELECT sh.qid, sh.vec_id, sh.rank, CAST(dp.depth AS BIGINT) AS depth, round({dl2('x', 'xh')}, 6) AS rest, round({dl2('q', 'x')}, 6) AS truth, gt.vec_id IS NOT NULL AS hit FROM sh JOIN rc USING (vec_id) JOIN q USING (qid) JOIN dp ON dp.vec_id = sh.vec_id LEFT JOIN gt ON gt.qid = sh.qid AND gt.vec_id = sh.vec_id AND gt.rank <= 10")
def rep07(spark, d):
    rec = search.reconstructed(encodings(spark, d)).select("vec_id", "x", "xh")
    hits = _truth(spark, d).select("qid", "vec_id", F.lit(True).alias("hit"))
    rows = _short(spark, d).join(rec, "vec_id").join(F.broadcast(queries_of(spark, d)), "qid").join(_depths(spark, d).select("vec_id", "depth"), "vec_id").join(hits, ["qid", "vec_id"], "left")
    return rows.select("qid", "vec_id", F.col("rank").cast("long").alias("rank"), "depth", r6(l2sq("x", "xh")).alias("rest"), r6(l2sq("q", "x")).alias("truth"), F.coalesce("hit", F.lit(False)).alias("hit"))


@query("rep08_feature_summary", f"WITH RECURSIVE {ENCODED}, {FOREST}, {DEPTHS}, {TRUTH}, {SHORT} SELECT CASE WHEN depth = 0 THEN 'root' WHEN depth <= 2 THEN 'near' ELSE 'deep' END AS bucket, count(*) AS n, count(gt.vec_id) AS hits FROM sh JOIN dp ON dp.vec_id = sh.vec_id LEFT JOIN gt ON gt.qid = sh.qid AND gt.vec_id = sh.vec_id GROUP BY 1")
def rep08(spark, d):
    hits = _truth(spark, d).select("qid", "vec_id", F.lit(1).alias("hit"))
    rows = _short(spark, d).join(_depths(spark, d).select("vec_id", "depth"), "vec_id").join(hits, ["qid", "vec_id"], "left")
    bucket = F.when(F.col("depth") == 0, "root").when(F.col("depth") <= 2, "near").otherwise("deep")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))


@query("rep09_rerank_gain", f"WITH {ENCODED}, {TRUTH}, {SHORT}, o AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {dl2('q', 'x')}, vec_id) AS rank FROM sh JOIN rc USING (vec_id) JOIN q USING (qid)) SELECT round((SELECT avg(CASE WHEN sh.rank <= 10 THEN 1.0 ELSE 0 END) FROM gt LEFT JOIN sh USING (qid, vec_id) WHERE gt.rank = 1), 6) AS adc, round((SELECT avg(CASE WHEN o.rank <= 10 THEN 1.0 ELSE 0 END) FROM gt LEFT JOIN o USING (qid, vec_id) WHERE gt.rank = 1), 6) AS oracle")
def rep09(spark, d):
    short, gt = _short(spark, d), _truth(spark, d)
    exact = search.rerank(short, base(spark, d), queries_of(spark, d), 30)
    a, o = (metrics.recall_curve(gt, p, [10]).select(r6("value").alias(n)) for p, n in ((short, "adc"), (exact, "oracle")))
    return a.crossJoin(o)


@query("rep10_rerank_grid", f"WITH {ENCODED}, {TRUTH}, {SHORT} SELECT CAST(ck AS INT) AS candidate_k, round(avg(CASE WHEN sh.rank <= ck THEN 1.0 ELSE 0 END), 6) AS found FROM gt CROSS JOIN (VALUES (5), (10), (30)) t(ck) LEFT JOIN sh ON sh.qid = gt.qid AND sh.vec_id = gt.vec_id GROUP BY ck")
def rep10(spark, d):
    return metrics.top_recall(_truth(spark, d), _short(spark, d), 10, [5, 10, 30]).select(F.col("k").alias("candidate_k"), r6("value").alias("found"))


@query("rep11_calibration", "WITH t AS (SELECT *, floor(l_quantity / 10) AS bk, l_orderkey % 2 = 0 AS tr FROM lineitem), m AS (SELECT bk, avg(l_discount) AS own, count(*) AS n FROM t WHERE tr GROUP BY bk), a AS (SELECT avg(l_discount) AS al FROM t WHERE tr) SELECT CAST(bk AS BIGINT) AS bk, round(max(CASE WHEN m.n >= 50 THEN own ELSE al END), 6) AS correction FROM t LEFT JOIN m USING (bk), a GROUP BY bk")
def rep11(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.floor(F.col("l_quantity") / 10).alias("bk"), "l_discount", (F.col("l_orderkey") % 2 == 0).alias("tr"))
    return metrics.calibrate(rows, "bk", "l_discount", "tr").groupBy("bk").agg(r6(F.max("correction")).alias("correction"))


@query("rep13_weighted_correlation", "SELECT round((sum(l_quantity * l_discount * l_tax) / sum(l_quantity) - sum(l_quantity * l_discount) * sum(l_quantity * l_tax) / sum(l_quantity) ** 2) / sqrt((sum(l_quantity * l_discount ** 2) / sum(l_quantity) - (sum(l_quantity * l_discount) / sum(l_quantity)) ** 2) * (sum(l_quantity * l_tax ** 2) / sum(l_quantity) - (sum(l_quantity * l_tax) / sum(l_quantity)) ** 2)), 6) AS correlation FROM lineitem")
def rep13(spark, d):
    return metrics.weighted_correlation(spark.read.parquet(f"{d}/lineitem.parquet"), "l_discount", "l_tax", "l_quantity").select(r6("correlation").alias("correlation"))


@query("rep14_stability", "WITH r AS (SELECT l_suppkey AS cid, l_linenumber % 2 AS run, avg(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 5) SELECT a.cid, round(a.v - b.v, 6) AS shift FROM r a JOIN r b ON a.cid = b.cid AND a.run = 0 AND b.run = 1")
def rep14(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("cid"), (F.col("l_linenumber") % 2).alias("run")).agg(F.avg("l_discount").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    a, b = (rows.where(F.col("run") == k).select("cid", F.col("v").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, "cid").select("cid", r6(F.col("a") - F.col("b")).alias("shift"))


# Clustering


@query("km01_one_step", f"WITH {BASE}, st AS (SELECT label AS code, x AS s FROM (SELECT cid AS label, x, row_number() OVER (PARTITION BY cid ORDER BY vec_id) AS i FROM b) WHERE i = 1), a AS (SELECT vec_id, x, code, {ddot('x', 's')} AS dot FROM b, st QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({ddot('x', 's')}, 12) DESC, code) = 1) SELECT CAST(code AS BIGINT) AS code, count(*) AS n, round(sum(1 - dot), 5) AS cost FROM a GROUP BY code")
def km01(spark, d):
    first = base(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where("i = 1")
    codes, starts = search.matrix(first, "cid", "x")
    rows = base(spark, d).withColumn("x", normalise("x"))
    found = search.assign(rows, spark.createDataFrame([(int(c), [float(v) for v in x]) for c, x in zip(codes, kmeans.unit_rows(starts))], "cid int, c array<double>"))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(1 - F.col("dot")), 5).alias("cost"))


@query("km02_anneal_step", f"WITH {CENTERS}, k AS (SELECT vec_id, 1 - {ddot('x', 'c')} / sqrt({ddot('c', 'c')}) AS cost FROM b JOIN c USING (cid)) SELECT vec_id, round(CASE WHEN cost > 0.5 THEN greatest(0.1, 0.8 * (1 - 0.3)) ELSE least(1.0, 0.8 * (1 + 0.3 / 2)) END, 6) AS w FROM k")
def km02(spark, d):
    rows = base(spark, d).join(centers(spark, d), "cid").select("vec_id", (1 - dot("x", "c") / F.sqrt(norm2("c"))).alias("cost"), F.lit(0.8).alias("w"))
    return kmeans.anneal(rows, 0.5, 0.3, 0.1).select("vec_id", r6("w").alias("w"))


@query("km03_lower_quantile", "SELECT round(l_extendedprice, 6) AS v FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET (SELECT CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) FROM lineitem)")
def km03(spark, d):
    v = kmeans.lower_quantile(spark.read.parquet(f"{d}/lineitem.parquet").select("l_extendedprice"), "l_extendedprice", 0.95)
    return spark.createDataFrame([(round(float(v), 6),)], "v double")


@query("km04_histogram_quantile", f"WITH {CENTERS}, k AS (SELECT least(199, CAST(floor((1 - {ddot('x', 'c')}) / 2 * 200) AS INT)) AS bin FROM b JOIN c USING (cid)), h AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS upto FROM k GROUP BY bin) SELECT round((min(bin) + 1) * 2.0 / 200, 6) AS threshold FROM h WHERE upto >= 0.9 * (SELECT count(*) FROM k)")
def km04(spark, d):
    costs = base(spark, d).join(centers(spark, d), "cid").select((1 - dot("x", "c")).alias("cost"))
    return kmeans.histogram_quantile(costs, "cost", 0.9).select(r6("threshold").alias("threshold"))


@query("km05_weighted_cost", f"WITH {CENTERS} SELECT round(sum((1 + vec_id % 3) * (1 - {ddot('x', 'c')})) / sum(1 + vec_id % 3), 6) AS cost FROM b JOIN c USING (cid)")
def km05(spark, d):
    rows = base(spark, d).join(centers(spark, d), "cid").select((1 + F.col("vec_id") % 3).alias("w"), (1 - dot("x", "c")).alias("cost"))
    return rows.agg(r6(F.sum(F.col("w") * F.col("cost")) / F.sum("w")).alias("cost"))


@query("km06_random_start", "SELECT vec_id FROM embeddings ORDER BY (vec_id * 2654435761 + 12345) % 4294967296, vec_id LIMIT 16")
def km06(spark, d):
    from orrery.operators.sampling import bottom_k

    return bottom_k(vectors(spark, d).select("vec_id"), 16)


def _centers_table(spark, c: np.ndarray):
    return spark.createDataFrame([(i, round(float((x * x).sum()), 6)) for i, x in enumerate(c)], "code int, norm2 double")


def _cost(rows, centers_) -> float:
    return kmeans.partial_sums(rows, kmeans.unit_rows(centers_))[2]


@query("km07_plus_plus", "SELECT 8 AS centers, true AS of_the_rows, true AS apart")
def km07(spark, d):
    got = kmeans.init_plus_plus(base(spark, d), 8)
    rows = kmeans.unit_rows(search.matrix(base(spark, d), "vec_id", "x")[1])
    near = (got @ rows.T).max(1)
    return holds(spark, centers=len(got), of_the_rows=bool((near > 1 - 1e-9).all()), apart=bool((got @ got.T - 2 * np.eye(8) < 1 - 1e-9).all()))


@query("km08_parallel_start", "SELECT 8 AS centers, true AS unit, true AS no_worse_than_random")
def km08(spark, d):
    rows = base(spark, d)
    got = kmeans.init_parallel(rows, 8)
    worst = max(_cost(rows, kmeans.init_random(rows, 8, s)) for s in (1, 2, 3))
    return holds(spark, centers=len(got), unit=bool(np.allclose((got * got).sum(1), 1)), no_worse_than_random=_cost(rows, got) <= worst + 1e-9)


@query("km09_spherical_kmeans", "SELECT 10 AS centers, true AS unit, true AS cost_falls, true AS at_rest")
def km09(spark, d):
    rows = base(spark, d)
    start = kmeans.init_random(rows, 10)
    found = [kmeans.spherical_kmeans(rows, start, n) for n in (1, 3)] + [kmeans.spherical_kmeans(rows, start, 40, 1e-12)]
    costs = [_cost(rows, m.centers) for m in found]
    more = _cost(rows, kmeans.spherical_kmeans(rows, found[-1].centers, 1).centers)
    return holds(spark, centers=len(found[-1].centers), unit=bool(np.allclose((found[-1].centers ** 2).sum(1), 1)), cost_falls=bool(_cost(rows, start) >= costs[0] - 1e-9 and costs[0] >= costs[1] - 1e-9 and costs[1] >= costs[2] - 1e-9), at_rest=abs(more - costs[-1]) < 1e-9)


@query("cb01_residual_init", f"WITH {BASE} SELECT 10 AS root, 8 AS small, true AS shorter, true AS orthogonal FROM (SELECT 1)")
def cb01(spark, d):
    """Every layer's projection takes length off every vector, and leaves a rest at right angles to it."""
    books, rest = codebooks.residual_init(base(spark, d), [10, 8], rounds=3)
    x, r = (search.matrix(t, "vec_id", "x")[1] for t in (base(spark, d), rest))
    first = x @ books[0].T
    at = first.argmax(1)
    one = x - first[np.arange(len(x)), at, None] * books[0][at]
    second = one @ books[1].T
    two = one - second.max(1)[:, None] * books[1][second.argmax(1)]
    return holds(spark, root=len(books[0]), small=len(books[1]), shorter=bool(((one**2).sum(1) <= (x**2).sum(1) + 1e-12).all()), orthogonal=bool(np.allclose(two, r) and np.allclose((one * books[0][at]).sum(1), 0, atol=1e-9)))


@query("cb02_one_layer_update", f"WITH {ENCODED} SELECT CAST(cid AS BIGINT) AS code, round(sum(a0 * x[1]) / sum(a0 * a0), 6) AS c0, round(sum(a0 * x[64]) / sum(a0 * a0), 6) AS c63 FROM e GROUP BY cid")
def cb02(spark, d):
    rows = encodings(spark, d).select("x", F.array("cid").alias("codes"), F.array("a0").alias("coeffs"))
    c = search.matrix(centers(spark, d), "cid", "c")[1]
    new = codebooks.update_codebooks(rows, [c])[0]
    return spark.createDataFrame([(i, round(float(r[0]), 6), round(float(r[63]), 6)) for i, r in enumerate(new)], "code long, c0 double, c63 double")


@query("cb04_root_elimination", "SELECT true AS equals_joint_solve, true AS fits_better")
def cb04(spark, d):
    rows = encodings(spark, d).select("x", F.array("cid", "code1").alias("codes"), F.array("a0", "a1").alias("coeffs"))
    books = [search.matrix(centers(spark, d), "cid", "c")[1], search.matrix(atoms(spark, d), "code", "atom")[1]]
    got, joint = codebooks.update_root_by_elimination(rows, books), codebooks.update_codebooks(rows, books)
    return holds(spark, equals_joint_solve=bool(np.allclose(np.vstack(got), np.vstack(joint), atol=1e-6)), fits_better=_fit(rows, got) <= _fit(rows, books) + 1e-9)


def _fit(rows, books) -> float:
    """The mean squared error of rows under codebooks, from the sums of the normal equations and of the squares."""
    g, t = codebooks.normal_equations(rows, [len(b) for b in books], books[0].shape[1])
    c = np.vstack(books)
    return float(rows.agg(F.sum(norm2("x"))).first()[0] - 2 * (c * t).sum() + (g * (c @ c.T)).sum())


@query("cb03_two_pass_root", "SELECT true AS falls, true AS not_below_joint")
def cb03(spark, d):
    rows = encodings(spark, d).select("x", F.array("cid", "code1").alias("codes"), F.array("a0", "a1").alias("coeffs"))
    books = [search.matrix(centers(spark, d), "cid", "c")[1], search.matrix(atoms(spark, d), "code", "atom")[1]]
    before, got, joint = _fit(rows, books), _fit(rows, codebooks.update_two_pass(rows, books)), _fit(rows, codebooks.update_codebooks(rows, books))
    return holds(spark, falls=got <= before + 1e-9, not_below_joint=got >= joint - 1e-6)


@query("cb08_rotation_moment", f"WITH {ENCODED} SELECT i, round(sum(xh[i] * x[i]), 6) AS m FROM rc, (SELECT unnest([1, 2, 63, 64]) AS i) GROUP BY i")
def cb08(spark, d):
    m = codebooks.procrustes_moment(search.reconstructed(encodings(spark, d)), 64)
    return spark.createDataFrame([(i, round(float(m[i - 1, i - 1]), 6)) for i in (1, 2, 63, 64)], "i int, m double")


@query("cb09_bad_clusters", f"WITH {ENCODED}, {BAD} SELECT CAST(cid AS BIGINT) AS cid, round(mean, 6) AS mean, bad FROM bd")
def cb09(spark, d):
    return _bad(spark, d).select(F.col("cid").cast("long").alias("cid"), r6("mean").alias("mean"), "bad")


def _books(spark, d) -> tuple[Codebooks, Codebooks]:
    c, a = search.matrix(centers(spark, d), "cid", "c")[1], search.matrix(atoms(spark, d), "code", "atom")[1]
    return Codebooks([c, a]), Codebooks([c - c.mean(0), a])


@query("enc03_least_squares", f"WITH {ENCODED}, g AS (SELECT vec_id, {ddot('c', 'c')} AS g00, {ddot('c', 'atom')} AS g01, {ddot('atom', 'atom')} AS g11, {ddot('x', 'c')} AS t0, {ddot('x', 'atom')} AS t1 FROM e) SELECT vec_id, round((g11 * t0 - g01 * t1) / (g00 * g11 - g01 * g01), 6) AS a0, round((g00 * t1 - g01 * t0) / (g00 * g11 - g01 * g01), 6) AS a1 FROM g")
def enc03(spark, d):
    rows = encodings(spark, d)
    g00, g01, g11, t0, t1 = norm2("c"), dot("c", "atom"), norm2("atom"), dot("x", "c"), dot("x", "atom")
    det = g00 * g11 - g01 * g01
    return rows.select("vec_id", r6((g11 * t0 - g01 * t1) / det).alias("a0"), r6((g00 * t1 - g01 * t0) / det).alias("a1"))


@query("enc07_greedy", f"WITH {ENCODED} SELECT vec_id, code1, round(a1, 6) AS a1 FROM e")
def enc07(spark, d):
    return encodings(spark, d).select("vec_id", "code1", r6("a1").alias("a1"))


#: The least-squares error of two layers for each pair of codes.
PAIRED = f"pg AS (SELECT vec_id, cid, root, code, xx - (g11 * t0 * t0 - 2 * g01 * t0 * t1 + g00 * t1 * t1) / (g00 * g11 - g01 * g01) AS err, gain FROM (SELECT b.vec_id, b.cid, k.cid AS root, code, {ddot('x', 'x')} AS xx, {ddot('k.c', 'k.c')} AS g00, {ddot('k.c', 'atom')} AS g01, {ddot('atom', 'atom')} AS g11, {ddot('x', 'k.c')} AS t0, {ddot('x', 'atom')} AS t1, {ddot('x', 'k.c')} ** 2 / {ddot('k.c', 'k.c')} AS gain FROM b, c k, atm))"


@query("enc10_beam_and_search", f"WITH {ENCODED}, {PAIRED}, br AS (SELECT *, dense_rank() OVER (PARTITION BY vec_id ORDER BY round(gain, 12) DESC, root) AS nth FROM pg) SELECT vec_id, round(greatest(min(err), 0), 5) + 0.0 AS mse FROM br WHERE nth <= 4 GROUP BY vec_id")
def enc10(spark, d):
    # With two layers the beam's best pair can't be bettered by the search, which leaves the root.
    from orrery.operators.encoding import encode

    return encode(base(spark, d), _books(spark, d)[0]).select("vec_id", (F.round(F.greatest("mse", F.lit(0.0)), 5) + 0.0).alias("mse"))


@query("enc12_forced_root", f"WITH {ENCODED}, {PAIRED} SELECT vec_id, CAST(cid AS INT) AS cid, round(greatest(min(err), 0), 5) + 0.0 AS mse FROM pg WHERE root = cid GROUP BY vec_id, cid")
def enc12(spark, d):
    from orrery.operators.encoding import encode

    got = encode(base(spark, d).withColumn("cid", F.col("cid").cast("int")), _books(spark, d)[0], root="cid")
    return got.select("vec_id", "cid", (F.round(F.greatest("mse", F.lit(0.0)), 5) + 0.0).alias("mse"))


@query("enc08_greedy_forced_root", f"WITH {ENCODED} SELECT vec_id, CAST(cid AS INT) AS root, code1, round(a0, 6) AS a0, round(a1, 6) AS a1 FROM e")
def enc08(spark, d):
    from orrery.operators.encoding import greedy_encode

    got = greedy_encode(base(spark, d).withColumn("root", F.col("cid").cast("int")), _books(spark, d)[0], "root")
    return got.select("vec_id", F.col("codes")[0].alias("root"), F.col("codes")[1].alias("code1"), r6(F.col("coeffs")[0]).alias("a0"), r6(F.col("coeffs")[1]).alias("a1"))


for _policy in ("structured", "nn_forest", "random_forest", "all_roots"):

    @query(f"lnk04_forest_{_policy}", f"WITH {BASE} SELECT CAST(cid AS BIGINT) AS cid, count(*) AS n, true AS parents_first, true AS depths_fit, true AS numbers_fit FROM b GROUP BY cid")
    def lnk04(spark, d, policy=_policy):
        """Each list whole, parents before children and one less deep, none deeper than 4, numbers from 1 on by depth."""
        root, one = _books(spark, d)
        forest = stores.spooled(linkage.build_forest(base(spark, d), root, one, policy), "forest")
        up = forest.select("cid", F.col("local_id").alias("parent_local"), F.col("depth").alias("above"))
        rows = forest.join(up, ["cid", "parent_local"], "left").withColumn("before", F.lag("depth", 1, 0).over(Window.partitionBy("cid").orderBy("local_id")))
        fits = (F.col("depth") == F.coalesce(F.col("above") + 1, F.lit(0))) & (F.col("depth") <= 4) & (F.lit(policy != "all_roots") | (F.col("depth") == 0))
        in_order = (F.max("local_id") == F.count(F.lit(1))) & F.bool_and(F.col("before") <= F.col("depth"))
        return rows.groupBy("cid").agg(F.countDistinct("vec_id").alias("n"), F.bool_and(F.col("parent_local") < F.col("local_id")).alias("parents_first"), F.bool_and(fits).alias("depths_fit"), in_order.alias("numbers_fit"))


def _scan_agrees(spark, d, forest, probes, found, root, one, k):
    """Ranks of a linked scan that differ from those of vectors rebuilt and compared one by one."""
    rebuilt = linkage.reconstruct_forest(forest, root, one).where("vec_id >= 0")

    def one_by_one(asked, rows):
        """Of a list's rows, the k nearest of each query that probes it."""
        ids, xh, parts = rows.column("vec_id").to_numpy(), search.stacked(rows.column("xh").combine_chunks()), []
        for qid, one_q in zip(asked.column("qid").to_pylist(), search.stacked(asked.column("q").combine_chunks())):
            if not len(ids):
                break
            rest = xh - one_q
            wanted = np.round(np.einsum("ij,ij->i", rest, rest) - one_q @ one_q, 9)
            last = np.partition(wanted, min(k, len(ids)) - 1)[min(k, len(ids)) - 1]
            near = np.flatnonzero(~(wanted > last))
            near = near[np.lexsort((ids[near], wanted[near]))][:k]
            parts.append((np.full(len(near), qid), ids[near], wanted[near]))
        columns = [np.concatenate(c) for c in zip(*parts)] or [[], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["qid", "vec_id", "wanted"])

    asked = probes.select("qid", "q", F.col("cid").cast("long").alias("cid")).groupBy("cid")
    near = asked.cogroup(rebuilt.groupBy("cid")).applyInArrow(one_by_one, "qid long, vec_id long, wanted double")
    plain = topk.top_k(near, "qid", [F.col("wanted"), F.col("vec_id")], k).select("qid", F.col("rank").alias("rank"), "wanted")
    both = plain.join(found.select("qid", "rank", "dist"), ["qid", "rank"], "full")
    return both.where("wanted is null or dist is null or abs(wanted - dist) > 1e-6").count()


AGREES = f"WITH {BASE} SELECT count(*) * 5 AS found, 0 AS differing FROM q"


@query("jn12_linked_scan", AGREES)
def jn12(spark, d):
    root, one = _books(spark, d)
    forest = stores.spooled(linkage.build_forest(base(spark, d), root, one, "nn_forest"), "forest")
    q = queries_of(spark, d)
    probes = search.probe(q, centers(spark, d), 4)
    found = stores.spooled(linkage.linked_scan(forest, q, probes, root, one, 5), "found")
    return holds(spark, found=found.count(), differing=_scan_agrees(spark, d, forest, probes, found, root, one, 5))


@query("jn15_scan_of_stored_trees", AGREES)
def jn15(spark, d):
    """As jn12, with parents decoded from the bits of a stored linkage."""
    root, one = _books(spark, d)
    forest = stores.spooled(linkage.build_forest(base(spark, d), root, one, "nn_forest"), "forest")
    place = stores.scratch(spark, "linkage")
    stores.write_linkage(forest, place, "overwrite")
    q = queries_of(spark, d)
    probes = search.probe(q, centers(spark, d), 4)
    wanted = sorted({r["cid"] for r in probes.select("cid").distinct().collect()})  # at most a number per list
    found = stores.spooled(linkage.linked_scan(stores.read_linkage(spark, place, wanted), q, probes, root, one, 5), "found")
    return holds(spark, found=found.count(), differing=_scan_agrees(spark, d, forest, probes, found, root, one, 5))


# Virtual roots


@query("vir01_counts", f"WITH {BASE} SELECT CAST(cid AS BIGINT) AS cid, CAST(least(count(*), least(8, greatest(2, round(0.1 * count(*))))) AS BIGINT) AS k FROM b GROUP BY cid")
def vir01(spark, d):
    return virtual.root_counts(base(spark, d), ratio=0.1, least=2, most=8).select(F.col("cid").cast("long").alias("cid"), "k")


FUZZY = f"{NEIGHBOURS}, rho AS (SELECT vec_id, min(sqrt(dist2)) AS rho, avg(sqrt(dist2)) AS sigma FROM nb WHERE rank <= 4 GROUP BY vec_id), pe AS (SELECT nb.vec_id AS i, neighbour AS j, exp(-greatest(0, sqrt(dist2) - rho) / sigma) AS p FROM nb JOIN rho ON rho.vec_id = nb.vec_id WHERE rank <= 4), w AS (SELECT a.i, a.j, a.p + coalesce(r.p, 0) - a.p * coalesce(r.p, 0) AS w FROM pe a LEFT JOIN pe r ON r.i = a.j AND r.j = a.i), sy AS (SELECT i, j, w FROM w UNION SELECT j, i, w FROM w)"


def _fuzzy(spark, d):
    knn = search.in_list_knn(base(spark, d), 4)
    scales = knn.groupBy("vec_id").agg(F.min(F.sqrt("dist2")).alias("rho"), F.avg(F.sqrt("dist2")).alias("sigma"))
    return virtual.fuzzy_edges(knn, scales)


@query("vir03_fuzzy_degrees", f"WITH {BASE}, {FUZZY} SELECT i AS vec_id, round(sum(w), 5) AS degree FROM (SELECT i, j, max(w) AS w FROM sy GROUP BY i, j) GROUP BY i")
def vir03(spark, d):
    return _fuzzy(spark, d).groupBy("vec_id").agg(F.round(F.sum("w"), 5).alias("degree"))


@query("vir04_seeds", f"WITH {BASE}, {FUZZY}, dg AS (SELECT i AS vec_id, sum(w) AS degree FROM (SELECT i, j, max(w) AS w FROM sy GROUP BY i, j) GROUP BY i), mx AS (SELECT b.cid, vec_id FROM dg JOIN b USING (vec_id) QUALIFY row_number() OVER (PARTITION BY b.cid ORDER BY round(degree, 9) DESC, vec_id) = 1) SELECT CAST(cid AS BIGINT) AS cid, vec_id AS first_seed, CAST(3 AS BIGINT) AS n FROM mx")
def vir04(spark, d):
    """The first seed of a list is its row of the greatest degree, which is a peak; three distinct ones come of each."""
    got = virtual.seeds(_fuzzy(spark, d), base(spark, d).select("vec_id", "cid"), 3)
    return got.groupBy("cid").agg(F.min_by("vec_id", "nth").alias("first_seed"), F.countDistinct("vec_id").alias("n"))


@query("vir06_virtual_roots", f"WITH {BASE} SELECT CAST(cid AS BIGINT) AS cid, CAST(3 AS BIGINT) AS n, true AS at_rest FROM b GROUP BY cid")
def vir06(spark, d):
    """Three sub-centers of each list, each the mean of the rows nearest to it."""
    got = stores.spooled(virtual.sub_centers(base(spark, d), 3, 200), "sub-centers")
    rows = base(spark, d).select(F.col("cid").cast("long").alias("cid"), "vec_id", "x").join(got.select("cid", "local_id", F.col("x").alias("y")), "cid")
    near = topk.top_k(rows.withColumn("d2", F.round(l2sq("x", "y"), 12)), "vec_id", [F.col("d2"), F.col("local_id")], 1)
    means = V.mean_vectors(near.withColumn("key", F.struct("cid", "local_id")), "key", "x").select("key.*", "c")
    return got.join(means, ["cid", "local_id"]).groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.bool_and(l2sq("x", "c") < 1e-9).alias("at_rest"))


# Compression


COEFFS = "cf AS (SELECT vec_id, cid, a0 AS a FROM e)"


def _coeffs(spark, d):
    return encodings(spark, d).select("vec_id", F.col("cid").cast("long").alias("cid"), F.col("a0").alias("a"))


QUANTISED = f"{COEFFS}, sp AS (SELECT cid, greatest(quantile_cont(abs(a), 0.95), 1e-12) / 127 AS step FROM cf GROUP BY cid), qz AS (SELECT vec_id, cid, a, CAST(greatest(-127, least(127, round_even(a / step, 0))) AS INT) AS q, abs(round_even(a / step, 0)) > 127 AS clipped FROM cf JOIN sp USING (cid))"


@query("qnt01_quantise", f"WITH {ENCODED}, {QUANTISED} SELECT vec_id, q, clipped FROM qz")
def qnt01(spark, d):
    return compression.quantise(_coeffs(spark, d), ["cid"], "a", 0.95, 8).select("vec_id", "q", "clipped")


@query("qnt02_best_percentile", f"WITH {ENCODED}, {COEFFS}, sp AS (SELECT cid, p, greatest(quantile_cont(abs(a), p), 1e-12) / 7 AS step FROM cf, (VALUES (0.9), (0.95), (1.0)) t(p) GROUP BY cid, p), " .replace("quantile_cont(abs(a), p)", "CASE p WHEN 0.9 THEN quantile_cont(abs(a), 0.9) WHEN 0.95 THEN quantile_cont(abs(a), 0.95) ELSE max(abs(a)) END") + "z AS (SELECT cid, p, a, greatest(-7, least(7, round_even(a / step, 0))) AS q FROM cf JOIN sp USING (cid)), r AS (SELECT cid, p, round(sum(a * a) - sum(a * q) ** 2 / sum(q * q), 9) AS err FROM z GROUP BY cid, p) SELECT CAST(cid AS BIGINT) AS cid, CAST(p AS DOUBLE) AS percentile FROM r QUALIFY row_number() OVER (PARTITION BY cid ORDER BY err, p) = 1")
def qnt02(spark, d):
    return compression.best_percentile(_coeffs(spark, d), ["cid"], "a", [0.9, 0.95, 1.0], 4).select("cid", "percentile")


@query("qnt03_quantile", f"WITH {ENCODED} SELECT CAST(cid AS BIGINT) AS cid, round(quantile_cont(a0, 0.3), 6) AS v FROM e GROUP BY cid")
def qnt03(spark, d):
    return _coeffs(spark, d).groupBy("cid").agg(r6(F.percentile("a", 0.3)).alias("v"))


@query("qnt04_weighted_quantile", "WITH r AS (SELECT l_returnflag AS k, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS upto, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS al FROM lineitem) SELECT k, min(v) AS quantile FROM r WHERE upto >= 0.6 * al GROUP BY k")
def qnt04(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), "l_extendedprice", "l_quantity")
    return compression.weighted_quantile(rows, "k", "l_extendedprice", "l_quantity", 0.6)


@query("qnt05_scale", f"WITH {ENCODED}, {QUANTISED} SELECT CAST(cid AS BIGINT) AS cid, round(sum(a * q) / sum(q * q), 6) AS scale FROM qz GROUP BY cid")
def qnt05(spark, d):
    return compression.fitted_scale(compression.quantise(_coeffs(spark, d), ["cid"], "a", 0.95, 8), ["cid"], "a").select("cid", r6("scale").alias("scale"))


@query("qnt07_groups", f"WITH {ENCODED}, {FOREST}, cg AS (SELECT e.cid, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS grp, a0 AS a FROM e JOIN ct USING (vec_id)) SELECT CAST(cid AS BIGINT) AS cid, grp, count(*) AS n, round(quantile_cont(abs(a), 0.9) / 7, 6) AS step FROM cg GROUP BY cid, grp")
def qnt07(spark, d):
    rows = _coeffs(spark, d).join(_forest(spark, d).select("vec_id", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("grp")), "vec_id")
    return compression.quantise(rows, ["cid", "grp"], "a", 0.9, 4).groupBy("cid", "grp").agg(F.count(F.lit(1)).alias("n"), r6(F.first("step")).alias("step"))


@query("huf01_frequencies", f"WITH {ENCODED}, {QUANTISED} SELECT q, count(*) AS n FROM qz GROUP BY q")
def huf01(spark, d):
    return compression.quantise(_coeffs(spark, d), ["cid"], "a", 0.95, 8).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


FINE = QUANTISED.replace("127", "15")


@query("snk09_codec_store", f"WITH {ENCODED}, {FINE} SELECT CAST(cid AS BIGINT) AS cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY vec_id) - 1 AS BIGINT) AS nth, q FROM qz")
def huf03(spark, d):
    """Huffman streams by list, written, read back and decoded."""
    rows = compression.quantise(_coeffs(spark, d), ["cid"], "a", 0.95, 5).select("cid", F.lit(0).alias("grp"), F.lit(0).alias("layer"), "vec_id", "q")
    place = stores.scratch(spark, "codec")
    stores.write_codec(compression.compress_lists(rows), place, "overwrite")
    return stores.read_codec(spark, place).select("cid", "nth", "q")


@query("suc01_louds", f"WITH RECURSIVE {BASE}, {FOREST}, {NUMBERED}, kd AS (SELECT cid, parent_local AS local_id, count(*) AS k FROM nl GROUP BY ALL), al AS (SELECT cid, local_id FROM nl UNION ALL SELECT DISTINCT cid, 0 FROM nl) SELECT cid, string_agg(repeat('1', CAST(coalesce(k, 0) AS INT)) || '0', '' ORDER BY local_id) AS bits FROM al LEFT JOIN kd USING (cid, local_id) GROUP BY cid")
def suc01(spark, d):
    """The bits of each list's level-order tree."""
    return _trees(spark, d, lambda tree: [("".join(map(str, np.unpackbits(np.frombuffer(tree.bits, dtype=np.uint8))[: 2 * tree.n + 1])),)], "bits string")


def _trees(spark, d, rows_of, schema):
    """Rows cid and those that rows_of makes of each list's tree, after the tree went through its stored form."""
    import pyarrow as pa

    names = [f.split(" ")[0] for f in schema.split(", ")]

    def each(part: pa.Table) -> pa.Table:
        part = part.sort_by("local_id")
        tree = compression.Louds.deserialise(compression.Louds.build(part.column("parent_local").to_numpy()).serialise())
        rows = rows_of(tree)
        cid = part.column("cid")[0].as_py()
        kinds = [pa.string() if "string" in f else pa.int32() for f in schema.split(", ")]
        return pa.table({"cid": pa.array([cid] * len(rows), pa.int64()), **{n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds))}})

    return _numbered(spark, d).select("cid", "local_id", "parent_local").groupBy("cid").applyInArrow(each, f"cid long, {schema}")


LOCAL_PARENTS = f"WITH RECURSIVE {BASE}, {FOREST}, {NUMBERED} SELECT cid, local_id, parent_local FROM nl"


@query("suc02_parents", LOCAL_PARENTS)
def suc02(spark, d):
    """All parents of a tree from its bits at once."""
    return _trees(spark, d, lambda tree: list(enumerate(tree.parents().tolist(), 1)), "local_id int, parent_local int")


@query("suc03_random_access", LOCAL_PARENTS)
def suc03(spark, d):
    """Each node's parent by itself, from the stored bits and their index."""
    return _trees(spark, d, lambda tree: [(v, tree.parent(v)) for v in range(1, tree.n + 1)], "local_id int, parent_local int")


@query("nrm01_norms", f"WITH {ENCODED} SELECT vec_id, round(a0 * a0 * {ddot('c', 'c')} + 2 * a0 * a1 * {ddot('c', 'atom')} + a1 * a1 * {ddot('atom', 'atom')}, 6) AS norm FROM e")
def nrm01(spark, d):
    return normed(spark, d).select("vec_id", r6("norm").alias("norm"))


for _mode in ("lut", "lut_sqrt", "lut_log1p", "lut_tail_weighted", "lut_piecewise"):

    @query(f"nrm03_{_mode}", f"WITH {BASE} SELECT count(*) AS n, 0 AS farther, true AS codes_in_use FROM b")
    def nrm03(spark, d, mode=_mode):
        """Every norm has the code of its nearest center, and no row is left out of the fit."""
        norms = normed(spark, d).select("vec_id", "norm")
        values, counts = compression.value_histogram(norms, "norm")
        table = compression.norm_table(values, mode, 16, counts)[0]
        rows = compression.norm_codes(norms, table)
        known = F.array(*[F.lit(float(c)) for c in table])
        own = F.abs(F.element_at(known, F.col("norm_code") + 1) - F.col("norm"))
        best = F.array_min(F.transform(known, lambda c: F.abs(c - F.col("norm"))))
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((own > best + 1e-12).cast("long")).alias("farther"), F.countDistinct("norm_code").alias("used")).first()
        return holds(spark, n=got["n"], farther=got["farther"], codes_in_use=bool(int(counts.sum()) == got["n"] and 8 <= got["used"] <= 17))


# Metrics


FOUND = f"{TRUTH}, pd AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 12), vec_id) AS rank FROM q, rc QUALIFY rank <= 10)"


@query("met01_recall_curve", f"WITH {ENCODED}, {FOUND} SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN pd.rank <= k THEN 1.0 ELSE 0 END), 6) AS value FROM (SELECT * FROM gt WHERE rank = 1) gt CROSS JOIN (VALUES (1), (5), (10)) t(k) LEFT JOIN pd ON pd.qid = gt.qid AND pd.vec_id = gt.vec_id GROUP BY k")
def met01(spark, d):
    return metrics.recall_curve(_truth(spark, d), _short(spark, d, 10), [1, 5, 10]).select("k", r6("value").alias("value"))


@query("met02_top_recall", f"WITH {ENCODED}, {FOUND} SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN pd.rank <= k THEN 1.0 ELSE 0 END), 6) AS value FROM gt CROSS JOIN (VALUES (1), (5), (10)) t(k) LEFT JOIN pd ON pd.qid = gt.qid AND pd.vec_id = gt.vec_id GROUP BY k")
def met02(spark, d):
    return metrics.top_recall(_truth(spark, d), _short(spark, d, 10), 10, [1, 5, 10]).select("k", r6("value").alias("value"))


@query("met03_ndcg", f"WITH {ENCODED}, {FOUND} SELECT gt.qid, round(sum(CASE WHEN pd.rank <= 10 THEN 1 / log2(pd.rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r)), 6) AS ndcg FROM gt LEFT JOIN pd ON pd.qid = gt.qid AND pd.vec_id = gt.vec_id GROUP BY gt.qid")
def met03(spark, d):
    return metrics.ndcg(_truth(spark, d), _short(spark, d, 10), 10, 10).select("qid", r6("ndcg").alias("ndcg"))


@query("met05_grid", "SELECT * FROM (VALUES (4, 16), (4, 32), (8, 16), (8, 32)) t(nprobe, ef)")
def met05(spark, d):
    return spark.createDataFrame(metrics.plan_grid([4, 8, 4, -1], [16, 32], True), "nprobe int, ef int")


@query("flt05_valid_truth", f"WITH {BASE}, {TRUTH} SELECT qid, vec_id, rank FROM gt")
def flt05(spark, d):
    """Truth with rows of id -1 behind it and its members again at later ranks comes out clean."""
    truth = _truth(spark, d)
    dirty = topk.pad(truth, queries_of(spark, d), 14).select("qid", "rank", "vec_id").unionByName(truth.select("qid", (F.col("rank") + 20).alias("rank"), "vec_id"))
    return metrics.valid_truth(dirty).select("qid", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("jn02_compare_truths", f"WITH {ENCODED}, {FOUND} SELECT qid, count(*) FILTER (WHERE gt.vec_id = pd.vec_id) AS same_rank, (SELECT count(*) FROM gt g JOIN pd p ON g.qid = p.qid AND g.vec_id = p.vec_id WHERE g.qid = gt.qid) AS common, round((SELECT count(*) FROM gt g JOIN pd p ON g.qid = p.qid AND g.vec_id = p.vec_id WHERE g.qid = gt.qid) / 10.0, 6) AS overlap FROM gt JOIN pd USING (qid, rank) GROUP BY qid")
def jn02(spark, d):
    """The exact truth held against one from estimated distances."""
    got = metrics.compare_truths(_truth(spark, d), _short(spark, d, 10))
    return got.select("qid", "same_rank", "common", r6("overlap").alias("overlap"))


@query("flt04_real_only", f"WITH {CENTERS}, al AS (SELECT vec_id, x FROM b UNION ALL SELECT -1 - cid, c FROM c), rk AS (SELECT qid, vec_id, {dl2('q', 'x')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {dl2('q', 'x')}, vec_id) AS rank FROM q, al QUALIFY rank <= 40) SELECT qid, vec_id, round(dist, 6) AS dist FROM rk WHERE vec_id >= 0")
def flt04(spark, d):
    """A search over vectors and the lists' virtual centers, of which only real rows come out."""
    virtual_rows = centers(spark, d).select((-1 - F.col("cid")).cast("long").alias("vec_id"), F.col("c").alias("x"))
    found = search.exact_knn(base(spark, d).select("vec_id", "x").unionByName(virtual_rows), queries_of(spark, d), 40)
    return linkage.real_only(found).select("qid", "vec_id", r6("dist").alias("dist"))

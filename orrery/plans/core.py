"""Queries over scans, vector arithmetic, filters, and nearest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.functions.vectors import angle_degrees, cosine, dot, l2sq, norm2, normalise, scale
from orrery.operators import search, topk
from orrery.operators.sampling import bottom_k
from orrery.plans.catalog import BASE, CENTERS, ENCODED, atoms, base, centers, ddot, dl2, encodings, queries_of, query, sub, vectors


def r6(c):
    return F.round(c, 6)


@query("src07_block_scan", "SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 100 AND 199")
def src07(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id between 100 and 199").select("vec_id", "label")


@query("src08_gather", f"WITH {BASE} SELECT vec_id, round(x[1], 6) AS x0 FROM v WHERE vec_id IN (SELECT DISTINCT (l_orderkey * 7) % 400 FROM lineitem)")
def src08(spark, d):
    ids = spark.read.parquet(f"{d}/lineitem.parquet").select(((F.col("l_orderkey") * 7) % 400).alias("vec_id")).distinct()
    return vectors(spark, d).join(ids, "vec_id").select("vec_id", r6(F.col("x")[0]).alias("x0"))


def _truth(spark, d, k=10):
    return search.exact_knn(base(spark, d), queries_of(spark, d), k)


TRUTH = f"gt AS (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM (SELECT qid, vec_id, {dl2('q', 'x')} AS dist FROM q, b) QUALIFY rank <= 10)"


@query("src11_ground_truth", f"WITH {BASE}, {TRUTH} SELECT qid, rank, vec_id + 1 AS gt_id FROM gt WHERE rank <= 5")
def src11(spark, d):
    return _truth(spark, d, 5).select("qid", F.col("rank").cast("long").alias("rank"), (F.col("vec_id") + 1).alias("gt_id"))


@query("src12_bytes_to_float", "SELECT vec_id, list_sum([CAST(CAST(floor((CAST(e AS DOUBLE) + 1) * 127) AS INT) AS DOUBLE) for e in embedding]) AS total FROM embeddings")
def src12(spark, d):
    quantised = F.transform("x", lambda v: F.floor((v + 1) * 127).cast("int").cast("float"))
    return vectors(spark, d).select("vec_id", V.total(quantised.cast("array<double>")).alias("total"))


@query("src13_caps", "SELECT 'train' AS part, count(*) AS n FROM embeddings WHERE vec_id < 300 UNION ALL SELECT 'query', count(*) FROM embeddings WHERE vec_id < 20")
def src13(spark, d):
    parts = F.array(F.when(F.col("vec_id") < 300, F.lit("train")), F.when(F.col("vec_id") < 20, F.lit("query")))
    return vectors(spark, d).select(F.explode(parts).alias("part")).where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("src14_sample", "SELECT vec_id, label FROM embeddings ORDER BY (vec_id * 2654435761 + 12345) % 4294967296, vec_id LIMIT 64")
def src14(spark, d):
    return bottom_k(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label"), 64)


@query("src17_column_limit", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id < 250 GROUP BY label")
def src17(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id < 250").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("src18_residual_reader", f"WITH {ENCODED} SELECT vec_id, round({ddot(sub('x', 'xh'), sub('x', 'xh'))}, 6) AS rest FROM rc")
def src18(spark, d):
    return search.reconstructed(encodings(spark, d)).select("vec_id", r6(l2sq("x", "xh")).alias("rest"))


@query("snk03_list_offsets", "SELECT label AS cid, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY label) - count(*) AS BIGINT) AS start FROM embeddings GROUP BY label")
def snk03(spark, d):
    # The ids themselves lie in order in the store (snk05); a list is found by its start and length.
    lists = vectors(spark, d).groupBy("cid").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    return lists.withColumn("start", F.sum("n").over(Window.orderBy("cid")) - F.col("n"))


@query("snk04_list_read", "SELECT vec_id FROM embeddings WHERE label = 3")
def snk04(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").where("label = 3").select("vec_id")


@query("snk05_list_order", "SELECT vec_id, label AS cid, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings")
def snk05(spark, d):
    # The place is the list's offset plus the rank in the list, so that no sort gathers all rows.
    rows = vectors(spark, d).select("vec_id", "cid")
    starts = rows.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("cid")) - F.col("n"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id")) - 1)
    return ranked.join(F.broadcast(starts), "cid").select("vec_id", "cid", (F.col("start") + F.col("nth")).alias("place"))


@query("vec01_normalise", f"WITH {BASE} SELECT vec_id, round(list_sum([(2 * e) / sqrt(list_dot_product([2 * f for f in x], [2 * f for f in x])) for e in x]), 6) AS total FROM v")
def vec01(spark, d):
    return vectors(spark, d).select("vec_id", r6(V.total(normalise(scale("x", F.lit(2.0))))).alias("total"))


@query("vec02_norm2", f"WITH {BASE} SELECT vec_id, round({ddot('x', 'x')}, 6) AS n2 FROM v")
def vec02(spark, d):
    return vectors(spark, d).select("vec_id", r6(norm2("x")).alias("n2"))


@query("vec03_angles", f"WITH {CENTERS} SELECT vec_id, round({dl2('x', 'c')}, 6) AS l2, round({ddot('x', 'c')}, 6) AS ip, round(degrees(acos(least(1, greatest(-1, {ddot('x', 'c')} / sqrt({ddot('x', 'x')}) / sqrt({ddot('c', 'c')}))))), 6) AS angle FROM b JOIN c USING (cid)")
def vec03(spark, d):
    own = base(spark, d).join(centers(spark, d), "cid")
    return own.select("vec_id", r6(l2sq("x", "c")).alias("l2"), r6(dot("x", "c")).alias("ip"), r6(angle_degrees("x", "c")).alias("angle"))


@query("vec04_rotate", f"WITH {BASE} SELECT vec_id, round(x[64], 6) AS y0, round(-x[1], 6) AS y1, round({ddot('x', 'x')}, 6) AS n2 FROM v")
def vec04(spark, d):
    import numpy as np

    from orrery.operators.codebooks import rotate

    r = np.zeros((64, 64))
    r[0, 63], r[1, 0] = 1.0, -1.0
    r[np.arange(2, 64), np.arange(1, 63)] = 1.0
    return rotate(vectors(spark, d), r).select("vec_id", r6(F.col("x")[0]).alias("y0"), r6(F.col("x")[1]).alias("y1"), r6(norm2("x")).alias("n2"))


@query("vec05_query_tables", f"WITH {CENTERS} SELECT qid, cid, round({ddot('q', 'c')}, 6) AS t FROM q, c")
def vec05(spark, d):
    return queries_of(spark, d).crossJoin(F.broadcast(centers(spark, d))).select("qid", "cid", r6(dot("q", "c")).alias("t"))


@query("vec06_reconstruct", f"WITH {ENCODED} SELECT vec_id, round(xh[1], 6) AS y0, round(xh[64], 6) AS y63, round({ddot('xh', 'xh')}, 6) AS n2 FROM rc")
def vec06(spark, d):
    return search.reconstructed(encodings(spark, d)).select("vec_id", r6(F.col("xh")[0]).alias("y0"), r6(F.col("xh")[63]).alias("y63"), r6(norm2("xh")).alias("n2"))


@query("vec07_mse", f"WITH {ENCODED}, s AS (SELECT {dl2('x', 'xh')} AS se FROM rc) SELECT round(avg(se), 6) AS mean, round(min(se), 6) AS low, round(max(se), 6) AS high FROM s")
def vec07(spark, d):
    se = search.reconstructed(encodings(spark, d)).select(l2sq("x", "xh").alias("se"))
    return se.agg(r6(F.avg("se")).alias("mean"), r6(F.min("se")).alias("low"), r6(F.max("se")).alias("high"))


@query(
    "vec08_gram_cost",
    f"WITH {ENCODED} SELECT vec_id, round({ddot('x', 'x')} - 2 * (a0 * {ddot('x', 'c')} + a1 * {ddot('x', 'atom')}) + a0 * a0 * {ddot('c', 'c')} + 2 * a0 * a1 * {ddot('c', 'atom')} + a1 * a1 * {ddot('atom', 'atom')}, 6) AS cost FROM rc",
)
def vec08(spark, d):
    rec = search.reconstructed(encodings(spark, d))
    return rec.select("vec_id", r6(norm2("x") - 2 * dot("x", "xh") + norm2("xh")).alias("cost"))


def _codebook(spark, d):
    small = atoms(spark, d).select(F.lit(1).alias("layer"), F.col("code").cast("long").alias("code"), F.col("atom").alias("w"))
    return centers(spark, d).select(F.lit(0).alias("layer"), F.col("cid").cast("long").alias("code"), F.col("c").alias("w")).unionByName(small)


CODEBOOK = "cb AS (SELECT 0 AS layer, CAST(cid AS BIGINT) AS code, c AS w FROM c UNION ALL SELECT 1, CAST(code AS BIGINT), atom FROM atm)"


@query("vec09_gram", f"WITH {ENCODED}, {CODEBOOK} SELECT i.layer AS layer_i, i.code AS code_i, j.layer AS layer_j, j.code AS code_j, round({ddot('i.w', 'j.w')}, 6) AS g FROM cb i, cb j")
def vec09(spark, d):
    book = _codebook(spark, d)
    i, j = (book.select(*[F.col(c).alias(f"{c}_{k}") for c in book.columns]) for k in "ij")
    return i.crossJoin(F.broadcast(j)).select("layer_i", "code_i", "layer_j", "code_j", r6(dot("w_i", "w_j")).alias("g"))


@query("vec10_large_root", f"WITH {ENCODED} SELECT cid, code, round({ddot('c', 'atom')}, 6) AS g0s, round({ddot('c', 'c')}, 6) AS norm0 FROM c, atm")
def vec10(spark, d):
    both = centers(spark, d).crossJoin(F.broadcast(atoms(spark, d)))
    return both.select("cid", "code", r6(dot("c", "atom")).alias("g0s"), r6(norm2("c")).alias("norm0"))


@query("vec11_cross_gram", f"WITH {ENCODED} SELECT code, cid, round({ddot('atom', 'c')}, 6) AS g FROM atm, c")
def vec11(spark, d):
    return atoms(spark, d).crossJoin(F.broadcast(centers(spark, d))).select("code", "cid", r6(dot("atom", "c")).alias("g"))


@query("vec12_root_to_one", f"WITH {ENCODED} SELECT cid, code FROM c, atm QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round({ddot('c', 'atom')}, 9) DESC, code) = 1")
def vec12(spark, d):
    both = centers(spark, d).crossJoin(F.broadcast(atoms(spark, d))).withColumn("g", F.round(dot("c", "atom"), 9))
    return topk.top_k(both, "cid", [F.desc("g"), F.col("code")], 1).select("cid", "code")


@query("flt01_zero_codewords", f"WITH {ENCODED}, z AS (SELECT code, CASE WHEN code % 3 = 0 THEN [0 * e for e in atom] ELSE atom END AS atom FROM atm) SELECT code FROM z WHERE {ddot('atom', 'atom')} > 0")
def flt01(spark, d):
    zeroed = atoms(spark, d).withColumn("atom", F.when(F.col("code") % 3 == 0, scale("atom", F.lit(0.0))).otherwise(F.col("atom")))
    return zeroed.where(norm2("atom") > 0).select("code")


@query("jn01_exact_knn", f"WITH {BASE}, {TRUTH} SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM gt")
def jn01(spark, d):
    return _truth(spark, d).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", r6("dist").alias("dist"))


@query("jn01_exact_ip", f"WITH {BASE} SELECT qid, vec_id, round({ddot('q', 'x')}, 6) AS ip FROM q, b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {ddot('q', 'x')} DESC, vec_id) <= 5")
def jn01_ip(spark, d):
    return search.exact_knn(base(spark, d), queries_of(spark, d), 5, "ip").select("qid", "vec_id", r6(-F.col("dist")).alias("ip"))


@query("jn03_assign", f"WITH {CENTERS} SELECT vec_id, c.cid AS code, round({ddot('x', 'c')}, 6) AS dot FROM b, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {ddot('x', 'c')} DESC, c.cid) = 1")
def jn03(spark, d):
    return search.assign(base(spark, d), centers(spark, d)).select("vec_id", F.col("code").cast("int").alias("code"), r6("dot").alias("dot"))


@query(
    "jn04_assign_two_level",
    f"""WITH {CENTERS}, g AS (SELECT grp, list(m ORDER BY d) AS g FROM (SELECT cid // 4 AS grp, d, avg(c[d]) AS m FROM c, range(1, 65) t(d) GROUP BY 1, 2) GROUP BY grp),
p AS (SELECT vec_id, x, grp FROM b, g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {ddot('x', 'g')} DESC, grp) <= 2)
SELECT vec_id, c.cid AS code FROM p JOIN c ON c.cid // 4 = p.grp QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {ddot('x', 'c')} DESC, c.cid) = 1""",
)
def jn04(spark, d):
    return search.assign_two_level(base(spark, d), centers(spark, d), 4, 2).select("vec_id", F.col("code").cast("int").alias("code"))


PROBES = f"pr AS (SELECT qid, q, cid, {ddot('q', 'c')} / sqrt({ddot('c', 'c')}) AS score FROM q, c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {ddot('q', 'c')} / sqrt({ddot('c', 'c')}) DESC, cid) <= 3)"


@query("jn05_probe", f"WITH {CENTERS}, {PROBES} SELECT qid, cid, round(score, 6) AS score FROM pr")
def jn05(spark, d):
    return search.probe(queries_of(spark, d), centers(spark, d), 3).select("qid", "cid", r6("score").alias("score"))


@query(
    "jn06_probe_two_level",
    f"""WITH {CENTERS}, g AS (SELECT grp, list(m ORDER BY d) AS g FROM (SELECT cid // 4 AS grp, d, avg(c[d]) AS m FROM c, range(1, 65) t(d) GROUP BY 1, 2) GROUP BY grp),
p AS (SELECT qid, q, grp FROM q, g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {ddot('q', 'g')} DESC, grp) <= 2)
SELECT qid, cid FROM p JOIN c ON c.cid // 4 = p.grp QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {ddot('q', 'c')} / sqrt({ddot('c', 'c')}) DESC, cid) <= 3""",
)
def jn06(spark, d):
    c = centers(spark, d).withColumn("grp", F.floor(F.col("cid") / 4))
    groups = c.select("cid", "grp").join(V.mean_vectors(c, "grp", "c", "g"), "grp")
    return search.probe_two_level(queries_of(spark, d), centers(spark, d), groups, 2, 3).select("qid", "cid")


@query("jn07_probe_graph", f"WITH {CENTERS}, {PROBES} SELECT qid, CAST(cid AS BIGINT) AS cid, round(score, 6) AS score FROM pr")
def jn07(spark, d):
    # A walk that may hold as many centers as there are lists finds what scoring all of them finds; tests measure shorter ones.
    return search.probe_graph(queries_of(spark, d), centers(spark, d), 3, 3, 64).select("qid", "cid", r6("score").alias("score"))


NEIGHBOURS = f"nb AS (SELECT a.cid, a.vec_id, o.vec_id AS neighbour, {dl2('a.x', 'o.x')} AS dist2, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({dl2('a.x', 'o.x')}, 12), o.vec_id) AS rank FROM b a JOIN b o ON a.cid = o.cid AND a.vec_id <> o.vec_id)"


@query("jn08_list_knn", f"WITH {BASE}, {NEIGHBOURS} SELECT CAST(cid AS BIGINT) AS cid, vec_id, neighbour, rank, round(dist2, 6) AS dist2 FROM nb WHERE rank <= 4")
def jn08(spark, d):
    return search.in_list_knn(base(spark, d), 4).withColumn("dist2", r6("dist2")).withColumn("rank", F.col("rank").cast("long"))


def normed(spark, d):
    return search.reconstructed(encodings(spark, d)).withColumn("norm", norm2("xh"))


@query("jn09_adc_scan", f"WITH {ENCODED} SELECT qid, vec_id, round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 6) AS dist FROM q, rc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 12), vec_id) <= 5")
def jn09(spark, d):
    return search.adc_scan(normed(spark, d), queries_of(spark, d), centers(spark, d), atoms(spark, d), 5).select("qid", "vec_id", r6("dist").alias("dist"))


ADC_PROBED = f"""WITH {ENCODED}, {PROBES} SELECT pr.qid, vec_id, round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 6) AS dist FROM pr JOIN rc USING (cid)
QUALIFY row_number() OVER (PARTITION BY pr.qid ORDER BY round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 12), vec_id) <= 5"""


@query("jn10_adc_probed", ADC_PROBED)
def jn10(spark, d):
    c, q = centers(spark, d), queries_of(spark, d)
    return search.adc_scan(normed(spark, d), q, c, atoms(spark, d), 5, search.probe(q, c, 3)).select("qid", "vec_id", r6("dist").alias("dist"))


@query("jn11_adc_stored_lists", ADC_PROBED)
def jn11(spark, d):
    from orrery.sources.stores import read_encodings, scratch, write_encodings

    place = scratch(spark, "lists")
    write_encodings(normed(spark, d).select("vec_id", "cid", "code1", "a0", "a1", "norm"), place, "overwrite")
    c, q = centers(spark, d), queries_of(spark, d)
    return search.adc_scan(read_encodings(spark, place), q, c, atoms(spark, d), 5, search.probe(q, c, 3)).select("qid", "vec_id", r6("dist").alias("dist"))


@query(
    "jn17_rerank",
    f"""WITH {ENCODED}, s AS (SELECT qid, q, vec_id, x FROM q, rc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 12), vec_id) <= 30)
SELECT qid, vec_id, round({dl2('q', 'x')}, 6) AS dist FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {dl2('q', 'x')}, vec_id) <= 5""",
)
def jn17(spark, d):
    short = search.adc_scan(normed(spark, d), queries_of(spark, d), centers(spark, d), atoms(spark, d), 30)
    return search.rerank(short, base(spark, d), queries_of(spark, d), 5).select("qid", "vec_id", r6("dist").alias("dist"))


@query("top01_padded", f"WITH {BASE}, {TRUTH} SELECT qid, CAST(k AS BIGINT) AS rank, coalesce(vec_id, -1) AS vec_id FROM (SELECT qid, k FROM q, range(1, 13) t(k)) LEFT JOIN gt ON gt.qid = q.qid AND gt.rank = k".replace("(SELECT qid, k FROM q, range(1, 13) t(k)) LEFT JOIN gt ON gt.qid = q.qid AND gt.rank = k", "(SELECT qid, k FROM q, range(1, 13) t(k)) w LEFT JOIN gt USING (qid) WHERE false UNION ALL SELECT w.qid, w.k, coalesce(gt.vec_id, -1) FROM (SELECT qid, k FROM q, range(1, 13) t(k)) w LEFT JOIN gt ON gt.qid = w.qid AND gt.rank = w.k"))
def top01(spark, d):
    return topk.pad(_truth(spark, d), queries_of(spark, d), 12).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("top02_best_lists", f"WITH {CENTERS} SELECT qid, cid FROM q, c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {ddot('q', 'c')} DESC, cid) <= 4")
def top02(spark, d):
    rows = queries_of(spark, d).crossJoin(F.broadcast(centers(spark, d))).withColumn("s", dot("q", "c"))
    return topk.top_k(rows, "qid", [F.desc("s"), F.col("cid")], 4).select("qid", "cid")


@query("top03_coarse_groups", f"WITH {CENTERS} SELECT qid, cid FROM q, c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 2 * {ddot('q', 'c')} - {ddot('c', 'c')} DESC, cid) <= 2")
def top03(spark, d):
    rows = queries_of(spark, d).crossJoin(F.broadcast(centers(spark, d))).withColumn("s", 2 * dot("q", "c") - norm2("c"))
    return topk.top_k(rows, "qid", [F.desc("s"), F.col("cid")], 2).select("qid", "cid")


@query("top04_merge", f"WITH {BASE}, {TRUTH} SELECT qid, rank, vec_id FROM gt")
def top04(spark, d):
    parts = [search.exact_knn(base(spark, d).where(F.col("cid") % 3 == k), queries_of(spark, d), 10) for k in range(3)]
    return topk.merge_top_k(parts, 10).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("set02_overlap", f"WITH {ENCODED}, {TRUTH}, a AS (SELECT qid, vec_id FROM q, rc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({ddot('xh', 'xh')} - 2 * {ddot('q', 'xh')}, 12), vec_id) <= 10) SELECT qid, count(*) AS hits FROM gt JOIN a USING (qid, vec_id) GROUP BY qid")
def set02(spark, d):
    found = search.adc_scan(normed(spark, d), queries_of(spark, d), centers(spark, d), atoms(spark, d), 10)
    return _truth(spark, d).join(found.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))


@query("set03_first_seen", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL")
def set03(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id")
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("set04_pareto", "WITH r AS (SELECT l_linenumber AS run, sum(l_quantity) AS qps, round(avg(l_discount), 9) AS recall FROM lineitem GROUP BY 1) SELECT run, qps, recall FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.qps >= r.qps AND o.recall >= r.recall AND (o.qps > r.qps OR o.recall > r.recall))")
def set04(spark, d):
    runs = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("run")).agg(F.sum("l_quantity").alias("qps"), F.round(F.avg("l_discount"), 9).alias("recall"))
    return topk.pareto(runs)


@query("lnk01_root_cosine", f"WITH {CENTERS} SELECT vec_id, round({ddot('x', 'c')} / sqrt({ddot('x', 'x')}) / sqrt({ddot('c', 'c')}), 6) AS cos FROM b JOIN c USING (cid)")
def lnk01(spark, d):
    return base(spark, d).join(centers(spark, d), "cid").select("vec_id", r6(cosine("x", "c")).alias("cos"))

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.engine import Config
from orrery.operators import codebooks, compression, encoding, kmeans, linkage, metrics, search, topk, virtual
from orrery.sources import stores, vector_files

RNG = np.random.default_rng(3)


def table(spark, x, ids=None, **more):
    rows = [(int(i), [float(v) for v in r], *(int(c[k]) for c in more.values())) for k, (i, r) in enumerate(zip(range(len(x)) if ids is None else ids, x))]
    return spark.createDataFrame(rows, "vec_id long, x array<double>" + "".join(f", {c} long" for c in more))


def pairs(spark, rows, names="qid long, rank int, vec_id long"):
    return spark.createDataFrame(rows, names)


def ranked(spark, lists):
    return pairs(spark, [(q, r + 1, v) for q, ids in enumerate(lists) for r, v in enumerate(ids)])


@pytest.mark.parametrize("gt, pred, recall", [([10, 20, 30], [10, 20, 30], 1.0), ([10, 20, 30], [10, 99, 20], 2 / 3), ([10, 20, 30], [99, 98, 97], 0.0), ([10, 20, 30], [10, 10, 10], 1 / 3), ([10, 10, -1], [10, 99, 98], 1.0), ([-1, -1, -1], [1, 2, 3], 0.0)])
def test_metrics(spark, gt, pred, recall):
    g, p = ranked(spark, [gt]), ranked(spark, [pred])
    assert metrics.top_recall(g, p, 3, [3]).first()["value"] == pytest.approx(recall)
    ndcg = metrics.ndcg(g, p, 3, 3).first()["ndcg"]
    assert ndcg == pytest.approx(1.0) if recall == 1 else 0 <= ndcg < 1


def test_recall_curve_and_summaries(spark):
    curve = metrics.recall_curve(ranked(spark, [[10], [7]]), ranked(spark, [[10, 1], [3, 7]]), [1, 2])
    assert {r["k"]: r["value"] for r in curve.collect()} == {1: 0.5, 2: 1.0}
    assert metrics.summary("r@1", 0.5) == "r@1 50.00%" and metrics.summary("ndcg10@10", 0.5) == "ndcg10@10 0.5000"
    assert metrics.gt_sizes([0, 5, 99], 10) == [5] and metrics.gt_sizes([], 20) == [10] and metrics.gt_sizes([], 3) == [3]


def test_grid():
    assert metrics.plan_grid([4, 8], [16, 32], True) == [(4, 16), (4, 32), (8, 16), (8, 32)]
    assert metrics.plan_grid([4, 8], [16, 32], False) == [(4, 16), (8, 16)]
    assert metrics.coefficient_runs("both", True) == ["float", "int8"]


def test_exact_knn_and_ties(spark):
    x = RNG.normal(size=(60, 5))
    x[7] = x[3]
    q = x[[3, 20]]
    got = search.exact_knn(table(spark, x), table(spark, q).toDF("qid", "q"), 4).collect()
    for i in range(2):
        d = ((x - q[i]) ** 2).sum(1)
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == i] == sorted(range(60), key=lambda j: (round(d[j], 12), j))[:4]
    assert search.exact_knn(table(spark, x).where("false"), table(spark, q).toDF("qid", "q"), 4).count() == 0


def test_block_size_is_checked(spark):
    with pytest.raises(search.BlockTooLarge):
        search.matrix(table(spark, RNG.normal(size=(10, 4))), "vec_id", "x", most=100)


def test_more_queries_and_centers_than_a_block(spark, monkeypatch):
    base, q = table(spark, RNG.normal(size=(50, 4))), table(spark, RNG.normal(size=(40, 4))).toDF("qid", "q")
    c = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(RNG.normal(size=(30, 4)))], "cid long, c array<double>")
    whole, best = (sorted(map(tuple, df.collect())) for df in (search.exact_knn(base, q, 3), search.assign(base, c)))
    monkeypatch.setattr(search, "MOST_BLOCK_BYTES", 8 * 4 * 12)  # 12 vectors
    assert len(search.blocks(q, "qid", "q")) > 3
    assert sorted(map(tuple, search.exact_knn(base, q, 3).collect())) == whole
    got = sorted(map(tuple, search.assign(base, c).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in best]


def test_graph_probe(spark):
    centers, queries = RNG.normal(size=(400, 8)), RNG.normal(size=(60, 8))
    c = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(centers)], "cid long, c array<double>")
    q = table(spark, queries).toDF("qid", "q")
    exact = {(r["qid"], r["cid"]) for r in search.probe(q, c, 5).collect()}
    found = [{(r["qid"], r["cid"]) for r in search.probe_graph(q, c, 5, 8, ef).collect()} for ef in (8, 64, 400)]
    recalls = [len(f & exact) / len(exact) for f in found]
    assert recalls[2] == 1.0 and recalls[1] >= 0.95 and recalls[0] >= 0.6 and all(len(f) == 300 for f in found)
    assert search.probe_graph(q, c.where("false"), 5).count() == 0


def test_padding(spark):
    got = topk.pad(pairs(spark, [(0, 1, 5, 0.5)], "qid long, rank int, vec_id long, dist double"), pairs(spark, [(0,), (1,)], "qid long"), 2)
    assert sorted((r["qid"], r["rank"], r["vec_id"]) for r in got.collect()) == [(0, 1, 5), (0, 2, -1), (1, 1, -1), (1, 2, -1)]


def test_pareto(spark):
    runs = spark.createDataFrame([(1.0, 0.9), (2.0, 0.8), (0.5, 0.9), (2.0, 0.8)], "qps double, recall double")
    assert sorted((r["qps"], r["recall"]) for r in topk.pareto(runs).collect()) == [(1.0, 0.9), (2.0, 0.8), (2.0, 0.8)]


def test_codebook_costs_and_search():
    books = encoding.Codebooks([RNG.normal(size=(8, 12)) for _ in range(3)])
    x = RNG.normal(size=(40, 12))
    codes, coeffs = encoding.beam_search(books, x, 4)
    cost = books.cost(x, codes, coeffs)
    assert np.allclose(cost, ((x - books.reconstruct(codes, coeffs)) ** 2).sum(1))
    better, solved, new = encoding.iterated_local_search(books, x, np.arange(40), codes, 3, 2, 2, 5)
    assert (new <= cost + 1e-9).all()
    order = RNG.permutation(40)
    again = encoding.iterated_local_search(books, x[order], order, codes[order], 3, 2, 2, 5)[0]
    assert (again == better[order]).all()
    forced, _ = encoding.beam_search(books, x, 4, root=np.full(40, 2))
    assert (forced[:, 0] == 2).all()
    one, a = encoding.greedy_abs(books, x)
    assert (books.cost(x, one, a) <= (x * x).sum(1) + 1e-9).all()


def test_encoding_does_not_depend_on_partitions(spark):
    books = encoding.Codebooks([RNG.normal(size=(4, 6)) for _ in range(2)])
    rows = table(spark, RNG.normal(size=(50, 6)))
    a, b = (sorted(map(tuple, ((r["vec_id"], *r["codes"]) for r in encoding.encode(rows.repartition(n), books).collect()))) for n in (1, 5))
    assert a == b


def test_least_squares_updates_agree(spark):
    x, codes, a = RNG.normal(size=(80, 4)), np.stack([RNG.integers(0, 3, 80), RNG.integers(0, 3, 80)], 1), RNG.normal(size=(80, 2))
    rows = spark.createDataFrame([([float(v) for v in p], [int(v) for v in c], [float(v) for v in w]) for p, c, w in zip(x, codes, a)], "x array<double>, codes array<int>, coeffs array<double>")
    books = [RNG.normal(size=(3, 4)) for _ in range(2)]
    s = np.zeros((80, 6))
    np.put_along_axis(s, codes + [0, 3], a, 1)
    wanted = np.linalg.lstsq(s, x, rcond=None)[0]
    assert np.allclose(np.vstack(codebooks.update_codebooks(rows, books)), wanted, atol=1e-6)
    assert np.allclose(np.vstack(codebooks.update_root_by_elimination(rows, books)), wanted, atol=1e-6)


def test_rotation_is_orthogonal_and_best(spark):
    q, _ = np.linalg.qr(RNG.normal(size=(5, 5)))
    x = RNG.normal(size=(30, 5))
    rows = spark.createDataFrame([([float(v) for v in b], [float(v) for v in a]) for a, b in zip(x, x @ q.T)], "xh array<double>, x array<double>")
    assert np.allclose(codebooks.procrustes(codebooks.procrustes_moment(rows, 5)), q, atol=1e-6)


def test_kmeans(spark):
    x = np.vstack([RNG.normal(size=(30, 4)) * 0.05 + c for c in np.eye(4)[:3]])
    rows = table(spark, x)
    for start in (kmeans.init_plus_plus(rows, 3), kmeans.init_parallel(rows, 3)):
        model = kmeans.spherical_kmeans(rows, start, 10)
        assert np.allclose(np.linalg.norm(model.centers, axis=1), 1) and model.cost < 0.05
    empty = kmeans.spherical_kmeans(rows, np.vstack([np.eye(4)[:3], -np.ones((1, 4))]), 3)
    assert np.isfinite(empty.centers).all()


def test_sub_centers():
    centers, at = kmeans.euclidean_kmeans(np.array([[0.0], [2.0], [4.0], [100.0], [102.0], [104.0]]), 2, 8)
    assert sorted(centers.ravel()) == [2.0, 102.0] and len(set(at[:3])) == 1
    for code in range(12):  # whichever row the root code draws to start from
        centers, _ = kmeans.euclidean_kmeans(np.array([[0.0], [2.0], [4.0], [100.0], [102.0], [104.0]]), 2, 8, code)
        assert sorted(centers.ravel()) == [2.0, 102.0]
    equal, _ = kmeans.euclidean_kmeans(np.ones((5, 2)), 3, 4)
    assert len(equal) == 3


def test_scalar_kmeans_and_quantiles(spark):
    centers, codes = kmeans.scalar_kmeans(np.array([0.0, 0.1, 5.0, 5.1]), 2)
    assert np.allclose(centers, [0.05, 5.05]) and codes.tolist() == [0, 0, 1, 1]
    rows = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 3, 9, 7]], "v double")
    assert [kmeans.lower_quantile(rows, "v", q) for q in (0.0, 0.5, 0.99, 1.0)] == [1.0, 3.0, 7.0, 9.0]
    for mode in ("lut", "lut_sqrt", "lut_log1p", "lut_tail_weighted", "lut_piecewise"):
        values = RNG.gamma(2.0, size=500)
        c, k = compression.norm_table(values, mode, 32)
        assert len(c) <= 33 and np.abs(c[k] - values).mean() < 0.3


def points():
    return np.array([[i, (i * i) % 7] for i in range(9)], dtype=float)


@pytest.mark.parametrize("max_depth, seed", [(2, 1234), (3, 9)])
def test_reference_forests(max_depth, seed):
    x = points()
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for wanted in (np.argmin(d, 1), linkage.random_parent(np.arange(9), 9, seed)):
        assert (wanted != np.arange(9)).all()
        parent, depth, order = linkage.breadth_first(linkage.cut_cycles(wanted), max_depth)
        assert sorted(order) == list(range(9)) and depth.max() <= max_depth
        place = np.argsort(order)
        for i, p in enumerate(parent):
            assert (p < 0 and depth[i] == 0) or (depth[i] == depth[p] + 1 and place[p] < place[i])


def test_cycle_cut():
    assert linkage.cut_cycles(np.array([1, 2, 0, 2, 3])).tolist() == [-1, 2, 0, 2, 3]
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 30))
        parent = rng.integers(-1, n, n)
        wanted = parent.copy()
        for i in range(n):
            seen, at = [], i
            while at >= 0 and at not in seen:
                seen.append(at)
                at = int(parent[at])
            if at == i and i == min(seen):
                wanted[i] = -1
        assert linkage.cut_cycles(parent).tolist() == wanted.tolist()


@pytest.mark.parametrize("n", [2047, 2048, 2049])
def test_order_does_not_depend_on_the_size(n):
    parent = np.array([-1, -1, 1, 0, *[2] * (n - 4)])
    _, depth, order = linkage.breadth_first(parent, 5)
    assert order[:4].tolist() == [0, 1, 3, 2] and sorted(order) == list(range(n)) and (np.diff(depth[order]) >= 0).all()


@pytest.mark.parametrize("n", [65, 200])
def test_chains_of_any_depth(spark, n):
    rows = spark.createDataFrame([(i, 0, i - 1 if i else None) for i in range(n)], "vec_id long, cid int, parent long")
    assert {r["vec_id"]: (r["root"], r["depth"]) for r in linkage.depths(rows).collect()} == {i: (0, i) for i in range(n)}
    sums = linkage.sums_along_parents(rows.withColumn("y", F.array(F.lit(1.0))))
    assert {r["vec_id"]: r["y"] for r in sums.collect()} == {i: [i + 1.0] for i in range(n)}
    with pytest.raises(ValueError):
        linkage.depths(spark.createDataFrame([(0, 0, 1), (1, 0, 0)], "vec_id long, cid int, parent long"))


def test_subtree_sizes(spark):
    rows = spark.createDataFrame([(0, 0, None), (1, 0, 0), (2, 0, 0), (3, 0, 1), (4, 0, 3), (5, 0, None)], "vec_id long, cid int, parent long")
    assert {r["vec_id"]: r["size"] for r in linkage.subtree_sizes(rows).collect()} == {0: 5, 1: 3, 2: 1, 3: 2, 4: 1, 5: 1}


def test_samples_of_large_ids(spark):
    from orrery.operators.sampling import bottom_k

    ids = [4_000_000_000 + 7 * i for i in range(50)] + [2**62 + i for i in range(20)] + list(range(10))
    wanted = sorted(ids, key=lambda i: ((i * 2654435761 + 12345) % 2**32, i))[:9]
    assert [r[0] for r in bottom_k(spark.createDataFrame([(i,) for i in ids], "vec_id long"), 9).collect()] == wanted


def test_trees_with_an_index():
    rng = np.random.default_rng(8)
    parents = np.sort([0, 0, *[int(rng.integers(0, i)) for i in range(2, 3000)]])
    tree = compression.Louds.deserialise(compression.Louds.build(parents).serialise())
    assert tree.parents().tolist() == parents.tolist() == [tree.parent(v) for v in range(1, 3001)]
    with pytest.raises(ValueError):
        compression.Louds.deserialise(tree.serialise()[:-1])
    with pytest.raises(IndexError):
        tree.parent(3001)


def test_linkage_store(spark, tmp_path):
    rows = [(0, i + 1, 10 + i, p, d, [i], [i / 2], 0.1) for i, (p, d) in enumerate(zip([0, 0, 1, 2, 3, 4], [0, 0, 1, 1, 2, 2]))]
    rows += [(2, i + 1, 20 + i, p, d, [i], [i / 4], 0.2) for i, (p, d) in enumerate(zip([0, 0, 1, 3], [0, 0, 1, 2]))]
    stores.write_linkage(spark.createDataFrame(rows, linkage.FOREST).repartition(3), f"{tmp_path}/l")
    back = stores.read_linkage(spark, f"{tmp_path}/l")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert [r["vec_id"] for r in stores.read_linkage(spark, f"{tmp_path}/l", [2], (1, 1)).collect()] == [22]
    assert stores.read_linkage(spark, f"{tmp_path}/l", [1]).count() == 0 and stores.read_linkage(spark, f"{tmp_path}/l", [0], (7, 9)).count() == 0


def test_truths(spark):
    a, b = ranked(spark, [[1, 2, 3], [4, 5, 6]]), ranked(spark, [[1, 3, 9], [-1, 5, 5]])
    got = {r["qid"]: (r["same_rank"], r["common"], r["overlap"]) for r in metrics.compare_truths(a, b).collect()}
    assert got == {0: (1, 2, 2 / 3), 1: (1, 1, 1 / 3)}


def test_throughput():
    calls = []
    got = metrics.throughput(lambda: calls.append(1), 100, warm_up=2, repeats=3)
    assert len(calls) == 5 and got["median_qps"] > 0 and got["mean_qps"] > 0


@pytest.mark.parametrize("policy", ["structured", "nn_forest", "random_forest", "all_roots"])
def test_forest_reconstructs_within_its_error(spark, policy):
    x = RNG.normal(size=(40, 6))
    root, one = (encoding.Codebooks([RNG.normal(size=(4, 6)) for _ in range(2)]) for _ in range(2))
    forest = linkage.build_forest(table(spark, x, cid=np.arange(40) % 2), root, one, policy, 3).cache()
    rebuilt = {r["vec_id"]: r["xh"] for r in linkage.reconstruct_forest(forest, root, one).collect()}
    rows = forest.collect()
    assert len(rows) == 40 and all(r["depth"] <= 3 and r["parent_local"] < r["local_id"] for r in rows)
    for r in rows:
        assert ((x[r["vec_id"]] - rebuilt[r["vec_id"]]) ** 2).sum() == pytest.approx(r["error"], abs=1e-6)


def test_depths_by_doubling(spark):
    rows = spark.createDataFrame([(i, 0, None if i == 0 else i - 1) for i in range(20)], "vec_id long, cid int, parent long")
    assert {r["vec_id"]: r["depth"] for r in linkage.depths(rows).collect()} == {i: i for i in range(20)}
    cut = {r["vec_id"]: (r["parent"], r["depth"]) for r in linkage.cut_deep(rows, 2).collect()}
    assert cut[3] == (None, 0) and cut[5] == (4, 2)


@pytest.mark.parametrize("parents", [[0, 0, 1, 1, 2, 2, 3, 6], [0, 0, 1, 1, 2, 3, 5, 5], [0], []])
def test_trees(parents):
    p = np.array(parents, dtype=int)
    bits = compression.louds(p)
    assert compression.louds_parents(bits, len(p)).tolist() == parents
    assert [compression.louds_parent(bits, len(p), v) for v in range(1, len(p) + 1)] == parents


def test_huffman():
    for symbols in (np.array([3, 3, 3]), RNG.integers(-4, 5, 200), np.array([], dtype=int)):
        lengths, payload = compression.huffman_encode(symbols)
        assert compression.huffman_decode(lengths, payload, len(symbols)).tolist() == symbols.tolist()
    assert compression.huffman_lengths({1: 1, 2: 1, 3: 2}) == {1: 2, 2: 2, 3: 1}
    assert compression.levels(7) == 63 and compression.expand([1, 2], 4) == [1, 2, 2, 2] and compression.expand([1, 2, 3, 4], 2) == [1, 2]


def test_joint_scales_and_refinement():
    c = RNG.normal(size=(5, 3, 8))
    gram = np.einsum("nid,njd->nij", c, c)
    q = RNG.integers(-5, 6, (5, 3)).astype(float)
    scales = compression.joint_scales(q, q * [0.5, 0.25, 2.0], gram)
    assert np.allclose(scales, [0.5, 0.25, 2.0])
    a = RNG.normal(size=(5, 3))
    start = np.zeros((5, 3))
    refined = compression.refine_codes(start, a, gram, np.full(3, 0.1), 63, 5, 63)

    def error(z):
        return np.einsum("ni,nij,nj->", a - z * 0.1, gram, a - z * 0.1)

    assert error(refined) < error(start)


def test_virtual_scales():
    d = np.array([0.5, 1.0, 1.5, 2.0, 4.0, 8.0, 9.0, 10.0])
    rho, sigma = virtual.scales(d)
    assert rho == 0.5 and np.exp(-(d - rho) / sigma).sum() == pytest.approx(3.0, abs=1e-3)


@pytest.mark.parametrize("kind", ["bvecs", "fvecs", "fbin", "ivecs", "ibin"])
def test_vector_files(spark, tmp_path, kind):
    dtype, headed = vector_files.FORMATS[kind]
    x = RNG.integers(0, 200, (37, 5)).astype(dtype)
    path = tmp_path / f"a.{kind}"
    if headed:
        path.write_bytes(np.array(x.shape, "<i4").tobytes() + x.tobytes())
    else:
        path.write_bytes(b"".join(np.array([5], "<i4").tobytes() + r.tobytes() for r in x))
    got = {r["vec_id"]: r["x"] for r in vector_files.read_vectors(spark, str(path), split_bytes=100).collect()}
    assert [got[i] for i in range(37)] == x.astype(float).tolist()
    assert sorted(r["vec_id"] for r in vector_files.read_vectors(spark, str(path), start=30, count=20).collect()) == list(range(30, 37))
    with pytest.raises(ValueError):
        path.write_bytes(path.read_bytes()[:-1])
        vector_files.shape_of(str(path), kind)


def test_presets():
    assert vector_files.preset("SIFT1B", "/r", 3_000_000)["truth"] == "/r/bigann/bigann_gnd/idx_2M.ivecs"
    assert vector_files.preset("MSONG", "/r")["train"] == vector_files.preset("MSONG", "/r")["base"] == "/r/msong/msong_base.fvecs"
    assert vector_files.preset("own", "/r", base="b.fvecs", query="q.fvecs") == {"train": "b.fvecs", "base": "b.fvecs", "query": "q.fvecs"}
    for name, n in (("own", None), ("DEEP10M", 5)):
        with pytest.raises(ValueError):
            vector_files.preset(name, "/r", n)
    assert vector_files.subset_millions(10) == 1 and vector_files.subset_millions(999_000_000) == 500


def test_store_rules():
    same = stores.identity("lists", {"a": 1, "b": 2}, "p")
    assert same == stores.identity("lists", {"b": 2, "a": 1}, "p") != stores.identity("lists", {"a": 1, "b": 2}, "q")
    assert stores.decide(same, same).decision is stores.Decision.REUSE
    assert stores.decide("x", same).decision is stores.Decision.REBUILD and stores.decide("x", same, True).warning
    assert stores.decide(None, same).decision is stores.Decision.BUILD
    with pytest.raises(FileNotFoundError):
        stores.decide(None, same, True)


def test_config():
    a, b = Config.load("h0 = 32"), Config.load("sizes = 32,16")
    assert a.sizes == b.sizes and a.signature() == b.signature() and Config.load(a.dump()) == a
    assert Config.load("k = 5", ["k=7"]).k == 7
    for bad in ("h0_one = 300", "policy = none", "unknown = 1"):
        with pytest.raises((ValueError, KeyError)):
            Config.load(bad)


def test_calibration_and_weighted_quantile(spark):
    rows = spark.createDataFrame([(i % 2, float(i % 2), i < 150) for i in range(200)], "b int, e double, t boolean")
    assert {r["b"]: r["correction"] for r in metrics.calibrate(rows, "b", "e", "t", 50).collect()} == {0: 0.0, 1: 1.0}
    w = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 8.0), ("a", 3.0, 1.0)], "k string, v double, w double")
    assert compression.weighted_quantile(w, "k", "v", "w", 0.5).first()["quantile"] == 2.0
    g = spark.createDataFrame([("a", v) for v in (0, 0, 0, 4)], "k string, v int")
    assert metrics.gini(g, "k", "v").first()["gini"] == pytest.approx(0.75)


def test_quantiser(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (-2.0, -0.4, 0.0, 0.5, 9.0)], "cid int, a double")
    got = compression.quantise(rows, ["cid"], "a", 0.5, 3).orderBy("a").collect()
    assert [r["q"] for r in got] == [-3, -2, 0, 3, 3] and [r["clipped"] for r in got] == [True, False, False, False, True]
    assert compression.best_percentile(rows, ["cid"], "a", [0.5, 1.0], 8).first()["percentile"] == 1.0


def test_annealing(spark):
    rows = spark.createDataFrame([(0.9, 0.5), (0.1, 0.5), (0.1, 0.95)], "cost double, w double")
    assert sorted(r["w"] for r in kmeans.anneal(rows, 0.5, 0.4, 0.4).collect()) == [0.4, 0.6, 1.0]
    assert kmeans.annealing_factor(0.4, 1, 2, 5) == 0 < kmeans.annealing_factor(0.4, 4, 2, 5) < 0.4
    assert kmeans.histogram_quantile(rows, "cost", 0.5, 20).first()["threshold"] == pytest.approx(0.2)


def test_two_level_assignment_with_all_groups_is_exact(spark):
    rows, c = table(spark, RNG.normal(size=(30, 4))), table(spark, RNG.normal(size=(7, 4))).toDF("cid", "c")
    a, b = ({r["vec_id"]: r["code"] for r in t.collect()} for t in (search.assign(rows, c), search.assign_two_level(rows, c, 3, 3)))
    assert a == b


def test_radial_layers(spark):
    rows = spark.createDataFrame([(i, 0, 1.0 - i / 10) for i in range(10)], "vec_id long, cid int, cos double")
    got = {r["vec_id"]: r["layer"] for r in linkage.radial_layers(rows, 0.25, 4).select("vec_id", F.col("layer")).collect()}
    assert [got[i] for i in range(10)] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]


def calls(monkeypatch, *lists, policy, knn_k=8):
    """How often the codes of children are searched for while a list is linked, and what comes out."""
    made, search_codes = [], linkage.iterated_local_search
    monkeypatch.setattr(linkage, "iterated_local_search", lambda books, *rest, **more: made.append(books) or search_codes(books, *rest, **more))
    found = linkage.linked_list(*lists, policy, 4, knn_k, 1)
    return sum(b is lists[-1] for b in made), found


def small_books(rng, d=6):
    return [encoding.Codebooks([rng.normal(size=(4, d)), rng.normal(size=(3, d))]) for _ in range(2)]


@pytest.mark.parametrize("policy", ["nn_forest", "random_forest"])
def test_a_level_of_a_forest_is_one_call(monkeypatch, policy):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 6))
    n, (parent, depth, codes, coeffs, error) = calls(monkeypatch, np.arange(500), x, *small_books(rng), policy=policy)
    assert 0 < n <= 4 and (parent >= 0).any() and depth.max() <= 4


def test_scan_of_forests_pairs_no_rows(spark):
    """A scan holds all queries of a list against a batch of it at once; what comes out is what brute force finds, copies by id."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 6))
    x[60:] = x[30:60]
    root, one = small_books(rng)
    forest = stores.spooled(linkage.build_forest(table(spark, x, cid=np.arange(90) % 3), root, one, "nn_forest"), "forest")
    wanted_lists = {q: [q % 3, (q + 1) % 3] for q in range(9)}
    queries = spark.createDataFrame([(q, x[10 * q].tolist()) for q in range(9)], "qid long, q array<double>")
    probes = spark.createDataFrame([(q, c) for q, cs in wanted_lists.items() for c in cs], "qid long, cid int")
    found = linkage.linked_scan(forest, queries, probes, root, one, 7)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["dist"]))
    rebuilt = [(r["cid"], r["vec_id"], np.array(r["xh"])) for r in linkage.reconstruct_forest(forest, root, one).collect()]
    for q, lists in wanted_lists.items():
        # Sums as the scan has them, so that copies tie.
        near = sorted(((xh * xh).sum() - 2 * (x[10 * q] * xh).sum(), i) for c, i, xh in rebuilt if c in lists)[:7]
        assert [i for i, _ in got[q]] == [i for _, i in near] and [d for _, d in got[q]] == pytest.approx([d for d, _ in near])


def test_scan_of_forests_with_few_rows(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(5, 6))
    root, one = small_books(rng)
    forest = linkage.build_forest(table(spark, x, cid=[0, 0, 0, 1, 1]), root, one, "nn_forest")
    queries = spark.createDataFrame([(3, x[0].tolist()), (4, x[1].tolist())], "qid long, q array<double>")
    probes = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (4, 7)], "qid long, cid int")
    for some, n in ((queries, {3: 2, 4: 5}), (queries.limit(0), {})):
        got = linkage.linked_scan(forest, some, probes, root, one, 9).collect()
        assert {q: sum(r["qid"] == q for r in got) for q in {r["qid"] for r in got}} == n


def test_a_singular_system_leaves_other_rows_alone():
    books = encoding.Codebooks([np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[2.0, 0.0]])])
    x = np.array([[3.0, 5.0], [3.0, 5.0]])
    both = books.solve(x, np.array([[0, 0], [1, 0]]))
    assert both[1].tolist() == books.solve(x[1:], np.array([[1, 0]]))[0].tolist() == [2.5, 1.5]
    assert books.reconstruct(np.array([[0, 0]]), both[:1])[0].tolist() == pytest.approx([3.0, 0.0], abs=1e-4)


@pytest.mark.parametrize("kind, max_depth, knn_k, most", [("apart", 4, 8, 150), ("copies", 2, 3, 500), ("grid", 3, 4, 500)])
def test_structured_forests_in_waves(monkeypatch, kind, max_depth, knn_k, most):
    """Rows that don't wait for each other are linked in one call; parents are those of a walk row by row."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 6))
    x = {"apart": x, "copies": np.tile(x[:50], (10, 1)), "grid": np.round(x)}[kind]
    root, one = small_books(rng)
    made, search_codes = [], linkage.iterated_local_search
    monkeypatch.setattr(linkage, "iterated_local_search", lambda books, *rest, **more: made.append(books) or search_codes(books, *rest, **more))
    parent, depth, codes, coeffs, error = linkage.linked_list(np.arange(500), x, root, one, "structured", max_depth, knn_k, 1)
    assert sum(b is one for b in made) <= most
    cos = x @ x.mean(0) / np.linalg.norm(x, axis=1) / np.linalg.norm(x.mean(0))
    rebuilt = {}
    for i in np.lexsort((np.arange(500), -np.round(cos, 12))).tolist():
        open_ = [j for j in rebuilt if depth[j] < max_depth]
        trial = [j for _, _, j in sorted((round(float(((x[i] - x[j]) ** 2).sum()), 12), nth, j) for nth, j in enumerate(open_))][:knn_k]
        whole = search_codes(root, x[i : i + 1], np.array([i]), encoding.greedy_abs(root, x[i : i + 1])[0], 1, 2, 1, 1)[2][0]
        e = [search_codes(one, x[i : i + 1] - rebuilt[j], np.array([i]), encoding.greedy_abs(one, x[i : i + 1] - rebuilt[j])[0], 0, 1, 1, 1)[2][0] for j in trial]
        best = int(np.argmin(np.round(e, 12))) if e else -1
        wanted = trial[best] if e and e[best] + 1e-6 < whole else -1
        assert parent[i] == wanted and depth[i] == (depth[wanted] + 1 if wanted >= 0 else 0)
        rebuilt[i] = (one if wanted >= 0 else root).reconstruct(codes[i : i + 1], coeffs[i : i + 1])[0] + (rebuilt[wanted] if wanted >= 0 else 0.0)


def kept_tables(spark, monkeypatch, name):
    """The names of the tables that a query writes, and its row."""
    from orrery.registry import QUERIES

    kept, write = [], stores.spooled
    monkeypatch.setattr(stores, "spooled", lambda df, what, *more: kept.append(what) or write(df, what, *more))
    return kept, QUERIES[name](spark, "/root/testdata/sf0.001").first()


@pytest.mark.parametrize("name", ["jn12_linked_scan", "jn13_linked_scan_with_virtual_roots", "jn14_linked_scan_quantised"])
def test_linked_scans_run_once(spark, monkeypatch, name):
    kept, row = kept_tables(spark, monkeypatch, name)
    assert kept.count("found") == 1 and row["differing"] == 0


def test_a_wrong_scan_is_noticed(spark):
    """The check of linked scans counts ranks with another distance, ranks too many and ranks that are missing."""
    from orrery.plans import structure
    from orrery.plans.catalog import base, centers, queries_of

    d = "/root/testdata/sf0.001"
    root, one = structure._books(spark, d)
    forest = stores.spooled(linkage.quantised_forest(linkage.build_forest(base(spark, d), root, one, "nn_forest"), 8), "forest")
    probes = search.probe(queries_of(spark, d), centers(spark, d), 4)
    found = stores.spooled(linkage.linked_scan(forest, queries_of(spark, d), probes, root, one, 5), "found")
    off = (F.col("qid") == 50) & (F.col("rank") == 2)
    wrong = {0: found, 1: found.withColumn("dist", F.col("dist") + F.when(off, 1e-3).otherwise(0.0)), 4: found.where("qid <> 100 or rank = 1"), 10: found.withColumn("rank", F.when(F.col("qid") == 0, F.col("rank") + 5).otherwise(F.col("rank")))}
    for n, rows in wrong.items():
        assert structure._scan_agrees(spark, d, forest, probes, rows, root, one, 5) == n


def test_scan_of_stored_trees_runs_once(spark, monkeypatch):
    kept, row = kept_tables(spark, monkeypatch, "jn15_scan_of_stored_trees")
    assert kept.count("found") == 1 and row["found"] > 0 and row["differing"] == 0

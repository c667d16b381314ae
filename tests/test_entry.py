import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from orrery import engine, registry
from orrery.engine import Config, RunMode, run
from orrery.sources.stores import read_encodings, write_encodings
from orrery.streaming.ingest import build_remaining, encode_blocks, encode_stream, unfinished

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v.item() if hasattr(v, "item") else v)


def rows_of(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_against_sql(spark, sql, name):
    assert rows_of(registry.QUERIES[name](spark, DATA).toPandas()) == rows_of(sql.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_run(spark, tmp_path):
    queries = f"{tmp_path}/q.parquet"
    spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 10").write.parquet(queries)
    config = Config.load(f"base = {DATA}/embeddings.parquet\nquery = {queries}\nout = {tmp_path}/out\nsizes = 8,8\nh0_one = 8\npolicy = nn_forest\nnprobe = 2,8\nk = 10")
    full = run(spark, config)
    assert full.ok, full.error
    values = {(r["nprobe"], r["metric"], r["k"]): r["value"] for r in full.metrics.collect()}
    assert values[8, "r", 10] >= values[2, "r", 10] and values[8, "r", 10] > 0.5
    again = run(spark, config, RunMode.EVAL)
    assert again.ok and sorted(map(tuple, again.metrics.collect())) == sorted(map(tuple, full.metrics.collect()))
    for broken in (f"base = {DATA}/none.fvecs\nout = {tmp_path}/no", f"base = {DATA}/none.parquet\nout = {tmp_path}/no"):
        assert not run(spark, Config.load(broken), RunMode.TRAIN).ok
    assert "no store" in run(spark, Config.load(config.dump(), [f"out = {tmp_path}/empty"]), RunMode.EVAL).error


def test_stages_run_again_only_for_other_settings(spark, tmp_path, caplog):
    source = f"{tmp_path}/base.parquet"
    spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 60").write.parquet(source)
    config = Config.load(f"base = {source}\nquery = {source}\nout = {tmp_path}/out\nsizes = 4,4\nh0_one = 4\npolicy = all_roots\nnprobe = 2\nk = 5")
    made = []
    build, engine._build = engine._build, lambda *a, **k: made.append((a[2], build(*a, **k)))
    try:
        assert run(spark, config).ok
        assert run(spark, config).ok
        assert made == [("model", True), ("encodings", True), ("forest", True), ("model", False), ("encodings", False), ("forest", False)]
        made.clear()
        deeper = Config.load(config.dump(), ["max_depth = 2"])
        assert run(spark, deeper, RunMode.EVAL).ok and "other settings" in caplog.text  # an evaluation warns and goes on
        assert run(spark, deeper).ok
        assert made[-3:] == [("model", False), ("encodings", False), ("forest", True)]
    finally:
        engine._build = build
    grid = engine.run_grid(spark, config, {"nprobe": ["1", "2"], "k,seed": ["3;1"]}, RunMode.TRAIN)
    assert [r.ok for r in grid] == [True, True] and grid[0].config.out != grid[1].config.out and grid[0].config.k == 3


def test_streamed_encoding_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label")
    source, target = f"{tmp_path}/in", f"{tmp_path}/lists"
    seen = []

    def encode(df):
        return df.withColumnRenamed("label", "cid")

    for k in range(2):
        rows.where(f"vec_id % 2 = {k}").write.mode("append").parquet(source)
        encode_stream(spark, source, rows.schema, target, f"{tmp_path}/cp", encode, lambda n, b: seen.append((n, b.count()))).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).select("vec_id", "cid").collect())) == sorted(map(tuple, encode(rows).collect()))
    assert [n for n, _ in seen] == [0, 1]


def test_builds_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS vec_id", "id % 8 AS cid")
    assert build_remaining(rows.where("cid < 4"), f"{tmp_path}/b", lambda df: df, 4) == 1
    assert build_remaining(rows, f"{tmp_path}/b", lambda df: df, 4) == 1
    assert spark.read.parquet(f"{tmp_path}/b").count() == 40
    assert unfinished(rows, rows.where("cid <> 3")).collect()[0]["cid"] == 3


def test_stores(spark, tmp_path):
    rows = spark.range(30).selectExpr("id AS vec_id", "CAST(id % 3 AS INT) AS cid")
    write_encodings(rows, f"{tmp_path}/e")
    assert read_encodings(spark, f"{tmp_path}/e", [1]).count() == 10


def test_blocks_go_on_behind_the_last_commit(spark, tmp_path):
    rows, seen = spark.range(95).withColumnRenamed("id", "vec_id"), []

    def breaks(block):
        if seen and seen[-1] == 60:
            raise RuntimeError("lost")
        return block

    with pytest.raises(RuntimeError):
        encode_blocks(rows, f"{tmp_path}/b", 30, breaks, seen.append)
    assert encode_blocks(rows, f"{tmp_path}/b", 30, lambda b: b, seen.append) == 120
    assert seen == [30, 60, 90, 120] and spark.read.parquet(f"{tmp_path}/b").count() == 95
    assert encode_blocks(rows.where("false"), f"{tmp_path}/none", 30, lambda b: b) == 0

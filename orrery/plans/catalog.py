"""Queries by name, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.vectors import as_double, dot, mean_vectors, scale, subtract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Vectors whose ids this divides are the queries of all searches; all vectors are the base.
QUERY_STEP = 50
#: Atoms of the second layer: the vectors below this id.
N_ATOMS = 8


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", as_double("embedding").alias("x"), F.col("label").alias("cid"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir)


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("qid"), F.col("x").alias("q"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_vectors(base(spark, sf_dir), "cid", "x")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("vec_id") < N_ATOMS).select(F.col("vec_id").cast("int").alias("code"), F.col("x").alias("atom"))


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers: the center of the own list by projection, and greedily the best atom of the rest."""
    from orrery.operators.encoding import greedy_atom

    own = base(spark, sf_dir).join(centers(spark, sf_dir), "cid").withColumn("a0", dot("x", "c") / dot("c", "c"))
    own = own.withColumn("r", subtract("x", scale("c", F.col("a0"))))
    return greedy_atom(own, atoms(spark, sf_dir)).select("vec_id", "cid", "x", "c", "a0", "code1", "atom", "a1")


def holds(spark: SparkSession, **facts: bool | int) -> DataFrame:
    """One row of facts that have to come out as stated whatever the random choices."""
    values = [v.item() if hasattr(v, "item") else v for v in facts.values()]
    schema = ", ".join(f"{name} {'boolean' if isinstance(v, bool) else 'long'}" for name, v in zip(facts, values))
    return spark.createDataFrame([tuple(values)], schema)


def sub(a: str, b: str) -> str:
    return f"[{a}[i] - {b}[i] for i in range(1, 65)]"


def ddot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def dl2(a: str, b: str) -> str:
    return f"list_sum([({a}[i] - {b}[i]) ** 2 for i in range(1, 65)])"


BASE = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS cid FROM embeddings),
b AS (SELECT * FROM v),
q AS (SELECT vec_id AS qid, x AS q FROM v WHERE vec_id % {QUERY_STEP} = 0)"""
CENTERS = f"""{BASE},
c AS (SELECT cid, list(m ORDER BY d) AS c FROM (
  SELECT cid, d, avg(x[d]) AS m FROM b, range(1, 65) t(d) GROUP BY cid, d) GROUP BY cid)"""
ENCODED = f"""{CENTERS},
atm AS (SELECT CAST(vec_id AS INT) AS code, x AS atom FROM v WHERE vec_id < {N_ATOMS}),
e0 AS (SELECT vec_id, b.cid, x, c, {ddot('x', 'c')} / {ddot('c', 'c')} AS a0 FROM b JOIN c USING (cid)),
e1 AS (SELECT *, [x[i] - a0 * c[i] for i in range(1, 65)] AS r FROM e0),
e AS (SELECT vec_id, cid, x, c, a0, code AS code1, atom, {ddot('r', 'atom')} / {ddot('atom', 'atom')} AS a1 FROM e1, atm
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(abs({ddot('r', 'atom')}) / sqrt({ddot('atom', 'atom')}), 9) DESC, code) = 1),
rc AS (SELECT *, [a0 * c[i] + a1 * atom[i] for i in range(1, 65)] AS xh FROM e)"""

"""Count matrices and labels made from the star-schema tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import CountMatrix


ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when only the driver's path has it."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(":")
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, parts)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cust_part(spark: SparkSession, sf_dir: str, sparse: bool = False) -> CountMatrix:
    """Customers by parts, summed quantity; ``sparse`` keeps large returned lines only, so that cells and features are empty."""
    line = table(spark, sf_dir, "lineitem")
    if sparse:
        line = line.filter("l_returnflag = 'R' and l_quantity >= 45")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    coo = line.select("l_orderkey", "l_partkey", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").cast("long").alias("value"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("name"))
    features = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))
    return CountMatrix(coo, cells, features)


def cust_part_sparse(spark: SparkSession, sf_dir: str) -> CountMatrix:
    return cust_part(spark, sf_dir, True)


def supp_part(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Suppliers by parts, summed quantity."""
    coo = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").cast("long").alias("value"))
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("name"))
    features = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))
    return CountMatrix(coo, cells, features)


def user_event(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Users by kinds of event, counted; kinds are numbered by name."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    kinds = events.groupBy("event_type").agg(F.count("*").alias("n"))
    features = kinds.select(F.row_number().over(Window.orderBy("event_type")).cast("long").alias("feature_id"), F.col("event_type").alias("name"))
    coo = events.join(F.broadcast(features), F.col("event_type") == F.col("name")).groupBy(F.col("user_id").alias("cell_id"), "feature_id").agg(F.count("*").alias("value"))
    cells = events.select(F.col("user_id").alias("cell_id")).distinct().withColumn("name", F.col("cell_id").cast("string"))
    return CountMatrix(coo, cells, features)


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, label): market segments, numbered from 1 by name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    names = c.select("c_mktsegment").distinct().withColumn("label", F.row_number().over(Window.orderBy("c_mktsegment")))
    return c.join(F.broadcast(names), "c_mktsegment").select(F.col("c_custkey").alias("cell_id"), "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("vector"), (F.col("label") + 1).alias("label"))


def vector_matrix(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Vectors as a matrix of cells by dimensions (1-based)."""
    v = table(spark, sf_dir, "embeddings")
    coo = v.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("d", "x")).select("cell_id", (F.col("d") + 1).cast("long").alias("feature_id"), F.col("x").cast("double").alias("value"))
    cells = v.select(F.col("vec_id").alias("cell_id"), F.col("vec_id").cast("string").alias("name"))
    features = coo.select("feature_id").distinct().withColumn("name", F.concat(F.lit("dim-"), F.col("feature_id").cast("string")))
    return CountMatrix(coo, cells, features)


#: The same matrices in SQL, as common table expressions.
COO = """coo AS (SELECT o_custkey AS cell_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey{where} GROUP BY 1, 2),
cells AS (SELECT c_custkey AS cell_id, c_name AS name FROM customer),
features AS (SELECT p_partkey AS feature_id, p_name AS name FROM part),
labels AS (SELECT c_custkey AS cell_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS label FROM customer)"""
DENSE = COO.format(where="")
SPARSE = COO.format(where=" WHERE l_returnflag = 'R' AND l_quantity >= 45")
EVENTS = """features AS (SELECT row_number() OVER (ORDER BY event_type) AS feature_id, event_type AS name FROM (SELECT DISTINCT event_type FROM events)),
coo AS (SELECT user_id AS cell_id, feature_id, count(*) AS value FROM events JOIN features ON event_type = name GROUP BY 1, 2),
cells AS (SELECT DISTINCT user_id AS cell_id FROM events)"""
VECTORS = "v AS (SELECT vec_id AS cell_id, embedding AS e, label + 1 AS label FROM embeddings)"
VECTOR_COO = """coo AS (SELECT vec_id AS cell_id, i AS feature_id, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)),
cells AS (SELECT vec_id AS cell_id FROM embeddings), features AS (SELECT DISTINCT feature_id FROM coo)"""

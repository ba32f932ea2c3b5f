"""How the bundled tables stand in for the data model, and the same bindings as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Leading dimensions of the embeddings that serve as scalar features and points.
DIMS = [f"d{k}" for k in range(6)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered series: user parity is the system, the user the replica, the day the segment."""
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    second = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000), F.lit(86_400)).cast("double")
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 2).alias("system_id"), F.col("user_id").alias("replica_id"), F.col("ts").cast("date").cast("string").alias("segment_id"), order.alias("ord"), "event_id", "ts", "value", F.col("event_type").alias("state"), second.alias("second"))


SERIES = """series AS (
  SELECT 's' || CAST(user_id % 2 AS VARCHAR) AS system_id, user_id AS replica_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS segment_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_id, ts, value, event_type AS state,
         CAST(CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) % 86400 AS DOUBLE) AS second
  FROM events
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as doubles, with the leading dimensions as columns; segments are labels, replicas the id modulo four."""
    v = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", v.alias("v"), *[v[k].alias(c) for k, c in enumerate(DIMS)], F.concat(F.lit("s"), F.col("label") % 2).alias("system_id"), (F.col("vec_id") % 4).alias("replica_id"), F.col("label").cast("string").alias("segment_id"), F.col("vec_id").alias("ord"))


VECTORS = f"""vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate(DIMS))},
         's' || CAST(label % 2 AS VARCHAR) AS system_id, vec_id % 4 AS replica_id, CAST(label AS VARCHAR) AS segment_id, vec_id AS ord
  FROM embeddings
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames: status is the system, priority the replica. An order without lines is an empty frame."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("system_id"), F.col("o_orderpriority").alias("replica_id"), F.col("o_orderkey").alias("frame"))


#: Orders whose lines meet in one task.
FRAMES_PER_TASK = 100_000


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands present in orders. Lines get their brand first and then meet their order once, in as many tasks as the number of orders asks for."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    grid = frames(spark, sf_dir)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grid.count() // FRAMES_PER_TASK))
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("frame", "item").repartition(tasks, "frame")
    return grid.repartition(tasks, "frame").join(named, "frame").select("system_id", "replica_id", "frame", "item")


PRESENCE = """frames AS (SELECT o_orderstatus AS system_id, o_orderpriority AS replica_id, o_orderkey AS frame FROM orders
), presence AS (
  SELECT DISTINCT system_id, replica_id, frame, p_brand AS item
  FROM frames JOIN lineitem ON l_orderkey = frame JOIN part ON p_partkey = l_partkey
)"""

"""The data model: rows of ordered series, keyed by system, replica and segment, in the order ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ID = ["system_id", "replica_id", "segment_id"]
ORD = "ord"


def in_segment() -> WindowSpec:
    return W.partitionBy(*ID).orderBy(ORD)


def in_replica() -> WindowSpec:
    return W.partitionBy("system_id", "replica_id").orderBy(ORD)


def whole_replica() -> WindowSpec:
    return W.partitionBy("system_id", "replica_id")


def issues(df: DataFrame, code: str, broken: Column, location: Column, message: str, severity: str = "error") -> DataFrame:
    """A violation query: one row ``(severity, code, location, message)`` for each row that breaks a contract."""
    return df.where(broken).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), location.cast("string").alias("location"), F.lit(message).alias("message"))


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """Fails the query at the first row that breaks a contract."""
    return df.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def order_issues(df: DataFrame, axis: str) -> DataFrame:
    """Duplicate frames and axis values that don't increase inside a segment."""
    back = F.col(axis) <= F.lag(axis).over(in_segment())
    marked = df.withColumn("_back", back).withColumn("_n", F.count("*").over(W.partitionBy(*ID, ORD)))
    where = F.concat_ws("/", *[F.col(c).cast("string") for c in [*ID, ORD]])
    return issues(marked, "axis_not_increasing", F.col("_back"), where, f"{axis} does not increase").unionByName(issues(marked, "duplicate_frame", F.col("_n") > 1, where, "frame index is not unique"))


def held(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` worked out once, for plans that read it again and again: checkpointed to the shared folder where one is set, else persisted, and whether it is saved."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    saved = bool(context.getCheckpointDir())
    return df.checkpoint() if saved else df.persist(), saved


def bounded(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``df`` if no value of ``keys`` has more than ``most`` rows, else an error: for joins that pair the rows of one key. Counted where the rows lie."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} rows share one value of {keys}; at most {most} may be paired")
    return df

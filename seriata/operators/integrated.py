"""Comparison of conditions over several measures, without a composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise_differences(measures: DataFrame) -> DataFrame:
    """``measures(measure, system_id, value)`` to ``(measure, left_system, right_system, left_value, right_value, difference)`` for left < right."""
    left = measures.select("measure", F.col("system_id").alias("left_system"), F.col("value").alias("left_value"))
    right = measures.select("measure", F.col("system_id").alias("right_system"), F.col("value").alias("right_value"))
    return left.join(right, "measure").where("left_system < right_system").withColumn("difference", F.col("left_value") - F.col("right_value"))


def integrate(expected: DataFrame, differences: DataFrame) -> DataFrame:
    """Every expected ``(measure, left_system, right_system)`` with its difference and whether it is covered; a missing one stays, as NULL."""
    keys = ["measure", "left_system", "right_system"]
    out = expected.join(differences.select(*keys, "difference"), keys, "left")
    return out.select(*keys, "difference", F.col("difference").isNotNull().alias("covered"))


def coverage(integrated: DataFrame) -> DataFrame:
    return integrated.groupBy("left_system", "right_system").agg(F.count("*").alias("expected"), F.count_if("covered").alias("covered"))

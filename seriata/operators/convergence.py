"""Convergence diagnostics: intervals by effective sample size and summaries of diagnostics. They describe; none of them is a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import split_half, whole_effective_sample_size

ID = ["system_id", "replica_id"]


def mean_intervals(df: DataFrame, value: str, z: float = 1.96) -> DataFrame:
    """``(system_id, replica_id, n, mean, sample_sd, ess, standard_error, lower, upper)``: the mean of each replica with ``z`` standard errors around it,
    the sample SD over the root of the effective sample size. NULL errors where that size is undefined or not above one; a replica
    of fewer than two values is left out."""
    told = df.groupBy(*ID).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd"))
    both = whole_effective_sample_size(df, value).select(*ID, "n", "ess").join(told, ID).where("n >= 2")
    error = F.when(F.col("ess") > 1, F.col("sample_sd") / F.sqrt("ess"))
    return both.select(*ID, "n", "mean", "sample_sd", "ess", error.alias("standard_error"), (F.col("mean") - z * error).alias("lower"), (F.col("mean") + z * error).alias("upper"))


def diagnostics(df: DataFrame, values: list[str], ess_reference: float, split_reference: float) -> DataFrame:
    """``(metric, system_id, replica_id, ess, ess_relation, split_difference, split_relation)`` for each of ``values``: above, at, below the reference, or unavailable.

    The split difference is that of the halves' means over the replica's SD."""

    def relation(x: Column, reference: float) -> Column:
        return F.when(x.isNull() | F.isnan(x), "unavailable").when(x > reference, "above").when(x < reference, "below").otherwise("at")

    parts = []
    for value in values:
        ess = whole_effective_sample_size(df, value).select(*ID, "ess")
        sd = df.groupBy(*ID).agg(F.nullif(F.stddev_pop(value), F.lit(0.0)).alias("_sd"))
        halves = split_half(df, value).join(sd, ID).select(*ID, F.abs(F.col("difference") / F.col("_sd")).alias("split_difference"))
        parts.append(ess.join(halves, ID).select(F.lit(value).alias("metric"), *ID, "ess", relation(F.col("ess"), ess_reference).alias("ess_relation"), "split_difference", relation(F.col("split_difference"), split_reference).alias("split_relation")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def diagnostic_summary(rows: DataFrame) -> DataFrame:
    """Counts by relation, and least, median and largest effective sample size, over all series (both keys NULL), by metric and by system."""
    count = lambda kind, name: F.count_if(F.col(f"{kind}_relation") == name).alias(f"{kind}_{name}")
    sets = rows.groupingSets([[], [F.col("metric")], [F.col("system_id")]], "metric", "system_id")
    return sets.agg(
        F.count("*").alias("series"), F.count("ess").alias("ess_available"), *[count("ess", n) for n in ("above", "at", "below", "unavailable")], *[count("split", n) for n in ("above", "at", "below")],
        F.min("ess").alias("ess_least"), F.percentile("ess", 0.5).alias("ess_median"), F.max("ess").alias("ess_most"),
    )

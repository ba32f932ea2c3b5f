"""Frame selection: strides, budgets and identity-hash samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .model import ORD, whole_replica


def fixed_stride(df: DataFrame, stride: int) -> DataFrame:
    """Rows ``0, s, 2s, ..`` of each replica, ``floor(n / s)`` of them: a trailing partial interval gives none."""
    n = F.count("*").over(whole_replica())
    return df.withColumn("_n", n).where((F.col(ORD) % stride == 0) & (F.col(ORD) < F.floor(F.col("_n") / stride) * stride)).drop("_n")


def stride_for_budget(df: DataFrame, budget: int) -> DataFrame:
    """``(replicas, longest, stride, selected)``: the smallest stride whose ``floor(n / s)`` fits the budget in every replica."""
    sizes = df.groupBy("system_id", "replica_id").agg(F.count("*").alias("n"))
    told = sizes.agg(F.count("*").alias("replicas"), F.max("n").alias("longest"))
    # floor(n / s) <= b holds first at s = floor(n / (b + 1)) + 1
    chosen = told.select("replicas", "longest", F.greatest(F.lit(1), F.floor(F.col("longest") / (budget + 1)) + 1).cast("bigint").alias("stride"))
    return sizes.crossJoin(F.broadcast(chosen)).groupBy("replicas", "longest", "stride").agg(F.sum(F.floor(F.col("n") / F.col("stride"))).cast("bigint").alias("selected"))


def uniform_budget(df: DataFrame, budget: int) -> DataFrame:
    """``budget`` rows of each replica at ``floor(i (n - 1) / (budget - 1))``; one row at ``floor(n / 2)``; all rows of a shorter replica."""
    sizes = df.groupBy("system_id", "replica_id").agg(F.count("*").alias("_n"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.lit(budget), F.col("_n").cast("int")) - 1)).alias("_i")
    b = F.least(F.lit(budget), F.col("_n"))
    at = F.when(b == 1, F.floor(F.col("_n") / 2)).otherwise(F.floor(F.col("_i") * (F.col("_n") - 1) / F.nullif(b - 1, F.lit(0))))
    wanted = sizes.select("system_id", "replica_id", "_n", i).select("system_id", "replica_id", at.cast("bigint").alias(ORD))
    return df.join(wanted, ["system_id", "replica_id", ORD], "left_semi")


def identity_hash(identity: dict[str, str]) -> Column:
    """SHA-256 of a row's canonical JSON identity: names in order, no blanks, as ``manifests.signature`` of the same values. ``identity`` maps names to columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(identity[n]).alias(n) for n in sorted(identity)]), {"ignoreNullFields": "false"}), 256)


def identity_hash_sample(df: DataFrame, key: str, size: int, identity: dict[str, str] | None = None) -> DataFrame:
    """The ``size`` rows with the smallest SHA-256 of their identity (the key's text, unless ``identity`` names its parts): a top-k, so each task keeps ``size`` rows at most."""
    hashed = identity_hash(identity) if identity else F.sha2(F.col(key).cast("string"), 256)
    return df.withColumn("identity_hash", hashed).orderBy("identity_hash", key).limit(size)


def stride_fitting(frames: int, seconds_a_frame: float, budget_seconds: float, fixed_seconds: float = 0.0, bytes_a_frame: float = 0.0, budget_bytes: float | None = None) -> int:
    """The smallest stride at which ``floor(frames / stride)`` frames fit both budgets; an error if not even one does."""
    most = (budget_seconds - fixed_seconds) / seconds_a_frame if seconds_a_frame > 0 else frames
    if budget_bytes is not None and bytes_a_frame > 0:
        most = min(most, budget_bytes / bytes_a_frame)
    most = min(frames, math.floor(most))
    if most < 1:
        raise ValueError("not one frame fits the budget")
    return frames // (most + 1) + 1


def balanced_budget(df: DataFrame, groups: list[str], budget: int) -> DataFrame:
    """``df`` cut to the same number of rows in every group (say replica and member): the budget's share or the smallest group, at even positions by ``ord``.

    Positions are ``floor(i n / m)`` for i = 0 .. m - 1 of a group's n rows, so the first row is always in. The groups' sizes are added up where they lie.
    """
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    told = sizes.agg(F.count("*").alias("_groups"), F.min("_n").alias("_least"))
    share = told.select(F.least("_least", F.floor(F.lit(budget) / F.col("_groups"))).cast("bigint").alias("_m"))
    by = W.partitionBy(*groups)
    rows = df.withColumn("_k", F.row_number().over(by.orderBy(ORD)).cast("bigint") - 1).withColumn("_n", F.count("*").over(by)).crossJoin(F.broadcast(share))
    # k = floor(i n / m) for some i  <=>  i = ceil(k m / n) gives k back
    i = F.ceil(F.col("_k") * F.col("_m") / F.col("_n"))
    return rows.where((i < F.col("_m")) & (F.floor(i * F.col("_n") / F.col("_m")) == F.col("_k"))).drop("_k", "_n", "_m")


def stride_by_position(df: DataFrame, groups: list[str], order: list[str], stride: int) -> DataFrame:
    """Per group, the floor-stride rule on the row's position rather than its frame index."""
    numbered = df.withColumn("position", F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("bigint") - 1).withColumn("_n", F.count("*").over(W.partitionBy(*groups)))
    return numbered.where((F.col("position") % stride == 0) & (F.col("position") < F.floor(F.col("_n") / stride) * stride)).drop("_n")

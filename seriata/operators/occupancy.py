"""Sparse presence of items in frames. Denominators always come from the frame table: a frame without items is an observed zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .model import bounded


def occupancy(presence: DataFrame, frames: DataFrame, item: str) -> DataFrame:
    """Per system and item: share of all frames (pooled) next to the mean over replicas of their shares. An item counts once a frame.

    ``frames(system_id, replica_id, frame)``, ``presence(system_id, replica_id, frame, item)``. Replicas that never show the item count as zero.
    """
    sizes = frames.groupBy("system_id", "replica_id").agg(F.count("*").alias("frames"))
    systems = sizes.groupBy("system_id").agg(F.sum("frames").alias("all_frames"), F.count("*").alias("replicas"))
    seen = presence.select("system_id", "replica_id", "frame", item).distinct().groupBy("system_id", "replica_id", item).agg(F.count("*").alias("hits"))
    per = seen.join(sizes, ["system_id", "replica_id"]).groupBy("system_id", item).agg(F.sum("hits").alias("present_frames"), F.sum(F.col("hits") / F.col("frames")).alias("_share"))
    return per.join(F.broadcast(systems), "system_id").select(
        "system_id", item, "present_frames", "all_frames", ratio(F.col("present_frames"), F.col("all_frames")).alias("pooled_occupancy"), ratio(F.col("_share"), F.col("replicas")).alias("replica_mean_occupancy")
    )


def compare_occupancy(table: DataFrame, eligible: DataFrame, item: str, a: str, b: str, value: str = "pooled_occupancy") -> DataFrame:
    """Every item of the candidate universe in two systems: observed, never observed (zero) or absent (NULL), with their difference.

    ``eligible(system_id, item)`` says in which systems an item could occur at all.
    """
    universe = eligible.select(item).distinct()
    out = universe
    for k, system in (("a", a), ("b", b)):
        may = eligible.where(F.col("system_id") == system).select(item, F.lit(True).alias(f"_may_{k}"))
        got = table.where(F.col("system_id") == system).select(item, F.col(value).alias(f"_v_{k}"))
        out = out.join(may, item, "left").join(got, item, "left")
        can = F.coalesce(f"_may_{k}", F.lit(False))
        out = out.withColumn(f"occupancy_{k}", F.when(can, F.coalesce(f"_v_{k}", F.lit(0.0))))
        out = out.withColumn(f"status_{k}", F.when(~can, "absent").when(F.coalesce(f"_v_{k}", F.lit(0.0)) > 0, "observed").otherwise("never_observed"))
    return out.select(item, "status_a", "status_b", "occupancy_a", "occupancy_b", (F.col("occupancy_a") - F.col("occupancy_b")).alias("difference"))


def top_differences(compared: DataFrame, item: str, n: int) -> DataFrame:
    """The ``n`` largest absolute differences, NULLs last, ties by item."""
    return compared.orderBy(F.col("difference").isNull(), F.abs("difference").desc(), item).limit(n)


def canonical_names(df: DataFrame, rules: DataFrame, keys: list[str], target: str) -> DataFrame:
    """``df`` with ``target`` from the one rule whose non-NULL keys all match; the row's first key if none does.

    Two matching rules are an error. ``rules`` is a short list written by people; beyond 10,000 rules it is refused. Rules are joined by equality, once for
    each set of keys that some of them leave open, so no row is shuffled, gathered or compared with every rule.
    """
    open_ = [F.col(k).isNull().alias(k) for k in keys]
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 mapping rules")
    out, found = df, []
    for pattern in rules.select(*open_).distinct().collect():
        told = [k for k in keys if not pattern[k]]
        same = reduce(lambda a, b: a & b, [F.col(k).isNull() == F.lit(pattern[k]) for k in keys])
        i = len(found)
        mine = rules.where(same).groupBy(*told).agg(F.count("*").alias(f"_n{i}"), F.min(target).alias(f"_t{i}"))
        out = out.join(F.broadcast(mine), told, "left") if told else out.crossJoin(F.broadcast(mine))
        found.append(i)
    if not found:
        return df.withColumn(target, F.col(keys[0]).cast("string"))
    several = reduce(lambda a, b: a + b, [F.coalesce(f"_n{i}", F.lit(0)) for i in found]) > 1
    name = F.when(several, F.raise_error(F.lit("several mapping rules match one key"))).otherwise(F.coalesce(*[F.col(f"_t{i}") for i in found], F.col(keys[0]).cast("string")))
    return out.select(*df.columns, name.alias(target))


def pairwise_jaccard(df: DataFrame, key: str, item: str, most: int = 5000) -> DataFrame:
    """``(left, right, shared, distance)`` for keys that share an item, from counts: items are joined, sets are not gathered.

    Pairs that share nothing are at distance 1 by definition and not listed. An item of more than ``most`` keys is refused, as all pairs of them would meet.
    """
    rows = bounded(df.select(key, item).distinct(), [item], most)
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    left, right = rows.select(F.col(key).alias("left"), item), rows.select(F.col(key).alias("right"), item)
    shared = left.join(right, item).where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared"))
    l, r = sizes.select(F.col(key).alias("left"), F.col("size").alias("_l")), sizes.select(F.col(key).alias("right"), F.col("size").alias("_r"))
    out = shared.join(l, "left").join(r, "right")
    return out.select("left", "right", "shared", (1 - F.col("shared") / (F.col("_l") + F.col("_r") - F.col("shared"))).alias("distance"))

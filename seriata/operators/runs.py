"""Ordered analytics: residence runs, transitions, blocks, folds, top-k, autocorrelation, multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import ratio
from .model import ID, ORD, held, in_replica, in_segment, whole_replica
from .summaries import summary_columns


def residence_runs(df: DataFrame, state: str = "state") -> DataFrame:
    """Maximal stretches of one state inside a segment. The first run is left-censored, the last right-censored; complete is neither."""
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(in_segment())) & (F.row_number().over(in_segment()) > 1), 0).otherwise(1)
    marked = df.select(*ID, ORD, state, change.alias("_c")).withColumn("run_id", F.sum("_c").over(in_segment()).cast("bigint"))
    runs = marked.groupBy(*ID, "run_id", state).agg(F.count("*").alias("length"), F.min(ORD).alias("first_ord"))
    last = F.max("run_id").over(W.partitionBy(*ID))
    return runs.withColumn("left_censored", F.col("run_id") == 1).withColumn("right_censored", F.col("run_id") == last).withColumn("complete", ~F.col("left_censored") & ~F.col("right_censored"))


def run_summaries(runs: DataFrame, state: str = "state") -> DataFrame:
    """Length summaries per system and state over all runs and over complete runs."""
    scopes = F.explode(F.when(F.col("complete"), F.array(F.lit("all"), F.lit("complete"))).otherwise(F.array(F.lit("all")))).alias("scope")
    return runs.select("system_id", state, "length", scopes).groupBy("system_id", state, "scope").agg(*summary_columns(F.col("length")), F.max("length").alias("longest"))


def presence_islands(presence: DataFrame, frames: DataFrame, item: str) -> DataFrame:
    """Runs of frames that hold an item. Adjacency comes from the segment's frame grid, never from the presence rows;
    a run is censored where it touches the segment's first or last frame."""
    grid = frames.select(*ID, ORD, (F.row_number().over(in_segment()) - 1).cast("bigint").alias("_pos"), (F.count("*").over(W.partitionBy(*ID)) - 1).alias("_last"))
    seen = presence.select(*ID, ORD, item).distinct().join(grid, [*ID, ORD])
    island = F.col("_pos") - F.row_number().over(W.partitionBy(*ID, item).orderBy("_pos"))
    runs = seen.withColumn("_island", island).groupBy(*ID, item, "_island", "_last").agg(F.count("*").alias("length"), F.min("_pos").alias("start"), F.max("_pos").alias("end"))
    return runs.select(*ID, item, "start", "length", (F.col("start") == 0).alias("left_censored"), (F.col("end") == F.col("_last")).alias("right_censored"))


def lag_pairs(df: DataFrame, columns: list[str], lag: int) -> DataFrame:
    """Each row with its columns ``lag`` selected rows later in the same segment, as ``next_*``; rows without a partner go."""
    out = df.withColumns({f"next_{c}": F.lead(c, lag).over(in_segment()) for c in columns}).withColumn("_has", F.lead(F.lit(1), lag).over(in_segment()))
    return out.where("_has = 1").drop("_has")


def transition_matrix(df: DataFrame, state: str = "state", lag: int = 1) -> DataFrame:
    """``(from_state, to_state, transitions, probability)``: counts inside segments and their row-normalised share."""
    pairs = lag_pairs(df.where(F.col(state).isNotNull()), [state], lag)
    counts = pairs.groupBy(F.col(state).alias("from_state"), F.col(f"next_{state}").alias("to_state")).agg(F.count("*").alias("transitions"))
    return counts.withColumn("probability", ratio(F.col("transitions"), F.sum("transitions").over(W.partitionBy("from_state"))))


def block_means(df: DataFrame, value: str, size: int) -> DataFrame:
    """Means of fixed blocks of ``size`` rows per replica; a partial last block is left out."""
    rows = df.withColumn("block", F.floor((F.row_number().over(in_replica()) - 1) / size).cast("bigint"))
    return rows.groupBy("system_id", "replica_id", "block").agg(F.avg(value).alias("block_mean"), F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")


def equal_blocks(df: DataFrame, value: str, blocks: int) -> DataFrame:
    """Means of ``blocks`` nearly equal blocks per replica, larger blocks first."""
    return df.withColumn("block", F.ntile(blocks).over(in_replica()).cast("bigint")).groupBy("system_id", "replica_id", "block").agg(F.count("*").alias("n"), F.avg(value).alias("block_mean"))


def time_folds(df: DataFrame, columns: list[str], lag: int, folds: int) -> DataFrame:
    """Lag pairs with their time-block fold ``min(F - 1, floor(i F / count))`` within the segment."""
    pairs = lag_pairs(df, columns, lag)
    i = F.row_number().over(in_segment()) - 1
    return pairs.withColumn("fold", F.least(F.lit(folds - 1), F.floor(i * folds / F.count("*").over(W.partitionBy(*ID)))).cast("bigint"))


def split_half(df: DataFrame, value: str) -> DataFrame:
    """First-half minus second-half mean per replica, raw and over ``max(sd, |mean|, 1e-12)``; the midpoint is ``floor(n / 2)``."""
    rows = df.withColumn("_k", F.row_number().over(in_replica())).withColumn("_n", F.count("*").over(whole_replica()))
    half = F.col("_k") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy("system_id", "replica_id").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(F.when(half, F.col(value))).alias("first_half"), F.avg(F.when(~half, F.col(value))).alias("second_half"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("_sd")
    )
    gap = F.col("first_half") - F.col("second_half")
    return out.select("system_id", "replica_id", "n", "mean", "first_half", "second_half", gap.alias("difference"), (gap / F.greatest("_sd", F.abs("mean"), F.lit(1e-12))).alias("scaled_difference"))


def autocorrelation(df: DataFrame, value: str, max_lag: int) -> DataFrame:
    """``rho(lag)`` per replica: overlap-normalised covariance over the population variance; NULL beyond lag 0 for a constant series.

    One window pass carries the bounded lags; nothing is joined.
    """
    stats = {"_m": F.avg(value).over(whole_replica()), "_v": F.var_pop(value).over(whole_replica())}
    rows = df.withColumns(stats).withColumn("_d", F.col(value) - F.col("_m"))
    ahead = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.lead("_d", k).over(in_replica()).alias("later")) for k in range(max_lag + 1)])
    long = rows.select("system_id", "replica_id", "_v", "_d", ahead.alias("_a")).select("system_id", "replica_id", "_v", "_d", F.inline("_a")).where("later is not null")
    rho = F.avg(F.col("_d") * F.col("later")) / F.nullif(F.max("_v"), F.lit(0.0))
    return long.groupBy("system_id", "replica_id", "lag").agg(F.count("*").alias("pairs"), F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(rho).alias("rho"))


def effective_sample_size(rho: DataFrame) -> DataFrame:
    """``tau = max(1, 1 + 2 * initial positive rho)`` and ``ess = min(n, n / tau)`` per replica, of an ``autocorrelation`` table; NULL for a constant series."""
    w = W.partitionBy("system_id", "replica_id").orderBy("lag").rowsBetween(W.unboundedPreceding, W.currentRow)
    open_ = rho.where("lag > 0").withColumn("_open", F.min(F.when(F.col("rho") > 0, 1).otherwise(0)).over(w))
    sums = open_.groupBy("system_id", "replica_id").agg(F.sum(F.when(F.col("_open") == 1, F.col("rho")).otherwise(0.0)).alias("_s"), F.sum("_open").cast("bigint").alias("positive_lags"), F.count("rho").alias("_defined"))
    sizes = rho.where("lag = 0").select("system_id", "replica_id", F.col("pairs").alias("n"))
    tau = F.greatest(F.lit(1.0), 1 + 2 * F.col("_s"))
    ok = F.col("_defined") > 0
    return sizes.join(sums, ["system_id", "replica_id"]).select("system_id", "replica_id", "n", "positive_lags", F.when(ok, tau).alias("tau"), F.when(ok, F.least(F.col("n").cast("double"), F.col("n") / tau)).alias("ess"))


def whole_effective_sample_size(df: DataFrame, value: str, block: int = 12) -> DataFrame:
    """``effective_sample_size`` over all lags up to the first that isn't positive.

    Window passes give the first ``block`` lags. A replica that is positive at all of them goes whole to one task, where Fourier
    transforms give all its lags; missing values are left out of a lag's pairs there too.
    """
    ids = ["system_id", "replica_id"]
    short = effective_sample_size(autocorrelation(df, value, block))
    left = df.join(short.where(F.col("positive_lags") == block).select(*ids), ids, "left_semi").select(*ids, ORD, F.col(value).cast("double").alias("_value"))

    def all_lags(key, rows):
        import numpy as np
        import pandas as pd

        x = rows.sort_values(ORD)["_value"].to_numpy(float)
        there = ~np.isnan(x)
        n, size = int(there.sum()), 1 << (2 * len(x) - 1).bit_length()
        d = np.where(there, x - x[there].mean(), 0.0)
        power = lambda v: np.fft.irfft(np.abs(np.fft.rfft(v, size)) ** 2, size)[: len(x)]
        pairs = np.rint(power(there.astype(float)))
        rho = np.divide(power(d), pairs, out=np.zeros(len(x)), where=pairs > 0)[1:] / x[there].var()
        closed = np.flatnonzero(~(rho > 0))
        k = int(closed[0]) if len(closed) else len(rho)
        tau = max(1.0, 1 + 2 * float(rho[:k].sum()))
        return pd.DataFrame([(*key, k, tau, min(float(n), n / tau))], columns=[*ids, "_k", "_tau", "_ess"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = left.groupBy(*ids).applyInPandas(all_lags, ", ".join(f"{i} {types[i]}" for i in ids) + ", _k long, _tau double, _ess double")
    return short.join(long, ids, "left").select(*ids, "n", *[F.coalesce(a, b).alias(b) for a, b in (("_k", "positive_lags"), ("_tau", "tau"), ("_ess", "ess"))])


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group under a total order, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def benjamini_hochberg(df: DataFrame, family: str, p: str, key: str) -> DataFrame:
    """``q`` per family: the running minimum of ``p n / rank`` from the largest p down, 1 at most. Rows without p are left out.

    Rows are range-partitioned and ranked inside a partition, so that a large family is shared out; only one count and one minimum per family and partition meet.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.where(F.col(p).isNotNull()).repartitionByRange(parts, family, p, key)
    ranged, _ = held(ranged.withColumn("_part", F.spark_partition_id()))  # ranges are sampled, so they are fixed before they are read twice
    part = W.partitionBy(family, "_part")
    earlier = W.partitionBy("_f").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("_f").orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, -1)
    same = F.col(family).eqNullSafe(F.col("_f")) & (F.col("_part") == F.col("_p"))
    sizes = ranged.groupBy(F.col(family).alias("_f"), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    before = sizes.select("_f", "_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy("_f")).alias("_n"))
    inside = ranged.withColumn("_k", F.row_number().over(part.orderBy(p, key)).cast("bigint"))
    ranked = inside.join(before, same).withColumn("rank", F.col("_before") + F.col("_k")).withColumn("_v", F.col(p) * F.col("_n") / F.col("rank")).drop("_f", "_p", "_before", "_n")
    least = ranked.groupBy(F.col(family).alias("_f"), F.col("_part").alias("_p")).agg(F.min("_v").alias("_least"))
    least = least.select("_f", "_p", F.min("_least").over(later).alias("_later"))
    down = part.orderBy(F.col("_k").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    told = ranked.withColumn("_q", F.min("_v").over(down)).join(least, same)
    return told.select(*df.columns, "rank", F.least(F.lit(1.0), "_q", "_later").alias("q"))


def effect_percentile(df: DataFrame, family: str, effect: str) -> DataFrame:
    """Share of the family's effects that are at most this row's absolute effect, over rows that have one."""
    rows = df.where(F.col(effect).isNotNull())
    return rows.withColumn("percentile", F.cume_dist().over(W.partitionBy(family).orderBy(F.abs(F.col(effect)))))


def standardized_difference(df: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Mean of side 0 minus side 1 over the root of the mean of their two sample variances; NULL for fewer than two values or no variance."""
    s = [F.when(F.col(side) == k, F.col(value)) for k in (0, 1)]
    spread = F.sqrt((F.var_samp(s[0]) + F.var_samp(s[1])) / 2)
    return df.groupBy(*keys).agg(F.count(s[0]).alias("n0"), F.count(s[1]).alias("n1"), ((F.avg(s[0]) - F.avg(s[1])) / F.nullif(spread, F.lit(0.0))).alias("standardized_difference"))

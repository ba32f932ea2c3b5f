"""Mergeable summaries: moments, circular statistics, populations, contingency, partition agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import ratio, total, wrap_half


def summary_columns(x: Column) -> list[Column]:
    """Count, mean, sample SD and its standard error; NULL where too few values define them."""
    sd = F.stddev_samp(x)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(x))).alias("sem")]


def sample_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(*summary_columns(F.col(value)))


def rmsf(df: DataFrame, atom: str, replica: str, block: str, xyz: tuple[str, str, str]) -> DataFrame:
    """Root mean square fluctuation pooled, per replica and per block, in one pass over grouping sets (level: see ``grouping_id``)."""
    sets = df.groupingSets([[F.col(atom)], [F.col(atom), F.col(replica)], [F.col(atom), F.col(replica), F.col(block)]], atom, replica, block)
    return sets.agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.sqrt(total(F.var_pop(c) for c in xyz)).alias("rmsf"))


def rmsf_rollup(profile: DataFrame, atom: str) -> DataFrame:
    """Pooled value next to the summary of replica values: frame-pooled and replica-balanced stay separate estimators."""
    pooled = profile.where("level = 3").select(atom, F.col("rmsf").alias("pooled_rmsf"))
    return pooled.join(sample_summary(profile.where("level = 1"), [atom], "rmsf"), atom)


def circular_summary(df: DataFrame, keys: list[str], degrees: str) -> DataFrame:
    a = F.radians(degrees)
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    r = F.sqrt(s * s + c * c)
    mean = F.when(r > 1e-12, wrap_half(F.degrees(F.atan2(s, c)), 360.0))
    return df.groupBy(*keys).agg(F.count(degrees).alias("n"), mean.alias("circular_mean"), r.alias("resultant"), (1 - r).alias("circular_variance"))


def state_populations(df: DataFrame, state: str) -> DataFrame:
    """Counts on the full grid of groups and states, at system and at replica level; an unassigned row has a NULL state.

    ``fraction_of_all`` divides by all rows, ``fraction_of_assigned`` by those with a state, ``coverage`` is their ratio.
    """
    totals = df.groupingSets([[F.col("system_id")], [F.col("system_id"), F.col("replica_id")]], "system_id", "replica_id").agg(
        F.when(F.grouping("replica_id") == 1, "system").otherwise("replica").alias("level"), F.count("*").alias("total"), F.count(state).alias("assigned")
    )
    seen = df.where(F.col(state).isNotNull()).groupingSets([[F.col("system_id"), F.col(state)], [F.col("system_id"), F.col("replica_id"), F.col(state)]], "system_id", "replica_id", state).agg(
        F.when(F.grouping("replica_id") == 1, "system").otherwise("replica").alias("level"), F.count("*").alias("state_count")
    )
    grid = totals.crossJoin(F.broadcast(df.where(F.col(state).isNotNull()).select(state).distinct()))
    seen = seen.select(F.col("system_id").alias("s"), F.col("replica_id").alias("r"), F.col("level").alias("l"), F.col(state).alias("t"), "state_count")
    same = (F.col("system_id") == F.col("s")) & F.col("replica_id").eqNullSafe(F.col("r")) & (F.col("level") == F.col("l")) & (F.col(state) == F.col("t"))
    n = F.coalesce("state_count", F.lit(0)).cast("bigint")
    return grid.join(seen, same, "left").select(
        "system_id", "replica_id", "level", state, "total", "assigned", n.alias("state_count"),
        ratio(n, F.col("total")).alias("fraction_of_all"), ratio(n, F.col("assigned")).alias("fraction_of_assigned"), ratio(F.col("assigned"), F.col("total")).alias("coverage"),
    )


def population_differences(populations: DataFrame, state: str) -> DataFrame:
    """System-level fractions of each pair ``left < right`` of systems and their difference, state by state."""
    one = populations.where("level = 'system'").select("system_id", state, "fraction_of_all")
    left = one.select(F.col("system_id").alias("left_system"), state, F.col("fraction_of_all").alias("left_fraction"))
    right = one.select(F.col("system_id").alias("right_system"), state, F.col("fraction_of_all").alias("right_fraction"))
    return left.join(right, state).where("left_system < right_system").withColumn("difference", F.col("left_fraction") - F.col("right_fraction"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, rows, cols, chi2, cramers_v)`` of the contingency of two columns; NULL if either has one state only."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    na = joint.groupBy(a).agg(F.sum("n").alias("na"))
    nb = joint.groupBy(b).agg(F.sum("n").alias("nb"))
    # sum over seen cells: chi2 = N (sum n^2 / (na nb) - 1)
    told = joint.join(na, a).join(nb, b).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb").cast("double"))).alias("s"), F.count_distinct(a).alias("rows"), F.count_distinct(b).alias("cols"))
    chi2 = F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1))
    least = F.least("rows", "cols") - 1
    return told.select("n", "rows", "cols", chi2.alias("chi2"), F.sqrt(ratio(chi2, F.col("n") * least)).alias("cramers_v"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two partitions from their contingency table; 1 where the denominator is zero."""
    joint = df.groupBy(a, b).agg(F.count("*").alias("n"))

    def pairs(c: Column) -> Column:
        return c * (c - 1) / 2.0

    cells = joint.agg(F.sum(pairs(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    rows = joint.groupBy(a).agg(F.sum("n").alias("k")).agg(F.sum(pairs(F.col("k"))).alias("rows"))
    cols = joint.groupBy(b).agg(F.sum("n").alias("k")).agg(F.sum(pairs(F.col("k"))).alias("cols"))
    expected = F.col("rows") * F.col("cols") / F.nullif(pairs(F.col("n")), F.lit(0.0))
    index = ratio(F.col("cells") - expected, (F.col("rows") + F.col("cols")) / 2 - expected)
    return cells.crossJoin(rows).crossJoin(cols).select("n", F.coalesce(index, F.lit(1.0)).alias("adjusted_rand_index"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class (a zero denominator gives 0) with accuracy and macro-F1 over all classes."""
    long = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    by_truth = long.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    by_guess = long.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("guessed"))
    zero = F.lit(0).cast("bigint")
    both = by_truth.join(by_guess, "class", "full").select("class", F.coalesce("support", zero).alias("support"), F.coalesce("hits", zero).alias("hits"), F.coalesce("guessed", zero).alias("guessed"))
    precision, recall = F.coalesce(ratio(F.col("hits"), F.col("guessed")), F.lit(0.0)), F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    every = W.partitionBy()
    table = both.select("class", "support", "guessed", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    return table.withColumn("macro_f1", F.avg("f1").over(every)).withColumn("accuracy", ratio(F.sum("hits").over(every), F.sum("support").over(every)))


def code_populations(df: DataFrame, keys: list[str], code: str, codes: list[str]) -> DataFrame:
    """Fraction of rows with each code, one column per code of a fixed list."""
    return df.groupBy(*keys).agg(F.count("*").alias("frames"), *[ratio(F.count_if(F.col(code) == c), F.count("*")).alias(f"fraction_{c}") for c in codes])

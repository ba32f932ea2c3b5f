"""Histograms by declared rules in one and two dimensions, threshold states, and density landscapes with basins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import free_energy, ratio

#: Factors of the Scott and Freedman-Diaconis widths: 3.5 population SDs, two interquartile ranges.
SCOTT, FREEDMAN = 3.5, 2.0


def axis_bins(x: Column, rule: str, least: int, most: int, padding: float = 0.0, explicit: int = 10) -> list[Column]:
    """Aggregates ``lo, width, bins`` of one axis. A width rule without spread falls back to NULL bins, which no row matches."""
    n, span = F.count(x), F.max(x) - F.min(x)
    third = F.pow(n.cast("double"), F.lit(-1.0 / 3.0))
    widened = span * (1 + 2 * padding)
    raw = {
        "explicit": F.lit(float(explicit)),
        "rice": F.ceil(2.0 * F.pow(n.cast("double"), F.lit(1.0 / 3.0))).cast("double"),
        "scott": F.ceil(widened / F.nullif(SCOTT * F.stddev_pop(x) * third, F.lit(0.0))).cast("double"),
        "freedman_diaconis": F.ceil(widened / F.nullif(FREEDMAN * (F.percentile(x, 0.75) - F.percentile(x, 0.25)) * third, F.lit(0.0))).cast("double"),
    }[rule]
    bins = raw if rule == "explicit" else F.when(raw.isNotNull(), F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), raw)))
    lo = F.min(x) - padding * span
    return [lo.alias("lo"), (widened / bins).alias("width"), bins.cast("bigint").alias("bins")]


def bin_of(x: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Zero-based bin, clamped, so that the maximum falls in the last one; a constant axis has one occupied bin."""
    at = F.coalesce(F.floor((x - lo) / F.nullif(width, F.lit(0.0))), F.lit(0).cast("bigint"))
    return F.greatest(F.lit(0).cast("bigint"), F.least(bins - 1, at))


def histogram(df: DataFrame, value: str, rule: str, least: int = 5, most: int = 200, padding: float = 0.0, explicit: int = 10) -> DataFrame:
    """``(rule, bin, lower_edge, n, fraction)`` with 1-based bins, empty ones included. Two passes; one row of bounds is sent to the tasks."""
    rows = df.where(F.col(value).isNotNull())
    bounds = rows.agg(F.count(value).alias("total"), *axis_bins(F.col(value), rule, least, most, padding, explicit))
    counts = rows.crossJoin(F.broadcast(bounds)).groupBy(bin_of(F.col(value), F.col("lo"), F.col("width"), F.col("bins")).alias("b")).agg(F.count("*").alias("n"))
    grid = bounds.where("bins is not null").select("total", "lo", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("b"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return grid.join(F.broadcast(counts), "b", "left").select(F.lit(rule).alias("rule"), (F.col("b") + 1).alias("bin"), (F.col("lo") + F.col("b") * F.col("width")).alias("lower_edge"), n.alias("n"), ratio(n, F.col("total")).alias("fraction"))


def threshold_states(df: DataFrame, value: str, threshold: float, below: str = "low", above: str = "high", closed_below: bool = True) -> DataFrame:
    """``df`` with ``state``: a label for values up to the threshold and one for those beyond; NULL for no value."""
    low = F.col(value) <= threshold if closed_below else F.col(value) < threshold
    return df.withColumn("state", F.when(F.col(value).isNull(), F.lit(None).cast("string")).when(low, below).otherwise(above))


def landscape(df: DataFrame, x: str, y: str, rule: str = "rice", least: int = 4, most: int = 60, temperature: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """``(cells, rows)``: occupied cells ``(x_bin, y_bin, n, probability, free_energy)`` and the input rows with their cell."""
    ax = [c.alias(f"x_{k}") for c, k in zip(axis_bins(F.col(x), rule, least, most), ("lo", "width", "bins"), strict=True)]
    ay = [c.alias(f"y_{k}") for c, k in zip(axis_bins(F.col(y), rule, least, most), ("lo", "width", "bins"), strict=True)]
    bounds = df.agg(*ax, *ay)
    cell = [bin_of(F.col(c), F.col(f"{a}_lo"), F.col(f"{a}_width"), F.col(f"{a}_bins")).alias(f"{a}_bin") for c, a in ((x, "x"), (y, "y"))]
    rows = df.crossJoin(F.broadcast(bounds)).select(*df.columns, *cell)
    counts = rows.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    told = counts.agg(F.sum("n").alias("_all"), F.max("n").alias("_most"))
    cells = counts.crossJoin(F.broadcast(told)).select("x_bin", "y_bin", "n", ratio(F.col("n"), F.col("_all")).alias("probability"), free_energy(F.col("n"), F.col("_most"), temperature).alias("free_energy"))
    return cells, rows


def smoothed(cells: DataFrame, sigma: float, bins: int) -> DataFrame:
    """``surface`` by a Gaussian kernel along x, then y: truncated at four sigma, zero outside the grid, mass kept. The grid is bounded by ``bins`` an axis."""
    reach = int(4 * sigma + 0.5)
    offsets = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("d"), F.exp(F.lit(-0.5 * (k / sigma) ** 2)).alias("w")) for k in range(-reach, reach + 1)])).alias("o")
    out = cells.select("x_bin", "y_bin", F.col("n").cast("double").alias("surface"))
    for axis in ("x_bin", "y_bin"):
        spread = out.select(*[c for c in out.columns if c != axis], (F.col(axis)).alias("_a"), offsets)
        keep = [c for c in ("x_bin", "y_bin") if c != axis]
        out = spread.select(*keep, (F.col("_a") + F.col("o.d")).alias(axis), (F.col("surface") * F.col("o.w")).alias("s")).where(f"{axis} between 0 and {bins - 1}").groupBy("x_bin", "y_bin").agg(F.sum("s").alias("surface"))
    mass = out.agg(F.sum("surface").alias("_after")).crossJoin(cells.agg(F.sum("n").alias("_before")))
    return out.crossJoin(F.broadcast(mass)).select("x_bin", "y_bin", (F.col("surface") * F.col("_before") / F.col("_after")).alias("surface"))


def basins(cells: DataFrame, least_count: int = 1, surface: str = "n", jumps: int = 12) -> DataFrame:
    """Cells with ``basin_id``: each points to its densest eligible 8-neighbour or itself (ties by cell), and pointers are
    doubled until they rest, ``2 ** jumps`` steps at most. Basins are numbered by population, then root cell.

    The table has at most bins x bins rows, so its joins are small whatever the data.
    """
    ok = cells.where(F.col("n") >= least_count).select("x_bin", "y_bin", "n", F.col(surface).alias("_s"))
    near = ok.select("x_bin", "y_bin", F.explode(F.array(*[F.struct((F.col("x_bin") + dx).alias("x"), (F.col("y_bin") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("c"))
    other = ok.select(F.col("x_bin").alias("x"), F.col("y_bin").alias("y"), F.col("_s").alias("s"))
    best = near.select("x_bin", "y_bin", "c.x", "c.y").join(other, ["x", "y"]).groupBy("x_bin", "y_bin").agg(F.min(F.struct((-F.col("s")).alias("s"), "x", "y")).alias("b"))
    at = best.select("x_bin", "y_bin", F.col("b.x").alias("rx"), F.col("b.y").alias("ry"))
    for _ in range(jumps):
        hop = at.select(F.col("x_bin").alias("rx"), F.col("y_bin").alias("ry"), F.col("rx").alias("hx"), F.col("ry").alias("hy"))
        told = at.join(hop, ["rx", "ry"]).select("x_bin", "y_bin", "rx", "ry", "hx", "hy").collect()
        at = cells.sparkSession.createDataFrame([(r.x_bin, r.y_bin, r.hx, r.hy) for r in told], "x_bin long, y_bin long, rx long, ry long")
        if all(r.rx == r.hx and r.ry == r.hy for r in told):
            break
    rooted = ok.join(at, ["x_bin", "y_bin"])
    population = rooted.groupBy("rx", "ry").agg(F.sum("n").alias("population"))
    numbered = population.withColumn("basin_id", F.row_number().over(W.orderBy(F.col("population").desc(), "rx", "ry")).cast("bigint"))
    return rooted.join(numbered, ["rx", "ry"]).select("x_bin", "y_bin", "n", F.col("rx").alias("root_x"), F.col("ry").alias("root_y"), "basin_id", "population")

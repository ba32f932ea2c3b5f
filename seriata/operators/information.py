"""Information and lagged dependence: entropies, mutual information, transfer entropy, correlation, coskewness, propagators."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, total
from .runs import lag_pairs


def quantile_bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """``df`` with ``b_<column>``: right-sided position among the distinct interior linear quantiles. Equal quantiles merge, so fewer bins may exist."""
    shares = [k / bins for k in range(1, bins)]
    edges = df.agg(*[F.array_distinct(F.percentile(c, F.array(*map(F.lit, shares)))).alias(f"_e_{c}") for c in columns])

    def place(c: str) -> Column:
        return F.size(F.filter(f"_e_{c}", lambda e: e <= F.col(c))).cast("bigint")

    made = {f"b_{c}": place(c) for c in columns}
    return df.crossJoin(F.broadcast(edges)).withColumns(made).drop(*[f"_e_{c}" for c in columns])


def midpoint_bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """``quantile_bins``, but a column with at most ``bins`` distinct values is cut at the midpoints between them. A constant column is an error.

    Distinct values are gathered up to ``bins`` + 1 of them by a partial aggregate of each task's least ones; nothing else of a column leaves its task.
    """
    told = {}
    for c in columns:
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(bins + 1).collect()]
        if len(values) < 2:
            raise ValueError(f"{c} is constant")
        told[c] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] if len(values) <= bins else None
    few = {c: e for c, e in told.items() if e}
    out = quantile_bins(df, [c for c in columns if c not in few], bins) if len(few) < len(columns) else df
    place = {f"b_{c}": _position(c, e) for c, e in few.items()}
    return out.withColumns(place) if place else out


def _position(c: str, edges: list[float]) -> Column:
    return total(F.when(F.col(c) >= e, 1).otherwise(0) for e in edges).cast("bigint")


def _entropy(n: Column, all_: Column) -> Column:
    return -F.sum(n / all_ * F.log(n / all_))


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, mi, nmi, generalized_correlation)`` for all pairs of discrete columns, in nats.

    One pass counts every pair's joint states; marginals are sums of those few rows. NMI is NULL where an entropy is zero.
    """
    pairs = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations_with_replacement(columns, 2)]
    joint = df.select(F.inline(F.array(*pairs))).groupBy("i", "j", "x", "y").agg(F.count("*").alias("n"))
    px = joint.groupBy("i", "j", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("i", "j", "y").agg(F.sum("n").alias("ny"))
    tot = px.groupBy("i", "j").agg(F.sum("nx").alias("t"))
    hx = px.join(tot, ["i", "j"]).groupBy("i", "j").agg(_entropy(F.col("nx"), F.col("t")).alias("hx"))
    hy = py.join(tot, ["i", "j"]).groupBy("i", "j").agg(_entropy(F.col("ny"), F.col("t")).alias("hy"))
    cells = joint.join(px, ["i", "j", "x"]).join(py, ["i", "j", "y"]).join(tot, ["i", "j"])
    n, t = F.col("n").cast("double"), F.col("t")
    mi = cells.groupBy("i", "j").agg(F.greatest(F.lit(0.0), F.sum(n / t * F.log(n * t / (F.col("nx") * F.col("ny").cast("double"))))).alias("mi"))
    scale = F.sqrt(F.greatest(F.lit(0.0), F.col("hx") * F.col("hy")))
    nmi = F.when(scale > 1e-12, F.col("mi") / scale)
    return mi.join(hx, ["i", "j"]).join(hy, ["i", "j"]).select("i", "j", "mi", nmi.alias("nmi"), F.sqrt(1 - F.exp(-2 * F.col("mi"))).alias("generalized_correlation"))


def transfer_entropy(df: DataFrame, source: str, target: str, lag: int = 1) -> DataFrame:
    """``I(target[t + lag]; source[t] | target[t])`` in nats from four levels of counts over within-segment pairs."""
    pairs = lag_pairs(df, [target], lag).select(F.col(f"next_{target}").alias("z"), F.col(source).alias("x"), F.col(target).alias("y"))
    xyz = pairs.groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    xy, yz, y = xyz.groupBy("x", "y").agg(F.sum("n").alias("nxy")), xyz.groupBy("y", "z").agg(F.sum("n").alias("nyz")), xyz.groupBy("y").agg(F.sum("n").alias("ny"))
    rows = xyz.join(xy, ["x", "y"]).join(yz, ["y", "z"]).join(y, "y").crossJoin(xyz.agg(F.sum("n").alias("t")))
    term = F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("ny") / (F.col("nxy").cast("double") * F.col("nyz")))
    return rows.agg(F.sum("n").alias("pairs"), F.greatest(F.lit(0.0), F.sum(term)).alias("transfer_entropy")).select(F.lit(source).alias("source"), F.lit(target).alias("target"), "pairs", "transfer_entropy")


def lagged_correlation(df: DataFrame, columns: list[str], lag: int) -> DataFrame:
    """``(source, target, pairs, correlation)``: source at t against target at t + lag, centred on the pairs' own means; NULL below a scale of 1e-15."""
    pairs = lag_pairs(df, columns, lag)
    stats = pairs.agg(
        F.count("*").alias("pairs"),
        *[F.covar_pop(a, f"next_{b}").alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)],
        *[F.stddev_pop(a).alias(f"s_{i}") for i, a in enumerate(columns)], *[F.stddev_pop(f"next_{a}").alias(f"t_{i}") for i, a in enumerate(columns)],
    )
    scale = {(i, j): F.col(f"s_{i}") * F.col(f"t_{j}") for i in range(len(columns)) for j in range(len(columns))}
    out = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.when(scale[i, j] > 1e-15, F.col(f"c_{i}_{j}") / scale[i, j]).alias("correlation")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return stats.select("pairs", F.inline(F.array(*out))).select("source", "target", "pairs", "correlation")


def coskewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean product of three standardised columns for every unordered triple; NULL where a column is constant."""
    stats = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)])
    z = [F.when(F.col(f"s_{i}") > 1e-15, (F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}")) for i, c in enumerate(columns)]
    triples = list(combinations_with_replacement(range(len(columns)), 3))
    sums = df.crossJoin(F.broadcast(stats)).agg(*[F.avg(z[i] * z[j] * z[k]).alias(f"c_{i}_{j}_{k}") for i, j, k in triples])
    out = [F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.lit(columns[k]).alias("k"), F.col(f"c_{i}_{j}_{k}").alias("coskewness")) for i, j, k in triples]
    return sums.select(F.inline(F.array(*out)))


def displacement_propagator(df: DataFrame, atoms: dict[str, tuple[str, str, str]], lag: int) -> DataFrame:
    """``(atom_i, atom_j, pairs, propagator)``: mean dot product of two atoms' displacements over a lag, normalised by their mean squares."""
    columns = [c for xyz in atoms.values() for c in xyz]
    pairs, names = lag_pairs(df, columns, lag), list(atoms)
    d = {a: [F.col(c) - F.col(f"next_{c}") for c in xyz] for a, xyz in atoms.items()}
    pairs_of = [(a, b) for a in names for b in names]
    sums = pairs.agg(F.count("*").alias("pairs"), *[F.avg(total(x * y for x, y in zip(d[a], d[b], strict=True))).alias(f"p_{a}_{b}") for a, b in pairs_of])

    def norm(a: str, b: str) -> Column:
        return F.sqrt(F.col(f"p_{a}_{a}") * F.col(f"p_{b}_{b}"))

    out = [F.struct(F.lit(a).alias("atom_i"), F.lit(b).alias("atom_j"), F.when(norm(a, b) > 1e-15, F.col(f"p_{a}_{b}") / norm(a, b)).alias("propagator")) for a, b in pairs_of]
    return sums.select("pairs", F.inline(F.array(*out))).select("atom_i", "atom_j", "pairs", "propagator")


def covariance(df: DataFrame, columns: list[str], keys: list[str] | None = None, floor: float = 1e-15) -> DataFrame:
    """``(keys, i, j, covariance, correlation)`` for i <= j: population covariance and clipped correlation, NULL where a variance is at most ``floor``."""
    index = list(combinations_with_replacement(range(len(columns)), 2))
    sums = df.groupBy(*(keys or [])).agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in index])

    def r(i: int, j: int) -> Column:
        ok = (F.col(f"c_{i}_{i}") > floor) & (F.col(f"c_{j}_{j}") > floor)
        return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"c_{i}_{j}") / F.sqrt(F.col(f"c_{i}_{i}") * F.col(f"c_{j}_{j}")))))

    out = [F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"c_{i}_{j}").alias("covariance"), r(i, j).alias("correlation")) for i, j in index]
    return sums.select(*(keys or []), F.inline(F.array(*out)))


def cross_correlation_map(df: DataFrame, atoms: dict[str, tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """Dynamic cross-correlation of atoms: covariances summed over the axes, normalised, per group of ``keys``."""
    names = list(atoms)
    index = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.groupBy(*keys).agg(*[total(F.covar_pop(x, y) for x, y in zip(atoms[a], atoms[b], strict=True)).alias(f"c_{a}_{b}") for a, b in index])

    def r(a: str, b: str) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col(f"c_{a}_{b}"), F.sqrt(F.col(f"c_{a}_{a}") * F.col(f"c_{b}_{b}")))))

    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(a).alias("atom_i"), F.lit(b).alias("atom_j"), r(a, b).alias("correlation")) for a, b in index])))


def mixture_covariance(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Covariance of the mixture in which every group weighs the same: mean of the groups' covariances plus that of their means."""
    index = list(combinations_with_replacement(range(len(columns)), 2))
    per = df.groupBy(group).agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in index])
    out = per.agg(*[(F.avg(f"c_{i}_{j}") + F.covar_pop(f"m_{i}", f"m_{j}")).alias(f"x_{i}_{j}") for i, j in index])
    return out.select(F.inline(F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"x_{i}_{j}").alias("covariance")) for i, j in index])))

"""Principal and time-lagged components: sums over all rows in Spark, spectra of the small matrices on the driver, projection as expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import total
from .runs import lag_pairs

#: Widest feature vector whose covariance goes to the driver: 2000 x 2000 doubles are 32 MB.
MAX_WIDTH = 2000
#: Most products that a plan holds as expressions.
MAX_EXPRESSIONS = 400


@dataclass
class Components:
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  #: one component a row

    def project(self, columns: list[str]) -> list[Column]:
        """Scores as column expressions, centred by hand."""
        return [total((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, self.mean, v, strict=True)).alias(f"score_{k}") for k, v in enumerate(self.vectors, 1)]


def product_sums(df: DataFrame, columns: list[str], others: list[str] | None = None) -> DataFrame:
    """``(i, n, total, products)`` for each of ``columns``: rows, sum, and sums of its products with each of ``others`` (itself and its like without them).

    A task multiplies its Arrow batches block by block and hands on one row per column; these rows are added up per column, so nothing but
    tasks x width doubles meets in one place. Rows with a NULL or NaN are left out.
    """
    names = [*columns, *(others or [])]
    width, schema = len(columns), "i int, n long, total double, products array<double>"

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count, totals, sums = 0, np.zeros(width), np.zeros((width, len(others or columns)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if len(batch) else np.zeros((0, len(names)))
            x = x[~np.isnan(x).any(1)]
            left = x[:, :width]
            count, totals = count + len(x), totals + left.sum(0)
            sums += left.T @ (x[:, width:] if others else left)
        for lo in range(0, width, 64):
            at = range(lo, min(width, lo + 64))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([count] * len(at), pa.int64()), pa.array(totals[lo : lo + 64]), pa.array(list(sums[lo : lo + 64]), pa.list_(pa.float64()))], ["i", "n", "total", "products"])

    def added(table):
        import pyarrow as pa

        products = np.stack(table["products"].to_numpy()).sum(0)
        return pa.table({"i": table["i"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "total": [float(np.sum(table["total"].to_numpy()))], "products": pa.array([products], pa.list_(pa.float64()))})

    doubles = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    return doubles.mapInArrow(partial, schema).groupBy("i").applyInArrow(added, schema)


def _moments(df: DataFrame, columns: list[str], others: list[str] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and mean products of ``columns`` with ``others`` (symmetric without them).

    Narrow tables take one aggregate of expressions; from MAX_EXPRESSIONS products on, ``product_sums``.
    """
    if len(columns) > MAX_WIDTH:
        raise ValueError(f"more than {MAX_WIDTH} features")
    other = others or columns
    if len(columns) * len(other) > MAX_EXPRESSIONS:
        rows = sorted(product_sums(df, columns, others).collect())
        if not rows or not rows[0].n:
            raise ValueError("no rows")
        return rows[0].n, np.array([r.total / r.n for r in rows]), np.array([r.products for r in rows]) / rows[0].n
    index = list(combinations_with_replacement(range(len(columns)), 2)) if others is None else [(i, j) for i in range(len(columns)) for j in range(len(other))]
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.avg(F.col(columns[i]) * F.col(other[j])).alias(f"p_{i}_{j}") for i, j in index]).first()
    if not row.n:
        raise ValueError("no rows")
    out = np.zeros((len(columns), len(other)))
    for i, j in index:
        out[i, j] = row[f"p_{i}_{j}"]
        if others is None:
            out[j, i] = out[i, j]
    return row.n, np.array([row[f"m_{i}"] for i in range(len(columns))]), out


def wide_covariance(df: DataFrame, columns: list[str], floor: float = 1e-15) -> DataFrame:
    """``information.covariance`` without keys for many columns: ``(i, j, covariance, correlation)`` for i <= j, the pairs made and kept in Spark."""
    sums = product_sums(df, columns).select("i", "n", (F.col("total") / F.col("n")).alias("m"), "products")
    own = sums.select("i", "m", (F.get("products", F.col("i")) / F.col("n") - F.col("m") * F.col("m")).alias("v"))
    left = sums.join(F.broadcast(own.select("i", F.col("v").alias("vi"))), "i").select("i", "n", "m", "vi", F.posexplode("products").alias("j", "p")).where("i <= j")
    right = own.select(F.col("i").alias("j"), F.col("m").alias("mj"), F.col("v").alias("vj"))
    covariance = F.col("p") / F.col("n") - F.col("m") * F.col("mj")
    r = F.when((F.col("vi") > floor) & (F.col("vj") > floor), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), covariance / F.sqrt(F.col("vi") * F.col("vj")))))
    names = F.array(*[F.lit(c) for c in columns])
    return left.join(F.broadcast(right), "j").select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), covariance.alias("covariance"), r.alias("correlation"))


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Each row with its largest loading positive (the first of equals)."""
    pivot = np.abs(vectors).round(12).argmax(1)
    return vectors * np.where(vectors[np.arange(len(vectors)), pivot] < 0, -1.0, 1.0)[:, None]


def principal_components(df: DataFrame, columns: list[str], count: int) -> Components:
    """Largest eigenvectors of the population covariance."""
    _, mean, product = _moments(df, columns)
    values, vectors = np.linalg.eigh(product - np.outer(mean, mean))
    order = np.argsort(-values)[:count]
    return Components(mean, values[order], oriented(vectors[:, order].T))


def randomized_components(matrix: np.ndarray, count: int, oversample: int = 8, rounds: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenpairs of a wide symmetric matrix by a randomised range finder with power steps."""
    q = np.linalg.qr(matrix @ np.random.default_rng(seed).standard_normal((len(matrix), min(len(matrix), count + oversample))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(matrix @ q)[0]
    values, small = np.linalg.eigh(q.T @ matrix @ q)
    order = np.argsort(-values)[:count]
    return values[order], oriented((q @ small[:, order]).T)


def time_lagged_components(df: DataFrame, columns: list[str], lag: int, count: int, ridge: float = 1e-10, cutoff: float = 1e-10) -> Components:
    """Slowest linear modes: symmetrised lagged covariance, whitened by the instantaneous one; both about the mean of all pair ends."""
    pairs = lag_pairs(df, columns, lag)
    later = [f"next_{c}" for c in columns]
    _, m0, p0 = _moments(pairs, columns)
    _, m1, p1 = _moments(pairs, later)
    _, _, cross = _moments(pairs, columns, later)
    mean = (m0 + m1) / 2
    around = lambda p, a, b: p - np.outer(a, mean) - np.outer(mean, b) + np.outer(mean, mean)
    instant = (around(p0, m0, m0) + around(p1, m1, m1)) / 2
    lagged = around(cross, m0, m1)
    lagged = (lagged + lagged.T) / 2
    instant += ridge * np.trace(instant) / len(columns) * np.eye(len(columns))
    s, u = np.linalg.eigh(instant)
    white = u[:, s > cutoff * s[-1]] / np.sqrt(s[s > cutoff * s[-1]])
    values, small = np.linalg.eigh(white.T @ lagged @ white)
    order = np.argsort(-np.abs(values))[:count]
    return Components(mean, values[order], oriented((white @ small[:, order]).T))

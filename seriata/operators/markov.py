"""Markov models of state sequences: counts in Spark, spectra of the small count matrix on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runs import transition_matrix

#: Most states: a count matrix of this size is 32 MB.
MAX_STATES = 2000


def count_matrix(df: DataFrame, state: str = "state", lag: int = 1) -> tuple[list, np.ndarray]:
    rows = transition_matrix(df, state, lag).select("from_state", "to_state", "transitions").limit(MAX_STATES**2 + 1).collect()
    states = sorted({x for r in rows for x in (r.from_state, r.to_state)})
    if len(states) > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} states")
    at = {s: k for k, s in enumerate(states)}
    counts = np.zeros((len(states), len(states)))
    for r in rows:
        counts[at[r.from_state], at[r.to_state]] = r.transitions
    return states, counts


def connected(counts: np.ndarray) -> list[list[int]]:
    """Components of the undirected graph of observed transitions, by smallest member."""
    seen, out = set(), []
    for s in range(len(counts)):
        if s in seen:
            continue
        part, stack = set(), [s]
        while stack:
            v = stack.pop()
            if v not in part:
                part.add(v)
                stack += [int(w) for w in np.flatnonzero(counts[v] + counts[:, v]) if w not in part]
        seen |= part
        out.append(sorted(part))
    return out


def reversible(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and stationary distribution of the symmetrised counts."""
    both = counts + counts.T
    rows = both.sum(1)
    return both / np.where(rows > 0, rows, 1)[:, None], rows / max(1.0, rows.sum())


def maximum_likelihood(counts: np.ndarray, rounds: int = 10_000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The reversible matrix of greatest likelihood, by fixed-point steps on the symmetric flow."""
    both, rows = counts + counts.T, counts.sum(1)
    flow = both / both.sum()
    for _ in range(rounds):
        pi = flow.sum(1)
        share = np.divide(rows, pi, out=np.zeros_like(pi), where=pi > 0)
        denominator = share[:, None] + share[None, :]
        new = np.divide(both, denominator, out=np.zeros_like(both), where=denominator > 0)
        new /= new.sum()
        if np.abs(new - flow).max() <= tolerance:
            flow = new
            break
        flow = new
    pi = flow.sum(1)
    return np.divide(flow, pi[:, None], out=np.zeros_like(flow), where=pi[:, None] > 0), pi


def implied_timescales(transition: np.ndarray, stationary: np.ndarray, lag: int) -> list[float | None]:
    """``-lag / ln(lambda)`` of the eigenvalues below the first, None where it is not positive."""
    root = np.sqrt(np.where(stationary > 0, stationary, 1))
    values = np.linalg.eigvalsh((root[:, None] * transition / root[None, :] + (root[:, None] * transition / root[None, :]).T) / 2)[::-1]
    return [float(-lag / np.log(v)) if 0 < v < 1 else None for v in values[1:]]


def chapman_kolmogorov(transition: np.ndarray, direct: np.ndarray, power: int) -> float:
    """Root mean square difference of the matrix's power and the one counted at the longer lag."""
    return float(np.sqrt(np.mean((np.linalg.matrix_power(transition, power) - direct) ** 2)))


def vamp2(train: np.ndarray, test: np.ndarray) -> float:
    """Cross-validated VAMP-2 score of indicator features: the model fitted on ``train`` counts, scored on ``test`` counts."""

    def parts(c: np.ndarray):
        p = c / c.sum()
        return p, np.diag(1 / np.sqrt(np.maximum(p.sum(1), 1e-12))), np.diag(1 / np.sqrt(np.maximum(p.sum(0), 1e-12)))

    p, a, b = parts(train)
    u, s, v = np.linalg.svd(a @ p @ b)
    left, right = a @ u, b @ v.T
    q = test / test.sum()
    joint, c0, c1 = left.T @ q @ right, left.T @ np.diag(q.sum(1)) @ left, right.T @ np.diag(q.sum(0)) @ right
    inner = np.linalg.pinv(c0) @ joint @ np.linalg.pinv(c1) @ joint.T
    return float(np.trace(inner))


def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint share of pairs, and the diagonal covariances of indicator features at both ends."""
    share = counts / counts.sum()
    return share, np.diag(share.sum(1)), np.diag(share.sum(0))


def vamp_fold(train: np.ndarray, test: np.ndarray, regularization: float = 1e-10) -> tuple[float, float]:
    """``(training VAMP-2, held-out VAMP-E)`` of a model of indicator features fitted on ``train`` counts and scored on ``test`` counts."""
    cross, left, right = _parts(train)
    white = lambda c: np.diag(1 / np.sqrt(np.diag(c) + regularization))
    u, s, v = np.linalg.svd(white(left) @ cross @ white(right))
    f, g = white(left) @ u, white(right) @ v.T
    cross, left, right = _parts(test)
    inner = 2 * s * np.einsum("ik,ij,jk->k", f, cross, g)
    metric = (s[:, None] * (f.T @ left @ f) * s[None, :]) * (g.T @ right @ g).T
    return float((s * s).sum()), float(inner.sum() - metric.sum())


def timescale_stability(timescales: dict[int, list[float | None]], most: float = 0.2) -> dict:
    """Spread of each mode's implied timescale over lags, by its median; ``passes`` if every mode known at two lags or more stays within ``most``."""
    modes = []
    for mode in range(max(map(len, timescales.values()), default=0)):
        known = [t[mode] for _, t in sorted(timescales.items()) if mode < len(t) and t[mode] is not None]
        if len(known) > 1:
            middle = float(np.median(known))
            spread = (max(known) - min(known)) / middle if middle > 0 else float("inf")
            modes.append({"mode": mode + 1, "lags": len(known), "relative_range": spread, "passes": spread <= most})
    return {"modes": modes, "passes": bool(modes) and all(m["passes"] for m in modes)}


def rank_state_models(reports: DataFrame) -> DataFrame:
    """``reports(candidate_id, passed, vamp_e, ck_rmse, its_range, geometric, states)`` with ``rank``: kinetic checks passed, then held-out VAMP-E, small
    Chapman-Kolmogorov error, stable timescales, geometric score, fewer states, and last the larger name. Missing figures come last."""
    best = [F.col("passed").desc(), F.col("vamp_e").desc_nulls_last(), F.col("ck_rmse").asc_nulls_last(), F.col("its_range").asc_nulls_last(), F.col("geometric").desc_nulls_last(), F.col("states").asc(), F.col("candidate_id").desc()]
    return reports.withColumn("rank", F.row_number().over(W.orderBy(*best)).cast("bigint"))  # one row per candidate

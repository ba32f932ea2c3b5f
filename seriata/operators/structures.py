"""Per-frame geometry of point sets. A frame is one row with an array of points; kernels run batch by batch and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def best_fit(mobile: np.ndarray, target: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """``(rotation, shift, rmsd)`` that lay ``mobile`` on ``target``: the top eigenvector of the 4 x 4 quaternion matrix; never a reflection."""
    w = np.full(len(mobile), 1 / len(mobile)) if weights is None else weights / weights.sum()
    cm, ct = w @ mobile, w @ target
    m = (mobile - cm).T @ (w[:, None] * (target - ct))
    skew = m - m.T
    q = np.zeros((4, 4))
    q[0, 0] = np.trace(m)
    q[0, 1:] = q[1:, 0] = [skew[1, 2], skew[2, 0], skew[0, 1]]
    q[1:, 1:] = m + m.T - np.trace(m) * np.eye(3)
    a, b, c, d = np.linalg.eigh(q)[1][:, -1]
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a - b * b + c * c - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a - b * b - c * c + d * d]])
    gap = (mobile - cm) @ r.T - (target - ct)
    return r, ct - r @ cm, float(np.sqrt((w[:, None] * gap * gap).sum()))


def radius_of_gyration(points: np.ndarray, masses: np.ndarray) -> float:
    center = masses @ points / masses.sum()
    return float(np.sqrt(masses @ ((points - center) ** 2).sum(1) / masses.sum()))


def principal_axes(points: np.ndarray, masses: np.ndarray) -> np.ndarray:
    """Axes of the inertia tensor, smallest moment first, each with its largest part positive."""
    x = points - masses @ points / masses.sum()
    tensor = (masses @ (x * x).sum(1)) * np.eye(3) - (masses[:, None] * x).T @ x
    axes = np.linalg.eigh(tensor)[1].T
    pivot = np.abs(axes).argmax(1)
    return axes * np.where(axes[np.arange(3), pivot] < 0, -1, 1)[:, None]


def fit_plane(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, unit normal and root mean square departure of the least-squares plane."""
    center = points.mean(0)
    _, s, v = np.linalg.svd(points - center)
    return center, v[-1], float(s[-1] / np.sqrt(len(points))) if len(points) > 2 else 0.0


def torsion(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> float:
    u, v, w = b - a, c - b, d - c
    n1, n2 = np.cross(u, v), np.cross(v, w)
    return float((np.degrees(np.arctan2(np.linalg.norm(v) * u @ n2, n1 @ n2)) + 180) % 360 - 180)


def ring_geometry(points: np.ndarray) -> dict:
    """Plane departure and torsions around a ring, with the largest departure of a torsion from planar."""
    n = len(points)
    turns = [torsion(*(points[(k + i) % n] for i in range(4))) for k in range(n)]
    return {"plane_rms": fit_plane(points)[2], "torsions": turns, "max_departure": max(abs((t + 90) % 180 - 90) for t in turns)}


#: Unit directions of ideal coordination shapes, in natural order.
SHAPES = {
    "linear": [(1, 0, 0), (-1, 0, 0)],
    "trigonal_planar": [(1, 0, 0), (-0.5, 0.75**0.5, 0), (-0.5, -(0.75**0.5), 0)],
    "tetrahedral": [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)],
    "square_planar": [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)],
    "trigonal_bipyramidal": [(1, 0, 0), (-0.5, 0.75**0.5, 0), (-0.5, -(0.75**0.5), 0), (0, 0, 1), (0, 0, -1)],
    "octahedral": [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)],
}


def _angles(u: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(u), 1)
    return np.sort(np.degrees(np.arccos(np.clip((u[i] * u[j]).sum(1), -1, 1))))


def coordination_shape(center: np.ndarray, ligands: np.ndarray) -> dict:
    """The ideal shape of equal size nearest in sorted pair angles, with that angle error and the best fit's RMSD over all assignments."""
    u = ligands - center
    u = u / np.linalg.norm(u, axis=1)[:, None]
    best: tuple | None = None
    for name, ideal in SHAPES.items():
        t = np.array(ideal, float)
        t = t / np.linalg.norm(t, axis=1)[:, None]
        if len(t) == len(u):
            error = float(np.sqrt(np.mean((_angles(u) - _angles(t)) ** 2)))
            if best is None or error < best[1]:
                best = (name, error, t)
    if best is None:
        return {"shape": None, "angle_rms": None, "fit_rmsd": None}
    fit = min(best_fit(best[2][list(order)], u)[2] for order in permutations(range(len(u))))
    return {"shape": best[0], "angle_rms": best[1], "fit_rmsd": fit}


def sphere_points(count: int) -> np.ndarray:
    """Evenly spread points on the unit sphere along a golden-angle spiral."""
    k = np.arange(count) + 0.5
    z, turn = 1 - 2 * k / count, np.pi * (3 - 5**0.5) * k
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], 1)


def surface_areas(points: np.ndarray, radii: np.ndarray, probe: float = 1.4, count: int = 960) -> np.ndarray:
    """Solvent-accessible area of each atom: the share of its sphere's points that no neighbour covers."""
    reach, unit = radii + probe, sphere_points(count)
    out = np.zeros(len(points))
    for i, p in enumerate(points):
        near = np.flatnonzero((((points - p) ** 2).sum(1) < (reach + reach[i]) ** 2) & (np.arange(len(points)) != i))
        free = np.ones(count, bool)
        for j in near:
            free &= ((p + reach[i] * unit - points[j]) ** 2).sum(1) >= reach[j] ** 2
        out[i] = 4 * np.pi * reach[i] ** 2 * free.mean()
    return out


def assign_optimally(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = match[j0]
            gap = np.where(used[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = gap < least[1:]
            least[1:][better], way[1:][better] = gap[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def unwrap(track: np.ndarray, box: np.ndarray) -> np.ndarray:
    """A wrapped path (frames x atoms x 3) made continuous by nearest-image steps."""
    steps = np.diff(track, axis=0)
    return np.concatenate([track[:1], track[:1] + np.cumsum(steps - box * np.floor(steps / box + 0.5), axis=0)])


def make_whole(points: np.ndarray, bonds: list[tuple[int, int]], box: np.ndarray) -> np.ndarray:
    """Bonded atoms brought to the image nearest their partner, outwards from each component's first atom."""
    near: dict[int, list[int]] = {}
    for a, b in bonds:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, done = points.copy(), set()
    for start in range(len(points)):
        stack = [start]
        while stack:
            a = stack.pop()
            if a in done:
                continue
            done.add(a)
            for b in near.get(a, ()):
                if b not in done:
                    d = points[b] - out[a]
                    out[b] = out[a] + d - box * np.floor(d / box + 0.5)
                    stack.append(b)
    return out


def per_frame(df: DataFrame, points: str, kernel: Callable[[np.ndarray], dict], schema: str, alias: str) -> DataFrame:
    """``df`` with the struct ``alias`` of what ``kernel`` tells of each frame's points (array of arrays of three); NULL for no points."""

    @F.pandas_udf(f"struct<{schema}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split(":")[0].strip() for x in schema.split(", ")]
        for frames in batches:
            rows = [kernel(np.array([list(p) for p in f], float)) if f is not None and len(f) else {} for f in frames]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return df.withColumn(alias, run(F.col(points)))


def rmsd_rg(df: DataFrame, points: str, reference: np.ndarray, masses: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``rmsd`` to the reference after the best fit and the mass-weighted ``rg``."""
    m = np.ones(len(reference)) if masses is None else masses
    out = per_frame(df, points, lambda p: {"rmsd": best_fit(p, reference, m)[2], "rg": radius_of_gyration(p, m)}, "rmsd: double, rg: double", "_g")
    return out.withColumns({"rmsd": F.col("_g.rmsd"), "rg": F.col("_g.rg")}).drop("_g")


def unwrapped(coordinate: Column, box: float, order: WindowSpec) -> Column:
    """One orthorhombic coordinate unwrapped in the JVM: the running sum of nearest-image steps over the replica's order."""
    step = coordinate - F.lag(coordinate).over(order)
    return F.first(coordinate).over(order) + F.sum(F.coalesce(step - box * F.floor(step / box + 0.5), F.lit(0.0))).over(order)

"""Scalar column functions: vectors, 3-D geometry, circular values. All of them run in the JVM and return NULL where a value is undefined."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boltzmann constant in kcal/(mol K), as used for free energies.
BOLTZMANN_KCAL = 0.00198720425864083


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; NULL where the denominator is zero or NULL."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def total(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """``x`` within bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def minkowski_power(a: Column, b: Column, p: float) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(0.0), lambda s, x: s + x)


def jaccard_distance(a: Column, b: Column) -> Column:
    """One minus the shared part of two sets; two empty sets are at distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def minimum_image(d: Column, length: Column | float) -> Column:
    """The nearest image of a displacement along one axis of an orthorhombic cell."""
    length = F.lit(length) if isinstance(length, float) else length
    return d - length * F.floor(d / length + 0.5)


def cell_vectors(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Rows are the vectors of a cell from lengths and angles in degrees: the first along x, the second in the xy plane."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    y = (ca - cb * cg) / sg
    return [[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [c * cb, c * y, c * math.sqrt(max(0.0, 1 - cb * cb - y * y))]]


def cell_volume(lengths: list[Column], angles: list[Column]) -> Column:
    ca, cb, cg = (F.cos(F.radians(x)) for x in angles)
    return lengths[0] * lengths[1] * lengths[2] * F.sqrt(F.greatest(F.lit(0.0), 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg))


def safe_radius(lengths: list[Column], angles: list[Column]) -> Column:
    """Half the least distance between opposite faces: spheres up to it don't meet their own images."""
    faces = [lengths[(i + 1) % 3] * lengths[(i + 2) % 3] * F.sin(F.radians(angles[i])) for i in range(3)]
    return F.least(*[cell_volume(lengths, angles) / f for f in faces]) / 2


def lattice_image(d: list[Column], cell: list[list[float]], most: int = 100_000) -> Column:
    """The shortest image of a displacement in any cell, skewed ones too, as ``array(x, y, z)``.

    Rounding fractional coordinates gives an image no longer than half the sum of the vectors; every image at most that long
    lies among lattice steps bounded by the reciprocal vectors, and these are all compared. A cell that needs more than ``most`` steps is an error.
    """
    m = np.array(cell, float)
    reciprocal = np.linalg.inv(m).T
    longest = np.linalg.norm(m, axis=1).sum() / 2
    reach = np.floor(np.linalg.norm(reciprocal, axis=1) * longest + 0.5 + 1e-9).astype(int)
    if np.prod(2.0 * reach + 1) > most:
        raise ValueError("the cell is too skewed for an exact nearest image")
    near = [F.floor(total(float(r) * x for r, x in zip(row, d, strict=True)) + 0.5) for row in reciprocal]
    base = [x - total(float(m[i, k]) * near[i] for i in range(3)) for k, x in enumerate(d)]
    steps = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in reach], indexing="ij"), -1).reshape(-1, 3) @ m
    orthogonal = np.abs(m - np.diag(np.diag(m))).max() == 0
    if orthogonal:
        return F.array(*base)
    shifts = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    image = F.transform(shifts, lambda s: F.array(*[x + s[k] for k, x in enumerate(base)]))
    return F.array_min(F.transform(image, lambda v: F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("d"), v.alias("v"))))["v"]


def json_pointer(document: Column, pointer: str) -> Column:
    """The value at a strict pointer (RFC 6901) as text; NULL where a token is absent. Number tokens read lists as well as objects."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer begins with /")
    out = document
    for raw in pointer[1:].split("/") if pointer else []:
        token = raw.replace("~1", "/").replace("~0", "~")
        named = F.get_json_object(out, f"$['{token}']")
        out = F.coalesce(F.get_json_object(out, f"$[{token}]"), named) if token.isdigit() else named
    return out


def wrap_half(a: Column, period: float = 180.0) -> Column:
    """The angle brought into ``[-period / 2, period / 2)``."""
    return F.pmod(a + period / 2, F.lit(period)) - period / 2


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot3(a: list[Column], b: list[Column]) -> Column:
    return total(x * y for x, y in zip(a, b, strict=True))


def norm3(a: list[Column]) -> Column:
    return F.sqrt(dot3(a, a))


def angle_degrees(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """The angle at ``b``; NULL where two points coincide."""
    u, v = minus(a, b), minus(c, b)
    return F.degrees(F.acos(clamp(ratio(dot3(u, v), norm3(u) * norm3(v)), -1.0, 1.0)))


def dihedral_degrees(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    """Signed torsion in ``[-180, 180)``; NULL for collinear points."""
    b1, b2, b3 = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    y, x = norm3(b2) * dot3(b1, n2), dot3(n1, n2)
    degenerate = (norm3(n1) <= 1e-12) | (norm3(n2) <= 1e-12)
    return F.when(~degenerate, wrap_half(F.degrees(F.atan2(y, x)), 360.0))


def unoriented_angle(a: list[Column], b: list[Column]) -> Column:
    """The angle of two plane normals, 0 to 90 degrees."""
    return F.degrees(F.acos(clamp(F.abs(ratio(dot3(a, b), norm3(a) * norm3(b))), 0.0, 1.0)))


def free_energy(count: Column, most: Column, temperature: float) -> Column:
    """``-kT ln(count / most)``; NULL for an empty cell."""
    return F.when(count > 0, -BOLTZMANN_KCAL * temperature * F.log(ratio(count, most)))


def hybrid36(field: Column, width: int) -> Column:
    """A fixed-width hybrid-36 number: decimal, then upper-case base 36, then lower-case base 36; NULL for other text."""
    text = F.btrim(field)
    first = F.substring(text, 1, 1)
    base = F.conv(F.upper(text), 36, 10).cast("bigint")
    plain = F.when(text.rlike(r"^-?\d+$"), text.cast("bigint"))
    upper = F.when(text.rlike(rf"^[A-Z][0-9A-Z]{{{width - 1}}}$"), base - 10 * 36 ** (width - 1) + 10**width)
    lower = F.when(text.rlike(rf"^[a-z][0-9a-z]{{{width - 1}}}$"), base + 16 * 36 ** (width - 1) + 10**width)
    return F.coalesce(plain, F.when(first.rlike("[A-Z]"), upper), F.when(first.rlike("[a-z]"), lower))


def to_hybrid36(n: Column, width: int) -> Column:
    """A whole number as ``width`` characters that ``hybrid36`` reads: decimal to the right, then upper-case base 36, then lower-case. One beyond these fails the query."""
    n, letters = n.cast("bigint"), 26 * 36 ** (width - 1)
    digits = lambda past: F.conv((n - past + 10 * 36 ** (width - 1)).cast("string"), 10, 36)
    plain, upper, lower = 10**width, 10**width + letters, 10**width + 2 * letters
    beyond = F.raise_error(F.concat(n.cast("string"), F.lit(f" doesn't fit {width} characters of hybrid-36"))).cast("string")
    return F.when((n > -(10 ** (width - 1))) & (n < plain), F.format_string(f"%{width}d", n)).when((n >= plain) & (n < upper), F.upper(digits(plain))).when((n >= upper) & (n < lower), F.lower(digits(upper))).when(n.isNotNull(), beyond)

"""Point-cloud attributes: stored logits and logarithms, rotations, placement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrain.functions.numeric import clip, dot, sigmoid

SH_C0 = 0.5 / np.sqrt(np.pi)  # the constant harmonic


def opacity(logit: Column) -> Column:
    return sigmoid(logit.cast("double"))


def scales(*logs: Column) -> Column:
    """Ascending sizes from their logarithms."""
    return F.array_sort(F.array(*[F.exp(c.cast("double")) for c in logs]))


def colour(f_dc: Column) -> Column:
    return clip(0.5 + F.lit(float(SH_C0)) * f_dc.cast("double"), 0.0, 1.0)


def intact(columns: list[Column], quaternion: list[Column]) -> Column:
    """Whether all values are finite and the rotation is one."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine & (F.sqrt(dot(quaternion, quaternion)) > 1e-6)


def visual_weight(alpha: Column, s1: Column, s2: Column, distance: Column) -> Column:
    """Opacity times the solid angle of the two larger axes, at most the whole sphere."""
    return alpha * F.least(np.pi * s1 * s2 / F.pow(F.greatest(distance, F.lit(0.02)), 2), F.lit(4 * np.pi))


def place(p: list[Column], rotate: list[list[float]], shift: list[float], scale: float = 1.0) -> list[Column]:
    """``(R p + t) * s`` of a point given as three columns."""
    return [(dot([F.lit(float(v)) for v in row], p) + F.lit(float(t))) * F.lit(float(scale)) for row, t in zip(rotate, shift)]


def quaternion_matrix(q: list[Column]) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion w, x, y, z."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def camera_centre(q: list[Column], t: list[Column]) -> list[Column]:
    """Where a camera with pose (q, t) stands: -R^T t."""
    r = quaternion_matrix(q)
    return [-dot([r[i][j] for i in range(3)], t) for j in range(3)]


def turned(q: list[Column], rotation: np.ndarray) -> list[Column]:
    """Quaternions w, x, y, z after a rotation is applied on the left."""
    w, x, y, z = (F.lit(float(v)) for v in matrix_quaternion(rotation))
    a, b, c, d = q
    return [w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a]


def matrix_quaternion(m: np.ndarray) -> np.ndarray:
    """Unit quaternion w, x, y, z of a rotation matrix: the main eigenvector of its symmetric form."""
    m = np.asarray(m, float)
    k = np.array([
        [m[0, 0] - m[1, 1] - m[2, 2], 0, 0, 0],
        [m[1, 0] + m[0, 1], m[1, 1] - m[0, 0] - m[2, 2], 0, 0],
        [m[2, 0] + m[0, 2], m[2, 1] + m[1, 2], m[2, 2] - m[0, 0] - m[1, 1], 0],
        [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], m.trace()],
    ]) / 3
    value, vector = np.linalg.eigh(k)
    x, y, z, w = vector[:, -1]
    q = np.array([w, x, y, z])
    return q if w >= 0 else -q


def harmonics(d: np.ndarray) -> np.ndarray:
    """Real spherical harmonics of bands 1 to 3 at unit directions: 15 columns.

    Built from associated Legendre polynomials instead of a table; signs and order (m from -l to l) are those splat
    files use.
    """
    from math import factorial, pi, sqrt

    x, y, z = d.T
    phi, out = np.arctan2(y, x), []
    s = np.sqrt(np.maximum(1 - z * z, 0))
    legendre = {(0, 0): np.ones_like(z)}
    for l in range(1, 4):  # noqa: E741
        legendre[l, l] = -(2 * l - 1) * s * legendre[l - 1, l - 1]
        legendre[l, l - 1] = (2 * l - 1) * z * legendre[l - 1, l - 1]
        for m in range(l - 1):
            legendre[l, m] = ((2 * l - 1) * z * legendre[l - 1, m] - (l + m - 1) * legendre[l - 2, m]) / (l - m)
        for m in range(-l, l + 1):
            k = sqrt((2 * l + 1) / (4 * pi) * factorial(l - abs(m)) / factorial(l + abs(m)))
            f = legendre[l, abs(m)]
            out.append(k * f if m == 0 else sqrt(2) * k * f * (np.cos(m * phi) if m > 0 else np.sin(-m * phi)))
    return np.stack(out, axis=1)


def band_rotations(rotation: np.ndarray) -> list[np.ndarray]:
    """For bands 1 to 3 the matrix that turns coefficients as ``rotation`` turns the scene.

    Its entries are integrals over the sphere of products of two harmonics, polynomials of degree 6 at most; four Gauss
    nodes in z times eight angles integrate those exactly.
    """
    z, weight = np.polynomial.legendre.leggauss(4)
    angle = np.arange(8) * (np.pi / 4)
    s = np.sqrt(1 - z * z)
    d = np.stack([np.outer(s, np.cos(angle)), np.outer(s, np.sin(angle)), np.repeat(z[:, None], 8, axis=1)], axis=2).reshape(-1, 3)
    area = np.repeat(weight, 8) * (np.pi / 4)
    turned_, plain = harmonics(d @ np.asarray(rotation).T), harmonics(d)
    return [(turned_[:, lo:hi] * area[:, None]).T @ plain[:, lo:hi] for lo, hi in ((0, 3), (3, 8), (8, 15))]


def turned_harmonics(coefficients: Column, rotation: np.ndarray) -> Column:
    """``array<double>`` of 45 values (three channels of 15) after a rotation, inside codegen."""
    bands = band_rotations(rotation)
    out = []
    for channel in range(3):
        for (lo, hi), m in zip(((0, 3), (3, 8), (8, 15)), bands):
            own = [F.get(coefficients, F.lit(15 * channel + i)).cast("double") for i in range(lo, hi)]
            out += [dot([F.lit(float(v)) for v in row], own) for row in m]
    return F.array(*out)

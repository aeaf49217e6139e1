"""Distance-decay calibration.

No measured calibration ships with this package: the knots below are synthetic and only have the
usual shape (density falls with distance, the diagonal grows with area to the power 2/3).  Fit real
ones with :mod:`walkweave.operators.training`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Synthetic knots: ln(distance in bp) and ln(contact density per bp^2 at depth 1).
KNOT_X = (7.0, 8.5, 10.0, 11.5, 13.0, 14.5, 16.0, 17.5, 19.0)
KNOT_Y = (-16.1, -17.5, -19.1, -20.6, -21.9, -23.3, -25.1, -27.2, -29.6)
DIAGONAL = (-11.2, 2 / 3)
INTERCHROM_DENSITY = 1.03714159e-11
MIN_RESOLUTION = 1e4
# Fixed value: beyond this distance density falls as 1/distance.
MAX_DISTANCE = 1e8


@dataclass(frozen=True)
class Decay:
    """Piecewise cubic in ln(distance), a line for the diagonal, and an inter-chromosome density."""

    starts: tuple[float, ...]
    coefs: tuple[tuple[float, float, float, float], ...]
    diagonal: tuple[float, float] = DIAGONAL
    interchrom: float = INTERCHROM_DENSITY
    min_resolution: float = MIN_RESOLUTION

    def log_density(self, x: Column) -> Column:
        """Cubic of the knot interval holding ``x`` (the outer cubics extend beyond the knots)."""
        out = None
        for k in range(len(self.starts) - 1, -1, -1):
            t = x - self.starts[k]
            a, b, c, d = self.coefs[k]
            piece = F.lit(a) + t * (F.lit(b) + t * (F.lit(c) + t * d))
            out = piece if k == 0 and out is None else (
                F.when(x >= self.starts[k], piece) if out is None
                else (out.when(x >= self.starts[k], piece) if k else out.otherwise(piece))
            )
        return out

    def log_density_at(self, x: float) -> float:
        k = max(0, int(np.searchsorted(self.starts, x, side="right")) - 1)
        t = x - self.starts[k]
        a, b, c, d = self.coefs[k]
        return a + t * (b + t * (c + t * d))

    def contact(self, area: Column, dist: Column) -> Column:
        """Expected contacts of two intervals of one molecule at depth 1."""
        far = float(np.exp(self.log_density_at(float(np.log(MAX_DISTANCE)))))
        a, b = self.diagonal
        return (
            F.when(dist == 0, F.exp(F.lit(a) + b * F.ln(area)))
            .when(dist > MAX_DISTANCE, area * far * MAX_DISTANCE / dist)
            .otherwise(area * F.exp(self.log_density(F.ln(dist))))
        )

    def numpy_contact(self, area: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """``contact`` on arrays."""
        far = float(np.exp(self.log_density_at(float(np.log(MAX_DISTANCE)))))
        a, b = self.diagonal
        x = np.log(np.where(dist > 0, dist, 1.0))
        k = np.maximum(np.searchsorted(self.starts, x, side="right") - 1, 0)
        t = x - np.asarray(self.starts)[k]
        c = np.asarray(self.coefs)[k].T
        near = area * np.exp(c[0] + t * (c[1] + t * (c[2] + t * c[3])))
        out = np.where(dist > MAX_DISTANCE, area * far * MAX_DISTANCE / np.where(dist > 0, dist, 1.0), near)
        return np.where(dist == 0, np.exp(a + b * np.log(area)), out)

    def long_read(self, area: Column, dist: Column, length: float) -> Column:
        """Co-occurrence on reads of mean ``length``."""
        return area / (10.0 * self.min_resolution**2) * F.exp(-dist / float(length))

    def sql_contact(self, area: str, dist: str) -> str:
        """The same value as SQL text."""
        far = float(np.exp(self.log_density_at(float(np.log(MAX_DISTANCE)))))
        a, b = self.diagonal
        e = "::DOUBLE"
        x = f"ln({dist})"
        cases = []
        for k in range(len(self.starts) - 1, -1, -1):
            t = f"({x} - {self.starts[k]!r}{e})"
            c0, c1, c2, c3 = (f"({v!r}{e})" for v in self.coefs[k])
            piece = f"({c0} + {t} * ({c1} + {t} * ({c2} + {t} * {c3})))"
            cases.append(f"WHEN {x} >= {self.starts[k]!r} THEN {piece}" if k else f"ELSE {piece}")
        spline = "CASE " + " ".join(cases) + " END"
        return (
            f"CASE WHEN {dist} = 0 THEN exp(({a!r}{e}) + ({b!r}{e}) * ln({area})) "
            f"WHEN {dist} > {MAX_DISTANCE!r} THEN {area} * ({far!r}{e}) * {MAX_DISTANCE!r}{e} / {dist} "
            f"ELSE {area} * exp({spline}) END"
        )


def cubic_spline(x, y) -> Decay:
    """Twice continuously differentiable cubic through the points.

    At both ends the third derivative is that of the cubic through the four outermost points.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 4:
        raise ValueError("a spline needs at least four knots")
    h, slope = np.diff(x), np.diff(y) / np.diff(x)

    def third(idx):
        xs, table = x[idx], y[idx].astype(float)
        for level in range(1, 4):
            table = (table[1:] - table[:-1]) / (xs[level:] - xs[:-level])
        return 6 * table[0]

    m = np.zeros((n, n))
    rhs = np.zeros(n)
    m[0, :2], rhs[0] = (-1 / h[0], 1 / h[0]), third(slice(0, 4))
    m[-1, -2:], rhs[-1] = (-1 / h[-1], 1 / h[-1]), third(slice(n - 4, n))
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        rhs[k] = 6 * (slope[k] - slope[k - 1])
    s = np.linalg.solve(m, rhs)
    coefs = tuple(
        (float(y[k]), float(slope[k] - h[k] * (2 * s[k] + s[k + 1]) / 6), float(s[k] / 2),
         float((s[k + 1] - s[k]) / (6 * h[k])))
        for k in range(n - 1)
    )
    return Decay(tuple(float(v) for v in x[:-1]), coefs)


SYNTHETIC = cubic_spline(KNOT_X, KNOT_Y)

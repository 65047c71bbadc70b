"""Column expressions: rounding, matrices, orientation, coordinate maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def lit(x: float) -> Column:
    return F.lit(float(x))


def trunc_int(c: Column) -> Column:
    """Towards zero, as an int."""
    return c.cast("int")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def clamp(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def floor_div(a: Column, b) -> Column:
    return F.floor(a / b)


def affine_xy(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """2x3 or 3x3 affine matrix applied to a point."""
    (a, b, c), (d, e, f) = m[0], m[1]
    return lit(a) * x + lit(b) * y + lit(c), lit(d) * x + lit(e) * y + lit(f)


#: How the perspective divisor is kept away from 0.
GUARDS = ("clamp", "replace", "sign")


def homography_xy(m: Matrix, x: Column, y: Column, guard: str = "clamp") -> tuple[Column, Column]:
    """Projective map. Guards: "clamp" takes max(w, 1e-8); "replace" puts 1e-12 for |w| <= 1e-12;
    "sign" keeps the sign and at least 1e-9."""
    (a, b, c), (d, e, f), (g, h, i) = m
    w = lit(g) * x + lit(h) * y + lit(i)
    if guard == "clamp":
        w = F.greatest(w, lit(1e-8))
    elif guard == "replace":
        w = F.when(F.abs(w) > 1e-12, w).otherwise(lit(1e-12))
    elif guard == "sign":
        w = F.when(F.abs(w) < 1e-9, F.when(w < 0, lit(-1e-9)).otherwise(lit(1e-9))).otherwise(w)
    else:
        raise ValueError(f"guard must be one of {GUARDS}")
    return (lit(a) * x + lit(b) * y + lit(c)) / w, (lit(d) * x + lit(e) * y + lit(f)) / w


def matmul(a: Matrix, b: Matrix) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def lift(m: Matrix) -> list[list[float]]:
    """A 2x3 matrix as 3x3."""
    rows = [list(map(float, r)) for r in m]
    return rows if len(rows) == 3 else [*rows, [0.0, 0.0, 1.0]]


def scaling(sx: float, sy: float | None = None) -> list[list[float]]:
    return [[sx, 0.0, 0.0], [0.0, sx if sy is None else sy, 0.0], [0.0, 0.0, 1.0]]


def inverse3(m: Matrix) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m, dtype=float)).tolist()


def level0(m: Matrix, source_level: int, target_level: int) -> list[list[float]]:
    """A map between two pyramid levels, between the levels 0 instead."""
    return matmul(matmul(scaling(2.0**target_level), lift(m)), scaling(2.0**-source_level))


def at_scale(m: Matrix, s: float) -> list[list[float]]:
    """The same map between images shown at scale s."""
    return matmul(matmul(scaling(1 / s), lift(m)), scaling(s))


#: (x, y) -> place in the oriented image, for the eight cases; w and h are the source's size.
def orient(case: int, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return {
        0: lambda: (x, y),
        1: lambda: (h - 1 - y, x),
        2: lambda: (w - 1 - x, h - 1 - y),
        3: lambda: (y, w - 1 - x),
        4: lambda: (x, h - 1 - y),
        5: lambda: (w - 1 - x, y),
        6: lambda: (y, x),
        7: lambda: (h - 1 - y, w - 1 - x),
    }[case]()


def orient_by(case: Column, x: Column, y: Column, w: Column, h: Column, compat_case6: bool = False) -> tuple[Column, Column]:
    """``orient`` with the case in a column. ``compat_case6`` flips vertically in case 6 instead of transposing."""
    pairs = [orient(i, x, y, w, h) for i in range(8)]
    if compat_case6:
        pairs[6] = pairs[4]
    return tuple(F.element_at(F.array(*[p[k] for p in pairs]), case + 1) for k in (0, 1))


def unorient_by(case: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Back from the oriented image, given the source's size."""
    pairs = [(x, y), (y, h - 1 - x), (w - 1 - x, h - 1 - y), (w - 1 - y, x), (x, h - 1 - y), (w - 1 - x, y), (y, x), (w - 1 - y, h - 1 - x)]
    return tuple(F.element_at(F.array(*[p[k] for p in pairs]), case + 1) for k in (0, 1))


def unorient_oriented_by(case: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Back from the oriented image, given the oriented image's size."""
    turned = case.isin(1, 3, 6, 7)
    return unorient_by(case, x, y, F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h))


def winding(points: Sequence[tuple[Column, Column]]) -> Column:
    """Signed area of a polygon (shoelace)."""
    total = lit(0)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True):
        total = total + x0 * y1 - x1 * y0
    return total / 2


def dice(both: Column, a: Column, b: Column) -> Column:
    return 2 * both / (a + b + lit(1e-6))


def iou(both: Column, a: Column, b: Column) -> Column:
    return both / (a + b - both + lit(1e-6))


def elapsed(seconds: Column) -> Column:
    """``1h02m03s`` from an hour on, else ``02m03s``."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).otherwise(F.format_string("%02dm%02ds", m, r))

"""Column expressions for periodic, orthorhombic cells. Lengths are nanometres; everything is DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def min_image(d: Column, length: Column) -> Column:
    """A coordinate difference brought into the nearest periodic image (rint rounds halves to even)."""
    return d - F.rint(d / length) * length


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], box: tuple[Column, Column, Column]) -> Column:
    dx, dy, dz = (min_image(p - q, length) for p, q, length in zip(a, b, box, strict=True))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def cell_count(length: Column, size: Column) -> Column:
    """How many cells of at least `size` fit along an axis; one at least."""
    return F.greatest(F.floor(length / size).cast("int"), F.lit(1))


def cell_index(x: Column, length: Column, cells: Column) -> Column:
    return F.pmod(F.floor(x / length * cells), cells).cast("int")


def wrap(x: Column, length: Column) -> Column:
    return F.pmod(x, length)


def linear_id(ix: Column, iy: Column, iz: Column, gy: Column, gz: Column) -> Column:
    return (ix.cast("long") * gy + iy) * gz + iz


def sphere_area(r: Column) -> Column:
    return 4 * F.pi() * r * r


def sphere_volume(r: Column) -> Column:
    return F.lit(4.0 / 3.0) * F.pi() * r * r * r


def tanh_smooth(d: Column, sigma: Column | float) -> Column:
    """0.5 * (1 + tanh(d / sigma))."""
    return 0.5 * (1 + F.tanh(d / sigma))


def fermi_smooth(d: Column, s: Column | float) -> Column:
    """1 / (1 + exp(-d / s)), flat beyond 60 widths."""
    x = d / s
    return F.when(x > 60, 1.0).when(x < -60, 0.0).otherwise(1 / (1 + F.exp(-x)))


def smoothstep(d: Column, w: Column | float) -> Column:
    """0 below -w, 1 above w, t * t * (3 - 2t) between."""
    t = (d + w) / (2 * w)
    return F.when(d <= -w, 0.0).when(d >= w, 1.0).otherwise(t * t * (3 - 2 * t))


def overlap_longer_than(a0: Column, a1: Column, b0: Column, b1: Column, tol: Column | float) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0) > tol


def faces_touch(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]], tol: Column | float) -> Column:
    """Whether two boxes, given as (centre, half edge) by axis, share part of a face."""
    lo = lambda box: [c - h for c, h in box]
    hi = lambda box: [c + h for c, h in box]
    (a0, a1), (b0, b1) = (lo(a), hi(a)), (lo(b), hi(b))
    found = F.lit(False)
    for axis in range(3):
        u, v = (k for k in range(3) if k != axis)
        meets = (F.abs(a1[axis] - b0[axis]) <= tol) | (F.abs(b1[axis] - a0[axis]) <= tol)
        found = found | (meets & overlap_longer_than(a0[u], a1[u], b0[u], b1[u], tol) & overlap_longer_than(a0[v], a1[v], b0[v], b1[v], tol))
    return found

"""Column helpers for axial angles (period pi) and closed-form 2 x 2 eigenvalues."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def symmetry_order(k: int) -> int:
    """A validated symmetry order; 0 and negative orders are refused."""
    if int(k) != k or k < 1:
        raise ValueError("k must be a positive integer")
    return int(k)


def wrap(d: Column) -> Column:
    """The representative of d modulo pi in [-pi/2, pi/2)."""
    return d - PI * F.floor((d + PI / 2) / PI)


def fold(theta: Column) -> Column:
    """theta modulo pi in [0, pi)."""
    t = theta - PI * F.floor(theta / PI)
    return F.when(t >= PI, 0.0).otherwise(t)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def ratio(a: Column, b: Column, least: float = 1e-15, otherwise: float = 0.0) -> Column:
    """a / b where b is over `least`."""
    return F.when(b > least, a / b).otherwise(F.lit(otherwise))


def eigen(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Eigenvalues, larger first, of the symmetric matrix (a b; b d)."""
    root = F.sqrt((a - d) * (a - d) + 4.0 * b * b)
    return (a + d + root) / 2.0, (a + d - root) / 2.0


def mean_axis(weight: Column, theta: Column) -> Column:
    """Aggregate: weighted axial mean in [0, pi)."""
    return fold(0.5 * F.atan2(F.sum(weight * F.sin(2.0 * theta)), F.sum(weight * F.cos(2.0 * theta))))


def frame(theta: Column) -> Column:
    """The rotation by theta about z as nine numbers, by rows."""
    c, s = F.cos(theta), F.sin(theta)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, s, c, zero, zero, zero, one)

"""Circular arithmetic on radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
MISSING = -1000.0
OBSERVED_ABOVE = -100.0


def mod2pi(a: Column) -> Column:
    """Angle in [0, 2pi)."""
    return F.pmod(a, F.lit(TWO_PI))


def pimod(a: Column) -> Column:
    """Angle in (-pi, pi]."""
    m = mod2pi(a)
    return F.when(m > math.pi, m - TWO_PI).otherwise(m)


def angle_to_index(a: Column, n: int, half_shift: bool = False) -> Column:
    """Cell 1..n of an angle; ``half_shift`` centres the first cell on zero."""
    delta = TWO_PI / n
    if half_shift:
        return (F.pmod(F.floor(mod2pi(a) / delta + 0.5), F.lit(n)) + 1).cast("bigint")
    return (F.floor(mod2pi(a) / delta) + 1).cast("bigint")


def index_to_angle(i: Column, n: int) -> Column:
    """Middle of cell ``i``."""
    delta = TWO_PI / n
    return i * F.lit(delta) - F.lit(delta / 2.0)


def circle_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(TWO_PI) - d)


def chord_distance(a: Column, b: Column) -> Column:
    c, s = F.cos(b) - F.cos(a), F.sin(b) - F.sin(a)
    return F.sqrt(c * c + s * s)


def torus_distance(phi_a: Column, psi_a: Column, phi_b: Column, psi_b: Column) -> Column:
    """Distance of two torsion pairs, 0 to sqrt(8); null if any angle is."""
    inner = 2.0 - F.cos(phi_a - phi_b) - F.cos(psi_a - psi_b)
    # No greatest() here: it would turn a null into a distance of zero.
    return F.sqrt(2.0 * F.when(inner < 0, 0.0).otherwise(inner))


def radius_angle(r: Column) -> Column:
    """Angle by which both torsions may differ for a torus distance ``r``."""
    return F.acos((4.0 - r * r) / 4.0)


def sentinel_to_null(c: Column) -> Column:
    return F.when(c > OBSERVED_ABOVE, c)


def null_to_sentinel(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))

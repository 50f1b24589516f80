"""Guards for logs and exponentials, and vector distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-50


def safe_log(c: Column) -> Column:
    """Log that gives -inf, not null, for values of zero or less."""
    return F.when(c <= 0, F.lit(-math.inf)).otherwise(F.ln(c))


def quick_exp(c: Column, lowest: float = -40.0) -> Column:
    """Exponential that is exactly zero far below the working range."""
    return F.when(c < lowest, 0.0).otherwise(F.exp(c))


def clamp(c: Column, floor: float = FLOOR) -> Column:
    return F.greatest(c, F.lit(floor))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def logsumexp2(a: Column, b: Column) -> Column:
    """Log of exp(a) + exp(b); null and -inf count as nothing."""
    a = F.coalesce(a, F.lit(-math.inf))
    b = F.coalesce(b, F.lit(-math.inf))
    top = F.greatest(a, b)
    return F.when(top == -math.inf, top).otherwise(top + F.log1p(F.exp(F.least(a, b) - top)))


def logsumexp_list(cols: list[Column]) -> Column:
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    total = sum((F.exp(c - top) for c in cols[1:]), F.exp(cols[0] - top))
    return top + F.ln(total)


def vector_rmsd(a: Column, b: Column) -> Column:
    """Root of the mean squared difference of two arrays of one length."""
    sq = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.sqrt(sq / F.size(a))


def cosine_similarity(a: Column, b: Column) -> Column:
    def dot(u: Column, v: Column) -> Column:
        prod = F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

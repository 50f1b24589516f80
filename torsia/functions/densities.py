"""Log densities on the circle and the torus, with given parameters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import TWO_PI, mod2pi
from .numeric import logsumexp_list

LOG_ROOT_TWO_PI = 0.5 * math.log(TWO_PI)
IMAGES = (-1, 0, 1)


def log_bessel_i0(kappa: float) -> float:
    """ln I0, by its leading asymptotic terms where numpy would overflow."""
    if kappa < 500.0:
        return float(np.log(np.i0(kappa)))
    return kappa - 0.5 * math.log(TWO_PI * kappa) + math.log1p(1.0 / (8.0 * kappa))


def von_mises_log_norm(kappa: float) -> float:
    return math.log(TWO_PI) + log_bessel_i0(kappa)


def bivariate_log_norm(k1: float, k2: float, k3: float, cells: int = 400) -> float:
    """Log normaliser of the cosine form, by a sum over one full period."""
    grid = -math.pi + TWO_PI * np.arange(cells) / cells
    x, y = np.meshgrid(grid, grid)
    power = k1 * np.cos(x) + k2 * np.cos(y) - k3 * np.cos(x - y)
    top = power.max()
    return float(top + np.log(np.exp(power - top).mean()) + 2.0 * math.log(TWO_PI))


def von_mises_logpdf(x: Column, mu: Column, kappa: Column, log_norm: Column) -> Column:
    return kappa * F.cos(x - mu) - log_norm


def bivariate_logpdf(phi, psi, mu_phi, mu_psi, k1, k2, k3, log_norm) -> Column:
    a, b = phi - mu_phi, psi - mu_psi
    return k1 * F.cos(a) + k2 * F.cos(b) - k3 * F.cos(a - b) - log_norm


def normal_logpdf(x: Column, sd: Column) -> Column:
    z = x / sd
    return -0.5 * z * z - F.ln(sd) - LOG_ROOT_TWO_PI


def wrapped_normal_logpdf(x: Column, mu: Column, sd: Column) -> Column:
    """Stationary law of the wrapped process, three images."""
    d = mod2pi(x) - mu
    return logsumexp_list([normal_logpdf(d + m * TWO_PI, sd) for m in IMAGES])


def wrapped_transition_logpdf(x0, xt, t, mu, alpha, sigma) -> Column:
    """Log density of ``xt`` a time ``t`` after ``x0`` for a wrapped mean-reverting process.

    Each winding of the start is weighed by its stationary density; each of
    those gives a normal law wrapped over the windings of the end.
    """
    a0, at = mod2pi(x0), mod2pi(xt)
    decay = F.exp(-alpha * t)
    spread = sigma * sigma / (2.0 * alpha)
    stat_sd = F.sqrt(spread)
    step_sd = F.sqrt(spread * (1.0 - decay * decay))
    starts, joint = [], []
    for m in IMAGES:
        offset = a0 - mu + m * TWO_PI
        weight = normal_logpdf(offset, stat_sd)
        centre = mu + offset * decay
        ends = [normal_logpdf(at - centre + k * TWO_PI, step_sd) for k in IMAGES]
        starts.append(weight)
        joint.append(weight + logsumexp_list(ends))
    return logsumexp_list(joint) - logsumexp_list(starts)


def wrapped_joint_logpdf(x0, xt, t, mu, alpha, sigma) -> Column:
    stat_sd = F.sqrt(sigma * sigma / (2.0 * alpha))
    return wrapped_normal_logpdf(x0, mu, stat_sd) + wrapped_transition_logpdf(x0, xt, t, mu, alpha, sigma)

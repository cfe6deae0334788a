"""Column builders for emission densities, scaling and log arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_SQRT_2PI = 0.9189385332046727


def log_gauss(x: Column, mu: Column, sd: Column) -> Column:
    """log N(x; mu, sd); minus infinity for sd = 0."""
    z = (x - mu) / F.nullif(sd, F.lit(0.0))
    return F.coalesce(-LOG_SQRT_2PI - F.ln(F.nullif(sd, F.lit(0.0))) - 0.5 * z * z, F.lit(float("-inf")))


def log_inv_gauss(x: Column, mu: Column, shape: Column) -> Column:
    """log of the inverse Gaussian density at x > 0."""
    a = (x - mu) / mu
    return (F.ln(shape) - math.log(2 * math.pi) - 3 * F.ln(x) - shape * a * a / x) / 2


def descale(x: Column, mu: Column, scale: Column, shift: Column, var: Column) -> Column:
    return (x + var * mu - scale * mu - shift) / var


def log_poisson(n: Column, rate: float) -> Column:
    """log Poisson of a count up to 20, by factorials."""
    return n * math.log(rate) - rate - F.ln(F.factorial(n.cast("int")).cast("double"))


def log_bivariate_gauss(x: Column, mx: Column, sx: Column, y: Column, my: Column, sy: Column, rho: float) -> Column:
    a, b = (x - mx) / sx, (y - my) / sy
    q = 1 - rho * rho
    return -(a * a - 2 * rho * a * b + b * b) / (2 * q) - F.ln(2 * math.pi * sx * sy * math.sqrt(q))


def skip_bin(a: Column, b: Column) -> Column:
    """Bin of the distance between two levels, in steps of 0.5, the last one open."""
    return F.least(F.floor(F.abs(a - b) / 0.5), F.lit(29)).cast("long")


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def noise_shape(mean: Column, sd: Column) -> Column:
    return F.pow(mean, F.lit(3.0)) / (sd * sd)


def noise_sd(mean: Column, shape: Column) -> Column:
    return F.sqrt(F.pow(mean, F.lit(3.0)) / shape)


def fixed_point(p: Column) -> Column:
    """A probability clamped to 1 and cut to seven decimal places."""
    return F.floor(F.least(p, F.lit(1.0)) * 1e7).cast("long") / F.lit(1e7)

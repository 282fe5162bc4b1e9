"""Soil-water release curve: water content as a function of suction, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.units import cm_to_m, cm_water_to_mpa, mpa_to_cm_water

# Fixed value: saturated water content of the loamy sand.
THETA_S = 0.44
# From here on exp(x) - 1 and exp(x) are the same double.
LARGE_EXPONENT = 40.0
# Taken out of large suctions while their unit is changed, lest that overflows.
SCALE = 1e10


def suction_cm(potential_mpa: Column) -> Column:
    """Potential (MPa, negative) to suction head (cm of water, positive)."""
    return -mpa_to_cm_water(potential_mpa)


def suction_m(potential_mpa: Column) -> Column:
    return cm_to_m(suction_cm(potential_mpa))


def saturation(h_cm: Column, alpha: Column, n: Column) -> Column:
    """Effective saturation (1 + (alpha h)^n)^(1/n - 1)."""
    one = F.lit(1.0)
    return F.pow(one + F.pow(alpha * h_cm, n), one / n - one)


def water_content(h_cm: Column, alpha: Column, n: Column, theta_r: Column, theta_s: float = THETA_S) -> Column:
    return theta_r + (F.lit(theta_s) - theta_r) * saturation(h_cm, alpha, n)


def residual(theta: Column, h_cm: Column, alpha: Column, n: Column, theta_r: Column) -> Column:
    """Observed less fitted water content."""
    return theta - water_content(h_cm, alpha, n, theta_r)


def suction_mpa(theta: Column, alpha: Column, n: Column, theta_r: Column, theta_s: float = THETA_S) -> Column:
    """Inverse curve as suction in MPa; NULL outside theta_r < theta <= theta_s, n > 1, alpha > 0.

    For large exponents the root is taken of the exponential as such, so that only a suction
    which is itself no finite double is NULL.
    """
    one = F.lit(1.0)
    valid = (theta > theta_r) & (theta <= F.lit(theta_s)) & (n > one) & (alpha > F.lit(0.0))
    power = F.log(F.try_divide(F.lit(theta_s) - theta_r, theta - theta_r)) * F.try_divide(n, n - one)
    root = F.try_divide(one, n)
    near = F.pow(F.exp(F.least(power, F.lit(LARGE_EXPONENT))) - one, root)
    far = cm_water_to_mpa(F.try_divide(F.exp(power * root) / F.lit(SCALE), alpha)) * F.lit(SCALE)
    suction = F.when(power < F.lit(LARGE_EXPONENT), cm_water_to_mpa(F.try_divide(near, alpha))).otherwise(far)
    return F.when(valid & (suction < F.lit(float("inf"))), suction)

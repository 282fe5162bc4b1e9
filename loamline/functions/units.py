"""Unit conversions and vapour-pressure deficit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit definitions.
MM_PER_INCH = 25.4
PASCAL_PER_CM_WATER = 98.0665
PASCAL_PER_MPA = 1.0e6
CM_PER_M = 100.0
KPA_PER_MPA = 1000.0

# Saturation vapour pressure over water (Pa, degrees C) with enhancement factor.
VAPOUR_A = 611.21
VAPOUR_B = 17.502
VAPOUR_C = 240.97
ENHANCE_BASE = 1.0007
ENHANCE_PER_PASCAL = 3.46e-8
DEFAULT_PRESSURE_KPA = 101.0


def inch_to_mm(c: Column) -> Column:
    return c * F.lit(MM_PER_INCH)


def mpa_to_cm_water(c: Column) -> Column:
    return c * F.lit(PASCAL_PER_MPA) / F.lit(PASCAL_PER_CM_WATER)


def cm_water_to_mpa(c: Column) -> Column:
    return c * F.lit(PASCAL_PER_CM_WATER) / F.lit(PASCAL_PER_MPA)


def cm_to_m(c: Column) -> Column:
    return c / F.lit(CM_PER_M)


def kpa_to_mpa(c: Column) -> Column:
    return c / F.lit(KPA_PER_MPA)


def vapour_pressure_deficit(rh: Column, temp: Column, pressure_kpa: float = DEFAULT_PRESSURE_KPA) -> Column:
    """kPa from relative humidity (%) and air temperature (degrees C)."""
    enhance = ENHANCE_BASE + ENHANCE_PER_PASCAL * pressure_kpa * 1000.0
    saturated_pa = F.lit(enhance * VAPOUR_A) * F.exp(F.lit(VAPOUR_B) * temp / (F.lit(VAPOUR_C) + temp))
    return (F.lit(1.0) - rh / F.lit(100.0)) * saturated_pa / F.lit(1000.0)

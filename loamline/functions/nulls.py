"""One notion of missing: NULL. NaN and infinities are folded into it before aggregating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value when it is a finite number, else NULL."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def at_least(c: Column, floor: float) -> Column:
    """Blank readings below a physical floor; the row stays."""
    return F.when(c >= F.lit(floor), c)


def zero_filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def mean_skipping(c: Column) -> Column:
    return F.avg(c)


def mean_poisoned(c: Column) -> Column:
    """Mean that turns NULL as soon as one input of the group is missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def group_mean(c: Column, skip_nulls: bool = True) -> Column:
    return mean_skipping(c) if skip_nulls else mean_poisoned(c)

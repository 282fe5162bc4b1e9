"""Nearest-value joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.nulls import finite
from loamline.operators.pairing import BROADCAST_ROWS, fits
from loamline.operators.ranking import value_ranks

# The water-content grid, as integer steps of 0.0001.
GRID_PER_UNIT = 10_000
GRID_FIRST = 200
GRID_LAST = 4_399


def grid_index(
    x: Column, per_unit: int = GRID_PER_UNIT, first: int = GRID_FIRST, last: int = GRID_LAST
) -> Column:
    """Index of the nearest grid point; a tie goes to the lower one, ends are clamped.

    A missing value has no index (``least`` and ``greatest`` alone would pass over it).
    """
    near = F.ceil(F.round(x * F.lit(float(per_unit)) - F.lit(0.5), 6))
    clamped = F.greatest(F.lit(first), F.least(F.lit(last), near)).cast("int")
    return F.when(finite(x).isNotNull(), clamped)


def nearest_join(
    df: DataFrame, lookup: DataFrame, value: str, grid: str, cell: float
) -> DataFrame:
    """Nearest ``grid`` value for each ``value``; ties go to the lower grid value.

    A value that is NULL, NaN or infinite matches nothing.  Lookup rows with equal grid values
    all match, whatever the size of the lookup.
    A grid value owns the stretch between the midpoints to its neighbours.  Stretches are
    entered in cells of width ``cell``, and the join is an equi join on cells.  Values outside
    the grid's span are looked up in its end cells.  Neighbours come from one window while
    the lookup is small, else from ranks counted over the cluster.
    """
    owned = _with_neighbours(lookup, grid).select(
        *lookup.columns,
        ((F.col("below_") + F.col(grid)) / 2).alias("from_"),
        ((F.col(grid) + F.col("above_")) / 2).alias("to_"),
    )

    def cell_of(c: Column) -> Column:
        return F.floor(c / F.lit(cell))

    span = F.sequence(cell_of(F.coalesce("from_", grid)), cell_of(F.coalesce("to_", grid)))
    spread = owned.withColumn("cell_", F.explode(span))
    ends = lookup.agg(F.min(grid).alias("lo"), F.max(grid).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    # Each lookup row enters the cells of its stretch: at most two more than the stretch spans.
    if ends["n"] and 2 * ends["n"] + (ends["hi"] - ends["lo"]) / cell <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    known = finite(F.col(value))
    held = F.greatest(F.lit(ends["lo"]), F.least(F.lit(ends["hi"]), known))
    left = df.withColumn("cell_", F.when(known.isNotNull(), cell_of(held)))
    here = (
        (left["cell_"] == spread["cell_"])
        & (spread["from_"].isNull() | (left[value] > spread["from_"]))
        & (spread["to_"].isNull() | (left[value] <= spread["to_"]))
    )
    return left.join(spread, here, "left").drop("cell_", "from_", "to_")


def _with_neighbours(lookup: DataFrame, grid: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Neighbours among the distinct grid values, so that equal ones own the same stretch."""
    if fits(lookup, limit):
        order = Window.orderBy(grid)
        points = lookup.select(grid).where(F.col(grid).isNotNull()).distinct()
        beside = points.withColumn("below_", F.lag(grid).over(order)).withColumn("above_", F.lead(grid).over(order))
        return lookup.join(F.broadcast(beside), grid)
    ranks = value_ranks(lookup.select(F.lit(0).alias("all_"), grid), ["all_"], grid)
    below = ranks.select(F.col("past").alias("first"), F.col(grid).alias("below_"))
    above = ranks.select(F.col("first").alias("past"), F.col(grid).alias("above_"))
    beside = ranks.join(below, "first", "left").join(above, "past", "left").select(grid, "below_", "above_")
    return lookup.join(beside, grid)

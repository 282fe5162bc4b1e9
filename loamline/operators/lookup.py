"""Water-content to water-potential lookup table, and its use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import curves
from loamline.operators.held import HELD_DRAWS, grid_quantiles, group_sizes, worth_holding
from loamline.operators.nearest import GRID_FIRST, GRID_LAST, GRID_PER_UNIT, grid_index
from loamline.operators.pairing import BROADCAST_ROWS, fits, settled_small
from loamline.operators.ranking import exact_quantiles
from loamline.session import cut_lineage, task_width

# Quantiles kept, draws a grid point needs, and the calibrated range.
QUANTILES = {"q50": 0.5, "q25": 0.25, "q75": 0.75}
MIN_DRAWS = 1000
RANGE_LOW = 0.0439
RANGE_HIGH = 0.44
# Join keys over which rows without content are dealt.
SPREAD = 10_000
STATISTICS = {"median": "q50", "lower": "q25", "upper": "q75"}


def swc_grid(spark: SparkSession, first: int = GRID_FIRST, last: int = GRID_LAST) -> DataFrame:
    index = spark.range(first, last + 1).select(F.col("id").cast("int").alias("swc_idx"))
    return index.withColumn("swc", F.col("swc_idx") / F.lit(float(GRID_PER_UNIT)))


def inverse_curves(
    draws: DataFrame, first: int = GRID_FIRST, last: int = GRID_LAST, limit: int = BROADCAST_ROWS
) -> tuple[DataFrame, int]:
    """Suction of every draw at every grid point, and the most draws a group holds.

    The draws are settled once; counting and expanding then read the settled rows.

    With draws few enough to send everywhere the (grid point, group) cells are what gets
    distributed: all draws of a cell meet in one task and the aggregate that follows needs
    no shuffle.  With more draws these are dealt over all tasks and each is expanded over the
    grid in place.
    """
    wanted = _settled_curves(draws)
    # Every draw meets every grid point once, so draws per group bound the values per cell.
    most, _ = group_sizes(wanted)
    return _expanded(wanted, first, last, limit), most


def _settled_curves(draws: DataFrame) -> DataFrame:
    return cut_lineage(draws.select("grp", "alpha_cm", "n", "theta_r"))


def _expanded(wanted: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    suction = curves.suction_mpa(F.col("swc"), F.col("alpha_cm"), F.col("n"), F.col("theta_r")).alias("suction_mpa")
    index = F.explode(F.sequence(F.lit(first), F.lit(last)))
    swc = F.col("swc_idx") / F.lit(float(GRID_PER_UNIT))
    width = task_width(wanted.sparkSession)
    if fits(wanted, limit):
        points = wanted.select("grp").distinct().withColumn("swc_idx", index)
        spread = points.repartition(width, "swc_idx", "grp")
        # A NULL group is a group, as it is for the aggregate of the other form.
        met = spread.withColumnRenamed("grp", "cell_grp").join(F.broadcast(wanted), F.col("cell_grp").eqNullSafe(F.col("grp")))
        return met.withColumn("swc", swc).select("swc_idx", "swc", "grp", suction)
    # The settled draws lie in few small files, which few tasks would read and expand.
    return wanted.repartition(width).withColumn("swc_idx", index).withColumn("swc", swc).select("swc_idx", "swc", "grp", suction)


def lookup_quantiles(
    draws: DataFrame,
    first: int = GRID_FIRST,
    last: int = GRID_LAST,
    limit: int = BROADCAST_ROWS,
    held: int = HELD_DRAWS,
    **quantile_options,
) -> DataFrame:
    """Per grid point and group: draws with a defined suction, and its quartiles.

    Draws that are too many to be sent everywhere are summarised where a task holds its group's
    draws, up to ``held`` of them; options, larger groups and many small ones take the pairs
    through :func:`exact_quantiles`.
    """
    wanted = _settled_curves(draws)
    most, groups = group_sizes(wanted)
    if not quantile_options and worth_holding(wanted, most, groups, limit, held):
        found = grid_quantiles(wanted, groups, first, last, GRID_PER_UNIT, QUANTILES)
    else:
        quantile_options.setdefault("group_rows", most)
        pairs = _expanded(wanted, first, last, limit)
        found = exact_quantiles(pairs, ["swc_idx", "grp"], "suction_mpa", QUANTILES, **quantile_options)
    return found.withColumn("swc", F.col("swc_idx") / F.lit(float(GRID_PER_UNIT)))


def masked_lookup(
    quantiles: DataFrame, min_draws: int = MIN_DRAWS, mask: str = "site", site: str = "site"
) -> DataFrame:
    """Negate suction to potential, blank where too few draws are defined.

    ``mask="site"`` applies the site's count to all groups; ``"group"`` each group's own.
    The window holds one row per group of a grid point.
    """
    if mask == "group":
        judged = quantiles.withColumn("n_mask", F.col("n_ok"))
    elif mask == "site":
        site_n = F.max(F.when(F.col("grp") == site, F.col("n_ok")))
        judged = quantiles.withColumn("n_mask", site_n.over(Window.partitionBy("swc_idx")))
    else:
        raise ValueError(f"unknown mask {mask!r}")
    keep = F.col("n_mask") >= min_draws
    return judged.select(
        "swc_idx", "swc", "grp", "n_ok", *[F.when(keep, -F.col(q)).alias(q) for q in QUANTILES]
    )


def wide_lookup(lookup: DataFrame, groups: Sequence[str] = ("site", "S1", "S4")) -> DataFrame:
    """One row per grid point with three columns per group."""
    columns = [F.max(F.when(F.col("grp") == groups[0], F.col("n_ok"))).alias("n")]
    for g in groups:
        for q in QUANTILES:
            columns.append(F.max(F.when(F.col("grp") == g, F.col(q))).alias(f"{g}_{q}"))
    return lookup.groupBy("swc_idx", "swc").agg(*columns)


def out_of_range(swc: Column) -> Column:
    return (swc < F.lit(RANGE_LOW)) | (swc >= F.lit(RANGE_HIGH))


def convert(
    df: DataFrame,
    lookup: DataFrame,
    swc: str = "swc",
    param: str | Column = "site",
    stats: Sequence[str] = ("median",),
    strict: bool = False,
) -> DataFrame:
    """Add ``swp_<stat>`` (MPa) for each statistic, and ``out_of_range``.

    ``param`` is a group name, or a column naming the group of each row.  The lookup holds
    one row per grid point and group; it is settled and, within the row limit, broadcast, so
    the readings stay where they are in an equi join on (index, group).  "lower" is the 25th
    percentile of suction, hence the less negative potential.  NULL content gives NULL;
    ``strict`` also blanks content above the calibrated range.
    """
    group = F.lit(param) if isinstance(param, str) else param
    index = grid_index(F.col(swc))
    # Rows without content match nothing; negative keys deal them over all tasks.
    apart = (-1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SPREAD))).cast("int")
    keyed = df.withColumn("swc_idx_", F.coalesce(index, apart)).withColumn("grp_", group)
    side = lookup.select(
        F.col("swc_idx").alias("swc_idx_"),
        F.col("grp").alias("grp_"),
        *[F.col(STATISTICS[s]).alias(f"swp_{s}") for s in stats],
    )
    if isinstance(param, str):
        side = side.where(F.col("grp_") == param)
    out = keyed.join(settled_small(side), ["swc_idx_", "grp_"], "left").drop("swc_idx_", "grp_")
    out = out.withColumn("out_of_range", out_of_range(F.col(swc)))
    if strict:
        for s in stats:
            out = out.withColumn(f"swp_{s}", F.when(~F.col("out_of_range"), F.col(f"swp_{s}")))
    return out


def prediction_errors(predicted: DataFrame, keys: Sequence[str] = ("summer",)) -> DataFrame:
    """Predicted against observed potential per group."""
    miss = F.col("swp_median") - F.col("wp_mean")
    return predicted.groupBy(*keys).agg(
        F.count(miss).alias("n"),
        F.avg(miss).alias("bias"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(
            F.when(F.col("wp_mean").between(F.col("swp_upper"), F.col("swp_lower")), 1.0).when(
                F.col("swp_upper").isNotNull() & F.col("swp_lower").isNotNull(), 0.0
            )
        ).alias("coverage"),
    )

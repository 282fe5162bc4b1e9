"""Exact order statistics per group, also for groups no single task could hold.

Small groups are handled by one aggregate.  Beyond ``GROUP_ROWS`` values per group:

* Quantiles count values in narrow logarithmic bins first (counts combine map-side), then fetch
  only the bins that hold a wanted rank.  Values outside them are never shuffled.
* Shortest intervals, and bins that are themselves too large, rank all values: these are counted
  by distinct value (which removes heavy duplicates map-side), range-partitioned by (keys, value)
  over the cluster, ranked inside each slice and shifted by the totals of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.nulls import finite
from loamline.operators.pairing import broadcast_if_small, join_same
from loamline.session import cut_lineage, shuffle_width

# Values of one group an aggregation buffer may hold.
GROUP_ROWS = 100_000


def largest_group(df: DataFrame, keys: Sequence[str], value: str) -> int:
    row = df.where(F.col(value).isNotNull()).groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def _strategy(
    df: DataFrame, keys: Sequence[str], value: str, group_rows: int | None, limit: int, strategy: str, large: str
) -> str:
    if strategy != "auto":
        return strategy
    return large if (largest_group(df, keys, value) if group_rows is None else group_rows) > limit else "array"


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, slices: int | None = None, keep_empty: bool = False
) -> DataFrame:
    """Distinct values with the half-open rank range [``first``, ``past``) they cover.

    ``total`` is the number of values of the group.  The sliced table is written once, so
    slice totals and slice contents always describe the same cut.  ``keep_empty`` leaves
    missing values in as NULL with an empty range, so that groups without values stay.
    """
    keys = list(keys)
    source = df if keep_empty else df.where(F.col(value).isNotNull())
    counted = source.groupBy(*keys, value).agg(F.count(value).alias("copies"))
    width = slices or shuffle_width(df.sparkSession)
    sliced = cut_lineage(
        counted.repartitionByRange(width, *keys, value).withColumn("slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = (
        sliced.groupBy(*keys, "slice")
        .agg(F.sum("copies").alias("in_slice"))
        .select(
            *keys,
            "slice",
            F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("shift"),
            F.sum("in_slice").over(whole).alias("total"),
        )
    )
    upto = Window.partitionBy(*keys, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inner = sliced.withColumn("upto", F.sum("copies").over(upto))
    past = F.col("shift") + F.col("upto")
    return join_same(inner, totals, [*keys, "slice"]).select(
        *keys, value, (past - F.col("copies")).alias("first"), past.alias("past"), "total"
    )


def _between(lower: Column, upper: Column, fraction: Column) -> Column:
    return F.when(fraction == 0, lower).otherwise(lower + (upper - lower) * fraction)


def _moments(value: str) -> list[Column]:
    return [F.avg(value).alias("estimate"), F.stddev_samp(value).alias("std_error")]


def _packed(clean: DataFrame, keys: list[str], value: str, moments: bool) -> DataFrame:
    """Sorted values ``v`` of each group and their number ``n``; one pass, one shuffle."""
    also = _moments(value) if moments else []
    packed = clean.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"), *also)
    return packed.withColumn("n", F.size("v").cast("long"))


def _with_moments(found: DataFrame, clean: DataFrame, keys: list[str], value: str) -> DataFrame:
    return join_same(clean.groupBy(*keys).agg(*_moments(value)), found, keys)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    count_as: str = "n_ok",
    moments: bool = False,
    group_rows: int | None = None,
    limit: int = GROUP_ROWS,
    strategy: str = "auto",
) -> DataFrame:
    """Linearly interpolated quantiles of the non-missing values.

    ``group_rows`` is a known bound on values per group; without it the bound is measured.
    Groups without any value keep a row with count 0 and NULL quantiles.  ``moments`` adds
    mean and standard deviation.
    """
    keys = list(keys)
    clean = df.select(*keys, finite(F.col(value)).alias(value))
    way = _strategy(clean, keys, value, group_rows, limit, strategy, "binned")
    if way == "array":
        packed = _packed(clean, keys, value, moments)
        picks = []
        for name, p in probabilities.items():
            place = F.lit(p) * (F.col("n") - 1)
            low = F.floor(place)
            at = [F.get("v", c.cast("int")) for c in (low, F.ceil(place))]
            picks.append(F.when(F.col("n") > 0, _between(*at, place - low)).alias(name))
        also = ["estimate", "std_error"] if moments else []
        return packed.select(*keys, F.col("n").alias(count_as), *also, *picks)
    if way == "binned":
        found = _quantiles_by_bin(clean, keys, value, probabilities, count_as, limit)
    else:
        found = _quantiles_by_rank(clean, keys, value, probabilities, count_as)
    return _with_moments(found, clean, keys, value) if moments else found


def _places(probabilities: dict[str, float]) -> list[tuple[str, Column]]:
    """The two ranks around each quantile, as (column name, rank)."""
    out = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("total") - 1)
        out += [(f"{name}_lo", F.floor(place)), (f"{name}_hi", F.ceil(place))]
    return out


def _interpolated(probabilities: dict[str, float], count_as: str) -> list[Column]:
    out = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col(count_as) - 1)
        out.append(_between(F.col(f"{name}_lo"), F.col(f"{name}_hi"), place - F.floor(place)).alias(name))
    return out


def _quantiles_by_rank(
    clean: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], count_as: str
) -> DataFrame:
    ranks = value_ranks(clean, keys, value, keep_empty=True)
    picks = [
        F.max(F.when((F.col("first") <= at) & (at < F.col("past")), F.col(value))).alias(name)
        for name, at in _places(probabilities)
    ]
    found = ranks.groupBy(*keys).agg(F.max("total").alias(count_as), *picks)
    return found.select(*keys, count_as, *_interpolated(probabilities, count_as))


def _log_bin(c: Column, per_log: int = 64, offset: int = 50_000) -> Column:
    """Integer bins in the order of the values, 1/64 natural-log unit wide on either side of 0."""
    size = F.floor(F.lit(float(per_log)) * F.log(F.abs(c))) + F.lit(offset)
    return F.when(c > 0, size).when(c < 0, -size).when(c == 0, F.lit(0).cast("long"))


def _quantiles_by_bin(
    clean: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], count_as: str, limit: int
) -> DataFrame:
    binned = clean.withColumn("bin", _log_bin(F.col(value)))
    counted = cut_lineage(binned.groupBy(*keys, "bin").agg(F.count(value).alias("in_bin")))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counted.withColumn("past", F.sum("in_bin").over(upto))
        .withColumn("total", F.sum("in_bin").over(Window.partitionBy(*keys)))
        .withColumn("before", F.col("past") - F.col("in_bin"))
    )
    places = _places(probabilities)

    def inside(at: Column) -> Column:
        return (F.col("before") <= at) & (at < F.col("past"))

    wanted = F.col("total") == 0
    for _, at in places:
        wanted = wanted | inside(at)
    targets = cut_lineage(placed.where(wanted))
    largest = targets.agg(F.max("in_bin")).first()[0] or 0
    fetched = join_same(binned, broadcast_if_small(targets.select(*keys, "bin")), [*keys, "bin"], "left_semi")
    if largest <= limit:
        held = fetched.groupBy(*keys, "bin").agg(F.sort_array(F.collect_list(value)).alias("v"))
        # Held arrays weigh more than the planner takes from the source's files: never broadcast.
        rows = join_same(targets, held.hint("merge"), [*keys, "bin"], "left")
        picks = [
            F.max(F.when(inside(at), F.get("v", (at - F.col("before")).cast("int")))).alias(name) for name, at in places
        ]
    else:
        ranks = value_ranks(fetched, [*keys, "bin"], value).drop("total")
        within = ranks.withColumnRenamed("first", "first_in").withColumnRenamed("past", "past_in")
        rows = join_same(targets, within.hint("merge"), [*keys, "bin"], "left")
        picks = []
        for name, at in places:
            spot = at - F.col("before")
            here = inside(at) & (F.col("first_in") <= spot) & (spot < F.col("past_in"))
            picks.append(F.max(F.when(here, F.col(value))).alias(name))
    found = rows.groupBy(*keys).agg(F.max("total").alias(count_as), *picks)
    return found.select(*keys, count_as, *_interpolated(probabilities, count_as))


def shortest_intervals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    mass: float = 0.95,
    moments: bool = False,
    group_rows: int | None = None,
    limit: int = GROUP_ROWS,
    strategy: str = "auto",
) -> DataFrame:
    """Narrowest interval that spans round(n * mass) steps of the sorted values, half to even.

    Equal widths resolve to the lowest interval.
    """
    keys = list(keys)
    clean = df.select(*keys, finite(F.col(value)).alias(value)).where(F.col(value).isNotNull())
    if _strategy(clean, keys, value, group_rows, limit, strategy, "ranked") == "array":
        return _shortest_in_array(clean, keys, value, mass, moments)
    found = _shortest_by_rank(clean, keys, value, mass)
    return _with_moments(found, clean, keys, value) if moments else found


def _gap(n: Column, mass: float) -> Column:
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(mass)).cast("long")))


def _shortest_in_array(clean: DataFrame, keys: list[str], value: str, mass: float, moments: bool) -> DataFrame:
    packed = _packed(clean, keys, value, moments).withColumn("gap", _gap(F.col("n"), mass).cast("int"))
    uppers = F.slice(F.col("v"), F.col("gap") + 1, F.greatest(F.lit(1), F.col("n").cast("int") - F.col("gap")))
    spans = F.transform(
        uppers,
        lambda upper, i: F.struct(
            (upper - F.get("v", i.cast("int"))).alias("width"),
            F.get("v", i.cast("int")).alias("conf_low"),
            upper.alias("conf_high"),
        ),
    )
    only = F.get("v", F.lit(0))
    also = ["estimate", "std_error"] if moments else []
    best = packed.select(*keys, *also, F.when(F.col("n") > 1, F.array_min(spans)).alias("best"), only.alias("only"))
    return best.select(
        *keys,
        *also,
        F.coalesce(F.col("best.conf_low"), F.col("only")).alias("conf_low"),
        F.coalesce(F.col("best.conf_high"), F.col("only")).alias("conf_high"),
    )


def _shortest_by_rank(clean: DataFrame, keys: list[str], value: str, mass: float, block: int = 500_000) -> DataFrame:
    """Each distinct value opens an interval at its first rank and asks who sits ``gap`` ranks on.

    Questions and holders meet in rank blocks of fixed length; a holder that spans several
    blocks is entered in each, so a block needs no look outside itself.
    """
    ranks = value_ranks(clean, keys, value).withColumn("gap", _gap(F.col("total"), mass))
    holders = ranks.select(
        *keys,
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("past") - 1) / block))).alias("block"),
        F.col("first").alias("at"),
        F.lit(0).alias("asks"),
        F.col(value).alias("held"),
        F.lit(None).cast("double").alias("conf_low"),
    )
    target = F.least(F.col("first") + F.col("gap"), F.col("total") - 1)
    questions = ranks.where((F.col("first") + F.col("gap") < F.col("total")) | (F.col("total") == 1)).select(
        *keys,
        F.floor(target / block).alias("block"),
        target.alias("at"),
        F.lit(1).alias("asks"),
        F.lit(None).cast("double").alias("held"),
        F.col(value).alias("conf_low"),
    )
    upto = (
        Window.partitionBy(*keys, "block").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    )
    answered = (
        holders.unionByName(questions)
        .withColumn("conf_high", F.last("held", ignorenulls=True).over(upto))
        .where(F.col("asks") == 1)
    )
    span = F.struct((F.col("conf_high") - F.col("conf_low")).alias("width"), F.col("conf_low"), F.col("conf_high"))
    return answered.groupBy(*keys).agg(F.min(span).alias("best")).select(*keys, "best.conf_low", "best.conf_high")

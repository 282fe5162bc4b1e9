"""Frames in the engine's input shapes, derived from whole test tables.

Amounts are summed as integers wherever a later step depends on exact equality, so both
engines start from the same bits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import curves, labels
from loamline.operators import reshape, rollup, watering
from loamline.operators.calendar import with_season

# Calendar years of the two stand-in periods.
EVENT_YEARS = {"first_year": 2023, "last_year": 2024}
LINE_YEARS = {"first_year": 1994, "last_year": 2002}
VARIABLES = {"view": "VWC", "click": "SWP", "signup": "TS", "purchase": "T", "error": "RH"}
PRIORITIES = {"1-URGENT": "S1", "2-HIGH": "S2", "3-MEDIUM": "S3", "4-NOT SPECIFIED": "S4", "5-LOW": "W1"}
GROUPS = ("site", "S1", "S4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snap(c: Column | str) -> Column:
    """Six decimals; the nudge keeps exact decimal ties from depending on the engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3e-10), 6)


def snapped(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[snap(c).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.expr(
        """CASE WHEN event_id % 17 = 0 THEN NULL
                WHEN event_type = 'view' THEN value / 1000
                WHEN event_type = 'click' THEN -10 * value
                WHEN event_type = 'purchase' THEN value - 15
                WHEN event_type = 'error' THEN value % 100
                ELSE value END"""
    )
    out = e.select(
        F.col("ts").cast("timestamp_ntz").alias("dt"),
        F.to_date("ts").alias("date"),
        labels.mapped(F.col("event_type"), VARIABLES).alias("variable"),
        F.expr("CAST(user_id % 5 + 1 AS INT)").alias("house"),
        F.expr("CAST(user_id DIV 5 % 12 + 1 AS INT)").alias("plot"),
        F.expr("CAST(user_id DIV 60 % 3 + 1 AS INT)").alias("depth"),
        F.when(F.col("user_id") % 2 == 1, "inside").otherwise("outside").alias("location"),
        value.alias("value"),
    )
    place = labels.sensor_id(F.col("plot"), F.col("depth"), F.col("house"))
    named = F.when(F.col("variable") == "TS", place).otherwise(F.concat_ws("_", "variable", place))
    return out.withColumn("id", named)


def soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).where(F.col("variable").isin("VWC", "SWP", "TS"))


def bucketed(df: DataFrame, minutes: int) -> DataFrame:
    """``dt`` moved back to the start of its bucket."""
    past = (F.hour("dt") * 60 + F.minute("dt")).cast("int")
    start = (past - past % minutes).cast("int")
    return df.withColumn(
        "dt", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=start)
    )


def wide_soil_names(variables: tuple[str, ...]) -> list[str]:
    return [f"{v}_P{p}_{d}_H{h}" for v in variables for h in range(1, 6) for p in range(1, 13) for d in range(1, 4)]


def wide_soil(spark: SparkSession, sf_dir: str, variables: tuple[str, ...] = ("VWC", "SWP")) -> DataFrame:
    """Six-hourly means, one column per sensor of the 5 x 12 x 3 layout."""
    names = wide_soil_names(variables)
    long = bucketed(readings(spark, sf_dir).where(F.col("variable").isin(*variables)), 360)
    place = labels.sensor_id(F.col("plot"), F.col("depth"), F.col("house"), F.col("variable"))
    return long.withColumn("name", place).groupBy("dt", "date").pivot("name", names).agg(F.avg("value"))


def wide_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly air temperature and humidity per location."""
    long = bucketed(readings(spark, sf_dir).where(F.col("variable").isin("T", "RH")), 30)
    columns = [
        F.avg(F.when((F.col("variable") == v) & (F.col("location") == p), F.col("value"))).alias(f"{v}_{p}")
        for v in ("T", "RH")
        for p in ("inside", "outside")
    ]
    return long.groupBy("dt", "date").agg(*columns)


def air_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_air(reshape.air_long(rollup.clean_air(wide_air(spark, sf_dir))), **EVENT_YEARS)


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 x 12 layout, plot 12 of house 5 left out, with both treatments."""
    places = spark.range(60, numPartitions=1).selectExpr(
        "CAST(id DIV 12 + 1 AS INT) AS house", "CAST(id % 12 + 1 AS INT) AS plot"
    )
    return places.where(~((F.col("house") == 5) & (F.col("plot") == 12))).select(
        "house",
        "plot",
        F.concat(F.lit("W"), (F.col("plot") % 3 + 1).cast("string")).alias("winter"),
        F.concat(F.lit("S"), ((F.col("house") * 7 + F.col("plot")) % 4 + 1).cast("string")).alias("summer"),
    )


def _irrigation(orders: DataFrame, day: Column, per_mm: float) -> DataFrame:
    return (
        orders.select(day.alias("date"), labels.mapped(F.col("o_orderpriority"), PRIORITIES).alias("treatment"), cents("o_totalprice").alias("c"))
        .groupBy("date", "treatment")
        .agg(F.when(F.count(F.lit(1)) % 2 == 0, 0.0).otherwise(F.sum("c") / F.lit(per_mm)).alias("irrigation_mm"))
    )


def irrigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _irrigation(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), 1.0e7)


def folded(day: Column) -> Column:
    """A day moved into the 30 days the event stand-ins cover."""
    past = F.datediff(day, F.lit("1970-01-01").cast("date")) % 30
    return F.date_add(F.lit("2024-01-01").cast("date"), past.cast("int"))


def irrigation_jan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _irrigation(table(spark, sf_dir, "orders"), folded(F.to_date("o_orderdate")), 1.0e9)


def irrigation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        irrigation(spark, sf_dir)
        .groupBy("date")
        .pivot("treatment", list(PRIORITIES.values()))
        .agg(F.first("irrigation_mm"))
    )


def gauge_inches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, inches) per ship day; the first day appears once more without rain."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), cents("l_tax").alias("c"))
    days = lines.groupBy("date").agg((F.sum("c") / F.lit(1000.0)).alias("inches"))
    again = lines.agg(F.min("date").alias("date")).withColumn("inches", F.lit(0.0))
    return days.unionByName(again)


def rain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauge_inches(spark, sf_dir).select("date", (F.col("inches") * 25.4).alias("ppt_mm"))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watering.rain_before_roof(rain_all(spark, sf_dir), dt.date(1998, 6, 30))


def rain_jan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        folded(F.to_date("l_shipdate")).alias("date"), cents("l_tax").alias("c")
    )
    return lines.groupBy("date").agg((F.sum("c") / F.lit(1.0e4)).alias("ppt_mm"))


def watering_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watering.watering_table(irrigation(spark, sf_dir), rain(spark, sf_dir))


def watering_jan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watering.watering_table(irrigation_jan(spark, sf_dir), rain_jan(spark, sf_dir))


def _line_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor-days of the order lines: content from all, potential from shipped ones."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.expr("CAST(l_suppkey % 5 + 1 AS INT)").alias("house"),
        F.expr("CAST(l_partkey % 12 + 1 AS INT)").alias("plot"),
        F.expr("CAST(l_linenumber % 3 + 1 AS INT)").alias("depth"),
        F.col("l_quantity").alias("q"),
        F.when(F.col("l_linestatus") == "F", cents("l_extendedprice")).alias("c"),
    )
    days = lines.groupBy("house", "plot", "depth", "date").agg(
        (F.lit(0.05) + F.avg("q") / 200.0).alias("wc_mean"),
        (F.lit(0.05) + F.min("q") / 200.0).alias("wc_min"),
        (F.lit(0.05) + F.max("q") / 200.0).alias("wc_max"),
        (-F.avg("c") / 5.0e6).alias("wp_mean"),
        (-F.max("c") / 5.0e6).alias("wp_min"),
        (-F.min("c") / 5.0e6).alias("wp_max"),
    )
    layout = (
        (F.col("house") == 5) & (F.col("plot") == 12)
    )
    named = days.select(
        "*",
        F.when(~layout, F.concat(F.lit("S"), ((F.col("house") * 7 + F.col("plot")) % 4 + 1).cast("string"))).alias("summer"),
        F.when(~layout, F.concat(F.lit("W"), (F.col("plot") % 3 + 1).cast("string"))).alias("winter"),
        labels.plot_id(F.col("house"), F.col("plot")).alias("plot_id"),
    )
    return with_season(named, "date", **LINE_YEARS)


def wc_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_days(spark, sf_dir).drop("wp_mean", "wp_min", "wp_max")


def wp_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_days(spark, sf_dir).drop("wc_mean", "wc_min", "wc_max").where(F.col("wp_mean").isNotNull())


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.paired_days(wp_days(spark, sf_dir), wc_days(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content against suction per ship day, depth and treatment."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.expr("CAST(l_linenumber % 3 + 1 AS INT)").alias("depth"),
        F.when(F.col("l_returnflag") == "A", "S1").otherwise("S4").alias("summer"),
        F.col("l_quantity").alias("q"),
        cents("l_extendedprice").alias("c"),
    )
    days = lines.groupBy("date", "depth", "summer").agg(
        (F.lit(0.05) + F.avg("q") / 200.0).alias("theta"), (-F.avg("c") / 5.0e6).alias("wp_mean")
    )
    past = F.datediff("date", F.lit("1990-01-01").cast("date"))
    return days.select(
        (past * 100 + F.col("depth") * 10 + F.when(F.col("summer") == "S1", 1).otherwise(4)).cast("long").alias("obs_id"),
        "date",
        "depth",
        "summer",
        F.col("summer").alias("grp"),
        labels.joined_key(F.col("depth"), F.col("summer")).alias("trt"),
        "theta",
        "wp_mean",
        curves.suction_cm(F.col("wp_mean")).alias("h_cm"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw per (chain, supplier) for the site and for each treatment."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr("CAST(l_linenumber % 3 + 1 AS INT)").alias("chain"),
        F.col("l_suppkey").alias("iter"),
        F.explode(F.array(F.lit("site"), F.when(F.col("l_returnflag") == "A", "S1").otherwise("S4"))).alias("grp"),
        "l_partkey",
        F.col("l_quantity").cast("long").alias("q"),
        cents("l_extendedprice").alias("c"),
    )
    return lines.groupBy("chain", "iter", "grp").agg(
        (F.lit(0.01) + (F.sum("l_partkey") % 1900) / 10000.0).alias("alpha_cm"),
        (F.lit(1.2) + (F.sum("c") % 1500) / 1000.0).alias("n"),
        (F.lit(0.01) + (F.sum("q") % 400) / 10000.0).alias("theta_r"),
        (F.lit(0.005) + (F.count(F.lit(1)) % 50) / 1000.0).alias("sigma"),
    )


def wide_logger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly soil and air columns in one file, as the loggers write them."""
    air = ("T_inside", "T_outside", "RH_inside", "RH_outside")
    names = [*air, *wide_soil_names(("VWC", "SWP"))]
    long = bucketed(readings(spark, sf_dir).where(F.col("variable") != "TS"), 360)
    place = labels.sensor_id(F.col("plot"), F.col("depth"), F.col("house"), F.col("variable"))
    name = F.when(F.col("variable").isin("T", "RH"), F.concat_ws("_", "variable", "location")).otherwise(place)
    return long.withColumn("name", name).groupBy("dt", "date").pivot("name", names).agg(F.avg("value"))

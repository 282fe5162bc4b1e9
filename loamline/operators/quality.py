"""Regression, coverage, counts and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjusted_r2(y: str, x: str) -> Column:
    n = F.regr_count(y, x)
    return 1.0 - (1.0 - F.regr_r2(y, x)) * F.try_divide(n - 1, n - 2)


def regression(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        adjusted_r2(y, x).alias("adj_r2"),
    )


def covered(value: str = "theta", low: str = "conf_low", high: str = "conf_high") -> Column:
    return F.avg(F.when(F.col(value).between(F.col(low), F.col(high)), 1.0).otherwise(0.0))


def metrics_table(pred: DataFrame) -> DataFrame:
    """One row per treatment, and a row "all".

    Per treatment the estimate is regressed on the observation, overall the other way round.
    """
    def measures(y: str, x: str) -> list[Column]:
        return [adjusted_r2(y, x).alias("adj_r2"), covered().alias("coverage"), F.regr_slope(y, x).alias("slope")]

    per = pred.groupBy(F.col("trt").alias("type")).agg(*measures("estimate", "theta"))
    overall = pred.agg(*measures("theta", "estimate")).withColumn("type", F.lit("all"))
    return per.unionByName(overall)


def log_histogram(df: DataFrame, value: Column, low: float, high: float, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins of log10(value); bin 0 and bins + 1 hold the outside."""
    bucket = F.width_bucket(F.log10(value), F.lit(low), F.lit(high), F.lit(bins))
    step = (high - low) / bins
    return (
        df.select(bucket.alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("log_from", F.lit(low) + F.lit(step) * (F.col("bin") - 1))
    )


def group_sizes(df: DataFrame, keys: Sequence[str], distinct: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(distinct).alias("n_distinct"))

"""Wide-to-long, long-to-wide, replication and projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import labels

# How sensor columns are named.
SOIL_TEMPERATURE_NAME = r"TS_P(\d+)_(\d+)_H(\d+)"
SOIL_SENSOR_NAME = r"([A-Z]+)_P(\d+)_(\d+)_H(\d+)"
AIR_NAME = r"([A-Z]+)_(inside|outside)"
STATISTIC_NAME = r"([A-Za-z]+)_(mean|min|max)"


def unpivot_by_name(
    df: DataFrame, ids: Sequence[str], pattern: str, keys: dict[str, Callable], value: str = "value"
) -> DataFrame:
    """Columns whose name matches ``pattern`` become rows; capture groups become key columns.

    Names are taken apart once when the plan is built.  A row carries its position among the
    matched columns and reads its keys from constant arrays, so no regular expression runs
    per reading.  A narrow step without shuffle; NULLs are kept.
    """
    hits = [(c, re.fullmatch(pattern, c)) for c in df.columns if c not in ids]
    hits = [(c, hit.groups()) for c, hit in hits if hit]
    if not hits:
        raise ValueError(f"no column matches {pattern}")
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c, _ in hits])
    long = df.select(*ids, F.posexplode(cells).alias("pos_", value))
    parts = [
        F.get(F.array(*[F.lit(cast(groups[i])) for _, groups in hits]), F.col("pos_")).alias(key)
        for i, (key, cast) in enumerate(keys.items())
    ]
    return long.select(*ids, *parts, value)


def soil_temperature_long(wide: DataFrame) -> DataFrame:
    long = unpivot_by_name(wide, ["dt", "date"], SOIL_TEMPERATURE_NAME, {"plot": int, "depth": int, "house": int})
    return long.withColumn("variable", F.lit("TS")).withColumn(
        "id", labels.sensor_id(F.col("plot"), F.col("depth"), F.col("house"))
    )


def soil_sensors_long(wide: DataFrame) -> DataFrame:
    keys = {"variable": str, "plot": int, "depth": int, "house": int}
    long = unpivot_by_name(wide, ["dt", "date"], SOIL_SENSOR_NAME, keys)
    return long.withColumn(
        "id", labels.sensor_id(F.col("plot"), F.col("depth"), F.col("house"), F.col("variable"))
    )


def air_long(wide: DataFrame) -> DataFrame:
    return unpivot_by_name(wide, ["dt", "date"], AIR_NAME, {"variable": str, "location": str})


def treatments_long(wide: DataFrame, treatments: Sequence[str] | None = None) -> DataFrame:
    """(date, treatment, irrigation_mm) with blank cells removed."""
    names = list(treatments or [c for c in wide.columns if c != "date"])
    return wide.unpivot(["date"], names, "treatment", "irrigation_mm").where(F.col("irrigation_mm").isNotNull())


def statistics_long(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return unpivot_by_name(df, ids, STATISTIC_NAME, {"variable": str, "type": str})


def statistics_wide(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Back to one column per statistic; of repeated cells the largest value stays."""
    wide = df.groupBy(*ids).pivot("type", ["mean", "min", "max"]).agg(F.max("value"))
    return wide


def variables_wide(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """One column per variable at the grain of ``ids``; of repeated cells the largest value stays."""
    return df.groupBy(*ids).pivot("variable", list(variables)).agg(F.max("value"))


def chosen_treatment(df: DataFrame, column: str) -> DataFrame:
    """The chosen design column becomes ``treatment``."""
    return df.withColumn("treatment", F.col(column)).drop(column)


def replicated(df: DataFrame, name: str, keys: Sequence) -> DataFrame:
    """Every row once per key; a narrow step."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(k) for k in keys])))


def offset_days(df: DataFrame, last_offset: int, date: str = "date", offset: str = "offset") -> DataFrame:
    """An event row becomes its own day and the ``last_offset`` days after it."""
    days = df.withColumn(offset, F.explode(F.sequence(F.lit(0), F.lit(last_offset))))
    return days.withColumn(date, F.date_add(F.col(date), F.col(offset)))


def with_prefix(df: DataFrame, prefix: str, *also: str) -> DataFrame:
    """Keep ``also`` and the columns starting with ``prefix``."""
    return df.select(*also, *[F.col(f"`{c}`") for c in df.columns if c.startswith(prefix) and c not in also])


def moved_first(df: DataFrame, *front: str) -> DataFrame:
    return df.select(*front, *[c for c in df.columns if c not in front])


def union_on_common(*frames: DataFrame) -> DataFrame:
    """Bag union on the columns all frames share."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def concatenated(parts: dict[int, DataFrame], name: str = "chain") -> DataFrame:
    """Frames appended with their key as a literal column."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn(name, F.lit(k)) for k, f in parts.items()])


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def first_row(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys).limit(1)

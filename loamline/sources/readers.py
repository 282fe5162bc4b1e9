"""Readers for the raw CSV inputs; columns are bound by the names in each file's header."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions import labels, timekeys, units
from loamline.sources.headers import files_by_header

# The time column of a logger or gauge file.
TIME_COLUMN = "TIMESTAMP"


def read_named(
    spark: SparkSession,
    paths: str | Iterable[str],
    required: Mapping[str, T.DataType],
    others: T.DataType | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """CSV files or folders of them, each file's columns bound by its own header.

    Files with one header are one scan. A file that lacks a ``required`` column fails the call by
    name, unless ``exclude`` matches it; see :func:`headers.probe_headers`. Other columns are read
    with type ``others``, where given, and are NULL in files without them.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for names, files in files_by_header(spark, given, list(required), exclude).items():
        fields = [T.StructField(c, required.get(c, others or T.StringType())) for c in names]
        raw = spark.read.csv(files, header=True, schema=T.StructType(fields), nullValue="NA", enforceSchema=False)
        kept = [c for c in names if c in required or others is not None]
        frames.append(raw.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def logger_time(text: Column, formats: Sequence[str] = ()) -> Column:
    """A zoneless timestamp; a day alone is its midnight.

    Without ``formats`` ISO forms are read, else the first format that fits. Text that none fits
    fails the job, naming the text: no reading loses its time silently.
    """
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    parsed = F.coalesce(*tried) if tried else text.try_cast("timestamp_ntz")
    lost = F.raise_error(F.concat(F.lit("no time: "), text)).cast("timestamp_ntz")
    return F.when(parsed.isNull() & text.isNotNull(), lost).otherwise(parsed)


def read_wide_sensors(
    spark: SparkSession,
    paths: str | Iterable[str],
    drop: tuple[str, ...] = ("X",),
    time_formats: Sequence[str] = (),
    exclude: str | None = None,
) -> DataFrame:
    """Wide logger files: ``dt``, ``date`` and one double column per sensor.

    Sensors may change places, come or go between files; one that a file lacks is NULL there. A file
    without a time column fails the call unless the pattern ``exclude`` names it.
    """
    raw = read_named(spark, paths, {TIME_COLUMN: T.StringType()}, T.DoubleType(), exclude)
    sensors = [F.col(f"`{c}`") for c in raw.columns if c != TIME_COLUMN and c not in drop]
    timed = raw.select(logger_time(F.col(TIME_COLUMN), time_formats).alias("dt"), *sensors)
    return timed.select("dt", F.to_date("dt").alias("date"), *sensors)


def read_irrigation(spark: SparkSession, path: str | Iterable[str], exclude: str | None = None) -> DataFrame:
    """Wide irrigation events: ``date`` plus one amount column per treatment, blanks NULL."""
    raw = read_named(spark, path, {"date": T.StringType()}, T.DoubleType(), exclude)
    return raw.withColumn("date", timekeys.slash_day(F.col("date")))


def read_gauge(spark: SparkSession, path: str | Iterable[str], exclude: str | None = None) -> DataFrame:
    """Rain gauge as (date, ppt_mm)."""
    raw = read_named(spark, path, {TIME_COLUMN: T.StringType(), "Rainfall (inch)": T.DoubleType()}, None, exclude)
    return raw.select(
        timekeys.gauge_day(F.col(TIME_COLUMN)).alias("date"),
        units.inch_to_mm(F.col("Rainfall (inch)")).alias("ppt_mm"),
    )


def read_design(spark: SparkSession, path: str | Iterable[str], exclude: str | None = None) -> DataFrame:
    """House x plot design with the ordinal of each treatment level."""
    number, text = T.IntegerType(), T.StringType()
    raw = read_named(spark, path, {"House": number, "Plot": number, "Winter": text, "Summer": text}, None, exclude)
    return raw.select(
        F.col("House").alias("house"),
        F.col("Plot").alias("plot"),
        F.col("Winter").alias("winter"),
        F.col("Summer").alias("summer"),
        labels.level_index(F.col("Winter"), labels.WINTER_LEVELS).alias("winter_ord"),
        labels.level_index(F.col("Summer"), labels.SUMMER_LEVELS).alias("summer_ord"),
    )

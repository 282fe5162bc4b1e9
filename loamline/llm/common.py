"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamline.session import ship_package

TEXT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the package is handed to the workers that will process it."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def modest_batches(spark: SparkSession) -> None:
    """Rows that Spark hands to Python at a time, for tables of whole texts.

    The default suits short rows; with texts a batch would hold tens of MB, several times over, in
    every task. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def carried(df: DataFrame, keep: Sequence[str], last: Column) -> DataFrame:
    """Columns ``keep`` and ``last`` under names of their own, whatever the caller's are."""
    return df.select(*[quoted(c).alias(f"keep_{i}") for i, c in enumerate(keep)], last.alias("last"))


def made_schema(df: DataFrame, keep: Sequence[str], **new: Column) -> StructType:
    """Schema of columns ``keep`` and new ones, whose names are lengthened where they are taken."""
    kept = df.select(*map(quoted, keep))
    for name, kind in new.items():
        kept = kept.withColumn(free_name(kept, name), kind)
    return kept.schema

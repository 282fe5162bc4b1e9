"""Prepared tables between stages, kept in versions, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from loamline import storage

# Names the version that readers take; hidden from Spark's file listing.
POINTER = "_current"


def version_names(spark: SparkSession, path: str) -> list[str]:
    """Folders of all versions, finished or not, oldest first."""
    names = [n for n in storage.children(spark, path) if n.startswith("v") and n[1:].isdigit()]
    return sorted(names, key=lambda n: int(n[1:]))


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that was finished last; None where the table has no versions."""
    pointer = f"{path.rstrip('/')}/{POINTER}"
    return storage.read_text(spark, pointer).strip() if storage.exists(spark, pointer) else None


def save_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), keep: int = 1
) -> str:
    """Parquet, optionally partitioned, as a new version of the table at ``path``; returns its name.

    Rows are brought together per partition value and sorted inside the files so that row-group
    statistics prune range filters. The pointer moves only after the write has finished: until then,
    and after a crash, readers get the version before. ``keep`` versions before the new one stay for
    readers that have begun; older ones and remains of crashed writes are deleted. One writer at a
    time; the frame may read the table's own current version.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before, names = current_version(spark, path), version_names(spark, path)
    version = f"v{int(names[-1][1:]) + 1 if names else 1:06d}"
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{version}")
    storage.swap_text(spark, f"{path}/{POINTER}", version)
    finished = [n for n in names if before is not None and int(n[1:]) <= int(before[1:])]
    stay = set(finished[-keep:]) if keep else set()
    for name in names:
        if name not in stay:
            storage.delete(spark, f"{path}/{name}")
    return version


def load_table(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The current version of a saved table, or a named one; a folder without versions as it is."""
    path = path.rstrip("/")
    version = version or current_version(spark, path)
    return spark.read.parquet(f"{path}/{version}" if version else path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)

"""Headers of many CSV files, found from the first bytes of each.

Files are listed once, as they must be to plan a scan, and only files with one header are scanned
together.
"""

from __future__ import annotations

import csv
import fnmatch
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from loamline import storage


class LoggerFile(NamedTuple):
    """A listed file, its column names, and why it is left out; None for a file that is read."""

    file: str
    names: tuple[str, ...] | None
    left_out: str | None


def probe_headers(
    spark: SparkSession, paths: Sequence[str], required: Sequence[str], exclude: str | None = None
) -> list[LoggerFile]:
    """Every file at or below ``paths``, in their order, with its column names or why it is left out.

    The header is the first line that is not blank. A file is left out if its name or path matches
    the shell pattern ``exclude``, or if it is empty or lacks a ``required`` column.
    """
    files = storage.listed(spark, list(paths))
    named = [f for f in files if exclude and any(fnmatch.fnmatch(n, exclude) for n in (f, f.rsplit("/", 1)[-1]))]
    asked = [f for f in files if f not in set(named)]
    lines = dict(zip(asked, storage.first_lines(spark, asked), strict=True))
    out = []
    for file in files:
        line = lines.get(file)
        if file in named:
            out.append(LoggerFile(file, None, f"matches {exclude}"))
        elif line is None:
            out.append(LoggerFile(file, None, "empty"))
        else:
            names = tuple(next(csv.reader([line])))
            lacks = [c for c in required if c not in names]
            out.append(LoggerFile(file, names, f"no column {', '.join(lacks)}" if lacks else None))
    return out


def files_left_out(
    spark: SparkSession, paths: Sequence[str], required: Sequence[str], exclude: str | None = None
) -> DataFrame:
    """(file, reason) of the files that a read would leave out or fail on."""
    probed = probe_headers(spark, paths, required, exclude)
    rows = [(f.file, f.left_out) for f in probed if f.left_out]
    return spark.createDataFrame(rows, "file string, reason string")


def files_by_header(
    spark: SparkSession, paths: Sequence[str], required: Sequence[str], exclude: str | None = None
) -> dict[tuple[str, ...], list[str]]:
    """Files to read, grouped by header; fails with the names of all files that cannot be read.

    Empty files have nothing to lose and are left out, as are those that ``exclude`` matches.
    """
    probed = probe_headers(spark, paths, required, exclude)
    bad = [f"{f.file} ({f.left_out})" for f in probed if f.names is not None and f.left_out]
    if bad:
        raise ValueError("cannot read " + ", ".join(bad))
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in probed:
        if f.left_out is None:
            groups.setdefault(f.names, []).append(f.file)
    if not groups:
        raise ValueError(f"no file with columns {', '.join(required)}")
    return groups

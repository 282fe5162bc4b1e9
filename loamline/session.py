"""Session settings, the shared folder, and the log of tables written below it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline import storage


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one it hands out."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loamline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Keep per-group arrays in the hash aggregate instead of re-sorting its input.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once an application.

    Workers then find it wherever the driver was started from. The driver builds a small archive of
    the sources; Spark distributes it.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loamline-"), "loamline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="loamline-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for an intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass
class Settled:
    """One written intermediate table.

    ``state`` goes from "writing" to "ready" to "released"; a failed write stays "writing". ``rows``
    and ``size``, an estimate of its bytes in memory, are observed while it is written.
    """

    path: str
    owner: str
    state: str = "writing"
    rows: int = 0
    size: int = 0
    facts: dict = field(default_factory=dict)


# Tables by application, in the order of writing; and the table behind a frame that was handed out.
_LOG: dict[str, list[Settled]] = {}
_BEHIND: weakref.WeakKeyDictionary[DataFrame, Settled] = weakref.WeakKeyDictionary()
_OWNERS: list[str] = []
_SHIPPED: set[str] = set()


def settled_tables(spark: SparkSession, owner: str | None = None, state: str | None = None) -> list[Settled]:
    """The log of this application, oldest table first."""
    log = _LOG.get(spark.sparkContext.applicationId, [])
    return [t for t in log if owner in (None, t.owner) and state in (None, t.state)]


def row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory: eight bytes a value, and what strings and arrays hold."""
    total = F.lit(8 * len(schema))
    for f in schema:
        name = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            held = F.octet_length(name)
        elif isinstance(f.dataType, T.ArrayType | T.MapType):
            held = F.size(name) * 16
        else:
            continue
        total = total + F.greatest(F.coalesce(held, F.lit(0)), F.lit(0))
    return total.cast("long")


def cut_lineage(df: DataFrame, **facts: Column) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    A written table is computed once, survives lost executors, and gives the planner a true
    size and column pruning. Its rows, its size and ``facts``, aggregates over it, are observed on
    the way, so that nobody has to count it again. It stays in the log until it is released.
    """
    spark = df.sparkSession
    table = Settled(scratch_path(spark, "settled"), _OWNERS[-1] if _OWNERS else "")
    log = _LOG.setdefault(spark.sparkContext.applicationId, [])
    if not log:
        atexit.register(_at_exit, spark)
    log.append(table)
    seen = Observation()
    size = F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("rows_"), size.alias("size_"), *[c.alias(n) for n, c in facts.items()]
    )
    watched.write.parquet(table.path)
    got = seen.get
    table.rows, table.size = got.pop("rows_", 0), got.pop("size_", 0)
    table.facts, table.state = got, "ready"
    out = spark.read.schema(df.schema).parquet(table.path)
    _BEHIND[out] = table
    return out


def table_behind(df: DataFrame) -> Settled | None:
    """The settled table that ``df`` reads, if it is the frame :func:`cut_lineage` gave."""
    return _BEHIND.get(df)


def release(spark: SparkSession, owner: str | None = None) -> int:
    """Delete settled tables, all or those of one owner; frames that read them end with it."""
    tables = [t for t in settled_tables(spark, owner) if t.state != "released"]
    for table in tables:
        _delete(spark, table)
    return len(tables)


def release_frames(*frames: DataFrame | None) -> None:
    """Delete the tables behind these frames; frames that read none are left alone."""
    for frame in frames:
        table = None if frame is None else _BEHIND.get(frame)
        if table is not None and table.state == "ready":
            _delete(frame.sparkSession, table)


@contextmanager
def owned_by(owner: str) -> Iterator[str]:
    """Tables settled inside belong to ``owner``."""
    _OWNERS.append(owner)
    try:
        yield owner
    finally:
        _OWNERS.pop()


@contextmanager
def temporary_tables(spark: SparkSession, name: str) -> Iterator[list[DataFrame]]:
    """Delete all tables settled inside but those behind the frames put into the yielded list."""
    kept: list[DataFrame] = []
    owner = f"{_OWNERS[-1] + '/' if _OWNERS else ''}{name}-{uuid.uuid4().hex[:8]}"
    try:
        with owned_by(owner):
            yield kept
    finally:
        stay = {id(_BEHIND[f]) for f in kept if f in _BEHIND}
        for table in settled_tables(spark, owner):
            if id(table) in stay:
                table.owner = _OWNERS[-1] if _OWNERS else ""
            elif table.state != "released":
                _delete(spark, table)


def _delete(spark: SparkSession, table: Settled) -> None:
    storage.delete(spark, table.path)
    table.state = "released"


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_width(spark: SparkSession) -> int:
    """Tasks for a step whose work grows far beyond its input.

    Given as a number, so that adaptive execution does not merge small inputs into one task.
    """
    return max(shuffle_width(spark), spark.sparkContext.defaultParallelism)

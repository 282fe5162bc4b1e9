"""Every-row-with-every-row products, kept distributed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import cut_lineage, row_bytes, shuffle_width, table_behind, task_width

# Rows a side may have to be sent whole to every executor, and what they may take in memory.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows and BROADCAST_BYTES.

    A settled frame was measured when it was written; another one is settled by the caller first or
    counted here, rows and bytes in one pass.
    """
    table = table_behind(df)
    if table is not None:
        return table.rows <= limit and table.size <= BROADCAST_BYTES
    held = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("size")).first()
    return held["n"] <= limit and held["size"] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only after rows and bytes were checked."""
    return F.broadcast(df) if fits(df, limit) else df


def settled_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A derived side table, computed once, then broadcast if its rows fit.

    For sides whose source tables are large while they themselves are not: without it the
    planner sees only the sources' size and shuffles the big side of the join.
    """
    return broadcast_if_small(cut_lineage(df), limit)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL, keeping the left side's key columns."""
    renamed = right.select(*[F.col(c).alias(f"{c}_same_") if c in keys else F.col(c) for c in right.columns])
    hit = F.lit(True)
    for key in keys:
        hit = hit & left[key].eqNullSafe(renamed[f"{key}_same_"])
    return left.join(renamed, hit, how).drop(*[f"{k}_same_" for k in keys])


def pair_rows(
    left: DataFrame, right: DataFrame, on: Sequence[str], limit: int = BROADCAST_ROWS, width: int | None = None
) -> DataFrame:
    """Equi join on ``on`` where each key may hold many rows on both sides.

    A right side within ``limit`` rows is broadcast.  With a larger one the left side is settled
    and, within the limit, broadcast to the right side's rows, which are dealt over all tasks.
    Otherwise the right side is cut into blocks, the left side into slices, and block x slice
    cells are joined: each pair meets in exactly one cell, and no key is bound to a single task.
    """
    if fits(right, limit):
        return left.join(F.broadcast(right), list(on))
    left = left if table_behind(left) is not None else cut_lineage(left)
    if fits(left, limit):
        return F.broadcast(left).join(right.repartition(task_width(left.sparkSession)), list(on))
    rows = table_behind(right).rows if table_behind(right) is not None else right.count()
    blocks = math.ceil(rows / limit)
    width = width or shuffle_width(left.sparkSession)
    slices = max(1, math.ceil(width / blocks))
    cut_left = left.withColumn("slice_", F.pmod(F.xxhash64(*left.columns), F.lit(slices))).withColumn(
        "block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    )
    cut_right = right.withColumn("block_", F.pmod(F.xxhash64(*right.columns), F.lit(blocks))).withColumn(
        "slice_", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>"))
    )
    # The planner takes a side's size from its files, without the copies: unhinted it may broadcast these.
    return cut_left.join(cut_right.hint("merge"), [*on, "slice_", "block_"]).drop("slice_", "block_")

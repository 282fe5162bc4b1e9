"""Interval joins through an index of cells.

Time is cut into cells of one width. An interval is listed under each cell it touches, a point under
its own, so the join is an equi join on cells; inside a cell the bounds are then tested exactly. An
interval that would touch many cells is listed under wider ones instead, so the index has a bounded
number of rows an interval, whatever its span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.operators.pairing import fits
from loamline.session import cut_lineage, table_behind

WIDTHS = ("hour", "day", "month", "year")
# Cells an interval may touch before it moves to the next width.
MOST_CELLS = 100


def cell(moment: Column, width: str) -> Column:
    """Number of the cell that holds a date or timestamp; never falls while time moves on."""
    if width == "hour":
        return F.unix_date(F.to_date(moment)) * 24 + F.hour(moment)
    if width == "day":
        return F.unix_date(F.to_date(moment))
    if width == "month":
        return F.year(moment) * 12 + F.month(moment)
    if width == "year":
        return F.year(moment)
    raise ValueError(f"unknown cell width {width!r}")


def interval_cells(intervals: DataFrame, st: str = "st", en: str = "en", width: str = "day") -> DataFrame:
    """The index: one row per interval and cell, with ``width_`` (its place in WIDTHS) and ``cell_``.

    Intervals with a NULL bound or with ``en`` before ``st`` hold no moment and are left out.
    """
    first = WIDTHS.index(width)
    held = intervals.where(F.col(st) <= F.col(en))
    level, cells = None, None
    for k in range(first, len(WIDTHS)):
        a, b = cell(F.col(st), WIDTHS[k]), cell(F.col(en), WIDTHS[k])
        fit = F.lit(True) if k == len(WIDTHS) - 1 else b - a < MOST_CELLS
        level = F.when(fit, F.lit(k)) if level is None else level.when(fit, F.lit(k))
        cells = F.when(fit, F.sequence(a, b)) if cells is None else cells.when(fit, F.sequence(a, b))
    return held.withColumn("width_", level).withColumn("cell_", F.explode(cells))


def join_intervals(
    points: DataFrame,
    intervals: DataFrame,
    at: str = "date",
    keys: Sequence[str] = (),
    how: str = "left",
    st: str = "st",
    en: str = "en",
    width: str = "day",
    keep_bounds: bool = False,
) -> DataFrame:
    """Each point with the intervals that hold it, both bounds included.

    Equals the range predicate ``st <= at AND at <= en`` with equal, non-NULL ``keys``: a NULL
    moment, bound or key and a reversed interval match nothing, overlapping intervals give a row
    each. Bounds and moments may be dates or timestamps. ``how`` is "left", "inner", "semi" or "anti".
    ``width`` should be near the length of the intervals; it changes the speed alone.

    The index is written once. It is broadcast if it was measured to be small; otherwise both sides
    are shuffled by key and cell, and adaptive execution splits a cell that holds too many points.
    """
    if how not in ("left", "inner", "semi", "anti"):
        raise ValueError(f"unknown join {how!r}")
    labels = [c for c in intervals.columns if c not in (*keys, st, en)]
    shown = [*labels, *((st, en) if keep_bounds else ())] if how in ("left", "inner") else []
    clash = sorted({c.lower() for c in shown} & {c.lower() for c in points.columns})
    if clash:
        raise ValueError(f"both sides have a column {clash[0]!r}")
    names = {c: f"{c}_of_interval_" for c in (*keys, st, en)}
    renamed = intervals.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in intervals.columns])
    used = F.sort_array(F.collect_set("width_"))
    index = cut_lineage(interval_cells(renamed, names[st], names[en], width), widths_=used)
    levels = list(table_behind(index).facts.get("widths_") or []) or [WIDTHS.index(width)]
    side = F.broadcast(index) if fits(index) else index

    def meets(level: int, rows: DataFrame) -> Column:
        hit = (side["width_"] == level) & (side["cell_"] == cell(rows[at], WIDTHS[level]))
        for key in keys:
            hit = hit & (rows[key] == side[names[key]])
        return hit & (rows[at] >= side[names[st]]) & (rows[at] <= side[names[en]])

    columns = [points[c] for c in points.columns]
    found = [side[c].alias(c) for c in labels]
    if keep_bounds:
        found += [side[names[st]].alias(st), side[names[en]].alias(en)]
    if how in ("semi", "anti") or (how == "left" and len(levels) > 1):
        bare = points
        for level in levels:
            bare = bare.join(side, meets(level, bare), "left_anti")
        if how == "anti":
            return bare
    if how == "semi":
        parts = [points.join(side, meets(levels[0], points), "left_semi")]
        rest = points
        for before, level in zip(levels, levels[1:], strict=False):
            rest = rest.join(side, meets(before, rest), "left_anti")
            parts.append(rest.join(side, meets(level, rest), "left_semi"))
        return _stacked(parts)
    if len(levels) == 1:
        return points.join(side, meets(levels[0], points), how).select(*columns, *found)
    parts = [points.join(side, meets(level, points), "inner").select(*columns, *found) for level in levels]
    if how == "left":
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in parts[0].schema.fields[len(columns) :]]
        parts.append(bare.select("*", *nothing))
    return _stacked(parts)


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

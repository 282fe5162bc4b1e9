"""Order statistics over all draws of a group, which one task holds as arrays.

Every draw of a group meets every grid point or observation, so the pairs by far outnumber both
sides.  Draws are sent to cells of (group, slice); a cell holds the draws of its group once, makes
the values of one point after the other and keeps their summary alone: pairs are neither shuffled
nor written, and nothing passes the driver.  A cell holds at most ``HELD_DRAWS`` draws; larger
groups take the forms of :mod:`loamline.operators.ranking`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.curves import LARGE_EXPONENT, SCALE, THETA_S
from loamline.functions.units import PASCAL_PER_CM_WATER, PASCAL_PER_MPA
from loamline.operators.pairing import BROADCAST_ROWS, fits
from loamline.operators.ranking import GROUP_ROWS
from loamline.session import ship_package, table_behind, task_width

# Draws of one group that a task may hold.
HELD_DRAWS = 2_000_000
# Draws a group must hold on average: a point takes about as long as some hundred draws.
HELD_LEAST = 1_000
# Cells per task slot, so that slots finish at about the same time.
CELLS_PER_SLOT = 8
# Draws evaluated at a time.
CHUNK = 1 << 14

# Values to numbers: the summary of the values of one point.
Summary = Callable[[np.ndarray], list]


def group_sizes(draws: DataFrame) -> tuple[int, int]:
    """The most draws a group holds, and the number of groups."""
    row = draws.groupBy("grp").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    return row["most"] or 0, row["groups"]


def worth_holding(settled: DataFrame, most: int, groups: int, limit: int = BROADCAST_ROWS, held: int = HELD_DRAWS) -> bool:
    """Whether settled draws are too many to be sent everywhere, or for one aggregate, and groups fit a task."""
    large = not fits(settled, limit) or most > GROUP_ROWS
    return large and most <= held and table_behind(settled).rows >= HELD_LEAST * groups


def _slices(draws: DataFrame, groups: int) -> int:
    return max(1, math.ceil(CELLS_PER_SLOT * draws.sparkSession.sparkContext.defaultParallelism / max(1, groups)))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(task_width(df.sparkSession), "grp", "slice_")


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _chunks(size: int) -> Iterator[slice]:
    return (slice(at, min(size, at + CHUNK)) for at in range(0, size, CHUNK))


def suction_values(theta: float, alpha: np.ndarray, n: np.ndarray, theta_r: np.ndarray) -> np.ndarray:
    """:func:`loamline.functions.curves.suction_mpa` over arrays; NaN where that is NULL."""
    out = np.full(len(alpha), np.nan)
    if theta > THETA_S:
        return out
    with np.errstate(all="ignore"):
        for part in _chunks(len(alpha)):
            at = np.flatnonzero((theta > theta_r[part]) & (n[part] > 1.0) & (alpha[part] > 0.0)) + part.start
            a, m, r = alpha[at], n[at], theta_r[at]
            power = np.log((THETA_S - r) / (theta - r)) * (m / (m - 1.0))
            root = 1.0 / m
            value = np.power(np.exp(np.minimum(power, LARGE_EXPONENT)) - 1.0, root) / a * PASCAL_PER_CM_WATER / PASCAL_PER_MPA
            far = np.flatnonzero(power >= LARGE_EXPONENT)
            large = np.exp(power[far] * root[far]) / SCALE / a[far]
            value[far] = large * PASCAL_PER_CM_WATER / PASCAL_PER_MPA * SCALE
            out[at] = value
    return out


def content_values(h_cm: float, alpha: np.ndarray, n: np.ndarray, theta_r: np.ndarray) -> np.ndarray:
    """:func:`loamline.functions.curves.water_content` over arrays."""
    with np.errstate(divide="raise"):
        power = 1.0 / n - 1.0
    with np.errstate(all="ignore"):
        return theta_r + (THETA_S - theta_r) * np.power(1.0 + np.power(alpha * h_cm, n), power)


def normal_values(row: int, draw: np.ndarray, modulus: int, multiplier: int) -> np.ndarray:
    """:func:`loamline.operators.posterior.standard_normal` from the two multiplied keys."""
    seed = np.fmod(row + draw + 11, modulus)
    one = np.fmod(seed * multiplier, modulus)
    two = np.fmod(one * multiplier, modulus)
    with np.errstate(all="ignore"):
        radius = np.sqrt(-2.0 * np.log((one + 1) / float(modulus + 1)))
        return radius * np.cos(2.0 * math.pi * (two / float(modulus)))


def quantiles_of(probabilities: dict[str, float], moments: bool = False) -> Summary:
    """Number of finite values, mean and standard deviation if wanted, and interpolated quantiles."""

    def summary(values: np.ndarray) -> list:
        v = values[np.isfinite(values)]
        size = len(v)
        also = _moments(v) if moments else []
        if not size:
            return [0, *also, *[None] * len(probabilities)]
        places = [p * (size - 1) for p in probabilities.values()]
        v.partition(sorted({f(place) for place in places for f in (math.floor, math.ceil)}))
        out = []
        for place in places:
            low, high, fraction = v[math.floor(place)], v[math.ceil(place)], place - math.floor(place)
            out.append(float(low if fraction == 0 else low + (high - low) * fraction))
        return [size, *also, *out]

    return summary


def _moments(v: np.ndarray) -> list:
    return [float(v.mean()) if len(v) else None, float(v.std(ddof=1)) if len(v) > 1 else None]


def shortest_of(mass: float) -> Summary:
    """Mean, standard deviation and shortest interval, lowest of equal ones; none without values."""

    def summary(values: np.ndarray) -> list:
        v = np.sort(values[np.isfinite(values)])
        size = len(v)
        if not size:
            return []
        gap = max(1, min(size - 1, int(np.rint(size * mass))))
        at = int(np.argmin(v[gap:] - v[:-gap])) if size > 1 else 0
        return [*_moments(v), float(v[at]), float(v[min(at + gap, size - 1)])]

    return summary


def grid_quantiles(
    draws: DataFrame, groups: int, first: int, last: int, per_unit: int, probabilities: dict[str, float]
) -> DataFrame:
    """Per grid point and group: draws with a defined suction, and quantiles of these."""
    ship_package(draws.sparkSession)
    slices = min(last - first + 1, _slices(draws, groups))
    kind = draws.schema["grp"].dataType
    schema = T.StructType([T.StructField("swc_idx", T.IntegerType()), T.StructField("grp", kind), T.StructField("n_ok", T.LongType())])
    for q in probabilities:
        schema = schema.add(q, T.DoubleType())
    summary = quantiles_of(probabilities)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        grp, begin = key
        held = [_numbers(table, c) for c in ("alpha_cm", "n", "theta_r")]
        points = range(first + begin.as_py(), last + 1, slices)
        found = [summary(suction_values(i / float(per_unit), *held)) for i in points]
        columns = [pa.array(points, pa.int32()), pa.repeat(grp, len(points)), pa.array([f[0] for f in found], pa.int64())]
        columns += [pa.array([f[1 + j] for f in found], pa.float64()) for j in range(len(probabilities))]
        return pa.table(columns, names=schema.names)

    cells = draws.select(
        "grp",
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice_"),
        *[F.col(c).cast("double").alias(c) for c in ("alpha_cm", "n", "theta_r")],
    )
    return _dealt(cells).groupBy("grp", "slice_").applyInArrow(run, schema)


def replicate_summary(
    obs: DataFrame, draws: DataFrame, groups: int, names: list[str], summary: Summary, modulus: int, multiplier: int
) -> DataFrame:
    """One summary per observation of the replicates from all draws of its group.

    ``obs`` holds obs_id, grp, h_cm and its key ``row_``; ``draws`` the parameters, sigma and their
    key ``draw_``, both keys multiplied.  Each obs_id occurs once.
    """
    ship_package(obs.sparkSession)
    slices = _slices(draws, groups)
    schema = T.StructType([obs.schema["obs_id"], *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = [], []
        if left.num_rows and right.num_rows:
            alpha, n, theta_r, sigma, draw = (_numbers(right, c) for c in ("alpha_cm", "n", "theta_r", "sigma", "draw_"))
            values = np.empty(len(alpha))
            for obs_id, known, row in zip(left.column("obs_id"), left.column("h_cm"), _numbers(left, "row_"), strict=True):
                h = known.as_py()
                values.fill(np.nan)
                for part in _chunks(len(alpha)) if h is not None else ():
                    mu = content_values(h, alpha[part], n[part], theta_r[part])
                    values[part] = mu + sigma[part] * normal_values(row, draw[part], modulus, multiplier)
                one = summary(values)
                if one:
                    ids.append(obs_id.as_py())
                    found.append(one)
        columns = [pa.array(ids, left.schema.field("obs_id").type)]
        columns += [pa.array([f[j] for f in found], pa.float64()) for j in range(len(names))]
        return pa.table(columns, names=schema.names)

    points = obs.where(F.col("grp").isNotNull()).withColumn("slice_", F.pmod(F.xxhash64("obs_id"), F.lit(slices)).cast("int"))
    cells = draws.where(F.col("grp").isNotNull()).withColumn("slice_", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    one, other = (_dealt(side).groupBy("grp", "slice_") for side in (points, cells))
    return one.cogroup(other).applyInArrow(run, schema)

"""Curve fitting as aggregation over a parameter grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.curves import THETA_S, saturation, suction_mpa, water_content
from loamline.functions.units import cm_water_to_mpa
from loamline.operators.nearest import GRID_FIRST, GRID_LAST, GRID_PER_UNIT
from loamline.operators.pairing import join_same, settled_small
from loamline.session import cut_lineage, release_frames, task_width


@dataclass(frozen=True)
class Axis:
    """Equally spaced parameter values."""

    low: float
    step: float
    count: int


# Box of the flat priors (alpha per cm, n, theta_r, sigma).
PRIOR_ALPHA = (0.0, 50.0)
PRIOR_N = (0.5, 3.0)
PRIOR_THETA_R = (0.01, 0.05)
PRIOR_SIGMA = (0.0, 10.0)


def _grid_points(obs: DataFrame, alpha: tuple[Column, Column, int], n: tuple[Column, Column, int]) -> DataFrame:
    cell = F.explode(F.sequence(F.lit(0), F.lit(alpha[2] * n[2] - 1)))
    return (
        obs.withColumn("cell", cell)
        .withColumn("alpha_cm", alpha[0] + alpha[1] * F.floor(F.col("cell") / n[2]))
        .withColumn("n", n[0] + n[1] * (F.col("cell") % n[2]))
    )


def _curve_sums(points: DataFrame, keys: list[str], theta_s: float) -> DataFrame:
    """The three sums per (alpha, n) from which the sum of squares at any theta_r follows.

    The curve is linear in theta_r: prediction = theta_s * s + theta_r * (1 - s).  The sum
    of squares is therefore a quadratic in theta_r, and one axis of the grid costs nothing
    during the pass over the observations.
    """
    s = saturation(F.col("h_cm"), F.col("alpha_cm"), F.col("n"))
    rest = F.col("theta") - F.lit(theta_s) * F.col("s")
    open_ = F.lit(1.0) - F.col("s")
    w = F.col("copies")
    return (
        points.withColumn("s", s)
        .groupBy(*keys, "alpha_cm", "n")
        .agg(
            F.sum("copies").alias("n_obs"),
            F.sum(w * rest * rest).alias("rr"),
            F.sum(w * rest * open_).alias("ro"),
            F.sum(w * open_ * open_).alias("oo"),
        )
    )


def _sse_over_theta_r(
    points: DataFrame, keys: list[str], theta_r: tuple[Column, Column, int], theta_s: float
) -> DataFrame:
    """Sum of squares at every theta_r of an axis."""
    sums = _curve_sums(points, keys, theta_s)
    step = F.explode(F.sequence(F.lit(0), F.lit(theta_r[2] - 1)))
    value = theta_r[0] + theta_r[1] * F.col("t")
    r = F.col("theta_r")
    return (
        sums.withColumn("t", step)
        .withColumn("theta_r", value)
        .select(
            *keys,
            "alpha_cm",
            "n",
            "theta_r",
            "n_obs",
            (F.col("rr") - 2.0 * r * F.col("ro") + r * r * F.col("oo")).alias("sse"),
        )
    )


def _fixed(axis: Axis) -> tuple[Column, Column, int]:
    return F.lit(axis.low), F.lit(axis.step), axis.count


def distinct_points(obs: DataFrame, group: str = "grp") -> DataFrame:
    """Usable (group, theta, h_cm) points with the number of observations at each.

    Repeated sensor readings collapse map-side before they meet the grid.  Every point then
    costs a whole grid of curve values, so spreading the points evenly pays for itself.  The
    spread uses other keys than the count, else it would be merged into the count's shuffle
    and few points would end up in one task.
    """
    usable = obs.where(F.col("theta").isNotNull() & (F.col("h_cm") > 0))
    keys = [group, "theta", "h_cm"]
    counted = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counted.repartition(task_width(obs.sparkSession), "theta", "h_cm")


def grid_sse(obs: DataFrame, alpha: Axis, n: Axis, theta_r: Axis, group: str = "grp", theta_s: float = THETA_S) -> DataFrame:
    """Sum of squared residuals per (group, alpha, n, theta_r).

    The grid is a literal expanded in place, and sums combine map-side: the shuffle carries
    groups x grid points per task whatever the number of observations.
    """
    points = _grid_points(distinct_points(obs, group), _fixed(alpha), _fixed(n))
    return _sse_over_theta_r(points, [group], _fixed(theta_r), theta_s)


def best_fit(sse: DataFrame, group: str = "grp") -> DataFrame:
    """Parameters of the smallest sum of squares; ties go to the smallest parameters."""
    order = F.struct("sse", "alpha_cm", "n", "theta_r")
    return (
        sse.groupBy(group)
        .agg(F.min(order).alias("b"), F.max("n_obs").alias("n_obs"))
        .select(group, "b.alpha_cm", "b.n", "b.theta_r", "b.sse", "n_obs")
    )


def curve_table(fitted: DataFrame, alpha: str, n: str, theta_r: str, first_cm: int, last_cm: int) -> DataFrame:
    """Each row's curve at every whole suction head: ``h_cm``, ``theta`` and ``mpa``."""
    heads = fitted.withColumn("h_cm", F.explode(F.sequence(F.lit(first_cm), F.lit(last_cm))))
    theta = water_content(F.col("h_cm"), F.col(alpha), F.col(n), F.col(theta_r))
    return heads.withColumn("theta", theta).withColumn("mpa", cm_water_to_mpa(F.col("h_cm")))


def inverse_table(
    fitted: DataFrame, alpha: str, n: str, theta_r: str, first: int = GRID_FIRST, last: int = GRID_LAST
) -> DataFrame:
    """Each row's suction at every point of the content grid: ``swc_idx`` and ``mpa``."""
    points = fitted.withColumn("swc_idx", F.explode(F.sequence(F.lit(first), F.lit(last))))
    swc = F.col("swc_idx") / F.lit(float(GRID_PER_UNIT))
    return points.withColumn("mpa", suction_mpa(swc, F.col(alpha), F.col(n), F.col(theta_r)))


def with_pooled(obs: DataFrame, group: str = "grp", pooled: str = "site") -> DataFrame:
    """Every observation once in its own group and once in the pooled one."""
    return obs.withColumn(group, F.explode(F.array(F.col(group), F.lit(pooled))))


def grid_posterior(sse: DataFrame, sigma: Axis, group: str = "grp", power: float = 1.0) -> DataFrame:
    """Normalised weights over (alpha, n, theta_r, sigma) under flat priors.

    A ``power`` below 1 tempers the likelihood: with very many observations all weight would lie
    on one grid point.

    The group's largest weight and its sum are aggregates, one row a group, joined back: no task
    holds a whole group.
    """
    s = F.lit(sigma.low) + F.lit(sigma.step) * F.col("k")
    log_weight = -F.col("n_obs") * F.log("sigma") - F.col("sse") / (2.0 * F.col("sigma") * F.col("sigma"))
    cells = (
        cut_lineage(sse)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sigma.count - 1))))
        .withColumn("sigma", s)
        .withColumn("log_weight", F.lit(power) * log_weight)
    )
    top = settled_small(cells.groupBy(group).agg(F.max("log_weight").alias("top")))
    raw = join_same(cells, top, [group]).withColumn("log_weight", F.col("log_weight") - F.col("top"))
    raw = raw.withColumn("raw", F.exp("log_weight"))
    total = settled_small(raw.groupBy(group).agg(F.sum("raw").alias("total")))
    return join_same(raw, total, [group]).select(
        group, "alpha_cm", "n", "theta_r", "sigma", "log_weight", (F.col("raw") / F.col("total")).alias("weight")
    )


@dataclass(frozen=True)
class Cells:
    """Cells of one parameter inside its prior: equal in the parameter, or in its logarithm."""

    bounds: tuple[float, float]
    count: int
    log: bool = False
    # What stands for a lower bound of 0 on a logarithmic axis, as a part of the upper one.
    least: float = 1e-6

    @property
    def range(self) -> tuple[float, float]:
        low, high = self.bounds
        return (math.log(low or high * self.least), math.log(high)) if self.log else (low, high)

    def edge(self, low: Column, step: Column, k: Column) -> Column:
        at = low + step * k
        return F.exp(at) if self.log else at

    def middle(self, low: Column, step: Column, k: Column) -> Column:
        return self.edge(low, step, k + F.lit(0.5))

    def open_low(self) -> bool:
        """Whether the axis begins above its prior's lower bound."""
        return self.log and self.bounds[0] == 0


# The box of the priors, with cells that can resolve it: scales in logarithms.
PRIOR_CELLS = {
    "alpha_cm": Cells(PRIOR_ALPHA, 24, log=True),
    "n": Cells(PRIOR_N, 24),
    "theta_r": Cells(PRIOR_THETA_R, 16),
    "sigma": Cells(PRIOR_SIGMA, 16, log=True),
}
# Part of its side by which a box that has settled moves no more.
STALLED = 0.2
# Mass of a cell from which it counts as part of the posterior.
TAIL = 1e-6


def _prior_boxes(points: DataFrame, cells: dict[str, Cells], group: str) -> DataFrame:
    """One row a group: lower end and step of every axis over the whole prior."""
    ends = []
    for name, axis in cells.items():
        low, high = axis.range
        ends += [F.lit(low).alias(f"{name}_low"), F.lit((high - low) / axis.count).alias(f"{name}_step")]
    return points.select(group).distinct().select(group, *ends)


def _box_posterior(points: DataFrame, boxes: DataFrame, cells: dict[str, Cells], group: str, theta_s: float) -> DataFrame:
    """Normalised weights of all cells of each group's box: density at the middle times volume.

    Columns: the group, the cell's number ``k_`` and middle on every axis, ``log_weight`` below the
    group's largest, and ``weight``. Observations are passed once, over (alpha, n).
    """
    side = [c for c in boxes.columns if c != group]
    low, step = (lambda name: F.col(f"{name}_low")), (lambda name: F.col(f"{name}_step"))
    a, m, r, s = (cells[c] for c in ("alpha_cm", "n", "theta_r", "sigma"))

    def middle(name: str) -> Column:
        return cells[name].middle(low(name), step(name), F.col(f"k_{name}"))

    def width(name: str) -> Column:
        k = F.col(f"k_{name}")
        return cells[name].edge(low(name), step(name), k + 1) - cells[name].edge(low(name), step(name), k)

    curve_cell = F.explode(F.sequence(F.lit(0), F.lit(a.count * m.count - 1)))
    spread = (
        join_same(points, boxes, [group])
        .withColumn("cell", curve_cell)
        .withColumn("k_alpha_cm", F.floor(F.col("cell") / m.count))
        .withColumn("k_n", F.col("cell") % m.count)
        .withColumn("alpha_cm", middle("alpha_cm"))
        .withColumn("n", middle("n"))
    )
    sums = _curve_sums(spread, [group, *side, "k_alpha_cm", "k_n"], theta_s)
    t, v = F.col("theta_r"), F.col("sigma")
    sse = F.greatest(F.col("rr") - 2.0 * t * F.col("ro") + t * t * F.col("oo"), F.lit(0.0))
    volume = width("alpha_cm") * width("n") * width("theta_r") * width("sigma")
    raw = cut_lineage(
        sums.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(r.count * s.count - 1))))
        .withColumn("k_theta_r", F.floor(F.col("cell") / s.count))
        .withColumn("k_sigma", F.col("cell") % s.count)
        .withColumn("theta_r", middle("theta_r"))
        .withColumn("sigma", middle("sigma"))
        .withColumn("raw", -F.col("n_obs") * F.log("sigma") - sse / (2.0 * v * v) + F.log(volume))
    )
    top = settled_small(raw.groupBy(group).agg(F.max("raw").alias("top")))
    weighed = join_same(raw, top, [group]).withColumn("log_weight", F.col("raw") - F.col("top"))
    total = settled_small(weighed.groupBy(group).agg(F.sum(F.exp("log_weight")).alias("total")))
    numbers = [F.col(f"k_{name}").cast("int").alias(f"k_{name}") for name in cells]
    return join_same(weighed, total, [group]).select(
        group, *side, *numbers, *cells, "log_weight", (F.exp("log_weight") / F.col("total")).alias("weight")
    )


def box_marginals(posterior: DataFrame, cells: dict[str, Cells] | None = None, group: str = "grp") -> DataFrame:
    """(group, parameter, k, low, high, x, weight): the mass of each cell of each axis."""
    cells = cells or PRIOR_CELLS
    axes = [
        F.struct(
            F.lit(name).alias("parameter"),
            F.col(f"k_{name}").alias("k"),
            axis.edge(F.col(f"{name}_low"), F.col(f"{name}_step"), F.col(f"k_{name}")).alias("low"),
            axis.edge(F.col(f"{name}_low"), F.col(f"{name}_step"), F.col(f"k_{name}") + 1).alias("high"),
            F.col(name).alias("x"),
        )
        for name, axis in cells.items()
    ]
    keys = ["parameter", "k", "low", "high", "x"]
    return posterior.select(group, "weight", F.inline(F.array(*axes))).groupBy(group, *keys).agg(F.sum("weight").alias("weight"))


def _next_boxes(marginals: DataFrame, boxes: DataFrame, cells: dict[str, Cells], group: str, tail: float) -> DataFrame:
    """Boxes around the cells that hold mass, one old cell wider on both sides, inside the prior.

    The widening lets a box follow a peak that lies past its edge.
    """
    held = F.col("weight") >= tail
    ends = []
    for name in cells:
        here = held & (F.col("parameter") == name)
        ends += [
            F.min(F.when(here, F.col("k"))).alias(f"{name}_first"),
            F.max(F.when(here, F.col("k"))).alias(f"{name}_last"),
        ]
    out = []
    for name, axis in cells.items():
        least, most = axis.range
        low = F.greatest(F.lit(least), F.col(f"{name}_low") + F.col(f"{name}_step") * (F.col(f"{name}_first") - 1))
        high = F.least(F.lit(most), F.col(f"{name}_low") + F.col(f"{name}_step") * (F.col(f"{name}_last") + 2))
        out += [low.alias(f"{name}_low"), ((high - low) / axis.count).alias(f"{name}_step")]
    return join_same(boxes, marginals.groupBy(group).agg(*ends), [group]).select(group, *out)


def box_state(marginals: DataFrame, cells: dict[str, Cells] | None = None, group: str = "grp") -> DataFrame:
    """(group, parameter, edge, coarsest): mass in outer cells off the prior's bounds, and the largest cell.

    Small values of both say that the box holds the posterior and resolves it.
    """
    cells = cells or PRIOR_CELLS
    off = F.lit(False)
    for name, axis in cells.items():
        least, most = axis.edge(F.lit(axis.range[0]), F.lit(0.0), F.lit(0)), axis.edge(F.lit(axis.range[1]), F.lit(0.0), F.lit(0))
        below = F.lit(True) if axis.open_low() else F.col("low") > least * F.lit(1 + 1e-12)
        outer = ((F.col("k") == 0) & below) | ((F.col("k") == axis.count - 1) & (F.col("high") < most * F.lit(1 - 1e-12)))
        off = off | ((F.col("parameter") == name) & outer)
    return marginals.groupBy(group, "parameter").agg(
        F.sum(F.when(off, F.col("weight")).otherwise(0.0)).alias("edge"), F.max("weight").alias("coarsest")
    )


def box_posterior(
    obs: DataFrame,
    cells: dict[str, Cells] | None = None,
    rounds: int | None = None,
    group: str = "grp",
    theta_s: float = THETA_S,
    tail: float = TAIL,
    most_mass: float = 0.3,
    most_rounds: int = 25,
) -> DataFrame:
    """Posterior over the whole prior box, on cells that end up where its mass lies.

    Each round weighs all cells of a group's box by density times volume and shrinks the box to the
    cells that hold at least ``tail``. Without ``rounds`` this goes on until, on every axis of every
    group, the outer cells hold next to nothing and none holds more than ``most_mass``. Where boxes
    stay as they are and still do not resolve an axis, as with long tails, the axis gets twice the
    cells. It fails after ``most_rounds``. Every ``n`` of the prior is admitted, also those up to 1, where the curve
    exceeds saturation. What a round hands to the next is one row a group.
    """
    cells = cells or PRIOR_CELLS
    points = cut_lineage(distinct_points(obs, group))
    boxes = settled_small(_prior_boxes(points, cells, group))
    done = 0
    while True:
        found = cut_lineage(_box_posterior(points, boxes, cells, group, theta_s))
        done += 1
        if done == rounds:
            return found
        marginals = cut_lineage(box_marginals(found, cells, group))
        if rounds is None:
            state = box_state(marginals, cells, group).groupBy("parameter").agg(F.max("edge"), F.max("coarsest"))
            axes = {name: (edge, coarsest) for name, edge, coarsest in state.collect()}
            coarse = [name for name, (_, coarsest) in axes.items() if coarsest > most_mass]
            if not coarse and all(edge < tail * 10 for edge, _ in axes.values()):
                return found
            if done == most_rounds:
                raise ValueError(f"the posterior is not resolved after {done} rounds: {axes}")
        moved = settled_small(_next_boxes(marginals, boxes, cells, group, tail))
        if rounds is None and coarse and _largest_move(boxes, moved, cells, group) < STALLED:
            cells = {name: replace(axis, count=axis.count * (1 + (name in coarse))) for name, axis in cells.items()}
            moved = settled_small(_next_boxes(marginals, boxes, cells, group, tail))
        boxes = moved
        release_frames(found, marginals)


def _largest_move(before: DataFrame, after: DataFrame, cells: dict[str, Cells], group: str) -> float:
    """The largest change of a box's side, as a part of it."""
    names = [c for c in before.columns if c != group]
    renamed = before.select(group, *[F.col(c).alias(f"{c}_old") for c in names])
    moves = [
        F.abs(F.col(f"{name}_step") / F.col(f"{name}_step_old") - 1.0)
        + F.abs(F.col(f"{name}_low") - F.col(f"{name}_low_old")) / (axis.count * F.col(f"{name}_step_old"))
        for name, axis in cells.items()
    ]
    return join_same(after, renamed, [group]).agg(F.max(F.greatest(*moves)).alias("m")).first()["m"] or 0.0


def box_summary(marginals: DataFrame, probabilities: dict[str, float], group: str = "grp") -> DataFrame:
    """Mean, sd and quantiles per group and parameter from the mass of cells.

    Inside a cell mass is even: quantiles are interpolated between its edges.
    """
    order = Window.partitionBy(group, "parameter").orderBy("k")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cumulated = marginals.withColumn("upto", upto).withColumn("before", F.lag("upto", 1, 0.0).over(order))
    mean, square = F.sum(F.col("weight") * F.col("x")), F.sum(F.col("weight") * F.col("x") * F.col("x"))
    found = []
    for name, p in probabilities.items():
        at = F.col("low") + (F.col("high") - F.col("low")) * ((F.lit(p) - F.col("before")) / F.col("weight"))
        found.append(F.min(F.when((F.col("before") < F.lit(p)) & (F.col("upto") >= F.lit(p)), at)).alias(name))
    return cumulated.groupBy(group, "parameter").agg(
        mean.alias("estimate"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std_error"), *found
    )


def weighted_summary(
    posterior: DataFrame, probabilities: dict[str, float], group: str = "grp"
) -> DataFrame:
    """Mean, sd and quantiles per group and parameter.

    Weights are first summed per distinct parameter value, so windows run over grid values.
    A quantile is the smallest value whose cumulative weight reaches the probability.
    """
    long = posterior.unpivot([group, "weight"], ["alpha_cm", "n", "theta_r", "sigma"], "parameter", "x")
    marginal = long.groupBy(group, "parameter", "x").agg(F.sum("weight").alias("w"))
    upto = Window.partitionBy(group, "parameter").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = marginal.withColumn("cum", F.sum("w").over(upto))
    mean = F.sum(F.col("w") * F.col("x"))
    square = F.sum(F.col("w") * F.col("x") * F.col("x"))
    reach = [
        F.min(F.when(F.col("cum") >= F.lit(p) - F.lit(1e-12), F.col("x"))).alias(name)
        for name, p in probabilities.items()
    ]
    return cumulated.groupBy(group, "parameter").agg(
        mean.alias("estimate"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std_error"), *reach
    )


def zoomed_fit(
    obs: DataFrame, alpha: Axis, n: Axis, theta_r: Axis, rounds: int = 3, group: str = "grp", theta_s: float = THETA_S
) -> DataFrame:
    """Fit on a grid, then on ever finer grids around the best point of each group.

    Every round spans one step to either side of the last optimum with as many points as
    before.  The distinct points are written once and scanned once a round; a round hands
    one row per group to the next.
    """
    points = cut_lineage(distinct_points(obs, group))
    first = _grid_points(points, _fixed(alpha), _fixed(n))
    best = best_fit(_sse_over_theta_r(first, [group], _fixed(theta_r), theta_s), group)
    steps = {"alpha_cm": alpha.step, "n": n.step, "theta_r": theta_r.step}
    counts = {"alpha_cm": alpha.count, "n": n.count, "theta_r": theta_r.count}
    for _ in range(rounds):
        centre = settled_small(best.select(group, *[F.col(p).alias(f"mid_{p}") for p in steps]))
        lows = {p: F.col(f"mid_{p}") - F.lit(steps[p]) for p in steps}
        finer = {p: 2.0 * steps[p] / (counts[p] - 1) for p in steps}
        axes = {p: (lows[p], F.lit(finer[p]), counts[p]) for p in steps}
        around = _grid_points(points.join(centre, group), axes["alpha_cm"], axes["n"]).where(
            (F.col("alpha_cm") > 0) & (F.col("n") > 0)
        )
        sse = _sse_over_theta_r(around, [group, "mid_theta_r"], axes["theta_r"], theta_s)
        best = best_fit(sse, group)
        steps = finer
    return best

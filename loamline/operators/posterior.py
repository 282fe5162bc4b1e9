"""Summaries of posterior draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.curves import water_content
from loamline.operators.held import HELD_DRAWS, group_sizes, quantiles_of, replicate_summary, shortest_of, worth_holding
from loamline.operators.pairing import BROADCAST_ROWS, pair_rows, settled_small
from loamline.operators.quality import metrics_table
from loamline.operators.ranking import exact_quantiles, shortest_intervals
from loamline.session import cut_lineage, table_behind, task_width

# Sampler bookkeeping.
BURN_IN = 1000
THIN_EVERY = 50
PARAMETERS = ("alpha_cm", "n", "theta_r")
# Multipliers and modulus of the linear congruential generator.
LCG_MODULUS = 2_147_483_647
LCG_MULTIPLIER = 48_271
LCG_SEED_MULTIPLIER = 69_621


def thinned(draws: DataFrame, burn_in: int = BURN_IN, every: int = THIN_EVERY) -> DataFrame:
    return draws.where((F.col("iter") > burn_in) & (F.col("iter") % every == 0))


def terms_long(draws: DataFrame, ids: Sequence[str] = ("chain", "iter", "grp"), names: Sequence[str] = PARAMETERS) -> DataFrame:
    return draws.unpivot(list(ids), list(names), "parameter", "x")


def quantile_summary(long: DataFrame, keys: Sequence[str], level: float = 0.95, **options) -> DataFrame:
    """Mean, sd and central interval per term."""
    return exact_quantiles(long, keys, "x", _central(level), moments=True, **options).drop("n_ok")


def _central(level: float) -> dict[str, float]:
    tail = (1.0 - level) / 2.0
    return {"conf_low": tail, "conf_high": 1.0 - tail}


def hdi_summary(long: DataFrame, keys: Sequence[str], level: float = 0.95, **options) -> DataFrame:
    """Mean, sd and shortest interval per term."""
    return shortest_intervals(long, keys, "x", level, moments=True, **options)


def convergence(
    long: DataFrame, keys: Sequence[str], burn_half: bool = False, df_correct: bool = True
) -> DataFrame:
    """Potential scale reduction per term from between- and within-chain variance."""
    keys = list(keys)
    if burn_half:
        half = long.groupBy(*keys, "chain").agg((F.max("iter") / 2).alias("half"))
        long = long.join(settled_small(half), [*keys, "chain"]).where(F.col("iter") > F.col("half")).drop("half")
    chains = long.groupBy(*keys, "chain").agg(
        F.count("x").alias("m"), F.avg("x").alias("mean"), F.var_samp("x").alias("s2")
    )
    n, k = F.col("n_iter").cast("double"), F.col("n_chains").cast("double")
    grow = F.lit(1.0) + F.lit(1.0) / k
    folded = chains.groupBy(*keys).agg(
        F.min("m").alias("n_iter"),
        F.count(F.lit(1)).alias("n_chains"),
        F.avg("s2").alias("within"),
        F.var_samp("mean").alias("b_over_n"),
        F.var_samp("s2").alias("var_s2"),
        F.avg("mean").alias("grand"),
        F.covar_samp("s2", F.col("mean") * F.col("mean")).alias("cov_sq"),
        F.covar_samp("s2", "mean").alias("cov"),
    )
    between = n * F.col("b_over_n")
    pooled = (n - 1) * F.col("within") / n + grow * F.col("b_over_n")
    var_w = F.col("var_s2") / k
    var_b = 2.0 * between * between / (k - 1)
    cov_wb = (n / k) * (F.col("cov_sq") - 2.0 * F.col("grand") * F.col("cov"))
    var_v = ((n - 1) * (n - 1) * var_w + grow * grow * var_b + 2.0 * (n - 1) * grow * cov_wb) / (n * n)
    freedom = F.try_divide(2.0 * pooled * pooled, var_v)
    ratio = (n - 1) / n + grow * F.try_divide(F.col("b_over_n"), F.col("within"))
    correction = (freedom + 3.0) / (freedom + 1.0) if df_correct else F.lit(1.0)
    return folded.select(*keys, "n_chains", "n_iter", F.sqrt(correction * ratio).alias("r_hat"))


def natural_scale(df: DataFrame) -> DataFrame:
    """Population parameters and standard deviations from the sampler's own scales.

    The sampler's normal takes a precision, hence sigma = tau^(-1/2).
    """
    out = df.select("chain", "iter")
    columns = []
    for p in PARAMETERS:
        columns.append(F.exp(F.col(f"mu_log_{p}")).alias(f"e_{p}"))
        columns.append(F.abs(F.col(f"eps_{p}")).alias(f"sig_{p}"))
        columns.append(F.pow(F.abs(F.col(f"eps_{p}")), F.lit(-2.0)).alias(f"tau_log_{p}"))
    columns.append(F.pow(F.col("tau"), F.lit(-0.5)).alias("sigma"))
    return df.select(*out.columns, *columns)


def row_part(row_key: Column) -> Column:
    return row_key.cast("long") * F.lit(LCG_MULTIPLIER)


def draw_part(draw_key: Column) -> Column:
    return draw_key.cast("long") * F.lit(LCG_SEED_MULTIPLIER)


def standard_normal(row_key: Column, draw_key: Column) -> Column:
    """A normal deviate fixed by two integer keys.

    Box-Muller on two steps of a congruential generator: a task that is run again yields
    the same numbers, which ``randn`` would not after a changed partitioning.
    """
    m, a = F.lit(LCG_MODULUS), F.lit(LCG_MULTIPLIER)
    seed = (row_part(row_key) + draw_part(draw_key) + F.lit(11)) % m
    one = (seed * a) % m
    two = (one * a) % m
    u1 = (one + F.lit(1)) / F.lit(float(LCG_MODULUS + 1))
    u2 = two / F.lit(float(LCG_MODULUS))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def draw_key() -> Column:
    return F.col("iter").cast("long") * 10 + F.col("chain").cast("long")


def _keyed_parameters() -> list[Column]:
    """Parameters, sigma and the multiplied key ``draw_`` of each draw.

    No sigma where anything is missing: arrays hold NaN for NULL, whose power of 0 is a number.
    """
    key = draw_part(draw_key())
    whole = key.isNotNull()
    for p in PARAMETERS:
        whole = whole & F.col(p).isNotNull()
    return [*[F.col(p) for p in PARAMETERS], F.when(whole, F.col("sigma")).alias("sigma"), F.coalesce(key, F.lit(0)).alias("draw_")]


def settled_draws(draws: DataFrame) -> DataFrame:
    """The columns a prediction needs, computed once."""
    return cut_lineage(draws.select("grp", "chain", "iter", "alpha_cm", "n", "theta_r", "sigma"))


def replicates(obs: DataFrame, draws: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Per observation and draw of its group: curve value ``mu`` and replicate ``rep``."""
    return _replicates(obs, settled_draws(draws), limit)


def _replicates(obs: DataFrame, settled: DataFrame, limit: int) -> DataFrame:
    """Observations are spread by ``obs_id`` first: each becomes one row per draw, and a later
    summary per observation finds its rows in place."""
    spread = obs.select("obs_id", "grp", "theta", "h_cm").repartition(task_width(obs.sparkSession), "obs_id")
    pairs = pair_rows(spread, settled, ["grp"], limit)
    mu = water_content(F.col("h_cm"), F.col("alpha_cm"), F.col("n"), F.col("theta_r"))
    return pairs.withColumn("mu", mu).withColumn(
        "rep", F.col("mu") + F.col("sigma") * standard_normal(F.col("obs_id"), draw_key())
    )


def draw_measures(pairs: DataFrame, keys: Sequence[str] = ("chain", "iter")) -> DataFrame:
    """Deviance, Bayesian R2 and predictive loss of each draw in one pass over the pairs.

    All are sums combined map-side: the shuffle carries draws x tasks rows.
    """
    sigma2 = F.max("sigma") * F.max("sigma")
    miss = F.col("theta") - F.col("mu")
    loss = F.col("theta") - F.col("rep")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        (F.count(F.lit(1)) * F.log(F.lit(2.0 * math.pi) * sigma2) + F.sum(miss * miss) / sigma2).alias("deviance"),
        (F.var_samp("mu") / (F.var_samp("mu") + sigma2)).alias("bayes_r2"),
        F.sum(loss * loss).alias("d_sum"),
    )


def predicted_intervals(
    obs: DataFrame,
    draws: DataFrame,
    method: str = "hdi",
    limit: int = BROADCAST_ROWS,
    level: float = 0.95,
    held: int = HELD_DRAWS,
    **options,
) -> DataFrame:
    """Replicates summarised per observation.

    An observation has one replicate per draw of its group, so counting the draws bounds the
    values per observation.  Draws that are too many to be sent everywhere are summarised where a
    task holds its group's draws, up to ``held`` of them.  Options, larger groups, many small ones,
    and observations whose obs_id is missing or not unique take the pairs through the general summaries.
    """
    settled = settled_draws(draws)
    most, groups = group_sizes(settled)
    summary = hdi_summary if method == "hdi" else quantile_summary

    def paired(some: DataFrame) -> DataFrame:
        long = _replicates(some, settled, limit).select("obs_id", F.col("rep").alias("x"))
        return summary(long, ["obs_id"], level, **{"group_rows": most, **options})

    if options or not worth_holding(settled, most, groups, limit, held):
        return paired(obs)
    single = (F.count(F.lit(1)).over(Window.partitionBy("obs_id")) == 1) & F.col("obs_id").isNotNull()
    marked = obs.select("obs_id", "grp", "theta", "h_cm", single.alias("single"))
    points = cut_lineage(marked, others=F.count_if(~F.col("single")))
    ends = shortest_of(level) if method == "hdi" else quantiles_of(_central(level), moments=True)
    names = ["estimate", "std_error", "conf_low", "conf_high"]
    found = replicate_summary(
        points.where("single").select("obs_id", "grp", "h_cm", row_part(F.col("obs_id")).alias("row_")),
        settled.select("grp", *_keyed_parameters()),
        groups,
        names if method == "hdi" else ["n_ok", *names],
        ends,
        LCG_MODULUS,
        LCG_MULTIPLIER,
    ).select("obs_id", *names)
    if table_behind(points).facts["others"]:
        return found.unionByName(paired(points.where("NOT single").drop("single")))
    return found


def fit_metrics(obs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adjusted R2, coverage and slope per treatment and overall."""
    return metrics_table(obs.join(intervals, "obs_id"))


def treatment_differences(summary: DataFrame) -> DataFrame:
    """Pairs of groups per parameter; different when neither mean lies in the other's interval."""
    a = summary.select(
        "parameter",
        F.col("grp").alias("grp_a"),
        F.col("estimate").alias("mean_a"),
        F.col("conf_low").alias("low_a"),
        F.col("conf_high").alias("high_a"),
    )
    b = summary.select(
        "parameter",
        F.col("grp").alias("grp_b"),
        F.col("estimate").alias("mean_b"),
        F.col("conf_low").alias("low_b"),
        F.col("conf_high").alias("high_b"),
    )
    apart = ~F.col("mean_a").between(F.col("low_b"), F.col("high_b")) & ~F.col("mean_b").between(
        F.col("low_a"), F.col("high_a")
    )
    ordered = (a["parameter"] == b["parameter"]) & (F.col("grp_a") < F.col("grp_b"))
    return (
        a.join(b, ordered)
        .select(a["parameter"], "grp_a", "grp_b", "mean_a", "mean_b", apart.alias("different"))
    )

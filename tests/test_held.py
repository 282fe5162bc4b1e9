"""Summaries over draws that a task holds, and draws dealt over tasks."""

import pytest
from pyspark.sql import functions as F

from loamline.operators import held, lookup, posterior
from loamline.session import cut_lineage, task_width


def many(spark, size=3000):
    """Draws of two groups and of none; one has no chain, and some no defined curve."""
    return spark.range(size).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("S"), F.col("id") % 3)).alias("grp"),
        F.when(F.col("id") != 31, F.col("id") % 2).cast("int").alias("chain"),
        F.col("id").alias("iter"),
        F.when(F.col("id") != 40, 0.01 + F.col("id") / 20000).alias("alpha_cm"),
        F.when(F.col("id") % 50 == 1, 1.0).otherwise(1.1 + F.col("id") % 700 / 400).alias("n"),
        (0.01 + F.col("id") % 900 / 2000).alias("theta_r"),
        (0.01 + F.col("id") % 7 / 100).alias("sigma"),
    )


def close(frame, *keys):
    """Rows with nine digits of each number, by key."""
    rows = {}
    for r in frame.collect():
        cells = tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r.asDict().values())
        rows.setdefault(tuple(r[k] for k in keys), []).append(cells)
    return {k: sorted(v, key=repr) for k, v in rows.items()}


def no_pairs(*_, **__):
    raise AssertionError("pairs were made")


def test_held_lookup_equals_the_aggregate(spark, monkeypatch):
    draws = many(spark)
    sent = close(lookup.lookup_quantiles(draws, 995, 1003), "swc_idx", "grp")
    monkeypatch.setattr(lookup, "_expanded", no_pairs)
    kept = lookup.lookup_quantiles(draws, 995, 1003, limit=10)
    assert close(kept, "swc_idx", "grp") == sent and len(sent) == 27
    with pytest.raises(AssertionError, match="pairs"):
        lookup.lookup_quantiles(draws, 995, 1003, limit=10, held=500)


def test_draws_are_dealt_before_they_meet_the_grid(spark):
    pairs, most = lookup.inverse_curves(many(spark).coalesce(1), 995, 1003, limit=10)
    assert pairs.rdd.getNumPartitions() == task_width(spark) and most == 1000
    assert pairs.count() == 27_000


def test_held_grid_has_points_of_no_suction(spark):
    found = held.grid_quantiles(cut_lineage(many(spark)), 3, 4399, 4401, 10_000, lookup.QUANTILES).collect()
    assert {r.n_ok == 0 for r in found if r.swc_idx == 4401} == {True}
    assert all((r.q50 is None) == (r.n_ok == 0) for r in found) and any(r.n_ok for r in found)


@pytest.mark.parametrize("method", ["hdi", "quantile"])
def test_held_intervals_equal_the_aggregate(spark, monkeypatch, method):
    draws = many(spark)
    obs = spark.range(30).select(
        F.when(F.col("id") != 5, F.col("id") * 13 % 24).alias("obs_id"),
        F.when(F.col("id") != 7, F.concat(F.lit("S"), F.col("id") % 4)).alias("grp"),
        F.lit(0.2).alias("theta"),
        F.when(F.col("id") != 9, F.col("id") * 11.0).alias("h_cm"),
    )
    sent = close(posterior.predicted_intervals(obs, draws, method), "obs_id")
    assert close(posterior.predicted_intervals(obs, draws, method, limit=10), "obs_id") == sent
    assert len(sent) > 9
    monkeypatch.setattr(posterior, "_replicates", no_pairs)
    some = (6, 8, 10, 19, 21, 23)
    single = obs.where(F.col("obs_id").isin(*some))
    kept = close(posterior.predicted_intervals(single, draws, method, limit=10), "obs_id")
    assert kept == {k: v for k, v in sent.items() if k[0] in some}

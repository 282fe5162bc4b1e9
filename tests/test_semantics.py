"""Join, null and fan-out semantics, and agreement of alternative forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamline.functions import curves, labels, nulls
from loamline.operators import calendar, fitting, lookup, nearest, pairing, posterior, pulses, ranking, watering
from loamline.session import scratch_path
from loamline.sources import readers, tables


def test_season_forms_agree(spark):
    days = spark.range(0, 2200).select(F.date_add(F.lit(dt.date(2018, 6, 1)), F.col("id").cast("int")).alias("date"))
    seasons = calendar.season_calendar(spark)
    expect = calendar.label_by_range(days, seasons, "inner").select("date", "year", "season")
    fast = calendar.label_by_interval(days, seasons, how="inner").select("date", "year", "season")
    plain = calendar.with_season(days).select("date", "year", "season")
    assert sorted(map(tuple, expect.collect())) == sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect()))


def test_null_keys_match_in_null_safe_join(spark):
    left = spark.createDataFrame([(1, None), (2, "S1")], "k int, s string")
    right = spark.createDataFrame([(1, None, 10), (2, "S1", 20), (2, None, 30)], "k int, s string, v int")
    assert sorted(pairing.join_same(left, right, ["k", "s"], "left").select("k", "v").collect()) == [(1, 10), (2, 20)]


def test_irrigation_join_keeps_row_count(spark):
    day = dt.date(2020, 3, 1)
    paired = spark.createDataFrame([(day, "S1", 1), (day, "S4", 1), (day, None, 1)], "date date, summer string, depth int")
    irrigation = spark.createDataFrame([(day, t, float(i)) for i, t in enumerate(labels.TREATMENTS)], "date date, treatment string, irrigation_mm double")
    out = watering.with_irrigation(paired, irrigation)
    assert {r.summer: r.irrigation_mm for r in out.collect()} == {"S1": 0.0, "S4": 3.0, None: None}


def test_event_windows_and_kept_days_are_disjoint(spark):
    base = dt.date(2020, 1, 1)
    days = spark.range(60).select(F.date_add(F.lit(base), F.col("id").cast("int")).alias("date"))
    events = spark.createDataFrame([(base, "S1", 2.0), (base + dt.timedelta(1), "S1", 1.0), (base + dt.timedelta(9), "S1", 0.0)], "date date, treatment string, irrigation_mm double")
    kept = {r.date for r in pulses.outside_windows(days, events, "S1", 2).collect()}
    assert len(kept) == 56 and base + dt.timedelta(9) in kept
    labelled = pulses.with_days_since(days, events, "S1", [(base + dt.timedelta(5), base + dt.timedelta(6))])
    found = {r.date: r.irig_label for r in labelled.collect()}
    assert len(found) == labelled.count() == 60
    assert [found[base + dt.timedelta(i)] for i in range(7)] == [0, 0, 1, 2, None, 3, 3]


def test_means_skip_or_carry_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 4.0)], "k int, x double")
    skip = {r.k: r.m for r in df.groupBy("k").agg(nulls.group_mean(F.col("x")).alias("m")).collect()}
    carry = {r.k: r.m for r in df.groupBy("k").agg(nulls.group_mean(F.col("x"), False).alias("m")).collect()}
    assert skip == {1: 1.0, 2: 4.0} and carry == {1: None, 2: 4.0}


def test_axis_ratio_without_watering_is_one(spark):
    empty = spark.createDataFrame([], "irrigation_mm double, ppt_mm double")
    series = spark.createDataFrame([(4.0,), (None,)], "x double")
    assert watering.axis_ratio(empty, series, F.max("x")).first().ratio == 1.0
    water = spark.createDataFrame([(8.0, None), (None, 2.0)], "irrigation_mm double, ppt_mm double")
    assert watering.axis_ratio(water, series, F.max("x")).first().ratio == 2.0
    assert watering.axis_ratio(water, series, F.max("x"), inverse=True).first().ratio == 0.5


def test_grid_index_equals_brute_force(spark):
    random.seed(1)
    xs = [random.uniform(0.0, 0.5) for _ in range(1500)] + [i / 20000 for i in range(399, 8802)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    grid = [i for i in range(200, 4400)]
    got = {r.x: r.i for r in df.select("x", nearest.grid_index(F.col("x")).alias("i")).collect()}
    for x in xs[:1500]:
        assert got[x] == min(grid, key=lambda i: (abs(i / 10000 - x), i))
    assert got[879 / 20000] == 439  # 0.04395 lies midway
    assert got[399 / 20000] == 200 and got[8801 / 20000] == 4399


@pytest.mark.parametrize("limit", [10_000, 50])
def test_nearest_join_equals_brute_force(spark, monkeypatch, limit):
    random.seed(2)
    grid = sorted({round(random.uniform(0, 10), 3) for _ in range(200)})
    xs = [random.uniform(-3, 14) for _ in range(400)] + [None] + [(a + b) / 2 for a, b in zip(grid, grid[1:])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    side = spark.createDataFrame([(g,) for g in grid], "g double")
    neighbours = nearest._with_neighbours
    monkeypatch.setattr(nearest, "_with_neighbours", lambda lookup, name: neighbours(lookup, name, limit))
    got = {r.i: r.g for r in nearest.nearest_join(df, side, "x", "g", 0.25).collect()}
    assert len(got) == len(xs)
    for i, x in enumerate(xs):
        assert got[i] == (None if x is None else min(grid, key=lambda g: (round(abs(g - x), 9), g)))


def _skewed(spark):
    """One key holds most rows and one value a third of them; NaN and NULL are mixed in."""
    random.seed(3)
    hot = [("hot", random.choice([1.0, 1.0, random.gauss(5, 2)])) for _ in range(6000)]
    cold = [("cold", random.expovariate(1.0)) for _ in range(70)] + [("one", 2.5), ("none", None), ("none", float("nan"))]
    cold += [(None, x) for x in (-3.0, 0.0, -0.5, 7.0)]
    return spark.createDataFrame(hot + cold, "k string, x double")


def test_ranked_quantiles_equal_the_array_form(spark):
    df, p = _skewed(spark), {"a": 0.025, "b": 0.5, "c": 0.975, "d": 1.0, "e": 0.0}
    small = ranking.exact_quantiles(df, ["k"], "x", p, strategy="array", moments=True)
    large = ranking.exact_quantiles(df, ["k"], "x", p, strategy="ranked", moments=True)
    binned = ranking.exact_quantiles(df, ["k"], "x", p, strategy="binned", moments=True)
    picked = ranking.exact_quantiles(df, ["k"], "x", p, limit=100, moments=True)

    def rows(d):
        return sorted((str(r.k), r.n_ok, *[None if v is None else round(v, 12) for v in (r.a, r.b, r.c, r.d, r.e, r.estimate)]) for r in d.collect())

    assert rows(small) == rows(large) == rows(binned) == rows(picked)
    assert dict((r[0], r[1]) for r in rows(small)) == {"hot": 6000, "cold": 70, "one": 1, "none": 0, "None": 4}


def test_ranked_intervals_equal_the_array_form(spark):
    df = _skewed(spark)
    for mass in (0.5, 0.95):
        small = ranking.shortest_intervals(df, ["k"], "x", mass, strategy="array")
        large = ranking.shortest_intervals(df, ["k"], "x", mass, strategy="ranked")
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    wide = ranking.exact_quantiles(df, ["k"], "x", {"lo": 0.025, "hi": 0.975})
    both = ranking.shortest_intervals(df, ["k"], "x").join(wide, "k").where("n_ok > 10").collect()
    assert all(r.conf_high - r.conf_low <= r.hi - r.lo + 1e-12 for r in both)


def test_interval_by_rank_crosses_blocks(spark):
    df = _skewed(spark).where("x IS NOT NULL AND NOT isnan(x)")
    expect = sorted(map(str, ranking.shortest_intervals(df, ["k"], "x", strategy="array").collect()))
    assert sorted(map(str, ranking._shortest_by_rank(df, ["k"], "x", 0.95, block=37).collect())) == expect


def test_value_ranks_cover_every_rank_once(spark):
    ranks = ranking.value_ranks(_skewed(spark).where("NOT isnan(x)"), ["k"], "x", slices=5)
    for key, total in (("hot", 6000), ("cold", 70), ("one", 1)):
        spans = sorted((r["first"], r["past"]) for r in ranks.where(F.col("k") == key).collect())
        assert spans[0][0] == 0 and spans[-1][1] == total
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pairs_are_complete_without_broadcast(spark):
    left = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("l"))
    right = spark.range(90).select((F.col("id") % 3).alias("g"), F.col("id").alias("r"))
    small = pairing.pair_rows(left, right, ["g"])
    large = pairing.pair_rows(left, right, ["g"], limit=20, width=12)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_lookup_is_the_same_from_distributed_draws(spark):
    draws = spark.range(60).select(
        F.lit("site").alias("grp"),
        (0.01 + F.col("id") / 500).alias("alpha_cm"),
        (1.2 + F.col("id") / 50).alias("n"),
        (0.01 + F.col("id") / 2000).alias("theta_r"),
    )
    sent = lookup.lookup_quantiles(draws, 200, 500)
    kept = lookup.lookup_quantiles(draws, 200, 500, limit=10)
    ranked = lookup.lookup_quantiles(draws, 200, 300, limit=10, strategy="ranked")
    binned = lookup.lookup_quantiles(draws, 200, 300, limit=10, strategy="binned")

    def rows(d, last):
        return sorted((r.swc_idx, r.n_ok, *[None if v is None else round(v, 9) for v in (r.q25, r.q50, r.q75)]) for r in d.where(F.col("swc_idx") <= last).collect())

    assert rows(sent, 500) == rows(kept, 500)
    assert rows(sent, 300) == rows(ranked, 300) == rows(binned, 300)


def test_mask_and_strict_conversion(spark):
    table = spark.createDataFrame(
        [(439, 0.0439, "site", 1200, 1.0, 0.5, 2.0), (439, 0.0439, "S1", 10, 3.0, 2.0, 4.0), (438, 0.0438, "site", 999, 9.0, 8.0, 10.0), (4399, 0.4399, "site", 3000, 0.1, 0.05, 0.2)],
        "swc_idx int, swc double, grp string, n_ok long, q50 double, q25 double, q75 double",
    )
    site = {(r.swc_idx, r.grp): (r.q50, r.q25, r.q75) for r in lookup.masked_lookup(table).collect()}
    assert site[(439, "S1")] == (-3.0, -2.0, -4.0) and site[(438, "site")] == (None, None, None)
    own = {(r.swc_idx, r.grp): r.q50 for r in lookup.masked_lookup(table, mask="group").collect()}
    assert own[(439, "S1")] is None and own[(439, "site")] == -1.0
    wet = spark.createDataFrame([(0.0439,), (0.2,), (0.5,), (None,)], "swc double")
    made = lookup.masked_lookup(table)
    loose = {r.swc: (r.swp_median, r.out_of_range) for r in lookup.convert(wet, made).collect()}
    assert loose[0.0439] == (-1.0, False) and loose[0.5] == (-0.1, True) and loose[None] == (None, None)
    strict = {r.swc: r.swp_median for r in lookup.convert(wet, made, strict=True).collect()}
    assert strict[0.5] is None and strict[0.0439] == -1.0


def test_grid_fit_recovers_parameters(spark):
    from loamline.functions import curves

    heads = spark.range(1, 200).select(F.pow(F.lit(1.05), F.col("id")).alias("h_cm"), F.lit("S1").alias("grp"))
    obs = heads.withColumn("theta", curves.water_content(F.col("h_cm"), F.lit(0.07), F.lit(1.5), F.lit(0.03)))
    axes = fitting.Axis(0.01, 0.02, 10), fitting.Axis(1.1, 0.2, 8), fitting.Axis(0.01, 0.01, 5)
    best = fitting.best_fit(fitting.grid_sse(obs, *axes)).first()
    assert (round(best.alpha_cm, 6), round(best.n, 6), round(best.theta_r, 6)) == (0.07, 1.5, 0.03)
    assert abs(best.sse) < 1e-12 and best.n_obs == 199
    off = heads.withColumn("theta", curves.water_content(F.col("h_cm"), F.lit(0.0652), F.lit(1.437), F.lit(0.0283)))
    fine = fitting.zoomed_fit(off, *axes, rounds=4).first()
    assert abs(fine.alpha_cm - 0.0652) < 2e-3 and abs(fine.n - 1.437) < 1e-2 and abs(fine.theta_r - 0.0283) < 1e-3
    weights = fitting.grid_posterior(fitting.grid_sse(obs, *axes), fitting.Axis(0.01, 0.01, 5))
    assert abs(weights.agg(F.sum("weight")).first()[0] - 1) < 1e-12


def test_replicates_repeat_under_another_partitioning(spark):
    obs = spark.range(50).select(F.col("id").alias("obs_id"), F.lit("S1").alias("grp"), F.lit(0.2).alias("theta"), (F.col("id") + 1.0).alias("h_cm"))
    draws = spark.range(40).select(F.lit("S1").alias("grp"), F.lit(1).alias("chain"), F.col("id").alias("iter"), F.lit(0.05).alias("alpha_cm"), F.lit(1.5).alias("n"), F.lit(0.03).alias("theta_r"), F.lit(0.02).alias("sigma"))
    one = posterior.replicates(obs, draws).select("obs_id", "iter", "rep")
    two = posterior.replicates(obs.repartition(3), draws.repartition(5), limit=7).select("obs_id", "iter", "rep")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    noise = posterior.replicates(obs, draws).agg(F.avg(F.col("rep") - F.col("mu")).alias("m"), F.stddev(F.col("rep") - F.col("mu")).alias("s")).first()
    assert abs(noise.m) < 0.002 and abs(noise.s - 0.02) < 0.002


def test_shared_folder_is_the_named_one():
    from types import SimpleNamespace

    from loamline.session import shared_dir

    def session(named, master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context)

    assert shared_dir(session("hdfs://shared/folder", "yarn")) == "hdfs://shared/folder"
    with pytest.raises(ValueError):
        shared_dir(session(None, "yarn"))


def test_convergence_of_identical_and_shifted_chains(spark):
    random.seed(4)
    rows = [(c, i, "p", random.gauss(0, 1)) for c in (1, 2, 3) for i in range(400)]
    rows += [(c, i, "q", random.gauss(3.0 * c, 1)) for c in (1, 2, 3) for i in range(400)]
    long = spark.createDataFrame(rows, "chain int, iter int, parameter string, x double")
    found = {r.parameter: r.r_hat for r in posterior.convergence(long, ["parameter"]).collect()}
    assert 0.99 < found["p"] < 1.02 and found["q"] > 2
    plain = {r.parameter: r.r_hat for r in posterior.convergence(long, ["parameter"], df_correct=False).collect()}
    assert plain["p"] <= found["p"]


def test_reader_unites_files_with_different_sensors(spark):
    old = spark.createDataFrame([("2020-01-01 00:00:00", "1", "0.1", "NA")], "TIMESTAMP string, X string, VWC_P1_2_H3 string, T_inside string")
    new = spark.createDataFrame([("2020-01-02 00:30:00", "0.2", "0.3")], "TIMESTAMP string, VWC_P1_2_H3 string, VWC_P12_3_H5 string")
    paths = [scratch_path(spark, n) for n in ("old", "new")]
    for df, path in zip((old, new), paths):
        tables.export_csv(df, path)
    back = readers.read_wide_sensors(spark, paths)
    assert back.columns == ["dt", "date", "VWC_P1_2_H3", "T_inside", "VWC_P12_3_H5"]
    rows = {str(r.date): tuple(r)[2:] for r in back.collect()}
    assert rows == {"2020-01-01": (0.1, None, None), "2020-01-02": (0.2, None, 0.3)}


def test_day_range_reads_only_its_years(spark):
    from loamline.plans import dashboard

    days = spark.range(1500).select(F.date_add(F.lit(dt.date(2019, 9, 1)), F.col("id").cast("int")).alias("date"))
    table = calendar.with_season(days)
    path = scratch_path(spark, "years")
    tables.save_table(table, path, ("year",), ("date",))
    first, last = dt.date(2020, 10, 30), dt.date(2020, 11, 2)
    back = dashboard.in_range(tables.load_table(spark, path), first, last, "year")
    assert back.count() == 4
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert sorted(r.year for r in back.collect()) == [2020, 2020, 2021, 2021]


def test_saved_table_prunes_partitions(spark):
    df = spark.range(100).select((F.col("id") % 4).cast("int").alias("year"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("date"))
    path = scratch_path(spark, "saved")
    tables.save_table(df, path, ("year",), ("date",))
    back = tables.load_table(spark, path).where((F.col("year") == 2) & (F.col("date") >= F.lit(dt.date(2020, 2, 1))))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThanOrEqual(date" in plan
    assert back.count() == 17


def test_logger_files_are_bound_by_name(spark, tmp_path):
    folder = tmp_path / "logger"
    folder.mkdir()
    (folder / "a.csv").write_text("TIMESTAMP,P1,P2\n2020-01-01 00:30:00,1,2\n")
    (folder / "b.csv").write_text("TIMESTAMP,P2,P1,X\n2020-01-02,20,10,0\n")
    (folder / "c.csv").write_text('"TIMESTAMP","P3"\n2020-01-03 00:00:00,NA\n')
    rows = {str(r.dt): r for r in readers.read_wide_sensors(spark, str(folder)).collect()}
    assert (rows["2020-01-01 00:30:00"].P1, rows["2020-01-01 00:30:00"].P2) == (1.0, 2.0)
    assert (rows["2020-01-02 00:00:00"].P1, rows["2020-01-02 00:00:00"].P2) == (10.0, 20.0)
    assert rows["2020-01-03 00:00:00"].P3 is None and "X" not in rows["2020-01-02 00:00:00"]
    (folder / "d.csv").write_text("TIMESTAMP,P1\nnot a time,1\n")
    with pytest.raises(Exception, match="no time: not a time"):
        readers.read_wide_sensors(spark, str(folder)).collect()


def test_interval_steps_are_rounded_half_to_even(spark):
    squares = spark.range(30).select(F.lit("g").alias("g"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    for strategy in ("array", "ranked"):
        row = ranking.shortest_intervals(squares, ["g"], "x", strategy=strategy).first()
        assert (row.conf_low, row.conf_high) == (0.0, 784.0)


@pytest.mark.parametrize("n, finite", [(1.035, False), (1.038, True), (1.039, True), (1.04, True), (1.05, True)])
def test_inverse_curve_keeps_every_finite_suction(spark, n, finite):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    alpha, theta_r = 0.05, 0.03
    theta = theta_r + 1e-12
    frame = spark.createDataFrame([(theta, alpha, n, theta_r)], "theta double, alpha double, n double, r double")
    found = frame.select(curves.suction_mpa(F.col("theta"), F.col("alpha"), F.col("n"), F.col("r")).alias("s")).first().s
    t, a, m, r = (Decimal(x) for x in (theta, alpha, n, theta_r))
    ratio = (Decimal(0.44) - r) / (t - r)
    head = ((ratio ** (m / (m - 1))) - 1) ** (1 / m) / a
    want = head * Decimal("98.0665") / Decimal("1e6")
    assert (found is not None) == finite
    if finite:
        assert abs(Decimal(found) / want - 1) < Decimal("1e-9")


def test_nearest_is_the_same_for_any_lookup_size(spark, monkeypatch):
    grid = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (2.0, "c"), (3.0, "d")], "grid double, tag string")
    values = spark.createDataFrame([(x,) for x in (2.2, 1.9, 1.5, 9.0, -4.0, float("nan"), float("inf"), None)], "v double")

    def matches():
        return sorted(map(repr, nearest.nearest_join(values, grid, "v", "grid", 0.5).collect()))

    small = matches()
    monkeypatch.setattr(nearest._with_neighbours, "__defaults__", (0,))
    assert matches() == small
    assert sum("2.2" in r for r in small) == 2 and sum("tag=None" in r for r in small) == 3


def test_draws_without_a_group_stay_for_any_size(spark):
    draws = spark.createDataFrame(
        [("site", 0.05, 1.5, 0.03), (None, 0.05, 1.5, 0.03)], "grp string, alpha_cm double, n double, theta_r double"
    )
    forms = [
        sorted(map(repr, lookup.lookup_quantiles(draws, 4000, 4001, limit).collect())) for limit in (100, 1)
    ]
    assert forms[0] == forms[1] and len(forms[0]) == 4

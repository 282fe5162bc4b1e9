"""The interval index against the literal predicate."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamline.operators import calendar, intervals, pulses


def moments(seed, n):
    draw = random.Random(seed)
    day = dt.datetime(2023, 1, 1)
    spans = [0, 1, 1800, 7200, 86400, 86400 * 40, 86400 * 400, 86400 * 4000]
    points = [(i, draw.choice("ab"), day + dt.timedelta(seconds=draw.randrange(86400 * 900))) for i in range(n)]
    rows = []
    for i in range(n // 3):
        st = day + dt.timedelta(seconds=draw.randrange(86400 * 900))
        en = st + dt.timedelta(seconds=draw.choice(spans) * draw.choice([1, 1, 1, -1]))
        rows.append((f"i{i}", draw.choice("ab"), st, en))
    rows += [("none", "a", None, day), ("open", "a", day, None), ("nokey", None, day, day + dt.timedelta(days=9))]
    rows += [("at", "b", points[0][2], points[0][2]), ("at2", "a", points[0][2], points[0][2])]
    return points + [(n, "a", None), (n + 1, None, day)], rows


def frames(spark, seed=3, n=300, kind="timestamp_ntz"):
    points, rows = moments(seed, n)
    return (
        spark.createDataFrame(points, "id long, k string, at timestamp_ntz").withColumn("at", F.col("at").cast(kind)),
        spark.createDataFrame(rows, "name string, k string, st timestamp_ntz, en timestamp_ntz")
        .withColumn("st", F.col("st").cast(kind))
        .withColumn("en", F.col("en").cast(kind)),
    )


def plain(points, rows, how):
    p, r = points.alias("p"), rows.alias("r")
    hit = (F.col("p.k") == F.col("r.k")) & (F.col("p.at") >= F.col("r.st")) & (F.col("p.at") <= F.col("r.en"))
    joined = p.join(r, hit, how)
    return joined.select("p.id", *(["r.name"] if how in ("left", "inner") else []))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "timestamp"])
@pytest.mark.parametrize("how", ["left", "inner", "semi", "anti"])
def test_equals_the_predicate(spark, how, kind):
    points, rows = frames(spark, kind=kind)
    full = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    want = sorted(map(str, plain(points, rows, full).collect()))
    for width in ("hour", "month") if kind != "date" else ("day", "year"):
        got = intervals.join_intervals(points, rows, "at", ["k"], how, width=width)
        assert sorted(map(str, got.select("id", *(["name"] if how in ("left", "inner") else [])).collect())) == want


def test_shuffled_index_equals_the_broadcast_one(spark, monkeypatch):
    points, rows = frames(spark)
    small = intervals.join_intervals(points, rows, "at", ["k"], keep_bounds=True)
    monkeypatch.setattr(intervals, "fits", lambda df: False)
    large = intervals.join_intervals(points, rows, "at", ["k"], keep_bounds=True)
    assert large.columns == ["id", "k", "at", "name", "st", "en"]
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_long_intervals_take_wider_cells(spark):
    day = dt.date(2000, 1, 1)
    rows = spark.createDataFrame([("long", day, day + dt.timedelta(days=30000)), ("day", day, day)], "name string, st date, en date")
    index = intervals.interval_cells(rows, width="day")
    assert {(r.name, r.n) for r in index.groupBy("name").agg(F.count("*").alias("n")).collect()} == {("day", 1), ("long", 83)}


def test_no_nested_loop(spark, capsys):
    points, rows = frames(spark)
    for how in ("left", "inner"):
        intervals.join_intervals(points, rows, "at", ["k"], how).explain()
        assert "NestedLoop" not in capsys.readouterr().out


def test_reversed_interval_labels_nothing(spark):
    days = spark.createDataFrame([(dt.date(2020, 7, d),) for d in range(1, 11)], "date date")
    back = spark.createDataFrame([(1, dt.date(2020, 7, 5), dt.date(2020, 7, 3))], "pulse int, st date, en date")
    out = calendar.label_by_interval(days, back)
    assert out.count() == 10 and out.where("pulse IS NOT NULL").count() == 0
    assert calendar.interval_days(back).count() == 0


def test_two_events_on_one_day_keep_the_rows(spark):
    rows = [(dt.date(2020, 7, d), "S4", mm) for d, mm in [(5, 3.0), (5, 4.0), (8, 2.0), (8, 2.0), (8, 0.0)]]
    events = spark.createDataFrame([*rows, (None, "S4", 1.0)], "date date, treatment string, irrigation_mm double")
    spans = pulses.event_spans(events)
    assert [(r.st.day, r.en.day, r.irrigation_mm) for r in spans.orderBy("st").collect()] == [(5, 7, 7.0), (8, 31, 4.0)]
    days = spark.createDataFrame([(dt.date(2020, 7, d),) for d in range(1, 11)], "date date")
    labelled = pulses.with_pulse(days, pulses.pulse_table(events, "S4"))
    assert [r.pulse for r in labelled.orderBy("date").collect()] == [None] * 4 + [1] * 3 + [2] * 3
    assert [r.pulse for r in pulses.numbered_events(events).orderBy("date").collect()] == [1, 2]


def test_clashing_label_is_named(spark):
    points, rows = frames(spark, n=10)
    with pytest.raises(ValueError, match="name"):
        intervals.join_intervals(points.withColumn("NAME", F.lit(1)), rows, "at", ["k"])

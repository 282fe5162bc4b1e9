"""The header probe, and readers that bind columns by name."""

import datetime as dt
import gzip

import pytest

from loamline import storage
from loamline.sources import headers, readers


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "logger data"
    (made / "deep").mkdir(parents=True)
    (made / "a.csv").write_text("TIMESTAMP,P1,P2\n2020-01-01 00:30:00,1,2\n")
    (made / "deep" / "b.csv").write_text("﻿TIMESTAMP,P2\r\n2020-01-02 00:00:00,20\r\n")
    (made / "_SUCCESS").write_text("")
    return made


def test_names_of_every_file(spark, folder):
    found = headers.probe_headers(spark, [str(folder)], ["TIMESTAMP"])
    assert [(f.file.rsplit("/", 1)[-1], f.names, f.left_out) for f in found] == [
        ("a.csv", ("TIMESTAMP", "P1", "P2"), None),
        ("b.csv", ("TIMESTAMP", "P2"), None),
    ]


def test_files_without_a_header_fail_by_name(spark, folder):
    (folder / "lower.csv").write_text("timestamp,P1\n2020-01-03 00:00:00,1\n")
    (folder / "lost.csv").write_text("2020-01-04 00:00:00,5\n2020-01-04,TIMESTAMP\n")
    (folder / "empty.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="lost.csv.*lower.csv"):
        readers.read_wide_sensors(spark, str(folder))
    with pytest.raises(ValueError, match="lost.csv"):
        readers.read_wide_sensors(spark, str(folder), exclude="lower*")
    back = readers.read_wide_sensors(spark, str(folder), exclude="lo*.csv")
    assert sorted(str(r.dt) for r in back.collect()) == ["2020-01-01 00:30:00", "2020-01-02 00:00:00"]
    out = headers.files_left_out(spark, [str(folder)], ["TIMESTAMP"], exclude="lower*").collect()
    reasons = {r.file.rsplit("/", 1)[-1]: r.reason for r in out}
    assert reasons == {"empty.csv": "empty", "lost.csv": "no column TIMESTAMP", "lower.csv": "matches lower*"}


def test_no_file_at_all(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_gauge(spark, str(tmp_path / "nothing"))
    (tmp_path / "one.csv").write_text("")
    with pytest.raises(ValueError, match="no file"):
        readers.read_gauge(spark, str(tmp_path))


def test_first_line_of_any_file(spark, tmp_path):
    long = ",".join(f"name {i}" for i in range(9000))
    texts = {"a": "\n \r\n\nx,y\r\n1,2\n", "b": long + "\n1\n", "c": "last", "d": "", "e": "\ufeffé,ü\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(b"p,q\n1,2\n"))
    found = storage.first_lines(spark, storage.listed(spark, [str(tmp_path)]))
    assert found == ["x,y", long, "last", None, "é,ü", "p,q"]


def test_no_job_runs_for_the_headers(spark, tmp_path):
    for name in ("x.csv", "y.csv"):
        (tmp_path / name).write_text("TIMESTAMP,P1\n" + "2020-01-01 00:30:00,1.5\n" * 1000)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "probe")
    try:
        assert len(headers.probe_headers(spark, [str(tmp_path)], ["TIMESTAMP"])) == 2
        assert len(tracker.getJobIdsForGroup("headers")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_swapped_columns_are_told_apart(spark, tmp_path):
    (tmp_path / "gauge.csv").write_text("Rainfall (inch),Note,TIMESTAMP\n1.0,x,1/2/2020 0:00\n")
    (row,) = readers.read_gauge(spark, str(tmp_path / "gauge.csv")).collect()
    assert (row.date, round(row.ppt_mm, 6)) == (dt.date(2020, 1, 2), 25.4)
    (tmp_path / "design.csv").write_text("Summer,Winter,Plot,House\nS1,W2,7,3\n")
    (row,) = readers.read_design(spark, str(tmp_path / "design.csv")).collect()
    assert tuple(row) == (3, 7, "W2", "S1", 2, 1)
    with pytest.raises(ValueError, match="gauge.csv.*no column House"):
        readers.read_design(spark, str(tmp_path))


def test_irrigation_files_with_different_treatments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,S1,S2\n7/5/2020,1.5,\n")
    (tmp_path / "b.csv").write_text("S4,date,S1\n4,7/6/2020,2\n")
    rows = readers.read_irrigation(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.date.day, r.S1, r.S2, r.S4) for r in rows] == [(5, 1.5, None, None), (6, 2.0, None, 4.0)]

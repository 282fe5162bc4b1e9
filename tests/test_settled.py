"""The log of settled tables, their release, and versions of saved tables."""

import os

import pytest
from pyspark.sql import functions as F

from loamline import session, storage
from loamline.operators import pairing
from loamline.sources import tables


def numbers(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("row "), "id").alias("name"))


def path_of(frame):
    return session.table_behind(frame).path


def test_rows_and_size_are_observed(spark):
    table = session.table_behind(session.cut_lineage(numbers(spark, 1000), most=F.max("id")))
    assert (table.state, table.rows, table.facts) == ("ready", 1000, {"most": 999})
    assert 16_000 < table.size < 40_000
    none = session.table_behind(session.cut_lineage(numbers(spark, 0)))
    assert (none.state, none.rows, none.size) == ("ready", 0, 0)


def test_broadcast_checks_rows_and_bytes(spark, monkeypatch):
    frame = session.cut_lineage(numbers(spark, 1000))
    assert pairing.fits(frame) and not pairing.fits(frame, 999)
    assert pairing.fits(numbers(spark, 1000)) and not pairing.fits(numbers(spark, 1000), 999)
    monkeypatch.setattr(pairing, "BROADCAST_BYTES", 10_000)
    assert not pairing.fits(frame) and not pairing.fits(numbers(spark, 1000))


def test_release_by_owner(spark):
    with session.owned_by("first"):
        a = session.cut_lineage(numbers(spark, 3))
    with session.owned_by("second"):
        b = session.cut_lineage(numbers(spark, 4))
    assert session.release(spark, "first") == 1
    assert not storage.exists(spark, path_of(a)) and b.count() == 4
    assert [t.state for t in session.settled_tables(spark, "first")] == ["released"]
    session.release_frames(b, None, numbers(spark, 1))
    assert not storage.exists(spark, path_of(b))


def test_temporary_tables_keep_only_the_result(spark):
    with session.temporary_tables(spark, "job") as kept:
        a = session.cut_lineage(numbers(spark, 3))
        b = session.cut_lineage(a.where("id > 0"))
        kept.append(b)
    assert not storage.exists(spark, path_of(a))
    assert b.count() == 2 and session.table_behind(b).owner == ""


def test_tables_go_when_a_job_fails(spark):
    made = []
    with pytest.raises(RuntimeError), session.temporary_tables(spark, "job"):
        made.append(session.cut_lineage(numbers(spark, 3)))
        raise RuntimeError
    assert not storage.exists(spark, path_of(made[0]))


def test_folder_is_empty_after_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    with session.owned_by("folder"):
        session.cut_lineage(numbers(spark, 3))
        with pytest.raises(Exception):
            session.cut_lineage(numbers(spark, 3).select(F.raise_error(F.lit("no")).alias("x")))
    assert len(os.listdir(tmp_path)) == 2
    assert [t.state for t in session.settled_tables(spark, "folder")] == ["ready", "writing"]
    assert session.release(spark, "folder") == 2
    assert os.listdir(tmp_path) == []


def test_crashed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    assert tables.save_table(numbers(spark, 5), path, ("id",)) == "v000001"
    with pytest.raises(Exception):
        tables.save_table(numbers(spark, 5).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert tables.load_table(spark, path).count() == 5
    assert tables.version_names(spark, path) == ["v000001", "v000002"]
    again = tables.load_table(spark, path).select("id", "name").where("id < 4")
    assert tables.save_table(again, path) == "v000003"
    assert tables.load_table(spark, path).count() == 4
    assert tables.version_names(spark, path) == ["v000001", "v000003"]
    assert tables.load_table(spark, path, "v000001").count() == 5
    tables.save_table(numbers(spark, 2), path, keep=0)
    assert tables.version_names(spark, path) == ["v000004"]


def test_folder_without_versions_is_read_as_it_is(spark, tmp_path):
    path = str(tmp_path / "plain")
    numbers(spark, 3).write.parquet(path)
    assert tables.load_table(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        storage.listed(spark, [str(tmp_path / "nowhere")])

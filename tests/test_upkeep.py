"""Dated tables under a manifest, and aggregates kept in step with their inputs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetline.operators import upkeep
from fleetline.plans.fixtures import Fixture
from fleetline.plans.rollup_queries import overlay_inputs, overlay_rows, refresh_overlay
from fleetline.sources.dated import DatedTable
from fleetline.sources.scratch import drop_scratch, keep, scratch_path, stamp_of

DIR = "/root/testdata/sf0.001"
SCHEMA = "service_date date, k string, n long"


def _df(spark, rows):
    return spark.createDataFrame([(d, k, n) for d, k, n in rows], "d string, k string, n long").select(F.to_date("d").alias("service_date"), "k", "n")


def _rows(df):
    return sorted((str(r.service_date), r.k, r.n) for r in df.collect())


def test_dates_change_together_and_readers_keep_theirs(spark, tmp_path):
    t = DatedTable(spark, str(tmp_path / "t"), SCHEMA, keep=2)
    assert t.read().count() == 0 and t.versions() == []
    first = [("2024-01-01", "a", 1), ("2024-01-02", "b", 2), ("2024-01-03", "c", 3)]
    assert t.replace(_df(spark, first), ["2024-01-01", "2024-01-02", "2024-01-03"]) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    reader = t.read()  # goes on with what it has, while the table changes twice
    t.replace(_df(spark, [("2024-01-02", "B", 20)]), ["2024-01-02"])
    assert _rows(reader) == first
    assert _rows(t.read()) == [first[0], ("2024-01-02", "B", 20), first[2]]
    assert _rows(t.read(["2024-01-02", "2030-01-01"])) == [("2024-01-02", "B", 20)]
    t.replace(_df(spark, []), ["2024-01-03"])  # no rows: the date leaves
    assert [r[0] for r in _rows(t.read())] == ["2024-01-01", "2024-01-02"]
    assert t.versions() == [1, 2]
    t.replace(_df(spark, [("2024-01-01", "x", 9)]), ["2024-01-01"])
    folders = {str(p.relative_to(tmp_path / "t/data")) for p in (tmp_path / "t/data").glob("v=*/service_date=*")}
    assert folders == {"v=0/service_date=2024-01-01", "v=1/service_date=2024-01-02", "v=3/service_date=2024-01-01"}  # what two manifests name
    with pytest.raises(ValueError):
        t.replace(_df(spark, first), ["2024-01-01"])


def test_only_the_files_of_the_dates_asked_for_are_opened(spark, tmp_path):
    t = DatedTable(spark, str(tmp_path / "t"), SCHEMA)
    days = [f"2024-01-{d:02d}" for d in range(1, 11)]
    t.replace(_df(spark, [(d, "k", 1) for d in days]), days)
    files = t.read(["2024-01-04"]).inputFiles()
    assert len(files) == 1 and "service_date=2024-01-04" in files[0]
    assert len({f.split("service_date=")[1][:10] for f in t.read().inputFiles()}) == 10


def test_a_version_that_is_written_again_starts_from_the_same_predecessor(spark, tmp_path):
    t = DatedTable(spark, str(tmp_path / "t"), SCHEMA)
    t.replace(_df(spark, [("2024-01-01", "a", 1)]), ["2024-01-01"], version=5)
    for n in (2, 3):
        t.replace(_df(spark, [("2024-01-02", "b", n)]), ["2024-01-02"], version=6)
    assert t.versions() == [5, 6] and _rows(t.read()) == [("2024-01-01", "a", 1), ("2024-01-02", "b", 3)]
    assert _rows(t.read(before=6)) == [("2024-01-01", "a", 1)]


def test_fingerprints_tell_rows_apart_but_not_their_order(spark):
    rows = [("2024-01-01", "a", 1), ("2024-01-01", "a", 1), ("2024-01-01", None, 2), ("2024-01-02", "b", None)]
    of = lambda rows, **x: {str(r.service_date): r.print for r in upkeep.fingerprints({"t": _df(spark, rows)}, **x).collect()}
    base = of(rows)
    assert of(rows[::-1]) == base and set(base) == {"2024-01-01", "2024-01-02"}
    once = of(rows[1:])
    assert once["2024-01-01"] != base["2024-01-01"] and once["2024-01-02"] == base["2024-01-02"]
    assert of([*rows[:3], ("2024-01-02", None, None)])["2024-01-02"] != base["2024-01-02"]
    assert not set(of(rows, recipe="2").values()) & set(base.values())
    two = upkeep.fingerprints({"a": _df(spark, rows), "b": _df(spark, rows[:1])}).collect()
    assert len(two) == 2 and not {r.print for r in two} & set(base.values())


def test_a_refresh_that_fails_leaves_the_table_and_finds_the_dates_again(spark, tmp_path):
    t = DatedTable(spark, str(tmp_path / "t"), SCHEMA)
    total = lambda x: x["t"].groupBy("service_date").agg(F.lit("sum").alias("k"), F.sum("n").alias("n"))
    a, b = [("2024-01-01", "a", 1), ("2024-01-02", "b", 2)], [("2024-01-02", "b", 5), ("2024-01-03", "c", 3)]
    assert upkeep.refresh(t, {"t": _df(spark, a)}, total) == upkeep.Refresh(("2024-01-01", "2024-01-02"), (), ())
    with pytest.raises(RuntimeError):
        upkeep.refresh(t, {"t": _df(spark, b)}, lambda x: (_ for _ in ()).throw(RuntimeError()))
    assert _rows(t.read()) == [("2024-01-01", "sum", 1), ("2024-01-02", "sum", 2)]
    assert upkeep.refresh(t, {"t": _df(spark, b)}, total) == upkeep.Refresh(("2024-01-02", "2024-01-03"), ("2024-01-01",), ())
    assert _rows(t.read()) == [("2024-01-02", "sum", 5), ("2024-01-03", "sum", 3)]
    assert upkeep.refresh(t, {"t": _df(spark, b)}, total) == upkeep.Refresh((), (), ("2024-01-02", "2024-01-03"))
    assert upkeep.refresh(t, {"t": _df(spark, b)}, total, recipe="2").written == ("2024-01-02", "2024-01-03")
    # a date whose rows no longer make any row of the aggregate
    empty = lambda x: total(x).filter("n > 4")
    assert upkeep.refresh(t, {"t": _df(spark, b)}, empty, recipe="3").written == ("2024-01-02",)
    assert _rows(t.read()) == [("2024-01-02", "sum", 5)] and upkeep.refresh(t, {"t": _df(spark, b)}, empty, recipe="3").written == ()


def test_one_changed_date_rewrites_one_partition_of_the_overlay(spark, tmp_path):
    inputs, path = overlay_inputs(Fixture(spark, DIR)), str(tmp_path / "overlay")
    table, done = refresh_overlay(Fixture(spark, DIR), inputs, path)
    times = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert len(done.written) >= 14 and times
    late = inputs["events"].withColumn("deviation_sec", F.when(F.col("service_date") == "2024-01-09", F.col("deviation_sec") + 500).otherwise(F.col("deviation_sec")))
    _, again = refresh_overlay(Fixture(spark, DIR), {**inputs, "events": late}, path)
    assert again.written == ("2024-01-09",) and not again.gone and len(again.same) == len(done.written) - 1
    new = {p for p in Path(path).rglob("*.parquet")} - times.keys()
    assert new and all("service_date=2024-01-09" in str(p) for p in new) and all(p.stat().st_mtime_ns == t for p, t in times.items())
    want = overlay_rows({**inputs, "events": late})
    assert sorted(map(str, table.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # the timetable of a date counts too
    cells = inputs["cells"].filter("NOT (service_date = date'2024-01-03' AND hour = 8)")
    assert refresh_overlay(Fixture(spark, DIR), {**inputs, "events": late, "cells": cells}, path)[1].written == ("2024-01-03",)


def test_readers_of_the_overlay_scan_no_events(spark):
    from fleetline import catalog

    catalog.queries()["R03_window_metrics"](spark, DIR)
    for name in ("R03_window_metrics", "R05_period_deltas", "R16_movers"):
        files = catalog.queries()[name](spark, DIR).inputFiles()
        assert files and all("/overlay-" in f for f in files), name


def test_stamps_and_scratch(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(str(tmp_path / "x"))
    before = stamp_of(spark, str(tmp_path / "x"))
    assert stamp_of(spark, str(tmp_path / "x")) == before
    df.write.mode("append").parquet(str(tmp_path / "x"))
    assert stamp_of(spark, str(tmp_path / "x")) != before
    kept = keep(df, "gone")
    place = kept.inputFiles()[0].rsplit("/", 1)[0]
    drop_scratch(spark, place)
    assert not Path(place.removeprefix("file://")).exists()
    with pytest.raises(ValueError):
        drop_scratch(spark, str(tmp_path / "x"))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")

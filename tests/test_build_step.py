"""The build of the stored runs and daily tables: the same rows at less work."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetline import catalog
from fleetline.functions import clock
from fleetline.operators import derive, headways, runs, schedule, upkeep
from fleetline.plans import fixtures

DIR = "/root/testdata/sf0.001"
EVENT = "service_date date, trip_id string, route_id string, direction_id int, vehicle_id string, stop_id string, stop_sequence int, scheduled_arrival_ts timestamp_ntz, observed_arrival_ts timestamp_ntz, deviation_sec int, source string, schedule_relationship string"
DAY = date(2024, 1, 10)


def _event(trip, seq, dev, *, vehicle="v", stop="s", rel="SCHEDULED", source="trip_update", minute=None):
    sched = datetime(2024, 1, 10, 13) + timedelta(minutes=10 * seq if minute is None else minute)
    return (DAY, trip, "r", 0, vehicle, stop, seq, sched, None if dev is None else sched + timedelta(seconds=dev), dev, source, rel)


def _plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_without_percentiles_are_the_same_runs(spark):
    rows = [
        _event("a", 1, 10, vehicle="v1"), _event("a", 2, None, vehicle="v9", rel="SKIPPED"), _event("a", 3, -5, vehicle=None), _event("a", 5, 40, vehicle="v2"), _event("a", 5, 70, vehicle="v3"),
        _event("a", 1, 99, vehicle="v1", source="proximity"), _event("b", 4, None, vehicle=None, rel=None), _event("c", 2, 7, vehicle="v5"), _event(None, 2, 7), _event("a", None, 3, vehicle="v8", minute=90),
    ]
    times = spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", 4)], "trip_id string, stop_sequence int")
    full = runs.aggregate_runs(spark.createDataFrame(rows, EVENT), times)
    lean = runs.aggregate_runs(spark.createDataFrame(rows, EVENT), times, percentiles=False)
    assert sorted(map(str, lean.collect())) == sorted(map(str, full.select(*lean.columns).collect()))
    of = {(r.trip_id, r.source): r for r in lean.collect()}
    run = of["a", "trip_update"]  # the last stop's vehicle; of two there the larger id
    assert (run.vehicle_id, run.stops_observed, run.stops_skipped, run.origin_dev_sec, run.destination_dev_sec) == ("v3", 5, 1, 10, 70)
    assert (of["b", "trip_update"].stops_observed, of["b", "trip_update"].vehicle_id, of["c", "trip_update"].sched_first_seq) == (0, None, None)


def test_runs_sort_their_events_once(spark, no_broadcast):
    made = runs.aggregate_runs(spark.createDataFrame([], EVENT), spark.createDataFrame([], "trip_id string, stop_sequence int"), percentiles=False)
    text = _plan(made)
    below = text[text.index("HashAggregate") :]  # beneath the first sums, rows are events
    assert sum("Sort [" in line and "sched_first_seq" not in line for line in below.splitlines()) == 2  # events, and the timetable's trips


def test_both_gaps_of_an_arrival_come_from_one_sort(spark, no_broadcast):
    rows = [_event("a", 1, 0, minute=0), _event("x", 1, 0, minute=1, rel="ADDED"), _event("b", 1, 0, minute=3), _event("c", 1, 0, minute=3), _event("y", 1, 0, minute=4, rel=None), _event("d", 1, 0, minute=13)]
    cells = spark.createDataFrame([(DAY, "r", 0, "s", 8, 600.0, 1200, 720000, 2)], "service_date date, route_id string, direction_id int, stop_id string, hour int, mean_h double, s_h long, s_h2 long, s_n long")
    made = headways.headway_statistics(spark.createDataFrame(rows, EVENT), cells)
    r = made.first()
    # next arrivals: 60, 120, 0, 60, 540 s; next scheduled ones of a, b, c: 180, 0 and 600 s, of which none is under 150
    assert (r.o_h, r.o_n, r.o_h2) == (780, 4, 60**2 + 120**2 + 60**2 + 540**2) and (r.n_headways, r.n_bunched) == (2, 0)
    assert _plan(made).count("Window [") == 1


def test_seconds_stored_with_the_timetable_are_not_parsed_again(spark):
    trips = spark.createDataFrame([(t, "r", 0, "WK") for t in "ab"], "trip_id string, route_id string, direction_id int, service_id string")
    texts = spark.createDataFrame([("a", "s", "25:00:00", 1), ("b", "s", "25:20:00", 1)], "trip_id string, stop_id string, arrival_time string, stop_sequence int")
    stored = texts.withColumn("arrival_sec", clock.gtfs_seconds(F.col("arrival_time"))).localCheckpoint()
    for make in (lambda t: schedule.scheduled_headways(trips, t, "service_id"), lambda t: schedule.route_service_hours(trips, t, trips.select("route_id").distinct()), schedule.scheduled_endpoints):
        assert sorted(map(str, make(stored).collect())) == sorted(map(str, make(texts).collect()))
        assert "split(" in _plan(make(texts)) and "split(" not in _plan(make(stored))


def test_cells_by_service_stand_for_their_headways(spark):
    head = spark.createDataFrame([("WK", "r", 0, "s", 8, h) for h in (300, 600)] + [("SA", "r", 0, "s", 8, 900)], "service_id string, route_id string, direction_id int, stop_id string, hour int, h_sec int")
    days = spark.createDataFrame([(DAY, "WK"), (date(2024, 1, 13), "SA"), (date(2024, 1, 13), "WK")], "service_date date, service_id string")
    seen = spark.createDataFrame([(DAY, "r", 0, "s", 8, 100, 1, 2), (date(2024, 1, 13), "r", 0, "s", 8, 700, 1, 2)], "service_date date, route_id string, direction_id int, stop_id string, hour int, h_sec long, leader_dev int, trailer_dev int")
    cells = headways.service_cells(head)
    for make in (lambda s: headways.ewt_by_period(seen, s, days), lambda s: headways.bunching_by_period(headways.bunching_pairs(seen, s, days)), lambda s: headways.scheduled_cells(s, days)):
        got = sorted(map(str, make(cells).collect()))
        assert got and got == sorted(map(str, make(head).collect()))


def test_queries_of_events_and_timetable_build_no_runs(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "_STORES", {})

    def refuse(*_):
        raise AssertionError("runs were built")

    monkeypatch.setattr(fixtures, "refresh_runs", refuse)
    for name in ("R08_anchor_date", "R13_period_drilldown"):
        assert catalog.queries()[name](spark, DIR).count() > 0


def test_fingerprints_sum_in_longs_and_tell_nulls_apart(spark):
    wide = [F.lit(1).alias(f"c{i:02d}") for i in range(65)]
    rows = spark.createDataFrame([(DAY,)] * 3, "service_date date").select("service_date", *wide)
    of = lambda df: upkeep.fingerprints({"t": df}).first()["print"]
    prints = {of(rows), of(rows.limit(2)), *(of(rows.withColumn(c, F.lit(None).cast("int"))) for c in ("c00", "c59", "c60", "c64"))}
    assert len(prints) == 6
    assert "decimal(20" not in _plan(upkeep.fingerprints({"t": rows}))


@pytest.mark.parametrize("n, want", [(90061, timedelta(days=1, hours=1, minutes=1, seconds=1)), (-5, timedelta(seconds=-5)), (1.25, timedelta(seconds=1.25)), (None, None)])
def test_seconds_as_an_interval(spark, n, want):
    assert spark.range(1).select(clock.seconds(F.lit(n).cast("double" if isinstance(n, float) else "int")).alias("x")).first()["x"] == want


def test_runs_of_events_that_know_their_trips_stops_shuffle_no_events(spark, no_broadcast):
    rows = [
        _event("a", 1, 10, vehicle="v1"), _event("a", 2, None, vehicle="v9", rel="SKIPPED"), _event("a", 5, 40, vehicle="v2"), _event("a", 5, 70, vehicle="v3"), _event("a", 7, 99, minute=20),
        _event("a", 3, 99, vehicle="v1", source="proximity"), _event("b", 0, 8, vehicle=None), _event("b", 4, None, rel=None), _event("c", 2, 7), _event(None, 2, 7),
    ]
    times = spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", 4)], "trip_id string, stop_sequence int")
    events = spark.createDataFrame(rows, EVENT)
    timed = events.join(runs.trip_stops(times), "trip_id", "left")
    want = runs.aggregate_runs(events, times, percentiles=False)
    got = runs.aggregate_runs(timed, None, percentiles=False)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = _plan(runs.aggregate_runs(spark.createDataFrame([], timed.schema), None, percentiles=False))
    assert "Join" not in text and "Window" not in text and text.rindex("HashAggregate") > text.rindex("Exchange")  # summed before the first shuffle


def test_stop_times_know_their_trips(spark):
    fx = fixtures.Fixture(spark, DIR)
    own = fx.stop_times_raw.select("trip_id", *runs.TRIP_STOPS).distinct()
    assert sorted(map(str, own.collect())) == sorted(map(str, runs.trip_stops(fx.stop_times).select(*own.columns).collect()))
    for make in (lambda t: schedule.scheduled_headways(fx.trips, t, "service_id"), lambda t: schedule.reference_stop(fx.trips, t), lambda t: schedule.route_stops(fx.trips, t, fx.stops)):
        got, want = make(fx.timetable), make(fx.stop_times)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and "orders" in str(want.inputFiles()) and "orders" not in str(got.inputFiles())


def test_what_a_table_was_made_of_is_not_read_again(spark, tmp_path):
    from fleetline.sources.dated import DatedTable

    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "d string, n long").select(F.to_date("d").alias("service_date"), "n")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = rows.mapInArrow(count, rows.schema)
    table, other = DatedTable(spark, str(tmp_path / "t"), rows.schema), rows.filter("n = 1")
    run = lambda told, more=other: upkeep.refresh(table, {"x": seen, "more": more}, lambda x: x["x"], "r", {"x": told})
    assert run({"2024-01-01": "p", "2024-01-02": "q"}).written == ("2024-01-01", "2024-01-02") and read.value == 2  # for the build, not for the prints
    assert run({"2024-01-01": "p", "2024-01-02": "q"}).same == ("2024-01-01", "2024-01-02") and read.value == 2
    assert run({"2024-01-01": "p", "2024-01-02": "z"}).written == ("2024-01-02",)
    assert run({"2024-01-01": "p", "2024-01-02": "z"}, other.withColumn("n", F.lit(5))).written == ("2024-01-01",)
    assert run({"2024-01-01": "p"}, rows).gone == () and run({"2024-01-01": "p"}, other).gone == ("2024-01-02",)


def test_a_changed_stop_time_rebuilds_its_date_of_runs_and_overlay(spark, tmp_path, monkeypatch):
    from fleetline.plans.rollup_queries import daily_batch

    fx = fixtures.Fixture(spark, DIR)
    daily_batch(fx, None, str(tmp_path))
    late = fixtures.Fixture(spark, DIR)
    late.stop_times_raw = fx.stop_times_raw.withColumn("l_quantity", F.when(F.col("day_off") == 5, 1).otherwise(F.col("l_quantity")))
    done = daily_batch(late, None, str(tmp_path))
    assert done["runs"][1].written == done["overlay"][1].written == ("2024-01-06",) and not done["overlay"][1].gone
    want = runs.aggregate_runs(late.stop_events, late.stop_times, percentiles=False)
    assert sorted(map(str, done["runs"][0].read().select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_pings_stay_one_row_where_their_stop_is_sought(spark):
    pings = spark.createDataFrame([(1, "r", 38.9, -77.05), (2, "r", 38.90045, -77.05), (3, "r", 38.9009, -77.05), (4, "q", 38.9, -77.05), (5, "r", None, -77.05)], "id long, route_id string, latitude double, longitude double")
    stops = spark.createDataFrame([("r", "b", "", 38.9, -77.05), ("r", "a", "", 38.9, -77.05), ("r", "c", "", 38.9005, -77.0496), ("r", "d", "", None, None)], "route_id string, stop_id string, stop_name string, stop_lat double, stop_lon double")
    found = derive.nearest_stop_within(pings, stops)
    assert sorted((r.id, r.stop_id) for r in found.collect()) == [(1, "a"), (2, "c")]
    lines = _plan(found).splitlines()
    assert [x for x in lines if "Generate" in x] and all("stop_lat" in x and "latitude" not in x for x in lines if "Generate" in x)

"""Hand-computed cases of the transit operators."""

import math
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetline.functions import clock, geo, labels
from fleetline.operators import corridors, derive, diagnostics, headways, metrics, rollups, runs, schedule
from fleetline.sources import tables


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- clock, geometry, labels


@pytest.mark.parametrize("text, want", [("05:00:00", 18000), ("25:30:15", 91815), ("bad", None), ("1:2", None), (" 7:05:09", 25509)])
def test_gtfs_seconds(spark, text, want):
    assert value(spark, clock.gtfs_seconds(F.lit(text))) == want


def test_wall_clock_and_elapsed_seconds_differ_when_clocks_change(spark):
    spring = F.lit("2024-03-10").cast("date")
    assert value(spark, clock.gtfs_time_to_utc(spring, F.lit(9000))) == datetime(2024, 3, 10, 7, 30)
    assert value(spark, clock.gtfs_time_to_utc(spring, F.lit(36000))) == datetime(2024, 3, 10, 14, 0)
    assert value(spark, clock.gtfs_seconds_to_local(spring, F.lit(36000))) == datetime(2024, 3, 10, 11, 0)
    assert value(spark, clock.gtfs_time_to_utc(F.lit("2024-01-05").cast("date"), F.lit(91800))) == datetime(2024, 1, 6, 6, 30)


def test_local_days_have_23_24_or_25_hours(spark):
    hours = []
    for d in ("2024-03-10", "2024-01-10", "2024-11-03"):
        a, b, _ = clock.local_day_bounds(F.lit(d).cast("date"))
        hours.append(value(spark, runs.seconds_between(a, b)) // 3600)
    assert hours == [23, 24, 25]


def test_period_tables(spark):
    rows = spark.range(24).select("id", labels.ewt_period(F.col("id")).alias("e"), labels.period_key(F.col("id")).alias("p"), labels.hour_in_period(F.col("id"), "late").alias("late")).collect()
    by = {r["id"]: r for r in rows}
    assert by[5]["e"] == "Night (0-6)" and by[9]["e"] == "Midday (9-15)" and by[23]["e"] == "Evening (19-24)"
    assert [i for i in range(24) if by[i]["late"]] == [0, 1, 2, 3, 4, 5, 22, 23] == [i for i in range(24) if by[i]["p"] == "late"]


@pytest.mark.parametrize("dev, want", [(-121, "early"), (-120, "on_time"), (420, "on_time"), (421, "late"), (None, None)])
def test_otp_window_is_inclusive(spark, dev, want):
    assert value(spark, labels.otp_bucket(F.lit(dev).cast("int"))) == want


def test_grades(spark):
    grade = lambda o, d, e: value(spark, labels.route_grade(labels.composite_score(F.lit(o).cast("double"), F.lit(d).cast("double"), F.lit(e).cast("double"))))
    assert grade(90, 1.0, 60) == "A" and grade(90, None, 60) == "N/A" and grade(0, 0.0, 400) == "F"
    assert grade(80, 0.8, None) == "A" and grade(50, 0.5, 180) == "C"


def test_geometry(spark):
    p = [F.lit(x) for x in (38.9, -77.0, 39.9, -77.0)]
    assert abs(value(spark, geo.haversine_m(*p)) - geo.DEGREE_M) < 1e-6
    assert value(spark, geo.haversine_m(F.lit(None).cast("double"), *p[1:])) is None
    assert value(spark, geo.bearing_deg(*p)) == 0.0
    assert value(spark, geo.cardinal8(F.lit(337.5))) == "N" and value(spark, geo.cardinal8(F.lit(337.4))) == "NW"
    assert value(spark, geo.bearing_distance(F.lit(350.0), F.lit(10.0))) == 20.0
    back = value(spark, geo.parse_wkt_linestring(F.lit("LINESTRING(-77.5 38.25, -77 39)")))
    assert [(r["lon"], r["lat"]) for r in back] == [(-77.5, 38.25), (-77.0, 39.0)]


# --- schedule


def test_services_by_date(spark):
    days = ", ".join(f"{d} int" for d in schedule.DAYS)
    cal = spark.createDataFrame([("W", 1, 1, 1, 1, 1, 0, 0, "20240101", "20240105")], f"service_id string, {days}, start_date string, end_date string")
    exc = spark.createDataFrame([("W", "20240103", 2), ("H", "20240103", 1), ("H", "oops", 1)], "service_id string, date string, exception_type int")
    got = schedule.service_ids_for_date(cal, exc, clock.date_spine(spark, "2024-01-01", "2024-01-07")).collect()
    assert {(r["service_date"].day, r["service_id"]) for r in got} == {(1, "W"), (2, "W"), (3, "H"), (4, "W"), (5, "W")}


def test_modal_services_tie_goes_to_the_latest_date(spark):
    rows = [(date(2024, 1, 2), "A"), (date(2024, 1, 9), "B"), (date(2024, 1, 6), "S"), (date(2024, 1, 13), "S"), (date(2024, 1, 13), "T"), (date(2024, 1, 20), "S")]
    got = {(r["day_type"], r["service_id"]) for r in schedule.modal_service_ids(spark.createDataFrame(rows, "service_date date, service_id string")).collect()}
    assert got == {("weekday", "B"), ("saturday", "S")}


def test_douglas_peucker_keeps_corners(spark):
    pts = [("s", 38.0, -77.0 + i * 0.001, i) for i in range(5)] + [("s", 38.0 + (i - 4) * 0.001, -76.996, i) for i in range(5, 9)] + [("two", 1.0, 1.0, 1), ("two", 1.0, 1.0, 2)]
    got = schedule.simplify_shapes(spark.createDataFrame(pts, "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")).collect()
    assert sorted((r["shape_id"], r["shape_pt_sequence"]) for r in got) == [("s", 0), ("s", 4), ("s", 8), ("two", 1), ("two", 2)]


# --- derivation


def test_anchor_moves_back_only_when_nearer_and_within_guard(spark):
    def at(obs, secs, guard=False):
        d, _ = derive.resolve_service_anchor(F.lit(obs).cast("timestamp_ntz"), F.lit("2024-01-10").cast("date"), F.lit(secs), proxy_guard=guard)
        return value(spark, d).day

    assert at("2024-01-10 06:10:00", 25 * 3600) == 9  # 01:10 local, scheduled at 25:00 of the day before
    assert at("2024-01-10 15:00:00", 36000) == 10
    assert at("2024-01-10 10:00:00", 25 * 3600, True) == 10  # four hours off: beyond the guard
    assert at("2024-01-10 08:00:00", 24 * 3600, True) == 9  # three hours, the guard itself


def test_first_ping_near_the_nearest_stop_of_the_route(spark):
    ntz = lambda m: datetime(2024, 1, 10, 13, m)
    pings = spark.createDataFrame(
        [(1, "v", "t", "r", 38.9001, -77.0, ntz(2)), (2, "v", "t", "r", 38.9, -77.0, ntz(5)), (3, "v", "t", "r", 38.95, -77.0, ntz(6)), (4, "v", "t", "r", 38.91, -77.0, ntz(7))],
        "id long, vehicle_id string, trip_id string, route_id string, latitude double, longitude double, timestamp timestamp_ntz",
    ).withColumn("service_date", F.lit("2024-01-10").cast("date"))
    stops = spark.createDataFrame([("r", "a", 38.9, -77.0), ("r", "other", 38.91, -77.0), ("q", "b", 38.95, -77.0)], "route_id string, stop_id string, stop_lat double, stop_lon double")
    times = spark.createDataFrame([("t", "a", "08:00:00", None, 1), ("t", "a", "09:00:00", None, 7)], "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int")
    trips = spark.createDataFrame([("t", "r", 0)], "trip_id string, route_id string, direction_id int")
    r = one(derive.derive_stop_events_proximity(pings, trips, times, stops))
    assert (r["stop_sequence"], r["observed_arrival_ts"], r["deviation_sec"]) == (1, ntz(2), 120)


# --- runs and metrics

EVENT = "service_date date, trip_id string, route_id string, direction_id int, vehicle_id string, stop_id string, stop_sequence int, scheduled_arrival_ts timestamp_ntz, observed_arrival_ts timestamp_ntz, deviation_sec int, source string, schedule_relationship string"


def events(spark, *rows):
    """(trip, seq, scheduled minute, deviation or None, source) at 13:00 UTC on one day."""
    out = []
    for trip, seq, minute, dev, source in rows:
        sched = datetime(2024, 1, 10, 13, minute)
        obs = None if dev is None else datetime.fromtimestamp(sched.timestamp() + dev)
        out.append((date(2024, 1, 10), trip, "r", 0, f"v{trip}", f"s{seq}", seq, sched, obs, dev, source, "SKIPPED" if dev is None else "SCHEDULED"))
    return spark.createDataFrame(out, EVENT)


def test_otp_of_five_deviations(spark):
    ev = events(spark, *[("t", i, i, d, "proximity") for i, d in enumerate([0, 30, 60, -30, 600])])
    assert one(metrics.system_otp_daily(ev))["otp_pct"] == 80.0


def test_run_row(spark):
    ev = events(spark, ("t", 1, 0, 10, "trip_update"), ("t", 2, 2, None, "trip_update"), ("t", 3, 4, -5, "trip_update"), ("t", 4, 10, 100, "trip_update"))
    st = spark.createDataFrame([("t", i) for i in range(1, 6)], "trip_id string, stop_sequence int")
    r = one(runs.aggregate_runs(ev, st))
    assert (r["stops_observed"], r["stops_skipped"], r["max_gap_sec"], r["dev_p50_sec"], r["stops_observable"]) == (3, 1, 465, 10, 4)
    assert (r["origin_dev_sec"], r["destination_dev_sec"], r["sched_last_seq"]) == (10, None, 5)


@pytest.mark.parametrize("observable, least", [(1, 1), (2, 1), (3, 2), (8, 2), (9, 3), (20, 6), (None, 2)])
def test_delivered_floor(spark, observable, least):
    assert value(spark, runs.delivered_floor(F.lit(observable).cast("int"))) == least


def test_average_wait(spark):
    df = spark.createDataFrame([(600,), (600,), (1200,)], "h int")
    assert df.agg(headways.awt(F.sum("h"), F.sum(F.col("h") * F.col("h"))).alias("x")).first()["x"] == 450.0


@pytest.mark.parametrize("a, b, want", [(500, -200, "both_off"), (500, 0, "leader_late_only"), (0, -200, "trailer_early_only"), (420, -120, "neither_off"), (None, 0, "unknown")])
def test_bunching_causes(spark, a, b, want):
    assert value(spark, headways.bunching_cause(F.lit(a).cast("int"), F.lit(b).cast("int"))) == want


def test_zero_gaps_stay_the_previous_arrival(spark):
    rows = [("a", 1, 0, 0, "trip_update"), ("b", 1, 0, 0, "trip_update"), ("c", 1, 10, 0, "trip_update")]
    got = headways.observed_headways(events(spark, *rows)).collect()
    assert [r["h_sec"] for r in got] == [600] and got[0]["hour"] == 8


def test_duty_ceiling():
    assert metrics.duty_ceiling([30]) == 1.0 and metrics.duty_ceiling([120]) == 0.5 and metrics.duty_ceiling([120, 180]) == 4 / 6


# --- diagnostics


def test_cumulative_slip_walks_consecutive_edges(spark):
    seg = [(1, 2, 9.0), (2, 3, 1.0), (2, 4, 50.0), (3, 4, 2.0), (4, 5, 4.0)]
    df = spark.createDataFrame([("r", 0, "all", a, b, f"s{a}", f"s{b}", x, 60) for a, b, x in seg], "route_id string, direction_id int, period string, from_seq int, to_seq int, from_stop string, to_stop string, mean_slip_sec double, n_obs int")
    got = {(r["from_seq"], r["to_seq"]): r["cum_slip_sec"] for r in diagnostics.cumulative_slip(df).collect()}
    assert got == {(2, 3): 1.0, (2, 4): 0.0, (3, 4): 3.0, (4, 5): 7.0}
    lay = spark.createDataFrame([("r", 0, 3, "s3")], "route_id string, direction_id int, stop_sequence int, stop_id string")
    assert {(r["from_seq"], r["to_seq"]): r["cum_slip_sec"] for r in diagnostics.cumulative_slip(df, lay).collect()} == {(2, 3): 1.0, (2, 4): 0.0, (4, 5): 5.0}


def test_two_routes_share_one_corridor(spark):
    pts, trips = [], []
    for r in ("F1", "F2", "F3"):
        trips.append((f"t{r}", r, 0, f"p{r}"))
        for i in range(10):
            lat, lon = (38.94, -77.07 + 0.001 * i) if r != "F3" else (38.90 + 0.001 * i, -77.10)
            pts.append((f"p{r}", lat, lon, i))
    t = spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int, shape_id string")
    s = spark.createDataFrame(pts, "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    found = corridors.corridor_runs(t, s)
    assert {(r["route_id"], r["routes"], r["n_points"], r["cardinal"]) for r in found.collect()} == {("F1", "F1,F2", 10, "E"), ("F2", "F1,F2", 10, "E")}
    stops = spark.createDataFrame([(r, f"s{i}", 38.94, -77.07 + 0.001 * i) for r in ("F1", "F2") for i in range(10)], "route_id string, stop_id string, stop_lat double, stop_lon double")
    order = spark.createDataFrame([(r, 0, f"s{i}", i) for r in ("F1", "F2") for i in range(10)], "route_id string, direction_id int, stop_id string, stop_sequence int")
    c = one(corridors.corridors(found, stops, order))
    assert (c["start_stop"], c["end_stop"], c["routes"]) == ("s0", "s9", "F1,F2") and c["wkt"].startswith("LINESTRING(-77.07 38.94")


# --- rollups, tables


def test_window_delta_needs_enough_days(spark):
    rows = [("r", date(2024, 1, d), False, float(d)) for d in range(1, 11)] + [("q", date(2024, 1, d), d < 8, 1.0) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "route_id string, service_date date, is_partial boolean, x double")
    got = {r["route_id"]: r["delta"] for r in rollups.window_delta(df, "x", "route_id").collect()}
    assert got == {"r": 7.0 - 2.0, "q": None}


def test_profile_hash_ignores_order(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, None)], "k string, a int, b string")
    h = lambda df: one(rollups.profile_hash(df, "k"))["profile_hash"]
    assert h(a) == h(a.orderBy(F.desc("a"))) != h(a.withColumn("a", F.col("a") + 1))


def test_feed_folder(spark, tmp_path):
    put = lambda n, text: (tmp_path / f"{n}.txt").write_text(text, encoding="utf-8-sig")
    put("routes", "route_id,route_type\nR1,3\n")
    put("stops", "stop_id,stop_lat,stop_lon\nS1,38.9,-77.0\n")
    put("trips", "route_id,service_id,trip_id\nR1,W,T1\n")
    put("stop_times", "trip_id,arrival_time,stop_id,stop_sequence\nT1,25:10:00,S1,1\n")
    feed = tables.gtfs_read(spark, str(tmp_path))
    assert one(feed["stop_times"])["stop_sequence"] == 1 and one(feed["routes"])["route_id"] == "R1" and feed["calendar"].count() == 0
    put("trips", "route_id,trip_id\nR1,T1\n")
    with pytest.raises(ValueError, match="service_id"):
        tables.gtfs_read(spark, str(tmp_path))


def test_archive_goes_by_whole_days_and_refuses_nothing_lost(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i // 4, 6 * (i % 4))) for i in range(12)]
    pos = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz")
    left = tables.archive_and_expire(pos, F.lit("2024-01-02 01:00:00").cast("timestamp_ntz"), str(tmp_path / "a"))
    assert sorted(r["id"] for r in left.collect()) == [8, 9, 10, 11]
    assert sorted(r["id"] for r in tables.archive_load(left, spark.read.parquet(str(tmp_path / "a"))).collect()) == list(range(12))


def test_json_lines_and_partitions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"trip_id":"t","stop_sequence":1,"snapshot_ts":"2024-01-01 00:00:00","predicted_arrival_ts":1704067260}\n{"trip_id":"t"}\n')
    r = one(tables.tu_jsonl_read(spark, str(tmp_path / "a.jsonl")))
    assert r["predicted_arrival_ts"] == datetime(2024, 1, 1, 0, 1)
    (tmp_path / "b.jsonl").write_text('{"trip_id":"u","extra":1}\n')
    assert tables.tu_jsonl_to_parquet(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], str(tmp_path / "p")).count() == 3
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.replace_partition(df, str(tmp_path / "t"), "k")
    tables.replace_partition(df.filter("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}


def _match_world(spark):
    """Trip A (direction 0) and B (direction 1) of route R, 09:00 at S1 and 09:10 at S2, about 1.1 km apart."""
    trips = spark.createDataFrame([("A", "R", 0), ("B", "R", 1)], "trip_id string, route_id string, direction_id int")
    rows = [(t, s, at, at, n) for t, shift in (("A", 0), ("B", 30)) for n, (s, at) in enumerate([("S1", f"09:{shift:02d}:00"), ("S2", f"09:{shift + 10:02d}:00")], 1)]
    stop_times = spark.createDataFrame(rows, "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int")
    stops = spark.createDataFrame([("S1", 38.90, -77.05), ("S2", 38.91, -77.05)], "stop_id string, stop_lat double, stop_lon double")
    return trips, stop_times, stops


@pytest.mark.parametrize(
    "reported, route, clock_time, want",
    [
        ("A", "R", "08:52:00", ("A", (7 / 15 + 1) / 2)),  # own trip eight minutes early: fits, and no malus
        ("A", "R", "09:12:00", ("A", (3 / 15 + 1) / 2)),  # own trip twelve minutes late: no bonus
        ("Z", "R", "09:30:00", ("B", 1.0)),  # unknown trip: any direction; the bonus stops at 1
        (None, "R", "09:12:00", ("A", (3 / 15 + 1) / 2)),  # twelve late, neither bonus nor malus
        (None, "R", "09:26:00", ("B", (11 / 15 + 1) / 2 - 0.1)),  # four early
        (None, "R", "08:54:00", None),  # six early is too early without a reported trip
        (None, None, "09:00:00", None),  # no route
        ("A", "R", "09:30:00", None),  # own trip too late, and trips of the other direction don't count
    ],
)
def test_matching_trip(spark, reported, route, clock_time, want):
    pings = spark.sql(f"SELECT 1L AS id, 'V' AS vehicle_id, {repr(reported) if reported else 'CAST(NULL AS STRING)'} AS trip_id, {repr(route) if route else 'CAST(NULL AS STRING)'} AS route_id, TIMESTAMP_NTZ '2024-01-02 {clock_time}' AS timestamp, 38.90D AS latitude, -77.05D AS longitude")
    got = [(r["trip_id"], r["confidence"]) for r in derive.find_matching_trip(pings, *_match_world(spark)).collect()]
    assert got == ([] if want is None else [(want[0], pytest.approx(want[1]))])


def _walked(ping, visits):
    """(confidence, stop_sequence) of a ping with one trip's visits, as the operator's contract words it; None if none is near."""
    held = None
    for seq, _, sec, d in sorted(visits):
        late = (ping - sec) / 60
        if d > 500 or not -5 <= late <= 15:
            continue
        time = abs(late) / 20 if abs(late) <= 2 else 0.3 - late / 15 * 0.7 if late < 0 else late / 15 * 0.5
        if held is None or (time + d / 500) / 2 < held[0]:
            held = ((abs(late) / 15 + d / 500) / 2, late, d, seq)
    if held is None:
        return None
    _, late, d, seq = held
    bonus = 0.1 if -2 <= late <= 10 else -0.1 if late < -2 else 0.0
    return max(0.0, min(1.0, ((1 - abs(late) / 15) + (1 - d / 500)) / 2 + bonus)), seq


def test_matching_in_a_dense_timetable_makes_no_pairs(spark):
    """Hundreds of trips pass each ping; a third of them loop or start late.  No row of a plan is a pair of ping and trip."""
    rng = random.Random(3)
    places = {f"S{k}": 38.90 + k * 0.0012 for k in range(8)}
    trips, visits = [], []
    for i in range(400):
        start, at = rng.randrange(28_000, 37_000), rng.sample(sorted(places), 8) if i % 3 == 0 else [f"S{k}" for k in range(rng.choice((0, 0, 5)), 8)]
        start = start - start % 60 if i % 5 else start
        trips.append((f"T{i}", "R", i % 2))
        visits += [(f"T{i}", s, f"{x // 3600:02d}:{x % 3600 // 60:02d}:{x % 60:02d}", k + 1) for k, s in enumerate([*at, at[0]] if i % 3 == 0 else at) for x in [start + k * 90]]
    pings = [(j, "V", rng.choice((None, "T0", "T1")), "R", datetime(2024, 1, 2) + timedelta(seconds=rng.randrange(27_000, 39_000)), 38.90 + rng.random() * 0.01, -77.05) for j in range(300)]
    world = spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int"), spark.createDataFrame(visits, "trip_id string, stop_id string, arrival_time string, stop_sequence int"), spark.createDataFrame([(s, x, -77.05) for s, x in places.items()], "stop_id string, stop_lat double, stop_lon double")
    asked = spark.createDataFrame(pings, "id long, vehicle_id string, trip_id string, route_id string, timestamp timestamp_ntz, latitude double, longitude double")
    df = derive.best_candidates(asked, *world)
    got = {r["id"]: (r["trip_id"], r["stop_sequence"], round(r["confidence"], 9)) for r in df.collect()}
    way, of = {t: d for t, _, d in trips}, {}
    for t, s, clock_time, k in visits:
        h, m, x = map(int, clock_time.split(":"))
        of.setdefault(t, []).append((k, s, h * 3600 + m * 60 + x))
    want = {}
    for j, _, told, _, when, lat, _ in pings:
        sec = (when - datetime(2024, 1, 2)).total_seconds()
        dist = {s: round(2 * 6_371_000.0 * math.asin(abs(math.sin(math.radians(y - lat) / 2))), 6) for s, y in places.items()}
        found = [(-w[0], t, w[1]) for t, v in of.items() if told is None or way[told] == way[t] if (w := _walked(sec, [(k, s, x, dist[s]) for k, s, x in v]))]
        best = min(found, default=(0, "", 0))
        if -best[0] > 0.3:
            want[j] = (best[1], best[2], round(-best[0], 9))
    assert got == want and len(want) > 200
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().toString()


def test_nearest_stop_in_the_far_north(spark):
    stops = spark.createDataFrame([("R", "S", 78.0, 15.0)], "route_id string, stop_id string, stop_lat double, stop_lon double")
    pings = spark.createDataFrame([(1, "R", 78.0, 15.0 + 45 / (111_195 * 0.2079)), (2, "R", 78.0, 15.01)], "id long, route_id string, latitude double, longitude double")
    got = derive.nearest_stop_within(pings, stops).collect()
    assert [(r["id"], r["stop_id"]) for r in got] == [(1, "S")] and got[0]["dist_m"] == pytest.approx(45, abs=0.1)


def test_trip_match_flags(spark):
    trips, stop_times, stops = _match_world(spark)
    trips = trips.selectExpr("*", "if(trip_id = 'A', 'P', 'none') AS shape_id")
    shapes = spark.createDataFrame([("P", 38.90, -77.05, 1), ("P", 38.91, -77.05, 2)], "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    rows = [(1, "A", "R", 20.0, 38.90), (2, "A", "R", 180.0, 38.90), (3, "A", "R", None, 38.99), (4, "B", "Q", 0.0, 38.99)]
    pings = spark.createDataFrame(rows, "id long, trip_id string, route_id string, bearing double, latitude double").selectExpr("*", "-77.05D AS longitude", "TIMESTAMP_NTZ '2024-01-02 09:05:00' AS timestamp")
    got = {r["id"]: (r["direction_ok"], r["shape_ok"], r["warnings"]) for r in derive.validate_trip_match(pings, trips, stop_times, stops, shapes).collect()}
    assert got == {1: (True, True, []), 2: (False, True, ["direction_mismatch"]), 3: (None, False, ["shape_mismatch"]), 4: (True, None, ["route_mismatch"])}


def _corridors_of(spark, spans):
    """Corridors of runs of one street, given as (from, to) stops 0 to 9, a kilometre each, for routes F1 and F2."""
    lon = lambda i: -77.07 + 0.01 * i
    rows = [(f"F{k % 2 + 1}", 0, n, "F1,F2", abs(b - a) * 870.0, "E", [(0, lon(a), 38.94), (1, lon(b), 38.94)]) for n, (a, b) in enumerate(spans) for k in (0, 1)]
    found = spark.createDataFrame(rows, "route_id string, direction_id int, from_seq int, routes string, length_m double, cardinal string, points array<struct<seq:int,lon:double,lat:double>>")
    stops = spark.createDataFrame([(r, f"s{i}", 38.94, lon(i)) for r in ("F1", "F2") for i in range(10)], "route_id string, stop_id string, stop_lat double, stop_lon double")
    order = spark.createDataFrame([(r, 0, f"s{i}", i) for r in ("F1", "F2") for i in range(10)], "route_id string, direction_id int, stop_id string, stop_sequence int")
    return sorted((c["start_stop"], c["end_stop"]) for c in corridors.corridors(found, stops, order).collect())


@pytest.mark.parametrize(
    "spans, want",
    [
        ([(0, 2), (2, 5), (5, 6)], [("s0", "s6")]),  # a chain becomes one
        ([(0, 2), (2, 5), (2, 4)], [("s0", "s5")]),  # the side branch lies within the chain and goes
        ([(0, 3), (3, 4), (3, 9), (1, 8)], [("s0", "s9")]),  # nested runs go
        ([(0, 3), (2, 5)], [("s0", "s3"), ("s2", "s5")]),  # overlapping, not nested
        ([(0, 1), (5, 7), (7, 5)], [("s0", "s1"), ("s5", "s7"), ("s7", "s5")]),  # a cycle beside a chain stays
    ],
)
def test_corridors_merge_and_nest(spark, spans, want):
    assert _corridors_of(spark, spans) == want


def test_service_profile_keeps_day_types_apart(spark):
    trips = [(f"{s}{i}", "R", s, 0) for s, n in (("WK", 5), ("SA", 2)) for i in range(n)]
    times = [(f"WK{i}", "S", f"08:{12 * i:02d}:00", 1) for i in range(5)] + [(f"SA{i}", "S", f"08:{6 + 40 * i:02d}:00", 1) for i in range(2)]
    t = spark.createDataFrame(trips, "trip_id string, route_id string, service_id string, direction_id int")
    st = spark.createDataFrame(times, "trip_id string, stop_id string, arrival_time string, stop_sequence int")
    days = spark.createDataFrame([("weekday", "WK"), ("saturday", "SA")], "day_type string, service_id string")
    profile = schedule.route_service_profile(t, st, days)
    assert {r["day_type"]: (r["n_arrivals"], r["mean_headway_min"], r["is_frequent"]) for r in profile.collect()} == {"weekday": (5, 12.0, True), "saturday": (2, 40.0, False)}
    routes = spark.createDataFrame([("R", "R"), ("RX", "RX"), ("Q", "QX")], "route_id string, route_short_name string")
    assert {r["route_id"]: r["frequency_class"] for r in schedule.frequency_class(profile, routes).collect()} == {"R": "high", "RX": "limited_stop", "Q": None}


def test_route_anchor_prefers_a_scheduled_system_date(spark):
    events = spark.createDataFrame([("A", date(2024, 1, 7)), ("B", date(2024, 1, 5)), ("C", date(2024, 1, 5))], "route_id string, service_date date")
    due = spark.createDataFrame([("A", date(2024, 1, 7)), ("B", date(2024, 1, 7)), ("C", date(2024, 1, 5))], "route_id string, service_date date")
    routes = spark.createDataFrame([(r,) for r in "ABCD"], "route_id string")
    got = {r["route_id"]: r["anchor_date"].day for r in rollups.route_anchor_date(events, due, routes).collect()}
    assert got == {"A": 7, "B": 7, "C": 5}  # B is due but unseen; D has nothing


def test_rolling_mean_reaches_over_dates(spark):
    devs = [0, 900, 0, 0, 900, 0]
    rows = [("R", "t", n, datetime(2024, 1, 1 + n // 2, 12, n), d, "proximity") for n, d in enumerate(devs)]
    events = spark.createDataFrame(rows, "route_id string, trip_id string, stop_sequence int, observed_arrival_ts timestamp_ntz, deviation_sec int, source string")
    got = {r["stop_sequence"]: r["rolling_otp"] for r in metrics.rolling_otp(events, 4).collect()}
    assert got == {n: pytest.approx(sum(d == 0 for d in devs[max(0, n - 3) : n + 1]) / min(4, n + 1)) for n in range(6)}


def test_run_after_midnight_belongs_to_the_day_before(spark):
    st = spark.createDataFrame([("T", "S1", "24:10:00", 1), ("T", "S2", "24:20:00", 2)], "trip_id string, stop_id string, arrival_time string, stop_sequence int")
    stops = spark.createDataFrame([("R", "S1", 38.9, -77.0), ("R", "S2", 38.91, -77.0)], "route_id string, stop_id string, stop_lat double, stop_lon double")
    rows = [(1, datetime(2024, 1, 3, 0, 9), 38.9, 2), (2, datetime(2024, 1, 3, 0, 11), 38.9, 1), (3, datetime(2024, 1, 3, 0, 27), 38.91, 0)]
    pings = spark.createDataFrame([(i, "T", "V", "R", ts, lat, -77.0, 5.0, s) for i, ts, lat, s in rows], "id long, trip_id string, vehicle_id string, route_id string, timestamp timestamp_ntz, latitude double, longitude double, speed double, current_status int")
    r = one(metrics.run_quality(pings, stops, st))
    assert (r["service_date"], r["stops_observed"], r["on_time_stops"], r["late_stops"], r["max_gap_sec"], r["is_complete"]) == (date(2024, 1, 2), 2, 1, 1, 960, False)


# --- shapes, chains and archives at scale


def _simplified(points, tolerance):
    """Douglas-Peucker by recursion: the numbers of the points that stay."""

    def span(a, b):
        (ax, ay), (bx, by) = points[a], points[b]
        lx, ly = bx - ax, by - ay
        length = math.hypot(lx, ly)
        off = [(abs(lx * (y - ay) - ly * (x - ax)) / length if length else math.hypot(x - ax, y - ay)) for x, y in points[a + 1 : b]]
        if not off or max(off) <= tolerance:
            return []
        k = a + 1 + off.index(max(off))
        return [*span(a, k), k, *span(k, b)]

    return sorted({0, len(points) - 1, *span(0, len(points) - 1)})


def test_simplification_level_by_level_is_the_recursion(spark):
    rng = random.Random(3)
    shapes = {"one": [(0.0, 0.0)], "same": [(1.0, 1.0)] * 5, "loop": [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], "spike": [(float(i), float(i == 40) * 9) for i in range(90)]}
    for k in range(12):
        at, pts = (0.0, 0.0), []
        for _ in range(rng.randint(2, 120)):
            at = (at[0] + rng.uniform(-1, 2), at[1] + rng.uniform(-1, 1))
            pts.append(at)
        shapes[f"walk{k}"] = pts
    rows = [(s, y, x, 10 * i + 3) for s, pts in shapes.items() for i, (x, y) in enumerate(pts)]
    rng.shuffle(rows)
    got = schedule.simplify_shapes(spark.createDataFrame(rows, "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int"), 1.1).collect()
    assert sorted((r.shape_id, r.shape_pt_sequence) for r in got) == sorted((s, 10 * i + 3) for s, pts in shapes.items() for i in _simplified(pts, 1.1))


def _chained(rows):
    """Chains by walking, from the first start on: (start, end, length) of each."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    follow = {}
    for r in rows:
        follow.setdefault(r[0], r)
    ends, taken, out = {r[1] for r in rows}, set(), []
    for head in [r for r in rows if r[0] not in ends]:
        links, n = [], head
        while n is not None and n not in taken:
            links.append(n)
            taken.add(n)
            n = follow.get(n[1])
        if links:
            out.append((links[0][0], links[-1][1], round(sum(x[2] for x in links), 6)))
    return sorted(out + [(a, b, round(n, 6)) for a, b, n in rows if (a, b, n) not in taken])


def test_chains_by_pointer_jumping_are_those_of_a_walk(spark):
    rng = random.Random(9)
    for n, stops in ((40, 25), (60, 90), (30, 6)):
        rows = sorted({(f"s{a}", f"s{b}", float(rng.randint(500, 600))) for a, b in ((rng.randrange(stops), rng.randrange(stops)) for _ in range(n)) if a != b})
        rows = list({(a, b): (a, b, c) for a, b, c in rows}.values()) + [(f"t{i}", f"t{i + 1}", 500.0 + i) for i in range(37)] + [("c1", "c2", 1.0), ("c2", "c1", 2.0)]
        df = spark.createDataFrame([("E", "1,2", a, b, c, "LINESTRING(0 0, 1 1)") for a, b, c in rows], "cardinal string, routes string, start_stop string, end_stop string, length_m double, wkt string")
        spans = F.lit(None).cast("map<struct<route_id:string,direction_id:int>,struct<a:int,b:int>>")
        got = corridors.merge_chains(df.withColumn("spans", spans)).collect()
        assert sorted((r.start_stop, r.end_stop, round(r.length_m, 6)) for r in got) == _chained(rows)


def test_a_hot_day_is_archived_by_several_tasks_in_order(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1704067200) + F.when(F.col("id") < 3000, (F.col("id") * 7919) % 86_400).otherwise(86_400 + F.col("id") % 300 * 60)).cast("timestamp_ntz")
    pings = spark.range(3300).repartition(5).select("id", at.alias("timestamp"))
    cutoff = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    tables.archive_write(pings, cutoff, str(tmp_path / "a"), rows_per_file=500)
    archive = spark.read.parquet(str(tmp_path / "a"))
    files = tables.archive_files(archive).collect()
    hot = [f for f in files if str(f.day) == "2024-01-01"]
    assert len(hot) >= 4 and sum(f.n for f in files) == 3300 and max(f.n for f in hot) < 1500
    assert all(a.last_ts <= b.first_ts for a, b in zip(hot, hot[1:]))
    for f in hot:  # sorted inside
        ts = [r.timestamp for r in spark.read.parquet(f.file).select("timestamp").collect()]
        assert ts == sorted(ts)
    checked = tables.archive_verify(pings, archive).collect()
    assert all(r.ok for r in checked) and {str(r.day): r.n_files for r in checked}["2024-01-01"] == len(hot)
    spark.read.parquet(hot[0].file).limit(100).write.mode("append").parquet(str(tmp_path / "a/day=2024-01-01"))  # rows twice, out of order
    assert not next(r.ok for r in tables.archive_verify(pings, spark.read.parquet(str(tmp_path / "a"))).collect() if str(r.day) == "2024-01-01")


def _wide_shuffles(df, column):
    """Exchanges of a plan whose rows hold ``column``, as they would run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "AdaptiveSparkPlan" in plan
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return sum(column in block for block in re.findall(r"\(\d+\) Exchange\n(.*?)\n\n", text, re.S))


def test_runs_and_delivered_trips_shuffle_their_rows_once(spark):
    events = spark.createDataFrame([], "service_date date, trip_id string, route_id string, direction_id int, vehicle_id string, stop_id string, stop_sequence int, scheduled_arrival_ts timestamp_ntz, observed_arrival_ts timestamp_ntz, deviation_sec int, source string, schedule_relationship string")
    made = runs.aggregate_runs(events, spark.createDataFrame([], "trip_id string, stop_sequence int"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _wide_shuffles(made, "deviation_sec") == 1
        due, ran = (spark.createDataFrame([], f"service_date date, route_id string, trip_id string{more}") for more in ("", ", stops_observed int, stops_observable int"))
        assert _wide_shuffles(runs.service_delivered(ran, due), "trip_id") == 2  # of each side one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

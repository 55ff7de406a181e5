"""Queries of sources, table-wide projections and the static schedule."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetline.functions import clock, geo, labels
from fleetline.operators import rollups, schedule
from fleetline.plans.fixtures import AS_OF, DAY0, Fixture
from fleetline.plans.registry import query
from fleetline.sources import tables
from fleetline.sources.scratch import scratch_path

CUTOFF = "2024-01-10 12:00:00"
NOW = "2024-01-14 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def versioned(fx: Fixture):
    base = fx.stops.select("stop_id", "stop_name", "stop_num")
    first = base.select("stop_id", "stop_name", F.lit(1).alias("snapshot_id"), F.lit("2023-12-01").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    fresh = base.filter("stop_num % 3 <> 0").select("stop_id", F.concat(F.col("stop_name"), F.lit("+")).alias("stop_name"))
    return tables.apply_snapshot(first, fresh, 2, _now())


@query("A02_gtfs_apply_snapshot", """ SELECT stop_id, stop_name, 1 AS snapshot_id, false AS is_current, true AS closed FROM stops
  UNION ALL SELECT stop_id, concat(stop_name, '+'), 2, true, false FROM stops WHERE stop_num % 3 <> 0""")
def _(fx):
    return versioned(fx).select("stop_id", "stop_name", "snapshot_id", "is_current", F.col("valid_to").isNotNull().alias("closed"))


@query("A02_snapshot_counts", " SELECT (SELECT count(*) FROM stops) AS n_stops, (SELECT count(*) FROM fx_trips) AS n_trips, (SELECT count(*) FROM fx_st) AS n_stop_times")
def _(fx):
    return tables.snapshot_counts({"stops": fx.stops, "trips": fx.trips, "stop_times": fx.stop_times})


@query("A03_gtfs_version_filter", " SELECT stop_id, concat(stop_name, '+') AS stop_name, 2 AS snapshot_id FROM stops WHERE stop_num % 3 <> 0")
def _(fx):
    return schedule.gtfs_version_filter(versioned(fx)).select("stop_id", "stop_name", "snapshot_id")


_OLD = f"SELECT CAST(ts AS DATE) AS day FROM pos GROUP BY 1 HAVING min(ts) < TIMESTAMP '{CUTOFF}'"


def _archived(fx: Fixture):
    """An archive of the old days, in files of a few thousand rows."""
    path = scratch_path(fx.spark, "archive")
    tables.archive_write(fx.positions, F.lit(CUTOFF).cast("timestamp_ntz"), path, rows_per_file=5_000)
    return fx.spark.read.schema(fx.positions.withColumn("day", F.to_date("timestamp")).schema).parquet(path)


@query("A04_vp_archive", f" SELECT id, CAST(ts AS DATE) AS day FROM pos WHERE CAST(ts AS DATE) IN ({_OLD})")
def _(fx):
    return _archived(fx).select("id", "day")


@query("A05_archive_verify", f" SELECT CAST(ts AS DATE) AS day, count(*) AS archived, count(*) AS kept, true AS ok FROM pos WHERE CAST(ts AS DATE) IN ({_OLD}) GROUP BY 1")
def _(fx):
    return tables.archive_verify(fx.positions, _archived(fx)).select("day", "archived", "kept", "ok")


@query("A06_vp_archive_load", " SELECT id, vehicle_id FROM pos")
def _(fx):  # what is recent, restored from an archive of everything
    return tables.archive_load(fx.positions.filter(F.col("timestamp") >= F.lit(CUTOFF).cast("timestamp_ntz")), fx.positions).select("id", "vehicle_id")


@query("A09_upsert_by_key", """ SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, '!') ELSE c_name END AS name FROM customer WHERE c_custkey % 4 <> 1
  UNION ALL SELECT c_custkey, concat(c_name, '!') FROM customer WHERE c_custkey % 4 = 1""")
def _(fx):
    c = fx.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = c.filter("k % 4 < 2 AND (k % 4 = 0 OR k % 4 = 1)").select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"), "name")
    new = new.select("k", "v", F.when(F.col("v") == 2, F.concat("name", F.lit("!"))).otherwise("stale").alias("name"))
    return tables.upsert_by_key(c.filter("k % 4 <> 1"), new, ["k"], ["v"])


@query("A11_retention_filter", f" SELECT service_date, trip_id, source FROM runs WHERE service_date >= DATE '{AS_OF}' - 7")
def _(fx):
    return tables.retention_filter(fx.runs, "service_date", AS_OF, 7).select("service_date", "trip_id", "source")


@query("A12_backfill_shape_block_ids", " SELECT trip_id, CASE WHEN trip_num % 4 = 0 THEN 'NEW' ELSE shape_id END AS shape_id, block_id FROM fx_trips")
def _(fx):
    fresh = fx.trips_raw.filter("trip_num % 4 = 0").select("trip_id", F.lit("NEW").alias("shape_id"), F.lit(None).cast("string").alias("block_id"))
    return tables.backfill(fx.trips, fresh).select("trip_id", "shape_id", "block_id")


TIERS = {"R1": "high", "R2": "medium", "R5": "high", "R40": "high"}
TARGETS = {"otp": 75.0, "service_delivered": 0.9, "ewt": 120.0, "bunching": 0.1}
ROUTE_TARGETS = {("R1", "otp"): 80.0, ("R2", "ewt"): 60.0}
TIER_SQL = "(VALUES ('R1', 900), ('R2', 1200), ('R5', 900), ('R40', 900)) t(route_id, gate_sec)"
TARGET_SQL = "(VALUES ('otp', 75.0::DOUBLE, false), ('service_delivered', 0.9, false), ('ewt', 120.0, true), ('bunching', 0.1, true)) t(metric, target, lower)"
OWN_SQL = "(VALUES ('R1', 'otp', 80.0::DOUBLE), ('R2', 'ewt', 60.0)) o(route_id, metric, own)"


def config(fx: Fixture):
    return tables.dim_config(fx.spark, TIERS, TARGETS, ROUTE_TARGETS)


@query("A13_dim_config", f" SELECT r.route_id, t.metric, coalesce(o.own, t.target) AS target FROM (SELECT DISTINCT route_id FROM fx_trips) r CROSS JOIN {TARGET_SQL} LEFT JOIN {OWN_SQL} ON o.route_id = r.route_id AND o.metric = t.metric", "target")
def _(fx):
    return rollups.targets_of(fx.trips.select("route_id").distinct(), config(fx)[1])


@query("A14_archive_and_expire", f" SELECT id FROM pos WHERE CAST(ts AS DATE) NOT IN ({_OLD})")
def _(fx):
    return tables.archive_and_expire(fx.positions, F.lit(CUTOFF).cast("timestamp_ntz"), scratch_path(fx.spark, "archive")).select("id")


# --- sources: what the operators read is first written from the tables


@query("A01_gtfs_read", " SELECT s.trip_id, s.route_id, s.service_id, s.stop_id, s.stop_sequence, s.arrival_sec, t.stop_lat FROM fx_st s LEFT JOIN stops t ON t.stop_id = s.stop_id", "stop_lat")
def _(fx):
    folder = scratch_path(fx.spark, "feed")
    for name, df in {"routes": fx.routes, "stops": fx.stops.drop("stop_num"), "trips": fx.trips, "stop_times": fx.stop_times.drop("arrival_sec")}.items():
        df.write.option("header", True).csv(f"{folder}/{name}.txt")
    feed = tables.gtfs_read(fx.spark, folder)
    rows = feed["stop_times"].join(feed["trips"], "trip_id").join(feed["routes"].select("route_id"), "route_id").join(feed["stops"], "stop_id", "left")
    return rows.select("trip_id", "route_id", "service_id", "stop_id", "stop_sequence", clock.gtfs_seconds(F.col("arrival_time")).cast("int").alias("arrival_sec"), "stop_lat")


def _update_lines(fx: Fixture):
    """Trip updates as the collector writes them: text and epoch seconds."""
    epoch = F.unix_timestamp(F.col("predicted_arrival_ts").cast("timestamp"))
    return fx.trip_updates.select(F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss").alias("snapshot_ts"), "trip_id", "stop_id", "vehicle_id", F.when(F.col("line_no") % 9 != 0, F.col("stop_sequence")).alias("stop_sequence"), epoch.alias("predicted_arrival_ts"), "schedule_relationship", "trip_start_date")


@query("A07_tu_jsonl_read", " SELECT date_trunc('second', snapshot_ts) AS snapshot_ts, trip_id, stop_id, vehicle_id, stop_sequence, date_trunc('second', pred) AS predicted_arrival_ts, rel AS schedule_relationship FROM tu WHERE line_no % 9 <> 0")
def _(fx):
    path = scratch_path(fx.spark, "updates")
    _update_lines(fx).write.option("compression", "gzip").json(path)
    return tables.tu_jsonl_read(fx.spark, path).select("snapshot_ts", "trip_id", "stop_id", "vehicle_id", "stop_sequence", "predicted_arrival_ts", "schedule_relationship")


@query("A08_tu_jsonl_to_parquet", " SELECT trip_id, CASE WHEN line_no % 2 = 0 THEN stop_id END AS stop_id, CASE WHEN line_no % 2 = 1 THEN rel END AS schedule_relationship FROM tu")
def _(fx):
    paths = [scratch_path(fx.spark, f"drift{k}") for k in (0, 1)]
    for k, (path, column) in enumerate(zip(paths, ("stop_id", "schedule_relationship"))):
        fx.trip_updates.filter(F.col("line_no") % 2 == k).select("trip_id", column).write.json(path)
    return tables.tu_jsonl_to_parquet(fx.spark, paths, scratch_path(fx.spark, "merged")).select("trip_id", "stop_id", "schedule_relationship")


@query("A10_replace_partition", " SELECT service_date, trip_id, source, CASE WHEN service_date = DATE '2024-01-05' THEN 'new' ELSE 'old' END AS tag FROM runs")
def _(fx):
    path = scratch_path(fx.spark, "runs")
    rows = fx.runs.select("service_date", "trip_id", "source", F.lit("old").alias("tag"))
    tables.replace_partition(rows, path, "service_date")
    tables.replace_partition(rows.filter("service_date = date'2024-01-05'").withColumn("tag", F.lit("new")), path, "service_date")
    return fx.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


# --- table-wide projections

_SE_KEY = ["service_date", "trip_id", "stop_sequence", "source"]


@query("B01_gtfs_seconds", " SELECT trip_id, stop_sequence, arrival_sec AS sec FROM fx_st")
def _(fx):
    return fx.stop_times.select("trip_id", "stop_sequence", clock.gtfs_seconds(F.col("arrival_time")).alias("sec"))


@query("B02_gtfs_time_to_utc", f" SELECT trip_id, stop_sequence, TIMESTAMP '{DAY0} 05:00:00' + to_seconds(day_off * 86400 + arrival_sec) AS arrival_utc FROM fx_st")
def _(fx):
    st = fx.stop_times.join(fx.trips_raw.select("trip_id", "day_off"), "trip_id")
    date = F.date_add(F.lit(DAY0).cast("date"), F.col("day_off"))
    return st.select("trip_id", "stop_sequence", clock.gtfs_time_to_utc(date, clock.gtfs_seconds(F.col("arrival_time"))).alias("arrival_utc"))


@query("B03_gtfs_seconds_to_local", """ SELECT trip_id, stop_sequence, TIMESTAMP '2024-03-10 00:00:00' + to_seconds(arrival_sec + CASE WHEN arrival_sec >= 7200 THEN 3600 ELSE 0 END) AS local_ts FROM fx_st""")
def _(fx):  # on the day the clocks go forward
    return fx.stop_times.select("trip_id", "stop_sequence", clock.gtfs_seconds_to_local(F.lit("2024-03-10").cast("date"), clock.gtfs_seconds(F.col("arrival_time"))).alias("local_ts"))


@query("B04_gtfs_time_on_reference_day", """ SELECT p.id, s.stop_sequence, CAST(CAST(p.ts AS DATE) AS TIMESTAMP) + to_seconds(s.arrival_sec) AS sched_ts FROM pos p JOIN fx_st s ON p.trip_id = s.trip_id""")
def _(fx):
    rows = fx.positions.join(fx.stop_times, "trip_id")
    return rows.select("id", "stop_sequence", clock.gtfs_time_on_reference_day(F.col("timestamp"), F.col("arrival_sec")).alias("sched_ts"))


@query("B05_parse_start_date", " SELECT snapshot_ts, line_no, CASE WHEN line_no % 2 = 0 THEN CAST(snapshot_ts AS DATE) END AS start_date FROM tu")
def _(fx):
    return fx.trip_updates.select("snapshot_ts", "line_no", clock.parse_service_date(F.col("trip_start_date")).alias("start_date"))


@query("B06_local_hour_date", " SELECT id, CAST(hour(ts - INTERVAL 5 HOUR) AS INT) AS local_hour, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_date FROM pos")
def _(fx):
    return fx.positions.select("id", clock.local_hour(F.col("timestamp")).alias("local_hour"), clock.local_date(F.col("timestamp")).alias("local_date"))


@query("B07_local_day_bounds", " SELECT service_date, CAST(service_date AS TIMESTAMP) + INTERVAL 5 HOUR AS lo, CAST(service_date AS TIMESTAMP) + INTERVAL 29 HOUR AS next, CAST(service_date AS TIMESTAMP) + INTERVAL 53 HOUR AS hi, count(*) AS n FROM se GROUP BY 1")
def _(fx):
    a, b, c = clock.local_day_bounds(F.col("service_date"))
    return fx.stop_events.groupBy("service_date").agg(F.count(F.lit(1)).alias("n")).select("service_date", a.alias("lo"), b.alias("next"), c.alias("hi"), "n")


_DAY = "CASE dayofweek(service_date) WHEN 6 THEN 'saturday' WHEN 0 THEN 'sunday' ELSE 'weekday' END"
_PERIOD = "CASE WHEN {h} >= 6 AND {h} < 10 THEN 'am_peak' WHEN {h} >= 10 AND {h} < 15 THEN 'midday' WHEN {h} >= 15 AND {h} < 19 THEN 'pm_peak' WHEN {h} >= 19 AND {h} < 22 THEN 'evening' ELSE 'late' END"
_EWT_PERIOD = "CASE WHEN {h} < 6 THEN 'Night (0-6)' WHEN {h} < 9 THEN 'AM Peak (6-9)' WHEN {h} < 15 THEN 'Midday (9-15)' WHEN {h} < 19 THEN 'PM Peak (15-19)' ELSE 'Evening (19-24)' END"


def period_sql(hour: str) -> str:
    return _PERIOD.format(h=hour)


def ewt_period_sql(hour: str) -> str:
    return _EWT_PERIOD.format(h=hour)


@query("B08_day_type", f" SELECT service_date, trip_id, source, {_DAY} AS day_type FROM runs")
def _(fx):
    return fx.runs.select("service_date", "trip_id", "source", clock.day_type(F.col("service_date")).alias("day_type"))


@query("B09_periods", f", h AS (SELECT *, sched_sec // 3600 % 24 AS h FROM se) SELECT service_date, trip_id, stop_sequence, source, {ewt_period_sql('h')} AS ewt_period, {period_sql('h')} AS period_key, h >= 22 OR h < 6 AS is_late FROM h")
def _(fx):
    h = clock.local_hour(F.col("scheduled_arrival_ts"))
    return fx.stop_events.select(*_SE_KEY, labels.ewt_period(h).alias("ewt_period"), labels.period_key(h).alias("period_key"), labels.hour_in_period(h, "late").alias("is_late"))


@query("B10_otp_bucket", " SELECT service_date, trip_id, stop_sequence, source, CASE WHEN dev < -120 THEN 'early' WHEN dev > 420 THEN 'late' WHEN dev IS NOT NULL THEN 'on_time' END AS bucket FROM se")
def _(fx):
    return fx.stop_events.select(*_SE_KEY, labels.otp_bucket(F.col("deviation_sec")).alias("bucket"))


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    x = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"2 * 6371000.0::DOUBLE * asin(sqrt(CASE WHEN {x} > 1 THEN 1 ELSE {x} END))"


def bearing_sql(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0::DOUBLE, 360.0::DOUBLE)"


@query("B11_haversine_m", f" SELECT p.id, s.stop_id, {hav_sql('p.lat', 'p.lon', 's.stop_lat', 's.stop_lon')} AS dist_m FROM pos p JOIN stops s ON s.stop_num = p.id % 10", "dist_m")
def _(fx):
    rows = fx.positions.withColumn("k", F.col("id") % 10).join(fx.stops, F.col("k") == F.col("stop_num"))
    return rows.select("id", "stop_id", geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("stop_lat"), F.col("stop_lon")).alias("dist_m"))


@query("B12_bearing", f", b AS (SELECT p.id, {bearing_sql('p.lat', 'p.lon', 's.stop_lat + 0.01', 's.stop_lon + 0.003 * (p.id % 5)')} AS bearing FROM pos p JOIN stops s ON s.stop_num = p.id % 10) SELECT id, bearing, least(abs(bearing - 350), 360 - abs(bearing - 350)) AS from_350, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor((bearing + 22.5) / 45) AS INT) % 8 + 1] AS cardinal FROM b", "bearing from_350")
def _(fx):
    rows = fx.positions.withColumn("k", F.col("id") % 10).join(fx.stops, F.col("k") == F.col("stop_num"))
    b = geo.bearing_deg(F.col("latitude"), F.col("longitude"), F.col("stop_lat") + 0.01, F.col("stop_lon") + 0.003 * (F.col("id") % 5))
    rows = rows.select("id", b.alias("bearing"))
    return rows.select("id", "bearing", geo.bearing_distance(F.col("bearing"), F.lit(350.0)).alias("from_350"), geo.cardinal8(F.col("bearing")).alias("cardinal"))


@query("B14_sanitize_float", " SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 IN (0, 1, 2) THEN NULL ELSE o_totalprice END AS x FROM orders", "x")
def _(fx):
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    dirty = F.when(k % 10 == 0, float("nan")).when(k % 10 == 1, float("inf")).when(k % 10 == 2, float("-inf")).otherwise(x)
    return fx.table("orders").select(k.alias("k"), labels.sanitize(dirty).alias("x"))


@query("B15_feed_expiry_status", f" SELECT trip_id, CASE WHEN day_off < 13 THEN CASE WHEN day_off < 6 THEN 'expired' ELSE 'expiring_soon' END ELSE 'expiring_soon' END AS status FROM fx_trips")
def _(fx):
    end = F.date_add(F.lit(DAY0).cast("date"), F.col("day_off"))
    return fx.trips_raw.select("trip_id", labels.feed_expiry_status(end, "2024-01-07").alias("status"))


_PTS = "concat_ws(' ', CAST(-77.05::DOUBLE + stop_sequence * 0.5::DOUBLE AS VARCHAR), CAST(38.5::DOUBLE + stop_sequence * 0.25::DOUBLE AS VARCHAR))"


@query("B18_wkt_linestring", " SELECT trip_id, CAST(count(*) AS INT) AS n_points, sum(stop_sequence * 0.5::DOUBLE) AS lon_sum, sum(38 + stop_sequence * 0.25::DOUBLE) AS lat_sum FROM fx_st GROUP BY 1", "lon_sum lat_sum")
def _(fx):  # rendered and parsed again
    pts = F.array_sort(F.collect_list(F.struct("stop_sequence", (F.col("stop_sequence") * 0.5).alias("lon"), (38 + F.col("stop_sequence") * 0.25).alias("lat"))))
    text = fx.stop_times.groupBy("trip_id").agg(geo.wkt_linestring(pts).alias("wkt"))
    back = text.select("trip_id", geo.parse_wkt_linestring(F.col("wkt")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + x[f])
    return back.select("trip_id", F.size("p").alias("n_points"), total("lon").alias("lon_sum"), total("lat").alias("lat_sum"))


@query("B20_date_spine", f" SELECT d.service_date, count(r.trip_id) AS n_runs, d.service_date > DATE '{AS_OF}' - 7 AS in_last_7, d.service_date BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' - 1 AS in_last_7_complete FROM dates d LEFT JOIN runs r ON r.service_date = d.service_date GROUP BY 1")
def _(fx):
    a = clock.last_days(fx.spark, AS_OF, 7).withColumn("a", F.lit(True))
    b = clock.last_days(fx.spark, AS_OF, 7, complete=True).withColumn("b", F.lit(True))
    n = fx.runs.groupBy("service_date").agg(F.count("trip_id").alias("n_runs"))
    out = fx.dates.join(n, "service_date", "left").join(a, "service_date", "left").join(b, "service_date", "left")
    return out.select("service_date", F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), F.coalesce("a", F.lit(False)).alias("in_last_7"), F.coalesce("b", F.lit(False)).alias("in_last_7_complete"))


# --- static schedule


def services(fx: Fixture):
    return schedule.service_ids_for_date(fx.calendar, fx.calendar_dates, fx.dates)


def day_services(fx: Fixture):
    d = F.weekday("service_date")
    return fx.dates.select("service_date", F.when(d == 5, "SA").when(d == 6, "SU").otherwise("WK").alias("service_id"))


def scheduled(fx: Fixture):
    return schedule.scheduled_headways(fx.trips, fx.timetable, "service_id")


def route_stops(fx: Fixture):
    return schedule.route_stops(fx.trips, fx.timetable, fx.stops)


@query("C01_service_ids_for_date", " SELECT s.service_date, s.service_id, count(*) AS n_trips FROM svc s JOIN fx_trips t ON t.service_id = s.service_id GROUP BY 1, 2")
def _(fx):
    return services(fx).join(fx.trips, "service_id").groupBy("service_date", "service_id").agg(F.count(F.lit(1)).alias("n_trips"))


@query("C02_removed_service_dates", " SELECT p.id FROM pos p JOIN fx_trips t ON t.trip_id = p.trip_id WHERE NOT (t.service_id = 'WK' AND CAST(p.ts AS DATE) = DATE '2024-01-04')")
def _(fx):
    return schedule.drop_exception_pings(fx.positions, fx.trips, fx.calendar_dates).select("id")


@query("C02_any_exception", " SELECT p.id FROM pos p JOIN fx_trips t ON t.trip_id = p.trip_id WHERE NOT (t.service_id IN ('WK', 'SU') AND CAST(p.ts AS DATE) = DATE '2024-01-04')")
def _(fx):
    return schedule.drop_exception_pings(fx.positions, fx.trips, fx.calendar_dates, exception_types=None).select("id")


@query("C03_feed_validity_window", """, v AS (SELECT service_id, min(day_off) AS a, max(day_off) AS b FROM fx_trips WHERE trip_num % 5 <> 0 GROUP BY 1), x AS (SELECT trip_num % 40 AS d FROM fx_trips WHERE trip_num % 5 = 0)
 SELECT DATE '2024-01-01' + least((SELECT min(a) FROM v), (SELECT min(CAST(d AS INT)) FROM x)) AS valid_from, DATE '2024-01-01' + greatest((SELECT max(b) FROM v), (SELECT max(CAST(d AS INT)) FROM x)) AS valid_to, count(*) AS n_trips FROM fx_trips""")
def _(fx):  # spans of services, and single dates beyond them; some dates are malformed
    day = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")), "yyyyMMdd")
    spans = fx.trips_raw.filter("trip_num % 5 <> 0").groupBy("service_id").agg(F.min("day_off").alias("a"), F.max("day_off").alias("b")).select("service_id", day(F.col("a")).alias("start_date"), day(F.col("b")).alias("end_date"))
    dates = fx.trips_raw.filter("trip_num % 5 = 0").select(F.explode(F.array(day(F.col("trip_num") % 40), F.lit("2024013"), F.lit(None).cast("string"))).alias("date"))
    return schedule.feed_validity_window(spans, dates).crossJoin(fx.trips.agg(F.count(F.lit(1)).alias("n_trips")))


@query("C04_modal_service_ids", " SELECT d.day_type, d.service_id, count(*) AS n_trips FROM (VALUES ('weekday', 'WK'), ('saturday', 'SA'), ('sunday', 'SU')) d(day_type, service_id) JOIN fx_trips t ON t.service_id = d.service_id GROUP BY 1, 2")
def _(fx):
    return schedule.modal_service_ids(services(fx)).join(fx.trips, "service_id").groupBy("day_type", "service_id").agg(F.count(F.lit(1)).alias("n_trips"))


@query("C05_scheduled_trips_on_date", " SELECT s.service_date, t.route_id, t.trip_id FROM svc s JOIN fx_trips t ON t.service_id = s.service_id")
def _(fx):
    return schedule.scheduled_trips_on_date(fx.trips, services(fx)).select("service_date", "route_id", "trip_id")


@query("C06_scheduled_headways", " SELECT service_id, route_id, direction_id, stop_id, hour, h_sec FROM sched_hw")
def _(fx):
    return scheduled(fx)


@query("C07_bus_route_filter", " SELECT r.route_id, count(*) AS n_trips FROM routes r JOIN fx_trips t ON t.route_id = r.route_id WHERE route_type = '3' GROUP BY 1")
def _(fx):
    return schedule.bus_route_filter(fx.routes).join(fx.trips, "route_id").groupBy("route_id").agg(F.count(F.lit(1)).alias("n_trips"))


def one_way(fx: Fixture):
    """Trips and stop times in which a route's directions use different stops."""
    return fx.trips, fx.timetable.withColumn("stop_id", F.concat("stop_id", F.lit("_"), F.col("direction_id").cast("string")))


_OW = ", ow AS (SELECT trip_id, route_id, direction_id, service_id, concat(stop_id, '_', CAST(direction_id AS VARCHAR)) AS stop_id, stop_sequence, arrival_sec AS sec FROM fx_st)"
_PROFILE = """, dts AS (SELECT * FROM (VALUES ('weekday', 'WK'), ('saturday', 'SA'), ('sunday', 'SU')) v(day_type, service_id)), od AS (SELECT o.*, d.day_type FROM ow o JOIN dts d ON d.service_id = o.service_id),
 trunk AS (SELECT route_id, day_type, stop_id FROM (SELECT route_id, day_type, stop_id, row_number() OVER (PARTITION BY route_id, day_type ORDER BY count(*) DESC, stop_id DESC) AS nth FROM od GROUP BY 1, 2, 3) WHERE nth = 1),
 profile AS (SELECT o.route_id, o.day_type, o.stop_id, CAST(sec // 3600 % 24 AS INT) AS hour, count(*) AS n_arrivals, CASE WHEN count(*) > 1 THEN (max(sec) - min(sec)) / (count(*) - 1)::DOUBLE / 60 END AS mean_headway_min
   FROM od o JOIN trunk t ON o.route_id = t.route_id AND o.day_type = t.day_type AND o.stop_id = t.stop_id GROUP BY 1, 2, 3, 4)"""
_CLASS = """, p9 AS (SELECT route_id, list_sort(list(mean_headway_min)) AS v FROM profile WHERE day_type = 'weekday' AND mean_headway_min IS NOT NULL GROUP BY 1), p90s AS (SELECT route_id, v[CAST(round_even((len(v) - 1) * 0.9::DOUBLE, 0) AS INT) + 1] AS p90 FROM p9),
 cls AS (SELECT x.route_id, p90 AS p90_headway_min, CASE WHEN x.route_id LIKE '%X' THEN 'limited_stop' WHEN p90 <= 12 THEN 'high' WHEN p90 <= 20 THEN 'medium' WHEN p90 <= 30 THEN 'low' WHEN p90 IS NOT NULL THEN 'limited' END AS frequency_class FROM routes x LEFT JOIN p90s r ON x.route_id = r.route_id)"""


def service_profile(fx: Fixture):
    return schedule.route_service_profile(*one_way(fx), schedule.modal_service_ids(services(fx)))


@query("C08_route_service_profile", _OW + _PROFILE + " SELECT *, coalesce(mean_headway_min <= 15, false) AS is_frequent FROM profile", "mean_headway_min")
def _(fx):
    return service_profile(fx)


@query("C09_frequency_class", _OW + _PROFILE + _CLASS + " SELECT * FROM cls", "p90_headway_min")
def _(fx):
    return schedule.frequency_class(service_profile(fx), fx.routes)


@query("C10_service_level_stats", """, d AS (SELECT * FROM sched_hw WHERE hour >= 7 AND hour < 19),
 best AS (SELECT route_id, direction_id, stop_id FROM (SELECT route_id, direction_id, stop_id, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, stop_id DESC) AS nth FROM d GROUP BY 1, 2, 3) WHERE nth = 1)
 SELECT count(*) AS n_gaps, quantile_cont(h_sec, 0.5) AS median_headway_sec, avg(CASE WHEN h_sec <= 900 THEN 1 ELSE 0 END) AS frequent_share FROM d JOIN best b ON d.route_id = b.route_id AND d.direction_id = b.direction_id AND d.stop_id = b.stop_id""", "median_headway_sec frequent_share")
def _(fx):
    return schedule.service_level_stats(scheduled(fx))


@query("C11_frequent_route_audit", f""", c AS (SELECT route_id, direction_id, stop_id, hour, avg(h_sec) AS m FROM sched_hw WHERE hour >= 7 AND hour < 20 GROUP BY 1, 2, 3, 4),
 p AS (SELECT c.route_id, count(*) AS n_cells, avg(CASE WHEN m <= coalesce(gate_sec, 900) THEN 1 ELSE 0 END) AS dense_share FROM c LEFT JOIN {TIER_SQL} ON t.route_id = c.route_id GROUP BY 1)
 SELECT coalesce(p.route_id, t.route_id) AS route_id, gate_sec, n_cells, dense_share, CASE WHEN gate_sec IS NOT NULL AND n_cells IS NULL THEN 'designated_missing' WHEN gate_sec IS NOT NULL AND dense_share < 0.5 THEN 'designated_sparse'
   WHEN gate_sec IS NULL AND dense_share >= 0.5 THEN 'dense_undesignated' ELSE 'consistent' END AS verdict FROM p FULL JOIN {TIER_SQL} ON t.route_id = p.route_id""", "dense_share")
def _(fx):
    return schedule.frequent_route_audit(scheduled(fx), config(fx)[0].select("route_id", "gate_sec"))


@query("C12_frequent_route_audit_detail", """ SELECT route_id, direction_id, count(*) AS n_gaps, avg(h_sec) AS mean_sec, quantile_cont(h_sec, 0.5) AS median_sec, min(h_sec) AS min_sec, avg(CASE WHEN h_sec <= 900 THEN 1 ELSE 0 END) AS share_15,
 avg(CASE WHEN h_sec <= 1200 THEN 1 ELSE 0 END) AS share_20, avg(CASE WHEN h_sec <= 1800 THEN 1 ELSE 0 END) AS share_30 FROM sched_hw GROUP BY GROUPING SETS ((route_id), (route_id, direction_id))""", "mean_sec median_sec share_15 share_20 share_30")
def _(fx):
    return schedule.frequent_route_audit_detail(scheduled(fx))


REF_SQL = _OW + """, per AS (SELECT route_id, direction_id, stop_id, count(DISTINCT trip_id) AS n, avg(stop_sequence) AS avg_seq FROM ow GROUP BY 1, 2, 3),
 good AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY route_id, direction_id) AS most FROM per) WHERE n >= most * 0.8::DOUBLE),
 ref AS (SELECT route_id, direction_id, stop_id, n, avg_seq FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY avg_seq, stop_id) AS nth, count(*) OVER (PARTITION BY route_id, direction_id) AS k FROM good) WHERE nth = k // 2 + 1)"""


@query("C13_reference_stop", REF_SQL + " SELECT * FROM ref", "avg_seq")
def _(fx):
    return schedule.reference_stop(*one_way(fx))


@query("C14_route_service_hours", " SELECT r.route_id, CAST(coalesce(min(arrival_sec // 3600) % 24, 5) AS INT) AS first_hour, CAST(coalesce(max(arrival_sec // 3600), 23) AS INT) AS last_hour FROM routes r LEFT JOIN fx_st s ON s.route_id = r.route_id GROUP BY 1")
def _(fx):
    return schedule.route_service_hours(fx.trips, fx.timetable, fx.routes)


@query("C15_route_stops", " SELECT DISTINCT s.route_id, s.stop_id, t.stop_name FROM fx_st s JOIN stops t ON t.stop_id = s.stop_id")
def _(fx):
    return route_stops(fx).select("route_id", "stop_id", "stop_name")


CANON = """, canon AS (SELECT s.route_id, s.direction_id, s.trip_id, s.stop_sequence, s.stop_id FROM fx_st s JOIN
  (SELECT trip_id FROM (SELECT trip_id, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, trip_id DESC) AS nth FROM fx_st GROUP BY route_id, direction_id, trip_id) WHERE nth = 1) l ON l.trip_id = s.trip_id)"""


@query("C16_canonical_stop_sequence", CANON + " SELECT * FROM canon")
def _(fx):
    return schedule.canonical_stop_sequence(fx.trips, fx.stop_times)


ORIGIN = """, origin AS (SELECT route_id, direction_id, stop_id, n, stop_sequence FROM (SELECT route_id, direction_id, stop_id, count(*) AS n, 1 AS stop_sequence, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, stop_id) AS nth
  FROM fx_st WHERE stop_sequence = 1 GROUP BY 1, 2, 3) WHERE nth = 1)"""


@query("C17_schedule_origins", ORIGIN + " SELECT * FROM origin")
def _(fx):
    return schedule.schedule_origins(fx.trips, fx.stop_times)


@query("C18_representative_shape", """ SELECT route_id, NULL AS direction_id, shape_id, n_trips FROM (SELECT route_id, shape_id, count(*) AS n_trips, row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, shape_id DESC) AS nth FROM fx_trips GROUP BY 1, 2) WHERE nth = 1
 UNION ALL SELECT route_id, direction_id, shape_id, count(*) FROM fx_trips GROUP BY 1, 2, 3""")
def _(fx):
    one = schedule.representative_shape(fx.trips).withColumn("direction_id", F.lit(None).cast("int"))
    return one.unionByName(schedule.representative_shape(fx.trips, by_direction=True)).select("route_id", "direction_id", "shape_id", "n_trips")


@query("C19_scheduled_endpoints", " SELECT trip_id, min(arrival_sec) AS start_sec, max(arrival_sec) AS end_sec FROM fx_st GROUP BY 1")
def _(fx):
    return schedule.scheduled_endpoints(fx.stop_times)


WINDOW_TRIPS = ", tw AS (SELECT route_id, CAST(sum(CASE service_id WHEN 'WK' THEN 10 ELSE 2 END) AS BIGINT) AS trips_in_window FROM fx_trips GROUP BY 1)"


@query("C20_scheduled_trips_in_window", WINDOW_TRIPS + " SELECT * FROM tw")
def _(fx):
    return schedule.scheduled_trips_in_window(fx.trips, fx.calendar, fx.dates)


@query("C21_rt_static_match_rate", " SELECT count(*) AS n_rt_trips, count(t.trip_id) AS n_matched, avg(CASE WHEN t.trip_id IS NULL THEN 0 ELSE 1 END) AS match_rate FROM (SELECT DISTINCT trip_id FROM tu) u LEFT JOIN fx_trips t ON t.trip_id = u.trip_id", "match_rate")
def _(fx):
    return schedule.rt_static_match_rate(fx.trip_updates, fx.trips)


@query("C22_simplify_shapes", """, shp AS (SELECT concat('P', CAST(r AS VARCHAR), '_', CAST(d AS VARCHAR)) AS shape_id, CAST(i + 1 AS INT) AS seq, 38.90::DOUBLE + (r % 4) * 0.00005::DOUBLE + ((i + 1) * (i + 1) * 7 % 13) * 0.00007::DOUBLE AS y,
   -77.05::DOUBLE + CASE d WHEN 0 THEN i ELSE 29 - i END * 0.0004::DOUBLE AS x FROM (SELECT DISTINCT route_num AS r, direction_id AS d FROM fx_trips), range(30) t(i)),
 ends AS (WITH RECURSIVE sp(shape_id, a, b) AS (SELECT DISTINCT shape_id, 1, 30 FROM shp UNION ALL
   SELECT shape_id, unnest([a, k]), unnest([k, b]) FROM (SELECT s.shape_id, s.a, s.b, max_by(p.seq, {'o': abs((pb.x - pa.x) * (p.y - pa.y) - (pb.y - pa.y) * (p.x - pa.x)) / sqrt((pb.x - pa.x) ** 2 + (pb.y - pa.y) ** 2), 'i': -p.seq}) AS k,
     max(abs((pb.x - pa.x) * (p.y - pa.y) - (pb.y - pa.y) * (p.x - pa.x)) / sqrt((pb.x - pa.x) ** 2 + (pb.y - pa.y) ** 2)) AS off
     FROM sp s JOIN shp pa ON pa.shape_id = s.shape_id AND pa.seq = s.a JOIN shp pb ON pb.shape_id = s.shape_id AND pb.seq = s.b JOIN shp p ON p.shape_id = s.shape_id AND p.seq > s.a AND p.seq < s.b GROUP BY 1, 2, 3) WHERE off > 0.0001::DOUBLE)
   SELECT DISTINCT shape_id, unnest([a, b]) AS seq FROM sp)
 SELECT shape_id, y AS shape_pt_lat, x AS shape_pt_lon, seq AS shape_pt_sequence FROM shp SEMI JOIN ends USING (shape_id, seq)""", "shape_pt_lat shape_pt_lon")
def _(fx):  # winding lines
    n = F.col("shape_pt_sequence")
    return schedule.simplify_shapes(fx.shapes.withColumn("shape_pt_lat", F.col("shape_pt_lat") + (n * n * 7 % 13) * 0.00007))


@query("C23_route_shapes", " SELECT route_id, shape_id, 30 AS n_points, count(*) AS n_trips FROM fx_trips GROUP BY 1, 2")
def _(fx):
    n = fx.trips.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_trips"))
    return schedule.route_shapes(fx.trips, fx.shapes).join(n, "shape_id").select("route_id", "shape_id", F.size("points").alias("n_points"), "n_trips")

"""Queries of derivation, runs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetline.functions import labels
from fleetline.operators import derive, headways, metrics, runs, schedule
from fleetline.plans.fixtures import DAY0, Fixture
from fleetline.plans.registry import query
from fleetline.plans.schedule_queries import CANON, REF_SQL, TIER_SQL, config, day_services, ewt_period_sql, hav_sql, one_way, route_stops, scheduled, services

UTC = f"TIMESTAMP '{DAY0} 05:00:00'"
E_KEY = "route_id, service_date"


def dated_positions(fx: Fixture):
    """Pings labelled with the service date on which the fixture runs their trip's day."""
    return fx.positions.withColumn("trip_start_date", F.date_format("timestamp", "yyyyMMdd"))


def near(fx: Fixture):
    return derive.nearest_stop_within(fx.positions, route_stops(fx))


RS = ", rs AS (SELECT DISTINCT s.route_id, s.stop_id, t.stop_lat, t.stop_lon FROM fx_st s JOIN stops t ON t.stop_id = s.stop_id)"
NEAR = RS + f""", near AS (SELECT * FROM (SELECT p.*, r.stop_id, {hav_sql('p.lat', 'p.lon', 'r.stop_lat', 'r.stop_lon')} AS dist_m FROM pos p JOIN rs r ON r.route_id = p.route_id) WHERE dist_m <= 50
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist_m, stop_id) = 1)"""


@query("D01_positions_for_service_date", " SELECT id, CAST(ts AS DATE) AS service_date FROM pos WHERE ts >= CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR AND CAST(ts AS DATE) IN (SELECT service_date FROM dates)")
def _(fx):
    return derive.positions_for_service_date(dated_positions(fx), fx.dates).select("id", "service_date")


@query("D02_nearest_stop_within", NEAR + " SELECT id, stop_id, dist_m FROM near", "dist_m")
def _(fx):
    return near(fx).select("id", "stop_id", "dist_m")


# local seconds of a ping since DAY0, its service date's offset, and both anchors
_SEC = f"epoch(p.ts - {UTC})"
RESOLVED = NEAR + f""", cand AS (
  SELECT p.id, p.trip_id, p.route_id, p.direction_id, p.vehicle_id, p.ts, p.stop_id, p.dist_m, s.stop_sequence, {_SEC} AS sec, CAST(p.ts AS DATE) - DATE '{DAY0}' AS off, s.arrival_sec AS a FROM near p JOIN fx_st s ON s.trip_id = p.trip_id AND s.stop_id = p.stop_id),
 anch AS (SELECT *, abs((off - 1) * 86400 + a - sec) < abs(off * 86400 + a - sec) AS back FROM cand),
 res AS (SELECT *, off - CASE WHEN back THEN 1 ELSE 0 END AS off2, (off - CASE WHEN back THEN 1 ELSE 0 END) * 86400 + a AS sched_sec FROM anch
   QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs((off - CASE WHEN back THEN 1 ELSE 0 END) * 86400 + a - sec), stop_sequence) = 1)"""


def resolved(fx: Fixture):
    pings = near(fx).withColumn("service_date", F.to_date("timestamp"))
    return derive.resolve_stop_time(pings.select("id", "trip_id", "stop_id", "service_date", "timestamp"), fx.stop_times)


@query("D03_resolve_stop_time", RESOLVED + f" SELECT id, stop_sequence, DATE '{DAY0}' + CAST(off2 AS INT) AS anchor_date, {UTC} + to_seconds(sched_sec) AS scheduled_arrival_ts FROM res")
def _(fx):
    return resolved(fx).select("id", "stop_sequence", "anchor_date", "scheduled_arrival_ts")


@query("D04_resolve_service_anchor", f""" SELECT t.snapshot_ts, t.line_no, s.stop_sequence, t.service_date - CASE WHEN back THEN 1 ELSE 0 END AS anchor_date FROM (
   SELECT t.*, s.stop_sequence AS q, abs(epoch({UTC} + to_seconds((t.service_date - DATE '{DAY0}' - 1) * 86400 + s.arrival_sec)) - epoch(t.snapshot_ts)) AS dp,
     abs(epoch({UTC} + to_seconds((t.service_date - DATE '{DAY0}') * 86400 + s.arrival_sec)) - epoch(t.snapshot_ts)) AS ds,
     CAST(dp AS BIGINT) < CAST(ds AS BIGINT) AND CAST(dp AS BIGINT) <= 10800 AS back FROM tu t JOIN fx_st s ON s.trip_id = t.trip_id AND s.stop_sequence = t.stop_sequence) t JOIN fx_st s ON s.trip_id = t.trip_id AND s.stop_sequence = t.q""")
def _(fx):
    from fleetline.streaming.updates import with_service_date

    rows = with_service_date(fx.trip_updates).join(fx.stop_times.select("trip_id", "stop_sequence", "arrival_sec"), ["trip_id", "stop_sequence"])
    date, _ = derive.resolve_service_anchor(F.date_trunc("second", "snapshot_ts").cast("timestamp_ntz"), F.col("service_date"), F.col("arrival_sec"), proxy_guard=True)
    return rows.select("snapshot_ts", "line_no", "stop_sequence", date.alias("anchor_date"))


PROX = RESOLVED + f""", prox AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), trip_id, stop_sequence ORDER BY ts, id) = 1),
 prox_ev AS (SELECT DATE '{DAY0}' + CAST(off2 AS INT) AS service_date, trip_id, route_id, direction_id, vehicle_id, stop_id, stop_sequence, sched_sec, ts, trunc(sec - sched_sec) AS deviation_sec, dist_m AS match_distance_m FROM prox)"""


def proximity_events(fx: Fixture):
    positions = fx.positions.withColumn("service_date", F.to_date("timestamp"))
    return derive.derive_stop_events_proximity(positions, fx.trips, fx.stop_times, route_stops(fx))


@query("D05_derive_stop_events_proximity", PROX + " SELECT service_date, trip_id, route_id, direction_id, vehicle_id, stop_id, stop_sequence, CAST(deviation_sec AS INT) AS deviation_sec, match_distance_m FROM prox_ev", "match_distance_m")
def _(fx):
    return proximity_events(fx).select("service_date", "trip_id", "route_id", "direction_id", "vehicle_id", "stop_id", "stop_sequence", "deviation_sec", "match_distance_m")


FOLD = """, fold AS (SELECT trip_id, stop_sequence, service_date, max_by(stop_id, k) AS stop_id, max(snapshot_ts) AS final_snapshot_ts, max_by(rel, k) AS final_rel,
   max_by(vehicle_id, k) FILTER (WHERE vehicle_id IS NOT NULL) AS vehicle_id, max_by(pred, k) FILTER (WHERE pred IS NOT NULL) AS pred, max(snapshot_ts) FILTER (WHERE pred IS NOT NULL) AS pred_ts,
   max(snapshot_ts) FILTER (WHERE vehicle_id IS NOT NULL) AS vehicle_ts FROM (SELECT *, {'a': snapshot_ts, 'b': line_no} AS k FROM tu) GROUP BY 1, 2, 3)"""
TU_EVENTS = FOLD + f""", tue0 AS (SELECT f.*, s.arrival_sec AS a, f.service_date - DATE '{DAY0}' AS off, epoch(CASE WHEN final_rel = 'SKIPPED' THEN final_snapshot_ts ELSE pred END - {UTC}) AS sec, t.route_id, t.direction_id
   FROM fold f JOIN fx_st s ON s.trip_id = f.trip_id AND s.stop_sequence = f.stop_sequence JOIN fx_trips t ON t.trip_id = f.trip_id
   WHERE (final_rel = 'SKIPPED' OR pred IS NOT NULL) AND EXISTS (SELECT 1 FROM pos p WHERE p.trip_id = f.trip_id AND CAST(p.ts AS DATE) = f.service_date)),
 tue AS (SELECT *, abs((off - 1) * 86400 + a - sec) < abs(off * 86400 + a - sec) AND (final_rel <> 'SKIPPED' OR abs((off - 1) * 86400 + a - sec) <= 10800) AS back FROM tue0)"""


def tu_events(fx: Fixture):
    from fleetline.streaming.updates import trip_update_state_fold

    positions = fx.positions.withColumn("service_date", F.to_date("timestamp"))
    state = trip_update_state_fold(fx.trip_updates)
    return derive.derive_stop_events_trip_update(state, positions, fx.trips, fx.stop_times)


@query("D06_derive_stop_events_trip_update", TU_EVENTS + """ SELECT service_date - CASE WHEN back THEN 1 ELSE 0 END AS service_date, trip_id, route_id, stop_sequence, stop_id, vehicle_id, final_rel AS schedule_relationship,
   CAST(CASE WHEN final_rel <> 'SKIPPED' THEN trunc(sec - ((off - CASE WHEN back THEN 1 ELSE 0 END) * 86400 + a)) END AS INT) AS deviation_sec FROM tue""")
def _(fx):
    return tu_events(fx).select("service_date", "trip_id", "route_id", "stop_sequence", "stop_id", "vehicle_id", "schedule_relationship", "deviation_sec")


@query("D07_supersede_shifted_rows", """, derived AS (SELECT service_date - 1 AS service_date, trip_id, stop_sequence, source FROM se WHERE stop_sequence = 2 AND source = 'proximity' AND trip_num % 4 = 0)
 SELECT service_date, trip_id, stop_sequence, source, 'old' AS tag FROM se WHERE NOT (stop_sequence = 2 AND source = 'proximity' AND trip_num % 4 = 0) UNION ALL SELECT *, 'new' FROM derived""")
def _(fx):
    old = fx.stop_events.select("service_date", "trip_id", "stop_sequence", "source", F.lit("old").alias("tag"))
    num = F.substring("trip_id", 2, 20).cast("long")
    new = old.filter((F.col("stop_sequence") == 2) & (F.col("source") == "proximity") & (num % 4 == 0)).withColumns({"service_date": F.date_sub("service_date", 1), "tag": F.lit("new")})
    return derive.supersede_shifted_rows(old, new)


@query("D09_aggregate_runs", f""" SELECT service_date, trip_id, route_id, direction_id, source, vehicle_id, stops_observed, CAST(stops_skipped AS BIGINT) AS stops_skipped, first_obs_seq, last_obs_seq, {UTC} + to_seconds(first_obs) AS first_obs_ts,
  {UTC} + to_seconds(last_obs) AS last_obs_ts, {UTC} + to_seconds(sched_first) AS sched_first_arrival_ts, {UTC} + to_seconds(sched_last) AS sched_last_arrival_ts, CAST(max_gap_sec AS BIGINT) AS max_gap_sec, dev_p50_sec, dev_p95_sec, stops_scheduled,
  stops_observable, sched_first_seq, sched_last_seq, origin_dev_sec, destination_dev_sec FROM runs""")
def _(fx):
    return fx.runs


@query("D10_compare_sources", """, k AS (SELECT route_id, service_date, trip_id, stop_sequence, max(CASE WHEN source = 'trip_update' THEN obs_sec END) AS tu, max(CASE WHEN source = 'proximity' THEN obs_sec END) AS prox FROM se GROUP BY 1, 2, 3, 4),
 d AS (SELECT *, tu - prox AS d FROM k WHERE tu IS NOT NULL OR prox IS NOT NULL)
 SELECT route_id, count(*) AS n_keys, count(d) AS n_both, count(*) - count(prox) AS n_tu_only, count(*) - count(tu) AS n_prox_only, count(d) / count(prox)::DOUBLE AS tu_coverage, count(d) / count(tu)::DOUBLE AS prox_coverage,
  quantile_cont(abs(d), 0.5) AS abs_p50, quantile_cont(abs(d), 0.95) AS abs_p95, quantile_cont(abs(d), 0.99) AS abs_p99, quantile_cont(d, 0.5) AS median_signed, avg(d) AS mean_signed FROM d GROUP BY ROLLUP (route_id)""", "tu_coverage prox_coverage abs_p50 abs_p95 abs_p99 median_signed mean_signed")
def _(fx):
    return runs.compare_sources(fx.stop_events)


def matches(fx: Fixture):
    return fx.kept("matches", lambda: derive.find_matching_trip(fx.positions, fx.trips, fx.stop_times, fx.stops))


# own trip first, then the walk over each candidate trip's visits, as a fold over an ordered list
MATCH = f""", visit AS (SELECT s.trip_id AS m_trip, s.route_id AS m_route, s.direction_id AS m_dir, s.stop_id, s.stop_sequence, s.arrival_sec, t.stop_lat, t.stop_lon FROM fx_st s JOIN stops t ON t.stop_id = s.stop_id),
 ping AS (SELECT *, epoch(ts - CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS ps FROM pos),
 hit AS (SELECT *, ps - arrival_sec AS late_sec, (ps - arrival_sec) / 60 AS mi FROM (SELECT p.id, p.vehicle_id, p.trip_id AS rt, p.direction_id AS dir, p.route_id, p.ts, p.ps, v.*, round({hav_sql('p.lat', 'p.lon', 'v.stop_lat', 'v.stop_lon')}, 6) AS dist_m
   FROM ping p JOIN visit v ON p.route_id = v.m_route AND p.direction_id = v.m_dir WHERE p.ps - v.arrival_sec BETWEEN -600 AND 900) WHERE dist_m <= 500),
 own AS (SELECT id, vehicle_id, route_id, ts, m_trip AS trip_id, stop_id, stop_sequence, late_sec, dist_m, greatest(0, least(1, (greatest(0, 1 - abs(mi) / 15) + (1 - dist_m / 500)) / 2)) AS confidence FROM hit WHERE m_trip = rt
   QUALIFY row_number() OVER (PARTITION BY id ORDER BY stop_sequence) = 1),
 sc AS (SELECT *, (CASE WHEN abs(mi) <= 2 THEN abs(mi) / 20 WHEN mi < 0 THEN 0.3::DOUBLE + abs(mi) / 15 * 0.7::DOUBLE ELSE mi / 15 * 0.5::DOUBLE END + dist_m / 500) / 2 AS biased, (abs(mi) / 15 + dist_m / 500) / 2 AS plain
   FROM hit WHERE late_sec >= -300 AND id NOT IN (SELECT id FROM own)),
 wk AS (SELECT id, vehicle_id, route_id, ts, m_trip, list_reduce(list({{'q': stop_sequence, 's': stop_id, 'l': late_sec, 'd': dist_m, 'b': biased, 'p': plain}} ORDER BY stop_sequence), lambda h, v: CASE WHEN v.b < h.p THEN v ELSE h END) AS v FROM sc GROUP BY ALL),
 cf AS (SELECT id, vehicle_id, route_id, ts, m_trip AS trip_id, v.s AS stop_id, v.q AS stop_sequence, v.l AS late_sec, v.d AS dist_m,
   greatest(0, least(1, ((1 - abs(v.l / 60) / 15) + (1 - v.d / 500)) / 2 + CASE WHEN v.l / 60 BETWEEN -2 AND 10 THEN 0.1::DOUBLE WHEN v.l / 60 < -2 THEN -0.1::DOUBLE ELSE 0 END)) AS confidence FROM wk),
 matched AS (SELECT * FROM own UNION ALL (SELECT * FROM cf WHERE confidence > 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, trip_id) = 1))"""


@query("D11_find_matching_trip", MATCH + " SELECT id, trip_id, stop_id, late_sec, dist_m, confidence FROM matched", "late_sec dist_m confidence")
def _(fx):
    return matches(fx).select("id", "trip_id", "stop_id", "late_sec", "dist_m", "confidence")


@query("D12_match_vehicles_to_trips", MATCH + " SELECT vehicle_id, trip_id, stop_id, confidence, ts AS timestamp FROM matched WHERE confidence >= 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, id DESC) = 1", "confidence")
def _(fx):
    return derive.match_vehicles_to_trips(matches(fx))


SHAPES = """, shp AS (SELECT concat('P', CAST(n % 12 AS VARCHAR), '_', CAST(n // 12 % 2 AS VARCHAR)) AS shape_id, 38.90::DOUBLE + (n % 12 % 4) * 0.00005::DOUBLE AS plat, -77.05::DOUBLE + CASE n // 12 % 2 WHEN 0 THEN n // 24 ELSE 29 - n // 24 END * 0.0004::DOUBLE AS plon FROM range(720) t(n))"""


def headed_positions(fx: Fixture):
    return fx.positions.withColumn("bearing", F.when(F.col("id") % 4 != 0, (F.col("id") * 37 % 360).cast("double")))


@query("D13_validate_trip_match", SHAPES + f""", ends AS (SELECT s.trip_id, min_by(arrival_sec, stop_sequence) % 86400 AS a, max_by(arrival_sec, stop_sequence) % 86400 AS b, min_by({{'lat': stop_lat, 'lon': stop_lon}}, stop_sequence) AS f,
   max_by({{'lat': stop_lat, 'lon': stop_lon}}, stop_sequence) AS t, count(*) AS n FROM fx_st s LEFT JOIN stops t ON t.stop_id = s.stop_id GROUP BY 1),
 near_shp AS (SELECT * FROM (SELECT p.id, min({hav_sql('p.lat', 'p.lon', 'plat', 'plon')}) AS shape_m FROM pos p JOIN fx_trips t ON t.trip_id = p.trip_id JOIN shp ON shp.shape_id = t.shape_id GROUP BY 1) WHERE shape_m <= 500),
 v0 AS (SELECT p.id, p.trip_id, CAST(floor(epoch(ts - CAST(CAST(ts AS DATE) AS TIMESTAMP))) AS BIGINT) AS now, a, b, n, shape_m, CASE WHEN p.id % 4 <> 0 THEN (p.id * 37 % 360)::DOUBLE END AS bearing, fmod(degrees(atan2(t.lon - f.lon, t.lat - f.lat)) + 360, 360) AS line
   FROM pos p LEFT JOIN ends e ON e.trip_id = p.trip_id LEFT JOIN near_shp s ON s.id = p.id),
 v1 AS (SELECT id, trip_id, shape_m, true AS route_ok, CASE WHEN bearing IS NOT NULL AND n >= 2 THEN least(fmod(abs(bearing - line), 360), 360 - fmod(abs(bearing - line), 360)) <= 90 END AS direction_ok,
   coalesce(CASE WHEN a <= b THEN now BETWEEN a - 1800 AND b + 1800 ELSE now >= a - 1800 OR now <= b + 1800 END, false) AS time_ok, shape_m IS NOT NULL AS shape_ok FROM v0)
 SELECT id, trip_id, route_ok, direction_ok, time_ok, shape_ok, shape_m, coalesce(direction_ok, true) AND time_ok AND shape_ok AS is_valid FROM v1""", "shape_m")
def _(fx):
    return derive.validate_trip_match(headed_positions(fx), fx.trips, fx.stop_times, fx.stops, fx.shapes).drop("warnings")


ENRICHED = NEAR + """, first_at AS (SELECT trip_id, stop_id, min_by(arrival_sec, stop_sequence) AS a FROM fx_st GROUP BY 1, 2),
 enr AS (SELECT n.*, CAST(ts AS DATE) AS service_date, epoch(ts - (CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_seconds(a))) AS raw FROM near n JOIN first_at f ON f.trip_id = n.trip_id AND f.stop_id = n.stop_id),
 enriched AS (SELECT *, CAST(trunc(raw) AS BIGINT) AS diff_sec FROM enr),
 passages AS (SELECT * FROM enriched QUALIFY row_number() OVER (PARTITION BY vehicle_id, trip_id, stop_id, service_date ORDER BY ts DESC, id DESC) = 1)"""


def enriched(fx: Fixture):
    return derive.enrich_positions(fx.positions, route_stops(fx), fx.stop_times)


def passages(fx: Fixture):
    return derive.dedupe_stop_passages(enriched(fx))


@query("D14_enrich_positions", ENRICHED + " SELECT id, stop_id, dist_m, service_date, diff_sec FROM enriched", "dist_m")
def _(fx):
    return enriched(fx).select("id", "stop_id", "dist_m", "service_date", "diff_sec")


@query("D15_dedupe_stop_passages", ENRICHED + " SELECT id, vehicle_id, trip_id, stop_id, service_date FROM passages")
def _(fx):
    return passages(fx).select("id", "vehicle_id", "trip_id", "stop_id", "service_date")


@query("D16_dedupe_pings", " SELECT id FROM pos")
def _(fx):
    return derive.dedupe_pings(fx.positions.unionByName(fx.positions.withColumn("id", F.col("id") + 10_000_000_000))).select("id")


@query("D17_sample_every_nth", " SELECT id FROM pos QUALIFY (row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, id) - 1) % 3 = 0")
def _(fx):
    return derive.sample_every_nth(fx.positions, 3).select("id")


@query("D18_trace_vehicle_journey", ENRICHED + " SELECT vehicle_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(diff_sec) AS BIGINT) AS total_diff FROM enriched GROUP BY 1")
def _(fx):  # every vehicle's journey; one vehicle is a filter in front
    return enriched(fx).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.sum("diff_sec").alias("total_diff"))


# --- metrics over events and runs


def split_sql(table: str, dev: str, prefix: str, keys: str, where: str = "true") -> str:
    return f"""SELECT {keys}, CAST(sum(CASE WHEN {dev} < -120 THEN 1 ELSE 0 END) AS BIGINT) AS {prefix}_early, CAST(sum(CASE WHEN {dev} BETWEEN -120 AND 420 THEN 1 ELSE 0 END) AS BIGINT) AS {prefix}_on_time,
      CAST(sum(CASE WHEN {dev} > 420 THEN 1 ELSE 0 END) AS BIGINT) AS {prefix}_late, count(*) AS {prefix}_n, sum(CASE WHEN {dev} BETWEEN -120 AND 420 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS {prefix}_pct
      FROM {table} WHERE {dev} IS NOT NULL AND {where} GROUP BY {keys}"""


OTP = f""", o1 AS ({split_sql('se', 'dev', 'all', E_KEY, "source = 'proximity'")}), o2 AS ({split_sql('runs', 'origin_dev_sec', 'origin', E_KEY, "source = 'proximity'")}),
 o3 AS ({split_sql('runs', 'destination_dev_sec', 'destination', E_KEY, "source = 'trip_update'")}), otp AS (SELECT * FROM o1 FULL JOIN o2 USING (route_id, service_date) FULL JOIN o3 USING (route_id, service_date))"""


def otp(fx: Fixture):
    return metrics.otp_split(fx.stop_events, fx.runs)


@query("E01_otp_split", OTP + " SELECT * FROM otp", "all_pct origin_pct destination_pct")
def _(fx):
    return otp(fx)


@query("E01_otp_split_pm_peak", f", w AS (SELECT *, obs_sec // 3600 % 24 AS h FROM se) {split_sql('w', 'dev', 'all', E_KEY, 'source = ' + chr(39) + 'proximity' + chr(39) + ' AND h >= 15 AND h < 19')}", "all_pct")
def _(fx):
    return metrics.otp_split(fx.stop_events, fx.runs, period="pm_peak").filter("all_n IS NOT NULL").select("route_id", "service_date", "all_early", "all_on_time", "all_late", "all_n", "all_pct")


@query("E02_system_otp_daily", " " + split_sql("se", "dev", "otp", "service_date", "source = 'proximity'"), "otp_pct")
def _(fx):
    return metrics.system_otp_daily(fx.stop_events)


@query("E03_route_otp_daily", f", d AS ({split_sql('se', 'dev', 'otp', E_KEY, chr(39) + 'proximity' + chr(39) + ' = source')}) SELECT r.route_id, s.service_date, otp_pct, otp_n FROM (SELECT DISTINCT route_id FROM se WHERE source = 'proximity') r CROSS JOIN dates s LEFT JOIN d ON d.route_id = r.route_id AND d.service_date = s.service_date", "otp_pct")
def _(fx):
    return metrics.route_otp_daily(fx.stop_events, fx.dates)


@query("E04_line_otp_from_positions", ENRICHED + f""", clean AS (SELECT p.* FROM enriched p JOIN fx_trips t ON t.trip_id = p.trip_id WHERE NOT (t.service_id = 'WK' AND p.service_date = DATE '2024-01-04')),
 pa AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY vehicle_id, trip_id, stop_id, service_date ORDER BY ts DESC, id DESC) = 1), s AS ({split_sql('pa', 'diff_sec', 'otp', 'route_id')})
 SELECT s.*, a.avg_late_sec FROM s JOIN (SELECT route_id, round(avg(diff_sec), 1) AS avg_late_sec FROM pa GROUP BY 1) a USING (route_id)""", "otp_pct avg_late_sec")
def _(fx):
    return metrics.line_otp_from_positions(fx.positions, fx.trips, fx.calendar_dates, route_stops(fx), fx.stop_times)


def arrivals_sql(metres: int, last: str) -> str:
    """SQL of the arrivals of matched pings at their nearest stop within ``metres``."""
    nearest = NEAR.replace("dist_m <= 50", f"dist_m <= {metres}")
    return MATCH + nearest + """, first_at AS (SELECT trip_id, stop_id, min_by(arrival_sec, stop_sequence) AS a FROM fx_st GROUP BY 1, 2),
 arr AS (SELECT m.route_id, m.trip_id, n.stop_id, m.ts, epoch(m.ts - CAST(CAST(m.ts AS DATE) AS TIMESTAMP)) - a AS diff_sec, CAST(hour(m.ts) AS INT) AS hour FROM matched m JOIN near n ON n.id = m.id JOIN first_at f ON f.trip_id = m.trip_id AND f.stop_id = n.stop_id WHERE m.confidence >= 0.3::DOUBLE)""" + last


def arrivals(fx: Fixture, max_m: float):
    return derive.arrivals_of_matches(matches(fx), derive.nearest_stop_within(fx.positions, route_stops(fx), max_m=max_m), fx.stop_times)


def _otp_sql(keys: str, rows: str = "arr") -> str:
    return f"{split_sql(rows, 'diff_sec', 'otp', keys)}"


def _with_mean(keys: str, rows: str = "arr") -> str:
    return f", o AS ({_otp_sql(keys, rows)}), l AS (SELECT {keys}, round(avg(diff_sec), 1) AS avg_late_sec FROM {rows} GROUP BY {keys}) SELECT o.*, avg_late_sec FROM o JOIN l USING ({keys})"


@query("E05_stop_otp_from_positions", arrivals_sql(50, _with_mean("route_id, stop_id")), "otp_pct avg_late_sec")
def _(fx):
    return metrics.otp_from_matches(arrivals(fx, 50.0), "stop_id")


@query("E06_period_otp_from_positions", arrivals_sql(50, f", ap AS (SELECT *, {ewt_period_sql('hour')} AS period FROM arr)" + _with_mean("route_id, period", "ap")), "otp_pct avg_late_sec")
def _(fx):
    return metrics.otp_from_matches(arrivals(fx, 50.0).withColumn("period", labels.ewt_period(F.hour("timestamp"))), "period")


@query("E07_otp_from_matches", arrivals_sql(200, """, o AS (""" + _otp_sql("route_id") + """), c AS (SELECT p.route_id, count(m.id) AS n_matched, count(*) - count(m.id) AS n_unmatched FROM pos p LEFT JOIN matched m ON m.id = p.id AND m.confidence >= 0.3::DOUBLE GROUP BY 1),
 l AS (SELECT route_id, round(avg(diff_sec), 1) AS avg_late_sec FROM arr GROUP BY 1) SELECT * FROM c LEFT JOIN o USING (route_id) LEFT JOIN l USING (route_id)"""), "otp_pct avg_late_sec")
def _(fx):
    counts = metrics.matched_and_unmatched(fx.positions, matches(fx))
    return counts.join(metrics.otp_from_matches(arrivals(fx, 200.0)), "route_id", "left")


def ref_passages(fx: Fixture):
    """Passages with stops told apart by direction, and each route-direction's reference stop."""
    rows = passages(fx).withColumn("stop_id", F.concat("stop_id", F.lit("_"), F.col("direction_id").cast("string")))
    return rows, schedule.reference_stop(*one_way(fx))


HEADWAYS = ENRICHED + REF_SQL + """, hours AS (SELECT route_id, min(arrival_sec // 3600) % 24 AS a, max(arrival_sec // 3600) AS b FROM fx_st GROUP BY 1),
 at_ref AS (SELECT p.route_id, p.direction_id, r.stop_id, p.service_date, p.ts, p.id FROM passages p JOIN ref r ON r.route_id = p.route_id AND r.direction_id = p.direction_id AND r.stop_id = concat(p.stop_id, '_', CAST(p.direction_id AS VARCHAR)) JOIN hours h ON h.route_id = p.route_id
   WHERE (hour(p.ts) >= a AND hour(p.ts) <= b) OR hour(p.ts) + 24 <= b),
 hw AS (SELECT *, CAST(trunc(epoch(ts - lag(ts) OVER (PARTITION BY route_id, direction_id, stop_id, service_date ORDER BY ts, id))) AS BIGINT) / 60.0::DOUBLE AS headway_min FROM at_ref)"""


def ref_headways(fx: Fixture):
    rows, ref = ref_passages(fx)
    return metrics.headways_at_stop(rows, ref, schedule.route_service_hours(fx.trips, fx.timetable, fx.routes))


@query("E08_headways_at_reference_stop", HEADWAYS + " SELECT route_id, direction_id, stop_id, service_date, ts AS timestamp, headway_min, headway_min <= 120 AS is_valid FROM hw WHERE headway_min IS NOT NULL", "headway_min")
def _(fx):
    return ref_headways(fx)


@query("E09_route_headways", HEADWAYS + ", p AS (SELECT route_id, direction_id, avg(headway_min) AS m, min(headway_min) AS a, max(headway_min) AS b FROM hw WHERE headway_min <= 120 GROUP BY 1, 2) SELECT route_id, avg(m) AS mean_headway_min, min(a) AS min_headway_min, max(b) AS max_headway_min FROM p GROUP BY 1", "mean_headway_min min_headway_min max_headway_min")
def _(fx):
    return metrics.route_headways(ref_headways(fx))


@query("E10_headways_batch", ENRICHED + """, best AS (SELECT route_id, direction_id, stop_id FROM passages GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, stop_id DESC) = 1),
 h AS (SELECT p.route_id, p.direction_id, CAST(trunc(epoch(ts - lag(ts) OVER (PARTITION BY p.route_id, p.direction_id, service_date ORDER BY ts, id))) AS BIGINT) / 60.0::DOUBLE AS h FROM passages p JOIN best b ON b.route_id = p.route_id AND b.direction_id = p.direction_id AND b.stop_id = p.stop_id),
 p AS (SELECT route_id, direction_id, avg(h) AS m, min(h) AS a, max(h) AS b, stddev_samp(h) AS s FROM h WHERE h > 0 GROUP BY 1, 2)
 SELECT route_id, avg(m) AS mean_min, min(a) AS min_min, max(b) AS max_min, avg(s) AS std_min, CASE WHEN avg(m) > 0 THEN avg(s) / avg(m) END AS cv FROM p GROUP BY 1""", "mean_min min_min max_min std_min cv")
def _(fx):
    return metrics.headways_batch(passages(fx))


@query("E11_average_speed", f""", st AS (SELECT route_id, CAST(ts AS DATE) AS d, ts, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM pos WINDOW w AS (PARTITION BY route_id, CAST(ts AS DATE) ORDER BY ts, id)),
 t AS (SELECT route_id, sum(step) AS m, CAST(trunc(epoch(max(ts) - min(ts))) AS BIGINT) AS s FROM st GROUP BY route_id, d), u AS (SELECT *, m / s * 3600 / 1609.344::DOUBLE AS mph FROM t WHERE s >= 300)
 SELECT route_id, count(*) AS n_trips, sum(m) / sum(s) * 3600 / 1609.344::DOUBLE AS avg_mph, quantile_cont(mph, 0.5) AS median_mph, min(mph) AS min_mph, max(mph) AS max_mph FROM u WHERE mph <= 60 GROUP BY 1""", "avg_mph median_mph min_mph max_mph")
def _(fx):
    # the fixture's vehicles send single pings; a route's pings of a day make one journey
    return metrics.average_speed(fx.positions.withColumns({"vehicle_id": F.col("route_id"), "trip_id": F.col("route_id")}))


@query("E12_average_speed_reported", " SELECT route_id, avg(speed) AS avg_speed, count(*) AS n_pings FROM pos WHERE speed IS NOT NULL GROUP BY 1", "avg_speed")
def _(fx):
    return metrics.average_speed_reported(fx.positions)


@query("E13_route_summary", " SELECT route_id, count(DISTINCT trip_id) AS n_trips, count(*) AS n_pings, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT vehicle_id) AS n_vehicles FROM pos GROUP BY 1")
def _(fx):
    return metrics.route_summary(fx.positions)


DELIVERED = """, ran AS (SELECT DISTINCT service_date, trip_id FROM runs WHERE stops_observed >= CASE WHEN stops_observable <= 2 THEN 1 WHEN stops_observable >= 9 THEN stops_observable // 3 ELSE 2 END),
 dl AS (SELECT t.route_id, s.service_date, count(*) AS trips_scheduled, count(r.trip_id) AS trips_delivered FROM svc s JOIN fx_trips t ON t.service_id = s.service_id LEFT JOIN ran r ON r.service_date = s.service_date AND r.trip_id = t.trip_id GROUP BY 1, 2),
 delivered AS (SELECT route_id, service_date, coalesce(trips_scheduled, 0) AS trips_scheduled, coalesce(trips_delivered, 0) AS trips_delivered, CASE WHEN trips_scheduled > 0 THEN trips_delivered / trips_scheduled::DOUBLE END AS delivered_ratio
   FROM dl FULL JOIN (SELECT DISTINCT route_id, service_date FROM runs) USING (route_id, service_date))"""


def delivered(fx: Fixture):
    return runs.service_delivered(fx.runs, schedule.scheduled_trips_on_date(fx.trips, services(fx)))


@query("E14_service_delivered", DELIVERED + " SELECT * FROM delivered", "delivered_ratio")
def _(fx):
    return delivered(fx)


SYS_DELIVERED = DELIVERED + ", sd AS (SELECT service_date, CAST(sum(trips_delivered) AS BIGINT) AS trips_delivered, CAST(sum(trips_scheduled) AS BIGINT) AS trips_scheduled, CASE WHEN service_date IN (SELECT service_date FROM runs) AND sum(trips_scheduled) > 0 THEN sum(trips_delivered) / sum(trips_scheduled)::DOUBLE END AS delivered_ratio FROM delivered GROUP BY 1)"


@query("E15_system_service_delivered_daily", SYS_DELIVERED + " SELECT * FROM sd", "delivered_ratio")
def _(fx):
    return runs.system_service_delivered_daily(delivered(fx), fx.runs)


@query("E16_stop_skip_rate", " SELECT route_id, service_date, count(*) AS n_runs, CAST(sum(stops_skipped) AS BIGINT) AS skipped, CAST(sum(stops_observable) AS BIGINT) AS observable, CASE WHEN sum(stops_observable) > 0 THEN sum(stops_skipped) / sum(stops_observable)::DOUBLE END AS skip_rate FROM runs WHERE source = 'trip_update' AND stops_observed >= 3 GROUP BY 1, 2", "skip_rate")
def _(fx):
    return runs.stop_skip_rate(fx.runs)


@query("E17_per_stop_skip_rate", """ SELECT s.route_id, s.direction_id, s.stop_id, count(*) AS n_events, CAST(sum(CASE WHEN rel = 'SKIPPED' THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped, sum(CASE WHEN rel = 'SKIPPED' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS skip_rate
 FROM se s JOIN (SELECT service_date, trip_id FROM runs WHERE source = 'trip_update' AND stops_observed >= 3) g ON g.service_date = s.service_date AND g.trip_id = s.trip_id WHERE s.source = 'trip_update' GROUP BY 1, 2, 3 HAVING count(*) >= 3""", "skip_rate")
def _(fx):
    return runs.per_stop_skip_rate(fx.stop_events, fx.runs, min_events=3)


_PICK = ", ".join(f"max(CASE WHEN source = '{s}' THEN {c} END) AS {a}_{n}" for s, a in (("proximity", "p"), ("trip_update", "t")) for c, n in (("first_obs", "f"), ("last_obs", "l"), ("origin_dev_sec", "o"), ("destination_dev_sec", "d"), ("sched_first", "sf"), ("sched_last", "sl")))
EXCESS = f""", wide AS (SELECT service_date, trip_id, route_id, {_PICK} FROM runs GROUP BY 1, 2, 3),
 ex AS (SELECT service_date, trip_id, route_id, CASE WHEN p_o IS NOT NULL AND t_d IS NOT NULL THEN t_l - p_f WHEN t_o IS NOT NULL AND t_d IS NOT NULL THEN t_l - t_f WHEN p_o IS NOT NULL AND p_d IS NOT NULL THEN p_l - p_f END AS act,
   CASE WHEN p_o IS NOT NULL AND t_d IS NOT NULL THEN t_sl - p_sf WHEN t_o IS NOT NULL AND t_d IS NOT NULL THEN t_sl - t_sf WHEN p_o IS NOT NULL AND p_d IS NOT NULL THEN p_sl - p_sf END AS sch FROM wide),
 excess AS (SELECT route_id, service_date, count(*) AS n_trips, CAST(trunc(round(quantile_cont(act - sch, 0.5), 6)) AS INT) AS median_excess_sec, CAST(trunc(round(quantile_cont(act - sch, 0.95), 6)) AS INT) AS p95_excess_sec, avg(CASE WHEN act > sch * 1.10::DOUBLE THEN 1 ELSE 0 END) * 100 AS pct_over
   FROM ex WHERE sch > 0 AND act > 0 GROUP BY 1, 2)"""


@query("E18_excess_trip_time", EXCESS + " SELECT * FROM excess", "pct_over")
def _(fx):
    return runs.excess_trip_time(fx.runs)


@query("E19_latest_nonempty_excess", EXCESS + " SELECT * FROM excess WHERE n_trips > 0 AND service_date <= DATE '2024-01-12' AND service_date > DATE '2024-01-05' QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY service_date DESC) = 1", "pct_over")
def _(fx):
    return runs.latest_nonempty_excess(runs.excess_trip_time(fx.runs), "2024-01-12")


@query("E20_awt", " SELECT route_id, direction_id, stop_id, CASE WHEN sum(h_sec) > 0 THEN sum(h_sec::BIGINT * h_sec) / (2 * sum(h_sec))::DOUBLE END AS awt_sec FROM sched_hw GROUP BY 1, 2, 3", "awt_sec")
def _(fx):
    h = F.col("h_sec").cast("long")
    return scheduled(fx).groupBy("route_id", "direction_id", "stop_id").agg(headways.awt(F.sum(h), F.sum(h * h)).alias("awt_sec"))


def observed(fx: Fixture):
    return headways.observed_headways(fx.stop_events)


def bunching(fx: Fixture):
    return headways.bunching_pairs(headways.observed_headways(fx.stop_events, scheduled_only=True), scheduled(fx), day_services(fx))


def gates(fx: Fixture):
    return config(fx)[0].select("route_id", "gate_sec")


@query("E21_observed_headways", " SELECT service_date, route_id, direction_id, stop_id, hour, CAST(h_sec AS BIGINT) AS h_sec, leader_dev, trailer_dev FROM obs_hw")
def _(fx):
    return observed(fx)


EWT = f""", fc AS (SELECT service_id, s.route_id, direction_id, stop_id, hour, sum(h_sec) AS s_h, sum(h_sec::BIGINT * h_sec) AS s_h2, count(*) AS s_n FROM sched_hw s LEFT JOIN {TIER_SQL} ON t.route_id = s.route_id GROUP BY 1, 2, 3, 4, 5 HAVING avg(h_sec) <= coalesce(max(gate_sec), 900)),
 fd AS (SELECT d.service_date, f.* EXCLUDE (service_id) FROM fc f JOIN day_svc d ON d.service_id = f.service_id),
 oc AS (SELECT service_date, route_id, direction_id, stop_id, hour, sum(h_sec) AS o_h, sum(h_sec::BIGINT * h_sec) AS o_h2, count(*) AS o_n FROM obs_hw GROUP BY 1, 2, 3, 4, 5),
 ec AS (SELECT f.*, coalesce(o_h, 0) AS o_h, coalesce(o_h2, 0) AS o_h2, coalesce(o_n, 0) AS o_n FROM fd f LEFT JOIN oc o ON o.service_date = f.service_date AND o.route_id = f.route_id AND o.direction_id = f.direction_id AND o.stop_id = f.stop_id AND o.hour = f.hour)"""
_SUM = "CAST(sum(s_h) AS BIGINT) AS s_h, CAST(sum(s_h2) AS BIGINT) AS s_h2, CAST(sum(s_n) AS BIGINT) AS s_n, CAST(sum(o_h) AS BIGINT) AS o_h, CAST(sum(o_h2) AS BIGINT) AS o_h2, CAST(sum(o_n) AS BIGINT) AS o_n"
_AWT = "CASE WHEN o_h > 0 THEN o_h2 / (2 * o_h)::DOUBLE END"
_SWT = "CASE WHEN s_h > 0 THEN s_h2 / (2 * s_h)::DOUBLE END"
HEAD = EWT + f", es AS (SELECT route_id, service_date, {_SUM} FROM ec GROUP BY 1, 2), ewt AS (SELECT *, {_AWT} AS awt_sec, {_SWT} AS swt_sec, {_AWT} - {_SWT} AS ewt_sec FROM es)"


def ewt(fx: Fixture):
    return headways.ewt_headline(observed(fx), scheduled(fx), day_services(fx), gates=gates(fx))


@query("E22_ewt_by_period", EWT + f""", ep AS (SELECT route_id, service_date, {ewt_period_sql('hour')} AS period, {_SUM} FROM ec GROUP BY 1, 2, 3),
 sp AS (SELECT DISTINCT route_id, service_date, p.period FROM ep, (VALUES ('AM Peak (6-9)'), ('Midday (9-15)'), ('PM Peak (15-19)'), ('Evening (19-24)'), ('Night (0-6)')) p(period)),
 x AS (SELECT sp.route_id, sp.service_date, sp.period, coalesce(s_h, 0) AS s_h, coalesce(s_h2, 0) AS s_h2, coalesce(s_n, 0) AS s_n, coalesce(o_h, 0) AS o_h, coalesce(o_h2, 0) AS o_h2, coalesce(o_n, 0) AS o_n FROM sp LEFT JOIN ep ON ep.route_id = sp.route_id AND ep.service_date = sp.service_date AND ep.period = sp.period)
 SELECT *, {_AWT} AS awt_sec, {_SWT} AS swt_sec, CASE WHEN o_h > 0 AND s_h > 0 THEN greatest({_AWT} - {_SWT}, 0) END AS ewt_sec, CASE WHEN s_n > 0 THEN least(1, o_n / s_n::DOUBLE) END AS coverage FROM x""", "awt_sec swt_sec ewt_sec coverage")
def _(fx):
    return headways.ewt_by_period(observed(fx), scheduled(fx), day_services(fx), gates=gates(fx))


@query("E23_ewt_headline", HEAD + " SELECT * FROM ewt", "awt_sec swt_sec ewt_sec")
def _(fx):
    return ewt(fx)


BUNCH = """, sc AS (SELECT d.service_date, route_id, direction_id, stop_id, hour, avg(h_sec) AS mean_h FROM sched_hw s JOIN day_svc d ON d.service_id = s.service_id GROUP BY 1, 2, 3, 4, 5),
 pairs AS (SELECT o.*, s.mean_h, o.h_sec < greatest(s.mean_h * 0.25::DOUBLE, 120) AS bunched FROM obs_hw o JOIN sc s ON s.service_date = o.service_date AND s.route_id = o.route_id AND s.direction_id = o.direction_id AND s.stop_id = o.stop_id AND s.hour = o.hour WHERE o.h_sec <= 7200)"""
_RATE = "count(*) AS n_headways, CAST(sum(CASE WHEN bunched THEN 1 ELSE 0 END) AS BIGINT) AS n_bunched, sum(CASE WHEN bunched THEN 1 ELSE 0 END) / count(*)::DOUBLE AS bunching_rate"


@query("E24_bunching_by_period", BUNCH + f" SELECT route_id, service_date, {ewt_period_sql('hour')} AS period, {_RATE} FROM pairs GROUP BY 1, 2, 3", "bunching_rate")
def _(fx):
    return headways.bunching_by_period(bunching(fx))


@query("E25_bunching_headline", BUNCH + f" SELECT route_id, service_date, {_RATE} FROM pairs GROUP BY 1, 2", "bunching_rate")
def _(fx):
    return headways.bunching_headline(bunching(fx))


@query("E26_bunching_causes", BUNCH + """, c AS (SELECT route_id, CASE WHEN leader_dev IS NULL OR trailer_dev IS NULL THEN 'unknown' WHEN leader_dev > 420 AND trailer_dev < -120 THEN 'both_off' WHEN leader_dev > 420 THEN 'leader_late_only' WHEN trailer_dev < -120 THEN 'trailer_early_only' ELSE 'neither_off' END AS cause, count(*) AS n
   FROM pairs WHERE bunched GROUP BY 1, 2), s AS (SELECT DISTINCT route_id, k.cause FROM c, (VALUES ('leader_late_only'), ('trailer_early_only'), ('both_off'), ('neither_off'), ('unknown')) k(cause))
 SELECT s.route_id, s.cause, coalesce(n, 0) AS n, coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY s.route_id) AS pct FROM s LEFT JOIN c ON c.route_id = s.route_id AND c.cause = s.cause""", "pct")
def _(fx):
    return headways.bunching_causes(bunching(fx))


SYS_EWT = EWT + BUNCH + f""", bus AS (SELECT route_id FROM routes WHERE route_type = '3'), sw AS (SELECT service_date, {_SUM} FROM ec WHERE route_id IN (SELECT route_id FROM bus) GROUP BY 1),
 sb AS (SELECT service_date, {_RATE} FROM pairs WHERE route_id IN (SELECT route_id FROM bus) GROUP BY 1),
 sys AS (SELECT service_date, CASE WHEN o_h > 0 AND s_h > 0 THEN greatest({_AWT} - {_SWT}, 0) END AS ewt_sec, {_SWT} AS swt_sec, o_n, n_headways, n_bunched, bunching_rate FROM sw FULL JOIN sb USING (service_date))"""


def system_ewt(fx: Fixture):
    return headways.system_ewt_swt_bunching_daily(observed(fx), bunching(fx), scheduled(fx), day_services(fx), schedule.bus_route_filter(fx.routes), gates=gates(fx))


@query("E27_system_ewt_swt_bunching_daily", SYS_EWT + " SELECT * FROM sys", "ewt_sec swt_sec bunching_rate")
def _(fx):
    return system_ewt(fx)


COVER = """, mins AS (SELECT date_trunc('minute', ts) AS m FROM events), cov AS (SELECT d.service_date, 1440 AS minutes_in_day, count(DISTINCT m) AS minutes_seen, count(DISTINCT m) / 1440.0::DOUBLE AS coverage FROM dates d LEFT JOIN
  (SELECT m FROM (SELECT date_trunc('minute', ts) AS m FROM events WHERE event_type = 'view' UNION ALL SELECT date_trunc('minute', ts) FROM pos)) x ON CAST(x.m - INTERVAL 5 HOUR AS DATE) = d.service_date GROUP BY 1)"""


def coverage(fx: Fixture):
    return metrics.ingest_coverage(fx.heartbeats, fx.positions, fx.dates)


@query("E28_ingest_coverage", COVER + " SELECT * FROM cov", "coverage")
def _(fx):
    return coverage(fx)


@query("E29_coverage_flag", COVER + " SELECT service_date, CASE WHEN coverage >= 0.02 * 0.8::DOUBLE THEN 'complete' ELSE 'partial' END AS data_quality FROM cov")
def _(fx):
    return coverage(fx).select("service_date", metrics.coverage_flag(F.col("coverage"), 0.02).alias("data_quality"))


@query("E30_run_quality", NEAR + """, rp AS (SELECT *, CAST(ts AS DATE) AS ping_date FROM pos), rg AS (SELECT *, CAST(trunc(epoch(ts - lag(ts) OVER (PARTITION BY trip_id, vehicle_id, ping_date ORDER BY ts, id))) AS BIGINT) AS gap FROM rp),
 ra AS (SELECT trip_id, vehicle_id, ping_date, count(*) AS n_pings, min(ts) AS first_ts, CAST(trunc(epoch(max(ts) - min(ts))) AS BIGINT) AS duration_sec, max(gap) AS max_gap_sec, avg(speed) AS avg_speed FROM rg GROUP BY 1, 2, 3),
 rt AS (SELECT trip_id, min_by(arrival_sec, stop_sequence) AS a, count(*) AS stops_scheduled, max(arrival_sec) - min(arrival_sec) AS scheduled_duration_sec FROM fx_st GROUP BY 1),
 rr AS (SELECT ra.*, stops_scheduled, scheduled_duration_sec, ping_date - CASE WHEN abs(epoch(first_ts - CAST(ping_date AS TIMESTAMP)) + 86400 - a) < abs(epoch(first_ts - CAST(ping_date AS TIMESTAMP)) - a) THEN 1 ELSE 0 END AS service_date FROM ra LEFT JOIN rt ON rt.trip_id = ra.trip_id),
 rs2 AS (SELECT trip_id, vehicle_id, CAST(ts AS DATE) AS ping_date, stop_id, ts AS seen FROM near QUALIFY row_number() OVER (PARTITION BY trip_id, vehicle_id, CAST(ts AS DATE), stop_id ORDER BY CASE current_status WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, ts, id) = 1),
 ro AS (SELECT s.*, f.stop_sequence, epoch(s.seen - CAST(r.service_date AS TIMESTAMP)) - f.arrival_sec AS dev FROM rs2 s JOIN fx_st f ON f.trip_id = s.trip_id AND f.stop_id = s.stop_id JOIN rr r ON r.trip_id = s.trip_id AND r.vehicle_id = s.vehicle_id AND r.ping_date = s.ping_date),
 rq AS (SELECT trip_id, vehicle_id, ping_date, count(DISTINCT stop_id) AS stops_observed, min(stop_sequence) AS first_obs_seq, max(stop_sequence) AS last_obs_seq, CAST(trunc(round(quantile_cont(dev, 0.5), 6)) AS INT) AS dev_p50_sec, CAST(trunc(round(quantile_cont(dev, 0.95), 6)) AS INT) AS dev_p95_sec,
   CAST(sum(CASE WHEN dev < -60 THEN 1 ELSE 0 END) AS BIGINT) AS early_stops, CAST(sum(CASE WHEN dev BETWEEN -60 AND 300 THEN 1 ELSE 0 END) AS BIGINT) AS on_time_stops, CAST(sum(CASE WHEN dev > 300 THEN 1 ELSE 0 END) AS BIGINT) AS late_stops FROM ro GROUP BY 1, 2, 3)
 SELECT r.* EXCLUDE (first_ts), q.* EXCLUDE (trip_id, vehicle_id, ping_date), least(1, stops_observed / stops_scheduled::DOUBLE) * 100 AS coverage_pct,
   coalesce(least(1, stops_observed / stops_scheduled::DOUBLE) * 100 >= 70 AND first_obs_seq <= 3 AND last_obs_seq >= stops_scheduled - 3 AND coalesce(max_gap_sec, 0) < 300, false) AS is_complete
 FROM rr r LEFT JOIN rq q ON q.trip_id = r.trip_id AND q.vehicle_id = r.vehicle_id AND q.ping_date = r.ping_date""", "avg_speed coverage_pct")
def _(fx):
    return metrics.run_quality(fx.positions, route_stops(fx), fx.stop_times)


@query("E31_stop_diagnostics", CANON + """, per AS (SELECT route_id, direction_id, stop_id, count(CASE WHEN source = 'proximity' THEN dev END) AS n_obs, quantile_cont(CASE WHEN source = 'proximity' THEN dev END, 0.5) AS median_dev_sec, quantile_cont(CASE WHEN source = 'proximity' THEN dev END, 0.95) AS p95_dev_sec,
   avg(CASE WHEN source = 'proximity' THEN CASE WHEN dev BETWEEN -120 AND 420 THEN 1 ELSE 0 END END) * 100 AS otp_pct, avg(CASE WHEN source = 'trip_update' THEN CASE WHEN rel = 'SKIPPED' THEN 1 ELSE 0 END END) * 100 AS skip_pct FROM se GROUP BY 1, 2, 3)
 SELECT c.route_id, c.direction_id, c.stop_id, c.stop_sequence, coalesce(n_obs, 0) AS n_obs, median_dev_sec, p95_dev_sec, otp_pct, skip_pct FROM canon c LEFT JOIN per p ON p.route_id = c.route_id AND p.direction_id = c.direction_id AND p.stop_id = c.stop_id""", "median_dev_sec p95_dev_sec otp_pct skip_pct")
def _(fx):
    return metrics.stop_diagnostics(fx.stop_events, fx.trips, fx.stop_times)


@query("E32_rolling_otp", " SELECT route_id, trip_id, stop_sequence, TIMESTAMP '2024-01-01 05:00:00' + to_seconds(obs_sec) AS observed_arrival_ts, avg(CASE WHEN dev BETWEEN -120 AND 420 THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY obs_sec, trip_id, stop_sequence ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_otp FROM se WHERE source = 'proximity'", "rolling_otp")
def _(fx):
    return metrics.rolling_otp(fx.stop_events)


@query("E33_lateness_histogram", " SELECT route_id, CAST(floor(dev / 60.0) AS INT) AS minute, count(*) AS n FROM se WHERE source = 'proximity' GROUP BY 1, 2")
def _(fx):
    return metrics.lateness_histogram(fx.stop_events)


@query("E33_otp_by_direction", " " + split_sql("se", "dev", "otp", "route_id, direction_id", "source = 'proximity'"), "otp_pct")
def _(fx):
    return metrics.otp_by_direction(fx.stop_events)


@query("E34_feed_profile", """ SELECT * FROM (SELECT count(*) AS n_rows, avg(CASE WHEN vehicle_id IS NULL THEN 0 ELSE 1 END) AS has_vehicle, avg(CASE WHEN pred IS NULL THEN 0 ELSE 1 END) AS has_prediction, avg(CASE WHEN line_no % 2 = 0 THEN 1 ELSE 0 END) AS has_start_date,
   CAST(sum(CASE WHEN rel = 'SCHEDULED' THEN 1 ELSE 0 END) AS BIGINT) AS n_scheduled, CAST(sum(CASE WHEN rel = 'SKIPPED' THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped FROM tu),
  (SELECT count(*) AS n_trips, min(k) AS min_rows, quantile_cont(k, 0.5) AS median_rows, quantile_cont(k, 0.95) AS p95_rows, max(k) AS max_rows FROM (SELECT count(*) AS k FROM tu GROUP BY trip_id))""", "has_vehicle has_prediction has_start_date median_rows p95_rows")
def _(fx):
    return metrics.feed_profile(fx.trip_updates)


@query("E35_prediction_volatility", """, p AS (SELECT count(DISTINCT snapshot_ts) AS k, CAST(trunc(epoch(max(pred) - min(pred))) AS BIGINT) AS spread FROM tu GROUP BY trip_id, stop_sequence), l AS (SELECT list_sort(list(k)) AS ks, list_sort(list(spread) FILTER (WHERE spread IS NOT NULL)) AS ss, count(*) AS n FROM p)
 SELECT n AS n_keys, ks[CAST(round_even((len(ks) - 1) * 0.5::DOUBLE, 0) AS INT) + 1] AS median_snapshots, ks[-1] AS max_snapshots, ss[CAST(round_even((len(ss) - 1) * 0.5::DOUBLE, 0) AS INT) + 1] AS median_spread, ss[CAST(round_even((len(ss) - 1) * 0.95::DOUBLE, 0) AS INT) + 1] AS p95_spread, ss[-1] AS max_spread FROM l""")
def _(fx):
    return metrics.prediction_volatility(fx.trip_updates)

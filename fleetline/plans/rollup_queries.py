"""Queries of diagnostics, corridors, blocks, rollups, rankings and the folds that streams share."""

from __future__ import annotations

from pyspark.sql import functions as F


from fleetline.operators import corridors, diagnostics, headways, metrics, rollups, runs, schedule, upkeep
from fleetline.plans.fixtures import AS_OF, Fixture, refresh_runs
from fleetline.plans.metric_queries import _AWT, _RATE, _SUM, _SWT, BUNCH, COVER, DELIVERED, EWT, EXCESS, FOLD, HEAD, OTP, PROX, RS, SYS_DELIVERED, SYS_EWT, bunching, coverage, delivered, gates, observed, otp, proximity_events, split_sql
from fleetline.plans.registry import query
from fleetline.plans.schedule_queries import _CLASS, _OW, _PROFILE, ORIGIN, OWN_SQL, TARGET_SQL, TIER_SQL, WINDOW_TRIPS, config, bearing_sql, day_services, ewt_period_sql, hav_sql, period_sql, route_stops, scheduled, service_profile, services
from fleetline.sources.dated import DatedTable
from fleetline.sources.scratch import scratch_path
from fleetline.streaming import live, updates

SEG = "route_id, direction_id, period, from_seq, to_seq, from_stop, to_stop"
# every row once under 'all' and once under its named period
_BOTH = "CROSS JOIN LATERAL (SELECT unnest(['all', {p}]) AS period)"

CANON_MAP = """, cmap AS (SELECT route_id, direction_id, stop_sequence, stop_id, count(*) AS n FROM se WHERE source = 'proximity' GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY route_id, direction_id, stop_sequence ORDER BY count(*) DESC, stop_id) = 1)"""
SLIP = CANON_MAP + f""", l AS (SELECT route_id, direction_id, stop_sequence AS from_seq, stop_id AS from_stop, lead(stop_sequence) OVER w AS to_seq, lead(stop_id) OVER w AS to_stop, lead(obs_sec) OVER w - obs_sec AS og, lead(sched_sec) OVER w - sched_sec AS sg,
   CAST(sched_sec // 3600 % 24 AS INT) AS hour, CAST(obs_sec // 3600 % 24 AS INT) AS obs_hour FROM se WHERE source = 'proximity' WINDOW w AS (PARTITION BY service_date, trip_id ORDER BY stop_sequence)),
 so AS (SELECT l.*, og - sg AS slip FROM l JOIN cmap a ON a.route_id = l.route_id AND a.direction_id = l.direction_id AND a.stop_sequence = l.from_seq AND a.stop_id = l.from_stop
   JOIN cmap b ON b.route_id = l.route_id AND b.direction_id = l.direction_id AND b.stop_sequence = l.to_seq AND b.stop_id = l.to_stop WHERE og BETWEEN 0 AND 1800),
 seg AS (SELECT route_id, direction_id, period, from_seq, to_seq, from_stop, to_stop, avg(slip) AS mean_slip_sec, count(*) AS n_obs FROM so {_BOTH.format(p=period_sql('hour'))} GROUP BY ALL HAVING count(*) >= 3)"""
MIN_OBS = 3  # the small test tables hold few observations a segment


def segments(fx: Fixture):
    return diagnostics.segment_slip(fx.stop_events, min_obs=MIN_OBS)


@query("X01_canonical_stop_mapping", CANON_MAP + " SELECT * FROM cmap")
def _(fx):
    return diagnostics.canonical_stop_mapping(fx.stop_events.filter("source = 'proximity'"))


# distances of the fixture's stops are about 222 m, so the radius is wider here
LAYOVER = ORIGIN + f""", lay AS (SELECT p.route_id, p.direction_id, p.stop_sequence, p.stop_id, median_dev FROM (SELECT route_id, direction_id, stop_sequence, stop_id, quantile_cont(dev, 0.5) AS median_dev FROM se WHERE source = 'proximity' GROUP BY 1, 2, 3, 4) p
   JOIN origin o ON o.route_id = p.route_id AND o.direction_id = p.direction_id JOIN stops a ON a.stop_id = o.stop_id JOIN stops b ON b.stop_id = p.stop_id
   WHERE p.stop_sequence - o.stop_sequence BETWEEN 0 AND 5 AND p.stop_id <> o.stop_id AND median_dev <= 250 AND {hav_sql('a.stop_lat', 'a.stop_lon', 'b.stop_lat', 'b.stop_lon')} <= 300)"""


def layover(fx: Fixture):
    return diagnostics.layover_stops(fx.stop_events, fx.trips, fx.stop_times, fx.stops, max_m=300.0, early_sec=250)


@query("X02_layover_stops", LAYOVER + " SELECT * FROM lay", "median_dev")
def _(fx):
    return layover(fx)


@query("X03_segment_slip", SLIP + " SELECT * FROM seg", "mean_slip_sec")
def _(fx):
    return segments(fx)


CUM = SLIP + LAYOVER + f""", kept AS (SELECT s.* FROM (SELECT *, min(from_seq) OVER (PARTITION BY route_id, direction_id, period) AS first FROM seg) s WHERE from_seq > first AND NOT EXISTS
   (SELECT 1 FROM lay y WHERE y.route_id = s.route_id AND y.direction_id = s.direction_id AND y.stop_sequence = s.from_seq AND y.stop_id = s.from_stop)),
 own AS (SELECT *, CASE WHEN to_seq = min(to_seq) OVER (PARTITION BY route_id, direction_id, period, from_seq) THEN mean_slip_sec ELSE 0 END AS own FROM kept),
 cum AS (SELECT {SEG}, mean_slip_sec, n_obs, coalesce(sum(own) OVER (PARTITION BY route_id, direction_id, period ORDER BY from_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + own AS cum_slip_sec FROM own)"""


@query("X04_cumulative_slip", CUM + " SELECT * FROM cum", "mean_slip_sec cum_slip_sec")
def _(fx):
    return diagnostics.cumulative_slip(segments(fx), layover(fx))


TP = RS + f", tp AS (SELECT DISTINCT rs.route_id, rs.stop_id FROM rs JOIN stops t ON t.stop_num % 2 = 0 AND {hav_sql('rs.stop_lat', 'rs.stop_lon', 't.stop_lat', 't.stop_lon')} < 50)"


def timepoints_of(fx: Fixture):
    return diagnostics.timepoint_stops(route_stops(fx), fx.timepoints)


@query("X05_timepoint_stops", TP + " SELECT * FROM tp")
def _(fx):
    return timepoints_of(fx)


@query("X06_timepoint_behavior", TP + f""", b AS (SELECT route_id, direction_id, stop_id, dev AS leaving, lag(dev) OVER w AS entering, CAST(lag(obs_sec) OVER w // 3600 % 24 AS INT) AS hour FROM se WHERE source = 'proximity' WINDOW w AS (PARTITION BY service_date, trip_id ORDER BY stop_sequence)),
 q AS (SELECT b.route_id, direction_id, period, b.stop_id, count(*) AS n_obs, quantile_cont(entering, 0.1) AS in_p10, quantile_cont(entering, 0.5) AS in_p50, quantile_cont(leaving, 0.1) AS out_p10, quantile_cont(leaving, 0.5) AS out_p50 FROM b JOIN tp ON tp.route_id = b.route_id AND tp.stop_id = b.stop_id
   {_BOTH.format(p=period_sql('hour'))} WHERE entering IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
 SELECT *, CASE WHEN in_p50 - out_p50 >= 120 THEN 'recovery' WHEN out_p10 >= 180 THEN 'leaky' WHEN in_p50 >= 120 AND in_p50 - out_p50 < 60 THEN 'underpowered' ELSE 'neutral' END AS behavior FROM q""", "in_p10 in_p50 out_p10 out_p50")
def _(fx):
    return diagnostics.timepoint_behavior(fx.stop_events, timepoints_of(fx), min_obs=5)


@query("X07_direction_asymmetry", f""", h AS (SELECT route_id, direction_id, dev, CAST(sched_sec // 3600 % 24 AS INT) AS hour FROM se WHERE source = 'proximity'),
 q AS (SELECT route_id, direction_id, period, count(*) AS n_obs, avg(CASE WHEN dev < -120 THEN 1 ELSE 0 END) * 100 AS early_pct, avg(CASE WHEN dev > 420 THEN 1 ELSE 0 END) * 100 AS late_pct FROM h {_BOTH.format(p=period_sql('hour'))} GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN early_pct - late_pct > 5 THEN 'early_dominant' WHEN early_pct - late_pct < -5 THEN 'late_dominant' ELSE 'balanced' END AS signature FROM q""", "early_pct late_pct")
def _(fx):
    return diagnostics.direction_asymmetry(fx.stop_events)


def shared_runs(fx: Fixture):
    return corridors.corridor_runs(fx.trips, fx.shapes)


# every pair of points is compared here; the operator meets them by grid cell
RUNS_SQL = f""", shp AS (SELECT concat('R', CAST(r AS VARCHAR)) AS route_id, d AS direction_id, CAST(i + 1 AS INT) AS seq, 38.90::DOUBLE + (r % 4) * 0.00005::DOUBLE AS lat, -77.05::DOUBLE + CASE d WHEN 0 THEN i ELSE 29 - i END * 0.0004::DOUBLE AS lon
   FROM (SELECT DISTINCT route_num AS r, direction_id AS d FROM fx_trips), range(30) t(i)),
 bear AS (SELECT *, {bearing_sql('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS own FROM shp WINDOW w AS (PARTITION BY route_id, direction_id ORDER BY seq)),
 pts AS (SELECT *, coalesce(own, lag(own) OVER (PARTITION BY route_id, direction_id ORDER BY seq)) AS bearing FROM bear),
 sets AS (SELECT a.route_id, a.direction_id, a.seq, a.lat, a.lon, a.bearing, array_to_string(list_sort(list(DISTINCT b.route_id)), ',') AS routes FROM pts a JOIN pts b ON {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 15
   AND least(abs(a.bearing - b.bearing), 360 - abs(a.bearing - b.bearing)) < 30 GROUP BY ALL),
 isl AS (SELECT *, sum(new) OVER (PARTITION BY route_id, direction_id ORDER BY seq) AS island FROM (SELECT *, CASE WHEN routes = lag(routes) OVER (PARTITION BY route_id, direction_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM sets)),
 stp AS (SELECT *, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM isl WINDOW w AS (PARTITION BY route_id, direction_id, island ORDER BY seq)),
 cruns AS (SELECT route_id, direction_id, routes, count(*) AS n_points, min(seq) AS from_seq, max(seq) AS to_seq, coalesce(sum(step), 0) AS length_m, avg(bearing) AS mean_bearing, arg_min(lat, seq) AS a_lat, arg_min(lon, seq) AS a_lon, arg_max(lat, seq) AS b_lat, arg_max(lon, seq) AS b_lon,
   ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor((avg(bearing) + 22.5) / 45) AS INT) % 8 + 1] AS cardinal FROM stp GROUP BY route_id, direction_id, island, routes HAVING count(*) >= 5 AND routes LIKE '%,%')"""


@query("X08_corridor_runs", RUNS_SQL + " SELECT * EXCLUDE (a_lat, a_lon, b_lat, b_lon) FROM cruns", "length_m mean_bearing")
def _(fx):
    return shared_runs(fx).drop("points")


def corridor_table(fx: Fixture):
    along = fx.shapes.filter("shape_pt_sequence % 7 = 1").select(F.regexp_replace("shape_id", r"^P(\d+)_.*$", "R$1").alias("route_id"), F.regexp_extract("shape_id", r"_(\d)$", 1).cast("int").alias("direction_id"), _corner().alias("stop_id"), F.col("shape_pt_sequence").alias("stop_sequence"))
    return corridors.corridors(shared_runs(fx), route_stops(fx).unionByName(_shape_stops(fx)), along)


def _corner():
    return F.concat(F.lit("C"), F.round(F.col("shape_pt_lon") * 10000).cast("int").cast("string"))


def _shape_stops(fx: Fixture):
    """Stops along the fixture's shapes, which its stop table lies across."""
    seq = fx.shapes.filter("shape_pt_sequence % 7 = 1").select(F.regexp_replace("shape_id", r"^P(\d+)_.*$", "R$1").alias("route_id"), _corner().alias("stop_id"), F.lit("corner").alias("stop_name"), F.lit(38.9).alias("stop_lat"), F.col("shape_pt_lon").alias("stop_lon"))
    return seq.distinct()


CORRIDORS_SQL = RUNS_SQL + RS + f""", cstop AS (SELECT DISTINCT route_id, concat('C', CAST(CAST(round(lon * 10000) AS INT) AS VARCHAR)) AS stop_id, 38.9::DOUBLE AS stop_lat, lon AS stop_lon FROM shp WHERE seq % 7 = 1),
 plc AS (SELECT stop_id, stop_lat, stop_lon, list(DISTINCT route_id) AS serves FROM (SELECT route_id, stop_id, stop_lat, stop_lon FROM rs UNION ALL SELECT * FROM cstop) GROUP BY 1, 2, 3),
 cend AS (SELECT route_id, direction_id, from_seq, routes, 'a' AS side, a_lat AS lat, a_lon AS lon FROM cruns WHERE length_m >= 500 UNION ALL SELECT route_id, direction_id, from_seq, routes, 'b', b_lat, b_lon FROM cruns WHERE length_m >= 500),
 snap AS (SELECT route_id, direction_id, from_seq, side, arg_min(stop_id, {{'d': {hav_sql('lat', 'lon', 'stop_lat', 'stop_lon')}, 's': stop_id}}) AS stop_id FROM cend JOIN plc ON {hav_sql('lat', 'lon', 'stop_lat', 'stop_lon')} < 100 AND len(list_intersect(string_split(routes, ','), serves)) >= 2 GROUP BY 1, 2, 3, 4),
 ided AS (SELECT c.routes, c.cardinal, a.stop_id AS s, b.stop_id AS e, c.length_m FROM cruns c JOIN snap a ON a.side = 'a' AND a.route_id = c.route_id AND a.direction_id = c.direction_id AND a.from_seq = c.from_seq
   JOIN snap b ON b.side = 'b' AND b.route_id = c.route_id AND b.direction_id = c.direction_id AND b.from_seq = c.from_seq WHERE c.length_m >= 500 AND a.stop_id <> b.stop_id
   QUALIFY row_number() OVER (PARTITION BY c.routes, c.cardinal, a.stop_id, b.stop_id ORDER BY c.length_m DESC, c.route_id, c.direction_id, c.from_seq) = 1),
 crow AS (SELECT *, row_number() OVER (PARTITION BY cardinal, routes ORDER BY length_m DESC, s, e) AS nr FROM ided),
 nxt AS (SELECT r.cardinal, r.routes, r.nr, min(f.nr) AS next FROM crow r JOIN crow f ON f.cardinal = r.cardinal AND f.routes = r.routes AND f.s = r.e GROUP BY 1, 2, 3),
 reach AS (WITH RECURSIVE walk(cardinal, routes, head, nr, steps) AS (SELECT cardinal, routes, nr, nr, 0 FROM crow r WHERE NOT EXISTS (SELECT 1 FROM crow p WHERE p.cardinal = r.cardinal AND p.routes = r.routes AND p.e = r.s)
   UNION ALL SELECT w.cardinal, w.routes, w.head, n.next, w.steps + 1 FROM walk w JOIN nxt n ON n.cardinal = w.cardinal AND n.routes = w.routes AND n.nr = w.nr WHERE w.steps < (SELECT count(*) FROM crow)) SELECT * FROM walk),
 own AS (SELECT cardinal, routes, nr, min({{'h': head, 's': steps}}) AS o FROM reach GROUP BY 1, 2, 3),
 lnk AS (SELECT r.*, o IS NULL AS loose, coalesce(o.h, r.nr) AS head, coalesce(o.s, 0) AS steps FROM crow r LEFT JOIN own USING (cardinal, routes, nr)),
 seqs AS (SELECT route_id, direction_id, concat('C', CAST(CAST(round(lon * 10000) AS INT) AS VARCHAR)) AS stop_id, min(seq) AS q FROM shp WHERE seq % 7 = 1 GROUP BY 1, 2, 3),
 spn AS (SELECT l.cardinal, l.routes, l.nr, x.route_id, x.direction_id, least(x.q, y.q) AS a, greatest(x.q, y.q) AS b FROM lnk l JOIN seqs x ON x.stop_id = l.s AND list_contains(string_split(l.routes, ','), x.route_id) JOIN seqs y ON y.stop_id = l.e AND y.route_id = x.route_id AND y.direction_id = x.direction_id),
 mrg AS (SELECT cardinal, routes, loose, head, sum(length_m) AS length_m, arg_min(s, steps) AS start_stop, arg_max(e, steps) AS end_stop, arg_min(nr, steps) AS f, arg_max(nr, steps) AS l, count(*) AS n_merged FROM lnk GROUP BY 1, 2, 3, 4),
 mrk AS (SELECT *, row_number() OVER (PARTITION BY cardinal, routes ORDER BY length_m DESC, loose, head) AS rank FROM mrg),
 msp AS (SELECT m.cardinal, m.routes, m.rank, x.route_id, x.direction_id, x.a, y.b, count(*) OVER (PARTITION BY m.cardinal, m.routes, m.rank) AS n FROM mrk m JOIN spn x ON x.cardinal = m.cardinal AND x.routes = m.routes AND x.nr = m.f JOIN spn y ON y.cardinal = m.cardinal AND y.routes = m.routes AND y.nr = m.l AND y.route_id = x.route_id AND y.direction_id = x.direction_id),
 nst AS (SELECT i.cardinal, i.routes, i.rank FROM msp i JOIN msp o ON o.cardinal = i.cardinal AND o.routes = i.routes AND o.route_id = i.route_id AND o.direction_id = i.direction_id AND o.n = i.n AND o.rank < i.rank AND o.a <= i.a AND i.b <= o.b
   GROUP BY i.cardinal, i.routes, i.rank, o.rank HAVING count(*) = max(i.n) AND bool_or(o.a < i.a OR i.b < o.b))
 SELECT routes, cardinal, start_stop, end_stop, length_m, sha256(concat_ws('|', cardinal, routes, start_stop, end_stop)) AS corridor_id, concat(start_stop, '-', end_stop, ' ', cardinal) AS display_name FROM mrk m
   WHERE NOT EXISTS (SELECT 1 FROM nst n WHERE n.cardinal = m.cardinal AND n.routes = m.routes AND n.rank = m.rank)"""


@query("X09_corridors", CORRIDORS_SQL, "length_m")
def _(fx):  # without the line's text: engines spell doubles differently
    return corridor_table(fx).drop("wkt")


# membership for the SQL-checked corridor queries: three spans per route and direction
_MEM = ", mem AS (SELECT concat('K', CAST(k AS VARCHAR)) AS corridor_id, route_id, d AS direction_id, CAST(1 + k AS INT) AS start_seq, CAST(4 + k AS INT) AS end_seq FROM routes, range(2) d(d), range(3) k(k) WHERE CAST(substr(route_id, 2) AS INT) % 3 = k)"


def membership(fx: Fixture):
    k = F.substring("route_id", 2, 9).cast("int") % 3
    return fx.routes.select("route_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("direction_id"), k.alias("k")).select(F.concat(F.lit("K"), F.col("k").cast("string")).alias("corridor_id"), "route_id", "direction_id", (F.col("k") + 1).alias("start_seq"), (F.col("k") + 4).alias("end_seq"))


CSLIP = SLIP + _MEM + """, ins AS (SELECT m.corridor_id, s.* FROM mem m JOIN seg s ON s.route_id = m.route_id AND s.direction_id = m.direction_id AND from_seq >= start_seq AND to_seq <= end_seq),
 cs AS (SELECT corridor_id, period, sum(n_obs * mean_slip_sec) AS weighted_slip, CAST(sum(n_obs) AS BIGINT) AS n_obs, sum(n_obs * mean_slip_sec) / sum(n_obs) AS mean_slip_sec, count(DISTINCT (route_id, direction_id)) AS n_route_dirs FROM ins GROUP BY 1, 2),
 pk AS (SELECT corridor_id, period AS peak FROM cs WHERE period <> 'all' QUALIFY row_number() OVER (PARTITION BY corridor_id ORDER BY mean_slip_sec DESC, period DESC) = 1),
 cslip AS (SELECT cs.*, CASE WHEN period = 'all' THEN peak END AS peak_period FROM cs LEFT JOIN pk USING (corridor_id))"""


@query("X10_corridor_slip", CSLIP + " SELECT * FROM cslip", "weighted_slip mean_slip_sec")
def _(fx):
    return corridors.corridor_slip(membership(fx), segments(fx))


CROSS = SLIP + """, cr AS (SELECT from_stop, to_stop, period, count(DISTINCT route_id) AS n_routes, CAST(sum(n_obs) AS BIGINT) AS n_obs, sum(n_obs * mean_slip_sec) / sum(n_obs) AS mean_slip_sec, count(*) AS n_contributors FROM seg GROUP BY 1, 2, 3 HAVING count(DISTINCT route_id) >= 2),
 cp AS (SELECT from_stop, to_stop, period AS peak_period FROM cr WHERE period <> 'all' QUALIFY row_number() OVER (PARTITION BY from_stop, to_stop ORDER BY mean_slip_sec DESC, period DESC) = 1),
 crossr AS (SELECT cr.*, peak_period FROM cr LEFT JOIN cp USING (from_stop, to_stop))"""


def cross(fx: Fixture):
    return diagnostics.cross_route_segments(segments(fx))


@query("X11_cross_route_segments", CROSS + " SELECT * FROM crossr", "mean_slip_sec")
def _(fx):
    return cross(fx).withColumn("n_contributors", F.size("contributors").cast("long")).drop("contributors")


@query("X12_rank_segments", CROSS + " SELECT from_stop, to_stop, a.stop_name AS from_name, b.stop_name AS to_name, mean_slip_sec, mean_slip_sec / 60 AS slip_min_per_trip, n_obs FROM (SELECT * FROM crossr WHERE period = 'all' ORDER BY mean_slip_sec DESC, from_stop, to_stop LIMIT 20) LEFT JOIN stops a ON a.stop_id = from_stop LEFT JOIN stops b ON b.stop_id = to_stop", "mean_slip_sec slip_min_per_trip")
def _(fx):
    return diagnostics.rank_segments(cross(fx), fx.stops).select("from_stop", "to_stop", "from_name", "to_name", "mean_slip_sec", "slip_min_per_trip", "n_obs")


@query("X13_rank_corridors", CSLIP + " SELECT * FROM cslip WHERE period = 'all' ORDER BY weighted_slip DESC, corridor_id LIMIT 20", "weighted_slip mean_slip_sec")
def _(fx):
    return corridors.rank_corridors(corridors.corridor_slip(membership(fx), segments(fx)))


@query("X13_corridor_segments", CSLIP + " SELECT corridor_id, period, from_stop, to_stop, CAST(sum(n_obs) AS BIGINT) AS n_obs, sum(n_obs * mean_slip_sec) / sum(n_obs) AS mean_slip_sec, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes FROM ins GROUP BY 1, 2, 3, 4", "mean_slip_sec")
def _(fx):
    return corridors.corridor_segments(membership(fx), segments(fx))


@query("X14_schedule_audit", SLIP + f" SELECT {SEG}, mean_slip_sec, n_obs, mean_slip_sec * (n_obs / 30.0::DOUBLE) / 60 AS minutes_per_day FROM seg WHERE period = 'all' AND mean_slip_sec > 0 ORDER BY abs(mean_slip_sec * (n_obs / 30.0::DOUBLE) / 60) DESC, route_id, direction_id, from_seq, to_seq LIMIT 500", "mean_slip_sec minutes_per_day")
def _(fx):
    return diagnostics.schedule_audit(segments(fx), sign=1)


@query("X15_diagnostic_profile", CUM + " SELECT c.*, a.stop_name AS from_stop_name, b.stop_name AS to_stop_name FROM cum c LEFT JOIN stops a ON a.stop_id = from_stop LEFT JOIN stops b ON b.stop_id = to_stop", "mean_slip_sec cum_slip_sec")
def _(fx):
    return diagnostics.with_stop_names(diagnostics.cumulative_slip(segments(fx), layover(fx)), fx.stops, "from_stop", "to_stop")


TIMELINE = """, act0 AS (SELECT s.service_date, t.block_id, t.trip_id FROM svc s JOIN fx_trips t ON t.service_id = s.service_id),
 act AS (SELECT service_date, trip_id, true AS is_scheduled FROM act0 UNION ALL SELECT d.service_date, t.trip_id, false FROM dates d CROSS JOIN fx_trips t WHERE NOT EXISTS (SELECT 1 FROM act0 a WHERE a.service_date = d.service_date AND a.block_id = t.block_id)),
 tl AS (SELECT s.service_date, s.is_scheduled, t.block_id, t.trip_id, t.route_id, e.a AS start_sec, e.b AS end_sec, o.origin_dev_sec, o.destination_dev_sec, o.vehicle_id, CASE WHEN origin_dev_sec IS NOT NULL AND destination_dev_sec IS NOT NULL THEN 'complete' WHEN seen > 0 THEN 'partial' ELSE 'not_observed' END AS status
   FROM act s JOIN fx_trips t ON t.trip_id = s.trip_id JOIN (SELECT trip_id, min(arrival_sec) AS a, max(arrival_sec) AS b FROM fx_st GROUP BY 1) e ON e.trip_id = t.trip_id
   LEFT JOIN (SELECT service_date, trip_id, max(CASE WHEN source = 'proximity' THEN origin_dev_sec END) AS origin_dev_sec, max(CASE WHEN source = 'trip_update' THEN destination_dev_sec END) AS destination_dev_sec,
     coalesce(max(CASE WHEN source = 'trip_update' THEN vehicle_id END), max(vehicle_id)) AS vehicle_id, max(stops_observed) AS seen FROM runs GROUP BY 1, 2) o ON o.service_date = s.service_date AND o.trip_id = t.trip_id)"""


def timeline(fx: Fixture):
    return diagnostics.block_timeline(fx.trips, fx.stop_times, fx.runs, services(fx), fx.dates)


@query("X16_block_timeline", TIMELINE + " SELECT * FROM tl")
def _(fx):
    return timeline(fx)


@query("X17_active_blocks", TIMELINE + """ SELECT service_date, block_id, count(*) AS n_trips, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes, min(start_sec) AS first_start_sec, max(greatest(abs(origin_dev_sec), abs(destination_dev_sec))) AS worst_dev_sec,
   max(CASE WHEN status <> 'not_observed' THEN 1 ELSE 0 END) AS any_observed, row_number() OVER (PARTITION BY service_date ORDER BY max(greatest(abs(origin_dev_sec), abs(destination_dev_sec))) DESC NULLS LAST, block_id) AS rank FROM tl WHERE is_scheduled GROUP BY 1, 2""")
def _(fx):
    return diagnostics.active_blocks(timeline(fx))


@query("X17_route_blocks", TIMELINE + " SELECT service_date, route_id, block_id, count(*) AS n_on_route, min(start_sec) AS first_start_sec, (SELECT count(*) FROM tl b WHERE b.service_date = tl.service_date AND b.block_id = tl.block_id AND b.is_scheduled) AS n_trips FROM tl WHERE is_scheduled GROUP BY 1, 2, 3")
def _(fx):
    return diagnostics.route_blocks(timeline(fx))


@query("X18_run_deviations", " SELECT service_date, trip_id, stop_sequence, stop_id, dev AS deviation_sec, rel AS schedule_relationship FROM se WHERE source = 'trip_update'")
def _(fx):
    return diagnostics.run_deviations(fx.runs, fx.stop_times, fx.stop_events)


@query("X19_recent_runs", """, lt AS (SELECT * FROM (SELECT *, max(service_date) OVER (PARTITION BY route_id) AS m FROM runs) WHERE service_date = m QUALIFY row_number() OVER (PARTITION BY route_id, trip_id ORDER BY CASE WHEN source = 'trip_update' THEN 0 ELSE 1 END) = 1)
 SELECT route_id, trip_id, source, service_date, row_number() OVER (PARTITION BY route_id ORDER BY first_obs DESC NULLS LAST, trip_id) AS rank FROM lt QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY first_obs DESC NULLS LAST, trip_id) <= 50""")
def _(fx):
    return diagnostics.recent_runs(fx.runs).select("route_id", "trip_id", "source", "service_date", "rank")


@query("X20_slip_trajectory", SLIP + ", t AS (SELECT route_id, direction_id, obs_hour, to_seq, avg(slip) AS mean_slip_sec, count(*) AS n_obs FROM so GROUP BY 1, 2, 3, 4) SELECT *, sum(mean_slip_sec) OVER (PARTITION BY route_id, direction_id, obs_hour ORDER BY to_seq) AS cum_slip_sec FROM t", "mean_slip_sec cum_slip_sec")
def _(fx):
    return diagnostics.slip_trajectory(fx.stop_events)


@query("X21_route_diagnostics", CUM + TP + " SELECT c.*, EXISTS (SELECT 1 FROM tp WHERE tp.route_id = c.route_id AND tp.stop_id = c.to_stop) AS is_timepoint FROM cum c", "mean_slip_sec cum_slip_sec")
def _(fx):
    return diagnostics.route_diagnostics(fx.stop_events, timepoints_of(fx), layover(fx), min_obs=MIN_OBS)


# --- rollups

_N = ["all_early", "all_on_time", "all_late", "all_n", "origin_on_time", "origin_n", "destination_on_time", "destination_n", "trips_scheduled", "trips_delivered", "s_h", "s_h2", "s_n", "o_h", "o_h2", "o_n", "n_headways", "n_bunched"]
QUALITY = COVER + ", qual AS (SELECT service_date, CASE WHEN coverage >= 0.02 * 0.8::DOUBLE THEN 'complete' ELSE 'partial' END AS data_quality FROM cov)"
OVERLAY = (
    OTP + DELIVERED + HEAD + BUNCH + f""", bun AS (SELECT route_id, service_date, {_RATE} FROM pairs GROUP BY 1, 2),
 ov AS (SELECT route_id, service_date, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in _N)} FROM otp FULL JOIN delivered USING (route_id, service_date) FULL JOIN ewt USING (route_id, service_date) FULL JOIN bun USING (route_id, service_date)),
 part AS (SELECT DATE '2024-01-03' AS service_date),"""
    + " wsum AS (SELECT route_id, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _N) + ", count(DISTINCT service_date) AS n_days FROM ov WHERE service_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND service_date NOT IN (SELECT service_date FROM part) GROUP BY 1)"
)
RATIOS = "CASE WHEN all_n > 0 THEN all_on_time / all_n::DOUBLE * 100 END AS otp_pct, CASE WHEN origin_n > 0 THEN origin_on_time / origin_n::DOUBLE * 100 END AS origin_pct, CASE WHEN destination_n > 0 THEN destination_on_time / destination_n::DOUBLE * 100 END AS destination_pct, CASE WHEN trips_scheduled > 0 THEN trips_delivered / trips_scheduled::DOUBLE END AS delivered_ratio, CASE WHEN o_h > 0 THEN o_h2 / (2 * o_h)::DOUBLE END - CASE WHEN s_h > 0 THEN s_h2 / (2 * s_h)::DOUBLE END AS ewt_sec, CASE WHEN n_headways > 0 THEN n_bunched / n_headways::DOUBLE END AS bunching_rate, CASE WHEN s_n > 0 THEN o_n / s_n::DOUBLE END AS coverage"
WINDOW = OVERLAY + f", win AS (SELECT *, {RATIOS} FROM wsum)"
DAILY = OVERLAY + f", rat AS (SELECT *, {RATIOS}, service_date IN (SELECT service_date FROM part) AS is_partial FROM ov), daily AS (SELECT route_id, service_date, is_partial, o_n, " + ", ".join(f"CASE WHEN NOT is_partial THEN {c} END AS {c}" for c in ("otp_pct", "delivered_ratio", "ewt_sec", "bunching_rate")) + " FROM rat)"
LONG = ", long AS (SELECT route_id, service_date, o_n, unnest(['otp', 'service_delivered', 'ewt', 'bunching']) AS metric, unnest([otp_pct, delivered_ratio, ewt_sec, bunching_rate]) AS value FROM daily)"
RATIO_COLS = "otp_pct origin_pct destination_pct delivered_ratio ewt_sec bunching_rate coverage"


def quality(fx: Fixture):
    return coverage(fx).select("service_date", metrics.coverage_flag(F.col("coverage"), 0.02).alias("data_quality"))


#: definition of the overlay; another one rebuilds the stored table
RECIPE = "1"


def service_cells(fx: Fixture):
    """The timetable's headways by service and cell, stored once."""
    return fx.kept("service_cells", lambda: headways.service_cells(scheduled(fx.stored)))


def overlay_inputs(fx: Fixture, events=None, ran=None) -> dict:
    """What a date of the overlay is made of, each by service_date: events, runs, timetable cells, trips due."""
    at = fx if ran is not None else fx.stored
    events = (at.stop_events if events is None else events).select("service_date", "route_id", "direction_id", "stop_id", "trip_id", "stop_sequence", "observed_arrival_ts", "deviation_sec", "source", "schedule_relationship")
    cells = fx.kept("cells", lambda: headways.scheduled_cells(service_cells(fx), day_services(at), gates=gates(at)), "service_date")
    trips = schedule.scheduled_trips_on_date(fx.trips, services(fx)).select("service_date", "route_id", "trip_id")
    return {"events": events, "runs": at.runs if ran is None else ran, "cells": cells, "trips": trips}


def overlay_rows(x: dict):
    """The overlay of the dates that ``x`` (of ``overlay_inputs``) holds."""
    split = metrics.otp_split(x["events"], x["runs"])
    return rollups.route_metrics_overlay(split, runs.service_delivered(x["runs"], x["trips"]), headways.headway_statistics(x["events"], x["cells"]))


def refresh_overlay(fx: Fixture, inputs: dict | None = None, path: str | None = None, told: dict[str, str] | None = None) -> tuple[DatedTable, upkeep.Refresh]:
    """Bring the stored overlay of the fixture's folder up to date: the build step, apart from all that reads it.

    ``told``: the fingerprints of the runs' table, which cover events and runs.
    """
    if inputs is None:
        inputs, told = overlay_inputs(fx), fx.stored.run_prints()
    table = DatedTable(fx.spark, path or fx.place("overlay"), overlay_rows(inputs).schema)
    return table, upkeep.refresh(table, inputs, overlay_rows, f"{RECIPE} {table.schema.simpleString()}", told and {"events": told, "runs": told})


def overlay(fx: Fixture):
    """The stored daily table that every rollup reads; it is checked against its inputs once for a state of the input files."""
    return fx.once("overlay", lambda: refresh_overlay(fx)[0].read())


def refresh_system(fx: Fixture, rows, ran, path: str | None = None) -> tuple[DatedTable, upkeep.Refresh]:
    """Bring the stored system metrics up to date with the overlay ``rows``, the runs ``ran``, and the coverage of the dates."""
    inputs = {"overlay": rows, "runs": ran.select("service_date").distinct().withColumn("any", F.lit(True)), "quality": quality(fx)}
    bus = schedule.bus_route_filter(fx.routes)
    # a date of coverage without any overlay row has no metrics
    build = lambda x: rollups.system_metrics_daily(x["overlay"], x["runs"], bus, x["quality"])
    table = DatedTable(fx.spark, path or fx.place("system"), build(inputs).schema)
    return table, upkeep.refresh(table, inputs, build, f"{RECIPE} {table.schema.simpleString()}")


def daily_batch(fx: Fixture, events=None, folder: str | None = None) -> dict[str, tuple[DatedTable, upkeep.Refresh]]:
    """Runs, overlay and system metrics, each brought up to date with the one before: a date whose events
    changed goes through all three, and no other date through any.

    ``folder``: where the tables are, if not in the fixture's own place.
    """
    at = lambda name: f"{folder}/{name}" if folder else None
    ran = refresh_runs(fx, events, at("runs"))
    inputs = overlay_inputs(fx, events, ran[0].read())
    over = refresh_overlay(fx, inputs, at("overlay"), ran[0].manifest()["notes"])
    return {"runs": ran, "overlay": over, "system": refresh_system(fx, over[0].read(), ran[0].read(), at("system"))}


def prepare(spark, sf_dir: str) -> dict[str, upkeep.Refresh]:
    """The build step: write or refresh what a deployment stores (stop times, timetable cells, profile, runs, overlay, system metrics), so that queries only read it."""
    fx = Fixture(spark, sf_dir)
    done = daily_batch(fx)
    fx.kept("profile", lambda: service_profile(fx.stored))
    for name, (table, _) in done.items():
        fx.once(name, table.read)
    return {name: what for name, (_, what) in done.items()}


def partial(fx: Fixture):
    return fx.dates.filter("service_date = date'2024-01-03'")


def window(fx: Fixture):
    return rollups.window_metrics(overlay(fx), partial(fx), AS_OF, 7)


def daily(fx: Fixture):
    return rollups.overlay_daily_values(overlay(fx), partial(fx))


def targets(fx: Fixture):
    return config(fx)[1]


@query("R01_route_metrics_overlay", OVERLAY + QUALITY + " SELECT o.*, data_quality FROM ov o LEFT JOIN qual q ON q.service_date = o.service_date")
def _(fx):
    return overlay(fx).join(quality(fx), "service_date", "left").select("route_id", "service_date", *_N, "data_quality")


@query("R01_overlay_upkeep", OVERLAY + " SELECT service_date, count(*) AS n_routes, CAST(sum(all_n) AS BIGINT) AS all_n, service_date = DATE '2024-01-05' AS rewritten FROM ov GROUP BY 1")
def _(fx):  # a date whose events were incomplete at first is the only one that a second refresh writes
    inputs, path = overlay_inputs(fx), scratch_path(fx.spark, "overlay")
    had = inputs["events"].filter("NOT (service_date = date'2024-01-05' AND source = 'proximity')")
    refresh_overlay(fx, {**inputs, "events": had}, path)
    table, done = refresh_overlay(fx, inputs, path)
    rows = table.read().groupBy("service_date").agg(F.count(F.lit(1)).alias("n_routes"), F.sum("all_n").alias("all_n"))
    return rows.withColumn("rewritten", F.col("service_date").cast("string").isin(*done.written))


SYSTEM = SYS_DELIVERED + SYS_EWT + QUALITY + f", so2 AS ({split_sql('se', 'dev', 'otp', 'service_date', chr(39) + 'proximity' + chr(39) + ' = source')}), system AS (SELECT service_date, otp_pct, delivered_ratio, ewt_sec, swt_sec, bunching_rate, data_quality FROM so2 FULL JOIN sd USING (service_date) FULL JOIN sys USING (service_date) LEFT JOIN qual USING (service_date))"


def system(fx: Fixture):
    return fx.once("system", lambda: refresh_system(fx, overlay(fx), fx.stored.runs)[0].read())


@query("R02_system_metrics_daily", SYSTEM + " SELECT * FROM system", "otp_pct delivered_ratio ewt_sec swt_sec bunching_rate")
def _(fx):
    return system(fx)


@query("R03_window_metrics", WINDOW + " SELECT * FROM win", RATIO_COLS)
def _(fx):
    return window(fx)


@query("R04_overlay_daily_values", DAILY + " SELECT * FROM daily", "otp_pct delivered_ratio ewt_sec bunching_rate")
def _(fx):
    return daily(fx)


DELTAS = DAILY + LONG + """, hv AS (SELECT *, CASE WHEN DATE '2024-01-14' - service_date BETWEEN 0 AND 6 THEN 'now' WHEN DATE '2024-01-14' - service_date BETWEEN 7 AND 13 THEN 'before' END AS half FROM long),
 dd AS (SELECT route_id, metric, avg(CASE WHEN half = 'now' THEN value END) AS now, avg(CASE WHEN half = 'before' THEN value END) AS before, count(CASE WHEN half = 'now' THEN value END) AS nn, count(CASE WHEN half = 'before' THEN value END) AS nb,
   coalesce(sum(CASE WHEN half = 'now' THEN o_n END), 0) AS hn, coalesce(sum(CASE WHEN half = 'before' THEN o_n END), 0) AS hb FROM hv WHERE half IS NOT NULL GROUP BY 1, 2),
 deltas AS (SELECT route_id, metric, now, before, CASE WHEN nn >= 3 AND nb >= 3 AND (metric <> 'ewt' OR (hn >= 20 AND hb >= 20)) THEN now - before END AS delta FROM dd)"""


def deltas(fx: Fixture):
    return rollups.period_deltas(daily(fx), AS_OF)


@query("R05_period_deltas", DELTAS + " SELECT * FROM deltas", "now before delta")
def _(fx):
    return deltas(fx)


SCORE = WINDOW + _OW + _PROFILE + _CLASS


def card_sql(values: str, name: str) -> str:
    """SQL of a scorecard over the metrics in ``values``."""
    target = ", ".join(f"max(CASE WHEN metric = '{m}' THEN target END) AS target_{m}" for m in rollups.METRICS)
    delta = ", ".join(f"max(CASE WHEN metric = '{m}' THEN delta END) AS delta_{m}" for m in rollups.METRICS)
    return f""", card_tg AS (SELECT route_id, {target} FROM (SELECT r.route_id, t.metric, coalesce(own, target) AS target FROM routes r CROSS JOIN {TARGET_SQL} LEFT JOIN {OWN_SQL} ON o.route_id = r.route_id AND o.metric = t.metric) GROUP BY 1),
 card_dl AS (SELECT route_id, {delta} FROM deltas GROUP BY 1),
 sc1 AS (SELECT r.route_id, r.route_short_name, frequency_class, r.route_id IN (SELECT route_id FROM {TIER_SQL}) AS is_frequent, w.* EXCLUDE (route_id), card_tg.* EXCLUDE (route_id), card_dl.* EXCLUDE (route_id), greatest(0, least(100, (300 - ewt_sec) / 240 * 100)) AS es
   FROM routes r LEFT JOIN {values} w ON w.route_id = r.route_id LEFT JOIN cls c ON c.route_id = r.route_id LEFT JOIN card_tg ON card_tg.route_id = r.route_id LEFT JOIN card_dl ON card_dl.route_id = r.route_id),
 score AS (SELECT * EXCLUDE (es), CASE WHEN otp_pct IS NOT NULL AND delivered_ratio IS NOT NULL THEN CASE WHEN ewt_sec IS NOT NULL THEN otp_pct * 0.3::DOUBLE + delivered_ratio * 100 * 0.5::DOUBLE + es * 0.2::DOUBLE ELSE otp_pct * 0.4::DOUBLE + delivered_ratio * 100 * 0.6::DOUBLE END END AS score FROM sc1),
 {name} AS (SELECT *, CASE WHEN score IS NULL THEN 'N/A' WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END AS grade FROM score)"""


CARD = SCORE + DELTAS.removeprefix(OVERLAY) + card_sql("win", "graded")
CARD_DOUBLES = RATIO_COLS + " score " + " ".join(f"{x}_{m}" for x in ("target", "delta") for m in rollups.METRICS)


def card_parts(fx: Fixture):
    """What a scorecard joins to its metrics: frequency classes, tiers, targets, deltas."""
    profile = fx.kept("profile", lambda: service_profile(fx.stored))
    return schedule.frequency_class(profile, fx.routes), config(fx)[0], targets(fx), deltas(fx)


def scorecard(fx: Fixture):
    return rollups.scorecard(window(fx), fx.routes, *card_parts(fx))


@query("R06_scorecard", CARD + " SELECT * FROM graded", CARD_DOUBLES)
def _(fx):
    return scorecard(fx)


ANCHOR = """, due AS (SELECT DISTINCT t.route_id FROM fx_trips t JOIN svc s ON s.service_id = t.service_id WHERE s.service_date = (SELECT max(service_date) FROM se)),
 an AS (SELECT r.route_id, CASE WHEN d.route_id IS NOT NULL THEN (SELECT max(service_date) FROM se) ELSE e.m END AS anchor_date FROM routes r LEFT JOIN due d ON d.route_id = r.route_id LEFT JOIN (SELECT route_id, max(service_date) AS m FROM se GROUP BY 1) e ON e.route_id = r.route_id WHERE d.route_id IS NOT NULL OR m IS NOT NULL)"""


def anchors(fx: Fixture):
    return rollups.route_anchor_date(fx.stored.stop_events, schedule.scheduled_trips_on_date(fx.trips, services(fx)), fx.routes)


def excess(fx: Fixture):
    return runs.excess_trip_time(fx.stored.runs)


@query("R07_route_detail", SCORE + DELTAS.removeprefix(OVERLAY) + ANCHOR + EXCESS + ", onday AS (SELECT rat.* EXCLUDE (service_date, is_partial) FROM rat JOIN an ON an.route_id = rat.route_id AND an.anchor_date = rat.service_date)" + card_sql("onday", "graded") + f""",
 lx AS (SELECT route_id, service_date AS excess_date, n_trips, median_excess_sec, p95_excess_sec, pct_over FROM excess WHERE n_trips > 0 AND service_date <= DATE '{AS_OF}' AND service_date > DATE '{AS_OF}' - 7 QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY service_date DESC) = 1)
 SELECT g.*, anchor_date, lx.* EXCLUDE (route_id) FROM graded g LEFT JOIN an ON an.route_id = g.route_id LEFT JOIN lx ON lx.route_id = g.route_id""", CARD_DOUBLES + " pct_over")
def _(fx):  # every route's detail; one route is a filter in front
    return rollups.route_detail(overlay(fx), anchors(fx), runs.latest_nonempty_excess(excess(fx), AS_OF), fx.routes, *card_parts(fx))


@query("R08_anchor_date", ANCHOR + """ SELECT 'all' AS kind, NULL AS route_id, max(service_date) AS anchor_date FROM se UNION ALL SELECT CASE dayofweek(service_date) WHEN 6 THEN 'saturday' WHEN 0 THEN 'sunday' ELSE 'weekday' END, NULL, max(service_date) FROM se GROUP BY 1
 UNION ALL SELECT 'seen', route_id, max(service_date) FROM se GROUP BY 2 UNION ALL SELECT 'route', route_id, anchor_date FROM an""")
def _(fx):
    events, none = fx.stored.stop_events, F.lit(None).cast("string")
    out = rollups.anchor_date_by_day_type(events).select(F.col("day_type").alias("kind"), none.alias("route_id"), "anchor_date")
    out = out.unionByName(rollups.anchor_date(events, "route_id").withColumn("kind", F.lit("seen")))
    return out.unionByName(anchors(fx).withColumn("kind", F.lit("route")))


@query("R09_route_trend", DAILY + EXCESS + """, rundays AS (SELECT DISTINCT route_id, service_date FROM runs), tr AS (SELECT coalesce(rat.route_id, x.route_id) AS route_id, coalesce(rat.service_date, x.service_date) AS service_date, otp_pct, CASE WHEN trips_delivered > 0 OR rundays.route_id IS NOT NULL THEN delivered_ratio END AS delivered_ratio, pct_over
   FROM rat LEFT JOIN rundays ON rundays.route_id = rat.route_id AND rundays.service_date = rat.service_date FULL JOIN (SELECT * FROM excess WHERE n_trips > 0) x ON x.route_id = rat.route_id AND x.service_date = rat.service_date)
 SELECT r.route_id, d.service_date, CASE WHEN wd THEN otp_pct END AS otp_pct, CASE WHEN wd THEN delivered_ratio END AS delivered_ratio, CASE WHEN wd THEN pct_over END AS excess_trip_time_pct FROM routes r CROSS JOIN (SELECT service_date, dayofweek(service_date) BETWEEN 1 AND 5 AS wd FROM dates) d LEFT JOIN tr y ON y.route_id = r.route_id AND y.service_date = d.service_date""", "otp_pct delivered_ratio excess_trip_time_pct")
def _(fx):
    return rollups.route_trend(overlay(fx), fx.stored.runs, excess(fx), fx.dates, fx.routes, day_types=("weekday",))


SYS_LONG = SYSTEM + ", syl AS (SELECT service_date, data_quality, unnest(['otp', 'service_delivered', 'ewt', 'bunching']) AS metric, unnest([otp_pct, delivered_ratio, ewt_sec, bunching_rate]) AS value FROM system)"


@query("R10_system_trend", SYS_LONG + f""", pm AS (SELECT metric, avg(value) AS prior_mean FROM syl WHERE service_date BETWEEN DATE '2024-01-04' AND DATE '2024-01-08' AND coalesce(data_quality, '') <> 'partial' GROUP BY 1)
 SELECT t.metric, d.service_date, value, data_quality, prior_mean, target FROM dates d CROSS JOIN {TARGET_SQL} LEFT JOIN syl s ON s.service_date = d.service_date AND s.metric = t.metric LEFT JOIN pm ON pm.metric = t.metric WHERE d.service_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-14'""", "value prior_mean target")
def _(fx):
    return rollups.system_trend(system(fx), fx.dates, targets(fx), AS_OF, 5)


@query("R11_contributors", DAILY + WINDOW_TRIPS + f""", wn AS (SELECT *, {RATIOS} FROM wsum), bl AS (SELECT route_id, avg(otp_pct) AS b FROM daily WHERE NOT is_partial GROUP BY 1),
 ct AS (SELECT w.route_id, w.otp_pct AS value, b AS baseline, CASE w.route_id WHEN 'R1' THEN 80.0::DOUBLE END AS target, trips_in_window FROM wn w LEFT JOIN bl ON bl.route_id = w.route_id JOIN tw ON tw.route_id = w.route_id),
 c2 AS (SELECT *, coalesce(target, baseline) - value AS gap, (coalesce(target, baseline) - value) * trips_in_window AS contribution FROM ct)
 SELECT *, row_number() OVER (ORDER BY round(contribution, 9) DESC, route_id) AS rank FROM c2 WHERE contribution IS NOT NULL""", "value baseline target gap contribution")
def _(fx):
    own = targets(fx).filter("route_id IS NOT NULL")
    return rollups.contributors(window(fx), rollups.baseline_mean(daily(fx)), own, schedule.scheduled_trips_in_window(fx.trips, fx.calendar, fx.dates))


def _agency(route):
    return F.when(F.substring(route, 2, 9).cast("int") % 2 == 0, "even").otherwise("odd")


def agencies(fx: Fixture):
    """Two agencies: the routes of even and of odd number, averaged per date; one lags two days."""
    flags = partial(fx).select("service_date", F.lit(True).alias("is_partial"))
    rows = rollups.with_ratios(overlay(fx)).join(flags, "service_date", "left").withColumn("agency", _agency("route_id")).filter((F.col("agency") == "even") | (F.col("service_date") <= F.lit("2024-01-12").cast("date")))
    return rows.groupBy("agency", "service_date").agg(F.coalesce(F.max("is_partial"), F.lit(False)).alias("is_partial"), *[F.avg(c).alias(c) for c, _ in rollups.METRICS.values()])


LEVEL = """, hl AS (SELECT *, CASE CAST(substr(route_id, 2) AS INT) % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS agency FROM sched_hw WHERE hour >= 7 AND hour < 19),
 hb AS (SELECT route_id, direction_id, stop_id FROM (SELECT route_id, direction_id, stop_id, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, stop_id DESC) AS nth FROM hl GROUP BY 1, 2, 3) WHERE nth = 1),
 lvl AS (SELECT agency, count(*) AS n_gaps, quantile_cont(h_sec, 0.5) AS median_headway_sec, avg(CASE WHEN h_sec <= 900 THEN 1 ELSE 0 END) AS frequent_share FROM hl JOIN hb ON hb.route_id = hl.route_id AND hb.direction_id = hl.direction_id AND hb.stop_id = hl.stop_id GROUP BY 1)"""


@query("R12_agency_comparison", DAILY + LEVEL + """, ag AS (SELECT CASE CAST(substr(route_id, 2) AS INT) % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS agency, service_date, bool_or(is_partial) AS is_partial, avg(otp_pct) AS a, avg(delivered_ratio) AS b, avg(ewt_sec) AS c, avg(bunching_rate) AS d FROM rat
   WHERE CAST(substr(route_id, 2) AS INT) % 2 = 0 OR service_date <= DATE '2024-01-12' GROUP BY 1, 2),
 al AS (SELECT agency, service_date, is_partial, unnest(['otp', 'service_delivered', 'ewt', 'bunching']) AS metric, unnest([a, b, c, d]) AS value FROM ag),
 ae AS (SELECT min(m) AS e FROM (SELECT max(service_date) AS m FROM ag GROUP BY agency)), aw AS (SELECT al.*, e, e - service_date AS age FROM al CROSS JOIN ae WHERE service_date <= e),
 am AS (SELECT agency, metric, avg(value) AS mean, count(value) AS days_included, count(CASE WHEN is_partial THEN value END) AS partial_days,
   CASE WHEN max(e) - 13 >= DATE '2023-12-30' THEN avg(CASE WHEN age BETWEEN 0 AND 6 THEN value END) - avg(CASE WHEN age BETWEEN 7 AND 13 THEN value END) END AS wow_delta FROM aw GROUP BY 1, 2)
 SELECT am.*, lvl.* EXCLUDE (agency) FROM am LEFT JOIN lvl ON lvl.agency = am.agency""", "mean wow_delta median_headway_sec frequent_share")
def _(fx):
    level = schedule.service_level_stats(scheduled(fx.stored).withColumn("agency", _agency("route_id")), "agency")
    return rollups.agency_comparison(agencies(fx), "2023-12-30", level)


@query("R13_period_drilldown", EWT + BUNCH + ANCHOR + f""", ep AS (SELECT route_id, service_date, {ewt_period_sql('hour')} AS period, {_SUM} FROM ec GROUP BY 1, 2, 3),
 sp AS (SELECT DISTINCT route_id, service_date, p.period FROM ep, (VALUES ('AM Peak (6-9)'), ('Midday (9-15)'), ('PM Peak (15-19)'), ('Evening (19-24)'), ('Night (0-6)')) p(period)),
 x AS (SELECT sp.*, coalesce(s_h, 0) AS s_h, coalesce(s_h2, 0) AS s_h2, coalesce(s_n, 0) AS s_n, coalesce(o_h, 0) AS o_h, coalesce(o_h2, 0) AS o_h2, coalesce(o_n, 0) AS o_n FROM sp LEFT JOIN ep USING (route_id, service_date, period)),
 pe AS (SELECT route_id, service_date, period, s_n, o_n, {_AWT} AS awt_sec, {_SWT} AS swt_sec, CASE WHEN o_h > 0 AND s_h > 0 THEN greatest({_AWT} - {_SWT}, 0) END AS ewt_sec, CASE WHEN s_n > 0 THEN least(1, o_n / s_n::DOUBLE) END AS coverage FROM x),
 pb AS (SELECT route_id, service_date, {ewt_period_sql('hour')} AS period, {_RATE} FROM pairs GROUP BY 1, 2, 3)
 SELECT d.* FROM (SELECT * FROM pe FULL JOIN pb USING (route_id, service_date, period)) d JOIN an ON an.route_id = d.route_id AND an.anchor_date = d.service_date""", "awt_sec swt_sec ewt_sec coverage bunching_rate")
def _(fx):
    at, cells = fx.stored, service_cells(fx)
    pairs = headways.bunching_pairs(headways.observed_headways(at.stop_events, scheduled_only=True), cells, day_services(at))
    return rollups.period_drilldown(headways.ewt_by_period(observed(at), cells, day_services(at), gates=gates(at)), headways.bunching_by_period(pairs), anchors(fx))


@query("R14_rolling_mean_7d", DAILY + " SELECT route_id, service_date, avg(CASE WHEN NOT is_partial THEN otp_pct END) OVER (PARTITION BY route_id ORDER BY service_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean FROM daily", "rolling_mean")
def _(fx):
    return rollups.rolling_mean_7d(daily(fx), "otp_pct", "route_id").select("route_id", "service_date", "rolling_mean")


@query("R15_window_delta", DAILY + """, ok AS (SELECT route_id, otp_pct, (row_number() OVER (PARTITION BY route_id ORDER BY service_date DESC) - 1) // 7 AS half FROM daily WHERE NOT is_partial AND otp_pct IS NOT NULL),
 x AS (SELECT route_id, avg(CASE half WHEN 0 THEN otp_pct END) AS now, avg(CASE half WHEN 1 THEN otp_pct END) AS before, count(CASE half WHEN 0 THEN 1 END) AS n_now, count(CASE half WHEN 1 THEN 1 END) AS n_before FROM ok WHERE half < 2 GROUP BY 1)
 SELECT *, CASE WHEN n_now >= 3 AND n_before >= 3 THEN now - before END AS delta FROM x""", "now before delta")
def _(fx):
    return rollups.window_delta(daily(fx), "otp_pct", "route_id")


@query("R15_system_delta", DAILY + " SELECT avg(otp_pct) AS mean, count(otp_pct) AS n, CASE WHEN count(otp_pct) >= 10 THEN avg(otp_pct) - 50 END AS delta FROM daily WHERE NOT is_partial", "mean delta")
def _(fx):
    return rollups.system_delta(daily(fx), "otp_pct", F.lit(50.0))


@query("R16_movers", DELTAS + """, mv AS (SELECT route_id, metric, delta, CASE WHEN delta * CASE WHEN metric IN ('ewt', 'bunching') THEN -1 ELSE 1 END > 0 THEN 'up' ELSE 'down' END AS way FROM deltas WHERE abs(delta) > CASE metric WHEN 'otp' THEN 0.5 WHEN 'ewt' THEN 10 ELSE 0.005 END)
 SELECT *, row_number() OVER (PARTITION BY metric, way ORDER BY abs(round(delta, 9)) DESC, route_id) AS rank FROM mv QUALIFY row_number() OVER (PARTITION BY metric, way ORDER BY abs(round(delta, 9)) DESC, route_id) <= 5""", "delta")
def _(fx):
    return rollups.movers(deltas(fx).withColumn("delta", F.round("delta", 9)))


AGAINST = WINDOW + f""", ag AS (SELECT w.route_id, m.metric, CASE m.metric WHEN 'otp' THEN otp_pct WHEN 'service_delivered' THEN delivered_ratio WHEN 'ewt' THEN ewt_sec ELSE bunching_rate END AS value, coalesce(o.own, m.target) AS target, m.lower
   FROM win w CROSS JOIN (SELECT * FROM {TARGET_SQL}) m LEFT JOIN {OWN_SQL} ON o.route_id = w.route_id AND o.metric = m.metric)"""


@query("R17_routes_below_target", AGAINST + ", b AS (SELECT route_id, max(CASE WHEN (lower AND value > target) OR (NOT lower AND value < target) THEN 1 ELSE 0 END) AS below FROM ag WHERE value IS NOT NULL GROUP BY 1) SELECT CAST(sum(below) AS BIGINT) AS n_below, count(*) AS n_evaluated FROM b")
def _(fx):
    return rollups.routes_below_target(window(fx), targets(fx))


@query("R18_latest_nonnull", DAILY + " SELECT route_id, max_by(otp_pct, service_date) AS otp_pct, max(service_date) AS service_date FROM daily WHERE otp_pct IS NOT NULL GROUP BY 1", "otp_pct")
def _(fx):
    return rollups.latest_nonnull(daily(fx), "otp_pct", "route_id")


@query("R19_weekly_summary", SYSTEM + """, sl AS (SELECT DATE '2024-01-14' - service_date AS age, unnest(['otp', 'service_delivered', 'ewt', 'bunching']) AS metric, unnest([otp_pct, delivered_ratio, ewt_sec, bunching_rate]) AS value FROM system),
 w AS (SELECT metric, avg(CASE WHEN age BETWEEN 0 AND 6 THEN value END) AS current, avg(CASE WHEN age BETWEEN 7 AND 13 THEN value END) AS prior FROM sl GROUP BY 1) SELECT *, CASE WHEN prior <> 0 THEN (current - prior) / prior * 100 END AS pct_change FROM w""", "current prior pct_change")
def _(fx):
    return rollups.weekly_summary(system(fx), AS_OF)


@query("R20_catch_up_dates", " SELECT d AS service_date FROM (SELECT DATE '2023-12-25' + CAST(n AS INT) AS d FROM range(21) t(n)) WHERE d NOT IN (SELECT service_date FROM runs) UNION SELECT DATE '2024-01-13'")
def _(fx):
    from fleetline.functions.clock import date_spine

    return rollups.catch_up_dates(date_spine(fx.spark, "2023-12-25", AS_OF), fx.runs, AS_OF)


@query("R20_daily_batch", """, k AS (SELECT unnest(['runs', 'overlay', 'system']) AS stage) SELECT stage, service_date, service_date = DATE '2024-01-11' AS rewritten FROM k, (SELECT DISTINCT service_date FROM runs)""")
def _(fx):  # a day's late rows arrive: what the batch then writes, table by table
    folder, day = scratch_path(fx.spark, "batch"), "service_date = date'2024-01-11'"
    daily_batch(fx, fx.stop_events.filter(f"NOT ({day} AND stop_sequence > 1)"), folder)
    done = daily_batch(fx, fx.stop_events, folder)
    rows = [(name, d, d in what.written) for name, (_, what) in done.items() for d in (*what.written, *what.same)]
    seen = fx.stored.runs.select("service_date").distinct()
    return fx.spark.createDataFrame(rows, "stage string, d string, rewritten boolean").select("stage", F.to_date("d").alias("service_date"), "rewritten").join(seen, "service_date", "left_semi").select("stage", "service_date", "rewritten")


@query("R21_gtfs_freshness", " SELECT 3 AS snapshot_id, max(service_date) AS feed_end_date, TIMESTAMP '2024-01-03' AS loaded_at, CASE WHEN max(service_date) < DATE '2024-01-14' THEN 'expired' ELSE 'expiring_soon' END AS status FROM se")
def _(fx):
    end = fx.stop_events.agg(F.max("service_date").alias("feed_end_date"))
    snaps = end.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("snapshot_id"), "feed_end_date").withColumn("loaded_at", F.to_timestamp_ntz(F.concat(F.lit("2024-01-0"), F.col("snapshot_id").cast("string"))))
    return rollups.gtfs_freshness(snaps, AS_OF)


@query("R21_ingest_freshness", " SELECT CAST(sum(CASE WHEN ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 5 MINUTE AND ts <= TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS n_recent, max(ts) AS latest_ts FROM pos")
def _(fx):
    return rollups.ingest_freshness(fx.positions, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query("R22_metrics_on_date", OVERLAY + f" SELECT *, {RATIOS} FROM ov WHERE service_date = DATE '2024-01-09'", RATIO_COLS)
def _(fx):
    return rollups.metrics_on_date(overlay(fx), "2024-01-09")


@query("R23_targets_table", AGAINST + " SELECT route_id, metric, value, target, CASE WHEN lower THEN value - target ELSE target - value END AS gap FROM ag", "value target gap")
def _(fx):
    return rollups.targets_table(window(fx), targets(fx))


@query("B13_ewt_score_route_grade", CARD + " SELECT route_id, score, grade FROM graded", "score")
def _(fx):
    return scorecard(fx).select("route_id", "score", "grade")


@query("B16_target_attainment", AGAINST + ", s AS (SELECT route_id, metric, CASE WHEN lower THEN CASE WHEN value > 0 THEN target / value WHEN value IS NOT NULL THEN 1 END ELSE value / target END AS s FROM ag) SELECT route_id, metric, CASE WHEN s IS NOT NULL THEN greatest(0, least(100, s * 100)) END AS attainment_pct, CASE WHEN s >= 1 THEN 'met' WHEN s >= 0.9 THEN 'near' WHEN s IS NOT NULL THEN 'missed' END AS band FROM s", "attainment_pct")
def _(fx):
    return rollups.target_attainment(window(fx), targets(fx))


@query("B17_worst_metric", AGAINST + ", g AS (SELECT route_id, metric, CASE WHEN lower THEN value - target ELSE target - value END / abs(target) AS g FROM ag) SELECT route_id, max_by(metric, {'g': g, 'm': metric}) AS worst_metric, max(g) AS gap_fraction FROM g WHERE g IS NOT NULL GROUP BY 1", "gap_fraction")
def _(fx):
    return rollups.worst_metric(window(fx), targets(fx))


@query("B19_profile_hash", SLIP + """, j AS (SELECT route_id, period, concat('{"direction_id":', direction_id, ',"from_seq":', from_seq, ',"from_stop":"', from_stop, '","n_obs":', n_obs, ',"slip":', CAST(round(mean_slip_sec * 10) AS BIGINT), ',"to_seq":', to_seq, ',"to_stop":"', to_stop, '"}') AS j FROM seg)
 SELECT route_id, period, sha256(CAST(to_json(list_sort(list(j))) AS VARCHAR)) AS profile_hash FROM j GROUP BY 1, 2""")
def _(fx):  # slips in tenths of a second
    rows = segments(fx).withColumn("slip", F.round(F.col("mean_slip_sec") * 10).cast("long")).drop("mean_slip_sec")
    return rollups.profile_hash(rows, "route_id", "period")


# --- folds that streams share


@query("T02_poll_dedupe", " SELECT snapshot_ts, line_no, trip_id, stop_sequence, service_date FROM tu QUALIFY row_number() OVER (PARTITION BY snapshot_ts, trip_id, stop_sequence, service_date ORDER BY line_no DESC) = 1")
def _(fx):
    return updates.poll_dedupe(fx.trip_updates).select("snapshot_ts", "line_no", "trip_id", "stop_sequence", "service_date")


FOLD_COLS = "trip_id, stop_sequence, service_date, stop_id, vehicle_id, final_snapshot_ts, final_rel AS final_schedule_relationship, pred_ts AS last_pred_snapshot_ts, pred AS last_predicted_arrival_ts, vehicle_ts AS last_vehicle_ts"


@query("T03_trip_update_state_fold", FOLD + f" SELECT {FOLD_COLS} FROM fold")
def _(fx):
    return updates.trip_update_state_fold(fx.trip_updates)


@query("T04_replay_date", FOLD.replace("FROM tu)", "FROM tu WHERE service_date = DATE '2024-01-09' AND CAST(snapshot_ts AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-10')") + f" SELECT {FOLD_COLS} FROM fold")
def _(fx):
    return updates.replay_date(fx.trip_updates, "2024-01-09")


def _arriving(df, name: str):
    """A folder of files that a stream reads."""
    path = scratch_path(df.sparkSession, name)
    df.repartition(3, *df.columns[:1]).write.parquet(path)
    return path


#: files of a step of arrival, which a stream takes in one batch
STEP_FILES = 2


def _in_steps(fx: Fixture, steps, name: str):
    """A stream of Parquet files that arrive in steps: one DataFrame each, in this order."""
    path = scratch_path(fx.spark, name)
    for df in steps:
        df.repartition(STEP_FILES).write.mode("append").parquet(path)
    return fx.spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", STEP_FILES).parquet(path)


def _by_days(df, ts: str, cuts, order=None):
    """``df`` cut into stretches of days since 2024-01-01, in the order given."""
    day = F.datediff(F.col(ts), F.lit("2024-01-01").cast("date"))
    edges = [-(10**6), *cuts, 10**6]
    parts = [df.filter((day >= a) & (day < b)) for a, b in zip(edges, edges[1:])]
    return [parts[i] for i in (order or range(len(parts)))]


def _land(stream, fx: Fixture, name: str):
    """Run an append stream to its end; the rows it wrote, and the query."""
    out = scratch_path(fx.spark, name)
    run = stream.writeStream.option("checkpointLocation", scratch_path(fx.spark, "checkpoint")).trigger(availableNow=True).start(out, format="parquet")
    run.awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(out), run


@query("T02_poll_dedupe_stream", " SELECT snapshot_ts, line_no, trip_id, stop_sequence, service_date FROM tu QUALIFY row_number() OVER (PARTITION BY snapshot_ts, trip_id, stop_sequence, service_date ORDER BY line_no DESC) = 1")
def _(fx):  # repeats inside the watermark and behind it: neither is let through
    first, middle, last = _by_days(fx.trip_updates, "snapshot_ts", (5, 10))
    steps = [first, middle.unionByName(middle.filter("line_no % 5 = 0")), middle.filter("line_no % 3 = 0").unionByName(last), first.filter("line_no % 7 = 0")]
    rows, _ = _land(updates.first_delivery(_in_steps(fx, steps, "polls"), "2 days"), fx, "delivered")
    return updates.poll_dedupe(rows.drop("service_date", "event_time")).select("snapshot_ts", "line_no", "trip_id", "stop_sequence", "service_date")


@query("T05_minute_coverage", " SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM pos GROUP BY 1")
def _(fx):
    return updates.minute_coverage(fx.positions)


@query("T05_coverage_from_stream", COVER + " SELECT * FROM cov", "coverage")
def _(fx):  # the stream's closed minutes are what E28 counts; a mark from later closes the last of them
    seen = fx.positions.select("timestamp").union(fx.heartbeats.select("ts"))
    mark = fx.spark.range(1).select(F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("timestamp"))
    stream = _in_steps(fx, [*_by_days(seen, "timestamp", (4, 8)), mark], "seen")
    out = scratch_path(fx.spark, "minutes")
    updates.closed_minutes(stream, out, scratch_path(fx.spark, "checkpoint")).awaitTermination()
    minutes = fx.spark.read.schema("minute timestamp_ntz, n long").parquet(out)
    return metrics.ingest_coverage(minutes.select(F.col("minute").alias("ts")), minutes.limit(0).select(F.col("minute").alias("timestamp")), fx.dates)


@query("T07_late_position_window", " SELECT id FROM pos WHERE ts >= CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR")
def _(fx):
    return updates.within_service_window(fx.positions, F.to_date("timestamp")).select("id")


@query("T07_window_counts_stream", """, w AS (SELECT ts, CAST(ts AS DATE) - CAST(id % 4 AS INT) AS d FROM pos), k AS (SELECT unnest(['kept', 'late', 'phantom', 'undated']) AS kind)
 SELECT kind, CAST(coalesce((SELECT count(*) FROM w WHERE CASE kind WHEN 'kept' THEN ts >= CAST(d AS TIMESTAMP) + INTERVAL 5 HOUR AND ts < CAST(d + 2 AS TIMESTAMP) + INTERVAL 5 HOUR WHEN 'late' THEN ts >= CAST(d + 2 AS TIMESTAMP) + INTERVAL 5 HOUR
   WHEN 'phantom' THEN ts < CAST(d AS TIMESTAMP) + INTERVAL 5 HOUR ELSE false END), 0) AS BIGINT) AS n FROM k""")
def _(fx):
    pings = fx.positions.withColumn("service_date", F.date_sub(F.to_date("timestamp"), (F.col("id") % 4).cast("int")))
    stream = updates.within_service_window(_in_steps(fx, _by_days(pings, "timestamp", (4, 9), (1, 0, 2)), "pings"), F.col("service_date"))
    rows, run = _land(stream.select("id"), fx, "kept")
    counts = updates.observed_sums(run, "service_window")
    if rows.count() != counts["n_kept"]:
        raise RuntimeError("the stream's counts aren't those of its rows")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(counts[f"n_{k}"]).cast("long").alias("n")) for k in ("kept", "late", "phantom", "undated")])
    return fx.spark.range(1).select(F.explode(kinds).alias("x")).select("x.kind", "x.n")


@query("T08_live_proximity_arrivals", PROX + " SELECT service_date, trip_id, stop_sequence, stop_id, vehicle_id, ts AS observed_arrival_ts, CAST(deviation_sec AS INT) AS deviation_sec FROM prox_ev QUALIFY row_number() OVER (PARTITION BY service_date, trip_id, stop_sequence ORDER BY ts) = 1")
def _(fx):
    return updates.first_arrivals(proximity_events(fx)).select("service_date", "trip_id", "stop_sequence", "stop_id", "vehicle_id", "observed_arrival_ts", "deviation_sec")


@query("T08_live_arrivals_stream", PROX + " SELECT service_date, trip_id, route_id, direction_id, vehicle_id, stop_id, stop_sequence, CAST(deviation_sec AS INT) AS deviation_sec, match_distance_m FROM prox_ev", "match_distance_m")
def _(fx):  # seven files, each second one before its predecessor
    pings = fx.positions.select("id", "vehicle_id", "trip_id", "route_id", "latitude", "longitude", "timestamp", F.to_date("timestamp").alias("service_date"))
    stream = _in_steps(fx, _by_days(pings, "timestamp", (2, 4, 6, 8, 10, 12), (1, 0, 3, 2, 5, 4, 6)), "pings")
    out = scratch_path(fx.spark, "arrivals")
    timetable = live.index_timetable(fx.trips, fx.stop_times, route_stops(fx))
    live.store_arrivals(live.live_arrivals(stream, timetable, delay="5 days"), out, scratch_path(fx.spark, "checkpoint")).awaitTermination()
    return live.stored_arrivals(fx.spark, out).select("service_date", "trip_id", "route_id", "direction_id", "vehicle_id", "stop_id", "stop_sequence", "deviation_sec", "match_distance_m")


@query("T01_tu_stream", " SELECT date_trunc('minute', snapshot_ts) AS snapshot_ts, trip_id, vehicle_id, stop_id, stop_sequence, rel AS schedule_relationship, date_trunc('second', pred) AS predicted_arrival_ts, CAST(1 AS BIGINT) AS n_quarantined FROM tu WHERE line_no % 11 <> 0")
def _(fx):  # a poll a minute as JSON, one line cut short, some updates without a stop
    sec = F.unix_timestamp(F.col("predicted_arrival_ts").cast("timestamp"))
    update = F.struct("stop_sequence", F.when(F.col("line_no") % 11 != 0, F.col("stop_id")).alias("stop_id"), F.struct(sec.alias("time")).alias("arrival"), "schedule_relationship")
    entity = F.struct(F.struct(F.struct("trip_id", F.col("trip_start_date").alias("start_date")).alias("trip"), F.struct(F.coalesce("vehicle_id", F.lit("")).alias("id")).alias("vehicle"), F.array(update).alias("stop_time_update")).alias("trip_update"))
    at = F.unix_timestamp(F.date_trunc("minute", "snapshot_ts").cast("timestamp"))
    polls = fx.trip_updates.groupBy(at.alias("at")).agg(F.collect_list(entity).alias("entity"))
    lines = polls.select(F.to_json(F.struct(F.struct(F.col("at").alias("timestamp")).alias("header"), "entity")).alias("value"))
    folder, out, bad = scratch_path(fx.spark, "polls"), scratch_path(fx.spark, "updates"), scratch_path(fx.spark, "quarantine")
    lines.unionByName(fx.spark.range(1).select(F.lit('{"header": {"timestamp": 17').alias("value"))).repartition(3).write.text(folder)
    updates.ingest_polls(updates.poll_stream(fx.spark, folder), out, bad, scratch_path(fx.spark, "checkpoint")).awaitTermination()
    rows = fx.spark.read.parquet(out).crossJoin(fx.spark.read.text(bad).agg(F.count(F.lit(1)).alias("n_quarantined")))
    return rows.select("snapshot_ts", "trip_id", "vehicle_id", "stop_id", "stop_sequence", "schedule_relationship", "predicted_arrival_ts", "n_quarantined")


@query("T01_vp_stream", " SELECT vehicle_id, trip_id, route_id, date_trunc('second', ts) AS timestamp, lat AS latitude, lon AS longitude FROM pos", "latitude longitude")
def _(fx):
    raw = fx.positions.select("vehicle_id", "trip_id", "route_id", "latitude", "longitude", "current_status", F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("timestamp"))
    out = scratch_path(fx.spark, "pings")
    stream = updates.position_stream(fx.spark, _arriving(raw, "raw"))
    stream.writeStream.option("checkpointLocation", scratch_path(fx.spark, "checkpoint")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(out).select("vehicle_id", "trip_id", "route_id", "timestamp", "latitude", "longitude")


@query("T06_archive_stream", " SELECT id, vehicle_id, CAST(ts AS DATE) AS date FROM pos")
def _(fx):
    rows = fx.positions
    stream = fx.spark.readStream.schema(rows.schema).parquet(_arriving(rows, "raw"))
    out = scratch_path(fx.spark, "archive")
    updates.archive_stream(stream, out, scratch_path(fx.spark, "checkpoint")).awaitTermination()
    return fx.spark.read.schema("id long, vehicle_id string, date date").parquet(out)

"""Pings and trip updates to stop events; matching of pings to trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions import clock, geo
from fleetline.operators import matching
from fleetline.operators.runs import exact_seconds_between, seconds_between
from fleetline.operators.schedule import stop_seconds

#: a prior-day anchor of an unobserved stop must lie within this many seconds
PROXY_GUARD = 10_800


def positions_for_service_date(positions: DataFrame, dates: DataFrame, tz: str = clock.TZ) -> DataFrame:
    """Pings labelled with a service date that lie in [midnight, midnight + 2 days) of it."""
    a, _, c = clock.local_day_bounds(F.col("service_date"), tz)
    bounds = dates.select("service_date", a.alias("lo"), c.alias("hi"))
    rows = positions.withColumn("service_date", clock.parse_service_date(F.col("trip_start_date")))
    return rows.join(bounds, "service_date").filter((F.col("timestamp") >= F.col("lo")) & (F.col("timestamp") < F.col("hi"))).drop("lo", "hi")


def nearest_stop_within(positions: DataFrame, route_stops: DataFrame, *, max_m: float = 50.0) -> DataFrame:
    """Pings with the nearest stop of their route within max_m: stop_id, dist_m.

    An equi join on route and grid cell (a stop stands in the 3 x 3 cells around it, so a ping stays one row), so a ping meets
    only stops around it, however many a route has.  Cells are max_m high, and wide enough
    for the stops' largest latitude, which one aggregate finds.  Ties go to the smaller stop id.
    """
    dy = max_m / geo.DEGREE_M
    limits = F.broadcast(route_stops.agg(F.max(F.abs("stop_lat")).alias("m")))
    dx = geo.cell_width(F.col("m"), max_m)
    stops = route_stops.crossJoin(limits).select("route_id", F.col("stop_id").alias("s_id"), F.col("stop_lat").alias("s_lat"), F.col("stop_lon").alias("s_lon"), F.explode(geo.neighbour_cells(F.col("stop_lat"), F.col("stop_lon"), dy, dx)).alias("c")).select("route_id", "s_id", "s_lat", "s_lon", "c.cy", "c.cx")
    near = positions.select("id", "route_id", "latitude", "longitude").crossJoin(limits).select("id", "route_id", "latitude", "longitude", geo.grid_cell(F.col("latitude"), dy).alias("cy"), geo.grid_cell(F.col("longitude"), dx).alias("cx"))
    dist = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))
    hits = near.join(stops, ["route_id", "cy", "cx"]).select("id", "s_id", dist.alias("d")).filter(F.col("d") <= max_m)
    best = hits.groupBy("id").agg(F.min(F.struct("d", "s_id")).alias("best"))
    return positions.join(best, "id").select(*positions.columns, F.col("best.s_id").alias("stop_id"), F.col("best.d").alias("dist_m"))


def resolve_service_anchor(observed: Column, date: Column, secs: Column, *, tz: str = clock.TZ, proxy_guard: bool = False) -> tuple[Column, Column]:
    """(service date, scheduled UTC): the date or the day before, whichever puts the schedule nearer.

    Ties keep the date.  With proxy_guard the day before must be within PROXY_GUARD.
    """
    same = clock.gtfs_time_to_utc(date, secs, tz)
    prior = clock.gtfs_time_to_utc(F.date_sub(date, 1), secs, tz)
    d_same, d_prior = F.abs(exact_seconds_between(same, observed)), F.abs(exact_seconds_between(prior, observed))
    back = d_prior < d_same
    back = back & (d_prior <= PROXY_GUARD) if proxy_guard else back
    return F.when(back, F.date_sub(date, 1)).otherwise(date), F.when(back, prior).otherwise(same)


def resolve_stop_time(pings: DataFrame, stop_times: DataFrame, *, tz: str = clock.TZ) -> DataFrame:
    """Pings (id, trip_id, stop_id, service_date, timestamp) with the visit of their trip at that stop.

    A loop visits a stop more than once: the visit scheduled nearest to the ping on the
    date or the day before is taken, ties to the earlier visit.
    """
    sched = stop_times.select("trip_id", "stop_id", "stop_sequence", clock.gtfs_seconds(F.coalesce("arrival_time", "departure_time")).alias("sched_sec")).filter("sched_sec IS NOT NULL")
    rows = pings.join(sched, ["trip_id", "stop_id"])
    date, ts = resolve_service_anchor(F.col("timestamp"), F.col("service_date"), F.col("sched_sec"), tz=tz)
    rows = rows.withColumns({"anchor_date": date, "scheduled_arrival_ts": ts})
    delta = F.abs(exact_seconds_between(F.col("scheduled_arrival_ts"), F.col("timestamp")))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(delta, "stop_sequence"))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth", "sched_sec")


def derive_stop_events_proximity(positions: DataFrame, trips: DataFrame, stop_times: DataFrame, route_stops: DataFrame, *, tz: str = clock.TZ, max_m: float = 50.0) -> DataFrame:
    """Stop events from pings that carry service_date: the first ping of each (trip, visit) near its stop.

    The nearest stop is sought among all stops of the route; a ping whose trip doesn't
    serve that stop is dropped.
    """
    near = nearest_stop_within(positions, route_stops, max_m=max_m)
    rows = resolve_stop_time(near.select("id", "trip_id", "stop_id", "service_date", "timestamp", "vehicle_id", "dist_m"), stop_times, tz=tz)
    first = F.row_number().over(Window.partitionBy("service_date", "trip_id", "stop_sequence").orderBy("timestamp", "id"))
    rows = rows.withColumn("nth", first).filter("nth = 1").join(trips.select("trip_id", "route_id", "direction_id"), "trip_id")
    return rows.select(
        F.col("anchor_date").alias("service_date"), "trip_id", "route_id", "direction_id", "vehicle_id", "stop_id", "stop_sequence", "scheduled_arrival_ts", F.col("timestamp").alias("observed_arrival_ts"),
        seconds_between(F.col("scheduled_arrival_ts"), F.col("timestamp")).cast("int").alias("deviation_sec"), F.lit("proximity").alias("source"), F.lit("SCHEDULED").alias("schedule_relationship"), F.col("dist_m").alias("match_distance_m"),
    )


def derive_stop_events_trip_update(state: DataFrame, positions: DataFrame, trips: DataFrame, stop_times: DataFrame, *, tz: str = clock.TZ) -> DataFrame:
    """Stop events from last-known states, of trips that sent a position on the date.

    A skipped stop has no observation (its date comes from the final snapshot, guarded);
    rows without prediction or without a scheduled stop are dropped.
    """
    seen = positions.select("service_date", "trip_id").distinct()
    sched = stop_times.select("trip_id", "stop_sequence", F.col("stop_id").alias("sched_stop_id"), clock.gtfs_seconds(F.coalesce("arrival_time", "departure_time")).alias("sched_sec"))
    rows = state.join(seen, ["service_date", "trip_id"], "left_semi").join(sched, ["trip_id", "stop_sequence"])
    skipped = F.col("final_schedule_relationship") == "SKIPPED"
    rows = rows.filter(skipped | F.col("last_predicted_arrival_ts").isNotNull())
    own = resolve_service_anchor(F.col("last_predicted_arrival_ts"), F.col("service_date"), F.col("sched_sec"), tz=tz)
    proxy = resolve_service_anchor(F.col("final_snapshot_ts"), F.col("service_date"), F.col("sched_sec"), tz=tz, proxy_guard=True)
    rows = rows.withColumns({"a_date": F.when(skipped, proxy[0]).otherwise(own[0]), "a_ts": F.when(skipped, proxy[1]).otherwise(own[1]), "obs": F.when(~skipped, F.col("last_predicted_arrival_ts"))})
    return rows.join(trips.select("trip_id", "route_id", "direction_id"), "trip_id").select(
        F.col("a_date").alias("service_date"), "trip_id", "route_id", "direction_id", "vehicle_id", F.coalesce("stop_id", "sched_stop_id").alias("stop_id"), "stop_sequence", F.col("a_ts").alias("scheduled_arrival_ts"),
        F.col("obs").alias("observed_arrival_ts"), seconds_between(F.col("a_ts"), F.col("obs")).cast("int").alias("deviation_sec"), F.lit("trip_update").alias("source"),
        F.col("final_schedule_relationship").alias("schedule_relationship"), F.lit(None).cast("double").alias("match_distance_m"),
    )


EVENT_KEY = ["service_date", "trip_id", "stop_sequence", "source"]


def supersede_shifted_rows(existing: DataFrame, derived: DataFrame) -> DataFrame:
    """Existing events with derived ones put in place of the same visit on the same or the next date."""
    moved = derived.select("trip_id", "stop_sequence", "source", F.explode(F.array("service_date", F.date_add("service_date", 1))).alias("service_date")).distinct()
    return existing.join(moved, EVENT_KEY, "left_anti").unionByName(derived.select(*existing.columns))


def service_dates_written(derived: DataFrame) -> DataFrame:
    return derived.select("service_date").distinct()


def dedupe_stop_passages(passages: DataFrame, *extra: str) -> DataFrame:
    """The last observation per (vehicle, trip, stop, date); ``extra`` columns add to the key."""
    key = ["vehicle_id", "trip_id", "stop_id", "service_date", *extra]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("timestamp"), F.desc("id")))
    return passages.withColumn("nth", nth).filter("nth = 1").drop("nth")


def dedupe_pings(positions: DataFrame) -> DataFrame:
    """One ping per (vehicle, time, place): the one with the smallest id."""
    nth = F.row_number().over(Window.partitionBy("vehicle_id", "timestamp", "latitude", "longitude").orderBy("id"))
    return positions.withColumn("nth", nth).filter("nth = 1").drop("nth")


def sample_every_nth(positions: DataFrame, n: int, key: str = "vehicle_id") -> DataFrame:
    """Every nth ping of a vehicle by time."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("timestamp", "id"))
    return positions.withColumn("nth", nth).filter((F.col("nth") - 1) % n == 0).drop("nth")


def enrich_positions(positions: DataFrame, route_stops: DataFrame, stop_times: DataFrame, *, tz: str = "UTC", max_m: float = 50.0) -> DataFrame:
    """Pings with nearest stop, service_date (date of the ping) and difference from the schedule on that day.

    The trip's first visit of the stop counts.  ``tz`` UTC compares the ping's UTC clock
    with the schedule, the agency's zone its local clock.
    """
    first = stop_times.groupBy("trip_id", "stop_id").agg(F.min_by(stop_seconds(stop_times), "stop_sequence").alias("sched_sec"))
    near = nearest_stop_within(positions, route_stops, max_m=max_m).join(first, ["trip_id", "stop_id"])
    at = clock.to_local(F.col("timestamp"), tz)
    sched = clock.gtfs_time_on_reference_day(at, F.col("sched_sec"), most_days=1)
    return near.withColumns({"service_date": F.to_date(at), "diff_sec": seconds_between(sched, at)}).drop("sched_sec")


def trace_vehicle_journey(enriched: DataFrame, vehicle_id: str) -> DataFrame:
    return enriched.filter(F.col("vehicle_id") == vehicle_id).select("timestamp", "id", "trip_id", "stop_id", "dist_m", "diff_sec").orderBy("timestamp", "id")


def _scheduled_visits(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Visits of every trip with their place: m_trip, m_route, m_direction, stop_id, stop_sequence, sec."""
    visits = trips.select("trip_id", F.col("route_id").alias("m_route"), F.col("direction_id").alias("m_direction")).join(stop_times.select("trip_id", "stop_id", "stop_sequence", clock.gtfs_seconds(F.col("arrival_time")).alias("sec")), "trip_id")
    return visits.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id").withColumnRenamed("trip_id", "m_trip")


def _timed_pings(positions: DataFrame, tz: str) -> DataFrame:
    """Pings of a route with their seconds since midnight; rt_trip is the trip they report."""
    at = clock.to_local(F.col("timestamp"), tz)
    sec = exact_seconds_between(F.date_trunc("day", at).cast("timestamp_ntz"), at)
    return positions.filter("route_id IS NOT NULL").select("id", "vehicle_id", F.col("trip_id").alias("rt_trip"), "route_id", "timestamp", "latitude", "longitude", sec.alias("ping_sec"))


def _near_visits(rows: DataFrame, max_m: float, early_min: float, late_min: float) -> DataFrame:
    """Pairs of ping and visit within max_m and the time window, with distance and lateness.

    Distances are taken to the micrometre, so that places equally far tie.
    """
    dist = F.round(geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("stop_lat"), F.col("stop_lon")), 6)
    rows = rows.withColumns({"dist_m": dist, "late_sec": F.col("ping_sec") - F.col("sec")})
    return rows.filter((F.col("dist_m") <= max_m) & F.col("late_sec").between(-early_min * 60, late_min * 60))


_PING, _VISIT = ["id", "vehicle_id", "rt_trip", "route_id", "timestamp"], ["stop_id", "stop_sequence", "late_sec", "dist_m"]


def own_trip_matches(positions: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, *, tz: str = "UTC", max_m: float = 500.0, early_min: int = 10, late_min: int = 15) -> DataFrame:
    """Pings whose reported trip fits: its first stop, in order, that is near in place and time.

    Direction and route of the trip aren't compared.  Confidence is the mean of nearness in
    time and in place, without a bonus.
    """
    rows = _timed_pings(positions, tz).join(_scheduled_visits(trips, stop_times, stops), F.col("rt_trip") == F.col("m_trip"))
    first = _near_visits(rows, max_m, early_min, late_min).groupBy(*_PING).agg(F.min(F.struct("stop_sequence", "stop_id", "late_sec", "dist_m")).alias("v"))
    rows = first.select(*_PING, F.col("rt_trip").alias("trip_id"), *[F.col(f"v.{c}").alias(c) for c in _VISIT])
    mean = (F.greatest(F.lit(0.0), 1 - F.abs("late_sec") / 60 / late_min) + (1 - F.col("dist_m") / max_m)) / 2
    return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def best_candidates(positions: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, *, min_confidence: float = 0.3, tz: str = "UTC", max_m: float = 500.0, early_min: int = 5, late_min: int = 15) -> DataFrame:
    """Pings with the most confident trip of their route that passes near in time and place, if above min_confidence; ties go to the smaller trip id.

    Where the reported trip is known, only trips of its direction count; else any does.
    Pings and timetable are cogrouped by route and a bucket of the clock, and each group is
    searched (``matching``), so pairs of ping and trip are never rows.  Trips of one
    timetable stand as their smallest id, so a group's timetable is bounded by its variants and the
    seconds of the clock.  A trip's visits are walked in order; a visit takes over if its
    biased score (early costs more than late) is below the plain score of the one held.
    Confidence adds 0.1 between two minutes early and ten late, and takes 0.1 off when
    earlier; visits of the next day (24:00 and later) count from the ping's own midnight.
    """
    rules, key = matching.Rules(max_m, early_min, late_min, min_confidence), ["route_id", "bucket"]
    bucket = lambda sec: F.floor(sec / ((early_min + late_min) * 60))
    reported = trips.select(F.col("trip_id").alias("rt_trip"), F.col("direction_id").alias("direction"))
    pings = _timed_pings(positions, tz).join(reported, "rt_trip", "left").withColumn("bucket", bucket(F.col("ping_sec")))
    visit = F.struct("stop_sequence", "stop_id", "sec", "stop_lat", "stop_lon")
    whole = _scheduled_visits(trips, stop_times, stops).groupBy("m_trip", F.col("m_route").alias("route_id"), F.col("m_direction").alias("direction")).agg(F.sort_array(F.collect_list(visit)).alias("v"))
    alike = whole.groupBy("route_id", "direction", "v").agg(F.min("m_trip").alias("trip_id"))
    # a bucket's pings reach back by late_min and forward by early_min
    reach = F.sequence(bucket(F.col("v.sec") - early_min * 60), bucket(F.col("v.sec") + late_min * 60))
    visits = alike.select("route_id", "direction", "trip_id", F.explode("v").alias("v")).filter(F.col("v.sec").isNotNull()).select("route_id", "direction", "trip_id", "v.*", F.explode(reach).alias("bucket"))
    asked = pings.select(*key, "id", "ping_sec", "latitude", "longitude", F.col("direction").cast("double").alias("direction"))
    found = asked.groupBy(*key).cogroup(visits.withColumn("direction", F.col("direction").cast("double")).groupBy(*key)).applyInArrow(lambda p, v: matching.match_group(p, v, rules), matching.RESULT)
    return pings.select(*_PING).join(found, "id")


def find_matching_trip(positions: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, *, min_confidence: float = 0.3, tz: str = "UTC", max_m: float = 500.0, late_min: int = 15) -> DataFrame:
    """The trip of each ping: the one it reports where that fits, else the most confident above min_confidence.

    Ties go to the smaller trip id.  Pings without route, or without any match, have no row.
    """
    options = {"tz": tz, "max_m": max_m, "late_min": late_min}
    own = own_trip_matches(positions, trips, stop_times, stops, **options)
    rest = best_candidates(positions.join(own.select("id"), "id", "left_anti"), trips, stop_times, stops, min_confidence=min_confidence, **options)
    return own.unionByName(rest)


def arrivals_of_matches(matches: DataFrame, near: DataFrame, stop_times: DataFrame, *, tz: str = "UTC", min_confidence: float = 0.3) -> DataFrame:
    """Matched pings that are near a stop which their matched trip serves: diff_sec against the trip's first visit there.

    ``near`` gives the nearest stop of a ping (id, stop_id), as ``nearest_stop_within`` does.
    """
    rows = matches.filter(F.col("confidence") >= min_confidence).select("id", "vehicle_id", "route_id", "timestamp", "trip_id").join(near.select("id", "stop_id"), "id")
    first = stop_times.groupBy("trip_id", "stop_id").agg(F.min_by(clock.gtfs_seconds(F.col("arrival_time")), "stop_sequence").alias("sched_sec"))
    at = clock.to_local(F.col("timestamp"), tz)
    diff = exact_seconds_between(clock.gtfs_time_on_reference_day(at, F.col("sched_sec")), at)
    return rows.join(first, ["trip_id", "stop_id"]).withColumn("diff_sec", diff).drop("sched_sec")


def match_vehicles_to_trips(matches: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Latest good match per vehicle."""
    return matches.filter(F.col("confidence") >= min_confidence).groupBy("vehicle_id").agg(F.max_by(F.struct("trip_id", "stop_id", "confidence", "timestamp"), F.struct("timestamp", "id")).alias("m")).select("vehicle_id", "m.*")


def validate_trip_match(positions: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, shapes: DataFrame, *, tz: str = "UTC", max_shape_m: float = 500.0, slack_min: int = 30, max_bearing: float = 90.0) -> DataFrame:
    """Flags per ping of a known trip: route agrees, heading, time within the trip's span, near the trip's shape.

    Route and time must hold.  The heading (a column ``bearing``, compared with the line from
    first to last stop) and the shape are null where they can't be checked, and then do no
    harm.  The span is from first departure to last arrival, each less a day from 24:00 on;
    a span that ends before it starts passes midnight.  A ping meets only the shape points
    in the cells around it; shape_m is null where none is within max_shape_m.
    """
    sec = lambda c: F.pmod(clock.gtfs_seconds(F.col(c)), F.lit(86400))
    visits = stop_times.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "left")
    end = F.struct(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    ends = visits.groupBy("trip_id").agg(
        F.min_by(sec("departure_time"), "stop_sequence").alias("a"), F.max_by(sec("arrival_time"), "stop_sequence").alias("b"), F.min_by(end, "stop_sequence").alias("from"), F.max_by(end, "stop_sequence").alias("to"), F.count(F.lit(1)).alias("n_stops")
    )
    info = trips.select("trip_id", F.col("route_id").alias("t_route"), F.col("direction_id").alias("t_direction"), "shape_id").join(ends, "trip_id", "left")
    at = clock.to_local(F.col("timestamp"), tz)
    now = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    heading = F.col("bearing") if "bearing" in positions.columns else F.lit(None).cast("double")
    rows = positions.withColumn("bearing", heading).join(info, "trip_id")
    pts = shapes.select("shape_id", F.col("shape_pt_lat").alias("p_lat"), F.col("shape_pt_lon").alias("p_lon"))
    known = pts.select("shape_id").distinct().withColumn("has_shape", F.lit(True))
    limits = shapes.agg(F.max(F.abs("shape_pt_lat")).alias("m"))
    dy = max_shape_m / geo.DEGREE_M
    dx = geo.cell_width(F.col("m"), max_shape_m)
    spot = rows.select("id", "shape_id", "latitude", "longitude").crossJoin(F.broadcast(limits)).select("id", "shape_id", "latitude", "longitude", F.explode(geo.neighbour_cells(F.col("latitude"), F.col("longitude"), dy, dx)).alias("c")).select("id", "shape_id", "latitude", "longitude", "c.cy", "c.cx")
    placed = pts.crossJoin(F.broadcast(limits)).select("shape_id", "p_lat", "p_lon", geo.grid_cell(F.col("p_lat"), dy).alias("cy"), geo.grid_cell(F.col("p_lon"), dx).alias("cx"))
    dist = spot.join(placed, ["shape_id", "cy", "cx"]).groupBy("id").agg(F.min(geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))).alias("shape_m")).filter(F.col("shape_m") <= max_shape_m)
    rows = rows.join(dist, "id", "left").join(known, "shape_id", "left")
    line = F.pmod(F.degrees(F.atan2(F.col("to.lon") - F.col("from.lon"), F.col("to.lat") - F.col("from.lat"))) + 360.0, F.lit(360.0))
    a, b, slack = F.col("a"), F.col("b"), slack_min * 60
    inside = F.when(a <= b, now.between(a - slack, b + slack)).otherwise((now >= a - slack) | (now <= b + slack))
    flags = {
        "route_ok": F.coalesce(F.col("route_id") == F.col("t_route"), F.lit(False)),
        "direction_ok": F.when(F.col("bearing").isNotNull() & F.col("t_direction").isNotNull() & (F.col("n_stops") >= 2), geo.bearing_distance(F.col("bearing"), line) <= max_bearing),
        "time_ok": F.coalesce(inside, F.lit(False)),
        "shape_ok": F.when(F.col("has_shape"), F.col("shape_m").isNotNull()),
    }
    rows = rows.withColumns(flags)
    bad = {c: ~F.coalesce(F.col(c), F.lit(True)) for c in flags}
    warnings = F.array_compact(F.array(*[F.when(x, F.lit(c.replace("_ok", "_mismatch"))) for c, x in bad.items()]))
    return rows.select("id", "trip_id", *flags, "shape_m", warnings.alias("warnings"), (F.size(warnings) == 0).alias("is_valid"))

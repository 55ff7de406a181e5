"""Segment slip, timepoints, direction asymmetry, cross-route segments, blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions import clock, geo, labels
from fleetline.operators.runs import seconds_between
from fleetline.operators.schedule import canonical_stop_sequence, schedule_origins, scheduled_endpoints

DIR = ["route_id", "direction_id"]


def canonical_stop_mapping(stop_events: DataFrame) -> DataFrame:
    """Most frequent stop per (route, direction, sequence); ties to the smaller id."""
    n = stop_events.groupBy(*DIR, "stop_sequence", "stop_id").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*DIR, "stop_sequence").orderBy(F.desc("n"), "stop_id"))
    return n.withColumn("nth", nth).filter("nth = 1").drop("nth")


def layover_stops(stop_events: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, *, max_offset: int = 5, max_m: float = 100.0, early_sec: int = -60) -> DataFrame:
    """(route, direction, stop_sequence, stop_id) of terminal bays: near the origin and left early by median."""
    place = stops.select("stop_id", "stop_lat", "stop_lon")
    origin = schedule_origins(trips, stop_times).join(place, "stop_id").select(*DIR, F.col("stop_id").alias("o_id"), F.col("stop_sequence").alias("o_seq"), F.col("stop_lat").alias("o_lat"), F.col("stop_lon").alias("o_lon"))
    rows = stop_events.filter("source = 'proximity' AND deviation_sec IS NOT NULL").groupBy(*DIR, "stop_sequence", "stop_id").agg(F.percentile("deviation_sec", 0.5).alias("median_dev"))
    rows = rows.join(origin, DIR).join(place, "stop_id")
    near = geo.haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("stop_lat"), F.col("stop_lon")) <= max_m
    head = (F.col("stop_sequence") - F.col("o_seq")).between(0, max_offset) & (F.col("stop_id") != F.col("o_id"))
    return rows.filter(near & head & (F.col("median_dev") <= early_sec)).select(*DIR, "stop_sequence", "stop_id", "median_dev")


def in_periods(rows: DataFrame, hour: Column, periods: tuple[str, ...] = ("all", *[p[0] for p in labels.PERIODS])) -> DataFrame:
    """Each row once per period that its hour lies in (``all`` and one named period)."""
    named = labels.period_key(hour)
    return rows.withColumn("period", F.explode(F.array_compact(F.array(F.lit("all"), named)))).filter(F.col("period").isin(*periods))


def segment_observations(stop_events: DataFrame, *, max_gap: int = 1800, source: str = "proximity", tz: str = clock.TZ) -> DataFrame:
    """Consecutive events of a run with both ends canonical: from/to stop and sequence, slip_sec, hour.

    The canonical mapping is a small aggregate of the same events, joined on its keys.
    """
    events = stop_events.filter((F.col("source") == source) & F.col("observed_arrival_ts").isNotNull())
    w = Window.partitionBy("service_date", "trip_id").orderBy("stop_sequence")
    nxt = lambda c: F.lead(c).over(w)
    obs, sched = F.col("observed_arrival_ts"), F.col("scheduled_arrival_ts")
    rows = events.select(
        *DIR, "service_date", "trip_id", F.col("stop_sequence").alias("from_seq"), F.col("stop_id").alias("from_stop"), nxt("stop_sequence").alias("to_seq"), nxt("stop_id").alias("to_stop"),
        seconds_between(obs, nxt("observed_arrival_ts")).alias("obs_gap"), seconds_between(sched, nxt("scheduled_arrival_ts")).alias("sched_gap"), clock.local_hour(sched, tz).alias("hour"), clock.local_hour(obs, tz).alias("obs_hour"),
    ).filter(F.col("obs_gap").between(0, max_gap))
    canon = canonical_stop_mapping(events)
    a = canon.select(*DIR, F.col("stop_sequence").alias("from_seq"), F.col("stop_id").alias("from_stop"))
    b = canon.select(*DIR, F.col("stop_sequence").alias("to_seq"), F.col("stop_id").alias("to_stop"))
    rows = rows.join(a, [*DIR, "from_seq", "from_stop"], "left_semi").join(b, [*DIR, "to_seq", "to_stop"], "left_semi")
    return rows.withColumn("slip_sec", F.col("obs_gap") - F.col("sched_gap"))


SEGMENT = [*DIR, "period", "from_seq", "to_seq", "from_stop", "to_stop"]


def segment_slip(stop_events: DataFrame, *, min_obs: int = 50, max_gap: int = 1800, tz: str = clock.TZ) -> DataFrame:
    """Mean slip per segment and period (by scheduled hour), with at least min_obs observations."""
    rows = in_periods(segment_observations(stop_events, max_gap=max_gap, tz=tz), F.col("hour"))
    return rows.groupBy(*SEGMENT).agg(F.avg("slip_sec").alias("mean_slip_sec"), F.count(F.lit(1)).alias("n_obs")).filter(F.col("n_obs") >= min_obs)


def cumulative_slip(segments: DataFrame, layover: DataFrame | None = None) -> DataFrame:
    """Segments but for the first and those that leave a layover stop, with the running sum of
    consecutive edges; an edge that skips stops carries the sum at its origin."""
    key = Window.partitionBy(*DIR, "period")
    rows = segments.withColumn("first", F.min("from_seq").over(key)).filter("from_seq > first").drop("first")
    if layover is not None:
        gone = layover.select(*DIR, F.col("stop_sequence").alias("from_seq"), F.col("stop_id").alias("from_stop"))
        rows = rows.join(gone, [*DIR, "from_seq", "from_stop"], "left_anti")
    rows = rows.withColumn("consecutive", F.col("to_seq") == F.min("to_seq").over(Window.partitionBy(*DIR, "period", "from_seq")))
    own = F.when(F.col("consecutive"), F.col("mean_slip_sec")).otherwise(0.0)
    before = F.coalesce(F.sum(own).over(key.orderBy("from_seq").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("cum_slip_sec", before + own).drop("consecutive")


def timepoint_stops(route_stops: DataFrame, timepoints: DataFrame, max_m: float = 50.0) -> DataFrame:
    """Distinct (route_id, stop_id) less than max_m from any timepoint, by grid cell."""
    dy = max_m / geo.DEGREE_M
    dx = dy * 2  # wide enough up to latitude 60
    t = timepoints.select(F.col("stop_lat").alias("t_lat"), F.col("stop_lon").alias("t_lon"), F.explode(geo.neighbour_cells(F.col("stop_lat"), F.col("stop_lon"), dy, dx)).alias("c")).select("t_lat", "t_lon", "c.cy", "c.cx")
    s = route_stops.withColumns({"cy": geo.grid_cell(F.col("stop_lat"), dy), "cx": geo.grid_cell(F.col("stop_lon"), dx)})
    near = geo.haversine_m(F.col("stop_lat"), F.col("stop_lon"), F.col("t_lat"), F.col("t_lon")) < max_m
    return s.join(t, ["cy", "cx"]).filter(near).select("route_id", "stop_id").distinct()


def timepoint_behavior(stop_events: DataFrame, timepoints_of: DataFrame, *, min_obs: int = 30, tz: str = clock.TZ) -> DataFrame:
    """Deviation entering (at the event before) and leaving each timepoint stop, and its class."""
    w = Window.partitionBy("service_date", "trip_id").orderBy("stop_sequence")
    rows = stop_events.filter("source = 'proximity' AND deviation_sec IS NOT NULL").select(
        *DIR, "stop_id", F.col("deviation_sec").alias("leaving"), F.lag("deviation_sec").over(w).alias("entering"), clock.local_hour(F.lag("observed_arrival_ts").over(w), tz).alias("hour")
    )
    rows = in_periods(rows.filter("entering IS NOT NULL").join(timepoints_of, ["route_id", "stop_id"], "left_semi"), F.col("hour"))
    p = lambda c, q: F.percentile(c, q)
    out = rows.groupBy(*DIR, "period", "stop_id").agg(F.count(F.lit(1)).alias("n_obs"), p("entering", 0.1).alias("in_p10"), p("entering", 0.5).alias("in_p50"), p("leaving", 0.1).alias("out_p10"), p("leaving", 0.5).alias("out_p50"))
    drop = F.col("in_p50") - F.col("out_p50")
    kind = F.when(drop >= 120, "recovery").when(F.col("out_p10") >= 180, "leaky").when((F.col("in_p50") >= 120) & (drop < 60), "underpowered").otherwise("neutral")
    return out.filter(F.col("n_obs") >= min_obs).withColumn("behavior", kind)


def direction_asymmetry(stop_events: DataFrame, *, margin: float = 5.0, tz: str = clock.TZ) -> DataFrame:
    rows = stop_events.filter("source = 'proximity' AND deviation_sec IS NOT NULL").select(*DIR, "deviation_sec", clock.local_hour(F.col("scheduled_arrival_ts"), tz).alias("hour"))
    d = F.col("deviation_sec")
    out = in_periods(rows, F.col("hour")).groupBy(*DIR, "period").agg(F.count(F.lit(1)).alias("n_obs"), (F.avg((d < labels.EARLIEST).cast("int")) * 100).alias("early_pct"), (F.avg((d > labels.LATEST).cast("int")) * 100).alias("late_pct"))
    diff = F.col("early_pct") - F.col("late_pct")
    return out.withColumn("signature", F.when(diff > margin, "early_dominant").when(diff < -margin, "late_dominant").otherwise("balanced"))


def route_diagnostics(stop_events: DataFrame, timepoints_of: DataFrame, layover: DataFrame | None = None, **options) -> DataFrame:
    """Cumulative slip of all routes and periods, with a flag for segments that end at a timepoint."""
    out = cumulative_slip(segment_slip(stop_events, **options), layover)
    flag = timepoints_of.select("route_id", F.col("stop_id").alias("to_stop"), F.lit(True).alias("is_timepoint"))
    return out.join(flag, ["route_id", "to_stop"], "left").withColumn("is_timepoint", F.coalesce("is_timepoint", F.lit(False)))


def cross_route_segments(segments: DataFrame, *, min_routes: int = 2) -> DataFrame:
    """Stop pairs that several routes run: slip weighted by observations, contributors, named period of most slip."""
    pair = ["from_stop", "to_stop"]
    n, slip = F.col("n_obs"), F.col("mean_slip_sec")
    per = segments.groupBy(*pair, "period").agg(
        F.count_distinct("route_id").alias("n_routes"), F.sum("n_obs").alias("n_obs"), (F.sum(n * slip) / F.sum(n)).alias("mean_slip_sec"),
        F.array_sort(F.collect_list(F.struct((-n).alias("order"), "route_id", "direction_id", F.col("n_obs").alias("n"), slip.alias("slip")))).alias("c"),
    ).filter(F.col("n_routes") >= min_routes)
    peak = per.filter("period <> 'all'").groupBy(*pair).agg(F.max_by("period", F.struct("mean_slip_sec", "period")).alias("peak_period"))
    routes = F.transform("c", lambda x: F.struct(x["route_id"].alias("route_id"), x["direction_id"].alias("direction_id"), x["n"].alias("n"), x["slip"].alias("slip")))
    return per.select(*pair, "period", "n_routes", "n_obs", "mean_slip_sec", routes.alias("contributors")).join(peak, pair, "left")


def rank_segments(cross: DataFrame, stops: DataFrame, *, period: str = "all", k: int = 20) -> DataFrame:
    """The k stop pairs with most slip, with names."""
    name = lambda a: stops.select(F.col("stop_id").alias(f"{a}_stop"), F.col("stop_name").alias(f"{a}_name"))
    rows = cross.filter(F.col("period") == period).orderBy(F.desc("mean_slip_sec"), "from_stop", "to_stop").limit(k)
    rows = rows.join(name("from"), "from_stop", "left").join(name("to"), "to_stop", "left")
    return rows.withColumn("slip_min_per_trip", F.col("mean_slip_sec") / 60).orderBy(F.desc("mean_slip_sec"), "from_stop", "to_stop")


def schedule_audit(segments: DataFrame, *, sign: int = 0, days: int = 30, k: int = 500) -> DataFrame:
    """Minutes a day each segment's slip adds; sign 1 keeps slow, -1 fast ones; largest first."""
    rows = segments.filter("period = 'all'").withColumn("minutes_per_day", F.col("mean_slip_sec") * (F.col("n_obs") / days) / 60)
    rows = rows.filter(F.col("mean_slip_sec") * sign > 0) if sign else rows
    return rows.orderBy(F.desc(F.abs("minutes_per_day")), *DIR, "from_seq", "to_seq").limit(min(max(k, 1), 500))


def with_stop_names(df: DataFrame, stops: DataFrame, *cols: str) -> DataFrame:
    """Names of the stops in the columns, as <column>_name."""
    return reduce(lambda d, c: d.join(stops.select(F.col("stop_id").alias(c), F.col("stop_name").alias(f"{c}_name")), c, "left"), cols, df)


def slip_trajectory(stop_events: DataFrame, *, max_gap: int = 1800, tz: str = clock.TZ) -> DataFrame:
    """Mean slip per arriving stop and observed hour, and its running sum along the direction."""
    rows = segment_observations(stop_events, max_gap=max_gap, tz=tz).groupBy(*DIR, "obs_hour", "to_seq").agg(F.avg("slip_sec").alias("mean_slip_sec"), F.count(F.lit(1)).alias("n_obs"))
    w = Window.partitionBy(*DIR, "obs_hour").orderBy("to_seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum_slip_sec", F.sum("mean_slip_sec").over(w))


def block_timeline(trips: DataFrame, stop_times: DataFrame, runs: DataFrame, services: DataFrame, dates: DataFrame) -> DataFrame:
    """Every block's trips per date in order: schedule, end deviations, vehicle, status.

    A block without an active trip on a date shows all its trips there, with is_scheduled false.
    """
    blocks = trips.select("block_id").filter("block_id IS NOT NULL").distinct()
    active = services.join(trips, "service_id").select("service_date", "block_id", "trip_id", "route_id", F.lit(True).alias("is_scheduled"))
    idle = dates.select("service_date").crossJoin(blocks).join(active.select("service_date", "block_id").distinct(), ["service_date", "block_id"], "left_anti")
    every = active.unionByName(idle.join(trips, "block_id").select("service_date", "block_id", "trip_id", "route_id", F.lit(False).alias("is_scheduled")))
    sched = every.join(scheduled_endpoints(stop_times), "trip_id").select("service_date", "is_scheduled", "block_id", "trip_id", "route_id", "start_sec", "end_sec")
    pick = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    wide = runs.groupBy("service_date", "trip_id").agg(
        pick("proximity", "origin_dev_sec").alias("origin_dev_sec"), pick("trip_update", "destination_dev_sec").alias("destination_dev_sec"),
        F.coalesce(pick("trip_update", "vehicle_id"), pick("proximity", "vehicle_id")).alias("vehicle_id"), F.max("stops_observed").alias("stops_observed"),
    )
    out = sched.join(wide, ["service_date", "trip_id"], "left")
    both = F.col("origin_dev_sec").isNotNull() & F.col("destination_dev_sec").isNotNull()
    return out.withColumn("status", F.when(both, "complete").when(F.col("stops_observed") > 0, "partial").otherwise("not_observed")).drop("stops_observed")


def active_blocks(timeline: DataFrame) -> DataFrame:
    """Per (date, block): trips, routes, first start, worst deviation, rank by it."""
    worst = F.greatest(F.abs("origin_dev_sec"), F.abs("destination_dev_sec"))
    out = timeline.filter("is_scheduled").groupBy("service_date", "block_id").agg(
        F.count(F.lit(1)).alias("n_trips"), F.array_join(F.array_sort(F.collect_set("route_id")), ",").alias("routes"), F.min("start_sec").alias("first_start_sec"), F.max(worst).alias("worst_dev_sec"), F.max((F.col("status") != "not_observed").cast("int")).alias("any_observed")
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("service_date").orderBy(F.desc_nulls_last("worst_dev_sec"), "block_id")))


def route_blocks(timeline: DataFrame) -> DataFrame:
    """Per (date, route, block): trips of the block, and those on the route."""
    timeline = timeline.filter("is_scheduled")
    n = timeline.groupBy("service_date", "block_id").agg(F.count(F.lit(1)).alias("n_trips"))
    on = timeline.groupBy("service_date", "route_id", "block_id").agg(F.count(F.lit(1)).alias("n_on_route"), F.min("start_sec").alias("first_start_sec"))
    return on.join(n, ["service_date", "block_id"])


def run_deviations(runs: DataFrame, stop_times: DataFrame, stop_events: DataFrame, source: str = "trip_update") -> DataFrame:
    """Every run's schedule with what was seen at each stop."""
    keys = runs.filter(F.col("source") == source).select("service_date", "trip_id")
    seen = stop_events.filter(F.col("source") == source).select("service_date", "trip_id", "stop_sequence", "deviation_sec", "schedule_relationship")
    return keys.join(stop_times.select("trip_id", "stop_sequence", "stop_id"), "trip_id").join(seen, ["service_date", "trip_id", "stop_sequence"], "left")


def recent_runs(runs: DataFrame, k: int = 50) -> DataFrame:
    """Newest runs of each route's latest date: one row per trip, trip updates preferred."""
    w = Window.partitionBy("route_id")
    rows = runs.withColumn("latest", F.max("service_date").over(w)).filter("service_date = latest").drop("latest")
    nth = F.row_number().over(Window.partitionBy("route_id", "trip_id").orderBy(F.when(F.col("source") == "trip_update", 0).otherwise(1)))
    rows = rows.withColumn("nth", nth).filter("nth = 1").drop("nth")
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("first_obs_ts"), "trip_id"))).filter(F.col("rank") <= k)


def diagnostic_stop_sequence(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    return with_stop_names(canonical_stop_sequence(trips, stop_times), stops, "stop_id")

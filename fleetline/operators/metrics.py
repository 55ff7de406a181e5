"""On-time performance, speed, completeness and other metrics over events and pings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions import clock, geo, labels
from fleetline.operators import derive
from fleetline.operators.runs import exact_seconds_between, seconds_between, trunc_int
from fleetline.operators.schedule import canonical_stop_sequence, drop_exception_pings

KEY = ["route_id", "service_date"]


def _split(df: DataFrame, dev: str, prefix: str, *keys: str) -> DataFrame:
    """Counts and on-time share of a deviation column per keys."""
    d = F.col(dev)
    n = lambda c: F.sum(c.cast("int"))
    out = df.filter(d.isNotNull()).groupBy(*keys).agg(
        n(d < labels.EARLIEST).alias(f"{prefix}_early"), n(d.between(labels.EARLIEST, labels.LATEST)).alias(f"{prefix}_on_time"), n(d > labels.LATEST).alias(f"{prefix}_late"), F.count(F.lit(1)).alias(f"{prefix}_n")
    )
    return out.withColumn(f"{prefix}_pct", F.col(f"{prefix}_on_time") * 100.0 / F.col(f"{prefix}_n"))


def otp_split(stop_events: DataFrame, runs: DataFrame, *, period: str = "all", tz: str = clock.TZ) -> DataFrame:
    """(route_id, service_date): on-time counts at origin (proximity runs), destination (trip-update runs) and all stops (proximity events)."""
    ts = lambda c: labels.hour_in_period(clock.local_hour(F.col(c), tz), period)
    origin = _split(runs.filter("source = 'proximity'").filter(ts("first_obs_ts")), "origin_dev_sec", "origin", *KEY)
    dest = _split(runs.filter("source = 'trip_update'").filter(ts("last_obs_ts")), "destination_dev_sec", "destination", *KEY)
    every = _split(stop_events.filter("source = 'proximity'").filter(ts("observed_arrival_ts")), "deviation_sec", "all", *KEY)
    return every.join(origin, KEY, "full").join(dest, KEY, "full")


def system_otp_daily(stop_events: DataFrame) -> DataFrame:
    return _split(stop_events.filter("source = 'proximity'"), "deviation_sec", "otp", "service_date")


def route_otp_daily(stop_events: DataFrame, dates: DataFrame, *, period: str = "all", tz: str = clock.TZ) -> DataFrame:
    """On-time share per route and every date of the axis; null where nothing was seen."""
    rows = stop_events.filter("source = 'proximity'").filter(labels.hour_in_period(clock.local_hour(F.col("observed_arrival_ts"), tz), period))
    per = _split(rows, "deviation_sec", "otp", *KEY).select(*KEY, "otp_pct", "otp_n")
    return rows.select("route_id").distinct().crossJoin(dates).join(per, KEY, "left")


def line_otp_from_positions(positions: DataFrame, trips: DataFrame, calendar_dates: DataFrame, route_stops: DataFrame, stop_times: DataFrame, *, every: int = 1, min_arrivals: int = 1, tz: str = "UTC") -> DataFrame:
    """Ping-based OTP per route, ranked: clean pings, nearest stop, last ping per passage."""
    pings = derive.dedupe_pings(positions)
    pings = drop_exception_pings(pings, trips, calendar_dates, tz=tz).drop("service_date")
    pings = derive.sample_every_nth(pings, every) if every > 1 else pings
    rows = derive.dedupe_stop_passages(derive.enrich_positions(pings, route_stops, stop_times, tz=tz))
    return otp_ranking(rows, min_arrivals)


def otp_ranking(passages: DataFrame, min_arrivals: int = 1) -> DataFrame:
    out = _split(passages, "diff_sec", "otp", "route_id").join(passages.groupBy("route_id").agg(F.round(F.avg("diff_sec"), 1).alias("avg_late_sec")), "route_id")
    return out.filter(F.col("otp_n") >= min_arrivals).orderBy(F.desc("otp_pct"), "route_id")


def otp_from_matches(arrivals: DataFrame, *keys: str) -> DataFrame:
    """OTP and mean lateness (to a tenth of a second) of the arrivals of matched pings (``derive.arrivals_of_matches``) per route and ``keys``."""
    late = arrivals.groupBy("route_id", *keys).agg(F.round(F.avg("diff_sec"), 1).alias("avg_late_sec"))
    return _split(arrivals, "diff_sec", "otp", "route_id", *keys).join(late, ["route_id", *keys])


def matched_and_unmatched(positions: DataFrame, matches: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Pings per route with and without a good match."""
    good = matches.filter(F.col("confidence") >= min_confidence).select("id", F.lit(1).alias("hit"))
    rows = positions.filter("route_id IS NOT NULL").select("id", "route_id").join(good, "id", "left")
    return rows.groupBy("route_id").agg(F.count("hit").alias("n_matched"), (F.count(F.lit(1)) - F.count("hit")).alias("n_unmatched"))


def headways_at_stop(passages: DataFrame, stops_of: DataFrame, hours: DataFrame, *, tz: str = "UTC", valid_min: int = 120) -> DataFrame:
    """Consecutive same-day gaps at each (route, direction)'s reference stop, flagged if too long."""
    rows = passages.join(stops_of.select("route_id", "direction_id", "stop_id"), ["route_id", "direction_id", "stop_id"], "left_semi").join(hours, "route_id")
    h = clock.local_hour(F.col("timestamp"), tz)
    rows = rows.filter((h >= F.col("first_hour")) & (h <= F.col("last_hour")) | (h + 24 <= F.col("last_hour")))
    w = Window.partitionBy("route_id", "direction_id", "stop_id", "service_date").orderBy("timestamp", "id")
    gap = seconds_between(F.lag("timestamp").over(w), F.col("timestamp")) / 60.0
    out = rows.select("route_id", "direction_id", "stop_id", "service_date", "timestamp", gap.alias("headway_min"))
    return out.filter("headway_min IS NOT NULL").withColumn("is_valid", F.col("headway_min") <= valid_min)


def route_headways(headways: DataFrame) -> DataFrame:
    """Mean of the directions' means, smallest and largest gap per route; valid gaps only."""
    per = headways.filter("is_valid").groupBy("route_id", "direction_id").agg(F.avg("headway_min").alias("m"), F.min("headway_min").alias("a"), F.max("headway_min").alias("b"))
    return per.groupBy("route_id").agg(F.avg("m").alias("mean_headway_min"), F.min("a").alias("min_headway_min"), F.max("b").alias("max_headway_min"))


def headways_batch(passages: DataFrame) -> DataFrame:
    """Per route: statistics at each direction's busiest stop, averaged over directions."""
    n = passages.groupBy("route_id", "direction_id", "stop_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("route_id", "direction_id").agg(F.max_by("stop_id", F.struct("n", "stop_id")).alias("stop_id"))
    rows = passages.join(best, ["route_id", "direction_id", "stop_id"], "left_semi")
    w = Window.partitionBy("route_id", "direction_id", "service_date").orderBy("timestamp", "id")
    rows = rows.withColumn("h", seconds_between(F.lag("timestamp").over(w), F.col("timestamp")) / 60.0).filter("h IS NOT NULL AND h > 0")
    per = rows.groupBy("route_id", "direction_id").agg(F.avg("h").alias("m"), F.min("h").alias("a"), F.max("h").alias("b"), F.stddev_samp("h").alias("s"))
    out = per.groupBy("route_id").agg(F.avg("m").alias("mean_min"), F.min("a").alias("min_min"), F.max("b").alias("max_min"), F.avg("s").alias("std_min"))
    return out.withColumn("cv", F.when(F.col("mean_min") > 0, F.col("std_min") / F.col("mean_min")))


def average_speed(positions: DataFrame, *, min_minutes: float = 5.0, max_mph: float = 60.0) -> DataFrame:
    """Speed per route over (vehicle, trip, date) journeys: path length over time."""
    date = F.to_date("timestamp")
    w = Window.partitionBy("route_id", "vehicle_id", "trip_id", date).orderBy("timestamp", "id")
    step = geo.haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    rows = positions.select("route_id", "vehicle_id", "trip_id", date.alias("d"), "timestamp", step.alias("step"))
    trips = rows.groupBy("route_id", "vehicle_id", "trip_id", "d").agg(F.sum("step").alias("m"), seconds_between(F.min("timestamp"), F.max("timestamp")).alias("s"))
    mph = F.col("m") / F.col("s") * 3600 / 1609.344
    trips = trips.filter(F.col("s") >= min_minutes * 60).withColumn("mph", mph).filter(F.col("mph") <= max_mph)
    return trips.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_trips"), (F.sum("m") / F.sum("s") * 3600 / 1609.344).alias("avg_mph"), F.percentile("mph", 0.5).alias("median_mph"), F.min("mph").alias("min_mph"), F.max("mph").alias("max_mph")
    )


def average_speed_reported(positions: DataFrame) -> DataFrame:
    return positions.filter("speed IS NOT NULL").groupBy("route_id").agg(F.avg("speed").alias("avg_speed"), F.count(F.lit(1)).alias("n_pings"))


def route_summary(positions: DataFrame) -> DataFrame:
    return positions.groupBy("route_id").agg(
        F.count_distinct("trip_id").alias("n_trips"), F.count(F.lit(1)).alias("n_pings"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count_distinct("vehicle_id").alias("n_vehicles")
    )


def ingest_coverage(heartbeats: DataFrame, positions: DataFrame, dates: DataFrame, tz: str = clock.TZ) -> DataFrame:
    """Distinct minutes with a heartbeat or ping over the minutes of the local day."""
    minutes = heartbeats.select(F.col("ts")).union(positions.select(F.col("timestamp"))).select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m"))
    seen = minutes.withColumn("service_date", clock.local_date(F.col("m"), tz)).groupBy("service_date").agg(F.count_distinct("m").alias("minutes_seen"))
    a, b, _ = clock.local_day_bounds(F.col("service_date"), tz)
    out = dates.select("service_date", (seconds_between(a, b) / 60).cast("int").alias("minutes_in_day")).join(seen, "service_date", "left").fillna(0, ["minutes_seen"])
    return out.withColumn("coverage", F.col("minutes_seen") / F.col("minutes_in_day"))


def duty_ceiling(tick_sec: list[int]) -> float:
    """Share of minutes in which some collector ticks, from the ticks' common cycle."""
    cycle = math.lcm(*tick_sec, 60)
    return len({t // 60 for s in tick_sec for t in range(0, cycle, s)}) / (cycle / 60)


def coverage_flag(coverage: Column, ceiling: float = 1.0, least: float = 0.80) -> Column:
    return F.when(coverage >= least * ceiling, "complete").otherwise("partial")


def stop_diagnostics(stop_events: DataFrame, trips: DataFrame, stop_times: DataFrame, *, day_type: str = "all", period: str = "all", tz: str = clock.TZ) -> DataFrame:
    """Per canonical stop of (route, direction): deviation, OTP, skip share; zeros where nothing was seen."""
    canon = canonical_stop_sequence(trips, stop_times).select("route_id", "direction_id", "stop_sequence", "stop_id")
    rows = stop_events if day_type == "all" else stop_events.filter(clock.day_type(F.col("service_date")) == day_type)
    rows = rows.filter(labels.hour_in_period(clock.local_hour(F.col("scheduled_arrival_ts"), tz), period))
    prox, tu = F.col("source") == "proximity", F.col("source") == "trip_update"
    d = F.when(prox, F.col("deviation_sec"))
    per = rows.groupBy("route_id", "direction_id", "stop_id").agg(
        F.count(d).alias("n_obs"), F.percentile(d, 0.5).alias("median_dev_sec"), F.percentile(d, 0.95).alias("p95_dev_sec"),
        (F.avg(d.between(labels.EARLIEST, labels.LATEST).cast("int")) * 100).alias("otp_pct"), (F.avg(F.when(tu, (F.col("schedule_relationship") == "SKIPPED").cast("int"))) * 100).alias("skip_pct"),
    )
    return canon.join(per, ["route_id", "direction_id", "stop_id"], "left").fillna(0, ["n_obs"])


def rolling_otp(stop_events: DataFrame, rows: int = 10) -> DataFrame:
    """Rolling on-time mean over the last observations of a route.

    Windows run within one date of a route; each date also gets the last rows - 1 flags of
    the dates before it, from a table of that many per route and date.
    """
    day = F.to_date("observed_arrival_ts")
    on = F.col("deviation_sec").between(labels.EARLIEST, labels.LATEST).cast("int")
    base = stop_events.filter("source = 'proximity' AND deviation_sec IS NOT NULL").select("route_id", "trip_id", "stop_sequence", "observed_arrival_ts", day.alias("day"), on.alias("on"))
    order = ["observed_arrival_ts", "trip_id", "stop_sequence"]
    w = Window.partitionBy("route_id", "day").orderBy(*order)
    base = base.select("*", F.row_number().over(w).alias("nth"), F.sum("on").over(w.rowsBetween(1 - rows, 0)).alias("here"), F.count(F.lit(1)).over(Window.partitionBy("route_id", "day")).alias("n"))
    tails = base.filter(F.col("n") - F.col("nth") < rows - 1).groupBy("route_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "on"))), lambda x: x["on"]).alias("tail"))
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy("route_id").orderBy("day").rowsBetween(1 - rows, -1)))
    carried = tails.select("route_id", "day", before.alias("before"))
    lack = F.greatest(F.lit(0), F.lit(rows) - F.col("nth"))
    take = F.least(lack, F.size("before"))
    old = F.aggregate(F.slice("before", F.size("before") - take + 1, take), F.lit(0), lambda a, x: a + x)
    out = base.join(carried, ["route_id", "day"]).select("*", F.when(take > 0, old).otherwise(0).alias("old"), take.alias("take"))
    return out.select("route_id", "trip_id", "stop_sequence", "observed_arrival_ts", ((F.col("here") + F.col("old")) / (F.least(F.col("nth"), F.lit(rows)) + F.col("take"))).alias("rolling_otp"))


def lateness_histogram(stop_events: DataFrame) -> DataFrame:
    return stop_events.filter("source = 'proximity' AND deviation_sec IS NOT NULL").groupBy("route_id", F.floor(F.col("deviation_sec") / 60).cast("int").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def otp_by_direction(stop_events: DataFrame) -> DataFrame:
    return _split(stop_events.filter("source = 'proximity'"), "deviation_sec", "otp", "route_id", "direction_id")


def feed_profile(updates: DataFrame) -> DataFrame:
    """One row: presence of fields, rows per trip, and counts by relationship."""
    n = updates.groupBy("trip_id").agg(F.count(F.lit(1)).alias("k"))
    per = n.agg(F.count(F.lit(1)).alias("n_trips"), F.min("k").alias("min_rows"), F.percentile("k", 0.5).alias("median_rows"), F.percentile("k", 0.95).alias("p95_rows"), F.max("k").alias("max_rows"))
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    rel = lambda r: F.sum((F.col("schedule_relationship") == r).cast("int"))
    whole = updates.agg(F.count(F.lit(1)).alias("n_rows"), share("vehicle_id").alias("has_vehicle"), share("predicted_arrival_ts").alias("has_prediction"), share("trip_start_date").alias("has_start_date"), rel("SCHEDULED").alias("n_scheduled"), rel("SKIPPED").alias("n_skipped"))
    return whole.crossJoin(per)


def nearest_rank(df: DataFrame, column: str, **shares: float) -> DataFrame:
    """One row: the values at rank round-half-even(share * (n - 1)), and the largest as ``max``; nulls don't count.

    Rows are first counted per value, so what is ordered in one place are distinct values: meant for whole
    seconds and counts, which are few, and not for columns of continuous doubles.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("v"))
    ranked = counts.withColumn("upto", upto).crossJoin(counts.agg(F.sum("n").alias("all")))
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.bround((F.col("all") - 1) * q), F.col("v"))).alias(name) for name, q in shares.items()], F.max("v").alias("max"))


def prediction_volatility(updates: DataFrame) -> DataFrame:
    """One row: snapshots per (trip, stop), and spread of their predictions, by nearest rank."""
    per = updates.groupBy("trip_id", "stop_sequence").agg(F.count_distinct("snapshot_ts").alias("k"), seconds_between(F.min("predicted_arrival_ts"), F.max("predicted_arrival_ts")).alias("spread"))
    snapshots = nearest_rank(per, "k", median_snapshots=0.5).withColumnRenamed("max", "max_snapshots")
    spread = nearest_rank(per, "spread", median_spread=0.5, p95_spread=0.95).withColumnRenamed("max", "max_spread")
    return per.agg(F.count(F.lit(1)).alias("n_keys")).crossJoin(snapshots).crossJoin(spread)


def run_quality(positions: DataFrame, route_stops: DataFrame, stop_times: DataFrame, *, tz: str = "UTC", max_m: float = 50.0) -> DataFrame:
    """Per run (trip, vehicle, date of its pings): pings, duration, gaps, speed, stops seen, deviation, coverage.

    The service date is the pings' date or the day before, whichever puts the trip's first
    arrival nearer to the first ping.  A stop's observation is the first ping there, stopped
    (status 1) before in transit (2) before others.  Complete means 70 % of the stops, both
    ends within three stops, and no gap of 300 s.
    """
    run = ["trip_id", "vehicle_id", "ping_date"]
    p = positions.filter("trip_id IS NOT NULL AND trip_id <> ''").withColumn("ping_date", F.to_date(clock.to_local(F.col("timestamp"), tz)))
    p = p.withColumn("gap", seconds_between(F.lag("timestamp").over(Window.partitionBy(*run).orderBy("timestamp", "id")), F.col("timestamp")))
    pings = p.groupBy(*run).agg(F.count("timestamp").alias("n_pings"), F.min("timestamp").alias("first_ts"), seconds_between(F.min("timestamp"), F.max("timestamp")).alias("duration_sec"), F.max("gap").alias("max_gap_sec"), F.avg("speed").alias("avg_speed"))
    sec = clock.gtfs_seconds(F.col("arrival_time"))
    trips = stop_times.groupBy("trip_id").agg(F.min_by(sec, "stop_sequence").alias("first_sec"), F.count(F.lit(1)).alias("stops_scheduled"), (F.max(sec) - F.min(sec)).alias("scheduled_duration_sec"))
    anchor, _ = derive.resolve_service_anchor(F.col("first_ts"), F.col("ping_date"), F.col("first_sec"), tz=tz)
    runs = pings.join(trips, "trip_id", "left").withColumn("service_date", F.coalesce(anchor, "ping_date"))
    rank = F.when(F.col("current_status") == 1, 0).when(F.col("current_status") == 2, 1).otherwise(2)
    near = derive.nearest_stop_within(p, route_stops, max_m=max_m)
    seen = near.groupBy(*run, "stop_id").agg(F.min_by("timestamp", F.struct(rank, "timestamp", "id")).alias("seen_ts"))
    obs = seen.join(stop_times.select("trip_id", "stop_id", "stop_sequence", sec.alias("sec")), ["trip_id", "stop_id"]).join(runs.select(*run, "service_date"), run)
    obs = obs.withColumn("dev", exact_seconds_between(clock.gtfs_time_to_utc(F.col("service_date"), F.col("sec"), tz), F.col("seen_ts"))).filter("dev IS NOT NULL")
    d = F.col("dev")
    n = lambda c: F.sum(c.cast("int"))
    stops = obs.groupBy(*run).agg(
        F.count_distinct("stop_id").alias("stops_observed"), F.min("stop_sequence").alias("first_obs_seq"), F.max("stop_sequence").alias("last_obs_seq"), trunc_int(F.percentile(d, 0.5)).alias("dev_p50_sec"),
        trunc_int(F.percentile(d, 0.95)).alias("dev_p95_sec"), n(d < -60).alias("early_stops"), n(d.between(-60, 300)).alias("on_time_stops"), n(d > 300).alias("late_stops"),
    )
    out = runs.join(stops, run, "left").drop("first_ts", "first_sec")
    out = out.withColumn("coverage_pct", F.least(F.lit(1.0), F.col("stops_observed") / F.col("stops_scheduled")) * 100)
    whole = (F.col("coverage_pct") >= 70) & (F.col("first_obs_seq") <= 3) & (F.col("last_obs_seq") >= F.col("stops_scheduled") - 3) & (F.coalesce("max_gap_sec", F.lit(0)) < 300)
    return out.withColumn("is_complete", F.coalesce(whole, F.lit(False)))

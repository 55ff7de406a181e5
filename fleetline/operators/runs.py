"""From stop events to one row per run, and the metrics that read runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_KEY = ["service_date", "trip_id", "source"]
#: what a run needs to know of its trip's timetable
TRIP_STOPS = ["stops_scheduled", "sched_first_seq", "sched_last_seq"]


def trunc_int(x: Column) -> Column:
    """A double cut towards zero; rounding first keeps 697.9999999999 at 698."""
    return F.round(x, 6).cast("int")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in whole seconds, of two timestamp_ntz."""
    return F.timestamp_diff("SECOND", a, b)


def exact_seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds with fractions."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def trip_stops(stop_times: DataFrame) -> DataFrame:
    """(trip_id, TRIP_STOPS): number, first and last sequence of the timetable's stops of each trip."""
    return stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).cast("int").alias("stops_scheduled"), F.min("stop_sequence").alias("sched_first_seq"), F.max("stop_sequence").alias("sched_last_seq"))


def aggregate_runs(stop_events: DataFrame, stop_times: DataFrame | None, *, percentiles: bool = True) -> DataFrame:
    """One row per (service_date, trip_id, source) of its stop events; with the percentiles of its deviations and its longest gap, if asked for.

    The gap window, the join with the timetable and the aggregation share one shuffle by trip; window and
    join share one sort of the events.  Without percentiles and gap the events are added up by hash, by vehicle first, as
    texts and percentiles would have them sorted again.  Events that carry TRIP_STOPS need no timetable: then they
    are added up where they are read, and only runs are shuffled.
    """
    seen = F.col("observed_arrival_ts").isNotNull()
    timed = set(TRIP_STOPS) <= set(stop_events.columns)
    rows = stop_events if timed and not percentiles else stop_events.repartition("trip_id")
    if percentiles:
        before = F.lag("observed_arrival_ts").over(Window.partitionBy("trip_id", "service_date", "source", seen).orderBy("observed_arrival_ts", "stop_sequence"))
        rows = rows.withColumn("gap", F.when(seen, seconds_between(before, F.col("observed_arrival_ts"))))
    rows = rows if timed else rows.join(trip_stops(stop_times), "trip_id", "left")
    seq, dev = F.col("stop_sequence"), F.col("deviation_sec")
    key, on = [*RUN_KEY, "route_id", "direction_id"], F.col("schedule_relationship") == "SKIPPED"
    sums = {
        "stops_scheduled": (F.max, F.col("stops_scheduled")), "sched_first_seq": (F.max, F.col("sched_first_seq")), "sched_last_seq": (F.max, F.col("sched_last_seq")),
        "sched_first_arrival_ts": (F.min, F.col("scheduled_arrival_ts")), "sched_last_arrival_ts": (F.max, F.col("scheduled_arrival_ts")),
        "stops_observed": (F.sum, seen.cast("long")), "stops_skipped": (F.sum, F.when(on, 1).otherwise(0)),
        "first_obs_seq": (F.min, F.when(seen, seq)), "last_obs_seq": (F.max, F.when(seen, seq)), "first_obs_ts": (F.min, F.col("observed_arrival_ts")), "last_obs_ts": (F.max, F.col("observed_arrival_ts")),
        "origin_dev_sec": (F.max, F.when(seq == F.col("sched_first_seq"), dev)), "destination_dev_sec": (F.max, F.when(seq == F.col("sched_last_seq"), dev)),
    }
    vehicle = lambda at: F.max_by("vehicle_id", F.when(F.col("vehicle_id").isNotNull() & F.col(at).isNotNull(), F.struct(at, "vehicle_id"))).alias("vehicle_id")
    if percentiles:
        more = [F.max("gap").alias("max_gap_sec")] + [trunc_int(F.percentile(dev, p)).alias(name) for name, p in (("dev_p50_sec", 0.5), ("dev_p95_sec", 0.95))]
        out = rows.groupBy(*key).agg(vehicle("stop_sequence"), *[f(c).alias(name) for name, (f, c) in sums.items()], *more)
    else:
        per = rows.groupBy(*key, "vehicle_id").agg(F.max(seq).alias("seq"), *[f(c).alias(name) for name, (f, c) in sums.items()])
        out = per.groupBy(*key).agg(vehicle("seq"), *[f(name).alias(name) for name, (f, _) in sums.items()])
    n = F.col("stops_scheduled")
    return out.withColumn("stops_observable", F.when(F.col("source") == "trip_update", F.greatest(n - 1, F.lit(0))).otherwise(n))


def delivered_floor(observable: Column) -> Column:
    """Fewest observed stops at which a run counts as delivered."""
    return F.when(observable <= 2, 1).when(observable >= 9, F.floor(observable / 3)).otherwise(2)


def service_delivered(runs: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Delivered and scheduled trips per (route_id, service_date); routes of either side.

    ``scheduled``: service_date, route_id, trip_id of the trips that should run.
    """
    ran = runs.filter(F.col("stops_observed") >= delivered_floor(F.col("stops_observable"))).select("service_date", "trip_id").distinct()
    # dealt by the join's keys before, so that telling rows apart and joining share one shuffle
    sched = scheduled.select("service_date", "route_id", "trip_id").repartition("service_date", "trip_id").distinct()
    done = sched.join(ran.withColumn("ran", F.lit(1)).hint("shuffle_hash"), ["service_date", "trip_id"], "left")  # sorts neither side
    out = done.groupBy("route_id", "service_date").agg(F.count(F.lit(1)).alias("trips_scheduled"), F.count("ran").alias("trips_delivered"))
    out = out.join(runs.select("route_id", "service_date").distinct(), ["route_id", "service_date"], "full")
    out = out.fillna(0, ["trips_scheduled", "trips_delivered"])
    return out.withColumn("delivered_ratio", F.when(F.col("trips_scheduled") > 0, F.col("trips_delivered") / F.col("trips_scheduled")))


def system_service_delivered_daily(delivered: DataFrame, runs: DataFrame) -> DataFrame:
    """Ratio of the sums per date; null where the date has no run."""
    any_run = runs.select("service_date").distinct().withColumn("has_runs", F.lit(True))
    out = delivered.groupBy("service_date").agg(F.sum("trips_delivered").alias("trips_delivered"), F.sum("trips_scheduled").alias("trips_scheduled")).join(any_run, "service_date", "left")
    ratio = F.when(F.col("has_runs") & (F.col("trips_scheduled") > 0), F.col("trips_delivered") / F.col("trips_scheduled"))
    return out.select("service_date", "trips_delivered", "trips_scheduled", ratio.alias("delivered_ratio"))


def stop_skip_rate(runs: DataFrame, min_observed: int = 3) -> DataFrame:
    """Skipped over observable stops per (route_id, service_date) of trip-update runs."""
    rows = runs.filter((F.col("source") == "trip_update") & (F.col("stops_observed") >= min_observed))
    out = rows.groupBy("route_id", "service_date").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("stops_skipped").alias("skipped"), F.sum("stops_observable").alias("observable"))
    return out.withColumn("skip_rate", F.when(F.col("observable") > 0, F.col("skipped") / F.col("observable")))


def per_stop_skip_rate(stop_events: DataFrame, runs: DataFrame, *, min_observed: int = 3, min_events: int = 10) -> DataFrame:
    """Skipped over all events per (route_id, direction_id, stop_id), of runs with enough observed stops."""
    good = runs.filter((F.col("source") == "trip_update") & (F.col("stops_observed") >= min_observed)).select("service_date", "trip_id")
    rows = stop_events.filter("source = 'trip_update'").join(good, ["service_date", "trip_id"], "left_semi")
    out = rows.groupBy("route_id", "direction_id", "stop_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.when(F.col("schedule_relationship") == "SKIPPED", 1).otherwise(0)).alias("n_skipped"))
    return out.filter(F.col("n_events") >= min_events).withColumn("skip_rate", F.col("n_skipped") / F.col("n_events"))


def excess_trip_times(runs: DataFrame) -> DataFrame:
    """Actual and scheduled duration per (service_date, trip_id, route_id).

    Last trip-update arrival less first proximity arrival where the ends were observed;
    else both from one source that saw both ends, trip updates first.
    """
    pick = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    wide = runs.groupBy("service_date", "trip_id", "route_id").agg(
        *[pick(s, c).alias(f"{a}_{c}") for s, a in (("proximity", "p"), ("trip_update", "t")) for c in ("first_obs_ts", "last_obs_ts", "origin_dev_sec", "destination_dev_sec", "sched_first_arrival_ts", "sched_last_arrival_ts")]
    )
    ends = lambda a, b: F.col(f"{a}_origin_dev_sec").isNotNull() & F.col(f"{b}_destination_dev_sec").isNotNull()
    span = lambda a, b, x, y: seconds_between(F.col(f"{a}_{x}"), F.col(f"{b}_{y}"))
    choice = [("p", "t"), ("t", "t"), ("p", "p")]
    actual, sched = F, F
    for i, (a, b) in enumerate(choice):
        actual = actual.when(ends(a, b), span(a, b, "first_obs_ts", "last_obs_ts"))
        sched = sched.when(ends(a, b), span(a, b, "sched_first_arrival_ts", "sched_last_arrival_ts"))
    return wide.select("service_date", "trip_id", "route_id", actual.alias("actual_sec"), sched.alias("scheduled_sec")).filter((F.col("scheduled_sec") > 0) & (F.col("actual_sec") > 0))


def excess_trip_time(runs: DataFrame, ratio: float = 1.10) -> DataFrame:
    """Per (route_id, service_date): trips, median and p95 excess, share above ratio."""
    x = F.col("actual_sec") - F.col("scheduled_sec")
    return excess_trip_times(runs).groupBy("route_id", "service_date").agg(
        F.count(F.lit(1)).alias("n_trips"), trunc_int(F.percentile(x, 0.5)).alias("median_excess_sec"), trunc_int(F.percentile(x, 0.95)).alias("p95_excess_sec"),
        (F.avg((F.col("actual_sec") > F.col("scheduled_sec") * ratio).cast("int")) * 100).alias("pct_over"),
    )


def latest_nonempty_excess(excess: DataFrame, as_of: str, days_back: int = 7) -> DataFrame:
    """Per route the latest row with trips in the days up to as_of."""
    end = F.lit(as_of).cast("date")
    rows = excess.filter((F.col("n_trips") > 0) & (F.col("service_date") <= end) & (F.col("service_date") > F.date_sub(end, days_back)))
    cols = [c for c in excess.columns if c != "route_id"]
    return rows.groupBy("route_id").agg(F.max_by(F.struct(*cols), "service_date").alias("x")).select("route_id", "x.*")


def compare_sources(stop_events: DataFrame) -> DataFrame:
    """Coverage and disagreement of the two sources, overall (null route) and per route."""
    dev = lambda s: F.max(F.when((F.col("source") == s) & F.col("observed_arrival_ts").isNotNull(), F.unix_timestamp(F.col("observed_arrival_ts").cast("timestamp"))))
    keys = stop_events.groupBy("route_id", "service_date", "trip_id", "stop_sequence").agg(dev("trip_update").alias("tu"), dev("proximity").alias("prox"))
    keys = keys.filter("tu IS NOT NULL OR prox IS NOT NULL").withColumn("d", F.col("tu") - F.col("prox"))
    both = F.col("d").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    return keys.rollup("route_id").agg(
        F.count(F.lit(1)).alias("n_keys"), n(both).alias("n_both"), n(F.col("prox").isNull()).alias("n_tu_only"), n(F.col("tu").isNull()).alias("n_prox_only"),
        (n(both) / n(F.col("prox").isNotNull())).alias("tu_coverage"), (n(both) / n(F.col("tu").isNotNull())).alias("prox_coverage"),
        F.percentile(F.abs("d"), 0.5).alias("abs_p50"), F.percentile(F.abs("d"), 0.95).alias("abs_p95"), F.percentile(F.abs("d"), 0.99).alias("abs_p99"),
        F.percentile("d", 0.5).alias("median_signed"), F.avg("d").alias("mean_signed"),
    )

"""Daily sufficient statistics, windows over them, deltas, rankings, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions import labels
from fleetline.operators.headways import awt

KEY = ["route_id", "service_date"]
#: name -> (value column, lower is better)
METRICS = {"otp": ("otp_pct", False), "service_delivered": ("delivered_ratio", False), "ewt": ("ewt_sec", True), "bunching": ("bunching_rate", True)}
# Smallest change that counts as a move, per metric.
MOVE_FLOOR = {"otp": 0.5, "service_delivered": 0.005, "ewt": 10.0, "bunching": 0.005}
COUNTS = ["all_early", "all_on_time", "all_late", "all_n", "origin_on_time", "origin_n", "destination_on_time", "destination_n", "trips_scheduled", "trips_delivered", "s_h", "s_h2", "s_n", "o_h", "o_h2", "o_n", "n_headways", "n_bunched"]


def route_metrics_overlay(otp: DataFrame, delivered: DataFrame, headway_sums: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(route_id, service_date): sufficient statistics of every metric, 0 where one is missing; data_quality of the date.

    The parts arrive aggregated by this key, so joining them shuffles nothing more.  Keep the
    result partitioned by service_date: all that follows reads it instead of raw events.
    """
    out = otp.join(delivered.drop("delivered_ratio"), KEY, "full").join(headway_sums, KEY, "full")
    out = out.fillna(0, [c for c in out.columns if c in COUNTS or c.startswith(("origin_", "destination_")) and not c.endswith("_pct")])
    out = out.drop("all_pct", "origin_pct", "destination_pct")
    return out if quality is None else out.join(quality.select("service_date", "data_quality"), "service_date", "left")


def with_ratios(sums: DataFrame) -> DataFrame:
    """The metrics of pooled statistics; EWT is not clamped."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    ewt = awt(F.col("o_h"), F.col("o_h2")) - awt(F.col("s_h"), F.col("s_h2"))
    return sums.withColumns({"otp_pct": per("all_on_time", "all_n") * 100.0, "origin_pct": per("origin_on_time", "origin_n") * 100.0, "destination_pct": per("destination_on_time", "destination_n") * 100.0, "delivered_ratio": per("trips_delivered", "trips_scheduled"), "ewt_sec": ewt, "bunching_rate": per("n_bunched", "n_headways"), "coverage": per("o_n", "s_n")})


def window_metrics(overlay: DataFrame, partial_dates: DataFrame, end: str, days: int) -> DataFrame:
    """Metrics per route over [end - days + 1, end], pooled, without partial dates."""
    last = F.lit(end).cast("date")
    rows = overlay.filter(F.col("service_date").between(F.date_sub(last, days - 1), last)).join(partial_dates, "service_date", "left_anti")
    return with_ratios(rows.groupBy("route_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("n_days")))


def metrics_on_date(overlay: DataFrame, date: str) -> DataFrame:
    return with_ratios(overlay.filter(F.col("service_date") == F.lit(date).cast("date")).select(*KEY, *COUNTS))


def overlay_daily_values(overlay: DataFrame, partial_dates: DataFrame) -> DataFrame:
    """Metrics per (route, date), null on partial dates."""
    flags = partial_dates.select("service_date", F.lit(True).alias("is_partial"))
    rows = with_ratios(overlay).join(flags, "service_date", "left").withColumn("is_partial", F.coalesce("is_partial", F.lit(False)))
    return rows.select(*KEY, "is_partial", "o_n", *[F.when(~F.col("is_partial"), F.col(c)).alias(c) for c, _ in METRICS.values()])


def _long(daily: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, value."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, (c, _) in METRICS.items()])
    return daily.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def period_deltas(daily: DataFrame, as_of: str, *, days: int = 7, min_days: int = 3, min_headways: int = 20) -> DataFrame:
    """(route_id, metric): mean of the last days less that of the days before; null unless both
    hold min_days values (and min_headways observed headways for EWT)."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, F.col("service_date"))
    rows = _long(daily, *KEY, "o_n").withColumn("half", F.when(age.between(0, days - 1), "now").when(age.between(days, 2 * days - 1), "before")).filter("half IS NOT NULL")
    on = lambda h, c: F.when(F.col("half") == h, F.col(c))
    out = rows.groupBy("route_id", "metric").agg(*[f for h in ("now", "before") for f in (F.avg(on(h, "value")).alias(h), F.count(on(h, "value")).alias(f"n_{h}"), F.sum(on(h, "o_n")).alias(f"h_{h}"))])
    valid = (F.col("n_now") >= min_days) & (F.col("n_before") >= min_days)
    enough = (F.coalesce("h_now", F.lit(0)) >= min_headways) & (F.coalesce("h_before", F.lit(0)) >= min_headways)
    valid = valid & ((F.col("metric") != "ewt") | enough)
    return out.select("route_id", "metric", "now", "before", F.when(valid, F.col("now") - F.col("before")).alias("delta"))


def _per_metric(rows: DataFrame, value: str, prefix: str) -> DataFrame:
    """One row per route with a column of ``value`` for every metric."""
    return rows.groupBy("route_id").agg(*[F.max(F.when(F.col("metric") == m, F.col(value))).alias(f"{prefix}_{m}") for m in METRICS])


def targets_of(routes: DataFrame, targets: DataFrame) -> DataFrame:
    """(route_id, metric, target): a route's own target, else the system's."""
    own = targets.filter("route_id IS NOT NULL").select("route_id", "metric", F.col("target").alias("own"))
    system = targets.filter("route_id IS NULL").select("metric", "target")
    return routes.select("route_id").crossJoin(system).join(own, ["route_id", "metric"], "left").select("route_id", "metric", F.coalesce("own", "target").alias("target"))


def scorecard(values: DataFrame, routes: DataFrame, classes: DataFrame, tiers: DataFrame, targets: DataFrame, deltas: DataFrame) -> DataFrame:
    """Routes with metrics, frequency class, tier membership, targets, week deltas, score and grade; best on-time first, without data last."""
    out = routes.select("route_id", "route_short_name").join(values, "route_id", "left").join(classes.select("route_id", "frequency_class"), "route_id", "left")
    out = out.join(tiers.select("route_id").distinct().withColumn("is_frequent", F.lit(True)), "route_id", "left").fillna(False, ["is_frequent"])
    out = out.join(_per_metric(targets_of(routes, targets), "target", "target"), "route_id", "left").join(_per_metric(deltas, "delta", "delta"), "route_id", "left")
    score = labels.composite_score(F.col("otp_pct"), F.col("delivered_ratio"), F.col("ewt_sec"))
    out = out.withColumn("score", score).withColumn("grade", labels.route_grade(F.col("score")))
    return out.orderBy(F.desc_nulls_last("otp_pct"), "route_id")


def route_detail(overlay: DataFrame, anchors: DataFrame, excess: DataFrame, routes: DataFrame, *card) -> DataFrame:
    """The scorecard's columns of each route on its own anchor date, with its freshest excess trip time.

    ``anchors``: route_id, anchor_date.  ``excess``: one row per route, of ``latest_nonempty_excess``.
    """
    on = overlay.withColumnRenamed("service_date", "anchor_date").join(anchors, ["route_id", "anchor_date"]).drop("anchor_date")
    out = scorecard(with_ratios(on.select("route_id", *COUNTS)), routes, *card).join(anchors, "route_id", "left")
    return out.join(excess.withColumnRenamed("service_date", "excess_date"), "route_id", "left")


def anchor_date(stop_events: DataFrame, *keys: str) -> DataFrame:
    """Latest date with events, overall or per keys."""
    return stop_events.groupBy(*keys).agg(F.max("service_date").alias("anchor_date"))


def anchor_date_by_day_type(stop_events: DataFrame) -> DataFrame:
    """Latest date with events per day type, and over all ('all')."""
    from fleetline.functions.clock import day_type

    dates = stop_events.select("service_date").distinct()
    return dates.select("service_date", F.explode(F.array(F.lit("all"), day_type(F.col("service_date")))).alias("day_type")).groupBy("day_type").agg(F.max("service_date").alias("anchor_date"))


def route_anchor_date(stop_events: DataFrame, scheduled: DataFrame, routes: DataFrame) -> DataFrame:
    """(route_id, anchor_date): the system's latest date for routes scheduled on it, even unseen; else the route's own latest.

    ``scheduled``: service_date, route_id.  Routes with neither have no row.
    """
    latest = anchor_date(stop_events).withColumnRenamed("anchor_date", "latest")
    due = scheduled.select("service_date", "route_id").distinct().join(latest, F.col("service_date") == F.col("latest"), "left_semi").select("route_id", F.col("service_date").alias("due"))
    out = routes.select("route_id").join(due, "route_id", "left").join(anchor_date(stop_events, "route_id"), "route_id", "left")
    return out.select("route_id", F.coalesce("due", "anchor_date").alias("anchor_date")).filter("anchor_date IS NOT NULL")


def route_trend(overlay: DataFrame, runs: DataFrame, excess: DataFrame, dates: DataFrame, routes: DataFrame, *, day_types: tuple[str, ...] | None = None) -> DataFrame:
    """Every route on every date of the axis: on-time share, delivered ratio and share of slow trips.

    Null on dates of another day type and where nothing was seen; a ratio of nothing
    delivered counts only if the route ran at all.
    """
    from fleetline.functions.clock import day_type

    ran = runs.select(*KEY).distinct().withColumn("ran", F.lit(True))
    rows = with_ratios(overlay).join(ran, KEY, "left").withColumn("delivered_ratio", F.when((F.col("trips_delivered") > 0) | F.col("ran"), F.col("delivered_ratio")))
    rows = rows.select(*KEY, "otp_pct", "delivered_ratio").join(excess.filter("n_trips > 0").select(*KEY, F.col("pct_over").alias("excess_trip_time_pct")), KEY, "full")
    out = routes.select("route_id").crossJoin(dates).join(rows, KEY, "left")
    keep = F.lit(True) if day_types is None else day_type(F.col("service_date")).isin(*day_types)
    return out.select(*KEY, *[F.when(keep, F.col(c)).alias(c) for c in ("otp_pct", "delivered_ratio", "excess_trip_time_pct")])


def system_metrics_daily(overlay: DataFrame, runs: DataFrame, bus_routes: DataFrame, quality: DataFrame) -> DataFrame:
    """Per date, from the overlay's sums: on-time share and delivered ratio of all routes, EWT (clamped at 0), SWT
    and bunching of bus routes; no delivered ratio on dates without any run."""
    bus = overlay.join(bus_routes.select("route_id").withColumn("is_bus", F.lit(True)), "route_id", "left")
    on_bus = [c for c in COUNTS if c[:2] in ("s_", "o_") or c in ("n_headways", "n_bunched")]
    sums = bus.groupBy("service_date").agg(*[F.coalesce(F.sum(F.when(F.col("is_bus"), F.col(c)) if c in on_bus else F.col(c)), F.lit(0)).alias(c) for c in COUNTS])
    rows = with_ratios(sums).join(runs.select("service_date").distinct().withColumn("ran", F.lit(True)), "service_date", "left").join(quality, "service_date", "left")
    ewt = F.when(F.col("ewt_sec").isNotNull(), F.greatest(F.col("ewt_sec"), F.lit(0.0)))
    return rows.select("service_date", "otp_pct", F.when(F.col("ran"), F.col("delivered_ratio")).alias("delivered_ratio"), ewt.alias("ewt_sec"), awt(F.col("s_h"), F.col("s_h2")).alias("swt_sec"), "bunching_rate", "data_quality")


def system_trend(system: DataFrame, dates: DataFrame, targets: DataFrame, as_of: str, days: int) -> DataFrame:
    """(metric, service_date): each metric on the last days + 1 dates, the mean of the ``days`` dates before (without
    nulls and partial dates), and the system's target."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, F.col("service_date"))
    rows = _long(system, "service_date", "data_quality").withColumn("age", age)
    prior = rows.filter(F.col("age").between(days + 1, 2 * days) & (F.coalesce("data_quality", F.lit("")) != "partial")).groupBy("metric").agg(F.avg("value").alias("prior_mean"))
    names = F.array(*[F.lit(m) for m in METRICS])
    axis = dates.filter(age.between(0, days)).select("service_date", F.explode(names).alias("metric"))
    goal = targets.filter("route_id IS NULL").select("metric", "target")
    return axis.join(rows.drop("age"), ["service_date", "metric"], "left").join(prior, "metric", "left").join(goal, "metric", "left").select("metric", "service_date", "value", "data_quality", "prior_mean", "target")


def contributors(window: DataFrame, baseline: DataFrame, targets: DataFrame, trips_in_window: DataFrame, metric: str = "otp") -> DataFrame:
    """Routes ranked by how much they pull the system down: gap to target (else baseline) times scheduled trips."""
    col, lower = METRICS[metric]
    rows = window.select("route_id", F.col(col).alias("value")).join(baseline.select("route_id", "baseline"), "route_id", "left").join(targets.filter(F.col("metric") == metric).select("route_id", "target"), "route_id", "left").join(trips_in_window, "route_id")
    goal = F.coalesce("target", "baseline")
    gap = F.col("value") - goal if lower else goal - F.col("value")
    rows = rows.withColumns({"gap": gap, "contribution": gap * F.col("trips_in_window")}).filter("contribution IS NOT NULL")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("contribution"), "route_id")))


def baseline_mean(daily: DataFrame, metric: str = "otp") -> DataFrame:
    """Mean of a route's complete dates."""
    return daily.filter("NOT is_partial").groupBy("route_id").agg(F.avg(METRICS[metric][0]).alias("baseline"))


def agency_comparison(agencies: DataFrame, start: str, service_level: DataFrame) -> DataFrame:
    """(agency, metric): mean from ``start`` to the earliest latest date of all agencies, days and partial days that
    hold a value, change of the last seven dates against the seven before if those lie in the window, and the
    agency's daytime service level.

    ``agencies``: agency, service_date, is_partial, metric columns.  ``service_level``: agency, n_gaps, median_headway_sec, frequent_share.
    """
    first = F.lit(start).cast("date")
    inside = agencies.filter(F.col("service_date") >= first)
    end = inside.groupBy("agency").agg(F.max("service_date").alias("m")).agg(F.min("m").alias("end"))
    rows = _long(inside, "agency", "service_date", "is_partial").crossJoin(F.broadcast(end)).filter(F.col("service_date") <= F.col("end"))
    age = F.datediff("end", "service_date")
    mean = lambda a, b: F.avg(F.when(age.between(a, b), F.col("value")))
    out = rows.groupBy("agency", "metric").agg(
        F.avg("value").alias("mean"), F.count("value").alias("days_included"), F.count(F.when(F.col("is_partial"), F.col("value"))).alias("partial_days"),
        F.when(F.date_sub(F.max("end"), 13) >= first, mean(0, 6) - mean(7, 13)).alias("wow_delta"),
    )
    return out.join(service_level, "agency", "left")


def period_drilldown(ewt: DataFrame, bunching: DataFrame, anchors: DataFrame) -> DataFrame:
    """EWT and bunching by period of each route on its anchor date (route_id, anchor_date)."""
    key = [*KEY, "period"]
    at = anchors.withColumnRenamed("anchor_date", "service_date")
    on = lambda df: df.join(at, KEY, "left_semi")
    return on(ewt).select(*key, "s_n", "o_n", "awt_sec", "swt_sec", "ewt_sec", "coverage").join(on(bunching), key, "full")


def rolling_mean_7d(daily: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean over the trailing seven rows, without partial dates."""
    w = Window.partitionBy(*keys).orderBy("service_date").rowsBetween(-6, 0)
    return daily.withColumn("rolling_mean", F.avg(F.when(~F.col("is_partial"), F.col(value))).over(w))


def window_delta(daily: DataFrame, value: str, *keys: str, size: int = 7, least: int = 3) -> DataFrame:
    """Mean of the last ``size`` valid values less that of the ``size`` before; null if one has under ``least``."""
    ok = daily.filter(~F.col("is_partial") & F.col(value).isNotNull())
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("service_date")))
    half = F.floor((F.col("nth") - 1) / size)
    rows = ok.withColumn("nth", nth).withColumn("half", half).filter("half < 2")
    on = lambda k: F.when(F.col("half") == k, F.col(value))
    out = rows.groupBy(*keys).agg(F.avg(on(0)).alias("now"), F.avg(on(1)).alias("before"), F.count(on(0)).alias("n_now"), F.count(on(1)).alias("n_before"))
    return out.withColumn("delta", F.when((F.col("n_now") >= least) & (F.col("n_before") >= least), F.col("now") - F.col("before")))


def system_delta(daily: DataFrame, value: str, prior: Column, least: int = 10) -> DataFrame:
    """Mean of valid values less a prior mean, if there are ``least`` of them."""
    out = daily.filter(~F.col("is_partial")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.withColumn("delta", F.when(F.col("n") >= least, F.col("mean") - prior))


def movers(deltas: DataFrame, k: int = 5) -> DataFrame:
    """(metric, way): the k routes that improved or declined most, beyond the metric's floor."""
    floor, sign = F.lit(None).cast("double"), F.lit(1.0)
    for m, x in MOVE_FLOOR.items():
        floor = F.when(F.col("metric") == m, x).otherwise(floor)
        sign = F.when(F.col("metric") == m, -1.0 if METRICS[m][1] else 1.0).otherwise(sign)
    gain = F.col("delta") * sign
    rows = deltas.filter(F.abs("delta") > floor).select("route_id", "metric", "delta", F.when(gain > 0, "up").otherwise("down").alias("way"))
    rank = F.row_number().over(Window.partitionBy("metric", "way").orderBy(F.desc(F.abs("delta")), "route_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _against_targets(window: DataFrame, targets: DataFrame) -> DataFrame:
    """route_id, metric, value, target, lower; targets of a route or, with null route, of the system."""
    lower = F.col("metric").isin(*[m for m, (_, x) in METRICS.items() if x])
    own = targets.filter("route_id IS NOT NULL").select("route_id", "metric", F.col("target").alias("own"))
    system = targets.filter("route_id IS NULL").select("metric", F.col("target").alias("system"))
    rows = _long(window, "route_id").join(own, ["route_id", "metric"], "left").join(system, "metric", "left")
    return rows.select("route_id", "metric", "value", F.coalesce("own", "system").alias("target"), lower.alias("lower"))


def targets_table(window: DataFrame, targets: DataFrame) -> DataFrame:
    rows = _against_targets(window, targets)
    gap = F.when(F.col("lower"), F.col("value") - F.col("target")).otherwise(F.col("target") - F.col("value"))
    return rows.select("route_id", "metric", "value", "target", gap.alias("gap"))


def target_attainment(window: DataFrame, targets: DataFrame) -> DataFrame:
    rows = _against_targets(window, targets)
    share = labels.attainment(F.col("value"), F.col("target"), F.col("lower"))
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), share * 100))
    return rows.select("route_id", "metric", F.when(share.isNotNull(), pct).alias("attainment_pct"), labels.attainment_band(share).alias("band"))


def worst_metric(window: DataFrame, targets: DataFrame) -> DataFrame:
    """Each route's metric with the largest gap as a share of its target."""
    rows = _against_targets(window, targets)
    rows = rows.withColumn("gap_fraction", labels.gap_fraction(F.col("value"), F.col("target"), F.col("lower"))).filter("gap_fraction IS NOT NULL")
    return rows.groupBy("route_id").agg(F.max_by("metric", F.struct("gap_fraction", "metric")).alias("worst_metric"), F.max("gap_fraction").alias("gap_fraction"))


def routes_below_target(window: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: routes that miss at least one target, of those evaluated."""
    rows = _against_targets(window, targets).filter("value IS NOT NULL AND target IS NOT NULL")
    miss = F.when(F.col("lower"), F.col("value") > F.col("target")).otherwise(F.col("value") < F.col("target"))
    per = rows.groupBy("route_id").agg(F.max(miss.cast("int")).alias("below"))
    return per.agg(F.sum("below").alias("n_below"), F.count(F.lit(1)).alias("n_evaluated"))


def latest_nonnull(daily: DataFrame, value: str, *keys: str) -> DataFrame:
    return daily.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, "service_date").alias(value), F.max("service_date").alias("service_date"))


def weekly_summary(system: DataFrame, as_of: str) -> DataFrame:
    """metric: means of the last seven dates and the seven before, and change in percent."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("service_date"))
    rows = _long(system, "service_date")
    out = rows.groupBy("metric").agg(F.avg(F.when(age.between(0, 6), F.col("value"))).alias("current"), F.avg(F.when(age.between(7, 13), F.col("value"))).alias("prior"))
    return out.withColumn("pct_change", F.when(F.col("prior") != 0, (F.col("current") - F.col("prior")) / F.col("prior") * 100))


def catch_up_dates(dates: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Dates without runs, and yesterday."""
    yesterday = dates.sparkSession.range(1).select(F.date_sub(F.lit(as_of).cast("date"), 1).alias("service_date"))
    return dates.join(runs.select("service_date").distinct(), "service_date", "left_anti").union(yesterday).distinct()


def gtfs_freshness(snapshots: DataFrame, as_of: str) -> DataFrame:
    """The latest snapshot and the state of its feed's end date."""
    last = snapshots.agg(F.max_by(F.struct("snapshot_id", "feed_end_date"), "loaded_at").alias("s"), F.max("loaded_at").alias("loaded_at")).select("s.*", "loaded_at")
    return last.withColumn("status", labels.feed_expiry_status(F.col("feed_end_date"), as_of))


def ingest_freshness(positions: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """One row: pings of the last minutes and the newest ping."""
    recent = (F.col("timestamp") > now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("timestamp") <= now)
    return positions.agg(F.coalesce(F.sum(recent.cast("int")), F.lit(0)).alias("n_recent"), F.max("timestamp").alias("latest_ts"))


def profile_hash(rows: DataFrame, *keys: str) -> DataFrame:
    """SHA-256 of each group's rows in canonical order; differs iff the rows do."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})))), 256).alias("profile_hash"))

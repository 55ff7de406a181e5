"""Observed headways, excess wait time, bunching and its causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions import clock, labels
from fleetline.operators.runs import seconds_between

CELL = ["route_id", "direction_id", "stop_id", "hour"]
MAX_GAP = 7200
CAUSES = ("leader_late_only", "trailer_early_only", "both_off", "neither_off", "unknown")


def awt(sum_h: Column, sum_h2: Column) -> Column:
    """Average wait of passengers who come at random: sum of squares over twice the sum."""
    return F.when(sum_h > 0, sum_h2 / (2 * sum_h))


def observed_headways(stop_events: DataFrame, *, scheduled_only: bool = False, tz: str = clock.TZ) -> DataFrame:
    """(service_date, CELL, h_sec, leader_dev, trailer_dev) of consecutive trip-update arrivals.

    ``scheduled_only`` drops other relationships before pairing, as bunching needs; zero
    gaps are dropped after it.  One shuffle: later aggregations by cell reuse its keys.
    """
    rows = stop_events.filter("source = 'trip_update' AND observed_arrival_ts IS NOT NULL")
    rows = rows.filter("schedule_relationship = 'SCHEDULED'") if scheduled_only else rows
    w = Window.partitionBy("service_date", "route_id", "direction_id", "stop_id").orderBy("observed_arrival_ts", "trip_id", "stop_sequence")
    ts = F.col("observed_arrival_ts")
    out = rows.select(
        "service_date", "route_id", "direction_id", "stop_id", clock.local_hour(ts, tz).alias("hour"), seconds_between(ts, F.lead(ts).over(w)).alias("h_sec"),
        F.col("deviation_sec").alias("leader_dev"), F.lead("deviation_sec").over(w).alias("trailer_dev"),
    )
    return out.filter("h_sec > 0")


def service_cells(scheduled: DataFrame) -> DataFrame:
    """Per (service_id, CELL) of scheduled headways: sum, sum of squares, number and mean.

    What takes ``scheduled`` below takes this too: a table of it is small and spares several readers the timetable.
    """
    if "mean_h" in scheduled.columns:
        return scheduled
    h = F.col("h_sec").cast("long")
    return scheduled.groupBy("service_id", *CELL).agg(F.sum(h).alias("s_h"), F.sum(h * h).alias("s_h2"), F.count(F.lit(1)).alias("s_n"), F.avg("h_sec").alias("mean_h"))


def with_schedule(observed: DataFrame, scheduled: DataFrame, day_services: DataFrame) -> DataFrame:
    """Observed gaps with mean_h of their cell on the date's timetable.

    ``scheduled``: headways keyed by service_id; ``day_services``: (service_date, service_id).
    """
    cells = service_cells(scheduled).join(day_services, "service_id").drop("service_id")
    cells = cells.groupBy("service_date", *CELL).agg(F.avg("mean_h").alias("mean_h"))
    return observed.join(cells, ["service_date", *CELL])


def _frequent_cells(scheduled: DataFrame, day_services: DataFrame, gates: DataFrame | None) -> DataFrame:
    """Scheduled gaps of the cell-hours whose mean headway is within the route's gate, by date."""
    sums = service_cells(scheduled)
    sums = sums.join(gates, "route_id", "left") if gates is not None else sums.withColumn("gate_sec", F.lit(None).cast("int"))
    return sums.filter(F.col("mean_h") <= F.coalesce("gate_sec", F.lit(900))).join(day_services, "service_id").drop("service_id", "mean_h", "gate_sec")


def _ewt_sums(observed: DataFrame, scheduled: DataFrame, day_services: DataFrame, gates: DataFrame | None) -> DataFrame:
    """Per frequent (service_date, cell): sums of scheduled and observed gaps."""
    cells = _frequent_cells(scheduled, day_services, gates)
    obs = observed.groupBy("service_date", *CELL).agg(F.sum("h_sec").alias("o_h"), F.sum(F.col("h_sec") * F.col("h_sec")).alias("o_h2"), F.count(F.lit(1)).alias("o_n"))
    return cells.join(obs, ["service_date", *CELL], "left").fillna(0, ["o_h", "o_h2", "o_n"])


_SUMS = ["s_h", "s_h2", "s_n", "o_h", "o_h2", "o_n"]


def _ewt(df: DataFrame, *, clamp: bool) -> DataFrame:
    ewt = awt(F.col("o_h"), F.col("o_h2")) - awt(F.col("s_h"), F.col("s_h2"))
    return df.withColumns({"awt_sec": awt(F.col("o_h"), F.col("o_h2")), "swt_sec": awt(F.col("s_h"), F.col("s_h2")), "ewt_sec": F.when(ewt.isNotNull(), F.greatest(ewt, F.lit(0.0))) if clamp else ewt})


def ewt_headline(observed: DataFrame, scheduled: DataFrame, day_services: DataFrame, *, gates: DataFrame | None = None, period: str = "all") -> DataFrame:
    """(route_id, service_date): sums, AWT, SWT and EWT (not clamped) of frequent cell-hours."""
    rows = _ewt_sums(observed, scheduled, day_services, gates).filter(labels.hour_in_period(F.col("hour"), period))
    return _ewt(rows.groupBy("route_id", "service_date").agg(*[F.sum(c).alias(c) for c in _SUMS]), clamp=False)


def ewt_by_period(observed: DataFrame, scheduled: DataFrame, day_services: DataFrame, *, gates: DataFrame | None = None) -> DataFrame:
    """(route_id, service_date, period): EWT clamped at 0 and coverage; every period of a route's day."""
    rows = _ewt_sums(observed, scheduled, day_services, gates).withColumn("period", labels.ewt_period(F.col("hour")))
    rows = rows.groupBy("route_id", "service_date", "period").agg(*[F.sum(c).alias(c) for c in _SUMS])
    names = F.array(*[F.lit(p[0]) for p in labels.EWT_PERIODS])
    spine = rows.select("route_id", "service_date").distinct().select("*", F.explode(names).alias("period"))
    out = _ewt(spine.join(rows, ["route_id", "service_date", "period"], "left").fillna(0, _SUMS), clamp=True)
    return out.withColumn("coverage", F.when(F.col("s_n") > 0, F.least(F.lit(1.0), F.col("o_n") / F.col("s_n"))))


def bunching_pairs(observed: DataFrame, scheduled: DataFrame, day_services: DataFrame, *, share: float = 0.25, floor: float = 120.0, max_gap: int = MAX_GAP) -> DataFrame:
    """Observed gaps (of ``observed_headways(scheduled_only=True)``) with a flag for bunched ones."""
    rows = with_schedule(observed.filter(F.col("h_sec") <= max_gap), scheduled, day_services)
    return rows.withColumn("bunched", F.col("h_sec") < F.greatest(F.col("mean_h") * share, F.lit(floor)))


def _bunching(pairs: DataFrame, *keys: str) -> DataFrame:
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_headways"), F.sum(F.col("bunched").cast("int")).alias("n_bunched"))
    return out.withColumn("bunching_rate", F.col("n_bunched") / F.col("n_headways"))


def scheduled_cells(scheduled: DataFrame, day_services: DataFrame, *, gates: DataFrame | None = None) -> DataFrame:
    """(service_date, CELL) of each date's timetable: mean_h, and the sums of frequent services (s_n null without one)."""
    per = service_cells(scheduled)
    per = per.join(gates, "route_id", "left") if gates is not None else per.withColumn("gate_sec", F.lit(None).cast("int"))
    often = F.col("mean_h") <= F.coalesce("gate_sec", F.lit(900))
    sums = [F.sum(F.when(often, F.col(c))).alias(c) for c in ("s_h", "s_h2", "s_n")]
    return per.join(day_services, "service_id").groupBy("service_date", *CELL).agg(F.avg("mean_h").alias("mean_h"), *sums)


def headway_statistics(stop_events: DataFrame, cells: DataFrame, *, share: float = 0.25, floor: float = 120.0, max_gap: int = MAX_GAP, tz: str = clock.TZ) -> DataFrame:
    """(route_id, service_date): what ``ewt_headline`` and ``bunching_headline`` sum, from one pass over the events.

    Both gaps of an arrival (to the next one, and to the next scheduled one) come from one
    sort: backwards, where the arrivals to come are those before.  ``cells`` (of ``scheduled_cells``) is read twice: keep it.
    A date's services are pooled.
    """
    key, cell = ["service_date", "route_id", "direction_id", "stop_id"], ["service_date", *CELL]
    ts, back = F.col("observed_arrival_ts"), Window.partitionBy(*key).orderBy(F.desc("observed_arrival_ts"), F.desc("trip_id"), F.desc("stop_sequence"))
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    rows = stop_events.filter("source = 'trip_update' AND observed_arrival_ts IS NOT NULL").withColumn("on_plan", F.col("schedule_relationship") == "SCHEDULED")
    h, planned = seconds_between(ts, F.lag(ts).over(back)), seconds_between(ts, F.last(F.when(F.col("on_plan"), ts), ignorenulls=True).over(before))
    rows = rows.select(*key, clock.local_hour(ts, tz).alias("hour"), "on_plan", h.alias("h"), planned.alias("planned_h")).join(cells, cell)
    h, planned = F.when((F.col("h") > 0) & F.col("s_n").isNotNull(), F.col("h")), F.when(F.col("on_plan") & F.col("planned_h").between(1, max_gap), F.col("planned_h"))
    near = planned < F.greatest(F.col("mean_h") * share, F.lit(floor))
    seen = rows.groupBy("route_id", "service_date").agg(
        F.sum(h).alias("o_h"), F.sum(h * h).alias("o_h2"), F.count(h).alias("o_n"), F.count(planned).alias("n_headways"), F.sum(near.cast("int")).alias("n_bunched")
    )
    due = cells.filter("s_n IS NOT NULL").groupBy("route_id", "service_date").agg(*[F.sum(c).alias(c) for c in ("s_h", "s_h2", "s_n")])
    out = due.join(seen, ["route_id", "service_date"], "full").filter("s_n IS NOT NULL OR n_headways > 0")
    return out.fillna(0, [*_SUMS, "n_headways", "n_bunched"])


def bunching_headline(pairs: DataFrame, period: str = "all") -> DataFrame:
    return _bunching(pairs.filter(labels.hour_in_period(F.col("hour"), period)), "route_id", "service_date")


def bunching_by_period(pairs: DataFrame) -> DataFrame:
    return _bunching(pairs.withColumn("period", labels.ewt_period(F.col("hour"))), "route_id", "service_date", "period")


def bunching_cause(leader_dev: Column, trailer_dev: Column) -> Column:
    late, early = leader_dev > labels.LATEST, trailer_dev < labels.EARLIEST
    unknown = leader_dev.isNull() | trailer_dev.isNull()
    return F.when(unknown, "unknown").when(late & early, "both_off").when(late, "leader_late_only").when(early, "trailer_early_only").otherwise("neither_off")


def bunching_causes(pairs: DataFrame, *, day_type: str = "all", period: str = "all") -> DataFrame:
    """(route_id, cause): bunched pairs and their share; all five causes for every route with a pair."""
    rows = pairs.filter("bunched").filter(labels.hour_in_period(F.col("hour"), period))
    rows = rows if day_type == "all" else rows.filter(clock.day_type(F.col("service_date")) == day_type)
    n = rows.groupBy("route_id", bunching_cause(F.col("leader_dev"), F.col("trailer_dev")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    spine = n.select("route_id").distinct().select("route_id", F.explode(F.array(*[F.lit(c) for c in CAUSES])).alias("cause"))
    out = spine.join(n, ["route_id", "cause"], "left").fillna(0, ["n"])
    return out.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("route_id")))


def system_ewt_swt_bunching_daily(observed: DataFrame, pairs: DataFrame, scheduled: DataFrame, day_services: DataFrame, bus_routes: DataFrame, *, gates: DataFrame | None = None) -> DataFrame:
    """Per date, pooled over bus routes: EWT clamped at 0, SWT, bunching rate."""
    only = lambda df: df.join(bus_routes.select("route_id"), "route_id", "left_semi")
    ewt = _ewt(_ewt_sums(only(observed), only(scheduled), day_services, gates).groupBy("service_date").agg(*[F.sum(c).alias(c) for c in _SUMS]), clamp=True)
    return ewt.select("service_date", "ewt_sec", "swt_sec", "o_n").join(_bunching(only(pairs), "service_date"), "service_date", "full")

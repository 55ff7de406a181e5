"""Arrivals at stops from a stream of pings, inside the stream.

The timetable is static and indexed for the join: stops by route and grid cell (each stop
lies in its 3 x 3 cells, so a ping looks into one), visits by trip and stop.  A ping meets at most one
row of each and picks its nearest stop and its visit by array functions, so nothing is grouped
before the one stateful step: the first ping of each visit, kept per (service date, trip, visit)
until the watermark, which runs over service dates, has passed the date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetline.functions import clock, geo
from fleetline.operators.derive import resolve_service_anchor
from fleetline.operators.runs import exact_seconds_between, seconds_between
from fleetline.sources.dated import DatedTable
from fleetline.sources.scratch import keep
from fleetline.streaming.updates import merge_dates


def stop_grid(route_stops: DataFrame, max_m: float) -> tuple[DataFrame, float, float]:
    """(route_id, cy, cx, stops) and the cells' height and width in degrees; one number is read off the stops."""
    top = route_stops.agg(F.max(F.abs("stop_lat"))).first()[0] or 0.0
    dy = max_m / geo.DEGREE_M
    dx = route_stops.sparkSession.range(1).select(geo.cell_width(F.lit(float(top)), max_m)).first()[0]
    cells = route_stops.select("route_id", "stop_id", "stop_lat", "stop_lon", F.explode(geo.neighbour_cells(F.col("stop_lat"), F.col("stop_lon"), dy, dx)).alias("c"))
    grid = cells.groupBy("route_id", "c.cy", "c.cx").agg(F.collect_set(F.struct("stop_id", "stop_lat", "stop_lon")).alias("stops"))  # a route's stops within 3 x 3 cells
    return grid, dy, dx


def trip_visits(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(trip_id, stop_id, route_id, direction_id, visits): when a trip is due at a stop, in a loop more than once."""
    sec = clock.gtfs_seconds(F.coalesce("arrival_time", "departure_time"))
    due = stop_times.select("trip_id", "stop_id", "stop_sequence", sec.alias("sec")).filter("sec IS NOT NULL")
    due = due.groupBy("trip_id", "stop_id").agg(F.collect_list(F.struct("stop_sequence", "sec")).alias("visits"))
    return due.join(trips.select("trip_id", "route_id", "direction_id"), "trip_id")


@dataclass(frozen=True)
class Timetable:
    """The static side of the join, stored once so that no micro-batch makes it anew."""

    grid: DataFrame
    visits: DataFrame
    dy: float
    dx: float
    max_m: float


def index_timetable(trips: DataFrame, stop_times: DataFrame, route_stops: DataFrame, *, max_m: float = 50.0) -> Timetable:
    grid, dy, dx = stop_grid(route_stops, max_m)
    return Timetable(keep(grid, "stop-grid"), keep(trip_visits(trips, stop_times), "trip-visits"), dy, dx, max_m)


def passing_pings(pings: DataFrame, timetable: Timetable, *, tz: str = clock.TZ) -> DataFrame:
    """Pings (with service_date) near a stop that their trip serves, with the visit that is nearest in time; stateless.

    Columns of the visit: stop_sequence, anchor_date, scheduled_arrival_ts, dist_m.
    """
    cells = {"cy": geo.grid_cell(F.col("latitude"), timetable.dy), "cx": geo.grid_cell(F.col("longitude"), timetable.dx)}
    rows = pings.withColumns(cells).join(timetable.grid, ["route_id", "cy", "cx"]).drop("cy", "cx")
    far = lambda s: F.struct(geo.haversine_m(F.col("latitude"), F.col("longitude"), s["stop_lat"], s["stop_lon"]).alias("d"), s["stop_id"].alias("stop_id"))
    rows = rows.withColumn("near", F.array_min(F.transform("stops", far))).filter(F.col("near.d") <= timetable.max_m)
    rows = rows.select(*[c for c in pings.columns if c not in ("route_id", "direction_id")], F.col("near.stop_id").alias("stop_id"), F.col("near.d").alias("dist_m"))
    rows = rows.join(timetable.visits, ["trip_id", "stop_id"])

    def visit(v):
        date, due = resolve_service_anchor(F.col("timestamp"), F.col("service_date"), v["sec"], tz=tz)
        return F.struct(F.abs(exact_seconds_between(due, F.col("timestamp"))).alias("off"), v["stop_sequence"].alias("stop_sequence"), date.alias("anchor_date"), due.alias("due"))

    rows = rows.withColumn("visit", F.array_min(F.transform("visits", visit)))
    return rows.withColumns({"stop_sequence": F.col("visit.stop_sequence"), "anchor_date": F.col("visit.anchor_date"), "scheduled_arrival_ts": F.col("visit.due")}).drop("visits", "visit")


VISIT = ["service_date", "trip_id", "stop_sequence"]
#: what is stored of a visit: its first ping
ARRIVAL = (
    "service_date date, trip_id string, stop_sequence int, observed_arrival_ts timestamp_ntz, id long, vehicle_id string, stop_id string, route_id string, direction_id int, "
    "anchor_date date, scheduled_arrival_ts timestamp_ntz, match_distance_m double"
)
_REST = [c.split()[0] for c in ARRIVAL.split(", ")][3:]


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The earliest ping per key; of pings at one time the one with the smallest id."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*_REST)).alias("x"))


def live_arrivals(pings: DataFrame, timetable: Timetable, *, tz: str = clock.TZ, delay: str = "2 days") -> DataFrame:
    """First pings of visits (``ARRIVAL``) from a stream of pings (id, vehicle_id, trip_id, route_id, latitude, longitude, timestamp, service_date).

    To be written in update mode: a visit comes when its first ping does, and again if an earlier ping of
    it arrives.  Pings of service dates more than ``delay`` before the newest are dropped as late, and
    the state of those dates with them.
    """
    rows = pings.withColumn("service_day", F.col("service_date").cast("timestamp")).withWatermark("service_day", delay)
    rows = passing_pings(rows, timetable, tz=tz)
    rows = rows.withColumnsRenamed({"timestamp": "observed_arrival_ts", "dist_m": "match_distance_m"})
    return _first(rows, "service_day", "trip_id", "stop_sequence").select(F.to_date("service_day").alias("service_date"), "trip_id", "stop_sequence", "x.*")


def store_arrivals(arrivals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a stream of arrivals as a table by service date below ``path``; a micro-batch opens its dates alone, and a replay changes nothing."""
    table = DatedTable(arrivals.sparkSession, path, ARRIVAL)

    def step(batch: DataFrame, number: int) -> None:
        merge_dates(table, batch, number, lambda rows: _first(rows, *VISIT).select(*VISIT, "x.*"))

    return arrivals.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """The stop events of a table of arrivals; equals ``derive_stop_events_proximity`` of the pings that were not too late."""
    return DatedTable(spark, path, ARRIVAL).read().select(
        F.col("anchor_date").alias("service_date"), "trip_id", "route_id", "direction_id", "vehicle_id", "stop_id", "stop_sequence", "scheduled_arrival_ts", "observed_arrival_ts",
        seconds_between(F.col("scheduled_arrival_ts"), F.col("observed_arrival_ts")).cast("int").alias("deviation_sec"), F.lit("proximity").alias("source"), F.lit("SCHEDULED").alias("schedule_relationship"),
        "match_distance_m",
    )

"""Trip-update state, poll dedupe, minute coverage and service windows, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from fleetline.functions import clock
from fleetline.sources.dated import DatedTable

STATE_KEY = ["trip_id", "stop_sequence", "service_date"]
UPDATE = "snapshot_ts timestamp_ntz, line_no long, trip_id string, stop_sequence int, stop_id string, vehicle_id string, schedule_relationship string, predicted_arrival_ts timestamp_ntz, trip_start_date string"


def update_stream(spark: SparkSession, path: str, schema: str = UPDATE, *, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: one poll of the trip-update feed as a JSON line
POLL = (
    "header struct<timestamp:long>, entity array<struct<trip_update:struct<trip:struct<trip_id:string,route_id:string,start_date:string>,vehicle:struct<id:string>,"
    "stop_time_update:array<struct<stop_sequence:int,stop_id:string,arrival:struct<time:long>,departure:struct<time:long>,schedule_relationship:string>>>>>"
)


def poll_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1) -> DataFrame:
    """Polls as JSON lines arrive; a line that can't be read has its text in ``_corrupt_record`` and nothing else."""
    reader = spark.readStream.schema(f"{POLL}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def flatten_polls(polls: DataFrame) -> DataFrame:
    """One row per stop-time update of the polls, epoch seconds as UTC; ``line_no`` is its place in the poll.

    Entities without a trip update and updates without a stop are left out; empty ids are null; a
    poll without a time has that of its reading; an unstated relationship is UNSET.
    """
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    sent = F.coalesce(F.when(F.col("header.timestamp") > 0, at(F.col("header.timestamp"))), F.current_timestamp().cast("timestamp_ntz"))
    rows = polls.select(sent.alias("snapshot_ts"), F.posexplode("entity").alias("e", "entity")).select("snapshot_ts", "e", F.col("entity.trip_update").alias("t")).filter("t IS NOT NULL")
    rows = rows.select("snapshot_ts", "e", "t", F.posexplode("t.stop_time_update").alias("s", "u")).filter("u.stop_id IS NOT NULL AND u.stop_id <> ''")
    return rows.select(
        "snapshot_ts", (F.col("e").cast("long") * (1 << 24) + F.col("s")).alias("line_no"), text("t.trip.trip_id").alias("trip_id"), text("t.trip.route_id").alias("route_id"), F.col("u.stop_sequence").alias("stop_sequence"),
        F.col("u.stop_id").alias("stop_id"), text("t.vehicle.id").alias("vehicle_id"), F.coalesce("u.schedule_relationship", F.lit("UNSET")).alias("schedule_relationship"),
        at(F.col("u.arrival.time")).alias("predicted_arrival_ts"), at(F.col("u.departure.time")).alias("predicted_departure_ts"), text("t.trip.start_date").alias("trip_start_date"),
    )


def ingest_polls(polls: DataFrame, path: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Write the updates of a stream of polls below ``path``, and lines that can't be read below ``quarantine``.

    Each micro-batch has a folder of its own in both, which a replay overwrites.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the corrupt column can't be read alone from JSON files
        flatten_polls(batch.filter("_corrupt_record IS NULL")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.filter("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("value")).write.mode("overwrite").text(f"{quarantine}/batch={number}")
        batch.unpersist()

    return polls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


POSITION = "vehicle_id string, trip_id string, route_id string, direction_id int, trip_start_date string, latitude double, longitude double, speed double, stop_id string, current_stop_sequence int, current_status int, timestamp long"


def position_stream(spark: SparkSession, path: str, schema: str = POSITION, *, files_per_batch: int = 1) -> DataFrame:
    """Pings as files arrive; their epoch seconds become UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("timestamp", F.timestamp_seconds("timestamp").cast("timestamp_ntz"))


def with_service_date(updates: DataFrame, tz: str = clock.TZ) -> DataFrame:
    """The trip's start date, else the local date of the snapshot."""
    return updates.withColumn("service_date", F.coalesce(clock.parse_service_date(F.col("trip_start_date")), clock.local_date(F.col("snapshot_ts"), tz)))


def poll_dedupe(updates: DataFrame, tz: str = clock.TZ) -> DataFrame:
    """Last row per key of one poll (of one snapshot_ts)."""
    rows = with_service_date(updates, tz)
    nth = F.row_number().over(Window.partitionBy("snapshot_ts", *STATE_KEY).orderBy(F.desc("line_no")))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth")


def first_delivery(updates: DataFrame, delay: str = "1 day", tz: str = clock.TZ) -> DataFrame:
    """A stream of updates without those that a poll delivers again: the same row of the same snapshot.

    State is kept for ``delay`` of event time.  A repeat within it is dropped; one that comes later is
    behind the watermark and is dropped as late, with no state needed.  Whatever is let through is let
    through at once; which of two rows of a key in one snapshot is the last is for ``poll_dedupe``.
    """
    rows = with_service_date(updates, tz).withColumn("event_time", F.col("snapshot_ts").cast("timestamp")).withWatermark("event_time", delay)
    return rows.dropDuplicatesWithinWatermark(["snapshot_ts", *STATE_KEY, "line_no"])


#: field -> its order key in the partial state
_FIELDS = {"stop_id": "seen", "final_schedule_relationship": "seen", "last_predicted_arrival_ts": "pred_at", "vehicle_id": "vehicle_at"}


def partial_state(updates: DataFrame, tz: str = clock.TZ) -> DataFrame:
    """Each update as a state of its own: every field with the order key of its last value."""
    at = F.struct(F.col("snapshot_ts").alias("ts"), F.col("line_no").alias("line"))
    rows = with_service_date(updates, tz)
    return rows.select(
        *STATE_KEY, at.alias("seen"), "stop_id", F.col("schedule_relationship").alias("final_schedule_relationship"),
        F.when(F.col("predicted_arrival_ts").isNotNull(), at).alias("pred_at"), F.col("predicted_arrival_ts").alias("last_predicted_arrival_ts"),
        F.when(F.col("vehicle_id").isNotNull(), at).alias("vehicle_at"), "vehicle_id",
    )


def merge_state(parts: DataFrame) -> DataFrame:
    """Fold partial states.  Associative and free of order, so batches merge in any way."""
    last = lambda field, at: F.max_by(field, F.when(F.col(at).isNotNull(), F.col(at))).alias(field)
    return parts.groupBy(*STATE_KEY).agg(*[F.max(a).alias(a) for a in ("seen", "pred_at", "vehicle_at")], *[last(f, a) for f, a in _FIELDS.items()])


def state_table(state: DataFrame) -> DataFrame:
    """The stored schema of a folded state."""
    return state.select(
        *STATE_KEY, "stop_id", "vehicle_id", F.col("seen.ts").alias("final_snapshot_ts"), "final_schedule_relationship", F.col("pred_at.ts").alias("last_pred_snapshot_ts"), "last_predicted_arrival_ts",
        F.col("vehicle_at.ts").alias("last_vehicle_ts"),
    )


def trip_update_state_fold(updates: DataFrame, tz: str = clock.TZ) -> DataFrame:
    """Last-known state per (trip_id, stop_sequence, service_date)."""
    return state_table(merge_state(partial_state(updates, tz)))


def replay_date(updates: DataFrame, date: str, tz: str = clock.TZ) -> DataFrame:
    """Fold one service date from the UTC days that hold it: the date and the next."""
    day = F.lit(date).cast("date")
    rows = updates.filter(F.to_date("snapshot_ts").between(day, F.date_add(day, 1)))
    return trip_update_state_fold(with_service_date(rows, tz).filter(F.col("service_date") == day).drop("service_date"), tz)


def merge_dates(table: DatedTable, batch: DataFrame, number: int, fold) -> list[str]:
    """Fold a micro-batch into the dates it holds; no file of another date is opened or written.

    A batch that runs again merges into the same predecessor, so the result is the same.
    """
    batch = batch.persist()
    dates = [r["service_date"] for r in batch.select("service_date").distinct().collect()]  # a handful: the dates of one batch
    old = table.read(dates, before=number)
    written = table.replace(fold(batch.select(*old.columns).unionByName(old)), dates, version=number) if dates else []
    batch.unpersist()
    return written


def read_versions(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a stream's table below ``path`` holds now."""
    return DatedTable(spark, path, schema).read()


def state_schema(spark: SparkSession, tz: str = clock.TZ):
    return merge_state(partial_state(spark.createDataFrame([], UPDATE), tz)).schema


def fold_stream(updates: DataFrame, path: str, checkpoint: str, *, tz: str = clock.TZ) -> StreamingQuery:
    """Fold a stream of updates into a table of partial states below ``path``, date by date.

    The state lives in the table, not in the engine, so retention can age it by service date.
    """
    table = DatedTable(updates.sparkSession, path, state_schema(updates.sparkSession, tz))

    def step(batch: DataFrame, number: int) -> None:
        merge_dates(table, merge_state(partial_state(batch, tz)), number, merge_state)

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_coverage(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows per tumbling minute; on a stream with a two-hour watermark."""
    rows = rows.withColumn("event_time", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("event_time", "2 hours") if rows.isStreaming else rows
    return rows.groupBy(F.window("event_time", "1 minute")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "n")


def archive_stream(rows: DataFrame, path: str, checkpoint: str, ts: str = "timestamp") -> StreamingQuery:
    """Append raw rows to a folder per UTC date."""
    return rows.withColumn("date", F.to_date(ts)).writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_minutes(rows: DataFrame, path: str, checkpoint: str, ts: str = "timestamp") -> StreamingQuery:
    """Append each minute with its rows to ``path`` once the watermark has passed it: every minute is written once.

    Minutes of the last two hours of a stream stay open until later rows come.
    """
    return minute_coverage(rows, ts).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within_service_window(positions: DataFrame, date: Column, tz: str = clock.TZ) -> DataFrame:
    """Pings from midnight of their service date to 48 hours later.

    On a stream the rest is counted as it goes by: metrics ``service_window`` of the query's progress hold
    n_kept, n_late (after the window), n_phantom (before it) and n_undated.
    """
    a, _, c = clock.local_day_bounds(date, tz)
    at = F.col("timestamp")
    if positions.isStreaming:
        n = lambda what, name: F.count(F.when(what, 1)).alias(name)
        undated = at.isNull() | a.isNull()
        positions = positions.observe("service_window", n((at >= a) & (at < c), "n_kept"), n(at >= c, "n_late"), n(at < a, "n_phantom"), n(undated, "n_undated"))
    return positions.filter((at >= a) & (at < c))


def observed_sums(query: StreamingQuery, name: str) -> dict[str, int]:
    """Sums over a query's micro-batches of the metrics it observes under ``name``.

    Spark keeps the progress of the last 100 batches; a longer run needs a listener, and is refused here.
    """
    progress = query.recentProgress
    if progress and progress[0].batchId > 0:
        raise ValueError("the progress of the first batches is gone")
    out: dict[str, int] = {}
    seen = set()
    for p in progress:
        found = p.observedMetrics.get(name)
        if found is not None and p.batchId not in seen:
            seen.add(p.batchId)
            for k, v in found.asDict().items():
                out[k] = out.get(k, 0) + (v or 0)
    return out


def first_arrivals(events: DataFrame) -> DataFrame:
    """First observation per visit: a fold, so streams merge it like the trip-update state."""
    key = ["service_date", "trip_id", "stop_sequence"]
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), "observed_arrival_ts").alias("x")).select(*key, "x.*")


def live_proximity_arrivals(positions: DataFrame, derive, schema, path: str, checkpoint: str) -> StreamingQuery:
    """Arrivals from a stream of pings: ``derive`` makes events (of ``schema``) of a micro-batch, which merge by first observation."""
    table = DatedTable(positions.sparkSession, path, schema)

    def step(batch: DataFrame, number: int) -> None:
        merge_dates(table, first_arrivals(derive(batch)), number, first_arrivals)

    return positions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

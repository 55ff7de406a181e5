"""Reading feeds and archives, snapshots, keyed merges, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Columns of the static feed's files; * marks those that must be there.
GTFS = {
    "routes": "route_id* route_short_name route_long_name route_type",
    "stops": "stop_id* stop_name stop_lat:double stop_lon:double",
    "trips": "trip_id* route_id* service_id* trip_headsign block_id shape_id direction_id:int",
    "stop_times": "trip_id* stop_id* arrival_time departure_time stop_sequence*:int timepoint:int",
    "calendar": "service_id* monday:int tuesday:int wednesday:int thursday:int friday:int saturday:int sunday:int start_date end_date",
    "calendar_dates": "service_id* date* exception_type*:int",
    "shapes": "shape_id* shape_pt_lat:double shape_pt_lon:double shape_pt_sequence:int",
    "timepoints": "stop_id* stop_lat:double stop_lon:double",
    "feed_info": "feed_publisher_name feed_start_date feed_end_date",
    "agency": "agency_id agency_name agency_timezone",
}
OPTIONAL = {"calendar", "calendar_dates", "shapes", "timepoints", "feed_info", "agency"}


def _spec(table: str) -> list[tuple[str, str, bool]]:
    out = []
    for item in GTFS[table].split():
        name, _, kind = item.partition(":")
        out.append((name.rstrip("*"), kind or "string", "*" in item))
    return out


def gtfs_read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Typed tables of a feed folder.  Optional files may be missing (empty table); a missing
    required file or column is an error that names it.  A byte-order mark is ignored."""
    from pyspark.errors import AnalysisException

    out = {}
    for table in GTFS:
        spec = _spec(table)
        try:
            raw = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
        except AnalysisException:
            if table not in OPTIONAL:
                raise FileNotFoundError(f"{table}.txt is missing") from None
            out[table] = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k, _ in spec))
            continue
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
        for name, _, needed in spec:
            if needed and name not in raw.columns:
                raise ValueError(f"{table}.txt has no column {name}")
        out[table] = raw.select(*[(F.trim(F.col(n)).try_cast(k) if n in raw.columns else F.lit(None).cast(k)).alias(n) for n, k, _ in spec])
    return out


def apply_snapshot(current: DataFrame, fresh: DataFrame, snapshot_id: int, now) -> DataFrame:
    """Close the current rows of a versioned table and append a new snapshot's."""
    is_now = F.col("is_current")
    closed = current.withColumns({"valid_to": F.when(is_now, now).otherwise(F.col("valid_to")), "is_current": F.lit(False)})
    added = fresh.withColumns({"snapshot_id": F.lit(snapshot_id), "valid_from": now, "valid_to": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True)})
    return closed.unionByName(added.select(*current.columns))


def snapshot_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: number of rows per table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = n if out is None else out.crossJoin(n)
    return out


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Last write wins per key: ``new`` replaces rows of ``old``; repeated keys of ``new`` keep the last by ``order``."""
    if order:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
        new = new.withColumn("nth", nth).filter("nth = 1").drop("nth")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def retention_filter(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days``; the predicate reaches the scan (partition pruning)."""
    return df.filter(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def backfill(trips: DataFrame, fresh: DataFrame) -> DataFrame:
    """shape_id and block_id of a fresh feed where it has them."""
    new = fresh.select("trip_id", F.col("shape_id").alias("n_shape"), F.col("block_id").alias("n_block")).dropDuplicates(["trip_id"])
    out = trips.join(new, "trip_id", "left")
    return out.withColumns({"shape_id": F.coalesce("n_shape", "shape_id"), "block_id": F.coalesce("n_block", "block_id")}).select(*trips.columns)


def days_to_archive(positions: DataFrame, cutoff) -> DataFrame:
    """UTC days with at least one row older than the cutoff."""
    return positions.groupBy(F.to_date("timestamp").alias("day")).agg(F.min("timestamp").alias("m")).filter(F.col("m") < cutoff).select("day")


def archive_rows(positions: DataFrame, cutoff) -> DataFrame:
    """Every row of the days to archive: such days go whole."""
    return positions.withColumn("day", F.to_date("timestamp")).join(days_to_archive(positions, cutoff), "day", "left_semi")


#: rows of an archive file, about
ARCHIVE_ROWS = 2_000_000


def archive_write(positions: DataFrame, cutoff, path: str, *, rows_per_file: int = ARCHIVE_ROWS) -> None:
    """Sorted zstd Parquet files per day: ranges of (day, timestamp, id), so that a hot day goes through
    several tasks and its files follow each other in time.  Only the days written are replaced."""
    rows = archive_rows(positions, cutoff).drop("day").withColumn("day", F.to_date("timestamp"))
    n = rows.count()
    rows = rows.repartitionByRange(max(1, -(-n // rows_per_file)), "day", "timestamp", "id").sortWithinPartitions("day", "timestamp", "id")
    rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def archive_files(archive: DataFrame) -> DataFrame:
    """(day, file, n, first_ts, last_ts) of an archive's files, in order of time."""
    out = archive.groupBy("day", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return out.orderBy("day", "first_ts", "last_ts")


def archive_verify(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Rows per archived day on both sides, files of the day, and whether counts agree and files don't overlap in time."""
    n = lambda df, name: df.groupBy("day").agg(F.count(F.lit(1)).alias(name))
    files = archive_files(archive).withColumn("before", F.lag("last_ts").over(Window.partitionBy("day").orderBy("first_ts", "last_ts")))
    files = files.groupBy("day").agg(F.sum("n").alias("archived"), F.count(F.lit(1)).alias("n_files"), F.min(F.coalesce(F.col("before") <= F.col("first_ts"), F.lit(True))).alias("in_order"))
    out = files.join(n(source.withColumn("day", F.to_date("timestamp")), "kept"), "day", "left")
    return out.withColumn("ok", F.coalesce((F.col("archived") == F.col("kept")) & F.col("in_order"), F.lit(False)))


def archive_load(current: DataFrame, archive: DataFrame) -> DataFrame:
    """Restore archived rows whose id isn't there."""
    return current.unionByName(archive.select(*current.columns).join(current.select("id"), "id", "left_anti"))


def archive_and_expire(positions: DataFrame, cutoff, path: str) -> DataFrame:
    """Archive the expired days, check the counts, then give the rows that stay; refuses on a mismatch."""
    archive_write(positions, cutoff, path)
    spark = positions.sparkSession
    bad = archive_verify(archive_rows(positions, cutoff).drop("day"), spark.read.parquet(path)).filter("NOT ok").count()
    if bad:
        raise RuntimeError(f"{bad} archived days don't hold the source's rows; nothing was dropped")
    return positions.withColumn("day", F.to_date("timestamp")).join(days_to_archive(positions, cutoff), "day", "left_anti").drop("day")


TU_JSON = "snapshot_ts string, trip_id string, route_id string, vehicle_id string, stop_id string, stop_sequence int, predicted_arrival_ts long, predicted_departure_ts long, schedule_relationship string, trip_start_date string"


def tu_jsonl_read(spark: SparkSession, path: str) -> DataFrame:
    """Trip-update lines (plain, .gz or .zst); rows without stop_sequence are dropped."""
    rows = spark.read.schema(TU_JSON).json(path).filter("stop_sequence IS NOT NULL")
    at = lambda c: F.when(F.col(c).isNotNull(), F.timestamp_seconds(c).cast("timestamp_ntz"))
    return rows.withColumns({"snapshot_ts": F.to_timestamp_ntz("snapshot_ts"), "predicted_arrival_ts": at("predicted_arrival_ts"), "predicted_departure_ts": at("predicted_departure_ts")})


def tu_jsonl_to_parquet(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Merge files whose columns drift; a column that one lacks is null there."""
    spark.read.json(paths).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def dim_config(spark: SparkSession, tiers: dict[str, str], targets: dict[str, float], route_targets: dict[tuple[str, str], float]) -> tuple[DataFrame, DataFrame]:
    """Tier table (route_id, tier, gate_sec) and target table (route_id or null, metric, target)."""
    t = spark.createDataFrame([(r, k, 1200 if k == "medium" else 900) for r, k in sorted(tiers.items())], "route_id string, tier string, gate_sec int")
    rows = [(None, m, float(x)) for m, x in sorted(targets.items())] + [(r, m, float(x)) for (r, m), x in sorted(route_targets.items())]
    return t, spark.createDataFrame(rows, "route_id string, metric string, target double")

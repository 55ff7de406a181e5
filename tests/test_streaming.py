"""Streams give what the batch folds give, whatever the order of the files."""

from datetime import timedelta

from pyspark.sql import functions as F

from fleetline.operators.derive import derive_stop_events_proximity
from fleetline.plans.fixtures import Fixture
from fleetline.plans.schedule_queries import route_stops
from fleetline.sources.dated import KEEP, DatedTable
from fleetline.streaming import live, updates

DIR = "/root/testdata/sf0.001"


def _files(df, path, n, seed):
    df.repartition(n, F.xxhash64(F.lit(seed), *df.columns[:2])).write.parquet(path)


def _rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_state_fold_streams_as_it_batches(spark, tmp_path):
    feed = Fixture(spark, DIR).trip_updates.select(*[f.strip().split()[0] for f in updates.UPDATE.split(",")])
    _files(feed, str(tmp_path / "in"), 4, 3)
    q = updates.fold_stream(updates.update_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    state = updates.read_versions(spark, str(tmp_path / "state"), updates.state_schema(spark))
    want = updates.trip_update_state_fold(feed)
    got = updates.state_table(state)
    assert want.count() > 100 and _rows(got, want.columns) == _rows(want, want.columns)
    # a batch that runs again changes nothing
    again = updates.merge_state(state.unionByName(updates.partial_state(feed)))
    assert _rows(updates.state_table(again), want.columns) == _rows(want, want.columns)


def test_live_arrivals_stream_as_they_batch(spark, tmp_path):
    fx = Fixture(spark, DIR)
    events = fx.stop_events.filter("source = 'proximity'").withColumn("observed_arrival_ts", F.col("observed_arrival_ts"))
    twice = events.unionByName(events.withColumn("observed_arrival_ts", F.col("observed_arrival_ts") + F.expr("INTERVAL 1 MINUTE")))
    _files(twice, str(tmp_path / "in"), 3, 5)
    stream = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates.live_proximity_arrivals(stream, lambda b: b, twice.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = updates.read_versions(spark, str(tmp_path / "out"), twice.schema)
    versions = [p.parent.name for p in (tmp_path / "out/data").glob("v=*/service_date=2024-01-02")]
    assert 1 <= len(versions) <= KEEP
    assert _rows(got, events.columns) == _rows(events, events.columns)


def test_minutes_and_archive_streams(spark, tmp_path):
    pos = Fixture(spark, DIR).positions
    _files(pos, str(tmp_path / "in"), 2, 1)
    read = lambda: spark.readStream.schema(pos.schema).parquet(str(tmp_path / "in"))
    q = updates.minute_coverage(read()).writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert _rows(spark.table("minutes"), ["minute", "n"]) == _rows(updates.minute_coverage(pos), ["minute", "n"])
    updates.archive_stream(read(), str(tmp_path / "arch"), str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "arch")).count() == pos.count()
    late = updates.within_service_window(read(), F.to_date("timestamp"))
    q = late.select("id").writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("late").count() == updates.within_service_window(pos, F.to_date("timestamp")).count()


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _updates(spark, rows):
    """(seconds since 2024-01-02 12:00, line_no, trip_id, stop_sequence)"""
    at = F.timestamp_seconds(F.lit(1704196800) + F.col("s")).cast("timestamp_ntz")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("stop_id", "string"), ("vehicle_id", "string"), ("schedule_relationship", "string"), ("predicted_arrival_ts", "timestamp_ntz"), ("trip_start_date", "string"))]
    df = spark.createDataFrame(rows, "s long, line_no long, trip_id string, stop_sequence int").select(at.alias("snapshot_ts"), "line_no", "trip_id", "stop_sequence", *none)
    return df.select(*[c.split()[0] for c in updates.UPDATE.split(", ")])


def _steps(spark, path, dfs):
    for df in dfs:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(dfs[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _dropped_late(query):
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def test_repeats_inside_the_watermark_and_behind_it_are_dropped(spark, tmp_path):
    hour = 3600
    first = _updates(spark, [(0, 1, "a", 1), (0, 2, "b", 1), (0, 1, "a", 1)])  # a repeat in one file
    again = _updates(spark, [(0, 2, "b", 1), (10 * hour, 1, "a", 1)])  # a repeat in the next
    later = _updates(spark, [(100 * hour, 1, "a", 1)])
    next_ = _updates(spark, [(100 * hour + 60, 3, "c", 1)])  # rows count as late from the batch after the one that a watermark starts with
    behind = _updates(spark, [(0, 1, "a", 1), (99 * hour, 1, "a", 1)])  # a repeat when the state is gone, and a row that is late but in time
    stream = updates.first_delivery(_steps(spark, str(tmp_path / "in"), [first, again, later, next_, behind]), "1 day")
    q = stream.writeStream.format("memory").queryName("delivered").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r.snapshot_ts), r.line_no, r.trip_id) for r in spark.table("delivered").collect())
    assert got == [("2024-01-02 12:00:00", 1, "a"), ("2024-01-02 12:00:00", 2, "b"), ("2024-01-02 22:00:00", 1, "a"), ("2024-01-06 15:00:00", 1, "a"), ("2024-01-06 16:00:00", 1, "a"), ("2024-01-06 16:01:00", 3, "c")]
    assert _dropped_late(q) == 1
    assert [s.numRowsTotal for s in q.recentProgress[-1].stateOperators] == [3]  # state of the last day alone


def test_closed_minutes_are_written_once_and_open_ones_not(spark, tmp_path):
    at = lambda *secs: _ntz(spark.createDataFrame([(1704196800 + s,) for s in secs], "s long").select(F.timestamp_seconds("s").alias("timestamp")), "timestamp")
    stream = _steps(spark, str(tmp_path / "in"), [at(5, 50, 70), at(61, 0), at(7200 + 200), at(7200 + 201), at(0, 7200 + 100)])
    updates.closed_minutes(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted((str(r.minute), r.n) for r in spark.read.schema("minute timestamp_ntz, n long").parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-02 12:00:00", 3), ("2024-01-02 12:01:00", 2)]  # the ping that came when its minute was closed isn't counted again


def test_service_window_counts_what_it_drops(spark, tmp_path):
    hours = [("a", 4), ("b", 5), ("c", 52), ("d", 53), ("e", 100), ("f", None)]  # since midnight UTC of the service date
    rows = _ntz(spark.createDataFrame(hours, "id string, h int").select("id", F.timestamp_seconds(F.lit(1704153600) + F.col("h") * 3600).alias("timestamp")), "timestamp")
    stream = updates.within_service_window(_steps(spark, str(tmp_path / "in"), [rows.filter("id < 'd'"), rows.filter("id >= 'd'")]), F.lit("2024-01-02").cast("date"))
    q = stream.select("id").writeStream.format("memory").queryName("window").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("window").collect()) == ["b", "c"]
    assert updates.observed_sums(q, "service_window") == {"n_kept": 2, "n_late": 2, "n_phantom": 1, "n_undated": 1}


def test_polls_are_flattened_and_bad_lines_set_aside(spark, tmp_path):
    lines = [
        '{"header":{"timestamp":1704196800},"entity":[{"trip_update":{"trip":{"trip_id":"t1","start_date":"20240102"},"vehicle":{"id":""},"stop_time_update":[{"stop_id":"s1","stop_sequence":1,"arrival":{"time":1704196860}},{"stop_id":"","stop_sequence":2},{"stop_id":"s3","schedule_relationship":"SKIPPED"}]}},{"alert":{}}]}',
        '{"header": {"timestamp": 17',
        '{"header":{"timestamp":1704196830},"entity":[{"trip_update":{"trip":{"trip_id":""},"stop_time_update":[{"stop_id":"s9","departure":{"time":1704196899}}]}}]}',
        '{"header":{"timestamp":1704196831},"entity":[]}',
    ]
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text("\n".join(lines[2 * i : 2 * i + 2]) + "\n")
    q = updates.ingest_polls(updates.poll_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = [(str(r.snapshot_ts), r.line_no, r.trip_id, r.stop_id, r.stop_sequence, r.vehicle_id, r.schedule_relationship, r.predicted_arrival_ts and str(r.predicted_arrival_ts), r.trip_start_date) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("snapshot_ts", "line_no").collect()]
    assert got == [
        ("2024-01-02 12:00:00", 0, "t1", "s1", 1, None, "UNSET", "2024-01-02 12:01:00", "20240102"), ("2024-01-02 12:00:00", 2, "t1", "s3", None, None, "SKIPPED", None, "20240102"),
        ("2024-01-02 12:00:30", 0, None, "s9", None, None, "UNSET", None, None),
    ]
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect()] == [lines[1]]


def test_fold_opens_the_dates_of_its_batch_alone(spark, tmp_path, monkeypatch):
    day = 86_400
    feed = [_updates(spark, [(d * day, 1, "t", 1) for d in range(6)]), _updates(spark, [(2 * day + 60, 1, "t", 1)])]
    opened = []
    read = DatedTable.read
    monkeypatch.setattr(DatedTable, "read", lambda self, *a, **b: opened.append(read(self, *a, **b)) or opened[-1])
    updates.fold_stream(_steps(spark, str(tmp_path / "in"), feed), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(120)
    files = opened[-1].inputFiles()
    assert files and {f.split("service_date=")[1][:10] for f in files} == {"2024-01-04"}
    state = updates.read_versions(spark, str(tmp_path / "state"), updates.state_schema(spark))
    assert state.count() == 6 and state.filter("service_date = date'2024-01-04'").first().seen.ts.minute == 1


def test_live_arrivals_keep_the_first_ping_and_drop_what_is_too_late(spark, tmp_path):
    fx = Fixture(spark, DIR)
    pings = fx.positions.select("id", "vehicle_id", "trip_id", "route_id", "latitude", "longitude", "timestamp", F.to_date("timestamp").alias("service_date"))
    near = derive_stop_events_proximity(pings, fx.trips, fx.stop_times, route_stops(fx))
    visit = near.orderBy("observed_arrival_ts").first()
    one = pings.filter((F.col("trip_id") == visit.trip_id) & (F.col("timestamp") == F.lit(visit.observed_arrival_ts).cast("timestamp_ntz"))).limit(1)
    shift = lambda minutes, id_: one.withColumns({"timestamp": F.col("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES"), "id": F.lit(id_).cast("long")})
    mark = lambda days: shift(days * 1440, 0).withColumns({"trip_id": F.lit("none"), "service_date": F.to_date("timestamp")})
    read = lambda: [(r.trip_id, r.observed_arrival_ts) for r in live.stored_arrivals(spark, str(tmp_path / "out")).collect()]

    timetable = live.index_timetable(fx.trips, fx.stop_times, route_stops(fx))

    def arrive(*files):
        stream = live.live_arrivals(_steps(spark, str(tmp_path / "in"), list(files)), timetable, delay="1 day")
        q = live.store_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(180)
        return q

    minute = lambda n: visit.observed_arrival_ts + timedelta(minutes=n)
    arrive(shift(1, 11))
    assert read() == [(visit.trip_id, minute(1))]  # told at once
    arrive(shift(0, 10).unionByName(shift(2, 12)).unionByName(shift(0, 13)))
    assert read() == [(visit.trip_id, minute(0))]  # an earlier ping takes its place
    q = arrive(mark(3), mark(3), shift(-1, 9), mark(4))  # one a minute earlier comes when its date has passed
    assert read() == [(visit.trip_id, minute(0))] and _dropped_late(q) == 1
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal == 0  # the visit is forgotten

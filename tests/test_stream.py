"""Streams over several files: late rows, repeated polls, replays."""

import datetime as dt
import uuid
from functools import partial

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.schema import fields
from airgrid.session import shared_dir
from airgrid.sources import snapshots
from airgrid.sources.writers import stored
from airgrid.streaming import jobs, keyed

T0 = dt.datetime(2024, 1, 1)
KIND = fields(station=T.StringType(), time=T.TimestampNTZType(), value=T.DoubleType())


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def land(spark, folder, *files):
    """One JSON file per list of (station, hours, value), in order."""
    for rows in files:
        df = spark.createDataFrame([(s, at(h), v) for s, h, v in rows], "station STRING, time TIMESTAMP_NTZ, value DOUBLE")
        df.coalesce(1).write.mode("append").json(folder)


def place(spark):
    return f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"


def opened(spark, folder):
    return jobs.read_landed(spark, folder, KIND, "json", files_per_trigger=1)


def test_hourly_means_equal_the_batch_result_and_drop_late_rows(spark):
    src = place(spark)
    land(spark, src, [("A", 0.1, 1.0), ("A", 0.5, 3.0)], [("A", 3.0, 5.0)], [("A", 3.5, 5.0)], [("A", 0.2, 100.0), ("A", 2.5, 7.0)], [("A", 9.0, 0.0)])
    got = jobs.run_to_table(jobs.hourly_means(opened(spark, src), ["station"]), place(spark))
    rows = {r.hour.hour: (r.mean_value, r.n) for r in got.collect()}
    # Spark drops by the watermark of the batch before, so the row for hour 0 comes two files later; the
    # one for 2.5 was still inside the overlap.
    assert rows == {0: (2.0, 2), 2: (7.0, 1), 3: (5.0, 2)}


def test_sliding_means(spark):
    src = place(spark)
    land(spark, src, [("A", h, float(h)) for h in range(30)], [("A", 60, 0.0)])
    got = jobs.run_to_table(jobs.sliding_means(opened(spark, src), ["station"]), place(spark))
    rows = {r.window_start.replace(tzinfo=None): (r.mean_value, r.n) for r in got.collect()}
    assert rows[T0] == (11.5, 24) and rows[at(1)] == (12.5, 24) and rows[at(-23)] == (0.0, 1)


def test_repeated_polls_are_dropped_once(spark):
    src = place(spark)
    land(spark, src, [("A", 0.0, 1.0), ("A", 0.0, 1.0)], [("A", 0.0, 1.0), ("A", 1.0, 2.0)])
    got = jobs.run_to_table(jobs.distinct_readings(opened(spark, src), ["station", "time"]), place(spark))
    assert got.count() == 2


def test_sessions_split_at_an_outage(spark):
    src = place(spark)
    land(spark, src, [("A", h, 0.0) for h in (0, 0.5, 1.0, 4.0, 4.5)], [("A", 20, 0.0)])
    got = jobs.run_to_table(jobs.reporting_sessions(opened(spark, src), ["station"]), place(spark)).collect()
    assert sorted((r.session_start.hour, r.n) for r in got) == [(0, 3), (4, 2)]


def test_upsert_sink_survives_a_replay(spark):
    src, table = place(spark), place(spark)
    land(spark, src, [("A", 0, 1.0)], [("A", 0, None), ("B", 1, 2.0)])
    for _ in range(2):  # a new checkpoint replays everything
        jobs.run_batches(opened(spark, src), jobs.upsert_sink(table))
    rows = sorted((r.station, r.value) for r in stored(spark, table).collect())
    assert rows == [("A", 1.0), ("B", 2.0)]


def test_rows_of_one_key_are_folded_alike_in_one_batch_or_two(spark):
    kinds = "station STRING, time TIMESTAMP_NTZ, pm25 DOUBLE, pm10 DOUBLE"
    batches = [spark.createDataFrame(r, kinds) for r in ([("A", at(0), 1.0, None)], [("A", at(0), None, 2.0)])]
    one, two = place(spark), place(spark)
    jobs.upsert_sink(one)(batches[0].union(batches[1]), 0)
    for i, b in enumerate(batches):
        jobs.upsert_sink(two)(b, i)
    for table in (one, two):
        assert [tuple(r) for r in stored(spark, table).select("pm25", "pm10").collect()] == [(1.0, 2.0)]


def test_hourly_upsert_does_not_depend_on_the_batches(spark):
    kinds = fields(station=T.StringType(), time=T.TimestampNTZType(), parameter=T.StringType(), value=T.DoubleType())
    readings = [(f"S{i % 2}", at(i * 0.13), "pm25" if i % 3 else "pm10", float(i)) for i in range(60)]
    want: dict = {}
    for s, t, p, v in readings:
        want.setdefault((s, t.replace(minute=0, second=0, microsecond=0), p), []).append(v)
    for parts in (1, 3, 10):
        src, table = place(spark), place(spark)
        for k in range(parts):
            spark.createDataFrame(readings[60 * k // parts : 60 * (k + 1) // parts], kinds).coalesce(1).write.mode("append").json(src)
        for _ in range(2):  # the second run replays everything
            stream = jobs.read_landed(spark, src, kinds, "json", files_per_trigger=1)
            jobs.run_batches(jobs.hourly_wide_means(stream, ["pm25", "pm10"]), jobs.upsert_sink(table), mode="update")
        got = {(r.station, r.time, p): r[p] for r in stored(spark, table).collect() for p in ("pm25", "pm10") if r[p] is not None}
        assert got == {k: sum(v) / len(v) for k, v in want.items()}, parts


def latest(spark, table):
    return sorted((r.station, r.value) for r in stored(spark, table).collect())


def test_latest_state(spark):
    src, table, place_of_state = place(spark), place(spark), place(spark)
    land(spark, src, [("A", 0, 1.0), ("B", 5, 2.0), ("A", 0, None), (None, 1, 9.0)], [("A", 3, 3.0), ("B", 1, 4.0)], [("B", 5, 3.0), ("A", 2, 7.0)])
    with keyed.keyed_state(spark):
        run = partial(jobs.run_batches, keyed.latest_state(opened(spark, src)), keyed.latest_sink(table), "update")
        progress = run(place_of_state)
        assert [(r.station, r.value) for r in stored(spark, table).orderBy("station").collect()] == [(None, 9.0), ("A", 3.0), ("B", 3.0)]
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 3  # one row per station, whatever came
        run(place_of_state)  # nothing new
        run(None)  # all of it again
        assert stored(spark, table).count() == 3
        land(spark, src, [("A", 9, 0.0)])
        run(place_of_state)
    assert stored(spark, table).where("station = 'A'").first().value == 0.0


def test_latest_survives_a_broken_write(spark, monkeypatch):
    """What a broken batch leaves does not stop the restart, and goes; so do old versions."""
    src, table, place_of_state = place(spark), place(spark), place(spark)
    land(spark, src, [("A", 0, 1.0)], [("A", 1, 2.0)], [("B", 2, 3.0)], [("B", 3, 4.0)])
    whole, calls = snapshots.publish, []

    def broken(session, path, new):
        calls.append(new.version)
        if len(calls) == 2:
            raise OSError("killed")
        whole(session, path, new)

    monkeypatch.setattr(snapshots, "publish", broken)
    with keyed.keyed_state(spark):
        run = partial(jobs.run_batches, keyed.latest_state(opened(spark, src)), keyed.latest_sink(table, keep=2), "update", place_of_state)
        with pytest.raises(Exception, match="killed"):
            run()
        assert latest(spark, table) == [("A", 1.0)]
        run()
    assert latest(spark, table) == [("A", 2.0), ("B", 4.0)]
    assert snapshots.versions(spark, table) == [2, 3] and len(snapshots._children(spark, f"{table}/data")) == 2


def test_silent_stations_leave_the_state(spark):
    src, table = place(spark), place(spark)
    land(spark, src, [("A", 0, 1.0), ("B", 0, 2.0)], [("A", 30, 3.0)], [("A", 60, 4.0)], [("A", 61, 5.0)])
    with keyed.keyed_state(spark):
        progress = jobs.run_batches(keyed.latest_state(opened(spark, src), silent=dt.timedelta(hours=24)), keyed.latest_sink(table), "update")
    rows = {r.station: (r.value, r.silent) for r in stored(spark, table).collect()}
    assert rows == {"A": (5.0, False), "B": (2.0, True)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < progress[0]["stateOperators"][0]["numRowsTotal"] + 2


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_closed_hours_leave_the_state_and_take_late_rows(spark, parts):
    kinds = fields(station=T.StringType(), time=T.TimestampNTZType(), parameter=T.StringType(), value=T.DoubleType())
    readings = [(f"S{i % 2}", at(i * 0.4), "pm25" if i % 3 else "pm10", float(i) if i % 11 else None) for i in range(120)]
    readings += [("S0", at(0.2), "pm25", 1000.0), ("S1", at(5.0), "pm10", 2000.0), ("S1", at(5.1), "pm10", 1.0), (None, at(1), "pm25", 1.0), ("S1", None, "pm25", 1.0)]  # far too late
    want: dict = {}
    for s, t, p, v in readings:
        if s and t and v is not None:
            want.setdefault((s, t.replace(minute=0, second=0, microsecond=0), p), []).append(v)
    n, src, table, state = len(readings), place(spark), place(spark), place(spark)
    for k in range(parts):
        spark.createDataFrame(readings[n * k // parts : n * (k + 1) // parts], kinds).coalesce(1).write.mode("append").json(src)
    stream = jobs.read_landed(spark, src, kinds, "json", files_per_trigger=1)
    with keyed.keyed_state(spark):
        for checkpoint in (state, state, None):  # the last run replays everything
            progress = jobs.run_batches(keyed.hourly_sums(stream, ["pm25", "pm10"]), keyed.hourly_sink(table), "update", checkpoint)
            got = {(r.station, r.time, p): r[p] for r in keyed.hourly_table(spark, table, ["pm25", "pm10"]).collect() for p in ("pm25", "pm10") if r[p] is not None}
            assert got == {k: sum(v) / len(v) for k, v in want.items()}
    # 48 hours went through; at most the two or three open ones and a counter are left per station.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2 * 4


def test_a_batch_is_a_part_however_many_files(spark, monkeypatch):
    """Events in several files; the middle third of the time has one row."""
    from airgrid.queries import streams

    d = place(spark)
    hours = [i * 0.1 for i in range(100)] + [15.0] + [20 + i * 0.1 for i in range(100)]
    rows = [(i, at(h), i, "error", float(i), "{}") for i, h in enumerate(hours)]
    spark.createDataFrame(rows, streams.EVENTS).repartition(5).write.parquet(f"{d}/events.parquet")
    for size in (1_000_000, 20):
        monkeypatch.setattr(streams, "FILE_ROWS", size, raising=False)
        seen = []
        jobs.run_batches(streams.landed_in_parts(spark, d), lambda batch, i: seen.append(sorted(r.event_id for r in batch.select("event_id").collect())))
        assert seen == [list(range(100)), [100], list(range(101, 201))]


def test_static_lookup(spark):
    src = place(spark)
    land(spark, src, [("A", 0, 1.0), ("Z", 0, 1.0)])
    table = spark.createDataFrame([("A", "Alpha")], "station STRING, name STRING")
    got = jobs.run_to_table(jobs.with_lookup(opened(spark, src), table, ["station"]), place(spark))
    assert sorted((r.station, r.name) for r in got.collect()) == [("A", "Alpha"), ("Z", None)]


def test_late_rows_are_counted(spark):
    df = spark.createDataFrame([(at(h),) for h in (0, 1.5, 2.0, 3.0)], "time TIMESTAMP_NTZ").withColumn("time", F.col("time").cast("timestamp"))
    r = jobs.late_rows(df, F.lit(at(2)).cast("timestamp")).first()
    assert (r.n, r.n_late, r.n_overlap) == (4, 1, 2)
    r = jobs.late_rows(df, F.lit(None).cast("timestamp")).first()
    assert (r.n, r.n_late, r.n_overlap) == (4, 0, 0)

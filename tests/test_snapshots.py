"""Tables in snapshots: no row or column is lost, and a write that breaks off leaves the table as it was."""

import datetime as dt
import uuid

import pytest

from airgrid.schema import KEY
from airgrid.session import shared_dir
from airgrid.sources import snapshots, writers

T0 = dt.datetime(2024, 1, 1)


def folder(spark):
    return f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"


def frame(spark, rows, columns):
    return spark.createDataFrame([(T0 + dt.timedelta(days=d) if d is not None else None, s, *v) for d, s, *v in rows], f"time TIMESTAMP_NTZ, station STRING, {columns}")


def content(spark, path, *columns, version=None):
    return sorted((tuple(r) for r in writers.stored(spark, path, version).select("time", "station", *columns).collect()), key=str)


def expected(*rows):
    return sorted(((T0 + dt.timedelta(days=d) if d is not None else None, s, *v) for d, s, *v in rows), key=str)


@pytest.fixture
def table(spark):
    path = folder(spark)
    writers.write_by_day(frame(spark, [(0, "A", 1.0, 2.0), (1, "A", 3.0, 4.0), (None, "N", 5.0, 6.0)], "pm25 DOUBLE, pm10 DOUBLE"), path)
    return path


OLD = [(0, "A", 1.0, 2.0, None), (1, "A", 3.0, 4.0, None), (None, "N", 5.0, 6.0, None)]


def test_appends_with_fewer_and_more_columns(spark, table):
    writers.write_by_day(frame(spark, [(5, "B", 7.0)], "pm25 DOUBLE"), table)
    writers.write_by_day(frame(spark, [(0, "C", 8.0, 9.0)], "pm1 DOUBLE, pm25 DOUBLE"), table)
    assert content(spark, table, "pm25", "pm10", "pm1") == expected(*OLD, (5, "B", 7.0, None, None), (0, "C", 9.0, None, 8.0))


def test_insert_into_a_table_by_day_keeps_new_days_and_columns(spark, table):
    new = frame(spark, [(0, "A", 99.0, 1.0), (0, "B", 7.0, 2.0), (40, "A", 8.0, 3.0), (None, "N", 5.0, 4.0), (40, "A", 9.0, 3.0)], "pm25 DOUBLE, pm1 DOUBLE")
    for _ in range(2):
        writers.insert_new(new, table, KEY)
    null_rows = [(None, "N", 5.0, None, 4.0)] * 2  # a null key matches nothing
    assert content(spark, table, "pm25", "pm10", "pm1") == expected(*OLD, (0, "B", 7.0, None, 2.0), (40, "A", 8.0, None, 3.0), *null_rows)
    assert writers.stored(spark, table).where("date = DATE '2024-02-10'").count() == 1


def test_insert_into_a_widened_table(spark):
    path = folder(spark)
    writers.append_widening(spark.createDataFrame([("A", 1.0)], "station STRING, x DOUBLE"), path)
    writers.insert_new(spark.createDataFrame([("A", 5), ("B", 2)], "station STRING, y INT"), path, ["station"])
    assert sorted(tuple(r) for r in writers.stored(spark, path).select("station", "x", "y").collect()) == [("A", 1.0, None), ("B", None, 2)]


def test_upsert_and_keep_last_with_other_columns(spark, table):
    new = frame(spark, [(0, "A", 9.0), (3, "Z", 8.0)], "pm1 DOUBLE")
    writers.upsert_by_day(new, table, KEY)
    assert content(spark, table, "pm25", "pm10", "pm1") == expected((0, "A", 1.0, 2.0, 9.0), *OLD[1:], (3, "Z", None, None, 8.0))
    writers.upsert_keep_last(frame(spark, [(0, "A", 0.5)], "pm10 DOUBLE"), table, KEY)
    assert content(spark, table, "pm25", "pm10", "pm1") == expected((0, "A", None, 0.5, None), *OLD[1:], (3, "Z", None, None, 8.0))


@pytest.mark.parametrize("breaks", ["_write", "publish"])
def test_a_broken_write_leaves_the_table(spark, table, monkeypatch, breaks):
    whole = getattr(snapshots, breaks)

    def broken(*args):
        if breaks == "_write":
            whole(*args)  # the data are there, the manifest is not
        raise OSError("killed")

    new = frame(spark, [(0, "A", 9.0)], "pm25 DOUBLE")
    monkeypatch.setattr(snapshots, breaks, broken)
    for write in (writers.write_by_day, lambda df, p: writers.insert_new(df, p, KEY), writers.upsert_by_day, writers.upsert_keep_last):
        with pytest.raises(OSError):
            write(new, table)
        assert content(spark, table, "pm25", "pm10") == expected(*[r[:4] for r in OLD])
    monkeypatch.undo()
    writers.upsert_by_day(new, table)
    assert content(spark, table, "pm25", "pm10") == expected((0, "A", 9.0, 2.0), *[r[:4] for r in OLD[1:]])
    gone = snapshots.vacuum(spark, table, keep=1)
    assert gone and content(spark, table, "pm25") == expected((0, "A", 9.0), (1, "A", 3.0), (None, "N", 5.0))


def test_an_overtaken_writer_starts_again(spark, table, monkeypatch):
    """Another writer publishes between the reading and the publishing of this one; neither's rows are lost."""
    whole, done = snapshots.publish, []

    def slow(session, path, new):
        if not done:
            done.append(1)
            snapshots.append(frame(spark, [(0, "A", 50.0), (0, "other", 60.0)], "pm1 DOUBLE"), path)
        whole(session, path, new)

    monkeypatch.setattr(snapshots, "publish", slow)
    writers.insert_new(frame(spark, [(0, "other", 1.0), (0, "mine", 2.0)], "pm25 DOUBLE"), table, KEY)
    got = content(spark, table, "pm25", "pm1")
    assert (T0, "other", None, 60.0) in got and (T0, "mine", 2.0, None) in got and (T0, "other", 1.0, None) not in got
    assert snapshots.versions(spark, table) == [0, 1, 2]


def test_a_number_is_published_once(spark, table):
    now = snapshots.snapshot(spark, table)
    with pytest.raises(snapshots.Overtaken):
        snapshots.publish(spark, table, now)
    assert snapshots.versions(spark, table) == [0] and not [n for n in snapshots._children(spark, f"{table}/log") if n.startswith(".") and not n.endswith(".crc")]


def test_older_snapshots_and_compaction(spark, table):
    for k in range(3):
        writers.write_by_day(frame(spark, [(0, f"S{k}", float(k))], "pm25 DOUBLE"), table)
    assert [len(content(spark, table, version=v)) for v in range(4)] == [3, 4, 5, 6]
    before = content(spark, table, "pm25", "pm10")
    assert len({p for p in snapshots.compact(spark, table).parts if p[1] == "2024-01-01"}) == 1
    assert content(spark, table, "pm25", "pm10") == before
    snapshots.vacuum(spark, table, keep=1)
    assert content(spark, table, "pm25", "pm10") == before and snapshots.versions(spark, table) == [4]


def test_empty_frames_and_tables(spark):
    path = folder(spark)
    assert writers.stored(spark, path) is None
    writers.write_by_day(frame(spark, [], "pm25 DOUBLE"), path)
    assert writers.stored(spark, path).columns == ["time", "station", "pm25", "date"] and content(spark, path) == []
    writers.upsert_by_day(frame(spark, [], "pm25 DOUBLE, pm1 DOUBLE"), path)
    writers.upsert_by_day(frame(spark, [(0, "A", 1.0)], "pm25 DOUBLE"), path)
    assert content(spark, path, "pm25", "pm1") == expected((0, "A", 1.0, None))


def test_refresh_replaces_columns(spark, table):
    writers.write_by_day(frame(spark, [(9, "A", 1.0)], "co DOUBLE"), table, "overwrite")
    assert writers.stored(spark, table).columns == ["time", "station", "co", "date"] and content(spark, table, "co") == expected((9, "A", 1.0))
    assert len(content(spark, table, "pm25", version=0)) == 3

"""Joins, duplicates and storage: properties that must hold for any input."""

import datetime as dt
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from airgrid.operators import dedup, joins, reshape
from airgrid.plans.merge import carry_raw, merge_sources
from airgrid.schema import KEY, POLLUTANTS, STATION_DUMP, WEATHER_NUMERIC, WIDE_CSV
from airgrid.session import shared_dir
from airgrid.sources import readers, snapshots, writers

T0 = dt.datetime(2024, 1, 1)
KIND = "time TIMESTAMP_NTZ, station STRING, pm25 DOUBLE, pm10 DOUBLE, no2 DOUBLE"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def folder(spark):
    return f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"


def test_upsert_never_overwrites_by_null(spark):
    old = spark.createDataFrame([(T0, "A", 5.0, None, None)], KIND)
    new = spark.createDataFrame([(T0, "A", None, 7.0, None), (T0, "B", 1.0, None, None)], KIND)
    once = joins.merge_coalesce(old, new, KEY)
    want = [(T0, "A", 5.0, 7.0, None), (T0, "B", 1.0, None, None)]
    assert rows(once, *old.columns) == want
    assert rows(joins.merge_coalesce(once, new, KEY), *old.columns) == want


def test_reconcile(spark):
    new = spark.createDataFrame([(T0, "A", 9.0, 8.0, None), (T0, "C", 1.0, 1.0, 1.0)], KIND)
    cols = ["pm25", "pm10", "no2"]
    tie = spark.createDataFrame([(T0, "A", 1.0, None, 3.0)], KIND)
    full = spark.createDataFrame([(T0, "A", 1.0, 2.0, 3.0)], KIND)
    assert rows(joins.reconcile(tie, new, KEY, cols), *tie.columns) == [(T0, "A", 9.0, 8.0, 3.0)]
    assert rows(joins.reconcile(full, new, KEY, cols), *tie.columns) == [(T0, "A", 1.0, 2.0, 3.0)]


def test_null_keys_are_always_new(spark):
    old = spark.createDataFrame([(None, "A"), (T0, "A")], "time TIMESTAMP_NTZ, station STRING")
    assert rows(joins.only_new(old, old, KEY), "station") == [("A",)]
    assert joins.record_exists(old, time=T0, station="A") and not joins.record_exists(old, station="B")


def test_duplicates_with_one_hot_key(spark):
    """A third of all rows share one key; the pick must still be right."""
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.choice([None, 1.0]), rng.choice([None, 2.0])) for i in range(3000)]
    df = spark.createDataFrame(data, "k STRING, i INT, a DOUBLE, b DOUBLE")
    want_last, want_full = {}, {}
    for k, i, a, b in data:
        want_last[k] = i
        n = (a is not None) + (b is not None)
        if k not in want_full or n > want_full[k][0]:
            want_full[k] = (n, i)
    assert dict(rows(dedup.keep_last(df, ["k"], ["i"]), "k", "i")) == want_last
    assert dict(rows(dedup.keep_most_complete(df, ["k"], "i"), "k", "i")) == {k: i for k, (_, i) in want_full.items()}
    times = Counter(k for k, *_ in data)
    assert dedup.flag_duplicates(df, ["k"]).where("is_duplicate").count() == sum(n for n in times.values() if n > 1)


def test_flag_duplicates_counts_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",)], "k STRING")
    assert rows(dedup.flag_duplicates(df, ["k"]), "k", "is_duplicate") == [("a", False), ("b", True), ("b", True), (None, True), (None, True)]


def plain_carry(data):
    """Forward, then backward, per station in order of time; rows without station or time stay."""
    out = {}
    for s in {r[0] for r in data if r[0] is not None}:
        mine = sorted((r for r in data if r[0] == s and r[2] is not None), key=lambda r: (r[2], r[1]))
        first = next((r[3] for r in mine if r[3] is not None), None)
        last = None
        for _, i, _, v in mine:
            last = v if v is not None else last
            out[i] = last if last is not None else first
    return out | {r[1]: r[3] for r in data if r[0] is None or r[2] is None}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_carry_over_ranges_equals_plain_carry(spark, parts):
    rng = random.Random(4)
    data = [(rng.choice("AAAB"), i, T0 + dt.timedelta(seconds=17 * (i // 3)), rng.random() if rng.random() < 0.05 else None) for i in range(700)]
    data += [("C", 1000 + i, T0, None) for i in range(50)] + [("D", 2000 + i, T0, 1.0 if i == 49 else None) for i in range(50)]
    data += [(None, 3000 + i, T0, 5.0 if i == 3 else None) for i in range(9)] + [("A", 4000 + i, None, 6.0 if i == 3 else None) for i in range(9)]
    df = spark.createDataFrame(data, "station STRING, i INT, time TIMESTAMP_NTZ, v DOUBLE").withColumn("w x", F.lit("x")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = carry_raw(df, ["v"], ["i"], parts=parts)
        assert out.columns == df.columns and dict(rows(out, "i", "v")) == plain_carry(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert carry_raw(df.limit(0), ["v"], ["i"], parts=parts).count() == 0


def test_a_busy_minute_is_spread_over_all_tasks(spark, monkeypatch):
    from airgrid.plans import merge

    written = []
    monkeypatch.setattr(merge, "cut_lineage", lambda df, whole=merge.cut_lineage: written.append(whole(df)) or written[-1])
    df = spark.range(20_000).select(F.lit("A").alias("station"), F.col("id").alias("i"), F.lit(T0).alias("time"), F.when(F.col("id") == 10, 1.5).alias("v"))
    out = carry_raw(df, ["v"], ["i"], parts=8)
    assert out.agg(F.min("v"), F.max("v"), F.count("v")).first() == (1.5, 1.5, 20_000)
    sizes = [r["count"] for r in written[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Join")[0]  # no sort of raw rows by key is left


def sources(spark):
    six = ", ".join(f"{p} DOUBLE" for p in POLLUTANTS)
    scored = spark.createDataFrame(
        [(T0 + dt.timedelta(hours=h), s, float(h), None, None, None, None, None) for h in range(4) for s in ("hub", "X")], f"time TIMESTAMP_NTZ, station STRING, {six}"
    )
    raw = spark.createDataFrame(
        [(T0 - dt.timedelta(hours=7), "feed X", 35.0, 150.0, None, None, None, None), (T0 - dt.timedelta(hours=7), "nowhere", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        f"utc_time TIMESTAMP_NTZ, location_name STRING, {six}",
    )
    wx = ", ".join(f"{w} DOUBLE" for w in WEATHER_NUMERIC)
    weather = spark.createDataFrame(
        [(i, T0 + dt.timedelta(hours=h), "hub", *[None] * 6, float(h), None, 50.0, 1.0, 1.0, 1.0, icon) for i, (h, icon) in enumerate([(0, "04d"), (3, "01d")])],
        f"id INT, time TIMESTAMP_NTZ, station STRING, {six}, {wx}, weather_icon STRING",
    )
    lookup = spark.createDataFrame([("feed X", "X")], "alias STRING, name STRING")
    return scored, raw, weather, lookup


def test_merge_of_three_sources(spark):
    out = merge_sources(*sources(spark), "hub", ["id"])
    got = {(r.station, r.time.hour): r for r in out.collect()}
    assert len(got) == out.count() == 8
    assert (got["X", 0].pm25, got["X", 0].pm10) == (99.0, 98.0)  # the raw source has no more nulls, so it wins
    assert got["X", 1].pm25 == 1.0 and got["X", 1].temperature == pytest.approx(1.0) and got["X", 2].weather_icon == "04d"
    assert got["X", 3].weather_icon == "01d" and got["X", 1].pressure is None


def test_incremental_merge_takes_only_new_hours(spark):
    scored, raw, weather, lookup = sources(spark)
    done = spark.createDataFrame([(T0 + dt.timedelta(hours=2), "X")], "time TIMESTAMP_NTZ, station STRING")
    out = merge_sources(scored, raw, weather, lookup, "hub", ["id"], merged=done)
    assert sorted({r.time.hour for r in out.collect()}) == [2, 3]
    empty = done.where("false")
    assert merge_sources(scored, raw, weather, lookup, "hub", ["id"], merged=empty).count() == 8


def test_stored_upsert_rewrites_only_touched_days(spark):
    out = folder(spark)
    old = spark.createDataFrame([(T0, "A", 1.0, None, None), (T0 + dt.timedelta(days=1), "A", 2.0, None, None)], KIND)
    new = spark.createDataFrame([(T0, "A", None, 7.0, None), (T0 + dt.timedelta(days=2), "B", 3.0, None, None)], KIND)
    writers.write_by_day(old, out)
    untouched = {f for f in writers.stored(spark, out).inputFiles() if "date=2024-01-02" in f}
    for _ in range(2):
        writers.upsert_by_day(new, out)
        got = rows(writers.stored(spark, out), "time", "station", "pm25", "pm10")
        assert got == [(T0, "A", 1.0, 7.0), (T0 + dt.timedelta(days=1), "A", 2.0, None), (T0 + dt.timedelta(days=2), "B", 3.0, None)]
    assert untouched and untouched <= set(writers.stored(spark, out).inputFiles())


def test_insert_new_and_keep_last(spark):
    a = spark.createDataFrame([(T0, "A", 1.0, None, None)], KIND)
    b = spark.createDataFrame([(T0, "A", 9.0, None, None), (T0, "B", 2.0, None, None)], KIND)
    out = folder(spark)
    for frame in (a, b, b):
        writers.insert_new(frame, out, KEY)
    assert rows(writers.stored(spark, out), "station", "pm25") == [("A", 1.0), ("B", 2.0)]
    out = folder(spark)
    writers.upsert_keep_last(a, out)
    assert rows(writers.upsert_keep_last(b, out), "station", "pm25") == [("A", 9.0), ("B", 2.0)]


def test_widening_append(spark):
    out = folder(spark)
    writers.append_widening(spark.createDataFrame([("A", 1.5)], "station STRING, x DOUBLE"), out)
    table = writers.append_widening(spark.createDataFrame([("B", 2.5, True, 3)], "station STRING, PM_AQI DOUBLE, flag BOOLEAN, n INT"), out)
    assert dict(table.dtypes) == {"station": "string", "x": "double", "PM_AQI": "bigint", "flag": "boolean", "n": "bigint"}
    assert rows(table, "station", "x", "PM_AQI", "flag", "n") == [("A", 1.5, None, None, None), ("B", None, 2, True, 3)]


def test_csv_with_commas_and_bad_numbers(spark, tmp_path):
    text = "location_id,location_name,datetimeUtc,datetimeLocal,latitude,longitude,co,no2,o3,pm10,pm2.5,so2\n1,\"No 46, High Street\",u,2025-05-11 07:00:00+07:00,21.0,105.0,,1.5,x,2,3,4\n"
    (tmp_path / "a.csv").write_text(text)
    r = readers.read_csv(spark, str(tmp_path / "a.csv"), WIDE_CSV, enforceSchema="true").first()
    assert r.location_name == "No 46, High Street" and r.co is None and r.o3 is None and r.pm25 == 3.0


def test_station_dump_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"s1": {"stat": {"PM2_5": [{"time": "2024-01-01 00:00:00", "value": "0"}, {"time": "bad", "value": "x"}]}}}')
    got = rows(reshape.station_dump_rows(readers.read_station_dump(spark, str(tmp_path))), "station", "data_type", "parameter", "time", "value")
    assert got == [("s1", "stat", "pm25", None, None), ("s1", "stat", "pm25", T0, 0.0)]
    assert STATION_DUMP.simpleString().startswith("map<string,map")


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", [200, 100_000])
def test_station_objects_are_read_by_ranges(spark, tmp_path, indent, block):
    """However the file is cut, every entry is found under its keys."""
    import json

    rng = random.Random(5)
    dump = {}
    for i in range(12):
        kinds = dump.setdefault(f"Tram {i} \"Đ\u1ed1ng\" \\ x", {})
        for kind in ("stat", "aqi")[: rng.randrange(3)]:
            kinds[kind] = {p: [{"time": f"2024-01-0{rng.randrange(1, 9)} 0{j % 10}:00:00", "value": str(rng.random())} for j in range(rng.choice([0, 1, 9]))] for p in ("PM2_5", "CO")[: rng.randrange(3)]}
    dump["braces"] = {"stat": {"O3": [{"time": "{odd} }", "value": "1"}] if block > 1000 else []}}
    for name, content in (("a", dump), ("b", dump), ("c", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=indent, ensure_ascii=name == "b"))
    want = sorted([(s, k, p, e["time"], e["value"]) for s, kinds in dump.items() for k, ps in kinds.items() for p, es in ps.items() for e in es] * 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", str(block))
    try:
        found = readers.read_station_entries(spark, str(tmp_path))
        got = sorted((r.station, r.data_type, r.parameter, r.entry["time"], r.entry["value"]) for r in found.collect())
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and (pieces > 10 or block > 1000)


@pytest.mark.parametrize("parts", [1, 7])
def test_station_object_is_written_in_ranges(spark, tmp_path, parts):
    """One object over several files, with ties, a null value and a name to be escaped; no task sorts it all."""
    import json
    from pathlib import Path

    rng = random.Random(3)
    rows = [(f'S"{rng.randrange(3)}', rng.choice(["stat", "aqi"]), rng.choice(["pm25", "co"]), T0 + dt.timedelta(minutes=rng.randrange(90)), rng.randrange(3), float(rng.randrange(9))) for _ in range(400)]
    rows += [("S9", "stat", "pm25", T0, 1, 4.0)] * 3 + [("S9", "stat", "pm25", T0, 2, None)]
    df = spark.createDataFrame(rows, "station STRING, kind STRING, parameter STRING, time TIMESTAMP_NTZ, event_id INT, value DOUBLE").repartition(5)
    out = str(tmp_path / "object")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        writers.write_station_object(df, out, ["station", "kind", "parameter"], ["time", "event_id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted(Path(out).glob("part-*"))
    assert len(files) == parts
    text = lambda t, v: (t.strftime("%Y-%m-%d %H:%M:%S"), None if v is None else str(v))
    want = sorted([(s, k, p, *text(t, v)) for s, k, p, t, _, v in rows], key=str)
    whole = json.loads("".join(f.read_text() for f in files))
    assert sorted([(s, k, p, e["time"], e["value"]) for s, kinds in whole.items() for k, ps in kinds.items() for p, es in ps.items() for e in es], key=str) == want
    found = readers.read_station_entries(spark, out, joined=True).collect()
    assert sorted([(r.station, r.data_type, r.parameter, r.entry["time"], r.entry["value"]) for r in found], key=str) == want


def test_sql_text_and_file(spark, tmp_path):
    df = spark.range(5)
    assert readers.run_sql(spark, "SELECT count(*) n FROM v WHERE id > :low", {"v": df}, low=2).first().n == 2
    (tmp_path / "q.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW w AS SELECT 1 AS a;\nSELECT a + :b AS c FROM w;\n")
    assert readers.run_sql_file(spark, str(tmp_path / "q.sql"), b=2).first().c == 3


def test_pivot_takes_the_first_by_order(spark):
    df = spark.createDataFrame([("A", "PM2.5", 2, 20.0), ("A", "pm_25", 1, 10.0), ("A", "CO", 3, 5.0)], "station STRING, p STRING, i INT, v DOUBLE")
    named = df.withColumn("p", reshape.canonical_parameter(F.col("p")))
    r = reshape.long_to_wide(named, ["station"], "p", "v", ["i"]).first()
    assert r.pm25 == 10.0 and r.co == 5.0 and r.o3 is None


def test_update_with_a_new_column_reads_only_its_days(spark):
    out = folder(spark)
    writers.write_by_day(spark.createDataFrame([(T0 + dt.timedelta(days=i), "A", 1.0, None, None) for i in range(5)], KIND), out)
    assert all("date=2024-01-01" in f for f in snapshots.read(spark, out, days=["2024-01-01"]).inputFiles())
    before = set(writers.stored(spark, out).inputFiles())
    writers.upsert_by_day(spark.createDataFrame([(T0, "A", 5.0)], "time TIMESTAMP_NTZ, station STRING, pm1 DOUBLE"), out)
    table = writers.stored(spark, out)
    assert len(before - set(table.inputFiles())) == 1
    got = {r.time: (r.pm25, r.pm1) for r in table.collect()}
    assert got[T0] == (1.0, 5.0) and len(got) == 5 and got[T0 + dt.timedelta(days=4)] == (1.0, None)
    plan = table.where("date = DATE '2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan

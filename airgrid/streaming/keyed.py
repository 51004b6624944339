"""Keyed state: newest reading per station, and hourly means that close, forget and still take late rows.

Rows are combined in each task before they are shuffled, so a busy station sends a few rows per task and batch to its state.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from airgrid.operators.dedup import keep_last, latest_per_key
from airgrid.sources import snapshots

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEPT = 3  # snapshots that stay readable behind the newest


_USERS = {"n": 0, "before": None}
_LOCK = threading.Lock()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store this kind of state needs, for queries started inside; when the last user has left, the setting is as before.
    Queries that other threads start meanwhile use that store too, which gives the same results."""
    with _LOCK:
        if not _USERS["n"]:
            _USERS["before"] = spark.conf.get(PROVIDER, None)
            spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        _USERS["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _USERS["n"] -= 1
            if not _USERS["n"]:
                before = _USERS["before"]
                spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _newest(key: str, order: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of each key that is largest in ``order``; holds a row per key."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if kept is None else [kept, batch])
        ranked = table.take(pc.sort_indices(table, [(key, "ascending"), *[(c, "ascending") for c in order]], null_placement="at_start"))
        keys = ranked.column(key).combine_chunks()
        last = pc.fill_null(pc.not_equal(keys.slice(0, max(len(keys) - 1, 0)), keys.slice(1)), True) if len(keys) > 1 else pa.array([], pa.bool_())
        nulls = pc.is_null(keys)
        if len(keys) > 1:  # null keys are one key
            both = pc.and_(nulls.slice(0, len(keys) - 1), nulls.slice(1))
            last = pc.and_(last, pc.invert(both))
        mask = pa.concat_arrays([last, pa.array([True])]) if len(keys) else pa.array([], pa.bool_())
        chosen = ranked.filter(mask).combine_chunks().to_batches()
        kept = chosen[0] if chosen else kept
    if kept is not None:
        yield kept


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _larger(a: tuple, b: tuple) -> bool:
    """Whether ``a`` comes behind ``b``; null is the smallest."""
    for x, y in zip(a, b):
        if x != y:
            return y is None or (x is not None and x > y)
    return False


class Latest(StatefulProcessor):
    """The newest row of a key. A key without rows for ``silent`` of event time comes out once more, marked, and is forgotten."""

    def __init__(self, columns: Sequence[str], kinds: T.StructType, silent: timedelta | None):
        self.columns, self.kinds, self.silent = list(columns), kinds, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.kinds)

    def handleInputRows(self, key, rows, timerValues):
        old = self.row.get()
        best = None if old is None else tuple(old)
        for r in rows:
            own = tuple(r[c] for c in self.columns)
            if best is None or _larger(own, best):
                best = own
        if old is None or best != tuple(old):
            self.row.update(best)
            if self.silent and best[0] is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer((best[0] + _micros(self.silent)) // 1000)
            yield T.Row(**dict(zip(self.kinds.names, best)), _key=key[0], silent=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.row.get()
        if last is not None:
            self.row.clear()
            yield T.Row(**dict(zip(self.kinds.names, last)), _key=key[0], silent=True)

    def close(self) -> None:
        pass


def latest_state(rows: DataFrame, key: str = "station", time: str = "time", columns: Sequence[str] = ("value",), silent: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """``key, time, columns, silent``: the newest row of a key (equal times: the larger), whenever it changes.

    With ``silent`` the state is bounded by the keys active within it: a key that had no row for so long comes out once with
    ``silent`` true and leaves the state; rows later than the watermark (``late``) are dropped then, else none is.
    """
    ranked = ["_at", *columns]  # times are numbers in the state, which knows no zones
    own = rows.select(key, F.unix_micros(time).alias("_at"), *columns)
    once = own.mapInArrow(partial(_newest, key, ranked), own.schema)
    kinds = T.StructType([T.StructField(f"_{i}", own.schema[c].dataType) for i, c in enumerate(ranked)])
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kinds], f"_key {own.schema[key].dataType.simpleString()}", "silent BOOLEAN"])
    source = once.withColumn("_time", F.timestamp_micros("_at")).withWatermark("_time", late) if silent else once
    out = source.groupBy(key).transformWithState(Latest(ranked, kinds, silent), fields, "Update", "EventTime" if silent else "None")
    return out.select(F.col("_key").alias(key), F.timestamp_micros("_0").alias(time), *[F.col(f"_{i}").alias(c) for i, c in enumerate(columns, 1)], "silent")


def latest_sink(path: str, key: str = "station", time: str = "time", keep: int = KEPT) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps the newest row per key in a small table in snapshots; equal times go to the larger row.

    A batch is published after it is written; what a broken write leaves is never read and goes with the next ``vacuum``. A
    replayed batch changes nothing. ``keep`` snapshots stay.
    """

    def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        both = rows if old is None else old.unionByName(rows)
        tie = [c for c in rows.columns if c not in (key, time)]
        return latest_per_key(both, key, time, tie).select(*rows.columns)

    def handle(batch: DataFrame, batch_id: int) -> None:
        snapshots.merge(batch, path, combine, [key], None)
        snapshots.vacuum(batch.sparkSession, path, keep)

    return handle


def _partial_sums(parameters: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and count of each parameter per (key, hour); holds a row per key and hour of the batch."""
    sums = [f"{p}{s}" for p in parameters for s in ("_sum", "_n")]
    kept = None
    for batch in batches:
        value, parameter = batch.column("value"), batch.column("parameter")
        columns = {"_key": batch.column("_key"), "_hour": batch.column("_hour")}
        for p in parameters:
            mine = pc.if_else(pc.fill_null(pc.equal(parameter, p), False), value, pa.scalar(None, pa.float64()))
            columns |= {f"{p}_sum": pc.fill_null(mine, 0.0), f"{p}_n": pc.is_valid(mine).cast(pa.int64())}
        table = pa.table(columns)
        table = table if kept is None else pa.concat_tables([kept, table])
        grouped = table.group_by(["_key", "_hour"]).aggregate([(c, "sum") for c in sums])
        kept = pa.table({"_key": grouped["_key"], "_hour": grouped["_hour"]} | {c: grouped[f"{c}_sum"] for c in sums}).combine_chunks()
    if kept is not None:
        yield from kept.to_batches()


class Hours(StatefulProcessor):
    """Sums of a key's open hours. An hour closes when the key's newest row is ``late`` past its end, and its state goes.

    An open hour comes out complete (part 0) whenever rows join it. Rows for a closed hour come out as a part of their
    own, numbered per key, to be added to what is stored.
    """

    def __init__(self, sums: Sequence[str], late: timedelta):
        self.sums, self.behind = list(sums), _micros(late) + _micros(timedelta(hours=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "hour BIGINT", ", ".join(f"{c} {'BIGINT' if c.endswith('_n') else 'DOUBLE'}" for c in self.sums))
        self.seen = handle.getValueState("seen", "newest BIGINT, parts BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        newest, parts = self.seen.get() or (None, 0)
        incoming: dict[int, list] = {}
        for r in rows:
            own = incoming.setdefault(r["_hour"], [0] * len(self.sums))
            for i, c in enumerate(self.sums):
                own[i] += r[c]
        bound = None if newest is None else newest - self.behind
        stored = {hour: values for (hour,), values in self.open.iterator()}
        held = dict(stored)  # hours that open and close within a batch never reach the store
        for hour in sorted(incoming):
            add = incoming[hour]
            if hour in held:
                held[hour] = [a + b for a, b in zip(held[hour], add)]
                yield self.row(key, hour, 0, False, held[hour])
            elif bound is not None and hour <= bound:
                parts += 1
                yield self.row(key, hour, parts, False, add)
            else:
                held[hour] = add
                yield self.row(key, hour, 0, True, add)
        newest = max([h for h in (newest, *incoming) if h is not None], default=None)
        if newest is not None:
            for hour, values in held.items():
                if hour > newest - self.behind:
                    if hour in incoming:
                        self.open.updateValue((hour,), tuple(values))
                elif hour in stored:
                    self.open.removeKey((hour,))
            self.seen.update((newest, parts))

    def row(self, key, hour, part, opened, values):
        return T.Row(_key=key[0], _hour=hour, part=part, opened=opened, **dict(zip(self.sums, values)))

    def close(self) -> None:
        pass


def hourly_sums(rows: DataFrame, parameters: Sequence[str], key: str = "station", value: str = "value", parameter: str = "parameter", time: str = "time", late: timedelta = timedelta(hours=1)) -> DataFrame:
    """``key, time, part, opened`` and a sum and a count per parameter, for ``hourly_sink``; rows without a key or time are left out.

    The state of a key holds the hours within ``late`` of its newest row, however long the stream runs.
    """
    own = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), F.unix_micros(F.date_trunc("hour", F.col(time))).alias("_hour"), F.col(parameter).alias("parameter"), F.col(value).cast("double").alias("value")
    )
    sums = [f"{p}{s}" for p in parameters for s in ("_sum", "_n")]
    kinds = [f"{c} {'BIGINT' if c.endswith('_n') else 'DOUBLE'}" for c in sums]
    base = [f"_key {own.schema['_key'].dataType.simpleString()}", "_hour BIGINT"]
    once = own.mapInArrow(partial(_partial_sums, list(parameters)), ", ".join([*base, *kinds]))
    out = once.groupBy("_key").transformWithState(Hours(sums, late), ", ".join([*base, "part BIGINT", "opened BOOLEAN", *kinds]), "Update", "None")
    return out.select(F.col("_key").alias(key), F.timestamp_micros("_hour").alias(time), "part", "opened", *sums)


def hourly_sink(path: str, key: str = "station", time: str = "time", keep: int = KEPT) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps the parts of each hour in a table by day. A part replaces the stored one of its number; an hour
    that opens anew, as it does when a stream starts over, drops all its parts. A replayed batch changes nothing."""

    def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        fresh = keep_last(rows.withColumn("_one", F.lit(1)), [time, key, "part"], [c for c in rows.columns if c.endswith("_n")]).drop("_one")
        if old is None:
            return fresh
        anew = rows.where("opened").select(time, key).distinct()
        kept = old.join(anew, [time, key], "left_anti").join(rows.select(time, key, "part").distinct(), [time, key, "part"], "left_anti")
        return kept.select(*rows.columns).unionByName(fresh)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(time, F.col(time).cast("timestamp_ntz"))
        snapshots.merge(rows, path, combine, [time, key, "part"], time)
        snapshots.vacuum(batch.sparkSession, path, keep)

    return handle


def hourly_table(spark: SparkSession, path: str, parameters: Sequence[str], key: str = "station", time: str = "time") -> DataFrame | None:
    """``key, time`` and the mean of each parameter, over all parts."""
    table = snapshots.read(spark, path)
    if table is None:
        return None
    total = table.groupBy(key, time).agg(*[F.sum(f"{p}{s}").alias(f"{p}{s}") for p in parameters for s in ("_sum", "_n")])
    return total.select(key, time, *[F.when(F.col(f"{p}_n") > 0, F.col(f"{p}_sum") / F.col(f"{p}_n")).alias(p) for p in parameters])

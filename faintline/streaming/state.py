"""Streams with a state per key, in RocksDB: requests against limits, changes of lifecycle, daily counts, stored signals.

Rows of a key are taken in order of their event time even where they come in another order or in other micro-batches: they are
held in the state until the watermark has passed them. A row that is later than the watermark allows is dropped by Spark and
counted by it (``numRowsDroppedByWatermark``). Timers remove what has expired, so that a key that is heard of no more leaves
the state. Each call from Python to a state is a message to the JVM: a processor makes few of them for a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from faintline.streaming.limits import POLICIES, decide

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY = 86_400_000_000
#: Days that the ring of a concept holds.
RING = 60


@contextmanager
def rocksdb(spark: SparkSession):
    """States of streams started here are kept by RocksDB."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)


def run(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream gives, up to the end of what has landed, to a table."""
    with rocksdb(out.sparkSession):
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def table_of(spark: SparkSession, checkpoint: str, state: str) -> DataFrame:
    """(key, value): a state as it stands after the last micro-batch of a stream. The state of a slot, arrays of ``keys`` and ``values`` or a map, gives a row for each of its keys."""
    with rocksdb(spark):
        found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", state).load()
    if "user_map_key" in found.columns:
        return found.select(F.col("user_map_key").alias("key"), F.col("user_map_value").alias("value"))
    found = found.select("key", "value")
    kept = {f.name: f.dataType for f in found.schema["value"].dataType}
    if list(kept) != ["keys", "values"]:
        return found
    rows = [F.arrays_zip(*[F.col(f"value.{part}.{f.name}").alias(f.name) for f in kept[part]]).alias(name) for part, name in (("keys", "key"), ("values", "value"))]
    return found.select(F.inline(F.arrays_zip(*rows)))


class InOrder(StatefulProcessor):
    """Rows of a key by time: ``released`` gets those of ``in_order`` that the watermark has passed since the last micro-batch. Subclasses name the columns, of which ``at`` (microseconds) is first."""

    columns: tuple[str, ...] = ("at",)

    def init(self, handle) -> None:
        self.handle = handle
        self.opened(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due = [r for row in rows for r in [tuple(row[c] for c in self.columns)] * row["n"]]
        due.sort(key=lambda r: tuple((v is None, v) for v in r))
        return self.released(key, due, timerValues.getCurrentWatermarkInMs() * 1000)

    def opened(self, handle) -> None:
        """Open states."""

    def released(self, key: tuple, rows: list[tuple], until: int) -> Iterator[Row]:
        """What rows give; the watermark is ``until`` (microseconds)."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, time: str, late: str) -> DataFrame:
    """rows with ``at`` (microseconds) and ``n``, how many are equal, once the watermark has passed them.

    Until then Spark's own aggregation holds them, outside Python: a key's processor is called once in a micro-batch, with all that is due.
    """
    held = rows.withWatermark(time, late).groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return held.withColumn("at", F.unix_micros(time))


class _Limit(StatefulProcessor):
    """The live windows of a slot of keys: read once and written once in a micro-batch, however many keys have requests."""

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("window", "keys struct<policy: array<string>, key: array<string>>, values struct<start: array<long>, ends: array<long>, n: array<long>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, asked, out = self._held(), {}, []
        for part in rows:
            for policy, k, t, n in zip(part["policy"], part["key"], part["at"], part["n"], strict=True):
                asked.setdefault((policy, k), []).extend([int(t)] * int(n))
        for who, at in asked.items():
            most, seconds = POLICIES[who[0]]
            at.sort()
            start, _, n = held.get(who, (None, None, 0))
            done, start, n = decide(at, most, seconds, start, n)
            held[who] = (start, start + seconds * 1_000_000, n)
            out += [(*who, t, count, allowed) for t, (count, allowed) in zip(at, done, strict=True)]
        self._store(held, timerValues)
        yield pd.DataFrame(out, columns=["policy", "key", "at", "n", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._store(self._held(), timerValues)
        return iter(())

    def _held(self) -> dict[tuple[str, str], tuple[int, int, int]]:
        found = self.windows.get()
        return dict(zip(zip(*found[0], strict=True), zip(*found[1], strict=True), strict=True)) if found else {}

    def _store(self, held: dict[tuple[str, str], tuple[int, int, int]], timerValues) -> None:
        # the watermark and timers count milliseconds: a window is over when the whole millisecond of its end has passed
        until = (timerValues.getCurrentWatermarkInMs() - 1) * 1000
        live = {who: window for who, window in held.items() if window[1] >= until}
        if live:
            self.windows.update((tuple(map(list, zip(*live, strict=True))), tuple(map(list, zip(*live.values(), strict=True)))))
            self.handle.registerTimer(min(window[1] for window in live.values()) // 1000 + 2)
        else:
            self.windows.clear()

    def close(self) -> None:
        pass


def limited(requests: DataFrame, late: str = "1 day", slots: int = 512) -> DataFrame:
    """(policy, key, at, n, allowed) of a stream of requests (policy, key strings, time timestamp), each decided once, in order of time.

    A window begins with a key's first request after its last one ended. The window of a key leaves the state once the
    watermark is more than a millisecond past its end. Keys are dealt to ``slots``, a number that must stay the same for a
    checkpoint: a task holds the live windows of one slot at a time, and a micro-batch rewrites those of the slots that it meets.
    """
    timed = in_order(requests.select("policy", "key", "time"), "time", late).withColumn("slot", F.pmod(F.xxhash64("policy", "key"), F.lit(slots)))
    return timed.groupBy("slot").transformWithStateInPandas(_Limit(), "policy string, key string, at long, n long, allowed boolean", "append", "eventTime")


class _Lifecycle(InOrder):
    columns = ("at", "lifecycle")

    def opened(self, handle) -> None:
        self.last = handle.getValueState("last", "lifecycle string")

    def released(self, key: tuple, rows: list[tuple], until: int) -> Iterator[Row]:
        found = self.last.get()
        last = first = found[0] if found else None
        out = []
        for at, now in rows:
            if now != last:
                out.append(_CHANGED(key[0], last, now, at))
            last = now
        if last != first or found is None:
            self.last.update((last,))
        return iter(out)


_CHANGED = Row("trend_slug", "previous", "lifecycle", "at")


def lifecycle_changes(states: DataFrame, late: str = "1 day") -> DataFrame:
    """(trend_slug, previous, lifecycle, at) whenever a trend's lifecycle differs from the one before in time. states: trend_slug, lifecycle, recorded_at.

    The last lifecycle of a trend stays in the state for ever: the next change has to name it.
    """
    timed = in_order(states.select("trend_slug", "lifecycle", "recorded_at"), "recorded_at", late)
    return timed.groupBy("trend_slug").transformWithState(_Lifecycle(), "trend_slug string, previous string, lifecycle string, at long", "append", "eventTime")


class _Ring(StatefulProcessor):
    """Counts of the last RING days of a concept; sums are given at each midnight that the watermark passes."""

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long")
        self.next = handle.getValueState("next", "day long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            for day, n in part.groupby("day")["n"].sum().items():
                before = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0,)
                self.days.updateValue((int(day),), (int(before[0] + n),))
                first = day if first is None else min(first, day)
        if first is not None and not self.next.exists():
            self.next.update((int(first) + 1,))
            self.handle.registerTimer((int(first) + 1) * _DAY // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.next.exists():
            return
        until, day = timerValues.getCurrentWatermarkInMs() * 1000 // _DAY, self.next.get()[0]
        count = {k[0]: v[0] for k, v in self.days.iterator()}
        out = []
        while day <= until and count:
            total = lambda lo, hi, day=day: sum(n for d, n in count.items() if day - lo <= d < day - hi)
            out.append((key[0], day, total(1, 0), total(7, 0), total(14, 7), total(30, 0), total(60, 30), total(21, 7)))
            day += 1
            count = {d: n for d, n in count.items() if d >= day - RING}
        for gone in [k for k in list(self.days.keys()) if k[0] not in count]:
            self.days.removeKey(gone)
        if count:
            self.next.update((day,))
            self.handle.registerTimer(day * _DAY // 1000)
        else:
            self.next.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SUMS.split(", ")])

    def close(self) -> None:
        pass


_SUMS = "concept_id long, day long, last_1 long, last_7 long, before_7 long, last_30 long, before_30 long, previous long"


def rolling_mentions(mentions: DataFrame, late: str = "1 day") -> DataFrame:
    """(concept_id, day, sums of mentions) at each midnight: of the day, 7 and 30 days before it, the 7 and 30 days before those, and
    the days 21 to 7 before. mentions: concept_id, collected_at.

    Mentions are counted by tumbling day windows, which close under the watermark; the counts of a concept go round in a ring of
    RING days, and a concept leaves the state when its ring is empty.
    """
    daily = mentions.withWatermark("collected_at", late).groupBy("concept_id", F.window("collected_at", "1 day")).agg(F.count("*").alias("n"))
    timed = daily.select("concept_id", "n", F.window_time("window").alias("time"), F.floor(F.unix_micros("window.start") / _DAY).alias("day"))
    return timed.groupBy("concept_id").transformWithStateInPandas(_Ring(), _SUMS, "append", "eventTime")


class _Stored(StatefulProcessor):
    """The stored rows of a slot of keys, each under its key; a new row adds it or refreshes some of its columns."""

    def __init__(self, key: T.StructType, values: T.StructType, refresh: list[str], order: str):
        self.key, self.values, self.refresh, self.order = key, values, refresh, order

    def init(self, handle) -> None:
        self.stored = handle.getMapState("row", self.key, self.values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names, keys = self.values.names, self.key.names
        place, fresh = names.index(self.order), [names.index(c) for c in self.refresh]
        made, landed = Row(*keys, *names), {}
        for r in rows:
            landed.setdefault(tuple(r[c] for c in keys), []).append(tuple(r[c] for c in names))
        for who, new in landed.items():
            if len(new) > 1:
                new.sort(key=lambda v: (v[place] is not None, v[place], repr(v)) if v[place] is not None else (False, repr(v)))
            # a message to the JVM each: what is stored, and what takes its place
            kept = list(self.stored.getValue(who) or new[0])
            for i in fresh:
                kept[i] = new[-1][i]
            self.stored.updateValue(who, tuple(kept))
            yield made(*who, *kept)

    def close(self) -> None:
        pass


def upserted(rows: DataFrame, key: list[str], refresh: list[str], order: str, late: str = "1 day", slots: int = 1024) -> DataFrame:
    """The stored rows that a micro-batch adds or refreshes, as they are after it. ``order`` (a timestamp) tells which of several rows of a key is later.

    Where a key is stored already, only ``refresh`` takes new values. Of several rows of a key in one micro-batch the first in
    order adds it and the last refreshes it (equal times: by all values), however they are dealt. A row that is delivered again
    within ``late`` is left out. The table is the state: ``table_of(spark, checkpoint, "row")``; a micro-batch costs what its own
    keys cost. Keys are dealt to ``slots``, a number that must stay the same for a checkpoint: a task holds a slot's rows of one micro-batch.
    """
    once = rows.withWatermark(order, late).dropDuplicatesWithinWatermark(rows.columns)
    keys, values = T.StructType([rows.schema[k] for k in key]), T.StructType([f for f in rows.schema.fields if f.name not in key])
    dealt = once.withColumn("__slot", F.pmod(F.xxhash64(*key), F.lit(slots)))
    return dealt.groupBy("__slot").transformWithState(_Stored(keys, values, refresh, order), T.StructType([*keys, *values]), "append", "none")


def played(rows: DataFrame, made: Callable[[DataFrame], DataFrame], paths: tuple[str, str, str], batch: str = "batch") -> DataFrame:
    """What a stream gives for rows that land one micro-batch (number ``batch``, from 0 on) after the other. paths: of what lands, of the results, of the checkpoint."""
    spark, (source, out, checkpoint) = rows.sparkSession, paths
    schema = rows.drop(batch).schema
    last = rows.agg(F.max(batch)).first()[0]
    for i in range(0 if last is None else last + 1):
        rows.filter(F.col(batch) == i).drop(batch).write.mode("append").parquet(source)
        stream = made(spark.readStream.schema(schema).parquet(source))
        run(stream, out, checkpoint)
    return spark.createDataFrame([], made(rows.drop(batch).limit(0)).schema) if last is None else spark.read.schema(stream.schema).parquet(out)

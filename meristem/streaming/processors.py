"""Stateful processors for Structured Streaming: memories, gates, collectors, snapshots and trackers.

Each key's state lies in value, list or map states of the state store (RocksDB), survives a restart from
the checkpoint, may start from a table, and expires: a timer in event or processing time clears a key
that has been quiet for too long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.tracking import NAMES, OUT, Track, Tracker, box_columns, stepped


def use_state_store(spark: SparkSession) -> None:
    """What these processors need of a session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Memory(StatefulProcessor):
    """Base of processors over rows (key, seq, v, on): rows of a batch are taken in order of seq, and a quiet key expires after quiet_ms (None: never)."""

    def __init__(self, quiet_ms: int | None = None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def step(self, row: Row) -> float | None:
        """The value after a row."""
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: r["seq"]):
            yield Row(key=key[0], seq=row["seq"], v=self.step(row))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(max(now, 0) + self.quiet_ms)

    event_time = False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.start(initialState)

    def start(self, row: Row) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Latch(Memory):
    """The last value that isn't zero."""

    def open(self) -> None:
        self.state = self.handle.getValueState("latch", "v double")

    def step(self, row: Row) -> float | None:
        if row["v"]:
            self.state.update((row["v"],))
        return self.state.get()[0] if self.state.exists() else 0.0

    def start(self, row: Row) -> None:
        self.state.update((row["v"],))

    def clear(self) -> None:
        self.state.clear()


class Gate(Memory):
    """A value while the gate is open, else null; a row's `on` opens or shuts it, and null leaves it as it is. Gates begin shut."""

    def open(self) -> None:
        self.state = self.handle.getValueState("gate", "open boolean")

    def step(self, row: Row) -> float | None:
        if row["on"] is not None:
            self.state.update((row["on"],))
        return row["v"] if self.state.exists() and self.state.get()[0] else None

    def start(self, row: Row) -> None:
        self.state.update((bool(row["v"]),))

    def clear(self) -> None:
        self.state.clear()


class Collector(Memory):
    """How many values a key holds: each row's value is appended to its list, which a row with `on` false empties first."""

    def open(self) -> None:
        self.state = self.handle.getListState("values", "v double")
        self.count = self.handle.getValueState("count", "n long")

    def step(self, row: Row) -> float | None:
        if row["on"] is False:
            self.clear()
        self.state.appendValue((row["v"],))
        n = (self.count.get()[0] if self.count.exists() else 0) + 1
        self.count.update((n,))
        return float(n)

    def start(self, row: Row) -> None:
        self.state.appendValue((row["v"],))
        self.count.update((1,))

    def clear(self) -> None:
        self.state.clear()
        self.count.clear()


class Snapshot(Memory):
    """What was held at the last trigger: a row with `on` true keeps its value under its place modulo slots, and each row gives the sum of what is kept."""

    slots = 4

    def open(self) -> None:
        self.state = self.handle.getMapState("kept", "slot int", "v double")

    def step(self, row: Row) -> float | None:
        if row["on"]:
            self.state.updateValue((row["seq"] % self.slots,), (row["v"],))
        return float(sum(v[0] for v in self.state.values()))

    def start(self, row: Row) -> None:
        self.state.updateValue((0,), (row["v"],))

    def clear(self) -> None:
        self.state.clear()


def remembered(stream: DataFrame, processor: Memory, key: str, seq: str, value: str, on: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(key, seq, v) of a processor over each key's rows. initial(key, v) is what keys begin with. Runs on streams, and on tables as one batch."""
    use_state_store(stream.sparkSession)
    rows = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("double").alias("v"), (F.col(on).cast("boolean") if on else F.lit(None).cast("boolean")).alias("on"))
    out = StructType([rows.schema["key"], *StructType.fromDDL("seq long, v double").fields])
    start = initial.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).groupBy("key") if initial is not None else None
    return rows.groupBy("key").transformWithState(processor, out, "Append", "ProcessingTime" if processor.quiet_ms is not None else "None", start)


class BoxTracker(StatefulProcessor):
    """Tracks of a stream of boxes. A tick is taken once a later one has begun, or the watermark has passed its time; boxes that come later than that are left out."""

    def __init__(self, max_age: int, min_hits: int, least: float):
        self.shape = max_age, min_hits, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getListState("tracks", "id long, label string, x array<double>, p array<double>, since int, streak int")
        self.at = handle.getValueState("at", "ticks long, next_id long, last long")
        self.waiting = handle.getListState("waiting", "tick long, box string, time long")

    def _load(self) -> tuple[Tracker, int | None]:
        tracker, last = Tracker(*self.shape), None
        if self.at.exists():
            tracker.ticks, tracker.next_id, last = self.at.get()
            tracker.tracks = [Track(i, label, np.array(x), np.array(p).reshape(7, 7), since, streak) for i, label, x, p, since, streak in self.tracks.get()] if self.tracks.exists() else []
        return tracker, last

    def _store(self, tracker: Tracker, last: int) -> None:
        self.at.update((tracker.ticks, tracker.next_id, last))
        if tracker.tracks:
            self.tracks.put([(t.id, t.label, t.x.tolist(), t.p.ravel().tolist(), t.since, t.streak) for t in tracker.tracks])
        else:
            self.tracks.clear()

    def _advance(self, key: tuple, boxes: list[tuple], closed: int) -> Iterator[Row]:
        """Takes the ticks up to closed; the rest waits."""
        tracker, last = self._load()
        ticks: dict[int, list] = {}
        for tick, box, _ in boxes:
            if tick <= closed and (last is None or tick > last):
                ticks.setdefault(tick, []).append(tuple(json.loads(box)))
        for tick in sorted(ticks):
            for found in stepped(tracker, last, tick, ticks[tick]):
                yield Row(stream=key[0], **dict(zip(NAMES, found, strict=True)))
            last = tick
        if ticks:
            self._store(tracker, last)
        rest = [b for b in boxes if b[0] > closed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        boxes = [tuple(b) for b in self.waiting.get()] if self.waiting.exists() else []
        boxes += [(r["tick"], json.dumps([r["box_id"], r["xmin"], r["ymin"], r["width"], r["height"], r["label"]]), int(r["at"].timestamp() * 1000)) for r in rows]
        newest = max(b[0] for b in boxes)
        yield from self._advance(key, boxes, newest - 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(max(b[2] for b in boxes if b[0] == newest), timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        boxes = [tuple(b) for b in self.waiting.get()] if self.waiting.exists() else []
        if boxes:
            yield from self._advance(key, boxes, max(b[0] for b in boxes))

    def close(self) -> None:
        pass


def track_stream(boxes: DataFrame, at: str, max_age: int = 5, min_hits: int = 2, iou_threshold: float = 0.3, delay: str = "10 seconds") -> DataFrame:
    """tracker_sort over a stream of boxes with an event time: (stream, tick, track_id, label, box_id and the filtered box)."""
    use_state_store(boxes.sparkSession)
    rows = boxes.withWatermark(at, delay).select(*box_columns(boxes), F.col(at).alias("at")).where("tick is not null and xmin is not null and ymin is not null and width is not null and height is not null")
    out = StructType([rows.schema["stream"], *StructType.fromDDL(OUT).fields])
    return rows.groupBy("stream").transformWithState(BoxTracker(max_age, min_hits, iou_threshold), out, "Append", "EventTime")

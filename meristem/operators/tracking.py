"""Boxes of successive ticks linked to tracks: constant-velocity Kalman filters and minimum-cost assignment by overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..registry import operator

#: State: centre x and y, area, aspect, and the speeds of the first three. Fixed values of the method: the filter's noises.
MOVE = np.eye(7) + np.eye(7, k=4)
START = np.diag([10.0] * 4 + [10000.0] * 3)
DRIFT = np.diag([1.0] * 4 + [0.01, 0.01, 0.0001])
NOISE = np.diag([1.0, 1.0, 10.0, 10.0])


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of a minimum-cost assignment; each row, or each column if they are fewer, is in one. Rows are added one by one along shortest augmenting paths."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    rows, columns = cost.shape
    u, v = np.zeros(rows), np.zeros(columns)
    taken, has = np.full(columns, -1), np.full(rows, -1)  # row by column, column by row
    for row in range(rows):
        far, before = np.full(columns, np.inf), np.full(columns, -1)
        closed, seen, least, at = np.zeros(columns, bool), [], 0.0, row
        while True:
            seen.append(at)
            step = least + cost[at] - u[at] - v
            nearer = ~closed & (step < far)
            far[nearer], before[nearer] = step[nearer], at
            column = int(np.where(closed, np.inf, far).argmin())
            least = far[column]
            closed[column] = True
            if taken[column] < 0:
                break
            at = taken[column]
        u[row] += least
        for r in seen[1:]:
            u[r] += least - far[has[r]]
        v[closed] -= least - far[closed]
        while True:
            r = before[column]
            taken[column], has[r], column = r, column, has[r]
            if r == row:
                break
    return [(r, int(c)) for r, c in enumerate(has)]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all pairs of boxes (x1, y1, x2, y2)."""
    side = lambda i: np.maximum(0, np.minimum(a[:, None, i + 2], b[None, :, i + 2]) - np.maximum(a[:, None, i], b[None, :, i]))
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    inter = side(0) * side(1)
    return inter / (area(a)[:, None] + area(b)[None] - inter + 1e-9)


def measured(box: np.ndarray) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([box[0] + w / 2, box[1] + h / 2, w * h, w / h if h > 0 else 1.0])


def boxed(x: np.ndarray) -> np.ndarray:
    w = math.sqrt(abs(x[2] * x[3]))
    h = x[2] / w if w > 0 else 0.0
    return np.array([x[0] - w / 2, x[1] - h / 2, x[0] + w / 2, x[1] + h / 2])


@dataclass
class Track:
    """since: ticks since its last box; streak: boxes in a row."""

    id: int
    label: str | None
    x: np.ndarray
    p: np.ndarray
    since: int = 0
    streak: int = 0

    def predict(self) -> np.ndarray:
        if self.x[2] + self.x[6] <= 0:
            self.x[6] = 0.0  # an area can't be negative
        self.x, self.p = MOVE @ self.x, MOVE @ self.p @ MOVE.T + DRIFT
        self.streak = 0 if self.since else self.streak
        self.since += 1
        return boxed(self.x)

    def update(self, box: np.ndarray) -> None:
        self.since, self.streak = 0, self.streak + 1
        gain = self.p[:, :4] @ np.linalg.inv(self.p[:4, :4] + NOISE)
        self.x = self.x + gain @ (measured(box) - self.x[:4])
        left = np.eye(7)
        left[:, :4] -= gain
        self.p = left @ self.p @ left.T + gain @ NOISE @ gain.T


@dataclass
class Tracker:
    """The tracks of one stream. Its state is bounded by the boxes of max_age ticks."""

    max_age: int = 5
    min_hits: int = 2
    least: float = 0.3
    ticks: int = 0
    next_id: int = 0
    tracks: list[Track] = field(default_factory=list)

    def tick(self, boxes: np.ndarray, labels: list) -> list[tuple[Track, int]]:
        """(track, its box's place or -1) of the tracks that are reported in this tick."""
        self.ticks += 1
        predicted = [t.predict() for t in self.tracks]
        ok = [bool(np.isfinite(p).all()) for p in predicted]
        self.tracks = [t for t, k in zip(self.tracks, ok, strict=True) if k]
        predicted = [p for p, k in zip(predicted, ok, strict=True) if k]
        taken: dict[int, int] = {}
        if len(boxes) and predicted:
            iou = overlaps(boxes, np.array(predicted))
            over = iou > self.least
            forced = over.sum(0).max() == 1 and over.sum(1).max() == 1
            pairs = np.argwhere(over).tolist() if forced else assignment(-iou)
            taken = {b: t for b, t in pairs if iou[b, t] >= self.least}
        placed = {}
        for b, t in taken.items():
            self.tracks[t].update(boxes[b])
            placed[self.tracks[t].id] = b
        for b in range(len(boxes)):
            if b not in taken:
                self.tracks.append(Track(self.next_id, labels[b], np.concatenate([measured(boxes[b]), np.zeros(3)]), START.copy()))
                placed[self.next_id] = b
                self.next_id += 1
        out = [(t, placed.get(t.id, -1)) for t in self.tracks if t.since <= 1 and (t.streak >= self.min_hits or self.ticks <= self.min_hits)]
        self.tracks = [t for t in self.tracks if t.since <= self.max_age]
        return out

    def idle(self, ticks: int) -> Iterator[list[tuple[Track, int]]]:
        """Ticks without boxes; once no track is left they only count."""
        while ticks > 0 and self.tracks:
            ticks -= 1
            yield self.tick(np.zeros((0, 4)), [])
        self.ticks += max(0, ticks)


OUT = "tick long, track_id long, label string, box_id long, xmin double, ymin double, width double, height double"
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]


def reported(tick: int, found: list[tuple[Track, int]], ids: list) -> Iterator[tuple]:
    for t, place in found:
        x1, y1, x2, y2 = boxed(t.x).tolist()
        yield tick, t.id, t.label, ids[place] if place >= 0 else None, x1, y1, x2 - x1, y2 - y1


def stepped(tracker: Tracker, last: int | None, tick: int, rows: list[tuple]) -> Iterator[tuple]:
    """What a tick's rows (box_id, xmin, ymin, width, height, label) report, after the empty ticks since the last one."""
    if last is not None:
        for k, found in enumerate(tracker.idle(tick - last - 1)):
            yield from reported(last + 1 + k, found, [])
    rows = sorted(rows, key=lambda r: r[0])
    boxes = np.array([(r[1], r[2], r[1] + r[3], r[2] + r[4]) for r in rows], float).reshape(-1, 4)
    yield from reported(tick, tracker.tick(boxes, [r[5] for r in rows]), [r[0] for r in rows])


def box_columns(boxes: DataFrame) -> list:
    label = F.col("label").cast("string") if "label" in boxes.columns else F.lit(None).cast("string")
    return ["stream", F.col("tick").cast("long").alias("tick"), F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "width", "height")], label.alias("label")]


@operator("tracker_sort")
def track_boxes(boxes: DataFrame, max_age: int = 5, min_hits: int = 2, iou_threshold: float = 0.3) -> DataFrame:
    """boxes(stream, tick, box_id, xmin, ymin, width, height, label) to (stream, tick, track_id, label, box_id and the filtered box) of the tracks reported in each tick.

    In a tick each track's box is predicted, and boxes are dealt to the predictions so that the overlaps'
    sum is largest; pairs under iou_threshold come apart. A box without a track begins one, in the order
    of box_ids. A track is reported if it had a box in this tick (or misses its first, with no box_id)
    and min_hits in a row before, or in a stream's first min_hits ticks; without a box for more than
    max_age ticks it ends. Ticks between a stream's first and last without boxes count. Boxes without a
    tick or with null sides are left out. A stream's ticks are taken in order by one task, which holds its
    tracks and the boxes of one tick.
    """
    rows = boxes.select(*box_columns(boxes)).where("tick is not null and xmin is not null and ymin is not null and width is not null and height is not null")
    schema = StructType([rows.schema["stream"], *StructType.fromDDL(OUT).fields])
    kind = rows.limit(0).toArrow().schema.field("stream").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = tracker = last = tick = None
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal last, held
            if held:
                out.extend((stream, *r) for r in stepped(tracker, last, tick, held))
            last, held = tick, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            for s, n, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tracker is None or s != stream:
                    close()
                    stream, tracker, last, tick = s, Tracker(max_age, min_hits, iou_threshold), None, n
                elif n != tick:
                    close()
                    tick = n
                held.append(tuple(row))
            yield packed()
            out = []
        close()
        yield packed()

    return rows.repartition("stream").sortWithinPartitions("stream", "tick").mapInArrow(run, schema)

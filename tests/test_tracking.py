"""Assignment, tracks and stateful processors against plain versions, in batch and as streams with restarts."""

import itertools
import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from meristem.operators import tracking as T
from meristem.streaming import processors as P

DDL = "stream string, tick long, box_id long, xmin double, ymin double, width double, height double, label string"


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2).tolist()
        cost = np.round(rng.normal(size=(n, m)), 1)
        got = T.assignment(cost)
        small, large = sorted((n, m))
        assert len(got) == small == len({r for r, _ in got}) == len({c for _, c in got})
        wide = cost if n <= m else cost.T
        least = min(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert math.isclose(sum(cost[r, c] for r, c in got), least, abs_tol=1e-9)
    assert T.assignment(np.zeros((0, 3))) == []


class PlainSort:
    """Tracks by textbook matrices and all permutations."""

    def __init__(self, max_age, min_hits, least):
        self.max_age, self.min_hits, self.least, self.frame, self.next, self.tracks = max_age, min_hits, least, 0, 0, []

    def box(self, x):
        w = math.sqrt(abs(x[2] * x[3]))
        h = x[2] / w if w else 0
        return [x[0] - w / 2, x[1] - h / 2, x[0] + w / 2, x[1] + h / 2]

    def iou(self, a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(0, w) * max(0, h)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i + 1e-9)

    def step(self, boxes):
        self.frame += 1
        f = np.eye(7)
        f[0, 4] = f[1, 5] = f[2, 6] = 1
        for t in self.tracks:
            if t["x"][2] + t["x"][6] <= 0:
                t["x"][6] = 0
            t["x"], t["p"] = f @ t["x"], f @ t["p"] @ f.T + np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
            if t["since"]:
                t["streak"] = 0
            t["since"] += 1
        iou = [[self.iou(b, self.box(t["x"])) for t in self.tracks] for b in boxes]
        best, pairs = -1, []
        n, m = len(boxes), len(self.tracks)
        for p in itertools.permutations(range(max(n, m)), min(n, m)):
            chosen = [(i, j) if n <= m else (j, i) for i, j in enumerate(p)]
            total = sum(iou[i][j] for i, j in chosen)
            if total > best + 1e-12:
                best, pairs = total, chosen
        pairs = [(i, j) for i, j in pairs if iou[i][j] >= self.least]
        h = np.eye(4, 7)
        for i, j in pairs:
            t, b = self.tracks[j], boxes[i]
            z = np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) * (b[3] - b[1]), (b[2] - b[0]) / (b[3] - b[1])])
            r = np.diag([1, 1, 10, 10])
            k = t["p"] @ h.T @ np.linalg.inv(h @ t["p"] @ h.T + r)
            t["x"] = t["x"] + k @ (z - h @ t["x"])
            t["p"] = (np.eye(7) - k @ h) @ t["p"] @ (np.eye(7) - k @ h).T + k @ r @ k.T
            t["since"], t["streak"], t["box"] = 0, t["streak"] + 1, i
        for i, b in enumerate(boxes):
            if i not in {a for a, _ in pairs}:
                x = np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) * (b[3] - b[1]), (b[2] - b[0]) / (b[3] - b[1]), 0, 0, 0])
                self.tracks.append({"id": self.next, "x": x, "p": np.diag([10.0] * 4 + [1e4] * 3), "since": 0, "streak": 0, "box": i})
                self.next += 1
        out = [(t["id"], t["box"] if t["since"] == 0 else None, self.box(t["x"])) for t in self.tracks if t["since"] <= 1 and (t["streak"] >= self.min_hits or self.frame <= self.min_hits)]
        self.tracks = [t for t in self.tracks if t["since"] <= self.max_age]
        return out


def walk(seed, ticks):
    """Boxes of three objects that move, sometimes go unseen, and cross; a gap of ticks without any."""
    rng = np.random.default_rng(seed)
    rows = []
    at, speed = rng.uniform(0, 40, (3, 2)), rng.uniform(-1.5, 1.5, (3, 2))
    for tick in range(ticks):
        at += speed
        for i in range(3):
            if rng.random() < 0.85 and not 12 <= tick < 15:
                x, y = at[i] + rng.normal(0, 0.3, 2)
                rows.append((f"s{seed}", tick, 10 * tick + i, float(x), float(y), 10.0 + i, 8.0, f"k{i}"))
    return rows


def plain_tracks(rows, shape=(3, 2, 0.3)):
    out = []
    for stream in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == stream]
        sort = PlainSort(*shape)
        for tick in range(min(r[1] for r in own), max(r[1] for r in own) + 1):
            now = sorted((r for r in own if r[1] == tick), key=lambda r: r[2])
            for i, place, b in sort.step([(r[3], r[4], r[3] + r[5], r[4] + r[6]) for r in now]):
                out.append((stream, tick, i, now[place][2] if place is not None else None, b))
    return sorted(out, key=lambda r: r[:3])


def same_tracks(got, want):
    got = sorted(((r["stream"], r["tick"], r["track_id"], r["box_id"], [r["xmin"], r["ymin"], r["xmin"] + r["width"], r["ymin"] + r["height"]]) for r in got), key=lambda r: r[:3])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(np.allclose(g[4], w[4], atol=1e-6) for g, w in zip(got, want, strict=True))


def test_tracks_equal_plain_ones(spark):
    rows = [r for seed in range(4) for r in walk(seed, 30)]
    odd = [("s9", None, 1, 0.0, 0.0, 1.0, 1.0, None), ("s9", 4, 1, None, 0.0, 1.0, 1.0, None), ("s8", 4, 1, 0.0, 0.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, DDL).repartition(3)
    want = plain_tracks([*rows, odd[2]])
    same_tracks(T.track_boxes(df, 3, 2, 0.3).collect(), want)
    assert len(want) > 150 and any(w[3] is None for w in want)
    assert T.track_boxes(df.limit(0)).count() == 0
    assert {r["label"] for r in T.track_boxes(df).where("stream = 's0'").collect()} == {"k0", "k1", "k2"}


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    P.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drain(df, name, path, schema=None):
    """Takes all that is there, and stops; called again it goes on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out-{name}").option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out-{name}")


def test_a_stream_of_boxes_gives_the_same_tracks_over_restarts(spark, store, tmp_path):
    rows = [r for seed in range(2) for r in walk(seed, 24)]
    start = datetime(2024, 1, 1)
    ddl = DDL + ", at timestamp"
    timed = [(*r, start + timedelta(seconds=r[1])) for r in rows]
    end = [(f"s{s}", 900, 9000 + s, 0.0, 0.0, 1.0, 1.0, None, start + timedelta(seconds=900)) for s in range(2)]
    shown = lambda: P.track_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "at", 3, 2, 0.3)
    found = None
    for part in ([r for r in timed if r[1] <= 8], [r for r in timed if 8 < r[1] <= 17], [r for r in timed if r[1] > 17], end):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = drain(shown(), "tracks", tmp_path)
    same_tracks(found.where("tick < 24").collect(), [w for w in plain_tracks([*rows, *[e[:8] for e in end]]) if w[1] < 24])


KINDS = {
    P.Latch: lambda s, r: (r[2] or s, r[2] or s), P.Gate: lambda s, r: (lambda o: (o, r[2] if o else None))(s if r[3] is None else r[3]),
    P.Collector: lambda s, r: (lambda n: (n, float(n)))(1 if r[3] is False else s + 1), P.Snapshot: lambda s, r: (lambda m: (m, float(sum(m.values()))))({**s, r[1] % 4: r[2]} if r[3] else s),
}
FIRST = {P.Latch: 0.0, P.Gate: False, P.Collector: 0, P.Snapshot: {}}


@pytest.mark.parametrize("kind", list(KINDS))
def test_memories_go_on_after_a_restart_and_begin_with_a_table(spark, store, tmp_path, kind):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.integers(0, 3)), [None, True, False][rng.integers(0, 3)]) for i in range(20) for k in ("a", "b")]
    ddl = "k string, i long, v double, on boolean"
    begin = spark.createDataFrame([("b", 5.0)], "k string, v double")
    started = {P.Latch: 5.0, P.Gate: True, P.Collector: 1, P.Snapshot: {0: 5.0}}
    for part in (rows[:14], rows[14:30], rows[30:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = drain(P.remembered(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), kind(), "k", "i", "v", "on", begin), "m", tmp_path)
    want = {}
    for key in "ab":
        state = started[kind] if key == "b" else FIRST[kind]
        for r in rows:
            if r[0] == key:
                state, want[key, r[1]] = KINDS[kind](state, r)
    assert {(r["key"], r["seq"]): r["v"] for r in found.collect()} == want
    batch = P.remembered(spark.createDataFrame(rows, ddl), kind(), "k", "i", "v", "on", begin)
    assert {(r["key"], r["seq"]): r["v"] for r in batch.collect()} == want


def test_a_quiet_key_expires(spark, store, tmp_path):
    """A timer clears a key's state between one row and the next; queries with timers in processing time run until they are stopped."""
    ddl = "k string, i long, v double"
    (tmp_path / "in").mkdir()
    q = P.remembered(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), P.Latch(quiet_ms=1), "k", "i", "v").writeStream.format("memory").queryName("quiet").trigger(processingTime="50 milliseconds").start()
    try:
        for i, key in enumerate("aba"):
            spark.createDataFrame([(key, i, 2.0 if i == 0 else 0.0)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            ends = time.monotonic() + 60
            while spark.table("quiet").count() < i + 1 and time.monotonic() < ends:
                time.sleep(0.2)
        found = {(r["key"], r["seq"]): r["v"] for r in spark.table("quiet").collect()}
    finally:
        q.stop()
    assert found == {("a", 0): 2.0, ("b", 1): 0.0, ("a", 2): 0.0}

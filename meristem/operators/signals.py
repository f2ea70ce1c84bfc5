"""Signal and stateful operators over ordered rows.

A signal is a value column in the order of `order` within `by` (a stream). Windowed filters are window
functions. Recursive filters fold over each stream's values as they pass by in order: a task reads its
streams batch by batch and holds one state, however long a stream is. A stream is one task's work, as
each state needs the one before; for endless streams use meristem.streaming, which keeps the same state
between batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..registry import operator
from .pieces import Linear, linear_fold


def _over(by: list[str], order: str, before: int | None, after: int = 0):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding if before is None else -before, after)


def _place(by: list[str], order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))


@operator("plugin_filter_ma")
def moving_average(df: DataFrame, value: str, order: str, by: list[str], window: int = 5) -> DataFrame:
    """Trailing mean, of fewer values at the start."""
    return df.withColumn("filtered", F.avg(value).over(_over(by, order, window - 1)))


@operator("plugin_filter_median")
def moving_median(df: DataFrame, value: str, order: str, by: list[str], window: int = 5) -> DataFrame:
    """Trailing median of an odd window (an even one is widened), of fewer values at the start."""
    return df.withColumn("filtered", F.percentile(value, F.lit(0.5)).over(_over(by, order, (window | 1) - 1)))


def _weighted(df: DataFrame, value: str, order: str, by: list[str], weights: list[float]) -> DataFrame:
    """Sum of weights times the last len(weights) values, oldest first; the raw value until there are as many."""
    w = Window.partitionBy(*by).orderBy(order)
    total: Column = F.lit(0.0)
    for lag, c in enumerate(reversed(weights)):
        total = total + (F.lag(value, lag).over(w) if lag else F.col(value)) * float(c)
    return df.withColumn("filtered", F.when(_place(by, order) >= len(weights), total).otherwise(F.col(value)))


@operator("plugin_filter_savgol")
def savitzky_golay(df: DataFrame, value: str, order: str, by: list[str], window: int = 7, polyorder: int = 2) -> DataFrame:
    """The window's least-squares polynomial at its centre (odd windows from 5 on)."""
    window = max(5, window | 1)
    x = np.arange(window) - window // 2
    return _weighted(df, value, order, by, np.linalg.pinv(np.vander(x, polyorder + 1, increasing=True))[0].tolist())


@operator("plugin_filter_gaussian")
def gaussian_filter(df: DataFrame, value: str, order: str, by: list[str], window: int = 7, sigma: float = 1.5) -> DataFrame:
    x = np.arange(window) - (window - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return _weighted(df, value, order, by, (k / k.sum()).tolist())


@operator("plugin_filter_loess")
def loess(df: DataFrame, value: str, order: str, by: list[str], span: int = 9) -> DataFrame:
    """Local line with tricube weights over the last span values, at the last; the raw value until there are as many."""
    w = Window.partitionBy(*by).orderBy(order)
    s = {n: F.lit(0.0) for n in ("w", "x", "y", "xx", "xy")}
    for lag in range(span):
        y = F.lag(value, lag).over(w) if lag else F.col(value)
        k, x = (1 - (lag / span) ** 3) ** 3, float(-lag)
        for n, term in (("w", F.lit(k)), ("x", F.lit(k * x)), ("y", y * k), ("xx", F.lit(k * x * x)), ("xy", y * (k * x))):
            s[n] = s[n] + term
    det = s["w"] * s["xx"] - s["x"] * s["x"]
    at_zero = (s["xx"] * s["y"] - s["x"] * s["xy"]) / det
    return df.withColumn("filtered", F.when(_place(by, order) >= span, at_zero).otherwise(F.col(value)))


def fold(df: DataFrame, value: str, order: str, by: list[str], first: Callable, step: Callable, out: Callable) -> DataFrame:
    """(by, order, value, filtered): a left fold over each stream, with out(state) after each value.

    first(v) is a stream's state after its first value, step(state, v) that after another. A null value
    leaves the state as it is. Of rows with equal keys and order the smaller value goes first.
    """
    names = list(dict.fromkeys([*by, order])) + [value]
    rows = df.select(*names[:-1], F.col(value).cast("double").alias(value))
    schema = StructType([*rows.schema.fields, StructField("filtered", DoubleType())])
    places = list(range(len(by)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in places), strict=True)) if by else [()] * batch.num_rows
            filtered = []
            for key, v in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if key != stream:
                    stream, state = key, None
                if v is not None:
                    state = first(v) if state is None else step(state, v)
                filtered.append(None if state is None else out(state))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filtered, pa.float64())], names=schema.names)

    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*names).mapInArrow(run, schema)


@operator("plugin_filter_ema")
def exponential_average(df: DataFrame, value: str, order: str, by: list[str], alpha: float = 20) -> DataFrame:
    """s = a v + (1 - a) s with a in percent."""
    a = alpha / 100
    return linear_fold(df, value, order, by, Linear(lambda v: (v,), lambda s, v: (a * v + (1 - a) * s[0],), np.array([[1 - a]]), np.array([a])))


@operator("plugin_filter_lowpass")
def low_pass(df: DataFrame, value: str, order: str, by: list[str], cutoff: float = 1000, fps: float = 30) -> DataFrame:
    """First-order RC filter; cutoff in thousandths of a hertz."""
    r = 1 - math.exp(-2 * math.pi * (cutoff / 1000) / fps)
    return linear_fold(df, value, order, by, Linear(lambda v: (v,), lambda s, v: (s[0] + r * (v - s[0]),), np.array([[1 - r]]), np.array([r])))


@operator("plugin_filter_kalman")
def kalman(df: DataFrame, value: str, order: str, by: list[str], q: float = 10, r: float = 10) -> DataFrame:
    """One-dimensional Kalman filter of a constant; process noise q / 1000, measurement noise r / 100."""
    q, r = q / 1000, r / 100

    def step(s: tuple[float, float], v: float) -> tuple[float, float]:
        x, p = s[0], s[1] + q
        k = p / (p + r)
        return x + k * (v - x), (1 - k) * p

    return fold(df, value, order, by, lambda v: (v, 1.0), step, lambda s: s[0])


@operator("plugin_filter_holt")
def holt(df: DataFrame, value: str, order: str, by: list[str], alpha: float = 30, beta: float = 10) -> DataFrame:
    """Level and trend smoothing, both in percent."""
    a, b = alpha / 100, beta / 100

    def step(s: tuple[float, ...], v: float) -> tuple[float, ...]:
        level = a * v + (1 - a) * (s[0] + s[1])
        return level, b * (level - s[0]) + (1 - b) * s[1]

    matrix = np.array([[1 - a, 1 - a], [-a * b, 1 - a * b]])  # of level and trend
    return linear_fold(df, value, order, by, Linear(lambda v: (v, 0.0), step, matrix, np.array([a, a * b])))


@operator("plugin_filter_particle")
def particle_filter(df: DataFrame, value: str, order: str, by: list[str], particles: int = 100, process_std: float = 10, measure_std: float = 50, seed: int = 42) -> DataFrame:
    """Random-walk particle filter with systematic resampling; deviations in hundredths. Seeded anew for each stream, so results repeat."""
    q, r = process_std / 100, max(measure_std / 100, 1e-9)

    def weighed(rng: np.random.Generator, x: np.ndarray, v: float) -> tuple[np.random.Generator, np.ndarray, float]:
        w = np.exp(-0.5 * ((x - v) / r) ** 2) + 1e-300
        w /= w.sum()
        estimate = float(w @ x)
        return rng, x[np.minimum(np.searchsorted(np.cumsum(w), (rng.random() + np.arange(particles)) / particles), particles - 1)], estimate

    first = lambda v: weighed(np.random.default_rng(seed), np.full(particles, v), v)
    return fold(df, value, order, by, first, lambda s, v: weighed(s[0], s[1] + s[0].normal(0, q, particles), v), lambda s: s[2])


# Gates and memories


def rising(condition: Column, by: list[str], order: str) -> Column:
    """True where the condition becomes true."""
    return F.coalesce(condition, F.lit(False)) & ~F.coalesce(F.lag(condition).over(Window.partitionBy(*by).orderBy(order)), F.lit(False))


def epoch(reset: Column, by: list[str], order: str) -> Column:
    """Number of resets so far; rows with one number are one stretch."""
    return F.sum(F.coalesce(reset.cast("int"), F.lit(0))).over(_over(by, order, None))


@operator("logic_collect")
def collect(df: DataFrame, value: str, order: str, by: list[str], condition: str = "true", mode: str = "rising", interval: int = 1, reset: str = "false") -> DataFrame:
    """Rows that a collector appends (every tick, at a rising edge, or every interval ticks) with their index since the last rising reset."""
    d = df.withColumn("__edge", rising(F.expr(reset), by, order)).withColumn("__epoch", epoch(F.col("__edge"), by, order))
    take = {"every": F.lit(True), "rising": rising(F.expr(condition), by, order), "interval": (_place(by, order) - 1) % interval == 0}[mode]
    taken = d.withColumn("__take", take).where("__take")
    return taken.withColumn("index", F.row_number().over(Window.partitionBy(*by, "__epoch").orderBy(order)) - 1).select(*by, order, value, "index")


@operator("signal_gate")
def gate(df: DataFrame, value: str, order: str, by: list[str], is_open: str, hold_last: bool = False) -> DataFrame:
    passed = F.coalesce(F.expr(is_open), F.lit(False))
    out = F.when(passed, F.col(value))
    return df.withColumn("passed", passed).withColumn("out", F.last(out, ignorenulls=True).over(_over(by, order, None)) if hold_last else out)


@operator("logic_latch")
def latch(df: DataFrame, value: str, order: str, by: list[str], mode: str = "non_null", reset: str = "false") -> DataFrame:
    """The last valid value (not null, not zero, or any) since the last rising reset."""
    valid = {"non_null": F.col(value).isNotNull(), "non_zero": F.coalesce(F.col(value) != 0, F.lit(False)), "always": F.lit(True)}[mode]
    d = df.withColumn("__edge", rising(F.expr(reset), by, order)).withColumn("__epoch", epoch(F.col("__edge"), by, order))
    held = F.last(F.when(valid, F.col(value)), ignorenulls=True).over(_over([*by, "__epoch"], order, None))
    return d.withColumn("held", held).withColumn("active", F.col("held").isNotNull()).drop("__edge", "__epoch")


@operator("variable_store")
def variable_store(df: DataFrame, value: str, order: str, by: list[str], max_items: int = 10, separator: str = ",") -> DataFrame:
    """At each change of the value: the last max_items changed values, joined as text, and their count."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    changed = df.withColumn("__before", before).where(~F.col(value).eqNullSafe(F.col("__before")) & F.col(value).isNotNull())
    items = F.collect_list(value).over(_over(by, order, max_items - 1))
    return changed.withColumn("list", items).select(*by, order, F.array_join(F.transform("list", lambda x: x.cast("string")), separator).alias("text"), F.size("list").alias("count"), F.col(value).alias("last"))


@operator("util_snapshot")
def snapshot(df: DataFrame, value: str, order: str, by: list[str], capture: str) -> DataFrame:
    """The value at the last rising trigger."""
    at = F.when(rising(F.expr(capture), by, order), F.col(value))
    return df.withColumn("__at", at).withColumn("main", F.last("__at", ignorenulls=True).over(_over(by, order, None))).drop("__at")


@operator("gen_feedback")
def feedback(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """The value one tick before."""
    return df.withColumn("prev", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


@operator("util_csv_export")
def recorded_rows(df: DataFrame, order: str, by: list[str], record: str) -> DataFrame:
    """Rows while recording is on, with their tick; write them with meristem.sources.writers."""
    return df.withColumn("tick", _place(by, order)).where(F.coalesce(F.expr(record), F.lit(False)))


@operator("analysis_monitor")
def monitor(df: DataFrame, value: str, by: list[str], mode: str = "mean", scale: float = 1.0, offset: float = 0.0, precision: int = 3) -> DataFrame:
    forms = {"mean": F.avg(value), "count": F.count(value).cast("double"), "area": F.count_if(F.col(value) > 0).cast("double")}
    scalar = F.bround(forms[mode] * scale + offset, precision)
    return df.groupBy(*by).agg(scalar.alias("scalar")).withColumn("display_text", F.col("scalar").cast("string"))


# Generators


@operator("signal_clock")
def clock(df: DataFrame, order: str, by: list[str], speed: float = 1.0, fps: float = 30.0) -> DataFrame:
    """frame (from 0), t in seconds, ms, and the sine and cosine of t."""
    d = df.withColumn("frame", _place(by, order) - 1).withColumn("t", F.col("frame") / fps * speed)
    return d.withColumns({"ms": F.col("t") * 1000, "sin_t": F.sin("t"), "cos_t": F.cos("t")})


@operator("signal_generator", "column")
def generator(t: Column, waveform: str = "sine", frequency: float = 1.0, amplitude: float = 1.0, offset: float = 0.0, phase: float = 0.0, duty: float = 0.5, seed: int = 42) -> Column:
    """A wave at time t: sine, square, triangle, saw or (seeded) noise."""
    cycle = t * frequency + phase
    u = cycle - F.floor(cycle)
    unit = {
        "sine": lambda: F.sin(cycle * (2 * math.pi)),
        "square": lambda: F.when(u < duty, F.lit(1.0)).otherwise(F.lit(-1.0)),
        "triangle": lambda: 1 - 4 * F.abs(u - 0.5),
        "saw": lambda: 2 * u - 1,
        "noise": lambda: F.pmod(F.xxhash64(t, F.lit(seed)), F.lit(2_000_001)) / 1_000_000 - 1,
    }[waveform]()
    return unit * amplitude + offset


def random_walk(df: DataFrame, order: str, by: list[str], step: float = 0.1, low: float = -1.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    """A walk that a seed fixes, held within limits."""
    d = df.withColumn("__step", (F.pmod(F.xxhash64(F.col(order), F.lit(seed)), F.lit(2_000_001)) / 1_000_000 - 1) * step)
    return fold(d, "__step", order, by, lambda v: v, lambda s, v: F.greatest(F.lit(low), F.least(F.lit(high), s + v)), lambda s: s).drop("__step")


# Ring buffers


def tail(df: DataFrame, order: str, by: list[str], n: int) -> DataFrame:
    """The last n rows of each stream, in a window that Spark prunes to n rows before it shuffles."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


@operator("plotter_pro")
def plotter(df: DataFrame, tick: str, series: str, value: str, names: list[str], order: str, buffer_size: int = 100) -> DataFrame:
    """The last buffer_size values of each series as a table by tick."""
    return tail(df, order, [series], buffer_size).groupBy(tick).pivot(series, names).agg(F.max_by(value, order))


@operator("sci_plotter")
def plot_buffer(df: DataFrame, value: str, order: str, by: list[str], buffer_size: int = 100) -> DataFrame:
    return tail(df, order, by, buffer_size).select(*by, F.col(order).alias("x"), F.col(value).alias("y"))


@operator("phase_space")
def phase_space(df: DataFrame, x: str, y: str, order: str, by: list[str], trail_len: int = 100) -> DataFrame:
    return tail(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), order, by, trail_len).select(*by, order, x, y)


@operator("imu_phase_dashboard")
def imu_dashboard(df: DataFrame, order: str, by: list[str], trail_len: int = 100, axes: tuple[str, ...] = ("ax", "ay", "az", "gx", "gy", "gz")) -> DataFrame:
    return tail(df, order, by, trail_len).select(*by, order, *axes)


@operator("sci_heatmap")
def heatmap(points: DataFrame, by: list[str], order: str, resolution: int = 32, decay: float = 0.05, intensity: float = 1.0) -> DataFrame:
    """points(x, y in 0..1) summed on a grid, each weakened by (1 - decay) per tick of age."""
    newest = points.groupBy(*by).agg(F.max(order).alias("__last"))
    cell = lambda c: F.least(F.lit(resolution - 1), F.floor(F.col(c) * resolution)).cast("int")
    weight = intensity * F.pow(F.lit(1 - decay), (F.col("__last") - F.col(order)).cast("double"))
    return points.join(newest, by).groupBy(*by, cell("y").alias("gy"), cell("x").alias("gx")).agg(F.sum(weight).alias("heat"))


@operator("sci_frame_accumulator")
def frame_accumulator(frames: DataFrame, mode: str = "mean", window: int | None = None) -> DataFrame:
    """frames(raster_id, tick, y, x, v) to one value per pixel over all ticks (mean, max, min, std or diff, last less first), or per tick over the last window ticks."""
    forms = {"mean": F.avg("v"), "max": F.max("v"), "min": F.min("v"), "std": F.stddev_pop("v")}
    if window is None:
        form = forms[mode] if mode != "diff" else F.max_by("v", "tick") - F.min_by("v", "tick")
        return frames.groupBy("raster_id", "y", "x").agg(form.alias("v"), F.count("*").alias("frame_count"))
    over = _over(["raster_id", "y", "x"], "tick", window - 1)
    form = forms[mode].over(over) if mode != "diff" else F.col("v") - F.first("v").over(over)
    return frames.withColumn("v", form)


@operator("geo_raster_noise")
def raster_noise(raster: DataFrame, sigma_abs: float = 1.0, sigma_rel: float = 0.0, seed: int = 42, clip: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian noise that the seed and the pixel fix (by Box-Muller on hashes), whatever the partitions."""
    unit = lambda salt: (F.pmod(F.xxhash64(*[F.col(c) for c in ("raster_id", "y", "x")], F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
    v = F.col("v") + normal * (sigma_abs + sigma_rel * F.abs("v"))
    return raster.withColumn("v", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), v)) if clip else v)


@operator("tracker_visualize")
def track_trails(tracks: DataFrame, trail_length: int = 30) -> DataFrame:
    """The last centres of each track."""
    last = tail(tracks, "tick", ["stream", "track_id"], trail_length)
    return last.select("stream", "track_id", "tick", (F.col("xmin") + F.col("width") / 2).alias("cx"), (F.col("ymin") + F.col("height") / 2).alias("cy"))


@operator("bg_sub_knn")
def background_neighbours(frames: DataFrame, history: int = 10, threshold: float = 20.0, k: int = 2) -> DataFrame:
    """A pixel is foreground if fewer than k of its last history values are within the threshold."""
    over = Window.partitionBy("raster_id", "y", "x").orderBy("tick").rowsBetween(-history, -1)
    near = F.size(F.filter(F.collect_list("v").over(over), lambda p: F.abs(p - F.col("v")) <= threshold))
    return frames.withColumn("mask", F.when(near < k, 255).otherwise(0))


@dataclass(frozen=True)
class Mixture:
    """Normal distributions that a pixel's values come from, as (weight, mean, variance) by falling weight.

    A value joins the first one that it fits within `near` variances, which moves towards it by the
    learning rate over its weight, or else begins one, for the weakest if there are `most`. Weights decay
    by the rate, a little more by `prune`, and those that come to nothing go. The background are the
    heaviest ones, up to `share` of the weight.
    """

    history: int = 500
    threshold: float = 16.0
    near: float = 9.0
    most: int = 5
    share: float = 0.9
    first_variance: float = 15.0
    least_variance: float = 4.0
    most_variance: float = 75.0
    prune: float = 0.05

    def step(self, state: tuple[int, list[tuple[float, float, float]], int], v: float, shadows: bool) -> tuple[int, list[tuple[float, float, float]], int]:
        """(number of values, modes, mask of the last one): 255 foreground, 127 shadow, 0 background."""
        count, modes, _ = state
        count += 1
        rate = 1 / min(2 * count, self.history)
        less = rate * self.prune
        mask, total, fits, kept = 255, 0.0, False, []
        for w, mean, variance in modes:
            far = (mean - v) ** 2
            if not fits:
                if total < self.share and far < self.threshold * variance:
                    mask = 0
                total += w
            w = (1 - rate) * w - less
            if not fits and far < self.near * variance:
                fits = True
                w += rate
                k = rate / w
                mean, variance = mean + k * (v - mean), min(self.most_variance, max(self.least_variance, variance + k * (far - variance)))
            if w > less:
                kept.append((w, mean, variance))
        if mask and shadows:
            heavy = 0.0
            for w, mean, _ in modes:
                if heavy < self.share and mean > 0 and 0.5 * mean <= v <= mean:
                    mask = 127
                    break
                heavy += w
        if not fits:
            kept = kept[: self.most - 1] if len(kept) == self.most else kept
            kept = [(w * (1 - rate), m, s) for w, m, s in kept] + [(rate if kept else 1.0, v, self.first_variance)]
        whole = sum(w for w, _, _ in kept)
        return count, sorted(((w / whole, m, s) for w, m, s in kept), key=lambda c: -c[0]), mask


@operator("bg_sub_mog2")
def background_mixture(frames: DataFrame, history: int = 500, threshold: float = 16.0, shadows: bool = True) -> DataFrame:
    """frames(raster_id, tick, y, x, v) with mask by a mixture of normal distributions for each pixel: 255 foreground, 127 shadow (darker than the background, to half of it at most), 0 background. A pixel's first value is foreground, and a null one has what the last had."""
    model = Mixture(history, threshold)
    begin = (0, [], 0)
    out = fold(frames, "v", "tick", ["raster_id", "y", "x"], lambda v: model.step(begin, v, shadows), lambda s, v: model.step(s, v, shadows), lambda s: float(s[2]))
    return out.withColumn("mask", F.col("filtered").cast("int")).drop("filtered")


def _variance(values: Column) -> Column:
    """Of an array by Welford's steps in its order; Spark's own variance rounds otherwise, which shows where a value lies on the threshold itself."""

    def step(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, none, step, lambda s: F.try_divide(s["squares"], s["n"]))


def background_gaussian(frames: DataFrame, history: int = 10, threshold: float = 16.0) -> DataFrame:
    """A pixel is foreground if its squared distance from the mean of its last history values exceeds threshold variances (at least 4); one Gaussian per pixel."""
    over = Window.partitionBy("raster_id", "y", "x").orderBy("tick").rowsBetween(-history, -1)
    last = F.collect_list(F.col("v").cast("double")).over(over)
    d = F.col("v") - F.avg("v").over(over)
    far = d * d > threshold * F.greatest(_variance(last), F.lit(4.0))
    return frames.withColumn("mask", F.when(far, 255).otherwise(0))


@operator("filter_bg_subtraction")
def foreground(frames: DataFrame, history: int = 500, threshold: float = 16.0, shadows: bool = True) -> DataFrame:
    """Frames with 0 where the mixture says background or shadow."""
    return background_mixture(frames, history, threshold, shadows).withColumn("v", F.when(F.col("mask") == 255, F.col("v")).otherwise(F.lit(0.0)))


def background_removed(frames: DataFrame, history: int = 10, threshold: float = 16.0) -> DataFrame:
    return background_gaussian(frames, history, threshold).withColumn("v", F.when(F.col("mask") > 0, F.col("v")).otherwise(F.lit(0.0)))


@operator("plugin_evm_color")
def magnify_change(frames: DataFrame, alpha: float = 10.0, low_cutoff: float = 0.4, high_cutoff: float = 3.0, fps: float = 30.0) -> DataFrame:
    """Each pixel plus alpha times its temporal band (the difference of two first-order low-pass filters)."""
    r = [1 - math.exp(-2 * math.pi * c / fps) for c in (high_cutoff, low_cutoff)]
    step = lambda s, v: (s[0] + r[0] * (v - s[0]), s[1] + r[1] * (v - s[1]))
    out = fold(frames, "v", "tick", ["raster_id", "y", "x"], lambda v: (v, v), step, lambda s: s[0] - s[1])
    return out.withColumn("v", F.col("v") + alpha * F.col("filtered")).withColumnRenamed("filtered", "signal")


@operator("plugin_evm_motion")
def magnify_motion(frames: DataFrame, alpha: float = 10.0, low_cutoff: float = 0.4, high_cutoff: float = 3.0, fps: float = 30.0) -> DataFrame:
    """As plugin_evm_color, on the detail that a 3x3 mean leaves."""
    from .stencils import box_mean

    smooth = box_mean(frames.withColumn("raster_id", F.struct("raster_id", "tick")), 3).select(F.col("raster_id.raster_id"), F.col("raster_id.tick"), "y", "x", F.col("v").alias("__low"))
    detail = frames.join(smooth, ["raster_id", "tick", "y", "x"]).withColumn("__v", F.col("v")).withColumn("v", F.col("v") - F.col("__low"))
    moved = magnify_change(detail, alpha, low_cutoff, high_cutoff, fps).select("raster_id", "tick", "y", "x", F.col("v").alias("__new"))
    return detail.join(moved, ["raster_id", "tick", "y", "x"]).select("raster_id", "tick", "y", "x", (F.col("__low") + F.col("__new")).alias("v"))

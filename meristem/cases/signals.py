"""Signal and stateful operators over events, one stream per user in the order of event_id."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators import tracking as T
from .base import FRAMES, case, events, frames, r6, table

ARGS = ("value", "event_id", ["user_id"])
_W = "(partition by user_id order by event_id rows between {} preceding and current row)"


def _filter(name: str, build, sql: str | None) -> None:
    @case(name, sql and f"select user_id, event_id, round({sql}, 6) as filtered from events")
    def query(spark, sf_dir):
        return r6(build(events(spark, sf_dir)).select("user_id", "event_id", "filtered"))


def _weighted_sql(weights: list[float]) -> str:
    total = " + ".join(f"{w!r}::double * lag(value, {i}) over (partition by user_id order by event_id)" for i, w in enumerate(reversed(weights)))
    return f"case when row_number() over (partition by user_id order by event_id) >= {len(weights)} then {total} else value end"


def _fold_sql(first: str, state: str, out: str) -> str:
    """A fold over each user's list so far, for the last element of every prefix."""
    return f"""select user_id, event_id, round({out}, 6) as filtered from (
      select user_id, event_id, list_reduce(list_transform(list(value) over (partition by user_id order by event_id rows unbounded preceding), lambda v: {first}), lambda s, v: {state}) as s from events)"""


_filter("plugin_filter_ma", lambda d: S.moving_average(d, *ARGS, window=5), f"avg(value) over {_W.format(4)}")
_filter("plugin_filter_median", lambda d: S.moving_median(d, *ARGS, window=5), f"median(value) over {_W.format(4)}")
_x = [-3, -2, -1, 0, 1, 2, 3]
_filter("plugin_filter_savgol", lambda d: S.savitzky_golay(d, *ARGS), _weighted_sql([c / 21 for c in (-2, 3, 6, 7, 6, 3, -2)]))
_g = [math.exp(-(x**2) / (2 * 1.5**2)) for x in _x]
_filter("plugin_filter_gaussian", lambda d: S.gaussian_filter(d, *ARGS), _weighted_sql([w / sum(_g) for w in _g]))
_tri = [(1 - (i / 9) ** 3) ** 3 for i in range(9)]
_sw, _sx, _sxx = (sum(k * (-i) ** p for i, k in enumerate(_tri)) for p in (0, 1, 2))
_filter("plugin_filter_loess", lambda d: S.loess(d, *ARGS), _weighted_sql([(k * (_sxx - _sx * -i)) / (_sw * _sxx - _sx * _sx) for i, k in enumerate(_tri)][::-1]))
_filter("plugin_filter_particle", lambda d: S.particle_filter(d, *ARGS), None)

case("plugin_filter_ema", _fold_sql("v", "0.2::double * v + 0.8::double * s", "s"))(lambda spark, d: r6(S.exponential_average(events(spark, d), *ARGS).select("user_id", "event_id", "filtered")))
_R = 1 - math.exp(-2 * math.pi * 1.0 / 30)
case("plugin_filter_lowpass", _fold_sql("v", f"s + {_R!r}::double * (v - s)", "s"))(lambda spark, d: r6(S.low_pass(events(spark, d), *ARGS).select("user_id", "event_id", "filtered")))
case("plugin_filter_kalman", _fold_sql("{'x': v, 'p': 1.0::double, 'v': v}", "{'x': s.x + (s.p + 0.01) / (s.p + 0.11) * (v.v - s.x), 'p': (1 - (s.p + 0.01) / (s.p + 0.11)) * (s.p + 0.01), 'v': v.v}", "s.x"))(lambda spark, d: r6(S.kalman(events(spark, d), *ARGS).select("user_id", "event_id", "filtered")))
case("plugin_filter_holt", _fold_sql("{'l': v, 't': 0.0::double, 'v': v}", "{'l': 0.3 * v.v + 0.7 * (s.l + s.t), 't': 0.1 * (0.3 * v.v + 0.7 * (s.l + s.t) - s.l) + 0.9 * s.t, 'v': v.v}", "s.l"))(lambda spark, d: r6(S.holt(events(spark, d), *ARGS).select("user_id", "event_id", "filtered")))

_EDGE = "(coalesce({c}, false) and not coalesce(lag({c}) over (partition by user_id order by event_id), false))"
_UP, _ERR = _EDGE.format(c="value > 20"), _EDGE.format(c="event_type = 'error'")


@case("logic_collect", f"with e as (select *, {_UP} as take, {_ERR} as edge from events), p as (select *, sum(edge::int) over (partition by user_id order by event_id rows unbounded preceding) as epoch from e) select user_id, event_id, value, row_number() over (partition by user_id, epoch order by event_id) - 1 as index from p where take")
def _collect(spark, d):
    return S.collect(events(spark, d), *ARGS, condition="value > 20", reset="event_type = 'error'")


@case("signal_gate", f"select user_id, event_id, last_value(case when event_type = 'click' then value end ignore nulls) over {_W.format('unbounded')} as out, event_type = 'click' as passed from events")
def _gate(spark, d):
    return S.gate(events(spark, d), *ARGS, is_open="event_type = 'click'", hold_last=True).select("user_id", "event_id", "out", "passed")


@case("logic_latch", f"with e as (select *, {_ERR} as edge from events), p as (select *, sum(edge::int) over (partition by user_id order by event_id rows unbounded preceding) as epoch from e) select user_id, event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id, epoch order by event_id rows unbounded preceding) as held from p")
def _latch(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return S.latch(e, *ARGS, reset="event_type = 'error'").select("user_id", "event_id", "held")


@case("variable_store", "with c as (select * from (select *, lag(event_type) over (partition by user_id order by event_id) as b from events) where event_type is distinct from b), l as (select user_id, event_id, list(event_type) over (partition by user_id order by event_id rows 2 preceding) as x, event_type from c) select user_id, event_id, array_to_string(x, ',') as text, len(x)::int as count, event_type as last from l")
def _store(spark, d):
    return S.variable_store(events(spark, d), "event_type", "event_id", ["user_id"], max_items=3)


@case("util_snapshot", f"with e as (select *, case when {_UP} then value end as held from events) select user_id, event_id, last_value(held ignore nulls) over {_W.format('unbounded')} as main from e")
def _snapshot(spark, d):
    return S.snapshot(events(spark, d), *ARGS, capture="value > 20").select("user_id", "event_id", "main")


@case("gen_feedback", "select user_id, event_id, lag(value) over (partition by user_id order by event_id) as prev from events")
def _feedback(spark, d):
    return S.feedback(events(spark, d), *ARGS).select("user_id", "event_id", "prev")


@case("util_csv_export", "select * from (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by event_id) as tick from events) where event_type = 'view'")
def _export(spark, d):
    return S.recorded_rows(events(spark, d), "event_id", ["user_id"], "event_type = 'view'").withColumn("tick", F.col("tick").cast("long"))


@case("analysis_monitor", "select user_id, round_even(avg(value) * 2 + 1, 3) as scalar from events group by 1")
def _monitor(spark, d):
    return S.monitor(events(spark, d), "value", ["user_id"], scale=2.0, offset=1.0).select("user_id", "scalar")


@case("signal_clock", "with f as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as frame from events) select user_id, event_id, frame, round(frame / 30, 6) as t, round(sin(frame / 30), 6) as sin_t from f")
def _clock(spark, d):
    return r6(S.clock(events(spark, d), "event_id", ["user_id"]).select("user_id", "event_id", F.col("frame").cast("long"), "t", "sin_t"))


@case("plotter_pro", "with t as (select event_id // 100 as tick, * from events), l as (select * from t qualify row_number() over (partition by event_type order by event_id desc) <= 200) select tick, arg_max(value, event_id) filter (event_type = 'view') as view, arg_max(value, event_id) filter (event_type = 'click') as click from l group by 1")
def _plotter(spark, d):
    e = events(spark, d).withColumn("tick", F.floor(F.col("event_id") / 100))
    return S.plotter(e, "tick", "event_type", "value", ["view", "click"], "event_id", 200)


_TAIL = "select user_id, event_id as x, value as y from events qualify row_number() over (partition by user_id order by event_id desc) <= 10"
case("sci_plotter", _TAIL)(lambda spark, d: S.plot_buffer(events(spark, d), *ARGS, buffer_size=10))
case("phase_space", "select user_id, event_id, value as x, value * 2 as y from events qualify row_number() over (partition by user_id order by event_id desc) <= 10")(lambda spark, d: S.phase_space(events(spark, d).withColumn("x", F.col("value")).withColumn("y", F.col("value") * 2), "x", "y", "event_id", ["user_id"], 10))
case("imu_phase_dashboard", "select user_id, event_id, value as ax, value as gz from events qualify row_number() over (partition by user_id order by event_id desc) <= 5")(lambda spark, d: S.imu_dashboard(events(spark, d).withColumn("ax", F.col("value")).withColumn("gz", F.col("value")), "event_id", ["user_id"], 5, ("ax", "gz")))


@case("sci_heatmap", "with p as (select user_id % 10 as u, event_id, (event_id * 37 % 1000) / 1000.0::double as x, (event_id * 91 % 1000) / 1000.0::double as y from events) select u, least(7, floor(y * 8))::int as gy, least(7, floor(x * 8))::int as gx, round(sum(power(0.999::double, (max_id - event_id))), 6) as heat from p join (select u, max(event_id) as max_id from p group by 1) using (u) group by all")
def _heat(spark, d):
    e = events(spark, d).select((F.col("user_id") % 10).alias("u"), "event_id", (F.col("event_id") * 37 % 1000 / 1000).alias("x"), (F.col("event_id") * 91 % 1000 / 1000).alias("y"))
    return r6(S.heatmap(e, ["u"], "event_id", 8, 0.001))


@case("sci_frame_accumulator", f"with {FRAMES} select raster_id, y, x, round(stddev_pop(v), 6) as v, count(*) as frame_count from frames group by 1, 2, 3")
def _accumulate(spark, d):
    return r6(S.frame_accumulator(frames(spark, d), "std"))


@case("geo_raster_noise")
def _noise(spark, d):
    """All pixels of all frames, each with its noise."""
    f = frames(spark, d).withColumn("raster_id", F.col("tick") * 20 + F.col("raster_id"))
    return r6(S.raster_noise(f, 5.0).select("raster_id", "y", "x", "v"))


@case("bg_sub_knn", f"with {FRAMES} select raster_id, tick, y, x, case when len(list_filter(coalesce(list(v) over (partition by raster_id, y, x order by tick rows between 5 preceding and 1 preceding), []), lambda p: abs(p - v) <= 20)) < 2 then 255 else 0 end as mask from frames")
def _knn(spark, d):
    return S.background_neighbours(frames(spark, d), 5).select("raster_id", "tick", "y", "x", "mask")


_MOG = "coalesce(power(v - avg(v) over w, 2) > 16 * greatest(var_pop(v) over w, 4), false)"


@case("bg_sub_mog2", f"with {FRAMES} select raster_id, tick, y, x, case when {_MOG} then 255 else 0 end as mask from frames window w as (partition by raster_id, y, x order by tick rows between 10 preceding and 1 preceding)")
def _mog(spark, d):
    return S.background_gaussian(frames(spark, d)).select("raster_id", "tick", "y", "x", "mask")


@case("bg_sub_mog2_mixture")
def _mixture(spark, d):
    return S.background_mixture(frames(spark, d)).select("raster_id", "tick", "y", "x", "mask")


@case("filter_bg_subtraction_mixture")
def _foreground(spark, d):
    return S.foreground(frames(spark, d)).select("raster_id", "tick", "y", "x", "v")


@case("filter_bg_subtraction", f"with {FRAMES} select raster_id, tick, y, x, case when {_MOG} then v else 0.0::double end as v from frames window w as (partition by raster_id, y, x order by tick rows between 10 preceding and 1 preceding)")
def _bg(spark, d):
    return S.background_removed(frames(spark, d)).select("raster_id", "tick", "y", "x", "v")


_H, _L = (1 - math.exp(-2 * math.pi * c / 30) for c in (3.0, 0.4))


def _band_sql(source: str) -> str:
    """Each pixel's difference of two low-pass filters over its frames so far."""
    return f"""f as (select raster_id, tick, y, x, v, list_reduce(list_transform(list(v) over (partition by raster_id, y, x order by tick rows unbounded preceding), lambda e: {{'h': e, 'l': e, 'e': e}}),
      lambda p, e: {{'h': p.h + {_H!r}::double * (e.e - p.h), 'l': p.l + {_L!r}::double * (e.e - p.l), 'e': e.e}}) as s from {source})"""


@case("plugin_evm_color", f"with {FRAMES}, {_band_sql('frames')} select raster_id, tick, y, x, round(v + 10 * (s.h - s.l), 6) as v, round(s.h - s.l, 6) as signal from f")
def _evm(spark, d):
    return r6(S.magnify_change(frames(spark, d)))


_MEAN3 = "m as (select a.raster_id, a.tick, a.y, a.x, avg(b.v) as low, any_value(a.v) - avg(b.v) as v from frames a cross join (select unnest([-1, 0, 1]) as dy) cross join (select unnest([-1, 0, 1]) as dx) join frames b on b.raster_id = a.raster_id and b.tick = a.tick and b.y = 7 - abs(7 - abs(a.y + dy)) and b.x = 7 - abs(7 - abs(a.x + dx)) group by 1, 2, 3, 4)"


@case("plugin_evm_motion", f"with {FRAMES}, {_MEAN3}, {_band_sql('m')} select raster_id, tick, y, x, round(low + f.v + 10 * (s.h - s.l), 6) as v from f join m using (raster_id, tick, y, x)")
def _evm_motion(spark, d):
    return r6(S.magnify_motion(frames(spark, d)))


@case("tracker_sort")
def _track(spark, d):
    e = events(spark, d)
    b = e.select((F.col("user_id") % 10).alias("stream"), F.floor(F.col("event_id") / 200).alias("tick"), F.col("event_id").alias("box_id"), (F.col("event_id") % 7 / 7).alias("xmin"), (F.col("user_id") % 5 / 5).alias("ymin"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    return r6(T.track_boxes(b.groupBy("stream", "tick", "xmin", "ymin", "width", "height").agg(F.min("box_id").alias("box_id")).select(*b.columns), iou_threshold=0.1))


@case("tracker_visualize", "select user_id % 10 as stream, event_type as track_id, event_id as tick, value + 0.5 as cx, 1.5::double as cy from events qualify row_number() over (partition by user_id % 10, event_type order by event_id desc) <= 4")
def _trails(spark, d):
    t = events(spark, d).select((F.col("user_id") % 10).alias("stream"), F.col("event_type").alias("track_id"), F.col("event_id").alias("tick"), F.col("value").alias("xmin"), F.lit(1.0).alias("ymin"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    return S.track_trails(t, 4)


@case("event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def _windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")

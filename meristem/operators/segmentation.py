"""Contours that move to where a raster's regions or edges are, and cuts between two mixtures of colours.

State lies in written tables between rounds; a round works on tiles with as much halo as its steps reach.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import Scratch
from .pixels import KEY
from .stencils import gaussian_blur
from .tiles import Tile, by_tiles

#: The lines of three pixels through a pixel, by one end.
LINES = ((0, 1), (1, 0), (1, 1), (1, -1))
STEPS = 8  # that contours by edges take in one round


def _shift(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a moved so that each place has what lay at (y + dy, x + dx); nothing lies beyond the border."""
    out = np.zeros_like(a)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _along(u: np.ndarray, erosion: bool) -> list[np.ndarray]:
    join = np.logical_and if erosion else np.logical_or
    return [join(u, join(_shift(u, dy, dx), _shift(u, -dy, -dx))) for dy, dx in LINES]


def smoothed(u: np.ndarray, parity: int) -> np.ndarray:
    """Thin parts and thin gaps go: what some line fills of what all lines reach, or the other way round."""
    fills = lambda a: np.logical_or.reduce(_along(a, True))
    reaches = lambda a: np.logical_and.reduce(_along(a, False))
    return reaches(fills(u)) if parity % 2 else fills(reaches(u))


def slopes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences, one-sided at borders; 0 along an axis of one pixel."""
    return tuple(np.gradient(a, axis=i) if a.shape[i] > 1 else np.zeros_like(a) for i in (0, 1))


def region_step(u: np.ndarray, image: np.ndarray, inside: np.ndarray, outside: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """The border moves over pixels that are nearer to the mean of the side that it comes from."""
    dy, dx = slopes(u.astype(float))
    push = (np.abs(dy) + np.abs(dx)) * (weights[0] * (image - inside) ** 2 - weights[1] * (image - outside) ** 2)
    return np.where(push < 0, True, np.where(push > 0, False, u))


def edge_step(u: np.ndarray, g: np.ndarray, limit: np.ndarray, balloon: float) -> np.ndarray:
    """The border grows or shrinks where there is no edge, then falls towards edges."""
    if balloon:
        moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        parts = [_shift(u, *m) for m in moves]
        moved = np.logical_or.reduce(parts) if balloon > 0 else np.logical_and.reduce(parts)
        u = np.where(g > limit, moved, u)
    (gy, gx), (uy, ux) = slopes(g), slopes(u.astype(float))
    pull = gy * uy + gx * ux
    return np.where(pull > 0, True, np.where(pull < 0, False, u))


@operator("feat_active_contour")
def active_contour(df: DataFrame, start: DataFrame, method: str = "regions", iterations: int = 150, smoothing: int = 1, weights: tuple[float, float] = (1.0, 1.0), balloon: float = -1.0, pre_blur: float = 2.0, tile: int = 512) -> DataFrame:
    """(raster_id, y, x, v): 255 inside the contour that grows from start's pixels over 127, in grey rasters (raster_id, y, x, v).

    regions: the means inside and outside, of the whole raster, are parted best (Chan-Vese); edges: a
    balloon stops at edges (geodesic). Both end when two rounds change nothing, as smoothing takes turns,
    or after iterations. A raster whose contour has no inside or no outside any more stays as it is.
    """
    image = gaussian_blur(df, max(3, int(6 * pre_blur + 1) | 1), pre_blur) if pre_blur > 0 else df
    image = image.select(*KEY, (F.round("v") / 255 if pre_blur > 0 else F.col("v") / 255).alias("g"))
    scratch = Scratch(df.sparkSession)
    limit = 0.4
    if method == "edges":
        image = by_tiles(scratch.put("image", image), ["g"], _indicator, "y int, x int, g double", tile, 1)
        image = scratch.put("indicator", image)
        counts = image.groupBy("raster_id", "g").agg(F.count("*").alias("n"))
        w = Window.partitionBy("raster_id")
        upto = counts.withColumn("_upto", F.sum("n").over(w.orderBy("g"))).withColumn("_all", F.sum("n").over(w))
        at = upto.where(F.col("_upto") > F.least(F.col("_all") - 1, F.floor(F.col("_all") * limit))).groupBy("raster_id").agg(F.min("g").alias("limit"))
        image = image.join(at.withColumn("limit", F.col("limit") / abs(balloon) if balloon > 0 else F.col("limit") * abs(balloon)), "raster_id")
    seeds = start.where("v > 127").select(*KEY, F.lit(1).alias("u"))
    image = scratch.put("base", image)
    state = scratch.put("state", image.join(seeds, KEY, "left").fillna(0, ["u"]).withColumn("changed", F.lit(1)))
    done, quiet = 0, 0
    per_round = 1 if method == "regions" else STEPS
    kept = [c for c in image.columns if c not in KEY]
    while done < iterations and quiet < 2:
        steps = min(per_round, iterations - done)
        reach = steps * (2 + 2 * smoothing)
        if method == "regions":
            mean = lambda on: F.avg(F.when(F.col("u") == on, F.col("g")))
            rows = state.join(state.groupBy("raster_id").agg(mean(1).alias("m1"), mean(0).alias("m0")), "raster_id")
            frozen = F.col("m1").isNull() | F.col("m0").isNull()
            rows = rows.withColumn("frozen", frozen.cast("int")).fillna(0.0, ["m1", "m0"])
            compute = _regions(done, smoothing, weights)
            columns = ["g", "u", "m1", "m0", "frozen"]
        else:
            rows, compute, columns = state, _edges(done, steps, smoothing, balloon), ["g", "u", "limit"]
        schema = "y int, x int, " + ", ".join(f"{c} double" for c in kept) + ", u int, changed int"
        state = scratch.put("state", by_tiles(rows, columns, compute, schema, tile, reach))
        scratch.drop_older("state")
        quiet = 0 if state.where("changed = 1").limit(1).count() else quiet + 1
        done += steps
    return state.select(*KEY, (F.col("u") * 255.0).alias("v"))


def _core(t: Tile) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices(next(iter(t.planes.values())).shape)
    return np.nonzero(t.in_core(y + t.y0, x + t.x0))


def _indicator(t: Tile) -> dict:
    y, x = _core(t)
    return {"y": y + t.y0, "x": x + t.x0, "g": (1 / np.sqrt(1 + 100 * np.hypot(*slopes(t.planes["g"]))))[y, x]}


def _regions(first: int, smoothing: int, weights: tuple[float, float]):
    def compute(t: Tile) -> dict:
        before = t.planes["u"] > 0
        u = region_step(before, t.planes["g"], t.planes["m1"], t.planes["m0"], weights)
        for s in range(smoothing):
            u = smoothed(u, first + s)
        u = np.where(t.planes["frozen"] > 0, before, u)
        y, x = _core(t)
        return {"y": y + t.y0, "x": x + t.x0, "g": t.planes["g"][y, x], "u": u[y, x].astype(int), "changed": (u != before)[y, x].astype(int)}

    return compute


def _edges(first: int, steps: int, smoothing: int, balloon: float):
    def compute(t: Tile) -> dict:
        u = before = t.planes["u"] > 0
        changed = np.zeros(u.shape, bool)
        for i in range(steps):
            last = u
            u = edge_step(u, t.planes["g"], t.planes["limit"], balloon)
            for s in range(smoothing):
                u = smoothed(u, first + i + s)
            changed |= u != last
        y, x = _core(t)
        return {"y": y + t.y0, "x": x + t.x0, "g": t.planes["g"][y, x], "limit": t.planes["limit"][y, x], "u": u[y, x].astype(int), "changed": changed[y, x].astype(int)}

    return compute


# Cuts

#: The eight neighbours; each stands beside its opposite.
NEAR = ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1))
FAR = 1e9  # label of what can't reach the sink
PUSHES = 24  # steps in a round
CAPACITIES = ["e", "rt", *(f"r{i}" for i in range(8))]


def _labels_near(d: np.ndarray) -> list[np.ndarray]:
    return [_shift(d - FAR, dy, dx) + FAR for dy, dx in NEAR]


def relaxed(d: np.ndarray, rt: np.ndarray, r: list[np.ndarray], steps: int) -> np.ndarray:
    """Distances to the sink along what is left of the capacities, a number of steps further."""
    for _ in range(steps):
        d = np.minimum(d, np.where(rt > 0, 1.0, FAR))
        for i, n in enumerate(_labels_near(d)):
            d = np.minimum(d, np.where(r[i] > 0, n + 1, FAR))
    return d


def pushed(e: np.ndarray, rt: np.ndarray, r: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """One step of all places at once: excess goes to the sink and to neighbours one label nearer to it, then places with excess left rise above their lowest neighbour."""
    out = np.where(d == 1, np.minimum(e, rt), 0)
    e, rt = e - out, rt - out
    flows = []
    for i, n in enumerate(_labels_near(d)):
        f = np.where((d < FAR) & (d == n + 1), np.minimum(e, r[i]), 0)
        e = e - f
        flows.append(f)
    came = [_shift(f, -dy, -dx) for f, (dy, dx) in zip(flows, NEAR, strict=True)]
    r = [r[i] - flows[i] + came[i ^ 1] for i in range(8)]
    e = e + sum(came)
    lowest = np.where(rt > 0, 1.0, FAR)
    for i, n in enumerate(_labels_near(d)):
        lowest = np.minimum(lowest, np.where(r[i] > 0, np.minimum(n + 1, FAR), FAR))
    return e, rt, r, np.where((e > 0) & (lowest > d), lowest, d)


def min_cut(caps: DataFrame, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, source) of caps(raster_id, y, x, e, rt, r0..r7): whether a pixel lies on the source's side of a least cut.

    e and rt are whole numbers, a pixel's capacities from the source and to the sink, of which one is 0;
    r0 to r7 those to its neighbours NEAR. Push and relabel on all pixels at once, PUSHES steps a round on
    tiles with a halo of twice as much; labels are found anew after each round, and the rounds end when no
    excess can reach the sink. State is written after every round.
    """
    scratch = Scratch(caps.sparkSession)
    schema = "y int, x int, " + ", ".join(f"{c} double" for c in [*CAPACITIES, "d"]) + ", changed int"

    def state_of(t: Tile, e, rt, r, d, changed) -> dict:
        y, x = _core(t)
        return {"y": y + t.y0, "x": x + t.x0, **{c: a[y, x] for c, a in zip([*CAPACITIES, "d"], [e, rt, *r, d], strict=True)}, "changed": changed[y, x].astype(int)}

    def planes(t: Tile) -> tuple:
        return t.planes["e"], t.planes["rt"], [t.planes[f"r{i}"] for i in range(8)], t.planes["d"]

    def label(t: Tile) -> dict:
        e, rt, r, before = planes(t)
        d = relaxed(before, rt, r, 2 * PUSHES)
        return state_of(t, e, rt, r, d, d != before)

    def push(t: Tile) -> dict:
        e, rt, r, d = planes(t)
        for _ in range(PUSHES):
            e, rt, r, d = pushed(e, rt, r, d)
        return state_of(t, e, rt, r, d, np.zeros_like(d))

    state = scratch.put("state", caps.select(*KEY, *CAPACITIES))
    while True:
        state = state.select(*KEY, *CAPACITIES, F.lit(FAR).alias("d"))
        moved = True
        while moved:
            state = scratch.put("state", by_tiles(state, [*CAPACITIES, "d"], label, schema, tile, 2 * PUSHES))
            scratch.drop_older("state")
            moved = state.where("changed = 1").limit(1).count() > 0
        if not state.where((F.col("e") > 0) & (F.col("d") < FAR)).limit(1).count():
            return state.select(*KEY, (F.col("d") >= FAR).alias("source"))
        state = scratch.put("state", by_tiles(state, [*CAPACITIES, "d"], push, schema, tile, 2 * PUSHES))
        scratch.drop_older("state")


COLOURS, GAMMA, UNITS = 5, 50.0, 1000  # colours of a mixture, weight of neighbours, and whole units of capacity


def mixtures(pixels: DataFrame) -> DataFrame:
    """(raster_id, models) of pixels(raster_id, c, k, b, g, r): each mixture c's colours k as means, inverse covariances and log weights, from sums by colour."""
    ch = ("b", "g", "r")
    mean = {a: F.avg(a).alias(f"m{a}") for a in ch}
    two = {a + b: (F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b) + (0.01 if a == b else 0.0)).alias(f"c{a}{b}") for i, a in enumerate(ch) for b in ch[i:]}
    m = pixels.groupBy("raster_id", "c", "k").agg(F.count("*").alias("n"), *mean.values(), *two.values())
    c = lambda a, b: F.col(f"c{min(a, b)}{max(a, b)}")
    bb, bg, br, gg, gr, rr = c("b", "b"), c("b", "g"), c("b", "r"), c("g", "g"), c("g", "r"), c("r", "r")
    det = bb * (gg * rr - gr * gr) - bg * (bg * rr - gr * br) + br * (bg * gr - gg * br)
    inverse = {"ibb": gg * rr - gr * gr, "ibg": br * gr - bg * rr, "ibr": bg * gr - br * gg, "igg": bb * rr - br * br, "igr": bg * br - bb * gr, "irr": bb * gg - bg * bg}
    weight = F.log(F.col("n") / F.sum("n").over(Window.partitionBy("raster_id", "c"))) - F.log(F.greatest(det, F.lit(1e-12))) / 2
    m = m.select("raster_id", F.struct("c", "k", "mb", "mg", "mr", weight.alias("w"), *[(v / F.greatest(det, F.lit(1e-12))).alias(n) for n, v in inverse.items()]).alias("m"))
    return m.groupBy("raster_id").agg(F.array_sort(F.collect_list("m")).alias("models"))


def _log_density(m: Column) -> Column:
    b, g, r = F.col("b") - m["mb"], F.col("g") - m["mg"], F.col("r") - m["mr"]
    return m["w"] - (b * b * m["ibb"] + g * g * m["igg"] + r * r * m["irr"] + 2 * (b * g * m["ibg"] + b * r * m["ibr"] + g * r * m["igr"])) / 2


def _cost(side: int) -> Column:
    """-log of a mixture's density; a mixture without pixels costs as much as a sure place."""
    logs = F.transform(F.filter("models", lambda m: m["c"] == side), _log_density)
    top = F.array_max(logs)
    return F.coalesce(-(top + F.log(F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))), F.lit(9 * GAMMA))


def _links(t: Tile) -> dict:
    p = t.planes
    y, x = _core(t)
    out = {"y": y + t.y0, "x": x + t.x0, "e": p["e"][y, x], "rt": p["rt"][y, x]}
    there = np.ones(p["b"].shape)
    for i, (dy, dx) in enumerate(NEAR):
        far = sum((p[c] - _shift(p[c], dy, dx)) ** 2 for c in "bgr")
        link = np.rint(UNITS * GAMMA / math.hypot(dy, dx) * np.exp(-p["beta"] * far))
        out[f"r{i}"] = (link * _shift(there, dy, dx))[y, x]
    return out


def _contrast(t: Tile) -> dict:
    y, x = _core(t)
    there = np.ones(t.planes["b"].shape)
    total, n = np.zeros_like(there), np.zeros_like(there)
    for dy, dx in NEAR[::2]:
        ok = _shift(there, dy, dx)
        total += ok * sum((t.planes[c] - _shift(t.planes[c], dy, dx)) ** 2 for c in "bgr")
        n += ok
    return {"total": np.array([total[y, x].sum()]), "n": np.array([n[y, x].sum()])}


@operator("feat_grabcut")
def grabcut(image: DataFrame, hints: DataFrame, iterations: int = 5, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, v): 255 in the foreground of image(raster_id, y, x, b, g, r), by hints(raster_id, y, x, v): 0 surely background, 1 surely foreground, 2 and 3 likely so; other pixels are likely background.

    In each round both sides' colours are mixtures of COLOURS normal ones, learnt from the sides as they
    are, and a least cut deals the pixels that are not sure to the sides anew: leaving a side costs its
    mixture's -log density, and parting neighbours the more, the more alike they are. A raster without
    any foreground stays background.
    """
    scratch = Scratch(image.sparkSession)
    p = image.join(hints.select(*KEY, F.col("v").cast("int").alias("hint")), KEY, "left").fillna(2, ["hint"])
    gaps = by_tiles(image, ["b", "g", "r"], _contrast, "total double, n double", tile, 1).groupBy("raster_id").agg((F.sum("total") / F.sum("n")).alias("mean"))
    p = p.join(gaps.select("raster_id", F.coalesce(F.try_divide(F.lit(0.5), F.col("mean")), F.lit(0.0)).alias("beta")), "raster_id")
    p = p.withColumn("c", F.col("hint").isin(1, 3).cast("int")).withColumn("grey", 0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r"))
    p = scratch.put("pixels", p)
    cuts = p.groupBy("raster_id", "c").agg(F.percentile("grey", F.array(*[F.lit(i / COLOURS) for i in range(1, COLOURS)])).alias("q"))
    first = p.join(cuts, ["raster_id", "c"]).withColumn("k", F.size(F.filter("q", lambda q: q < F.col("grey")))).drop("q")
    models = mixtures(first)
    for _ in range(iterations):
        seen = p.join(models, "raster_id")
        own = F.array_max(F.transform(F.filter("models", lambda m: m["c"] == F.col("c")), lambda m: F.struct(_log_density(m).alias("l"), m["k"].alias("k"))))["k"]
        models = scratch.put("models", mixtures(seen.withColumn("k", own).drop("models")))
        costs = p.join(models, "raster_id")
        sure = lambda hint, other, cost: F.when(F.col("hint") == hint, F.lit(9 * GAMMA)).when(F.col("hint") == other, F.lit(0.0)).otherwise(cost)
        costs = costs.select(*KEY, "b", "g", "r", "beta", F.rint(UNITS * sure(1, 0, _cost(0))).alias("s"), F.rint(UNITS * sure(0, 1, _cost(1))).alias("t"))
        tied = costs.withColumn("e", F.greatest(F.lit(0.0), F.col("s") - F.col("t"))).withColumn("rt", F.greatest(F.lit(0.0), F.col("t") - F.col("s")))
        caps = by_tiles(tied, ["b", "g", "r", "beta", "e", "rt"], _links, "y int, x int, " + ", ".join(f"{c} double" for c in CAPACITIES), tile, 1)
        side = min_cut(caps, tile).withColumnRenamed("source", "fore")
        p = scratch.put("pixels", p.drop("c").join(side, KEY).withColumn("c", F.when(F.col("hint") == 0, 0).when(F.col("hint") == 1, 1).otherwise(F.col("fore").cast("int"))).drop("fore"))
    return p.select(*KEY, (F.col("c") * 255.0).alias("v"))

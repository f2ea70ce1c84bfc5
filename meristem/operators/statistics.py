"""Descriptive and robust statistics, grouped by any keys. A list is a column of values; an empty one gives 0 where the plain statistics do."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import cut


def _value(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("__v", F.col(value).cast("double")).where("__v is not null and not isnan(__v)")


@operator("sci_stats")
def stats(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean, median, population deviation, minimum, maximum."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    forms = {"mean": F.avg(v), "median": F.median(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    return df.groupBy(*by).agg(*[F.coalesce(f, F.lit(0.0)).alias(n) for n, f in forms.items()])


@operator("feat_list_aggregator")
def list_aggregator(df: DataFrame, value: str, by: list[str] = [], per_unit: float = 1.0, is_area: bool = False) -> DataFrame:  # noqa: B006
    """Count, average, deviation, minimum, maximum and total of calibrated values."""
    v = F.col(value).cast("double") / (per_unit**2 if is_area else per_unit)
    return df.groupBy(*by).agg(F.count(v).alias("count"), *[F.bround(F.coalesce(f, F.lit(0.0)), 4).alias(n) for n, f in (("avg", F.avg(v)), ("std", F.stddev_pop(v)), ("min", F.min(v)), ("max", F.max(v)), ("total", F.sum(v)))])


@operator("sci_robust_location")
def robust_location(df: DataFrame, value: str, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean, median, and what the last value in order adds to each."""
    v = _value(df, value)
    lasts = v.groupBy(*by).agg(F.max(F.struct(order, "__v"))["__v"].alias("last"), F.max(order).alias("__last"))
    joined = v.join(lasts, by) if by else v.crossJoin(F.broadcast(lasts))
    rest = F.when(F.col(order) < F.col("__last"), F.col("__v"))
    out = joined.groupBy(*by).agg(F.avg("__v").alias("mean"), F.median("__v").alias("median"), F.avg(rest).alias("m"), F.median(rest).alias("d"))
    return out.select(*by, F.bround("mean", 4).alias("mean"), F.bround("median", 4).alias("median"), F.bround(F.col("mean") - F.col("m"), 4).alias("mean_influence"), F.bround(F.col("median") - F.col("d"), 4).alias("median_influence"))


def _mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = _value(df, value)
    med = v.groupBy(*by).agg(F.median("__v").alias("median"))
    joined = v.join(med, by) if by else v.crossJoin(F.broadcast(med))
    mad = joined.groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col("__v") - F.col("median"))).alias("mad"))
    return (v.join(mad, by) if by else v.crossJoin(F.broadcast(mad))).withColumn("sigma_hat", 1.4826 * F.col("mad"))


@operator("sci_mad_scale")
def mad_scale(df: DataFrame, value: str, by: list[str] = [], z_threshold: float = 3.5) -> DataFrame:  # noqa: B006
    """Median, median absolute deviation, its normal-consistent scale, and how many values have a modified z over the threshold (none if the deviation is 0)."""
    z = 0.6745 * (F.col("__v") - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return _mad(df, value, by).groupBy(*by, "median", "mad", "sigma_hat").agg(F.count_if(F.abs(z) > z_threshold).alias("outliers"), F.count("*").alias("count"))


@operator("sci_m_estimator")
def m_estimator(df: DataFrame, value: str, by: list[str], kernel: str = "huber", k_sigma: float = 1.345, iterations: int = 10) -> DataFrame:
    """Location by iterated reweighting from the median; Huber or Tukey weights at k normal-consistent scales. A round joins the values with the groups' estimates, which stay small, and sums with partial aggregates."""
    values = _value(df, value).select(*by, "__v")
    state = _mad(df, value, by).groupBy(*by).agg(F.first("median").alias("m"), F.greatest(F.first("sigma_hat"), F.lit(1e-12)).alias("s"))
    for _ in range(iterations):
        state = cut(state)
        u = F.abs(F.col("__v") - F.col("m")) / (k_sigma * F.col("s"))
        w = F.when(u <= 1, F.lit(1.0)).otherwise(1 / u) if kernel == "huber" else F.when(u < 1, F.pow(1 - u * u, F.lit(2))).otherwise(F.lit(0.0))
        state = values.join(state, by).groupBy(*by).agg(F.coalesce(F.sum(w * F.col("__v")) / F.nullif(F.sum(w), F.lit(0.0)), F.first("m")).alias("m"), F.first("s").alias("s"))
    means = values.groupBy(*by).agg(F.avg("__v").alias("ls_estimate"))
    return state.select(*by, F.col("m").alias("estimate")).join(means, by)


@operator("sci_robust_stats")
def robust_stats(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    out = _mad(df, value, by)
    return out.groupBy(*by, "median", "mad").agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"), F.count("*").alias("count"))


@operator("list_natural_break")
def natural_break(df: DataFrame, value: str, by: list[str], log_scale: bool = False, min_value: float | None = None) -> DataFrame:
    """The split of values with the largest between-class variance; the threshold is midway between its neighbours. Equal values are counted first, so groups are as long as their distinct values."""
    v = _value(df, value)
    v = v.where(F.col("__v") >= min_value) if min_value is not None else v
    v = v.where("__v > 0").withColumn("x", F.log("__v")) if log_scale else v.withColumn("x", F.col("__v"))
    cells = v.groupBy(*by, "x").agg(F.count("*").alias("n"))
    to, whole = Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    c = cells.select(*by, "x", F.sum("n").over(to).alias("n0"), F.sum(F.col("x") * F.col("n")).over(to).alias("s0"), F.sum("n").over(whole).alias("n_all"), F.sum(F.col("x") * F.col("n")).over(whole).alias("s_all"), F.lead("x").over(Window.partitionBy(*by).orderBy("x")).alias("next"))
    n1 = F.col("n_all") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / n1
    best = c.where("next is not null").withColumn("between", F.bround(F.col("n0") * n1 * gap * gap, 6))
    top = best.groupBy(*by).agg(F.max_by(F.struct(((F.col("x") + F.col("next")) / 2).alias("t"), "n0", n1.alias("n1")), F.struct("between", -F.col("x"))).alias("s"))
    t = F.exp("s.t") if log_scale else F.col("s.t")
    return top.select(*by, t.alias("threshold"), F.col("s.n1").alias("count_above"), F.col("s.n0").alias("count_below"))


@operator("sci_kmeans_list")
def kmeans_list(df: DataFrame, value: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds cluster_id, clusters numbered by rising centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["__v"], outputCol="__f").transform(_value(df, value))
    model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="__c").fit(rows)
    rank = {c: i for i, c in enumerate(sorted(range(len(model.clusterCenters())), key=lambda c: model.clusterCenters()[c][0]))}
    place = F.create_map(*[x for c, i in rank.items() for x in (F.lit(c), F.lit(i))])
    return model.transform(rows).withColumn("cluster_id", place[F.col("__c")]).drop("__f", "__c", "__v")


@operator("sci_matrix_dist")
def matrix_distribution(df: DataFrame, value: str, bins: int = 8, log_scale: bool = False, cumulative: bool = False) -> DataFrame:
    """Histogram (at least 8 bins) of all values, optionally running and as log10(1 + n)."""
    bins = max(8, bins)
    v = _value(df, value)
    ends = v.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0)).cast("int")
    out = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").cast("double").alias("count"))
    if cumulative:
        out = out.withColumn("count", F.sum("count").over(Window.orderBy("bin")))  # one row per bin
    return out.withColumn("count", F.log10(1 + F.col("count"))) if log_scale else out


@operator("geo_grain_histogram")
def grain_histogram(regions: DataFrame, area: str = "area", metric: str = "diameter", by: list[str] = []) -> DataFrame:  # noqa: B006
    """d10, d50, d90, mean and deviation of equivalent diameters (or areas)."""
    v = F.sqrt(4 * F.col(area) / math.pi) if metric == "diameter" else F.col(area).cast("double")
    q = [F.percentile(v, F.lit(p)).alias(n) for p, n in ((0.1, "d10"), (0.5, "d50"), (0.9, "d90"))]
    return regions.groupBy(*by).agg(F.count("*").alias("count"), *q, F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


@operator("sci_zone_stats")
def zone_stats(pixels: DataFrame, zones: DataFrame, min_area: int = 0, max_area: int | None = None) -> DataFrame:
    """Regions (raster_id, y, x, label over 0) by the zone (raster_id, y, x, zone) at their rounded centroid: count, mean and total area."""
    regions = pixels.where("label > 0").groupBy("raster_id", "label").agg(F.count("*").alias("area"), F.floor(F.avg("y") + 0.5).alias("y"), F.floor(F.avg("x") + 0.5).alias("x"))
    regions = regions.where(F.col("area") >= min_area)
    regions = regions.where(F.col("area") <= max_area) if max_area is not None else regions
    return regions.join(zones, ["raster_id", "y", "x"]).groupBy("raster_id", "zone").agg(F.count("*").alias("count"), F.avg("area").alias("mean_area"), F.sum("area").alias("total_area"))


@operator("sci_range_checker")
def range_checker(values: DataFrame, ranges: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """values(key, value) to status by [low, warn low, warn high, high]: CRITICAL outside, LOW or HIGH between, else OK; keys without a range are left out."""
    status = F.lit(None).cast("string")
    v = F.col("value")
    for key, (low, warn_low, warn_high, high) in ranges.items():
        own = F.when((v < low) | (v > high), "CRITICAL").when(v < warn_low, "LOW").when(v > warn_high, "HIGH").otherwise("OK")
        status = F.when(F.col("key") == key, own).otherwise(status)
    return values.withColumn("status", status).where("status is not null")


@operator("ml_training_monitor")
def training_monitor(history: DataFrame, smooth: int = 3) -> DataFrame:
    """history(run, epoch, train_loss, val_loss): per run the best epoch (first least validation loss), the last losses, and the last moving average of the training loss."""
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(-(smooth - 1), 0)
    rows = history.withColumn("avg", F.avg("train_loss").over(w))
    last = lambda c: F.max_by(c, "epoch")
    return rows.groupBy("run").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), last("train_loss").alias("final_train_loss"), last("val_loss").alias("final_val_loss"), last("avg").alias("smooth_train_loss"))


@operator("ml_best_params")
def best_params(history: DataFrame, weights: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """history(step, metrics...): the step with the largest weighted sum of metrics (the first of equals)."""
    score: Column = F.lit(0.0)
    for name, w in weights.items():
        score = score + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return history.withColumn("score", score).groupBy(*by).agg(F.max_by("step", F.struct("score", -F.col("step"))).alias("best_step"), F.max("score").alias("best_score"))


def _in_order(term: Column) -> Column:
    """A sum over few bins in the order of the bins, so that it rounds the same whatever the tasks."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct("bin", term.alias("t")))), F.lit(0.0), lambda s, x: s + x["t"])


@operator("sci_hist_compare")
def histogram_distance(a: DataFrame, b: DataFrame, by: list[str], metric: str = "bhattacharyya", bins: int = 32, top: float = 256.0) -> DataFrame:
    """Distance of two tables' normalised histograms of v in [0, top): bhattacharyya (at most 5), chi2, wasserstein (mean difference of the running sums) or correlation ((1 - r) / 2)."""
    def hist(df: DataFrame, name: str) -> DataFrame:
        h = df.groupBy(*by, F.least(F.lit(bins - 1), F.floor(F.col("v") * bins / top)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
        return h.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*by))).drop("n")

    full = hist(a, "p").join(hist(b, "q"), [*by, "bin"], "outer").fillna(0.0, ["p", "q"])
    if metric == "bhattacharyya":
        value = F.least(F.lit(5.0), -F.log(F.greatest(_in_order(F.sqrt(F.col("p") * F.col("q") + 1e-8)), F.lit(1e-8))))
    elif metric == "chi2":
        value = _in_order(F.coalesce(F.try_divide(F.pow(F.col("p") - F.col("q"), F.lit(2)), F.col("p") + F.col("q")), F.lit(0.0))) / 2
    elif metric == "wasserstein":
        grid = full.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        full = grid.join(full, [*by, "bin"], "left").fillna(0.0, ["p", "q"]).withColumn("d", F.sum(F.col("p") - F.col("q")).over(Window.partitionBy(*by).orderBy("bin")))
        value = F.sum(F.abs("d")) / bins
    else:
        grid = full.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        full = grid.join(full, [*by, "bin"], "left").fillna(0.0, ["p", "q"])
        value = (1 - F.corr("p", "q")) / 2
    return full.groupBy(*by).agg(value.alias("distance"))

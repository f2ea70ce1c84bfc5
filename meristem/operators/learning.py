"""Machine-learning operators: spark.ml where it has the model, aggregates and joins elsewhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import cut
from . import kernels
from .trees import grow, importances, leaves_of, poisson


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean by their population deviation; a constant one is only centred."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    d = df.crossJoin(F.broadcast(one))
    d = d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-6, F.col(f"_s_{c}")).otherwise(1.0) for c in features})
    return d.drop(*[f"_{k}_{c}" for k in "ms" for c in features])


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip").transform(df)


@operator("ml_train_test_split")
def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.25, seed: int = 42, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ceil(test_size * n) test rows (per stratum): those whose hashes of seed and key come first. Counts by hash prefix find where the share ends, so only one prefix per stratum is sorted. The rows differ from those of a generator's permutation."""
    by = [stratify] if stratify else []
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    d = df.withColumn("__mark", mark).withColumn("__p", F.substring("__mark", 1, 3))
    counts = d.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__goal", F.ceil(F.sum("__c").over(w) * F.lit(test_size)))
    d = d.join(counts, [*by, "__p"])
    whole = F.col("__before") + F.col("__c") <= F.col("__goal")
    rank = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__mark", *key))
    part = d.where(~whole & (F.col("__before") < F.col("__goal"))).withColumn("__test", F.col("__before") + rank <= F.col("__goal"))
    rest = d.where(whole | (F.col("__before") >= F.col("__goal"))).withColumn("__test", whole)
    marked = part.unionByName(rest)
    return marked.where("not __test").select(*df.columns), marked.where("__test").select(*df.columns)


@operator("ml_kmeans")
def kmeans(df: DataFrame, features: list[str], k: int = 3, standardized: bool = True, seed: int = 42, max_iter: int = 100, n_init: int = 3, init: str = "k-means||") -> tuple[DataFrame, float]:
    """(rows with cluster, inertia): the best of n_init starts; clusters are numbered by size, largest first."""
    d = assembled(standardise(df, features) if standardized else df, features)
    models = [KMeans(k=k, seed=seed + i, maxIter=max_iter, initMode=init, featuresCol="__features", predictionCol="__c").fit(d) for i in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = sorted(range(k), key=lambda i: -best.summary.clusterSizes[i])
    place = F.create_map(*[x for n, i in enumerate(order) for x in (F.lit(i), F.lit(n))])
    raw = assembled(df, features) if not standardized else d
    return best.transform(raw).withColumn("cluster", place[F.col("__c")]).drop("__features", "__c"), best.summary.trainingCost


def elbow(df: DataFrame, features: list[str], k_max: int = 10, standardized: bool = True, seed: int = 42) -> DataFrame:
    """(k, inertia) for k = 1 .. k_max; one cluster's is the spread around the mean."""
    d = standardise(df, features) if standardized else df
    one = d.agg(F.lit(1).alias("k"), sum((F.var_pop(f) * F.count(f) for f in features), F.lit(0.0)).alias("inertia"))
    rest = [(k, float(kmeans(df, features, k, standardized, seed)[1])) for k in range(2, k_max + 1)]
    return one.unionByName(df.sparkSession.createDataFrame(rest, "k int, inertia double")) if rest else one


@operator("ml_pca")
def pca(df: DataFrame, features: list[str], n: int = 2, standardized: bool = True) -> tuple[DataFrame, list[float]]:
    """(rows with PC1..PCn, explained shares in percent); each component's largest loading is positive."""
    d = assembled(standardise(df, features), features) if standardized else assembled(df, features)
    model = PCA(k=n, inputCol="__features", outputCol="__pc").fit(d)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(n)]
    if standardized is False:
        one = d.agg(*[F.avg(c).alias(c) for c in features]).first()
        shift = np.array([one[c] for c in features]) @ loadings
    else:
        shift = np.zeros(n)
    pc = vector_to_array(F.col("__pc"))
    out = model.transform(d).withColumns({f"PC{i + 1}": (F.get(pc, F.lit(i)) - float(shift[i])) * signs[i] for i in range(n)})
    return out.drop("__features", "__pc"), [100 * v for v in model.explainedVariance.toArray().tolist()]


def distance(a: list[Column], b: list[Column], metric: str = "euclidean") -> Column:
    d = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    if metric == "manhattan":
        return sum(d, F.lit(0.0))
    if metric == "chebyshev":
        return F.greatest(*d) if len(d) > 1 else d[0]
    return F.sqrt(sum((x * x for x in d), F.lit(0.0)))


NEAR_BLOCK, FOLD = 65_536, 16
TILE = 2048  # queries and rows of a product of matrices
SPREAD = 8  # blocks of a side, at least, that has rows for them


def _far(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a few queries to a block of rows."""
    d = np.abs(q[:, None] - t[None])
    return d.sum(axis=2) if metric == "manhattan" else d.max(axis=2) if metric == "chebyshev" else np.sqrt((d * d).sum(axis=2))


def _candidates(q: np.ndarray, t: np.ndarray, k: int, apart: np.ndarray | None, kind: type, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of t) of all pairs that may be among a query's k nearest, for all the rounding of one product of matrices; of those no farther than within, if it is given.

    The columns are read as lines of FOLD; the k-th least of the lines' least is not under the k-th least
    of all, and takes a fraction of the time to find.
    """
    middle = t.mean(axis=0)
    q, t = q - middle, t - middle
    with np.errstate(over="ignore", invalid="ignore"):
        own, long = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", t, t)
        most = 4 * (own.max(initial=0) + long.max(initial=0))
    if not most < float(np.finfo(kind).max):
        if kind is np.float64:  # all pairs
            every = np.ones((len(q), len(t)), bool)
            if apart is not None:
                every[apart[:, 0], apart[:, 1]] = False
            return np.nonzero(every)
        return _candidates(q + middle, t + middle, k, apart, np.float64, within)
    left, right = np.empty((len(q), q.shape[1] + 1), kind), np.empty((len(t), t.shape[1] + 1), kind)
    left[:, :-1], left[:, -1], right[:, :-1], right[:, -1] = -2 * q, 1, t, long
    d = left @ right.T
    if apart is not None:
        d[apart[:, 0], apart[:, 1]] = np.inf
    slack = 4 * (q.shape[1] + 4) * float(np.finfo(kind).eps) * (own + long.max(initial=0))

    def under(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No pair under the bound is lost by the bound's own rounding, and none that is apart is under it."""
        top = np.minimum(np.nextafter((bound + slack).astype(kind), kind(np.inf)), np.finfo(kind).max)
        at = np.flatnonzero(d <= top[:, None])
        return at // len(t), at % len(t)

    if within is not None and np.isfinite(within).all():
        found = under(within * within - own)
        if len(found[0]) <= 16 * k * len(q):
            return found
    lines = d.shape[1] // FOLD
    if lines > k:
        least = d[:, : lines * FOLD].reshape(len(d), FOLD, lines).min(axis=1)
        last = np.partition(least, k - 1, axis=1)[:, k - 1]
    else:
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    bound = last.astype(float)
    if within is not None:
        bound = np.minimum(bound, within * within - own)
    return under(bound)


def _first(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each a by distance and place."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], d[place < k]


def _close(q: np.ndarray, t: np.ndarray, k: int, metric: str, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, distance) of each query's k nearest by distance and place; the pairs in apart (two columns) are left out.

    Euclidean distances come from a product of matrices first, and only pairs that may be among the k by
    these, for all their rounding, are measured one by one. Of zeros and ones the product is the count of
    places that differ.
    """
    bits = metric == "manhattan" and all(((m == 0) | (m == 1)).all() for m in (q, t))
    if not bits and (metric != "euclidean" or not (np.isfinite(q).all() and np.isfinite(t).all())):
        d = _far(q, t, metric)
        if apart is not None:
            d[apart[:, 0], apart[:, 1]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(len(d)), best.shape[1]), best.ravel(), np.take_along_axis(d, best, axis=1).ravel()
    if bits:  # equal distances are many, and exact: of these the first places
        d = (q * q).sum(1)[:, None] + (t * t).sum(1)[None] - 2 * (q @ t.T)
        if apart is not None:
            d[apart[:, 0], apart[:, 1]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
        under = d < last
        tied = d == last
        a, b = np.nonzero(under | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - under.sum(1, keepdims=True)))) if d.shape[1] > k else np.nonzero(d < np.inf)
        return _first(a, b, d[a, b], k)
    out, most = [], max(1, (1 << 22) // max(1, q.shape[1]))
    by_t = None if apart is None else apart[np.lexsort((apart[:, 1], apart[:, 0] // TILE))]  # by tiles of queries, in these by row of t
    for s in range(0, len(q), TILE):  # a tile of queries meets one of rows after the other, each within the k nearest so far
        x, own = q[s : s + TILE], None
        a, b, found, within = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.full(len(x), np.inf)
        if by_t is not None:
            own = by_t[slice(*np.searchsorted(by_t[:, 0] // TILE, [s // TILE, s // TILE + 1]))]
        for u in range(0, len(t), TILE):
            y = t[u : u + TILE]
            off = None if own is None else own[slice(*np.searchsorted(own[:, 1], [u, u + TILE]))] - [s, u]
            i, j = _candidates(x, y, k, off, np.float32, within)
            if len(i) > 64 * k * len(x):  # rows so near to each other that rounding hides which are nearest
                i, j = _candidates(x, y, k, off, np.float64, within)
            far = np.concatenate([np.zeros(0), *[np.sqrt(((x[i[n : n + most]] - y[j[n : n + most]]) ** 2).sum(axis=1)) for n in range(0, len(i), most)]])
            a, b, found = _first(np.concatenate([a, i]), np.concatenate([b, j + u]), np.concatenate([found, far]), k)
            full = np.flatnonzero(np.bincount(a, minlength=len(x)) == k)
            within[full] = found[np.searchsorted(a, full, side="right") - 1]
        out.append((a + s, b, found))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", others: bool = False) -> DataFrame:
    """(q, t, d, r): the k nearest rows of train(t, v array of doubles or floats) to each of queries(q, v), by distance and then t; of those with t <> q if others.

    Both sides are dealt into blocks of at most about NEAR_BLOCK rows (fewer of more than 64 numbers), and
    into SPREAD blocks where these have enough rows; a task meets one block of each and passes on k rows a
    query, so rows move once for each block of the other side, and no pair leaves its task that is not
    among its block's nearest.
    """

    def blocks(d: DataFrame) -> int:
        n, width = d.agg(F.count("*"), F.max(F.size("v"))).first()
        most = max(8, NEAR_BLOCK * 64 // max(64, width or 0))
        return max(1, -(-n // most), min(SPREAD, -(-n // (most // 8))))

    n_q, n_t = blocks(queries), blocks(train)
    parts = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    q = queries.select(F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int").alias("a"), parts(n_t).alias("b"), "q", "v")
    t = train.select(parts(n_q).alias("_a"), F.pmod(F.xxhash64("t"), F.lit(n_t)).cast("int").alias("_b"), "t", "v")
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "q"), (train, "t"))}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [left.column("q").slice(0, 0), right.column("t").slice(0, 0), pa.array([], pa.float64())]
        if left.num_rows and right.num_rows:
            right = right.sort_by("t")
            x, y = (c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1) for c in (left.column("v"), right.column("v")))
            asked, own = left.column("q").to_pylist(), {}
            if others:
                for i, name in enumerate(right.column("t").to_pylist()):
                    own.setdefault(name, []).append(i)
            rows, cols, far = [], [], []
            quick = metric == "manhattan" and ((y == 0) | (y == 1)).all()
            step = len(x) if metric == "euclidean" else max(1, (1 << 22) // (len(y) if quick else y.size))
            for s in range(0, len(x), step):
                apart = np.array([(i, j) for i, name in enumerate(asked[s : s + step]) for j in own.get(name, ())], int).reshape(-1, 2) if others else None
                a, b, d = _close(x[s : s + step], y, k, metric, apart)
                rows.append(a + s), cols.append(b), far.append(d)
            found = [left.column("q").take(pa.array(np.concatenate(rows))), right.column("t").take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(far))]
        return pa.table(found, names=["q", "t", "d"])

    near = q.groupBy("a", "b").cogroup(t.groupBy("_a", "_b")).applyInArrow(run, f"q {types['q']}, t {types['t']}, d double")
    near = near.where(F.col("d") < float("inf"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))).where(F.col("r") <= k)


@operator("ml_knn_classifier")
def knn_classify(train: DataFrame, test: DataFrame, features: list[str], target: str, key: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform") -> DataFrame:
    """test rows with prediction by vote of the k nearest train rows (ties: smaller key; equal votes: smaller class)."""
    v = F.array(*[F.col(f).cast("double") for f in features]).alias("v")
    near = nearest(test.select(F.col(key).alias("q"), v), train.select(F.col(key).alias("t"), v), k, metric)
    near = near.join(train.select(F.col(key).alias("t"), F.col(target).alias("__y")), "t").withColumn("__exact", F.min("d").over(Window.partitionBy("q")) == 0)
    vote = F.lit(1.0) if weights == "uniform" else F.when(F.col("__exact"), (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    votes = near.groupBy(F.col("q").alias("__qk"), "__y").agg(F.bround(F.sum(vote), 9).alias("__v"))
    won = votes.withColumn("__n", F.row_number().over(Window.partitionBy("__qk").orderBy(F.desc("__v"), "__y"))).where("__n = 1").select("__qk", F.col("__y").alias("prediction"))
    return test.join(won, F.col(key) == F.col("__qk")).drop("__qk")


@operator("ml_linear_regression")
def linear_regression(train: DataFrame, features: list[str], target: str, intercept: bool = True) -> tuple[LinearRegression, dict[str, float]]:
    """(model, coefficients by name with intercept) by the normal equations."""
    d = assembled(train, features).withColumn("__y", F.col(target).cast("double"))
    m = LinearRegression(featuresCol="__features", labelCol="__y", fitIntercept=intercept, solver="normal", regParam=0.0, standardization=False).fit(d)
    return m, dict(zip(features, m.coefficients.toArray().tolist(), strict=True)) | {"intercept": m.intercept}


def regression_scores(predicted: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: r2 (0 where the target is constant) and rmse."""
    y, e = F.col(target).cast("double"), F.col(target).cast("double") - F.col(prediction)
    total = F.var_pop(y) * F.count(y)
    return predicted.agg(F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(0.0).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


@operator("ml_cluster_validity")
def cluster_validity(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """One row: calinski_harabasz, davies_bouldin, and dunn from centroids (least distance of two by twice the largest distance of a row to its own)."""
    centre = df.groupBy(cluster).agg(*[F.avg(f).alias(f"_c_{f}") for f in features], F.count("*").alias("_n"))
    mean = df.agg(*[F.avg(f).alias(f"_g_{f}") for f in features])
    own = distance([F.col(f) for f in features], [F.col(f"_c_{f}") for f in features])
    within = df.join(centre, cluster).groupBy(cluster).agg(F.sum(own * own).alias("_w"), F.avg(own).alias("_s"), F.max(own).alias("_m"))
    c = centre.join(within, cluster).crossJoin(F.broadcast(mean))
    between = distance([F.col(f"_c_{f}") for f in features], [F.col(f"_g_{f}") for f in features])
    other = c.select(F.col(cluster).alias("_o"), F.col("_s").alias("_os"), *[F.col(f"_c_{f}").alias(f"_o_{f}") for f in features])
    gap = distance([F.col(f"_c_{f}") for f in features], [F.col(f"_o_{f}") for f in features])
    pair = c.join(other, F.col(cluster) != F.col("_o")).withColumn("_gap", gap)
    db = pair.groupBy(cluster).agg(F.max((F.col("_s") + F.col("_os")) / F.col("_gap")).alias("_r"), F.min("_gap").alias("_least"))
    k, n = F.count("*"), F.sum("_n")
    return c.join(db, cluster).agg((F.sum(between * between * F.col("_n")) / (k - 1) / (F.sum("_w") / (n - k))).alias("calinski_harabasz"), F.avg("_r").alias("davies_bouldin"), (F.min("_least") / (2 * F.max("_m"))).alias("dunn"))


@operator("ml_classification_report")
def classification_report(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support), 0 where undefined."""
    cells = df.groupBy(F.col(target).cast("string").alias("t"), F.col(prediction).cast("string").alias("p")).agg(F.count("*").alias("n"))
    t = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    d = t.join(p, "label", "outer").fillna(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return d.select("label", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def _numbered(train: DataFrame, features: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """(train rows with their class's number and features as one array, classes(y, name)); classes are numbered by name."""
    d = train.where(F.col(target).isNotNull())
    classes = cut(d.select(F.col(target).cast("string").alias("name")).distinct().withColumn("y", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")) - 1))
    f = F.array(*[F.col(c).cast("double") for c in features]).alias("f")
    return d.select(F.col(target).cast("string").alias("name"), f).join(F.broadcast(classes), "name").select("y", "f").where(F.forall("f", lambda x: x.isNotNull())), classes


@operator("ml_decision_tree")
def decision_tree(train: DataFrame, test: DataFrame, features: list[str], target: str, criterion: str = "gini", max_depth: int = 5, min_samples_leaf: int = 1, min_samples_split: int = 2) -> tuple[DataFrame, dict[str, float]]:
    """(test rows with prediction, importances) of an exact tree: thresholds are midpoints between neighbouring values. Training rows with nulls are left out; a null test value goes right."""
    rows, classes = _numbered(train, features, target)
    trees = grow(rows.select(F.lit(0).alias("tree"), F.lit(1).alias("w"), "y", "f"), classes.count(), len(features), len(features), criterion, max_depth, min_samples_split, min_samples_leaf)
    asked = test.select(F.struct("*").alias("row"), F.array(*[F.col(c).cast("double") for c in features]).alias("f"), F.lit(0).alias("tree"))
    out = leaves_of(asked, trees, max_depth).join(F.broadcast(classes), F.col("prediction") == F.col("y")).select("row.*", F.col("name").alias("prediction"))
    return out, importances(trees, features)


@operator("ml_random_forest")
def random_forest(train: DataFrame, test: DataFrame, features: list[str], target: str, n_estimators: int = 20, max_depth: int = 5, max_features: str = "sqrt", seed: int = 42) -> tuple[DataFrame, dict[str, float], float]:
    """(test rows with prediction, importances, out-of-bag score). Trees vote with their leaves' class shares.

    A row is in a tree's bag as often as a Poisson number of mean 1, drawn by hash of its values, says;
    the out-of-bag score is the share of rows that the trees without them get right. All trees grow in
    the same passes.
    """
    rows, classes = _numbered(train, features, target)
    k, tried = classes.count(), {"sqrt": max(1, math.isqrt(len(features))), "log2": max(1, int(math.log2(len(features)))), "all": len(features)}[max_features]
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()))
    uniform = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    bags = rows.select("id", "y", "f", F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))).alias("tree")).withColumn("w", poisson(uniform))
    trees = cut(grow(bags, k, len(features), tried, max_depth=max_depth, seed=seed))
    shares = [(F.sum(F.col(f"c{i}") / F.col("n"))).alias(f"v{i}") for i in range(k)]
    winner = -F.array_max(F.array(*[F.struct(F.bround(F.col(f"v{i}"), 9).alias("v"), F.lit(-i).alias("i")) for i in range(k)]))["i"]
    out_of_bag = leaves_of(bags.where("w = 0").select("id", F.col("y").alias("was"), "f", "tree"), trees, max_depth).groupBy("id", "was").agg(*shares)
    score = out_of_bag.agg(F.avg((winner == F.col("was")).cast("double"))).first()[0] or 0.0
    asked = cut(test.select(F.struct("*").alias("row"), F.array(*[F.col(c).cast("double") for c in features]).alias("f"), F.monotonically_increasing_id().alias("id")))
    voted = leaves_of(asked.select("id", "f", F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))).alias("tree")), trees, max_depth).groupBy("id").agg(*shares)
    named = voted.select("id", winner.alias("y")).join(F.broadcast(classes), "y")
    return asked.join(named, "id").select("row.*", F.col("name").alias("prediction")), importances(trees, features), score


@operator("ml_svm_classifier")
def svm(train: DataFrame, test: DataFrame, features: list[str], target: str, kernel: str = "rbf", c: float = 1.0, gamma: float | None = None, degree: int = 3, coef0: float = 0.0, tolerance: float = 1e-3) -> DataFrame:
    """test rows with prediction by kernel machines (linear, rbf, poly, sigmoid), one for each pair of classes.

    gamma is by default one by the number of features times the variance of all their values. Training
    rows with a null are left out, and with one class all rows are of it.
    """
    if kernel not in ("linear", "rbf", "poly", "sigmoid"):
        raise ValueError("kernel is linear, rbf, poly or sigmoid")
    v = F.array(*[F.col(f).cast("double") for f in features])
    rows = cut(train.select(F.col(target).cast("string").alias("y"), v.alias("v")).where(F.col("y").isNotNull() & F.forall("v", lambda x: x.isNotNull())))
    if gamma is None:
        spread = rows.select(F.explode("v").alias("x")).agg(F.var_pop("x")).first()[0]
        gamma = 1 / (len(features) * spread) if spread else 1.0
    classes = [r["y"] for r in rows.select("y").distinct().limit(2).collect()]
    if len(classes) < 2:
        return test.withColumn("prediction", F.lit(classes[0] if classes else None).cast("string"))
    shape = (kernel, gamma, degree, coef0)
    return kernels.classified(test, v, kernels.machines(rows, c, shape, tolerance), shape)


@operator("ml_robust_line")
def robust_line(df: DataFrame, x: str, y: str, mode: str = "l2", group_size: int = 256, epsilon: float = 1.35) -> DataFrame:
    """One row: slope, intercept, n. l2; huber (joint scale, spark.ml); theil_sen: the median slope of pairs within hash groups of about group_size rows (all pairs where the table has no more), and the median offset."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    if mode == "l2":
        return d.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n"))
    if mode == "huber":
        m = LinearRegression(featuresCol="__features", labelCol="y", loss="huber", epsilon=epsilon).fit(assembled(d, ["x"]))
        return d.agg(F.lit(float(m.coefficients[0])).alias("slope"), F.lit(float(m.intercept)).alias("intercept"), F.count("*").alias("n"))
    groups = max(1, -(-d.count() // group_size))
    g = d.withColumn("g", F.pmod(F.xxhash64("x", "y"), F.lit(groups)))
    other = g.select("g", F.col("x").alias("x2"), F.col("y").alias("y2"))
    slope = g.join(other, "g").where("x < x2").agg(F.median((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("slope"))
    return d.crossJoin(F.broadcast(slope)).groupBy("slope").agg(F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"), F.count("*").alias("n"))


@operator("feat_matcher")
def match_descriptors(queries: DataFrame, train: DataFrame, ratio: float = 0.75, others: bool = False) -> DataFrame:
    """queries(q, d array) and train(t, d array) to (q, t, d1) whose nearest is under ratio times the second nearest; t <> q if others."""
    v = lambda d: F.col("d") if d.schema["d"].dataType.elementType.typeName() == "float" else F.transform("d", lambda x: x.cast("double"))
    two = nearest(queries.select("q", v(queries).alias("v")), train.select("t", v(train).alias("v")), 2, others=others)
    second = F.lead("d").over(Window.partitionBy("q").orderBy("r"))
    return two.withColumn("d2", second).where((F.col("r") == 1) & (F.col("d") < ratio * F.col("d2"))).select("q", "t", F.col("d").alias("d1"))


@operator("cv_kmeans_segmentation")
def kmeans_segmentation(image: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Pixels of all rasters by clusters in colour space; clusters numbered by rising grey level of the centre."""
    d = assembled(image, ["b", "g", "r"])
    m = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__c").fit(d)
    order = sorted(range(len(m.clusterCenters())), key=lambda i: float(np.dot(m.clusterCenters()[i], [0.114, 0.587, 0.299])))
    place = F.create_map(*[x for n, i in enumerate(order) for x in (F.lit(i), F.lit(n))])
    return m.transform(d).withColumn("label", place[F.col("__c")]).drop("__features", "__c")


@operator("cv_montecarlo_cluster")
def montecarlo_cluster(image: DataFrame, k: int = 2, rounds: int = 3, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Share of rounds in which a pixel falls in the brightest cluster, each fitted on another seeded share of the pixels."""
    d = assembled(image, ["b", "g", "r"])
    votes: Column = F.lit(0.0)
    for i in range(rounds):
        part = d.where(F.pmod(F.xxhash64("raster_id", "y", "x", F.lit(seed + i)), F.lit(1000)) < int(share * 1000))
        m = KMeans(k=k, seed=seed + i, featuresCol="__features", predictionCol=f"__c{i}").fit(part)
        top = max(range(len(m.clusterCenters())), key=lambda j: float(np.dot(m.clusterCenters()[j], [0.114, 0.587, 0.299])))
        d = m.transform(d)
        votes = votes + (F.col(f"__c{i}") == top).cast("double")
    return d.withColumn("probability", votes / rounds).select("raster_id", "y", "x", "probability")


@operator("util_monte_carlo_propagation")
def monte_carlo_spread(seeds: DataFrame, simulations: int = 10, steps: int = 5, chance: float = 0.3, seed: int = 42) -> DataFrame:
    """seeds(raster_id, y, x, v): the share of simulations in which a pixel is reached from the set ones. A step offers each reached pixel's four neighbours, which a hash of simulation, step and place accepts."""
    from ..session import cut
    from .pixels import KEY, size_of

    live = seeds.where("v > 0").select(F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"), *KEY)
    size = size_of(seeds)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("o")
    for step in range(steps):
        offer = live.select("sim", *KEY, near).select("sim", "raster_id", (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).distinct()
        offer = offer.where(F.pmod(F.xxhash64("sim", *KEY, F.lit(step), F.lit(seed)), F.lit(10_000)) < int(chance * 10_000))
        inside = offer.join(size, "raster_id").where("y >= 0 and x >= 0 and y < h and x < w").select("sim", *KEY)
        live = live.unionByName(inside).distinct()
        if step % 4 == 3:
            live = cut(live)
    share = live.groupBy(*KEY).agg((F.count("*") / simulations).alias("probability"))
    return seeds.select(*KEY).join(share, KEY, "left").fillna(0.0, ["probability"])

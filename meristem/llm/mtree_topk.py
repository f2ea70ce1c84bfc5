"""Exact top-k by inner product with an M-tree searched best-first.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and a query a 0
there: then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest vectors are those with the largest inner
products, and distances obey the triangle inequality.

The tree is built once and written. Its branches are the vectors nearest to one of a bounded number of
routing vectors; a branch of more than BRANCH vectors lies in several pages, each with its covering
radius. In a page, leaves of about LEAF entries have a routing vector, its distance to the branch's,
a covering radius, and entries in order of their distance to the routing vector.

Queries visit pages in order of the least distance that these can hold: first the best one, which gives
a bound for the k-th hit, then four more, then all that the bound has not ruled out. Within a page
leaves are ruled out by their stored distance to the branch before any distance to them is computed,
then by their covering radius, and entries by their stored distance. Scores are integer inner products;
bounds carry a slack for rounding, so ties are all compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut

BRANCH, LEAF, QUERIES = 8192, 64, 16384
MOST_BRANCHES = 4096
ROUNDS = (1, 4, None)  # pages that a query visits at most in each
LARGEST = float(1 << 62)  # squared norm: inner products of such vectors fit a long


def augmented(vectors: np.ndarray, largest: float) -> np.ndarray:
    v = vectors.astype(float)
    return np.concatenate([v, np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", v, v), 0))[:, None]], axis=1)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T, 0))


def leaves_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the entries of a page: leaf, distance to its routing vector, and the place of that vector."""
    n = len(points)
    centres = np.unique(np.linspace(0, n - 1, max(1, -(-n // LEAF))).astype(int))
    near = distances(points, points[centres]).argmin(axis=1)
    near[centres] = np.arange(len(centres))
    return near, np.sqrt(((points - points[centres][near]) ** 2).sum(1)), centres[near]


class Page:
    """A page of the tree; entries by leaf and distance to its routing vector, which is each leaf's first entry."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: np.ndarray, to_leaf: np.ndarray, to_branch: np.ndarray, branch: np.ndarray, largest: float):
        order = np.lexsort((to_leaf, leaf))
        self.ids, self.vectors, self.to_leaf, self.branch, self.largest = ids[order], vectors[order], to_leaf[order], branch, largest
        leaf = leaf[order]
        self.starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        self.ends = np.append(self.starts[1:], len(leaf))
        self.radii, self.leaf_to_branch = self.to_leaf[self.ends - 1], to_branch[order][self.starts]
        self.routing = augmented(self.vectors[self.starts], largest)
        self.computed = 0

    def search(self, query: np.ndarray, k: int, skip: int | None = None, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k largest (inner product, then smaller id) of the entries with ids other than skip; those under least may be left out."""
        slack = 1e-6 * (1 + np.sqrt(self.largest))
        own = float(query.astype(float) @ query.astype(float))
        limit = np.inf if least is None else np.sqrt(max(0.0, own + self.largest - 2.0 * float(least)))
        q = np.append(query.astype(float), 0.0)
        to_branch = np.sqrt(((q - self.branch) ** 2).sum())
        live = np.flatnonzero(np.abs(to_branch - self.leaf_to_branch) - self.radii <= limit + slack)
        away = np.sqrt(((self.routing[live] - q) ** 2).sum(1))
        self.computed += 1 + len(live)
        bounds = np.maximum(away - self.radii[live], 0)
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in np.argsort(bounds, kind="stable"):
            if bounds[i] > limit + slack:
                break
            s, e = self.starts[live[i]], self.ends[live[i]]
            # |d(q, routing) - d(x, routing)| is the least distance that x can have
            a = s + np.searchsorted(self.to_leaf[s:e], away[i] - limit - slack, side="left")
            b = s + np.searchsorted(self.to_leaf[s:e], away[i] + limit + slack, side="right")
            self.computed += b - a
            new = self.vectors[a:b] @ query
            keep = self.ids[a:b] != skip if skip is not None else np.ones(b - a, bool)
            if len(scores) == k:
                keep &= new >= scores[-1]
            if not keep.any():
                continue
            scores, found = np.concatenate([scores, new[keep]]), np.concatenate([found, self.ids[a:b][keep]])
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
            if len(scores) == k:
                limit = min(limit, np.sqrt(max(0.0, own + self.largest - 2.0 * float(scores[-1]))))
        return scores, found


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, *keep: str) -> DataFrame:
    """(vec_id, v array<long>) with floor(scale * x), and the columns keep.

    Rows with a null id, no vector, or a null or non-finite component are left out, and those whose
    squared norm is over 2**62 after scaling, as inner products with them may not fit a long.
    """
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-4e9)), F.lit(4e9))))
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite, scaled).alias("v"), *keep)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(norm <= LARGEST)


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dim)


class Tree:
    """Branches by vector length: routing points, the largest squared norm, and the pages with their covering radii. Its size follows the number of pages."""

    def __init__(self, rows: DataFrame, stats: list):
        chance = rows.sparkSession.createDataFrame([(r["dim"], min(1.0, min(MOST_BRANCHES, -(-r["n"] // BRANCH)) / r["n"])) for r in stats], "dim int, chance double")
        drawn = rows.join(F.broadcast(chance), "dim").where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < F.col("chance") * (1 << 30))
        points: dict[int, list] = {r["dim"]: [] for r in stats}
        for r in drawn.dropDuplicates(["dim", "vec_id"]).select("dim", "v").limit(4 * MOST_BRANCHES).collect():  # about MOST_BRANCHES rows for each vector length at most
            points[r["dim"]].append(r["v"])
        self.largest = {r["dim"]: float(r["largest"]) for r in stats}
        self.branches = {d: augmented(np.unique(np.array(v or [[0] * d], np.int64), axis=0), self.largest[d]) for d, v in points.items()}
        self.pages: dict[int, np.ndarray] = {}

    def order(self, dim: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pages (branch, page) of one length and their least distances from a query, nearest first."""
        pages = self.pages[dim]
        away = np.sqrt(((self.branches[dim] - np.append(query.astype(float), 0.0)) ** 2).sum(1))[pages[:, 0].astype(int)]
        bounds = np.maximum(away - pages[:, 2], 0)
        best = np.lexsort((away, bounds))
        return pages[best, :2].astype(np.int64), bounds[best]


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    """Each vector's nearest branch and its distance."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                branches = shared.value.branches[dim]
                for k in range(0, own.num_rows, 1024):
                    part = own.slice(k, 1024)
                    x = augmented(_vectors(part.column(2), dim), shared.value.largest[dim])
                    near = distances(x, branches).argmin(axis=1)
                    away = np.sqrt(((x - branches[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=[*part.schema.names, "branch", "to_branch"])

    return rows.mapInArrow(run, "dim int, vec_id long, v array<long>, asked boolean, branch int, to_branch double")


def _build(rows: DataFrame, tree: Tree) -> DataFrame:
    """The tree's entries (dim, branch, page, leaf, to_leaf, to_branch, vec_id, v), written; the pages' radii go into tree."""
    near = cut(_assigned(rows.select("dim", "vec_id", "v", "asked"), tree))
    sizes = near.groupBy("dim", "branch").agg(F.ceil(F.count("*") / BRANCH).alias("pages"))
    paged = near.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(sizes), ["dim", "branch"]).withColumn("page", F.expr("cast(pmod(xxhash64(_row), pages) as int)"))
    largest = tree.largest
    schema = "dim int, branch int, page int, leaf int, to_leaf double, to_branch double, vec_id long, v array<long>"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        table = table.sort_by("vec_id")
        points = augmented(_vectors(table.column("v"), dim), largest[dim])
        leaf, to_leaf, at = leaves_of(points)
        to_branch = table.column("to_branch").to_numpy()[at]  # of the leaf's routing vector
        return pa.table([table.column("dim"), table.column("branch"), table.column("page"), pa.array(leaf.astype(np.int32)), pa.array(to_leaf), pa.array(to_branch), table.column("vec_id"), table.column("v")], names=["dim", "branch", "page", "leaf", "to_leaf", "to_branch", "vec_id", "v"])

    entries = cut(paged.groupBy("dim", "branch", "page").applyInArrow(run, schema))
    for r in paged.groupBy("dim", "branch", "page").agg(F.max("to_branch").alias("radius")).orderBy("dim", "branch", "page").collect():  # a row for each page
        tree.pages.setdefault(r["dim"], []).append((r["branch"], r["page"], r["radius"]))
    tree.pages = {d: np.array(p, float) for d, p in tree.pages.items()}
    return entries


def _wanted(asked: DataFrame, tree: Tree, done: int, most: int | None) -> DataFrame:
    """Rows (dim, branch, page, query_id, q, least) of asked(dim, query_id, q, least) for the next pages that each query's bound leaves open."""
    shared = asked.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            take, branch, page = [], [], []
            for i, (dim, q, least) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
                q = q.values.to_numpy()
                pages, bounds = tree.order(dim, q)
                limit = np.inf if least is None else np.sqrt(max(0.0, float(q.astype(float) @ q.astype(float)) + tree.largest[dim] - 2.0 * least))
                upto = np.searchsorted(bounds, limit + 1e-6 * (1 + np.sqrt(tree.largest[dim])), side="right")
                some = pages[done : min(upto, done + most) if most else upto]
                take += [i] * len(some)
                branch.append(some[:, 0]), page.append(some[:, 1])
            if take:
                part = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(branch).astype(np.int32)), pa.array(np.concatenate(page).astype(np.int32)), *part.columns[1:]], names=["dim", "branch", "page", "query_id", "q", "least"])

    return asked.select("dim", "query_id", "q", "least").mapInArrow(run, "dim int, branch int, page int, query_id long, q array<long>, least long")


def exact_topk(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, v array<long>): each query row's k largest inner products with all other rows.

    Ties go to the smaller vec_id; a query with fewer than k other rows gets all. Only vectors of one
    and the same length are comparable: those of another length than the query's are left out, as are
    empty ones. Rows that repeat an id are each candidates, except for a query with that id, and a
    query given twice gives its rows once, for the smaller of its vectors. An empty table gives no rows.
    Other columns are not read. Squared norms up to 2**62 are handled, as integer_vectors leaves them.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows = cut(vectors.select(F.size("v").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(queries, F.lit(False)).alias("asked")).where("dim > 0"))
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("asked"), F.max(norm).alias("largest")).collect()  # a row for each vector length
    hits = None
    if stats:
        tree = Tree(rows, stats)
        entries = _build(rows, tree)
        asked = cut(rows.where("asked").groupBy("dim", F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")))
        blocks = max(1, -(-max(r["asked"] for r in stats) // QUERIES))
        branches, largest = spark.sparkContext.broadcast(tree.branches), tree.largest
        done = 0
        for most in ROUNDS:
            bound = asked.withColumn("least", F.lit(None).cast("long"))
            if hits is not None:
                kth = hits.groupBy("query_id", "dim").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "dim", "least")
                bound = asked.join(kth, ["query_id", "dim"], "left")
            wanted = cut(_wanted(bound, tree, done, most).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")))
            if most is None and wanted.isEmpty():
                break
            new = _searched(entries, wanted, branches, largest, k)
            ordered = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id")
            hits = cut((new if hits is None else hits.unionByName(new)).withColumn("_place", F.row_number().over(ordered)).where(F.col("_place") <= k).drop("_place"))
            done += most or 0
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _searched(entries: DataFrame, wanted: DataFrame, branches, largest: dict[int, float], k: int) -> DataFrame:
    """Hits (query_id, dim, vec_id, score) of the wanted pages. A page goes once to each block of queries that want it."""
    keys = ["dim", "branch", "page", "block"]
    pages = entries.join(wanted.select(*keys).distinct(), keys[:3])

    def run(key: tuple, page: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        dim, branch = key[0].as_py(), key[1].as_py()
        if page.num_rows and asked.num_rows:
            columns = [page.column(c).to_numpy() for c in ("leaf", "to_leaf", "to_branch")]
            tree = Page(page.column("vec_id").to_numpy(), _vectors(page.column("v"), dim), *columns, branches.value[dim][branch], largest[dim])
            for query_id, q, least in zip(asked.column("query_id").to_pylist(), _vectors(asked.column("q"), dim), asked.column("least").to_pylist(), strict=True):
                scores, found = tree.search(q, k, skip=query_id, least=least)
                out[0].append(np.full(len(found), query_id)), out[1].append(found), out[2].append(scores)
        query_id, found, scores = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"query_id": query_id, "dim": pa.array(np.full(len(found), dim, np.int32)), "vec_id": found, "score": scores})

    right = wanted.withColumnsRenamed({c: f"_{c}" for c in keys})
    return pages.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInArrow(run, "query_id long, dim int, vec_id long, score long")

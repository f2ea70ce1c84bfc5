"""Table operators: selection, sorting, grouping, joining, cleaning, describing and plot data.

Row order counts in several of them. Where it does, they take `order`, columns that fix it; ties are
then broken by all columns, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.expressions import compile_expression
from ..registry import operator
from ..session import cut
from .concordance import kendall
from .pieces import filled, numbered


def resolve(df: DataFrame, name: str) -> str:
    """The column called name, else the one that is equal after trimming and lower-casing."""
    if name in df.columns:
        return name
    for c in df.columns:
        if c.strip().lower() == name.strip().lower():
            return c
    raise ValueError(f"no column {name!r} among {df.columns}")


def column(df: DataFrame, name: str) -> Column:
    return F.col("`" + resolve(df, name).replace("`", "``") + "`")


def names_of(df: DataFrame, names: str | list[str]) -> list[str]:
    return [resolve(df, n) for n in (names.split(",") if isinstance(names, str) else names) if n.strip()]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


@operator("df_from_list")
def from_list(df: DataFrame, items: str) -> DataFrame:
    """A row per item of an array column; structs become columns, scalars a column `value`."""
    out = df.select(F.posexplode(column(df, items)).alias("__idx", "value"))
    return out.select("__idx", "value.*") if "struct" in dict(out.dtypes)["value"][:6] else out


@operator("df_to_dataframe")
def to_dataframe(df: DataFrame, entries: str, keys: list[str] | None = None) -> DataFrame:
    """A map column as Key and Value rows, or one column for each of the given keys."""
    m = column(df, entries)
    return df.select(F.explode(m).alias("Key", "Value")) if keys is None else df.select(*[F.try_element_at(m, F.lit(k)).alias(k) for k in keys])


@operator("df_column_list")
def column_list(df: DataFrame, name: str) -> DataFrame:
    """One column; a distributed list."""
    return df.select(column(df, name))


@operator("df_select")
def select(df: DataFrame, keep: str | list[str]) -> DataFrame:
    return df.select(*[column(df, n) for n in names_of(df, keep)])


@operator("df_sort")
def sort(df: DataFrame, by: str | list[str], ascending: bool = True) -> DataFrame:
    """Missing values last either way."""
    return df.orderBy(*[column(df, n).asc_nulls_last() if ascending else column(df, n).desc_nulls_last() for n in names_of(df, by)])


@operator("df_sample")
def sample(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """n rows, the same for a seed: those with the smallest hashes of key (which should be unique)."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[column(df, k).cast("string") for k in key]))
    return df.withColumn("__mark", mark).orderBy("__mark").limit(n).drop("__mark")


TOP = 100_000  # rows of a top-n, which tasks hold


@operator("df_slice")
def slice_rows(df: DataFrame, start: int, stop: int | None, order: list[str]) -> DataFrame:
    """Rows from start up to stop in an order; negative places count from the end. Rows within TOP of either end are found by top-n from that end; others by their places in range pieces."""
    columns = [column(df, c) for c in [*order, *[c for c in df.columns if c not in order]]]
    keys, back = [c.asc_nulls_last() for c in columns], [c.desc_nulls_first() for c in columns]
    if -TOP <= start < 0 and (stop is None or stop < 0):
        skip = -(stop or 0)
        return df.orderBy(*back).offset(skip).limit(max(0, -start - skip)).orderBy(*keys)
    if start >= 0 and stop is not None and 0 <= stop <= TOP:
        return df.orderBy(*keys).offset(start).limit(max(0, stop - start))
    n = df.count()
    start, stop = (max(0, p + n) if p < 0 else min(p, n) for p in (start, n if stop is None else stop))
    if start >= stop:
        return df.limit(0)
    if stop <= TOP:
        return df.orderBy(*keys).offset(start).limit(stop - start)
    if n - start <= TOP:
        return df.orderBy(*back).offset(n - stop).limit(stop - start).orderBy(*keys)
    place = F.col("__place")
    return numbered(df, keys, "__place").where((place >= start) & (place < stop)).drop("__place").orderBy(*keys)


AGGREGATES = {
    "count": F.count,
    "nunique": lambda c: F.count_distinct(c.cast("string")),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_samp,
}


@operator("df_groupby")
def group_by(df: DataFrame, by: str | list[str], cols: str | list[str], agg: str | list[str]) -> DataFrame:
    """One row per group, a column per aggregate; with several aggregates they are named column_aggregate. Missing keys form a group."""
    keys, kinds = names_of(df, by), [agg] if isinstance(agg, str) else agg
    out = [AGGREGATES[k](column(df, c)).alias(c if len(kinds) == 1 else f"{c}_{k}") for c in names_of(df, cols) for k in kinds]
    return df.groupBy(*[column(df, k) for k in keys]).agg(*out)


@operator("df_merge")
def merge(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on shared columns; other columns of both sides get suffixes. how: inner, left, right, outer, cross, leftsemi or leftanti."""
    keys = names_of(left, on) if how != "cross" else []
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    if how not in ("leftsemi", "leftanti"):
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.crossJoin(right) if how == "cross" else left.join(right, keys, how)


@operator("df_fillna")
def fill_missing(df: DataFrame, strategy: str = "constant", value: float | str = 0, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """constant, mean, median, mode (smallest of the most frequent), ffill, bfill (over order) or drop."""
    names = names_of(df, columns) if columns else (numeric_columns(df) if strategy in ("mean", "median") else df.columns)
    if strategy == "drop":
        return df.na.drop(subset=names)
    if strategy == "constant":
        return df.na.fill(value, subset=names)
    if strategy in ("ffill", "bfill"):
        return filled(df, names, [column(df, c) for c in order], strategy == "ffill")
    form = {"mean": F.avg, "median": F.median, "mode": lambda c: F.mode(c, deterministic=True)}[strategy]
    whole = df.agg(*[form(column(df, n)).alias(f"__{n}") for n in names])  # one row
    return df.crossJoin(F.broadcast(whole)).withColumns({n: F.coalesce(column(df, n), F.col(f"`__{n}`")) for n in names}).drop(*[f"__{n}" for n in names])


@operator("df_new_col")
def new_column(df: DataFrame, name: str, expr: str) -> DataFrame:
    return df.withColumn(name, compile_expression(expr, {c: F.col(f"`{c}`") for c in df.columns}))


@operator("df_rename")
def rename(df: DataFrame, mapping: str | dict[str, str]) -> DataFrame:
    """`old:new, ...`; names that aren't there are passed over."""
    if isinstance(mapping, str):
        mapping = dict(x.split(":", 1) for x in mapping.split(",") if ":" in x)
    found = {c.strip().lower(): c for c in df.columns}
    return df.withColumnsRenamed({found[k.strip().lower()]: v.strip() for k, v in mapping.items() if k.strip().lower() in found})


@operator("df_collect")
def collect_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


@operator("df_editor")
def edit_cells(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """edits(key, col, val): the cell of column col in the row with that key becomes val, cast to the column's type. The last edit in val order wins for a repeated cell."""
    wide = edits.groupBy(F.col(key).alias("__key")).pivot("col", [c for c in df.columns if c != key]).agg(F.max("val"))
    wide = wide.withColumnsRenamed({c: f"__{c}" for c in df.columns if c != key})
    out = df.join(wide, F.col(key) == F.col("__key"), "left")
    return out.select(*[F.coalesce(F.col(f"`__{c}`").cast(df.schema[c].dataType), F.col(f"`{c}`")).alias(c) if c != key else F.col(c) for c in df.columns])


@operator("df_plot")
def plot_data(df: DataFrame, kind: str, x: str | None = None, y: str | None = None, bins: int = 10) -> DataFrame:
    """The rows that a plot would draw: line, scatter, bar and area (x, y), pie (x, share), histogram (bin, count), box (five numbers of y by x)."""
    if kind in ("line", "scatter", "area"):
        return df.select(column(df, x).alias("x"), column(df, y).alias("y")).where("x is not null and y is not null")
    if kind == "bar":
        return df.groupBy(column(df, x).alias("x")).agg(F.avg(column(df, y)).alias("y"))
    if kind == "pie":
        sums = df.groupBy(column(df, x).alias("x")).agg(F.sum(column(df, y)).alias("y"))
        return sums.withColumn("share", F.col("y") / F.sum("y").over(Window.partitionBy(F.lit(0))))
    if kind == "histogram":
        return histogram(df, y, bins)
    if kind == "box":
        v = column(df, y)
        return df.groupBy(column(df, x).alias("x")).agg(*[F.percentile(v, F.lit(p)).alias(n) for p, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))])
    raise ValueError(f"unknown plot {kind}")


@operator("ml_df_filter")
def filter_rows(df: DataFrame, name: str | None = None, op: str = "==", value: object = None, dropna: bool = False, compat: bool = False) -> DataFrame:
    """== != > < >= <= contains null notnull on one column; numbers compare as numbers if the literal is one, else only == and != filter, as text. compat reads missing numbers as 0."""
    df = df.na.drop() if dropna else df
    if name is None:
        return df
    c = column(df, name)
    if op in ("null", "notnull"):
        return df.where(c.isNull() if op == "null" else c.isNotNull())
    if op == "contains":
        return df.where(F.contains(c.cast("string"), F.lit(str(value))))
    try:
        literal, number = F.lit(float(value)), True
    except (TypeError, ValueError):
        literal, number = F.lit(str(value)), False
    if not number and op not in ("==", "!="):
        return df
    if number and isinstance(df.schema[resolve(df, name)].dataType, NumericType):
        v = c.cast("double")
    else:
        v = c.cast("string").try_cast("double") if number else c.cast("string")
    v = F.coalesce(v, F.lit(0.0)) if compat and number else v
    return df.where({"==": v == literal, "!=": v != literal, ">": v > literal, "<": v < literal, ">=": v >= literal, "<=": v <= literal}[op])


@operator("ml_dataframe_join")
def join_tables(tables: list[DataFrame], key: str, how: str = "outer", order: list[str] | None = None, drop_dupes: bool = True) -> DataFrame:
    """Two to four tables on a key compared as text, null equal to null. Of a key's rows in a table the last counts (in order, else by all columns); a column that an earlier table has is dropped, or suffixed _b, _c, _d."""
    if any(key not in t.columns for t in tables):
        return tables[0]
    out = None
    for t, suffix in zip(tables, ("", "_b", "_c", "_d"), strict=False):
        rest = [c for c in t.columns if c != key]
        rank = [F.col(c) for c in (order or []) if c in t.columns] + [F.col(c) for c in rest]
        last = t.groupBy(F.col(key).cast("string").alias("__key")).agg(F.max_by(F.struct(key, *rest), F.struct(*rank)).alias("__row"))
        if out is None:
            out = last.select("__key", *[F.col(f"__row.{c}").alias(c) for c in [key, *rest]])
            continue
        taken = set(out.columns)
        new = [(c, c if c not in taken else c + suffix) for c in rest if c not in taken or not drop_dupes]
        right = last.select(F.col("__key").alias("__other"), F.col(f"__row.{key}").alias("__k"), *[F.col(f"__row.{c}").alias(n) for c, n in new])
        joined = out.join(right, F.col("__key").eqNullSafe(F.col("__other")), how)
        keep = [c for c in out.columns if c not in ("__key", key)]
        out = joined.select(F.coalesce("__key", "__other").alias("__key"), F.coalesce(key, "__k").alias(key), *keep, *[n for _, n in new])
    return out.drop("__key")


@operator("ml_df_stats")
def table_stats(df: DataFrame, mode: str = "describe", name: str | None = None, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """describe (count, mean, std, min, quartiles, max of numeric columns), head, dtypes with null counts, or value_counts of a column."""
    if mode == "head":
        return df.orderBy(*order).limit(10) if order else df.limit(10)
    if mode == "value_counts":
        return df.groupBy(F.coalesce(column(df, name).cast("string"), F.lit("(null)")).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    if mode == "dtypes":
        kinds = dict(df.dtypes)
        nulls = df.agg(*[F.count_if(column(df, c).isNull()).alias(c) for c in df.columns])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])).alias("s")
        return nulls.select(pairs).select("s.*")
    if mode != "describe":
        raise ValueError(f"unknown mode {mode}")
    names = names_of(df, columns) if columns else numeric_columns(df)
    one = df.agg(*[F.struct(*_describe(column(df, n))).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("s")) for n in names])).alias("r")).select("r.column", "r.s.*")


def _describe(c: Column) -> list[Column]:
    v = c.cast("double")
    q = [F.bround(F.percentile(v, F.lit(p)), 4).alias(n) for p, n in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%"))]
    std = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.bround(F.stddev_samp(v), 4))
    return [F.count(v).alias("count"), F.bround(F.avg(v), 4).alias("mean"), std.alias("std"), F.bround(F.min(v), 4).alias("min"), *q, F.bround(F.max(v), 4).alias("max")]


def ranked(df: DataFrame, name: str) -> DataFrame:
    """Adds {name}__rank, the average rank: values are counted, the distinct ones are ranked over range-partitioned pieces, and joined back."""
    counts = df.groupBy(name).agg(F.count("*").alias("__n"))
    pieces = cut(counts.repartitionByRange(name).withColumn("__p", F.spark_partition_id()))  # written, so that both readers see the same pieces
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("__p").agg(F.sum("__n").alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).select("__p", "__o")
    inside = Window.partitionBy("__p").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    ranks = pieces.join(F.broadcast(offsets), "__p").select(F.col(name).alias("__v"), (F.col("__o") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + (F.col("__n") + 1) / 2).alias(f"{name}__rank"))
    return df.join(ranks, F.col(name) == F.col("__v")).drop("__v")


@operator("ml_corr_heatmap")
def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for all pairs of columns over rows complete in all of them: pearson, spearman (of average ranks) or kendall (tau-b), to 4 digits."""
    names = names_of(df, columns)
    rows = df.select(*[column(df, n).cast("double").alias(n) for n in names]).na.drop()
    pairs = [(a, b) for a in names for b in names]
    if method == "kendall":
        return _kendall(rows, names)
    if method == "spearman":
        for n in names:
            rows = ranked(rows, n)
        rows = rows.select(*[F.col(f"{n}__rank").alias(n) for n in names])
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs if a < b])
    cell = lambda a, b: F.lit(1.0) if a == b else F.bround(F.col(f"`{min(a, b)}|{max(a, b)}`"), 4)
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias("r")) for a, b in pairs])).alias("s")).select("s.*")


def _kendall(rows: DataFrame, names: list[str]) -> DataFrame:
    rows = cut(rows)
    found = [(a, b, kendall(rows, a, b)) for a in names for b in names if a < b]
    return rows.sparkSession.createDataFrame(found, "a string, b string, r double").withColumn("r", F.bround("r", 4))


@operator("ml_histogram")
def histogram(df: DataFrame, name: str, bins: int = 10, hue: str | None = None, density: bool = False) -> DataFrame:
    """(bin, [hue], low, high, count or density) over [min, max] with at least 5 equal bins, the last one closed; empty bins are left out."""
    bins = max(5, bins)
    v = df.select(column(df, name).cast("double").alias("v"), *([column(df, hue).alias("hue")] if hue else [])).where("v is not null and not isnan(v)")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0))
    placed = v.crossJoin(F.broadcast(ends)).withColumn("bin", at.cast("int"))
    width = (F.col("hi") - F.col("lo")) / bins
    out = placed.groupBy("bin", *(["hue"] if hue else []), "lo", "hi", "n").agg(F.count("*").alias("count"))
    value = (F.col("count") / (F.col("n") * width)).alias("density") if density else F.col("count")
    return out.select("bin", *(["hue"] if hue else []), (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), value)


def kernel_density(df: DataFrame, name: str, points: int = 120) -> DataFrame:
    """(x, density): a Gaussian kernel estimate with Silverman's width at equally spaced points."""
    v = df.select(column(df, name).cast("double").alias("v")).where("v is not null and not isnan(v)")
    one = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"), (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"))
    one = one.withColumn("h", 0.9 * F.least(F.col("sd"), F.col("iqr") / 1.34) * F.pow("n", F.lit(-0.2)))
    grid = one.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi", "h", "n").withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return v.crossJoin(F.broadcast(grid)).groupBy("x", "h", "n").agg(F.sum(F.exp(-0.5 * z * z)).alias("s")).select("x", (F.col("s") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


@operator("ml_scatter_plot")
def scatter_data(df: DataFrame, x: str, y: str, hue: str | None = None, max_points: int = 2000, order: list[str] | None = None) -> DataFrame:
    """Complete (x, y, hue) rows, every k-th in order so that at most max_points stay, with the least-squares line through all of them."""
    rows = df.select(column(df, x).cast("double").alias("x"), column(df, y).cast("double").alias("y"), *([column(df, hue).alias("hue")] if hue else []), *[F.col(o).alias(f"__{o}") for o in order or []]).where("x is not null and y is not null")
    line = rows.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    placed = numbered(rows, [F.col(f"__{o}") for o in order], "__i") if order else rows.withColumn("__i", F.monotonically_increasing_id())
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / max_points))
    return placed.crossJoin(F.broadcast(line)).where(F.col("__i") % stride == 0).select("x", "y", *(["hue"] if hue else []), "slope", "intercept")


@operator("ml_bar_chart")
def bar_data(df: DataFrame, category: str, value: str, by_value: bool = False) -> DataFrame:
    out = df.groupBy(column(df, category).alias("category")).agg(F.avg(column(df, value)).alias("value"))
    return out.orderBy(F.desc("value"), "category") if by_value else out.orderBy("category")


# Beyond the reference's tables: ordinary relational forms that a table engine is asked for.


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    return {"union": left.unionByName, "intersect": left.intersectAll, "except": left.exceptAll}[kind](right)


def cube(df: DataFrame, by: list[str], value: str, kind: str = "cube") -> DataFrame:
    grouped = df.cube(*by) if kind == "cube" else df.rollup(*by)
    return grouped.agg(F.sum(column(df, value)).alias("sum"), F.count("*").alias("count"), F.grouping_id().alias("level"))


def pivot(df: DataFrame, index: str, columns: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(index).pivot(columns, names).agg(F.sum(column(df, value)))

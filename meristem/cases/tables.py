"""Table and statistics operators over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.collections import contour_props, filter_contours
from ..operators import graphics as G
from ..operators import relational as R
from ..operators import statistics as A
from ..operators.user_code import classify_regions, run_python
from ..plans.graph import run
from .base import case, events, r6, table


@case("groupby_mean", "select l_returnflag, round(avg(l_extendedprice), 4) as l_extendedprice from lineitem where l_quantity > 10 group by 1")
def _flagship(spark, sf_dir):
    """A graph of three nodes: filter, group, sort."""
    graph = {
        "nodes": [
            {"id": "t", "type": "table", "data": {"params": {"name": "lineitem"}}},
            {"id": "f", "type": "ml_df_filter", "data": {"params": {"name": "l_quantity", "op": ">", "value": 10}}},
            {"id": "r", "type": "reroute"},
            {"id": "g", "type": "df_groupby", "data": {"params": {"by": "l_returnflag", "cols": "l_extendedprice", "agg": "mean"}}},
            {"id": "s", "type": "df_sort", "data": {"params": {"by": "l_returnflag"}}},
        ],
        "edges": [{"source": a, "target": b, "sourceHandle": "any__main", "targetHandle": "any__df"} for a, b in (("t", "f"), ("f", "r"), ("r", "g"), ("g", "s"))],
    }
    return r6(run(spark, graph, "s", {"lineitem": table(spark, sf_dir, "lineitem")}), 4)


@case("reroute", "select count(*) as n from lineitem where l_quantity > 10")
def _reroute(spark, sf_dir):
    return G.reroute(table(spark, sf_dir, "lineitem")).where("l_quantity > 10").agg(F.count("*").alias("n"))


@case("data_inspector", "select * from region")
def _inspector(spark, sf_dir):
    return G.data_inspector(table(spark, sf_dir, "region"))


@case("df_from_list", "select doc_id, i - 1 as __idx, w[i] as value from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, string_split(text, ' ') as w from documents))")
def _from_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return d.select("doc_id", F.posexplode("w").alias("__idx", "value"))


@case("df_to_dataframe", "select event_id, 'k' as Key, json_extract_string(props, '$.k') as Value from events")
def _to_dataframe(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return d.select("event_id", F.explode("m").alias("Key", "Value"))


@case("df_column_list", "select p_brand from part")
def _column_list(spark, sf_dir):
    return R.column_list(table(spark, sf_dir, "part"), " P_Brand ")


@case("df_select", "select l_orderkey, l_tax from lineitem")
def _select(spark, sf_dir):
    return R.select(table(spark, sf_dir, "lineitem"), "l_orderkey, L_TAX")


@case("df_sort", "select * from orders order by o_totalprice desc")
def _sort(spark, sf_dir):
    return R.sort(table(spark, sf_dir, "orders"), "o_totalprice", ascending=False)


@case("df_sample", "select * from customer order by md5('7|' || c_custkey) limit 100")
def _sample(spark, sf_dir):
    return R.sample(table(spark, sf_dir, "customer"), 100, 7, ["c_custkey"])


@case("df_slice", "select * from (select * from orders order by o_orderkey desc limit 50) order by o_orderkey limit 30")
def _slice(spark, sf_dir):
    return R.slice_rows(table(spark, sf_dir, "orders"), -50, -20, ["o_orderkey"])


AGGS = {"count": "count(l_tax)", "nunique": "count(distinct l_tax)", "sum": "round(coalesce(sum(l_tax), 0), 4)", "min": "min(l_tax)", "max": "max(l_tax)", "mean": "round(avg(l_tax), 4)", "median": "round(median(l_tax), 4)", "std": "round(stddev_samp(l_tax), 4)"}


@case("df_groupby", "select l_shipmode_ as l_linestatus, " + ", ".join(f"{s} as l_tax_{n}" for n, s in AGGS.items()) + " from (select l_linestatus as l_shipmode_, l_tax from lineitem) group by 1")
def _groupby(spark, sf_dir):
    return r6(R.group_by(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_tax", list(AGGS)), 4)


for _how, _sql in {
    "inner": "select o.*, c_name from orders o join customer c on o_custkey = c_custkey",
    "left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey",
    "outer": "select coalesce(c_custkey, o_custkey) as k, o_orderkey from customer full join orders on c_custkey = o_custkey",
    "leftsemi": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)",
    "leftanti": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
}.items():

    def _merge(spark, sf_dir, how=_how):
        o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
        if how == "inner":
            return R.merge(o, c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", how).select(*o.columns, "c_name")
        k = c.select(F.col("c_custkey").alias("k"))
        right = o.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
        if how == "leftsemi":
            return R.merge(k, right.where("o_totalprice > 200000"), "k", how).select(F.col("k").alias("c_custkey"))
        out = R.merge(k, right, "k", how)
        return out.select(F.col("k").alias("c_custkey")) if how == "leftanti" else out.select(F.col("k").alias("k" if how == "outer" else "c_custkey"), "o_orderkey")

    case("df_merge" if _how == "inner" else f"df_merge_{_how}", _sql)(_merge)

_NULLS = "(select l_orderkey, l_linenumber, case when l_linenumber = 3 then null else l_quantity end as q from lineitem)"
for _strategy, _sql in {"constant": "coalesce(q, 0)", "mean": "round(coalesce(q, avg(q) over ()), 4)", "median": "round(coalesce(q, (select median(q) from {t})), 4)", "drop": None}.items():

    def _fill(spark, sf_dir, strategy=_strategy):
        d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
        return r6(R.fill_missing(d, strategy, 0, ["q"]), 4)

    _q = f"select l_orderkey, l_linenumber, {(_sql or 'q').format(t=_NULLS)} as q from {_NULLS} t" + (" where q is not null" if _sql is None else "")
    case("df_fillna" if _strategy == "constant" else f"df_fillna_{_strategy}", _q)(_fill)


@case("df_new_col", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / l_quantity, 6) as unit from lineitem")
def _new_col(spark, sf_dir):
    d = R.new_column(table(spark, sf_dir, "lineitem"), "unit", "df['l_extendedprice'] * (1 - df['l_discount']) / df['l_quantity']")
    return r6(d.select("l_orderkey", "l_linenumber", "unit"))


@case("df_rename", "select r_regionkey as id, r_name as name from region")
def _rename(spark, sf_dir):
    return R.rename(table(spark, sf_dir, "region"), "R_RegionKey:id, r_name:name, none:x")


@case("df_collect", "select r_regionkey as k, r_name, null as n_name from region union all select n_nationkey, null, n_name from nation")
def _collect(spark, sf_dir):
    return R.collect_tables(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "k"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"))


@case("df_editor", "select n_nationkey, case when n_nationkey = 3 then 'EDITED' else n_name end as n_name, case when n_nationkey = 5 then 9 else n_regionkey end as n_regionkey from nation")
def _editor(spark, sf_dir):
    edits = spark.createDataFrame([(3, "n_name", "EDITED"), (5, "n_regionkey", "9")], "n_nationkey int, col string, val string")
    return R.edit_cells(table(spark, sf_dir, "nation"), edits, "n_nationkey")


@case("df_plot", "select l_returnflag as x, quantile_cont(l_quantity, 0.0) as low, quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.5) as median, quantile_cont(l_quantity, 0.75) as q3, quantile_cont(l_quantity, 1.0) as high from lineitem group by 1")
def _plot(spark, sf_dir):
    return R.plot_data(table(spark, sf_dir, "lineitem"), "box", "l_returnflag", "l_quantity")


@case("ml_df_filter", "select * from lineitem where l_quantity >= 30")
def _filter(spark, sf_dir):
    return R.filter_rows(table(spark, sf_dir, "lineitem"), "l_quantity", ">=", "30")


@case("ml_dataframe_join", "with s as (select o_custkey as k, max(o_orderkey) as o from orders group by 1) select coalesce(c_custkey, k) as k, c_name, o as o_orderkey from customer full join s on c_custkey = k")
def _ml_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return R.join_tables([c, o], "k")


def _describe_sql(c: str) -> str:
    q = ", ".join(f'round_even(quantile_cont({c}, {p}), 4) as "{n}"' for p, n in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")))
    return f"select '{c}' as column, count({c}) as count, round_even(avg({c}), 4) as mean, round_even(stddev_samp({c}), 4) as std, min({c}) as min, {q}, max({c}) as max from lineitem"


@case("ml_df_stats", " union all ".join(_describe_sql(c) for c in ("l_quantity", "l_discount", "l_tax")))
def _describe(spark, sf_dir):
    return R.table_stats(table(spark, sf_dir, "lineitem"), columns=["l_quantity", "l_discount", "l_tax"])


@case("ml_df_stats_value_counts", "select coalesce(event_type, '(null)') as value, count(*) as count from events group by 1")
def _value_counts(spark, sf_dir):
    return R.table_stats(table(spark, sf_dir, "events"), "value_counts", "event_type")


@case("ml_df_stats_dtypes", "select 'r_regionkey' as column, 'int' as dtype, count(*) filter (r_regionkey is null) as nulls from region union all select 'r_name', 'string', count(*) filter (r_name is null) from region")
def _dtypes(spark, sf_dir):
    return R.table_stats(table(spark, sf_dir, "region"), "dtypes")


def _corr_sql(tab: str, names: list[str]) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, " + ("1.0::double" if a == b else f"round_even(corr({min(a, b)}, {max(a, b)}), 4)") + f" as r from {tab}" + (" limit 1" if a == b and False else "") for a in names for b in names if a != b) + "".join(f" union all select '{a}', '{a}', 1.0" for a in names)


_C = ["l_quantity", "l_extendedprice", "l_tax"]


@case("ml_corr_heatmap", _corr_sql("lineitem", _C))
def _pearson(spark, sf_dir):
    return R.correlation(table(spark, sf_dir, "lineitem"), _C)


_RANKS = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in _C) + " from lineitem) t"


@case("ml_corr_heatmap_spearman", _corr_sql(_RANKS, _C))
def _spearman(spark, sf_dir):
    return R.correlation(table(spark, sf_dir, "lineitem"), _C, "spearman")


@case("ml_corr_heatmap_kendall", "with c as (select l_discount as x, l_tax as y, count(*)::double as n from lineitem group by 1, 2), p as (select sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) as s, sum(a.n * b.n) filter (a.x <> b.x) as nx, sum(a.n * b.n) filter (a.y <> b.y) as ny from c a, c b) select 'l_discount' as a, 'l_tax' as b, round_even(s / sqrt(nx * ny), 4) as r from p")
def _kendall(spark, sf_dir):
    return R.correlation(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], "kendall")


@case("ml_histogram", "with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) select least(29, floor((l_extendedprice - lo) / (hi - lo) * 30))::int as bin, l_returnflag as hue, round(lo + least(29, floor((l_extendedprice - lo) / (hi - lo) * 30)) * (hi - lo) / 30, 4) as low, round(lo + (least(29, floor((l_extendedprice - lo) / (hi - lo) * 30)) + 1) * (hi - lo) / 30, 4) as high, count(*) as count from lineitem, e group by all")
def _histogram(spark, sf_dir):
    return r6(R.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30, "l_returnflag"), 4)


@case("ml_histogram_kde", "with s as (select min(c_acctbal) as lo, max(c_acctbal) as hi, count(*) as n, 0.9 * least(stddev_samp(c_acctbal), (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 1.34) * power(count(*), -0.2) as h from customer), g as (select lo + (hi - lo) * i / 119 as x, n, h from s, (select unnest(range(120)) as i)) select round(x, 6) as x, round(sum(exp(-0.5 * power((x - c_acctbal) / h, 2))) / (any_value(n) * any_value(h) * 2.5066282746310002), 6) as density from g, customer group by x")
def _kde(spark, sf_dir):
    return r6(R.kernel_density(table(spark, sf_dir, "customer"), "c_acctbal"))


@case("ml_scatter_plot", "select s_acctbal as x, s_nationkey::double as y, round(regr_slope(s_nationkey, s_acctbal) over (), 6) as slope, round(regr_intercept(s_nationkey, s_acctbal) over (), 6) as intercept from supplier")
def _scatter(spark, sf_dir):
    return r6(R.scatter_data(table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey", max_points=10**9, order=["s_suppkey"]))


@case("ml_bar_chart", "select c_mktsegment as category, round(avg(c_acctbal), 4) as value from customer group by 1")
def _bar(spark, sf_dir):
    return r6(R.bar_data(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", True), 4)


@case("df_setop_intersect", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def _intersect(spark, sf_dir):
    return R.set_operation(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "intersect")


@case("df_cube", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum, count(*) as count, grouping_id(l_returnflag, l_linestatus) as level from lineitem group by cube(l_returnflag, l_linestatus)")
def _cube(spark, sf_dir):
    return r6(R.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), 2)


@case("df_pivot", "select l_linestatus, round(sum(l_quantity) filter (l_returnflag = 'A'), 2) as A, round(sum(l_quantity) filter (l_returnflag = 'R'), 2) as R from lineitem group by 1")
def _pivot(spark, sf_dir):
    return r6(R.pivot(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", ["A", "R"]), 2)


# Statistics

V = "value"
U = ["user_id"]


@case("sci_stats", "select user_id, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max from events group by 1")
def _stats(spark, sf_dir):
    return r6(A.stats(events(spark, sf_dir), V, U))


@case("feat_list_aggregator", "select user_id, count(*) as count, round_even(avg(value / 2), 4) as avg, round_even(stddev_pop(value / 2), 4) as std, round_even(min(value / 2), 4) as min, round_even(max(value / 2), 4) as max, round_even(sum(value / 2), 4) as total from events group by 1")
def _aggregator(spark, sf_dir):
    return A.list_aggregator(events(spark, sf_dir), V, U, 2.0)


@case("sci_robust_location", "with l as (select *, event_id = max(event_id) over (partition by user_id) as last from events), s as (select user_id, avg(value) as mean, median(value) as median, avg(value) filter (not last) as m, median(value) filter (not last) as d from l group by 1) select user_id, round_even(mean, 4) as mean, round_even(median, 4) as median, round_even(mean - m, 4) as mean_influence, round_even(median - d, 4) as median_influence from s")
def _location(spark, sf_dir):
    return A.robust_location(events(spark, sf_dir), V, "event_id", U)


_MAD = "with m as (select user_id, median(value) as median from events group by 1), d as (select user_id, median, median(abs(value - median)) as mad from events join m using (user_id) group by 1, 2)"


@case("sci_mad_scale", _MAD + " select user_id, round(median, 6) as median, round(mad, 6) as mad, round(1.4826 * mad, 6) as sigma_hat, count(*) filter (abs(0.6745 * (value - median) / nullif(mad, 0)) > 3.5) as outliers, count(*) as count from events join d using (user_id) group by 1, median, mad")
def _mad(spark, sf_dir):
    return r6(A.mad_scale(events(spark, sf_dir), V, U))


@case("sci_robust_stats", _MAD + " select user_id, round(median, 6) as median, round(mad, 6) as mad, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*) as count from events join d using (user_id) group by 1, median, mad")
def _robust(spark, sf_dir):
    return r6(A.robust_stats(events(spark, sf_dir), V, U))


_ROUNDS = "".join(
    f", m{i} as (select user_id, s, sum(case when abs(value - m) <= 1.345 * s then value else value * 1.345 * s / abs(value - m) end) / sum(case when abs(value - m) <= 1.345 * s then 1 else 1.345 * s / abs(value - m) end) as m from events join m{i - 1} using (user_id) group by 1, 2)"
    for i in range(1, 11)
)


@case("sci_m_estimator", _MAD + ", m0 as (select user_id, greatest(1.4826 * mad, 1e-12) as s, median as m from d)" + _ROUNDS + " select user_id, round(any_value(m), 4) as estimate, round(avg(value), 4) as ls_estimate from events join m10 using (user_id) group by 1")
def _m_estimator(spark, sf_dir):
    return r6(A.m_estimator(events(spark, sf_dir), V, U), 4)


@case("list_natural_break", "with c as (select user_id, value as x, count(*) as n from events group by 1, 2), w as (select user_id, x, sum(n) over a as n0, sum(x * n) over a as s0, sum(n) over b as nn, sum(x * n) over b as ss, lead(x) over (partition by user_id order by x) as nx from c window a as (partition by user_id order by x rows unbounded preceding), b as (partition by user_id)), t as (select *, round_even(n0 * (nn - n0) * power(s0 / n0 - (ss - s0) / (nn - n0), 2), 6) as bv from w where nx is not null) select user_id, round((x + nx) / 2, 6) as threshold, (nn - n0)::bigint as count_above, n0::bigint as count_below from t qualify row_number() over (partition by user_id order by bv desc, x) = 1")
def _break(spark, sf_dir):
    return r6(A.natural_break(events(spark, sf_dir), V, U))


@case("sci_kmeans_list")
def _kmeans_list(spark, sf_dir):
    return A.kmeans_list(events(spark, sf_dir), V).groupBy("cluster_id").agg(F.count("*").alias("n"))


@case("sci_matrix_dist", "with e as (select min(value) as lo, max(value) as hi from events), c as (select least(15, floor((value - lo) / (hi - lo) * 16))::int as bin, count(*)::double as n from events, e group by 1) select bin, sum(n) over (order by bin) as count from c")
def _matrix(spark, sf_dir):
    return A.matrix_distribution(events(spark, sf_dir), V, 16, cumulative=True)


@case("geo_grain_histogram", "with d as (select p_brand, sqrt(4 * p_size / pi()) as v from part) select p_brand, count(*) as count, round(quantile_cont(v, 0.1), 6) as d10, round(quantile_cont(v, 0.5), 6) as d50, round(quantile_cont(v, 0.9), 6) as d90, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from d group by 1")
def _grain(spark, sf_dir):
    return r6(A.grain_histogram(table(spark, sf_dir, "part"), "p_size", by=["p_brand"]))


@case("sci_range_checker", "select event_id, event_type as key, value, case event_type when 'view' then case when value < 1 or value > 40 then 'CRITICAL' when value < 5 then 'LOW' when value > 20 then 'HIGH' else 'OK' end else case when value < 0 or value > 90 then 'CRITICAL' when value < 2 then 'LOW' when value > 50 then 'HIGH' else 'OK' end end as status from events where event_type in ('view', 'click')")
def _range(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", F.col("event_type").alias("key"), "value")
    return A.range_checker(d, {"view": (1, 5, 20, 40), "click": (0, 2, 50, 90)})


@case("ml_training_monitor", "with h as (select user_id as run, event_id as epoch, value as t, value * 2 as v, avg(value) over (partition by user_id order by event_id rows 2 preceding) as a from events) select run, arg_min(epoch, (v, epoch)) as best_epoch, arg_max(t, epoch) as final_train_loss, round(arg_max(v, epoch), 6) as final_val_loss, round(arg_max(a, epoch), 6) as smooth_train_loss from h group by 1")
def _monitor(spark, sf_dir):
    h = events(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("train_loss"), (F.col("value") * 2).alias("val_loss"))
    return r6(A.training_monitor(h))


@case("ml_best_params", "select user_id, arg_max(event_id, (value * 2.0, -event_id)) as best_step, round(max(value * 2.0), 6) as best_score from events group by 1")
def _best(spark, sf_dir):
    return r6(A.best_params(events(spark, sf_dir).withColumn("step", F.col("event_id")), {"value": 2.0}, U))


@case("logic_python", "select event_id, value * 2 as doubled from events")
def _python(spark, sf_dir):
    return run_python(events(spark, sf_dir).select("event_id", "value"), lambda p: p.assign(doubled=p["value"] * 2)[["event_id", "doubled"]], "event_id long, doubled double")


@case("sci_region_classifier", "select p_partkey, case when p_size > 40 and p_retailprice > 1000 then 'big' when p_size < 10 then 'small' else 'other' end as class from part")
def _classifier(spark, sf_dir):
    return classify_regions(table(spark, sf_dir, "part"), [("p_size > 40 and p_retailprice > 1000", "big"), ("p_size < 10", "small")]).select("p_partkey", "class")


@case("feat_filter_contours", "select p_partkey, case when p_size between 10 and 30 then 1 else 0 end as n from part")
def _contours(spark, sf_dir):
    c = F.struct(F.col("p_size").cast("double").alias("area"), F.lit(0.5).alias("circularity"), F.lit(1.0).alias("elongation"), F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("center"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(filter_contours(F.array(c), 10, 30)).alias("n"))


@case("feat_contour_props", "select p_partkey, p_size::double as area from part")
def _contour_props(spark, sf_dir):
    c = F.struct(F.col("p_size").cast("double").alias("area"), F.lit(0.5).alias("circularity"), F.lit(1.0).alias("elongation"), F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("center"))
    return table(spark, sf_dir, "part").select("p_partkey", contour_props(c)["area"].alias("area"))


for _name, _build in {
    "draw_arrow": lambda x, y, w, h: G.draw_arrow(x, y, w, h), "draw_line": lambda x, y, w, h: G.draw_line(x, y, w, h), "draw_point": lambda x, y, w, h: G.draw_point(x, y),
    "draw_rect": lambda x, y, w, h: G.draw_rect(x, y, w, h), "draw_ellipse": lambda x, y, w, h: G.draw_ellipse(x, y, w, h),
}.items():

    def _draw(spark, sf_dir, build=_build):
        return table(spark, sf_dir, "supplier").select("s_suppkey", build(F.lit(1.0), F.lit(2.0), F.col("s_acctbal"), F.lit(3.0))["shape"].alias("shape"))

    case(_name, f"select s_suppkey, '{_name[5:]}' as shape from supplier")(_draw)


@case("draw_text", "select n_nationkey, n_name as text from nation")
def _draw_text(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", G.draw_text(F.col("n_name"), F.lit(0.0), F.lit(0.0))["text"].alias("text"))

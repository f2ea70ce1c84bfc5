"""Operators that SQL can't say, graphs, sources, sinks and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem import registry
from meristem.functions.expressions import compile_expression, math_expr
from meristem.functions.scalars import math_div, math_round
from meristem.operators import geometry, labels, learning, relational, signals, stencils
from meristem.operators.components import connected_components
from meristem.plans import graph
from meristem.sources import readers, writers
from meristem.streaming import stateful


def raster(spark, a, rid=1):
    a = np.asarray(a, float)
    return spark.createDataFrame([(rid, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "raster_id int, y int, x int, v double")


def dense(df, name="v"):
    rows = df.select("y", "x", name).collect()
    a = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1))
    for y, x, v in rows:
        a[y, x] = v
    return a


def test_registry_is_whole():
    assert len(registry.load_all()) >= 320 and registry.get("math_add").kind == "column"


def test_quirks(spark):
    row = spark.range(1).select(math_div(F.lit(1.0), F.lit(0.0)), math_round(F.lit(-2.5)), math_expr("a / 0", a=F.lit(1.0)), math_expr("a +", a=F.lit(1.0))).first()
    assert tuple(row) == (0.0, -2, 0.0, 0.0)
    with pytest.raises(ValueError):
        compile_expression("__import__('os')", {})
    with pytest.raises(ValueError):
        compile_expression("x.y.z", {"x": F.lit(1)})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_labels_match_a_flood_fill(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((12, 12)) > 0.55) * 255.0
    got = {(r["y"], r["x"]): r["label"] for r in labels.component_labels(raster(spark, a)).collect()}
    want, n = {}, 0
    for y in range(12):
        for x in range(12):
            if a[y, x] and (y, x) not in want:
                n += 1
                todo = [(y, x)]
                while todo:
                    p = todo.pop()
                    if p in want or not (0 <= p[0] < 12 and 0 <= p[1] < 12) or not a[p]:
                        continue
                    want[p] = n
                    todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert got == want


def test_holes_and_distance(spark):
    a = np.zeros((7, 7))
    a[1:6, 1:6] = 255
    a[3, 3] = 0
    filled = dense(labels.fill_holes(raster(spark, a)))
    assert filled[3, 3] == 255 and filled.sum() == 25 * 255
    d = dense(labels.distance_transform(raster(spark, a)))
    assert d[2, 2] == pytest.approx(math.sqrt(2)) and d[3, 3] == 0 and d[2, 3] == 1


def test_stencils_match_numpy(spark):
    a = np.random.default_rng(2).integers(0, 256, (9, 11)).astype(float)
    p = np.pad(a, 2, mode="reflect")
    k = stencils.gaussian_kernel(5)
    want = sum(k[i, j] * p[i : i + 9, j : j + 11] for i in range(5) for j in range(5))
    assert np.allclose(dense(stencils.gaussian_blur(raster(spark, a), 5)), want)
    assert np.allclose(dense(stencils.box_mean(raster(spark, a), 5)), sum(p[i : i + 9, j : j + 11] for i in range(5) for j in range(5)) / 25)
    med = np.median(np.stack([p[1 + i : 10 + i, 1 + j : 12 + j] for i in range(3) for j in range(3)]), axis=0)
    assert np.allclose(dense(stencils.blur(raster(spark, a), 3, "median")), med)


def test_transforms_match_numpy(spark):
    a = np.random.default_rng(3).integers(0, 256, (6, 8)).astype(float)
    f = geometry.dft(raster(spark, a))
    assert np.allclose(dense(f, "re") + 1j * dense(f, "im"), np.fft.fft2(a))
    assert np.allclose(dense(geometry.ifft(geometry.fft(raster(spark, a)))), a)
    assert np.allclose(dense(geometry.rotate(raster(spark, a), 180)), a[::-1, ::-1])


def test_fold_filters_match_loops(spark):
    v = np.random.default_rng(4).normal(0, 1, 50)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    s, want = v[0], [v[0]]
    for x in v[1:]:
        s = 0.2 * x + 0.8 * s
        want.append(s)
    got = [r["filtered"] for r in signals.exponential_average(df, "v", "i", ["k"]).orderBy("i").collect()]
    assert np.allclose(got, want)
    assert signals.particle_filter(df, "v", "i", ["k"]).count() == 50


def test_split_is_exact_and_stratified(spark):
    df = spark.range(1001).withColumn("s", F.col("id") % 3)
    train, test = learning.train_test_split(df, ["id"], 0.2, stratify="s")
    assert {r["s"]: r["count"] for r in test.groupBy("s").count().collect()} == {0: 67, 1: 67, 2: 67}
    assert train.unionByName(test).distinct().count() == 1001


def test_kmeans_and_trees(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, float(x), float(y), f"c{i // 60}") for i, (x, y) in enumerate(pts)], "id long, x double, y double, c string")
    got = learning.kmeans(df, ["x", "y"], 3)[0].groupBy("c").agg(F.count_distinct("cluster").alias("n")).collect()
    assert all(r["n"] == 1 for r in got)
    out, weights = learning.decision_tree(df, df, ["x", "y"], "c")
    assert out.where("prediction <> c").count() == 0 and sum(weights.values()) == pytest.approx(1)


def test_filter_and_join_quirks(spark):
    df = spark.createDataFrame([(1, "5"), (2, None), (3, "x")], "k int, t string")
    assert relational.filter_rows(df, "t", "<", 6).count() == 1
    assert relational.filter_rows(df, "t", "<", 6, compat=True).count() == 3
    assert relational.filter_rows(df, "t", "<", "abc").count() == 3
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k int, va string")
    b = spark.createDataFrame([("1", "x"), (None, "m")], "k string, vb string")
    assert sorted(map(str, ((r["va"], r["vb"]) for r in relational.join_tables([a, b], "k").collect()))) == ["('b', 'x')", "('n', 'm')"]


def test_graph_flattens_groups_and_rejects_cycles(spark):
    inner = {"nodes": [{"id": "i", "type": "group_input"}, {"id": "f", "type": "ml_df_filter", "data": {"params": {"name": "id", "op": "<", "value": 3}}}, {"id": "o", "type": "group_output"}], "edges": [{"source": "i", "sourceHandle": "any__a", "target": "f", "targetHandle": "any__df"}, {"source": "f", "target": "o", "targetHandle": "any__z"}]}
    g = {
        "nodes": [{"id": "t", "type": "table", "data": {"params": {"name": "n"}}}, {"id": "g", "type": "group_node", "data": {"subGraph": inner}}, {"id": "m", "type": "math_add", "data": {"params": {"columns": {"a": "id", "b": "id"}, "out": "twice"}}}],
        "edges": [{"source": "t", "target": "g", "targetHandle": "any__a"}, {"source": "g", "sourceHandle": "any__z", "target": "m", "targetHandle": "any__df"}],
    }
    assert [r["twice"] for r in graph.run(spark, g, "m", {"n": spark.range(10)}).orderBy("id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        graph.topological({"nodes": [{"id": "a", "type": "x"}, {"id": "b", "type": "x"}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]})


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b,a,c\n1,x,true,1.5\n2,NA,false,\n3,"q, ""r""",true,2\n')
    df = readers.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "a.1": "boolean", "c": "double"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x", True, 1.5), (2, None, False, None), (3, 'q, "r"', True, 2.0)]
    writers.export(df, str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_image_round_trip(spark, tmp_path):
    a = np.random.default_rng(6).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "frame1.png").write_bytes(writers.encode_png(a))
    px = readers.read_images(spark, str(tmp_path / "frame1.png"))
    got = np.stack([dense(px, b) for b in "bgr"], axis=2)
    assert (got == a).all()
    assert writers.encoded_frames(px).first()["png"] == writers.encode_png(a)
    (tmp_path / "g.pgm").write_bytes(b"P5\n2 2\n255\n" + bytes([1, 2, 3, 4]))
    assert (readers.decode_image((tmp_path / "g.pgm").read_bytes())[..., 0] == [[1, 2], [3, 4]]).all()


def test_streams_keep_state(spark, tmp_path):
    rows = [(k, i, float((i * 7 + k) % 5)) for i in range(12) for k in (1, 2)]
    for part in (0, 1):
        spark.createDataFrame(rows[part * 12 : part * 12 + 12], "k int, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, i long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.exponential_average(stream, "k", "i", "v").writeStream.format("memory").queryName("ema").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["k"], r["i"]): r["filtered"] for r in spark.table("ema").collect()}
    want = signals.exponential_average(spark.createDataFrame(rows, "k int, i long, v double"), "v", "i", ["k"]).collect()
    assert len(got) == 24 and all(got[r["k"], r["i"]] == pytest.approx(r["filtered"]) for r in want)


@pytest.mark.parametrize("top", [100_000, 15, 0])
def test_slices_are_those_of_a_list(spark, monkeypatch, top):
    """From either end, across it, and beyond the rows that a top-n may hold."""
    monkeypatch.setattr(relational, "TOP", top)
    rows = [(i * 7 % 40 if i % 9 else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    whole = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for start, stop in ((-9, -4), (-60, -30), (-9, None), (-4, -9), (3, 8), (3, -20), (-38, 9), (22, 31), (12, None), (0, None), (30, 99), (50, 60), (-50, 0)):
        assert [tuple(r) for r in relational.slice_rows(df, start, stop, ["k"]).collect()] == whole[start:stop], (start, stop)


def test_a_slice_at_the_end_keeps_few_rows(spark):
    """The last fifty of many rows are the first fifty in the other order; a top-n from the front would hold the whole table."""
    plan = relational.slice_rows(spark.range(5_000), -50, -20, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "limit=50," in plan and "limit=49" not in plan

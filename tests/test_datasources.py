"""Planned partitions, pushed windows and stream offsets of the data sources."""

import os

import numpy as np
import pytest
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from meristem.sources import datasources as D
from meristem.sources import readers as R
from meristem.sources import writers as W


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("deflate", [False, True])
def test_geotiff_round_trip(spark, tmp_path, apart, deflate):
    rng = np.random.default_rng(1)
    px = np.round(rng.normal(size=(3, 37, 21)), 3)
    px[1, 5, 6] = -9.0
    (tmp_path / "a.tif").write_bytes(W.encode_tiff(px, 8, (10.0, 50.0), 0.25, -9.0, deflate, apart))
    (tmp_path / "note.txt").write_text("x")
    got = {(r["band"], r["y"], r["x"]): (r["v"], r["lon"], r["lat"]) for r in R.read_geotiff(spark, str(tmp_path)).collect()}
    assert len(got) == px.size
    for (b, y, x), (v, lon, lat) in got.items():
        assert (v is None) == (px[b, y, x] == -9) and (v is None or v == px[b, y, x])
        assert (lon, lat) == (10 + (x + 0.5) * 0.25, 50 - (y + 0.5) * 0.25)


def test_a_window_reads_its_strips_alone(spark, tmp_path, monkeypatch):
    px = np.arange(64 * 10, dtype=float).reshape(1, 64, 10)
    data = bytearray(W.encode_tiff(px, 4, deflate=False))
    lay_path = tmp_path / "a.tif"
    lay_path.write_bytes(data)
    lay = D.layout(str(lay_path))
    for n in (0, 15):  # strips outside the window hold nothing that can be read
        lay.tags[279][n] = 0
    reader = D.GeoTiffReader(str(tmp_path))
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("y",), 20), LessThan(("y",), 30)]))) == 2
    assert [p.numbers for p in reader.partitions()] == [[5, 6, 7]]
    monkeypatch.setattr(D, "PIXELS", 80)
    assert [p.numbers for p in D.GeoTiffReader(str(tmp_path)).partitions()] == [[k, k + 1] for k in range(0, 16, 2)]
    window = R.read_geotiff(spark, str(tmp_path)).where("y >= 20 and y < 30")
    assert sorted(r["v"] for r in window.collect()) == list(range(200, 300))
    assert window.rdd.getNumPartitions() == 1
    # the strips outside are cut off: only a plan that leaves them out can read the rest
    at, size = D.layout(str(lay_path)).tags[273], 4 * 10 * 8
    lay_path.write_bytes(bytes(data).replace(bytes(data[at[0] : at[0] + size]), b"\xff" * size))
    assert sorted(r["v"] for r in window.collect()) == list(range(200, 300))


def frame(path, number, value):
    draft = path / f".draft{number}"
    draft.write_bytes(W.encode_png(np.full((3, 4), value, np.uint8)))
    os.rename(draft, path / f"f{number}.png")


def test_frames_as_a_table_and_a_stream_that_goes_on(spark, tmp_path):
    folder = tmp_path / "camera"
    folder.mkdir()
    seen = []
    for first, last in ((0, 3), (3, 3), (3, 12)):
        for i in range(first, last):
            frame(folder, i, 20 * i)
        q = R.frame_stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        seen.append(len(rows))
        assert {(r["frame"], r["b"]) for r in rows} == {(i, 20.0 * i) for i in range(last)}
    assert seen == [36, 36, 144]
    table = R.read_frames(spark, str(folder))
    assert table.rdd.getNumPartitions() == 12
    assert {(r["frame"], r["g"], r["total_frames"]) for r in table.collect()} == {(i, 20.0 * i, 12) for i in range(12)}

"""Round trips of readers and writers."""

import struct

import numpy as np
from pyspark.sql import functions as F

from lithoframe.sources import files as S


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [(0.0, 0.0), (1.5, 2.0)]), (2, None, [(3.0, 4.0), (5.0, 6.0)])], f"id long, name string, geometry array<{S.POINT}>")
    S.write_geojson(df, str(tmp_path / "g"), "geometry", "LineString", ["id", "name"])
    back = S.read_geojson(spark, str(tmp_path / "g"), "LineString", "id: long, name: string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":7},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    row = S.read_geojson(spark, str(tmp_path / "c.json"), "Point", "id: long").first()
    assert (row.id, row.geometry.x, row.geometry.y) == (7, 1.0, 2.0)


def test_wkt(spark):
    df = spark.createDataFrame([("POINT (1 2)",), ("LINESTRING (0 0, 1.5 2)",), ("POLYGON ((0 0, 1 0, 1 1, 0 0))",), (None,), ("POINT EMPTY",)], "t string").select(S.parse_wkt(F.col("t")).alias("g"))
    assert [None if r.g is None else [(p.x, p.y) for p in r.g] for r in df.collect()] == [[(1, 2)], [(0, 0), (1.5, 2)], [(0, 0), (1, 0), (1, 1), (0, 0)], None, None]


def test_dxf(spark, tmp_path):
    entity = lambda kind, text, x, y: f"0\n{kind}\n1\n{text}\n10\n{x}\n20\n{y}\n"
    (tmp_path / "a.dxf").write_text(entity("TEXT", "12", 1, 2) + entity("MTEXT", "13", 3, 4) + entity("TEXT", "A1", 5, 6) + entity("LINE", "14", 7, 8) + entity("TEXT", "12", 9, 10) + entity("TEXT", "15", "bad", 1) + "0\nEOF\n")
    assert {r.label: (r.x, r.y) for r in S.read_dxf_labels(spark, str(tmp_path / "a.dxf")).collect()} == {"12": (9, 10), "13": (3, 4)}


def test_shapes(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4dii1i", 5, 0, 0, 3, 2, 1, 4, 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    record = struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(struct.pack(">i20xi", 9994, (100 + len(record)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + record)
    row = S.read_shapes(spark, str(tmp_path / "a.shp")).first()
    assert row.shp_idx == 0 and [(p.x, p.y) for p in row.ring] == ring


def test_shapefile_round_trip(spark, tmp_path):
    """Rings, points and attributes come back; long names are cut and stay distinct, NULL and missing shapes stay so."""
    rows = [(1, "é" * 200, 0.5, [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (0.0, 0.0)]), (2, None, None, [(5.0, 5.0), (6.0, 5.0), (6.0, 7.5), (5.0, 5.0)]), (None, "b", -1e30, None)]
    df = spark.createDataFrame(rows, f"id long, betweenness_name string, betweenness_value double, ring array<{S.POINT}>").coalesce(1)
    S.write_shapes(df, str(tmp_path / "a"), "ring", "Polygon", ["id", "betweenness_name", "betweenness_value"])
    shapes = {r.shp_idx: [tuple(p) for p in r.ring] for r in S.read_shapes(spark, str(tmp_path / "a.shp")).collect()}
    assert shapes == {0: rows[0][3], 1: rows[1][3]}
    told = {r.shp_idx: r.attributes for r in S.read_attributes(spark, str(tmp_path / "a.dbf")).collect()}
    assert told[0] == {"id": "1", "betweennes": "é" * 127, "betweenn_1": "0.500000000"}
    assert told[1] == {"id": "2", "betweennes": None, "betweenn_1": None} and told[2]["id"] is None and float(told[2]["betweenn_1"]) == -1e30
    files = {S.read_shapes(spark, str(tmp_path / "a.shp")).first().file, S.read_attributes(spark, str(tmp_path / "a.dbf")).first().file}
    assert len(files) == 1
    size = (tmp_path / "a.shp").stat().st_size
    assert struct.unpack(">i", (tmp_path / "a.shp").read_bytes()[24:28])[0] * 2 == size and (tmp_path / "a.shx").stat().st_size == 124
    points = spark.createDataFrame([((1.0, 2.0),), ((3.0, 4.0),)], f"p {S.POINT}").coalesce(1)
    S.write_shapes(points, str(tmp_path / "b"), "p", "Point", [])
    assert [tuple(r.ring[0]) for r in S.read_shapes(spark, str(tmp_path / "b.shp")).collect()] == [(1, 2), (3, 4)]
    S.write_shapes(points.limit(0), str(tmp_path / "c"), "p", "Point", [])
    assert S.read_shapes(spark, str(tmp_path / "c.shp")).count() == 0 and S.read_attributes(spark, str(tmp_path / "c.dbf")).count() == 0


def test_rasters(spark, tmp_path):
    grid = np.array([[1.5, np.nan, 3.0], [4.0, 5.0, -2.0]])
    (tmp_path / "a.tif").write_bytes(S.encode_tiff(grid, (10.0, 20.0), 0.5))
    back, origin, cell = S.decode_tiff((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(back, grid, equal_nan=True) and origin == (10.0, 20.0) and cell == 0.5
    cells = S.read_tiff(spark, str(tmp_path / "a.tif"))
    assert {(r.row_id, r.col_id): r.v for r in cells.collect()} == {(i, j): None if np.isnan(grid[i, j]) else grid[i, j] for i in range(2) for j in range(3)}
    S.write_raster(cells, str(tmp_path / "p"), "v")
    assert S.read_raster(spark, str(tmp_path / "p"), "v").where("v is null").count() == 1
    assert S.read_tiles(spark, str(tmp_path / "p"), "part-*").select("tile").distinct().count() >= 1


def test_optional_and_presence(spark, tmp_path):
    assert S.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    spark.range(2).write.parquet(str(tmp_path / "some"))
    assert S.read_optional(spark, str(tmp_path / "some"), "id long").count() == 2
    got = {r.name: r.present for r in S.presence(spark, {"a": f"file://{tmp_path}/some", "b": f"file://{tmp_path}/none"}).collect()}
    assert got == {"a": True, "b": False}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nA=1\nB='two'\n\nbroken\n")
    monkeypatch.setenv("C", "env")
    assert S.settings(str(tmp_path / ".env"), {"A": "0", "C": "0", "D": "d"}) == {"A": "1", "B": "two", "C": "env", "D": "d"}
    assert S.settings(None, {"A": "0"}) == {"A": "0"}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("100", 1, 2.5), (None, 2, None)], "chapel_id string, shp_idx long, dist_m double")
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert sorted(map(str, spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "c")).collect())) == sorted(map(str, df.collect()))


def test_degrees(spark):
    df = spark.createDataFrame([([(500_000.0, 0.0), (254_000.0, 2_821_000.0)],)], f"g array<{S.POINT}>").select(S.to_degrees(F.col("g"), "LineString", 36).alias("g"))
    a, b = df.first().g
    assert abs(a.x - 33) < 1e-9 and abs(a.y) < 1e-9 and 30 < b.x < 31 and 25 < b.y < 26

"""Readers and writers of layers: GeoJSON, CSV, shapefiles, DXF text, GeoTIFF and WKT, by Spark's own sources where they exist."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crs import inverse

POINT = "struct<x: double, y: double>"
NODATA = -9999.0


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet layer, or no rows of its schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def settings(path: str | None, defaults: dict[str, str]) -> dict[str, str]:
    """key=value lines of a file over the defaults; the environment wins. Comments and blank lines are skipped."""
    found = dict(defaults)
    if path and os.path.exists(path):
        with open(path) as f:
            for line in f:
                key, sign, value = line.strip().partition("=")
                if sign and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("'\"")
    return {k: os.environ.get(k, v) for k, v in found.items()}


def presence(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, present): which sources exist, asked of the file system that each path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        rows.append((name, path, bool(p.getFileSystem(conf).exists(p))))
    return spark.createDataFrame(rows, "name string, path string, present boolean")


def read_tiles(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """All Parquet tiles of a folder whose name fits, with their file as tile."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder).withColumn("tile", F.col("_metadata.file_path"))


# ---- GeoJSON


def to_geojson(df: DataFrame, geometry: str, kind: str, properties: list[str]) -> DataFrame:
    """(value): one feature of each row; kind is Point, LineString or Polygon, geometry a point or an array of points."""
    pair = lambda p: F.array(p["x"], p["y"])
    g = F.col(geometry)
    coords = pair(g) if kind == "Point" else F.transform(g, pair)
    coords = F.array(coords) if kind == "Polygon" else coords
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def to_degrees(geometry: Column, kind: str, zone: int, north: bool = True) -> Column:
    """A geometry in metres of a UTM zone as longitude and latitude, for exchange formats."""

    def move(p: Column) -> Column:
        lon, lat = inverse(p["x"], p["y"], zone, north)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return move(geometry) if kind == "Point" else F.transform(geometry, move)


def write_geojson(df: DataFrame, path: str, geometry: str, kind: str, properties: list[str]) -> None:
    """Newline-delimited features, in parallel."""
    to_geojson(df, geometry, kind, properties).write.text(path)


def read_geojson(spark: SparkSession, path: str, kind: str, properties: str) -> DataFrame:
    """Newline-delimited features, or collections: the properties and `geometry` as a point or an array of points."""
    depth = {"Point": "array<double>", "LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>"}[kind]
    feature = f"type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: {depth}>"
    top = f"type string, properties struct<{properties}>, geometry struct<type: string, coordinates: {depth}>, features array<struct<{feature}>>"
    rows = spark.read.schema(top).json(path)
    each = rows.select(F.explode(F.coalesce("features", F.array(F.struct("type", "properties", "geometry")))).alias("f"))
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    c = F.col("f.geometry.coordinates")
    return each.select("f.properties.*", (pair(c) if kind == "Point" else F.transform(c[0] if kind == "Polygon" else c, pair)).alias("geometry"))


def parse_wkt(text: Column) -> Column:
    """Points of a WKT point, line or simple polygon."""
    body = F.regexp_extract(text, r"\(+([^()]*)\)+", 1)
    pair = lambda p: F.filter(F.split(F.trim(p), r"\s+"), lambda x: x != "")
    return F.when(body != "", F.transform(F.split(body, ","), lambda p: F.struct(pair(p)[0].cast("double").alias("x"), pair(p)[1].cast("double").alias("y"))))


# ---- DXF text


def read_dxf_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, x, y): TEXT and MTEXT entities whose text is digits only; of equal labels the last in the file wins.

    A DXF file is pairs of lines, a code and a value; a drawing is read whole by one task.
    """

    def entities(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content in part["content"]:
                lines = bytes(content).decode("utf-8", "replace").splitlines()
                kind, held, n = None, {}, 0

                def done(kind=None, held=None, n=0, rows=rows):
                    text = held.get("1", "").strip() if held else ""
                    if kind in ("TEXT", "MTEXT") and text.isascii() and text.isdigit():
                        try:
                            rows.append((text, float(held["10"]), float(held["20"]), n))
                        except (KeyError, ValueError):
                            pass  # an entity without a readable place

                for code, value in zip(lines[::2], lines[1::2], strict=False):
                    if code.strip() == "0":
                        done(kind, held, n)
                        kind, held, n = value.strip(), {}, n + 1
                    else:
                        held.setdefault(code.strip(), value)
                done(kind, held, n)
            yield pd.DataFrame(rows, columns=["label", "x", "y", "seq"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(entities, "label string, x double, y double, seq long")
    return found.groupBy("label").agg(F.max_by(F.struct("x", "y"), "seq").alias("p")).select("label", "p.x", "p.y")


# ---- shapefiles (polygons and lines; the attribute table as text)


def _stem(path: str) -> str:
    return os.path.splitext(path)[0]


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, shp_idx, ring): the first part of every record of .shp files; file has no extension, and read_attributes gives the same keys."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"].map(_stem), part["content"], strict=True):
                data, at, k = bytes(content), 100, 0
                while at + 8 <= len(data):
                    size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
                    body = data[at + 8 : at + 8 + size]
                    kind = struct.unpack("<i", body[:4])[0]
                    if kind in (3, 5):
                        n_parts, n_points = struct.unpack("<ii", body[36:44])
                        starts = struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts])
                        xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)[starts[0] : starts[1] if n_parts > 1 else n_points]
                        rows.append((name, k, [{"x": float(x), "y": float(y)} for x, y in xy]))
                    elif kind == 1:
                        rows.append((name, k, [dict(zip("xy", struct.unpack("<dd", body[4:20]), strict=True))]))
                    k += 1
                    at += 8 + size
            yield pd.DataFrame(rows, columns=["file", "shp_idx", "ring"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, f"file string, shp_idx long, ring array<{POINT}>")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(file, shp_idx, attributes): the columns of .dbf files as text; blank ones are NULL."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"].map(_stem), part["content"], strict=True):
                data = bytes(content)
                n, head, size = struct.unpack("<IHH", data[4:12])
                fields = [(data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]) for at in range(32, head - 1, 32)]
                for k in range(n):
                    at, own = head + k * size + 1, {}
                    for field, width in fields:
                        own[field] = data[at : at + width].decode("utf-8", "replace").strip() or None
                        at += width
                    rows.append((name, k, own))
            yield pd.DataFrame(rows, columns=["file", "shp_idx", "attributes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, shp_idx long, attributes map<string, string>")


def _field_names(columns: list[str]) -> list[str]:
    """Names of ten characters at most, numbered where they would be equal."""
    out: list[str] = []
    for c in columns:
        name, k = c[:10], 1
        while name in out:
            name, k = f"{c[: 9 - len(str(k))]}_{k}", k + 1
        out.append(name)
    return out


def write_shapes(df: DataFrame, path: str, geometry: str, kind: str, columns: list[str]) -> None:
    """A shapefile (path.shp, .shx and .dbf) on the driver's disk; geometry is a point or an array of points, its units stay.

    Rows come one partition at a time and are written at once; the format itself ends at 2 GB. Names of columns are cut to ten
    characters, texts to 254 bytes, NULL is blank.
    """
    code = {"Point": 1, "LineString": 3, "Polygon": 5}[kind]
    types = dict(df.select(*columns).dtypes)
    numeric = {c: types[c] in ("double", "float") or types[c].startswith("decimal") for c in columns}
    whole = {c: types[c] in ("tinyint", "smallint", "int", "bigint") for c in columns}
    fields = [(name, *((b"N", 24, 9) if numeric[c] else (b"N", 20, 0) if whole[c] else (b"C", 254, 0)), c) for name, c in zip(_field_names(columns), columns, strict=True)]

    def shown(v, width: int, decimals: int) -> bytes:
        text = "" if v is None else f"{v:.{decimals}f}" if decimals else str(v)
        if len(text) > width and decimals:
            text = f"{v:.{width - 8}e}"
        return text.encode()[:width].decode("utf-8", "ignore").encode().ljust(width)

    low, high, at, n = [np.inf, np.inf], [-np.inf, -np.inf], 100, 0
    with open(f"{path}.shp", "wb") as shp, open(f"{path}.shx", "wb") as shx, open(f"{path}.dbf", "wb") as dbf:
        shp.write(bytes(100))
        shx.write(bytes(100))
        head = 33 + 32 * len(fields)
        dbf.write(bytes(32) + b"".join(struct.pack("<11sc4xBB14x", f.encode(), t, w, d) for f, t, w, d, _ in fields) + b"\r")
        for row in df.select(F.col(geometry).alias("_g"), *columns).toLocalIterator():
            points = [] if row["_g"] is None else [row["_g"]] if kind == "Point" else row["_g"]
            xy = np.array([(p.x, p.y) for p in points], "<f8").reshape(-1, 2)
            if not len(xy):
                body = struct.pack("<i", 0)
            else:
                box = [*xy.min(axis=0), *xy.max(axis=0)]
                low, high = np.minimum(low, box[:2]), np.maximum(high, box[2:])
                body = struct.pack("<i", code) + (b"" if kind == "Point" else struct.pack("<4diii", *box, 1, len(xy), 0)) + xy.tobytes()
            n += 1
            shp.write(struct.pack(">ii", n, len(body) // 2) + body)
            shx.write(struct.pack(">ii", at // 2, len(body) // 2))
            at += 8 + len(body)
            if at >= 1 << 31:
                raise ValueError("a shapefile holds 2 GB at most")
            dbf.write(b" " + b"".join(shown(row[c], w, d) for _, _, w, d, c in fields))
        dbf.write(b"\x1a")
        bounds = [*low, *high] if n and np.isfinite(low[0]) else [0.0] * 4
        for f, size in ((shp, at), (shx, 100 + 8 * n)):
            f.seek(0)
            f.write(struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii8d", 1000, code, *bounds, 0, 0, 0, 0))
        dbf.seek(0)
        dbf.write(struct.pack("<4BIHH20x", 3, 126, 1, 1, n, head, 1 + sum(w for _, _, w, _, _ in fields)))


# ---- rasters


def write_raster(cells: DataFrame, path: str, value: str) -> None:
    """A cell table as Parquet, missing values as the sentinel and values as 32-bit floats."""
    cells.select("row_id", "col_id", F.coalesce(value, F.lit(NODATA)).cast("float").alias(value)).write.parquet(path)


def read_raster(spark: SparkSession, path: str, value: str, nodata: float = NODATA) -> DataFrame:
    """Such a table with the sentinel and NaN as NULL."""
    v = F.col(value).cast("double")
    return spark.read.parquet(path).withColumn(value, F.when((v != nodata) & ~F.isnan(v), v))


def encode_tiff(grid: np.ndarray, origin: tuple[float, float], cell: float) -> bytes:
    """A one-band 32-bit float GeoTIFF in one uncompressed strip."""
    data = np.ascontiguousarray(np.where(np.isnan(grid), NODATA, grid), "<f4").tobytes()
    h, w = grid.shape
    nodata = f"{NODATA:g}".encode() + b"\0"
    scale, tie = struct.pack("<3d", cell, cell, 0), struct.pack("<6d", 0, 0, 0, origin[0], origin[1], 0)
    at = 8 + len(data)
    extra = {33550: at, 33922: at + 24, 42113: at + 72}
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, extra[33550]), (33922, 12, 6, extra[33922]), (42113, 2, len(nodata), extra[42113])]
    body = scale + tie + nodata.ljust(8, b"\0")
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at + len(body)) + data + body + ifd


def decode_tiff(data: bytes) -> tuple[np.ndarray, tuple[float, float], float]:
    """Grid (NaN where there is no data), upper left corner and cell size of an uncompressed one-band GeoTIFF."""
    end = "<" if data[:2] == b"II" else ">"
    ifd = struct.unpack(end + "I", data[4:8])[0]
    tags = {}
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
    for k in range(struct.unpack(end + "H", data[ifd : ifd + 2])[0]):
        at = ifd + 2 + 12 * k
        tag, kind, n = struct.unpack(end + "HHI", data[at : at + 8])
        if kind not in sizes:
            continue
        form = f"{end}{n}{sizes[kind]}"
        size = struct.calcsize(form)
        start = at + 8 if size <= 4 else struct.unpack(end + "I", data[at + 8 : at + 12])[0]
        tags[tag] = struct.unpack(form, data[start : start + size])
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("only uncompressed one-band files are read")
    kind = {(3, 32): "f4", (3, 64): "f8", (2, 16): "i2", (1, 8): "u1", (1, 16): "u2"}[tags.get(339, (1,))[0], tags[258][0]]
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    grid = np.frombuffer(raw, end + kind).reshape(tags[257][0], tags[256][0]).astype(np.float64)
    if 42113 in tags:
        grid = np.where(grid == float(tags[42113][0].rstrip(b"\0")), np.nan, grid)
    tie, scale = tags.get(33922, (0,) * 6), tags.get(33550, (1.0, 1.0, 0))
    return grid, (tie[3], tie[4]), scale[0]


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, col_id, v) of GeoTIFF files, missing values as NULL; one task for each file."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                grid = decode_tiff(bytes(content))[0]
                for r in range(0, len(grid), 256):
                    block = grid[r : r + 256]
                    rows, cols = np.indices(block.shape)
                    v = pd.array(block.ravel(), dtype="Float64")
                    v[np.isnan(block.ravel())] = pd.NA
                    yield pd.DataFrame({"row_id": (rows + r).ravel().astype("int32"), "col_id": cols.ravel().astype("int32"), "v": v})

    schema = T.StructType([T.StructField("row_id", T.IntegerType()), T.StructField("col_id", T.IntegerType()), T.StructField("v", T.DoubleType())])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)

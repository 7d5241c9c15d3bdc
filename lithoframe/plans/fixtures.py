"""Stand-in tables for the spatial operators, as views over the star schema, and the same as SQL for the oracle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

_BAND = "CASE WHEN vec_id % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor((CAST(embedding[{k}] AS DOUBLE) + 1)*1000) AS DOUBLE) END AS dn{n}"
_VIEWS = {
    "fx_pixels": ("embeddings", ["vec_id", "CAST(floor(vec_id/25.0) AS INT) AS row_id", "CAST(vec_id % 25 AS INT) AS col_id", "label", *[_BAND.replace("{n}", str(i)).replace("{k}", "{%d}" % i) for i in range(1, 9)]], ""),
    "fx_dem": ("events", ["CAST(floor(event_id/100.0) AS INT) AS row_id", "CAST(event_id % 100 AS INT) AS col_id", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(70.0 AS DOUBLE) + value/50.0 END AS elev"], ""),
    "fx_doors": ("embeddings", ["vec_id AS door_id", "CAST(200 AS DOUBLE) + 400*CAST(embedding[{9}] AS DOUBLE) AS x", "CAST(200 AS DOUBLE) + 400*CAST(embedding[{10}] AS DOUBLE) AS y", "CAST(100 + vec_id % 120 AS STRING) AS chapel_id", "CASE vec_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS direction"], "vec_id < 120"),
    "fx_footprints": ("supplier", ["s_suppkey AS shp_idx", "CAST(20 + 36*(s_suppkey % 10) AS DOUBLE) AS cx", "CAST(20 + 36*floor(s_suppkey/10.0) AS DOUBLE) AS cy", "CAST(3 + (s_suppkey*7) % 5 AS DOUBLE) AS hw", "CAST(3 + (s_suppkey*11) % 4 AS DOUBLE) AS hh"], "s_suppkey < 100"),
    "fx_sheet": ("customer", ["c_custkey AS row_no", "CAST(100 + c_custkey % 120 AS STRING) AS chapel_id", "CASE c_custkey % 8 WHEN 0 THEN 'North' WHEN 1 THEN 'south (blocked)' WHEN 2 THEN 'N and E' WHEN 3 THEN 'East/West' WHEN 4 THEN 'unknown' WHEN 5 THEN NULL WHEN 6 THEN 'NE' ELSE 'S, N, south' END AS raw_dir"], ""),
    "fx_labels": ("supplier", ["CAST(100 + s_suppkey AS STRING) AS label", "CAST((20 + 36*(s_suppkey % 10) - 50)/2.0 + (s_suppkey % 3)*0.5 AS DOUBLE) AS x", "CAST((20 + 36*floor(s_suppkey/10.0) - 80)/2.0 - (s_suppkey % 4)*0.5 AS DOUBLE) AS y"], "s_suppkey < 100"),
}


def _expr(text: str, spark: bool) -> str:
    import re

    return re.sub(r"\{(\d+)\}", lambda m: str(int(m[1]) - 1) if spark else m[1], text).replace("STRING", "STRING" if spark else "VARCHAR")


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def _view(self, name: str) -> DataFrame:
        source, columns, where = _VIEWS[name]
        df = table(self.spark, self.sf_dir, source)
        return (df.where(where) if where else df).selectExpr(*[_expr(c, True) for c in columns])

    @property
    def pixels(self) -> DataFrame:
        return self._view("fx_pixels")

    @property
    def dem(self) -> DataFrame:
        return self._view("fx_dem")

    @property
    def doors(self) -> DataFrame:
        return self._view("fx_doors")

    @property
    def footprints(self) -> DataFrame:
        return self._view("fx_footprints")

    @property
    def sheet(self) -> DataFrame:
        return self._view("fx_sheet")

    @property
    def labels(self) -> DataFrame:
        return self._view("fx_labels")

    def _pairs(self, step: int) -> DataFrame:
        a, b = self.doors.select("door_id", "x", "y"), self.doors.select((F.col("door_id") - step).alias("door_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return a.join(b, "door_id").select(F.col("door_id").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")

    @property
    def lines(self) -> DataFrame:
        return self._pairs(1)

    @property
    def skeleton(self) -> DataFrame:
        return self._pairs(7).where("line_id % 5 = 0")


def oracle(*parts: str) -> str:
    """SQL over the stand-ins: the last part is the query, those before it are further common tables."""
    views = [f"{n} AS (SELECT {', '.join(_expr(c, False) for c in cols)} FROM {src}{f' WHERE {w}' if w else ''})" for n, (src, cols, w) in _VIEWS.items()]
    line = "SELECT a.door_id AS line_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_doors a JOIN fx_doors b ON b.door_id = a.door_id + "
    views += [f"fx_lines AS ({line}1)", f"fx_skeleton AS ({line}7 WHERE a.door_id % 5 = 0)"]
    return f"WITH RECURSIVE {', '.join([*views, *parts[:-1]])} {parts[-1]}"

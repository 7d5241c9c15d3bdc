"""Joins by distance and by line of sight. Space is cut into square cells; only rows of like cells meet, and exact tests follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_span, distance, edges_of, ring_spans, segment_distance
from ..functions.scalars import num


def cell(x: Column, size: float) -> Column:
    return F.floor(x / num(size)).cast("long")


def near_pairs(points: DataFrame, key: str, radius: float, keep: list[str] | None = None) -> DataFrame:
    """Pairs a < b of points(key, x, y) within radius: a, b, dist and, for the columns of keep, a_<c> and b_<c>.

    One side stands in its cell, the other in its 3 x 3 neighbourhood of cells of the radius' size.
    """
    keep = keep or []
    side = lambda p: points.select(F.col(key).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", *keep)])
    a = side("a").withColumns({"_i": cell(F.col("a_x"), radius), "_j": cell(F.col("a_y"), radius)})
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    b = side("b").withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps))
    b = b.withColumns({"_i": cell(F.col("b_x"), radius) + F.col("_di"), "_j": cell(F.col("b_y"), radius) + F.col("_dj")}).drop("_di", "_dj")
    dist = distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    met = a.join(b, ["_i", "_j"]).where(F.col("a") < F.col("b")).withColumn("dist", dist).where(F.col("dist") <= radius)
    return met.drop("_i", "_j")


def boxes(footprints: DataFrame) -> DataFrame:
    """shp_idx with xmin, ymin, xmax, ymax from centres and half sizes."""
    return footprints.select("shp_idx", (F.col("cx") - F.col("hw")).alias("xmin"), (F.col("cy") - F.col("hh")).alias("ymin"), (F.col("cx") + F.col("hw")).alias("xmax"), (F.col("cy") + F.col("hh")).alias("ymax"))


def _spread(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float, grow: float = 0.0) -> DataFrame:
    """df with a row for each cell that its box, grown on all sides, touches."""
    span = lambda lo, hi: F.sequence(cell(lo - num(grow), size), cell(hi + num(grow), size))
    df = df.withColumn("_i", F.explode(span(F.least(x1, x2), F.greatest(x1, x2))))
    return df.withColumn("_j", F.explode(span(F.least(y1, y2), F.greatest(y1, y2))))


def box_meetings(segments: DataFrame, key: list[str], footprints: DataFrame, size: float = 50.0) -> DataFrame:
    """(key, shp_idx, t0, t1): the shares of each segment(x1, y1, x2, y2) inside each building it enters."""
    c = F.col
    s = _spread(segments.select(*key, "x1", "y1", "x2", "y2"), c("x1"), c("y1"), c("x2"), c("y2"), size)
    b = _spread(boxes(footprints), c("xmin"), c("ymin"), c("xmax"), c("ymax"), size)
    t0, t1 = box_span((c("x1"), c("y1"), c("x2"), c("y2")), (c("xmin"), c("ymin"), c("xmax"), c("ymax")))
    met = s.join(b, ["_i", "_j"]).withColumns({"t0": t0, "t1": t1}).where("t0 < t1")
    return met.select(*key, "shp_idx", "t0", "t1").dropDuplicates([*key, "shp_idx"])


def ring_bounds(polygons: DataFrame) -> DataFrame:
    """polygons(shp_idx, ring) with xmin, ymin, xmax and ymax."""
    part = lambda k: F.transform("ring", lambda p: p[k])
    return polygons.withColumns({"xmin": F.array_min(part("x")), "ymin": F.array_min(part("y")), "xmax": F.array_max(part("x")), "ymax": F.array_max(part("y"))})


def ring_meetings(segments: DataFrame, key: list[str], polygons: DataFrame, size: float = 50.0) -> DataFrame:
    """(key, shp_idx, t0, t1): the stretches of each segment(x1, y1, x2, y2) inside polygons(shp_idx, ring) of any shape.

    A pair meets once, in the cell where both their boxes' lower left corners have been passed.
    """
    c = F.col
    s = _spread(segments.select(*key, "x1", "y1", "x2", "y2"), c("x1"), c("y1"), c("x2"), c("y2"), size)
    b = ring_bounds(polygons.select("shp_idx", "ring")).withColumn("_edges", edges_of(c("ring"))).drop("ring")
    b = _spread(b, c("xmin"), c("ymin"), c("xmax"), c("ymax"), size)
    first = (c("_i") == cell(F.greatest(F.least("x1", "x2"), "xmin"), size)) & (c("_j") == cell(F.greatest(F.least("y1", "y2"), "ymin"), size))
    met = s.join(b, ["_i", "_j"]).where(first)
    met = met.select(*key, "shp_idx", F.explode(ring_spans((c("x1"), c("y1"), c("x2"), c("y2")), c("_edges"))).alias("_s"))
    return met.select(*key, "shp_idx", "_s.t0", "_s.t1")


def meetings(segments: DataFrame, key: list[str], footprints: DataFrame, size: float = 50.0) -> DataFrame:
    """ring_meetings of footprints with a ring, box_meetings of those with centres and half sizes."""
    return (ring_meetings if "ring" in footprints.columns else box_meetings)(segments, key, footprints, size)


def visible(segments: DataFrame, key: list[str], footprints: DataFrame, size: float = 50.0) -> DataFrame:
    """Segments that enter no building, a box or a ring; walls and corners may be touched."""
    return segments.join(meetings(segments, key, footprints, size).select(*key).distinct(), key, "left_anti")


def covered_length(segments: DataFrame, key: list[str], footprints: DataFrame, size: float = 50.0) -> DataFrame:
    """Segments with crosses and the length within the union of buildings; overlapping stretches count once."""
    spans = meetings(segments, key, footprints, size).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("_s"))
    zero = F.struct(num(0).alias("end"), num(0).alias("sum"))
    merge = lambda acc, s: F.struct(F.greatest(acc["end"], s["t1"]).alias("end"), (acc["sum"] + F.greatest(num(0), s["t1"] - F.greatest(acc["end"], s["t0"]))).alias("sum"))
    spans = spans.withColumn("_share", F.aggregate("_s", zero, merge, lambda acc: acc["sum"])).drop("_s")
    length = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return segments.join(spans, key, "left").withColumns({"crosses": F.col("_share").isNotNull(), "inside_len": F.coalesce(F.col("_share"), num(0)) * length}).drop("_share")


def segment_pairs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, radius: float, size: float = 50.0) -> DataFrame:
    """(a_key, b_key, dist) of segments within radius of one another."""
    c = F.col
    left = _spread(a.select(c(a_key).alias("_a"), *[c(k).alias(f"a_{k}") for k in ("x1", "y1", "x2", "y2")]), c("a_x1"), c("a_y1"), c("a_x2"), c("a_y2"), size, radius)
    right = _spread(b.select(c(b_key).alias("_b"), *[c(k).alias(f"b_{k}") for k in ("x1", "y1", "x2", "y2")]), c("b_x1"), c("b_y1"), c("b_x2"), c("b_y2"), size)
    dist = segment_distance(tuple(c(f"a_{k}") for k in ("x1", "y1", "x2", "y2")), tuple(c(f"b_{k}") for k in ("x1", "y1", "x2", "y2")))
    met = left.join(right, ["_i", "_j"]).withColumn("dist", dist).where(c("dist") <= radius)
    return met.select(c("_a").alias(a_key), c("_b").alias(b_key), "dist").dropDuplicates([a_key, b_key])


def range_pairs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, radius: float) -> DataFrame:
    """(a_key, b_key, dist) of points(x, y) of two tables that are less than radius apart."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    left = a.select(F.col(a_key).alias("_a"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumns({"_i": cell(F.col("ax"), radius), "_j": cell(F.col("ay"), radius)})
    right = b.select(F.col(b_key).alias("_b"), F.col("x").alias("bx"), F.col("y").alias("by")).withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps))
    right = right.withColumns({"_i": cell(F.col("bx"), radius) + F.col("_di"), "_j": cell(F.col("by"), radius) + F.col("_dj")})
    met = left.join(right, ["_i", "_j"]).withColumn("dist", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("dist") < radius)
    return met.select(F.col("_a").alias(a_key), F.col("_b").alias(b_key), "dist")

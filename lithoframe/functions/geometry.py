"""Plane geometry as columns: points are pairs of columns, rings and lines are arrays of struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import num


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(point(x1, y1), point(x2, y2))


def box_ring(cx: Column, cy: Column, hw: Column, hh: Column) -> Column:
    """A closed axis-parallel ring, counter-clockwise from the lower left."""
    return F.array(point(cx - hw, cy - hh), point(cx + hw, cy - hh), point(cx + hw, cy + hh), point(cx - hw, cy + hh), point(cx - hw, cy - hh))


def edges_of(points: Column) -> Column:
    """array<struct<i, x1, y1, x2, y2>> of consecutive vertices."""
    return F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.zip_with(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), lambda q, i: F.struct(q.alias("q"), i.alias("i"))),
        lambda p, q: F.struct(q["i"].alias("i"), p["x"].alias("x1"), p["y"].alias("y1"), q["q"]["x"].alias("x2"), q["q"]["y"].alias("y2")),
    )


def total(items: Column, value) -> Column:
    return F.aggregate(items, num(0), lambda s, e: s + value(e))


def length(points: Column) -> Column:
    return total(edges_of(points), lambda e: distance(e["x1"], e["y1"], e["x2"], e["y2"]))


def ring_area(ring: Column) -> Column:
    """Signed; positive counter-clockwise."""
    return total(edges_of(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / num(2)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """By area; NULL for a ring without area."""
    six = F.nullif(ring_area(ring) * num(6), num(0))
    part = lambda a, b: total(edges_of(ring), lambda e: (e[a] + e[b]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / six
    return part("x1", "x2"), part("y1", "y2")


def line_centroid(points: Column) -> tuple[Column, Column]:
    """By length."""
    whole = F.nullif(length(points), num(0))
    part = lambda a, b: total(edges_of(points), lambda e: (e[a] + e[b]) / num(2) * distance(e["x1"], e["y1"], e["x2"], e["y2"])) / whole
    return part("x1", "x2"), part("y1", "y2")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; points on the boundary fall to the lower and left sides."""
    return in_edges(x, y, edges_of(ring))


def in_edges(x: Column, y: Column, edges: Column) -> Column:
    """As in_ring, from the ring's edges."""
    crosses = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], num(0)) * (e["x2"] - e["x1"])))
    return F.size(crosses) % 2 == 1


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of the segment at which the point's nearest point stands, 0..1; 0 for a segment without length."""
    square = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.when(square > 0, F.greatest(num(0), F.least(num(1), ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / F.nullif(square, num(0))))).otherwise(num(0))


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = along(px, py, x1, y1, x2, y2)
    return distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def crossing(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """Whether two segments meet in one point (parallel ones don't), and the point."""
    x1, y1, x2, y2 = a
    x3, y3, x4, y4 = b
    d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    safe = F.nullif(d, num(0))
    t, u = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / safe, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / safe
    met = F.coalesce((d != 0) & t.between(0, 1) & u.between(0, 1), F.lit(False))
    return met, x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def segment_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    x1, y1, x2, y2 = a
    x3, y3, x4, y4 = b
    ends = F.least(point_segment(x1, y1, *b), point_segment(x2, y2, *b), point_segment(x3, y3, *a), point_segment(x4, y4, *a))
    return F.when(crossing(a, b)[0], num(0)).otherwise(ends)


def box_span(seg: tuple[Column, ...], box: tuple[Column, ...]) -> tuple[Column, Column]:
    """Shares [t0, t1] of a segment within an open box (xmin, ymin, xmax, ymax); t0 >= t1 if it stays outside.

    A segment along a wall doesn't enter: the limits of a parallel direction are strict.
    """
    x1, y1, x2, y2 = seg
    xmin, ymin, xmax, ymax = box

    def axis(p, q, lo, hi):
        d = F.nullif(q - p, num(0))
        near, far = F.least((lo - p) / d, (hi - p) / d), F.greatest((lo - p) / d, (hi - p) / d)
        inside = (p > lo) & (p < hi)
        return F.when(q != p, near).when(inside, num(0)).otherwise(num(1)), F.when(q != p, far).when(inside, num(1)).otherwise(num(0))

    xs, ys = axis(x1, x2, xmin, xmax), axis(y1, y2, ymin, ymax)
    return F.greatest(num(0), xs[0], ys[0]), F.least(num(1), xs[1], ys[1])


def within(x: Column, y: Column, edges: Column, tol: float = 1e-9) -> Column:
    """Whether a point is inside a ring, given by its edges, and not on one."""
    return in_edges(x, y, edges) & ~F.exists(edges, lambda e: point_segment(x, y, e["x1"], e["y1"], e["x2"], e["y2"]) < tol)


def ring_spans(seg: tuple[Column, ...], edges: Column, tol: float = 1e-9) -> Column:
    """array<struct<t0, t1>>: shares of a segment inside an open ring of any shape, given by its edges.

    The segment is cut where it meets edges, and a stretch counts if its middle is inside and no edge runs along it.
    """
    x1, y1, x2, y2 = seg

    def meeting(e):
        d = (x2 - x1) * (e["y2"] - e["y1"]) - (y2 - y1) * (e["x2"] - e["x1"])
        safe = F.nullif(d, num(0))
        t = ((e["x1"] - x1) * (e["y2"] - e["y1"]) - (e["y1"] - y1) * (e["x2"] - e["x1"])) / safe
        u = ((e["x1"] - x1) * (y2 - y1) - (e["y1"] - y1) * (x2 - x1)) / safe
        return F.when(u.between(-tol, 1 + tol) & (t > 0) & (t < 1), t)

    met = F.filter(F.transform(edges, meeting), lambda t: t.isNotNull())
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(num(0), num(1)), met)))
    spans = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))

    def inside(s):
        t = (s["t0"] + s["t1"]) / num(2)
        return (s["t1"] - s["t0"] > tol) & within(x1 + t * (x2 - x1), y1 + t * (y2 - y1), edges, tol)

    return F.filter(spans, inside)


def best_wall(ring: Column, code: Column) -> Column:
    """struct<score, idx, mx, my, nx, ny, edge_len> of the ring's edge whose midpoint lies most in the direction of code from the centroid.

    The first edge wins a tie, midpoints at the centroid don't count, and an unknown code means south.
    """
    cx, cy = ring_centroid(ring)
    dx = F.when(code == "E", num(1)).when(code == "W", num(-1)).otherwise(num(0))
    dy = F.when(code == "N", num(1)).when(code.isin("E", "W"), num(0)).otherwise(num(-1))

    def scored(e):
        mx, my = (e["x1"] + e["x2"]) / num(2), (e["y1"] + e["y2"]) / num(2)
        far = distance(mx, my, cx, cy)
        nx, ny = (mx - cx) / F.nullif(far, num(0)), (my - cy) / F.nullif(far, num(0))
        return F.struct(F.when(far >= 1e-9, nx * dx + ny * dy).alias("score"), (-e["i"]).alias("idx"), mx.alias("mx"), my.alias("my"), nx.alias("nx"), ny.alias("ny"), distance(e["x1"], e["y1"], e["x2"], e["y2"]).alias("edge_len"))

    return F.array_max(F.filter(F.transform(edges_of(ring), scored), lambda s: s["score"].isNotNull()))


def principal_axis(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column]:
    """Unit vector of the largest spread from variances and covariance; x >= 0, and y > 0 where x is 0."""
    angle = F.atan2(num(2) * sxy, sxx - syy) / num(2)
    x, y = F.cos(angle), F.sin(angle)
    flip = F.when((F.abs(x) < 1e-12) & (y < 0), num(-1)).when((x < 0) & (F.abs(x) >= 1e-12), num(-1)).otherwise(num(1))
    return x * flip, y * flip

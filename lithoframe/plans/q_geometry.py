"""Queries on shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import crs
from ..functions import geometry as G
from ..functions.scalars import num, r6
from ..operators import hull as H
from ..operators import raster as R
from ..operators import spatial_join as J
from .q_attributes import attributed
from .q_network import BOX, PAIRS, span
from .registry import query

c = F.col
SEG = ("x1", "y1", "x2", "y2")


def rings(fx):
    return fx.footprints.withColumn("ring", G.box_ring(c("cx"), c("cy"), c("hw"), c("hh")))


@query("geometry_measures", "SELECT shp_idx, round(cx,6)+0 AS x, round(cy,6)+0 AS y, round(4*(hw+hh),6)+0 AS perimeter, round(4*hw*hh,6)+0 AS area FROM fx_footprints")
def geometry_measures(fx):
    x, y = G.ring_centroid(c("ring"))
    return rings(fx).select("shp_idx", r6(x).alias("x"), r6(y).alias("y"), r6(G.length(c("ring"))).alias("perimeter"), r6(G.ring_area(c("ring"))).alias("area"))


@query("line_measures", "SELECT line_id, round(sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)),6)+0 AS length, round((x1+x2)/2,6)+0 AS x, round((y1+y2)/2,6)+0 AS y FROM fx_lines")
def line_measures(fx):
    line = G.segment(*[c(k) for k in SEG])
    x, y = G.line_centroid(line)
    return fx.lines.select("line_id", r6(G.length(line)).alias("length"), r6(x).alias("x"), r6(y).alias("y"))


@query("layer_bounds", "SELECT round(min(cx-hw),6)+0 AS xmin, round(min(cy-hh),6)+0 AS ymin, round(max(cx+hw),6)+0 AS xmax, round(max(cy+hh),6)+0 AS ymax FROM fx_footprints")
def layer_bounds(fx):
    v = rings(fx).select(F.explode("ring").alias("p"))
    return v.agg(r6(F.min("p.x")).alias("xmin"), r6(F.min("p.y")).alias("ymin"), r6(F.max("p.x")).alias("xmax"), r6(F.max("p.y")).alias("ymax"))


_WALLS = "walls AS (SELECT shp_idx, d AS direction, cx + CASE d WHEN 'E' THEN hw WHEN 'W' THEN -hw ELSE 0 END AS mx, cy + CASE d WHEN 'N' THEN hh WHEN 'E' THEN 0 WHEN 'W' THEN 0 ELSE -hh END AS my, CASE d WHEN 'E' THEN 1.0 WHEN 'W' THEN -1.0 ELSE 0.0 END::DOUBLE AS nx, CASE d WHEN 'N' THEN 1.0 WHEN 'E' THEN 0.0 WHEN 'W' THEN 0.0 ELSE -1.0 END::DOUBLE AS ny, CASE WHEN d IN ('E','W') THEN 2*hh ELSE 2*hw END AS edge_len FROM fx_footprints, (VALUES ('N'),('S'),('E'),('W'),('?')) v(d))"
_WALL_COLS = ", ".join(f"round({k},6)+0 AS {k}" for k in ("mx", "my", "nx", "ny", "edge_len"))


@query("best_wall", _WALLS, f"SELECT shp_idx, direction, {_WALL_COLS} FROM walls")
def best_wall(fx):
    df = rings(fx).withColumn("direction", F.explode(F.array(*[F.lit(d) for d in "NSEW?"]))).withColumn("w", G.best_wall(c("ring"), c("direction")))
    return df.select("shp_idx", "direction", *[r6(c(f"w.{k}")).alias(k) for k in ("mx", "my", "nx", "ny", "edge_len")])


def doors_of(df):
    """Doors of footprints(ring, direction array): the wall's middle, moved out, and a segment along the wall."""
    df = df.withColumn("code", F.explode("direction")).withColumn("w", G.best_wall(c("ring"), c("code")))
    half = F.least(num(C.DOOR_HALF_WIDTH), c("w.edge_len") / num(3))
    w = lambda k: c(f"w.{k}")
    return df.select(
        "shp_idx", "chapel_id", c("code").alias("direction"), (w("mx") + w("nx") * num(C.DOOR_OFFSET)).alias("x"), (w("my") + w("ny") * num(C.DOOR_OFFSET)).alias("y"),
        (w("mx") - w("ny") * half).alias("x1"), (w("my") + w("nx") * half).alias("y1"), (w("mx") + w("ny") * half).alias("x2"), (w("my") - w("nx") * half).alias("y2"),
        w("nx").alias("nx"), w("ny").alias("ny"), w("edge_len").alias("edge_len_m"), F.lit("direction_attributed").alias("source"), num(0.85).alias("confidence"),
    )


_FOUR = "four AS (SELECT w.*, least(1.0::DOUBLE, edge_len/3) AS half FROM walls w WHERE direction <> '?' AND (ascii(direction) + shp_idx) % 2 = 0)"


@query("place_doors", _WALLS, _FOUR, "SELECT shp_idx, direction, round(mx+nx*0.5,6)+0 AS x, round(my+ny*0.5,6)+0 AS y, round(mx-ny*half,6)+0 AS x1, round(my+nx*half,6)+0 AS y1, round(mx+ny*half,6)+0 AS x2, round(my-nx*half,6)+0 AS y2, round(edge_len,6)+0 AS edge_len_m, 'direction_attributed' AS source, 0.85::DOUBLE AS confidence FROM four")
def place_doors(fx):
    codes = F.filter(F.array(*[F.lit(d) for d in "NSEW"]), lambda d: (F.ascii(d) + c("shp_idx")) % 2 == 0)
    df = doors_of(rings(fx).withColumn("direction", codes).withColumn("chapel_id", F.lit(None).cast("string")))
    return df.select("shp_idx", "direction", *[r6(c(k)).alias(k) for k in ("x", "y", *SEG, "edge_len_m")], "source", "confidence")


@query("door_projection", "SELECT d.door_id, round(d.x + 3.5*(d.x-f.cx)/sqrt((d.x-f.cx)*(d.x-f.cx)+(d.y-f.cy)*(d.y-f.cy)),6)+0 AS x, round(d.y + 3.5*(d.y-f.cy)/sqrt((d.x-f.cx)*(d.x-f.cx)+(d.y-f.cy)*(d.y-f.cy)),6)+0 AS y FROM fx_doors d JOIN fx_footprints f ON f.shp_idx = d.door_id")
def door_projection(fx):
    """Doors moved outward from their footprint's centre by the road's offset."""
    df = fx.doors.join(fx.footprints, c("door_id") == c("shp_idx"))
    far = G.distance(c("x"), c("y"), c("cx"), c("cy"))
    out = lambda a, b: a + num(C.ROAD_OFFSET) * (a - b) / F.nullif(far, num(0))
    return df.select("door_id", r6(out(c("x"), c("cx"))).alias("x"), r6(out(c("y"), c("cy"))).alias("y"))


_FIT = "fit AS (SELECT ((max(f.cx)-min(f.cx))/(SELECT max(x)-min(x) FROM fx_labels) + (max(f.cy)-min(f.cy))/(SELECT max(y)-min(y) FROM fx_labels))/2 AS s, avg(f.cx) AS px, avg(f.cy) AS py FROM fx_footprints f)"
_MOVED = "moved AS (SELECT label, s*x + px - s*(SELECT avg(x) FROM fx_labels) AS x, s*y + py - s*(SELECT avg(y) FROM fx_labels) AS y FROM fx_labels, fit)"


def _centres(fx):
    return fx.footprints.select("shp_idx", c("cx").alias("x"), c("cy").alias("y"))


@query("affine_fit", _FIT, "SELECT round(s,6)+0 AS scale, round(px - s*(SELECT avg(x) FROM fx_labels),6)+0 AS dx, round(py - s*(SELECT avg(y) FROM fx_labels),6)+0 AS dy FROM fit")
def affine_fit(fx):
    return H.affine_fit(fx.labels, _centres(fx)).select(*[r6(c(k)).alias(k) for k in ("scale", "dx", "dy")])


@query("affine_apply", _FIT, _MOVED, "SELECT label, round(x,6)+0 AS x, round(y,6)+0 AS y FROM moved")
def affine_apply(fx):
    return H.apply_affine(fx.labels, H.affine_fit(fx.labels, _centres(fx))).select("label", r6(c("x")).alias("x"), r6(c("y")).alias("y"))


@query("label_candidates", _FIT, _MOVED, "SELECT label, shp_idx, round(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)),6)+0 AS dist FROM moved, fx_footprints WHERE sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) < 120")
def label_candidates(fx):
    moved = H.apply_affine(fx.labels, H.affine_fit(fx.labels, _centres(fx)))
    return J.range_pairs(moved, "label", _centres(fx), "shp_idx", C.MATCH_RADIUS).select("label", "shp_idx", r6(c("dist")).alias("dist"))


@query("label_assignment")
def label_assignment(fx):
    moved = H.apply_affine(fx.labels, H.affine_fit(fx.labels, _centres(fx)))
    return H.assign(moved, "label", _centres(fx), "shp_idx").select("label", "shp_idx", F.bround("dist", 3).alias("dist_m"))


_TT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((d.x-l.x1)*(l.x2-l.x1)+(d.y-l.y1)*(l.y2-l.y1))/nullif((l.x2-l.x1)*(l.x2-l.x1)+(l.y2-l.y1)*(l.y2-l.y1),0)))"
_PS = "ps AS (SELECT d.door_id, l.line_id, t, x1+t*(x2-x1) AS px, y1+t*(y2-y1) AS py, sqrt((d.x-(x1+t*(x2-x1)))*(d.x-(x1+t*(x2-x1)))+(d.y-(y1+t*(y2-y1)))*(d.y-(y1+t*(y2-y1)))) AS dist FROM fx_doors d, (SELECT l.*, d.door_id AS dd, " + _TT + " AS t FROM fx_lines l, fx_doors d) l WHERE l.dd = d.door_id AND l.line_id % 10 = 0)"


@query("nearest_on_segment", _PS, "SELECT door_id, line_id, round(t,6)+0 AS t, round(px,6)+0 AS px, round(py,6)+0 AS py, round(dist,6)+0 AS dist FROM ps WHERE dist > 0.1 AND dist < 12")
def nearest_on_segment(fx):
    """Door-to-line connectors: nearest points of lines that are over 0.1 and under 12 m away."""
    d = fx.doors.select("door_id", "x", "y").withColumns({"x1": c("x"), "y1": c("y"), "x2": c("x"), "y2": c("y")})
    near = J.segment_pairs(d, "door_id", fx.lines.where("line_id % 10 = 0"), "line_id", C.CONNECT_MAX)
    df = near.join(fx.doors.select("door_id", "x", "y"), "door_id").join(fx.lines, "line_id").where("dist > 0.1 and dist < 12")
    t = G.along(c("x"), c("y"), *[c(k) for k in SEG])
    return df.select("door_id", "line_id", r6(t).alias("t"), r6(c("x1") + t * (c("x2") - c("x1"))).alias("px"), r6(c("y1") + t * (c("y2") - c("y1"))).alias("py"), r6(c("dist")).alias("dist"))


_DEN = "((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1))"
_CX = f"cx_ AS (SELECT a.line_id AS a, b.line_id AS b, ((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))/nullif({_DEN},0) AS t, ((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))/nullif({_DEN},0) AS u, a.x1, a.y1, a.x2, a.y2 FROM fx_lines a JOIN fx_lines b ON a.line_id + 1 < b.line_id AND a.line_id % 4 = 0 AND b.line_id % 4 = 0)"


@query("segment_cross_point", _CX, "SELECT a, b, round(x1+t*(x2-x1),5)+0 AS x, round(y1+t*(y2-y1),5)+0 AS y FROM cx_ WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
def segment_cross_point(fx):
    lines = fx.lines.where("line_id % 4 = 0")
    near = J.segment_pairs(lines.withColumnRenamed("line_id", "a"), "a", lines.withColumnRenamed("line_id", "b"), "b", 1e-9).where("a + 1 < b").select("a", "b")
    side = lambda p: fx.lines.select(c("line_id").alias(p), *[c(k).alias(f"{p}_{k}") for k in SEG])
    df = near.join(side("a"), "a").join(side("b"), "b")
    met, x, y = G.crossing(tuple(c(f"a_{k}") for k in SEG), tuple(c(f"b_{k}") for k in SEG))
    return df.where(met).select("a", "b", r6(x, 5).alias("x"), r6(y, 5).alias("y"))


_L0, _L1 = span("l.x1", "l.y1", "l.x2", "l.y2")
_CLIP = f"clip AS (SELECT line_id, {_L0} AS t0, {_L1} AS t1 FROM fx_lines l, bx)"


@query("union_clip_length", BOX, _CLIP, "s AS (SELECT line_id, sum(t1-t0) AS share FROM clip WHERE t0 < t1 GROUP BY line_id)", "SELECT line_id, share IS NOT NULL AS crosses, round(coalesce(share,0)*sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)),5)+0 AS inside_len FROM fx_lines LEFT JOIN s USING (line_id)")
def union_clip_length(fx):
    return J.covered_length(fx.lines, ["line_id"], fx.footprints).select("line_id", "crosses", r6(c("inside_len"), 5).alias("inside_len"))


def diamonds(fx):
    """Footprints turned by a quarter: rings whose sides follow no axis."""
    ends = [G.point(c("cx") + num(i) * c("hw"), c("cy") + num(j) * c("hh")) for i, j in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]
    return fx.footprints.select("shp_idx", F.array(*ends).alias("ring"))


def _in_diamonds(src: str, key: str) -> str:
    """Shares of segments inside the diamonds, from the four half-planes that bound each."""
    side = f"dsd AS (SELECT {key}, shp_idx, i*(x1-cx)/hw + j*(y1-cy)/hh - 1 AS p, i*(x2-x1)/hw + j*(y2-y1)/hh AS q FROM {src}, fx_footprints, (VALUES (1),(-1)) u(i), (VALUES (1),(-1)) v(j))"
    return f"{side}, dia AS (SELECT {key}, shp_idx, greatest(0.0::DOUBLE, max(-p/q) FILTER (q < 0)) AS t0, least(1.0::DOUBLE, min(-p/q) FILTER (q > 0)) AS t1 FROM dsd GROUP BY {key}, shp_idx HAVING count(*) FILTER (q = 0 AND p >= 0) = 0), din AS (SELECT * FROM dia WHERE t1 - t0 > 1e-9)"


@query("ring_sight_edges", PAIRS, "nrp AS (SELECT a, b, ax AS x1, ay AS y1, bx AS x2, by_ AS y2, dist FROM prs WHERE dist <= 50)", _in_diamonds("nrp", "a, b"), "SELECT a, b, round(dist,6)+0 AS dist FROM nrp WHERE NOT EXISTS (SELECT 1 FROM din WHERE din.a = nrp.a AND din.b = nrp.b)")
def ring_sight_edges(fx):
    """Lines of sight between polygons that are no boxes."""
    e = J.near_pairs(fx.doors, "door_id", C.R_MAX).withColumns({"x1": c("a_x"), "y1": c("a_y"), "x2": c("b_x"), "y2": c("b_y")})
    return J.visible(e, ["a", "b"], diamonds(fx)).select("a", "b", r6(c("dist")).alias("dist"))


@query("ring_clip_length", _in_diamonds("fx_lines", "line_id"), "s AS (SELECT line_id, sum(t1-t0) AS share FROM din GROUP BY line_id)", "SELECT line_id, share IS NOT NULL AS crosses, round(coalesce(share,0)*sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)),5)+0 AS inside_len FROM fx_lines LEFT JOIN s USING (line_id)")
def ring_clip_length(fx):
    """Length of lines within polygons that are no boxes."""
    return J.covered_length(fx.lines, ["line_id"], diamonds(fx)).select("line_id", "crosses", r6(c("inside_len"), 5).alias("inside_len"))


@query("ring_cells", "SELECT CAST(shp_idx AS BIGINT) AS shp_idx, CAST(row_id AS INT) AS row_id, CAST(col_id AS INT) AS col_id FROM (SELECT unnest(range(100)) AS row_id) r, (SELECT unnest(range(100)) AS col_id) q, fx_footprints WHERE abs((col_id+0.5)*4-cx)/hw + abs(400-(row_id+0.5)*4-cy)/hh < 1 - 1e-12")
def ring_cells(fx):
    """Cells whose centre is inside polygons that are no boxes."""
    return R.ring_cells(diamonds(fx))


def _sd() -> str:
    def ps(px, py, a):
        t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px}-{a}.x1)*({a}.x2-{a}.x1)+({py}-{a}.y1)*({a}.y2-{a}.y1))/nullif(({a}.x2-{a}.x1)*({a}.x2-{a}.x1)+({a}.y2-{a}.y1)*({a}.y2-{a}.y1),0)))"
        dx, dy = f"({px}-({a}.x1+{t}*({a}.x2-{a}.x1)))", f"({py}-({a}.y1+{t}*({a}.y2-{a}.y1)))"
        return f"sqrt({dx}*{dx}+{dy}*{dy})"

    t, u = f"((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))/nullif({_DEN},0)", f"((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))/nullif({_DEN},0)"
    return f"CASE WHEN {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 THEN 0.0::DOUBLE ELSE least({ps('a.x1', 'a.y1', 'b')},{ps('a.x2', 'a.y2', 'b')},{ps('b.x1', 'b.y1', 'a')},{ps('b.x2', 'b.y2', 'a')}) END"


SEGDIST = f"sd AS (SELECT a.line_id AS skel, b.line_id AS line, {_sd()} AS dist FROM fx_skeleton a, (SELECT * FROM fx_lines WHERE line_id % 10 = 3) b)"


def network_lines(fx):
    return fx.lines.where("line_id % 10 = 3")


@query("line_to_network_distance", SEGDIST, "SELECT skel, round(min(dist),5)+0 AS dist FROM sd GROUP BY skel")
def line_to_network_distance(fx):
    """Distance of each line to the whole network; the radius covers the site."""
    near = J.segment_pairs(fx.skeleton.withColumnRenamed("line_id", "skel"), "skel", network_lines(fx).withColumnRenamed("line_id", "line"), "line", 800.0, 200.0)
    return near.groupBy("skel").agg(r6(F.min("dist"), 5).alias("dist"))


@query("within_distance", SEGDIST, "SELECT line_id AS skel, coalesce(bool_or(dist <= 12), false) AS agrees FROM fx_skeleton LEFT JOIN sd ON sd.skel = line_id GROUP BY line_id")
def within_distance(fx):
    skel = fx.skeleton.withColumnRenamed("line_id", "skel")
    near = J.segment_pairs(skel, "skel", network_lines(fx).withColumnRenamed("line_id", "line"), "line", C.AGREE_DIST).select("skel").distinct().withColumn("agrees", F.lit(True))
    return skel.select("skel").join(near, "skel", "left").withColumn("agrees", F.coalesce("agrees", F.lit(False)))


@query("line_of_sight_lines", BOX, _CLIP, "SELECT line_id FROM fx_lines WHERE line_id NOT IN (SELECT line_id FROM clip WHERE t0 < t1)")
def line_of_sight_lines(fx):
    return J.visible(fx.lines, ["line_id"], fx.footprints).select("line_id")


@query("edge_barrier_samples", PAIRS, "e AS (SELECT * FROM prs WHERE dist <= 20), s AS (SELECT e.*, greatest(10, CAST(ceil(dist/0.2) AS BIGINT)) AS n FROM e)", "SELECT a, b, count(*) AS n, round(sum(ax+i*(bx-ax)/(n-1)),4)+0 AS sx FROM (SELECT s.*, unnest(range(n)) AS i FROM s) GROUP BY a, b")
def edge_barrier_samples(fx):
    from ..operators.raster import edge_samples

    e = J.near_pairs(fx.doors, "door_id", 20.0)
    return edge_samples(e).groupBy("a", "b").agg(F.count("*").alias("n"), r6(F.sum("x"), 4).alias("sx"))


@query("principal_axis", "g AS (SELECT door_id % 12 AS g, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x,y) AS sxy FROM fx_doors GROUP BY 1), t AS (SELECT g, atan2(2*sxy, sxx-syy)/2 AS th FROM g)", "SELECT g, round(abs(cos(th)),6)+0 AS ux, round(sin(th)*CASE WHEN cos(th) < 0 THEN -1 ELSE 1 END,6)+0 AS uy FROM t")
def principal_axis(fx):
    g = fx.doors.groupBy((c("door_id") % 12).alias("g")).agg(F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    ux, uy = G.principal_axis(c("sxx"), c("syy"), c("sxy"))
    return g.select("g", r6(ux).alias("ux"), r6(uy).alias("uy"))


@query("hull_mask")
def hull_mask(fx):
    """Doors' hull with its buffer, tested at the footprints' centres."""
    return H.in_buffered_hull(_centres(fx), H.convex_hull(fx.doors)).select("shp_idx", "in_hull")


@query("convex_hull")
def convex_hull(fx):
    return H.convex_hull(fx.doors)


@query("crs_roundtrip", "SELECT door_id, true AS closes FROM fx_doors")
def crs_roundtrip(fx):
    """Metres to degrees and back, within a micrometre."""
    e, n = num(254_000) + c("x"), num(2_821_000) + c("y")
    lon, lat = crs.inverse(e, n, 36)
    df = fx.doors.select("door_id", e.alias("e"), n.alias("n"), lon.alias("lon"), lat.alias("lat"))
    e2, n2 = crs.forward(c("lon"), c("lat"), 36)
    return df.select("door_id", (G.distance(c("e"), c("n"), e2, n2) < 1e-6).alias("closes"))


@query("footprint_lookup", "SELECT d.door_id, f.shp_idx, round(f.hw*f.hh,6)+0 AS quarter FROM fx_doors d LEFT JOIN fx_footprints f ON f.shp_idx = d.door_id % 130")
def footprint_lookup(fx):
    d = fx.doors.select("door_id", (c("door_id") % 130).alias("shp_idx"))
    return d.join(fx.footprints.withColumn("found", c("shp_idx")), "shp_idx", "left").select("door_id", c("found").alias("shp_idx"), r6(c("hw") * c("hh")).alias("quarter"))


@query("positional_pair", "SELECT a.line_id, round(a.x1-b.x1,6)+0 AS dx FROM fx_skeleton a JOIN fx_lines b USING (line_id)")
def positional_pair(fx):
    """Two geometries of one feature side by side, by key and not by row order."""
    return fx.skeleton.join(fx.lines.select("line_id", c("x1").alias("bx")), "line_id").select("line_id", r6(c("x1") - c("bx")).alias("dx"))


@query("preprocessing")
def preprocessing(fx):
    """Footprints attributed through the crosswalk, and their doors."""
    df = attributed(fx).withColumn("ring", G.box_ring(c("cx"), c("cy"), c("hw"), c("hh")))
    return doors_of(df.select("shp_idx", "chapel_id", "direction", "ring"))

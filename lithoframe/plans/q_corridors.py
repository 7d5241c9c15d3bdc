"""Queries on streets and hubs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import num, r6
from ..operators import corridors as S
from ..operators import graph as G
from .q_network import _EPS, _CC, _HUBS, BOX, CLUSTERS, PAIRS, span
from .registry import query

c = F.col
_P = "srt AS (SELECT door_id, door_id % 4 AS g, x AS p, row_number() OVER (PARTITION BY door_id % 4 ORDER BY x, door_id) AS rn FROM fx_doors)"
_WALK = "walk(g, rn, door_id, p, start, sub) AS (SELECT g, rn, door_id, p, p, 0::BIGINT FROM srt WHERE rn = 1 UNION ALL SELECT s.g, s.rn, s.door_id, s.p, CASE WHEN s.p - w.p > 12 OR s.p - w.start > 35 THEN s.p ELSE w.start END, w.sub + CASE WHEN s.p - w.p > 12 OR s.p - w.start > 35 THEN 1 ELSE 0 END FROM walk w JOIN srt s ON s.g = w.g AND s.rn = w.rn + 1)"


@query("corridor_runs", _P, _WALK, "SELECT door_id, g, sub FROM walk")
def corridor_runs(fx):
    """Greedy runs by gap and length along x within each direction's doors."""
    rows = fx.doors.select("door_id", (c("door_id") % 4).alias("g"), c("x").alias("p"))
    return S.split_runs(rows, ["g"], ["door_id"], "p").select("door_id", "g", "sub")


@query("axis_segments", _P, _WALK, "SELECT g, sub, count(*) AS n, round(CASE WHEN count(*) > 1 THEN min(p)-1 ELSE min(p)-2 END,6)+0 AS lo, round(CASE WHEN count(*) > 1 THEN max(p)+1 ELSE max(p)+2 END,6)+0 AS hi, round(avg(p),6)+0 AS mid FROM walk GROUP BY g, sub")
def axis_segments(fx):
    rows = fx.doors.select("door_id", (c("door_id") % 4).alias("g"), c("x").alias("p"))
    g = S.split_runs(rows, ["g"], ["door_id"], "p").groupBy("g", "sub").agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b"), F.avg("p").alias("m"))
    grow = F.when(c("n") > 1, num(1)).otherwise(num(2))
    return g.select("g", "sub", "n", r6(c("a") - grow).alias("lo"), r6(c("b") + grow).alias("hi"), r6(c("m")).alias("mid"))


@query("corridor_flags", _P, _WALK, "SELECT w.g, w.sub, bool_or(d.direction = 'N') AS north, bool_or(CAST(d.chapel_id AS INT) BETWEEN 116 AND 120) AS forced FROM walk w JOIN fx_doors d USING (door_id) GROUP BY w.g, w.sub")
def corridor_flags(fx):
    rows = fx.doors.select("door_id", (c("door_id") % 4).alias("g"), c("x").alias("p"), "direction", "chapel_id")
    return S.split_runs(rows, ["g"], ["door_id"], "p").groupBy("g", "sub").agg(F.bool_or(c("direction") == "N").alias("north"), F.bool_or(c("chapel_id").cast("int").between(116, 120)).alias("forced"))


@query("corridor_segments")
def corridor_segments(fx):
    return S.corridors(fx.doors)


@query("road_crossings")
def road_crossings(fx):
    return S.crossings(S.corridors(fx.doors))


@query("road_connectors")
def road_connectors(fx):
    return S.connectors(S.corridors(fx.doors)).withColumn("dist", F.bround("dist", 3))


@query("road_hubs")
def road_hubs(fx):
    return S.hubs(S.road_nodes(S.corridors(fx.doors))).withColumn("marker", F.least(num(350), num(60) + num(35) * c("weight")))


_SPOKE = "spk AS (SELECT 'door_' || d.door_id AS u, 'hub_' || h.cluster AS v, 'door_to_hub' AS edge_type, h.cluster, d.x AS x1, d.y AS y1, h.x AS x2, h.y AS y2 FROM fx_doors d JOIN clus USING (door_id) JOIN hubs h USING (cluster))"
_HP = "hp AS (SELECT a.cluster AS a, b.cluster AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM hubs a JOIN hubs b ON a.cluster < b.cluster)"
_HG = "hg AS (SELECT 'hub_' || a AS u, 'hub_' || b AS v, 'hub_to_hub' AS edge_type, NULL::BIGINT AS cluster, ax AS x1, ay AS y1, bx AS x2, by_ AS y2 FROM hp WHERE NOT EXISTS (SELECT 1 FROM hubs w WHERE w.cluster <> a AND w.cluster <> b AND sqrt((w.x-(ax+bx)/2)*(w.x-(ax+bx)/2)+(w.y-(ay+by_)/2)*(w.y-(ay+by_)/2)) < dist/2 - 1e-5::DOUBLE))"
_T0, _T1 = span("e.x1", "e.y1", "e.x2", "e.y2")
_ALL = f"alle AS (SELECT * FROM spk UNION ALL SELECT * FROM hg), cov AS (SELECT u, v, sum(t1-t0) AS share FROM (SELECT u, v, {_T0} AS t0, {_T1} AS t1 FROM alle e, bx) WHERE t0 < t1 GROUP BY u, v)"


@query("hub_edges", PAIRS, BOX, _EPS, _CC.format(e="eps"), CLUSTERS, _HUBS, _SPOKE, _HP, _HG, _ALL, "SELECT u, v, edge_type, cluster, round(sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)),5)+0 AS dist, share IS NOT NULL AS intersects_building, round(coalesce(share,0)*sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)),4)+0 AS intersection_len FROM alle LEFT JOIN cov USING (u, v)")
def hub_edges(fx):
    _, e = S.entrance_network(fx.doors, fx.footprints)
    return e.select("u", "v", "edge_type", "cluster", r6(c("dist"), 5).alias("dist"), c("crosses").alias("intersects_building"), r6(c("inside_len"), 4).alias("intersection_len"))


@query("entrance_hubs", PAIRS, _EPS, _CC.format(e="eps"), CLUSTERS, "SELECT cluster, count(*) AS size, string_agg(chapel_id, ', ' ORDER BY door_id) AS chapels FROM clus JOIN fx_doors USING (door_id) GROUP BY cluster")
def entrance_hubs(fx):
    h, _ = S.entrance_network(fx.doors, fx.footprints)
    return h.select("cluster", "size", "chapels")


@query("hub_membership", PAIRS, _EPS, _CC.format(e="eps"), CLUSTERS, "SELECT door_id, 'hub_' || cluster AS hub FROM clus")
def hub_membership(fx):
    return G.dbscan(fx.doors, "door_id", 12.0).select("door_id", F.format_string("hub_%d", "cluster").alias("hub"))

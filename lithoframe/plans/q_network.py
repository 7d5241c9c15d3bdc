"""Queries over doors and footprints as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalars import num, r6
from ..operators import graph as G
from ..operators.components import components, with_components
from ..operators.spatial_join import near_pairs
from .registry import query

_D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
PAIRS = f"prs AS (SELECT a.door_id AS a, b.door_id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, {_D} AS dist FROM fx_doors a JOIN fx_doors b ON a.door_id < b.door_id)"
BOX = "bx AS (SELECT shp_idx, cx-hw AS xmin, cy-hh AS ymin, cx+hw AS xmax, cy+hh AS ymax FROM fx_footprints)"


def span(x1: str, y1: str, x2: str, y2: str) -> tuple[str, str]:
    """Shares of a segment within a box, as SQL."""

    def axis(p: str, q: str, lo: str, hi: str) -> tuple[str, str]:
        f = f"(({lo})-({p}))/nullif(({q})-({p}),0)", f"(({hi})-({p}))/nullif(({q})-({p}),0)"
        inside = f"({p}) > {lo} AND ({p}) < {hi}"
        return f"CASE WHEN ({q}) <> ({p}) THEN least({f[0]},{f[1]}) WHEN {inside} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END", f"CASE WHEN ({q}) <> ({p}) THEN greatest({f[0]},{f[1]}) WHEN {inside} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

    x, y = axis(x1, x2, "xmin", "xmax"), axis(y1, y2, "ymin", "ymax")
    return f"greatest(0.0::DOUBLE, {x[0]}, {y[0]})", f"least(1.0::DOUBLE, {x[1]}, {y[1]})"


_T0, _T1 = span("ax", "ay", "bx", "by_")
EDGES = f"edges AS (SELECT * FROM prs WHERE dist <= 50 AND NOT EXISTS (SELECT 1 FROM bx b2 WHERE {_T0} < {_T1}))"


def edges_of(fx):
    return G.proximity_graph(fx.doors, fx.footprints)


def door_heights(fx):
    """Doors with the elevation of the cell they stand in; 4 m cells from the upper left corner of a 400 m site."""
    cells = fx.doors.withColumns({"row_id": F.floor((num(400) - F.col("y")) / num(4)).cast("int"), "col_id": F.floor(F.col("x") / num(4)).cast("int")})
    return cells.join(fx.dem, ["row_id", "col_id"], "left")


HEIGHTS = "heights AS (SELECT d.*, e.elev FROM fx_doors d LEFT JOIN fx_dem e ON e.row_id = CAST(floor((400-d.y)/4.0) AS INT) AND e.col_id = CAST(floor(d.x/4.0) AS INT))"


@query("proximity_edges", PAIRS, "SELECT a, b, round(dist,6)+0 AS dist FROM prs WHERE dist <= 50")
def proximity_edges(fx):
    return near_pairs(fx.doors, "door_id", 50.0).select("a", "b", r6(F.col("dist")).alias("dist"))


@query("line_of_sight_edges", PAIRS, BOX, EDGES, "SELECT a, b, round(dist,6)+0 AS dist FROM edges")
def line_of_sight_edges(fx):
    return edges_of(fx).select("a", "b", r6(F.col("dist")).alias("dist"))


@query("raster_point_sample", HEIGHTS, "SELECT door_id, round(elev,6)+0 AS elev FROM heights")
def raster_point_sample(fx):
    return door_heights(fx).select("door_id", r6(F.col("elev")).alias("elev"))


_SLOPE = "CASE WHEN dist > 0 THEN dh/dist ELSE 0 END"
FETE = f"fete AS (SELECT e.*, h.dh, CASE WHEN h.dh IS NOT NULL THEN dist/(6.0*exp(-3.5*abs({_SLOPE}+0.05))/3.6) ELSE dist/0.1 END AS w FROM edges e JOIN (SELECT e.a, e.b, abs(p.elev-q.elev) AS dh FROM edges e JOIN heights p ON p.door_id = e.a JOIN heights q ON q.door_id = e.b) h USING (a, b))"


def fete_of(fx):
    return G.with_walking_time(G.proximity_graph(door_heights(fx), fx.footprints, keep=["elev"]))


@query("fete_edges", PAIRS, BOX, EDGES, HEIGHTS, FETE, "SELECT a, b, round(dh,6)+0 AS dh, round(w,5)+0 AS w FROM fete")
def fete_edges(fx):
    return fete_of(fx).select("a", "b", r6(F.abs(F.col("a_elev") - F.col("b_elev"))).alias("dh"), r6(F.col("w"), 5).alias("w"))


@query("node_degree", PAIRS, BOX, EDGES, "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node")
def node_degree(fx):
    return G.degrees(edges_of(fx))


@query("topk_nodes", PAIRS, BOX, EDGES, "SELECT node, degree FROM (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node) ORDER BY degree DESC, node LIMIT 10")
def topk_nodes(fx):
    return G.degrees(edges_of(fx)).orderBy(F.desc("degree"), "node").limit(10)


@query("edge_attributes", PAIRS, BOX, EDGES, "SELECT e.a, e.b, p.chapel_id AS u_chapel, q.chapel_id AS v_chapel, round(dist,6)+0 AS dist FROM edges e JOIN fx_doors p ON p.door_id = e.a JOIN fx_doors q ON q.door_id = e.b")
def edge_attributes(fx):
    return G.proximity_graph(fx.doors, fx.footprints, keep=["chapel_id"]).select("a", "b", F.col("a_chapel_id").alias("u_chapel"), F.col("b_chapel_id").alias("v_chapel"), r6(F.col("dist")).alias("dist"))


@query("distance_matrix", PAIRS, "SELECT a, b, round(dist,6)+0 AS dist FROM prs")
def distance_matrix(fx):
    return G._pairs_to(fx.doors, "door_id", None)[0].select("a", "b", r6(F.col("dist")).alias("dist"))


_GAB = "gab AS (SELECT * FROM prs p WHERE NOT EXISTS (SELECT 1 FROM fx_doors w WHERE w.door_id <> a AND w.door_id <> b AND sqrt((w.x-(ax+bx)/2)*(w.x-(ax+bx)/2)+(w.y-(ay+by_)/2)*(w.y-(ay+by_)/2)) < dist/2 - 1e-9::DOUBLE))"


def gabriel_of(fx):
    return G.gabriel(fx.doors, "door_id")


@query("gabriel_edges", PAIRS, _GAB, "SELECT a, b, round(dist,6)+0 AS weight FROM gab")
def gabriel_edges(fx):
    return gabriel_of(fx).select("a", "b", r6(F.col("dist")).alias("weight"))


_IN = lambda p, q: f"sqrt((w.x-({p}))*(w.x-({p}))+(w.y-({q}))*(w.y-({q}))) < 0.75::DOUBLE*dist - 1e-9::DOUBLE"


@query("beta_edges", PAIRS, f"SELECT a, b, round(dist,6)+0 AS weight FROM prs WHERE NOT EXISTS (SELECT 1 FROM fx_doors w WHERE w.door_id <> a AND w.door_id <> b AND {_IN('0.25*ax+0.75*bx', '0.25*ay+0.75*by_')} AND {_IN('0.25*bx+0.75*ax', '0.25*by_+0.75*ay')})")
def beta_edges(fx):
    return G.beta_skeleton(fx.doors, "door_id").select("a", "b", r6(F.col("dist")).alias("weight"))


_CC = "lab AS (SELECT door_id AS node, door_id AS root FROM fx_doors UNION SELECT CASE WHEN lab.node = e.a THEN e.b ELSE e.a END, lab.root FROM lab JOIN {e} e ON (lab.node = e.a OR lab.node = e.b))"


@query("components", PAIRS, BOX, EDGES, _CC.format(e="edges"), "SELECT node AS door_id, min(root) AS comp FROM lab GROUP BY node")
def component_labels(fx):
    return with_components(fx.doors.select("door_id"), edges_of(fx).select("a", "b"), "door_id")


_EPS = "eps AS (SELECT a, b FROM prs WHERE dist <= 12)"
CLUSTERS = "clus AS (SELECT node AS door_id, dense_rank() OVER (ORDER BY min(root)) - 1 AS cluster FROM lab GROUP BY node)"


@query("dbscan_clusters", PAIRS, _EPS, _CC.format(e="eps"), CLUSTERS, "SELECT door_id, cluster FROM clus")
def dbscan_clusters(fx):
    return G.dbscan(fx.doors.select("door_id", "x", "y"), "door_id", 12.0).select("door_id", "cluster")


_HUBS = "hubs AS (SELECT cluster, avg(x) AS x, avg(y) AS y, count(*) AS size FROM clus JOIN fx_doors USING (door_id) GROUP BY cluster)"


@query("hubs", PAIRS, _EPS, _CC.format(e="eps"), CLUSTERS, _HUBS, "SELECT cluster, round(x,6)+0 AS x, round(y,6)+0 AS y, size FROM hubs")
def hubs(fx):
    found = G.dbscan(fx.doors.select("door_id", "x", "y"), "door_id", 12.0)
    return found.groupBy("cluster").agg(r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y"), F.count("*").alias("size"))


_SSSP = "sp(node, cost) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT n.node, n.cost FROM (SELECT e.v AS node, min(sp.cost + e.w) AS cost FROM sp JOIN {e} e ON e.u = sp.node GROUP BY e.v) n LEFT JOIN recurring.sp r ON r.node = n.node WHERE r.node IS NULL OR n.cost < r.cost)"
_BOTH = "both_ AS (SELECT a AS u, b AS v, dist AS w FROM edges UNION ALL SELECT b, a, dist FROM edges)"


@query("shortest_paths", PAIRS, BOX, EDGES, _BOTH, _SSSP.format(e="both_"), "SELECT node, round(min(cost),5)+0 AS cost FROM sp GROUP BY node")
def shortest_paths(fx):
    e = edges_of(fx).select("a", "b", F.col("dist").alias("w"))
    return G.shortest_paths(e, 0).select("node", r6(F.col("cost"), 5).alias("cost"))


@query("path_tree_edges")
def path_tree_edges(fx):
    return G.path_tree(G.shortest_paths(edges_of(fx).select("a", "b", F.col("dist").alias("w")), 0))


_HOP = "hop(s, node, d) USING KEY (s, node) AS (SELECT door_id, door_id, 0::BIGINT FROM fx_doors UNION SELECT n.s, n.node, n.d FROM (SELECT hop.s, e.v AS node, min(hop.d + 1) AS d FROM hop JOIN both_ e ON e.u = hop.node GROUP BY hop.s, e.v) n LEFT JOIN recurring.hop r ON r.s = n.s AND r.node = n.node WHERE r.node IS NULL OR n.d < r.d)"
_MD = "md AS (SELECT s AS node, count(*) AS reached, CAST(sum(d) AS BIGINT) AS total FROM hop GROUP BY s)"


@query("bfs_all", PAIRS, BOX, EDGES, _BOTH, _HOP, _MD, "SELECT node, reached, total FROM md WHERE reached > 1")
def bfs_all(fx):
    return G.hop_depths(edges_of(fx).select("a", "b"))


_INT = "itg AS (SELECT node, total/(reached-1)::DOUBLE AS depth, CASE WHEN total/(reached-1)::DOUBLE - 1 > 0 THEN 1/(total/(reached-1)::DOUBLE - 1) ELSE 0 END AS integration FROM md WHERE reached >= 3)"


@query("integration", PAIRS, BOX, EDGES, _BOTH, _HOP, _MD, _INT, "SELECT node, round(depth,6)+0 AS depth, round(integration,6)+0 AS integration FROM itg")
def integration(fx):
    return G.integration(edges_of(fx).select("a", "b")).select("node", r6(F.col("depth")).alias("depth"), r6(F.col("integration")).alias("integration"))


@query("axial_integration", PAIRS, BOX, EDGES, _BOTH, _HOP, _MD, _INT, "l AS (SELECT e.a, e.b, u.integration AS iu, v.integration AS iv, (u.integration+v.integration)/2 AS m FROM edges e JOIN itg u ON u.node = e.a JOIN itg v ON v.node = e.b)", "SELECT a, b, round(m,6)+0 AS integration_mean, round(m/(SELECT max(m) FROM l),6)+0 AS integration_mean_norm FROM l")
def axial_integration(fx):
    return G.edge_integration(edges_of(fx).select("a", "b")).select("a", "b", r6(F.col("integration_mean")).alias("integration_mean"), r6(F.col("integration_mean_norm")).alias("integration_mean_norm"))


_APSP = "ap(s, node, d) USING KEY (s, node) AS (SELECT door_id, door_id, CAST(0 AS DOUBLE) FROM fx_doors UNION SELECT n.s, n.node, n.d FROM (SELECT ap.s, e.v AS node, min(ap.d + e.w) AS d FROM ap JOIN both_ e ON e.u = ap.node GROUP BY ap.s, e.v) n LEFT JOIN recurring.ap r ON r.s = n.s AND r.node = n.node WHERE r.node IS NULL OR n.d < r.d - 1e-9)"
_NN = "nn AS (SELECT count(DISTINCT u) AS n FROM both_)"


@query("edge_betweenness", PAIRS, BOX, EDGES, _BOTH, _APSP, _NN, "SELECT a, b, round(sum(CASE WHEN abs(su.d + e.dist + tv.d - st.d) < 1e-7 OR abs(sv.d + e.dist + tu.d - st.d) < 1e-7 THEN 1 ELSE 0 END)*2/((SELECT n FROM nn)*((SELECT n FROM nn)-1))::DOUBLE, 6)+0 AS betweenness FROM edges e JOIN ap st ON st.s < st.node JOIN ap su ON su.s = st.s AND su.node = e.a JOIN ap sv ON sv.s = st.s AND sv.node = e.b JOIN ap tu ON tu.s = st.node AND tu.node = e.a JOIN ap tv ON tv.s = st.node AND tv.node = e.b GROUP BY a, b")
def edge_betweenness(fx):
    """Every edge, also those that no shortest path uses. The oracle counts pairs whose path is unique, as it is for these distances."""
    e = edges_of(fx).select("a", "b", F.col("dist").alias("w"))
    found = G.betweenness(e).where("kind = 'edge'").select("a", "b", "value")
    return e.select("a", "b").join(found, ["a", "b"], "left").select("a", "b", r6(F.coalesce("value", num(0))).alias("betweenness"))


@query("node_betweenness", PAIRS, BOX, EDGES, _BOTH, _APSP, _NN, "SELECT v.node, round(sum(CASE WHEN st.s <> v.node AND st.node <> v.node AND abs(sv.d + tv.d - st.d) < 1e-7 THEN 1 ELSE 0 END)*2/(((SELECT n FROM nn)-1)*((SELECT n FROM nn)-2))::DOUBLE, 6)+0 AS betweenness FROM (SELECT DISTINCT u AS node FROM both_) v JOIN ap st ON st.s < st.node JOIN ap sv ON sv.s = st.s AND sv.node = v.node JOIN ap tv ON tv.s = st.node AND tv.node = v.node GROUP BY v.node")
def node_betweenness(fx):
    e = edges_of(fx).select("a", "b", F.col("dist").alias("w"))
    found = G.betweenness(e).where("kind = 'node'").select(F.col("a").alias("node"), "value")
    return G.degrees(e).join(found, "node", "left").select("node", r6(F.coalesce("value", num(0))).alias("betweenness"))


@query("mst_steiner")
def mst_steiner(fx):
    """Spanning tree over the Gabriel graph's largest component."""
    return G.terminal_tree(gabriel_of(fx).select("a", "b", F.col("dist").alias("w")), fx.doors, "door_id").select(F.col("a").alias("node_u"), F.col("b").alias("node_v"), F.col("w").alias("weight"))


@query("induced_subgraph", PAIRS, "SELECT a, b FROM prs WHERE dist <= 50 AND a % 2 = 0 AND b % 2 = 0")
def induced_subgraph(fx):
    return G.induced(near_pairs(fx.doors, "door_id", 50.0).select("a", "b"), fx.doors.where("door_id % 2 = 0"), "door_id")


@query("best_component", PAIRS, BOX, EDGES, _CC.format(e="edges"), "cc AS (SELECT node, min(root) AS comp FROM lab GROUP BY node)", "SELECT comp, count(*) AS n FROM cc GROUP BY comp ORDER BY n DESC, comp LIMIT 1")
def best_component(fx):
    return with_components(fx.doors.select("door_id"), edges_of(fx).select("a", "b"), "door_id").groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(1)


@query("distinct_path_edges", "e AS (SELECT door_id AS dest, least(door_id % 20, (door_id*3) % 20) AS a, greatest(door_id % 20, (door_id*3) % 20) AS b, x AS cost FROM fx_doors)", "SELECT a, b, round(arg_min(cost, dest),6)+0 AS path_cost FROM e WHERE a <> b GROUP BY a, b")
def distinct_path_edges(fx):
    """Distinct edges of many routes; the cost is that of the first destination."""
    u, v = F.col("door_id") % 20, (F.col("door_id") * 3) % 20
    e = fx.doors.select("door_id", F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), "x").where("a <> b")
    return e.groupBy("a", "b").agg(r6(F.min_by("x", "door_id")).alias("path_cost"))


@query("length_report", PAIRS, BOX, EDGES, "SELECT round(sum(dist),4)+0 AS total, count(*) AS n, (SELECT round(avg(dist),4)+0 FROM (SELECT dist FROM edges ORDER BY dist DESC, a, b LIMIT 5)) AS top5 FROM edges")
def length_report(fx):
    e = edges_of(fx)
    top = e.orderBy(F.desc("dist"), "a", "b").limit(5).agg(r6(F.avg("dist"), 4).alias("top5"))
    return e.agg(r6(F.sum("dist"), 4).alias("total"), F.count("*").alias("n")).join(F.broadcast(top))


@query("elevation_summary", HEIGHTS, "SELECT count(elev) AS n, round(avg(elev),6)+0 AS mean, round(stddev_samp(elev),6)+0 AS std, round(min(elev),6)+0 AS least, round(quantile_cont(elev,0.25),6)+0 AS q25, round(quantile_cont(elev,0.5),6)+0 AS q50, round(quantile_cont(elev,0.75),6)+0 AS q75, round(max(elev),6)+0 AS most FROM heights")
def elevation_summary(fx):
    e = F.col("elev")
    return door_heights(fx).agg(F.count(e).alias("n"), r6(F.avg(e)).alias("mean"), r6(F.stddev_samp(e)).alias("std"), r6(F.min(e)).alias("least"), r6(F.percentile(e, num(0.25))).alias("q25"), r6(F.percentile(e, num(0.5))).alias("q50"), r6(F.percentile(e, num(0.75))).alias("q75"), r6(F.max(e)).alias("most"))


@query("elevation_histogram", HEIGHTS, "r AS (SELECT min(elev) AS lo, max(elev) AS hi FROM heights)", "SELECT CAST(least(29, floor((elev-lo)/(hi-lo)*30)) AS BIGINT) AS bin, count(*) AS n FROM heights, r WHERE elev IS NOT NULL GROUP BY 1")
def elevation_histogram(fx):
    h = door_heights(fx).where("elev is not null")
    h = h.join(F.broadcast(h.agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))))
    return h.groupBy(F.least(F.lit(29).cast("long"), F.floor((F.col("elev") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30)).alias("bin")).agg(F.count("*").alias("n"))

"""Queries that score lines, and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import clip, num, r6
from ..operators import corridors as S
from ..operators import graph as G
from ..operators import raster as R
from ..operators import scoring as X
from ..operators import spatial_join as J
from ..operators import spectral as P
from ..operators.vectorise import skeleton_to_lines
from . import q_circuit, q_network, q_raster
from .q_geometry import SEGDIST, network_lines
from .q_raster import _DDA, extent
from .q_spectral import _IDX, _RAD, _n01
from .registry import query

c = F.col
LAYERS = "lay AS (SELECT row_id, col_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (elev-66)/10)) AS signal, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (78-elev)/10)) AS stability, CAST((row_id*7+col_id) % 8 AS INT) AS cls FROM fx_dem WHERE elev IS NOT NULL)"


def layers(fx):
    """Stand-ins for a path signal, a stability and a class raster."""
    d = fx.dem.where("elev is not null")
    return d.select("row_id", "col_id", clip((c("elev") - num(66)) / num(10), 0, 1).alias("signal"), clip((num(78) - c("elev")) / num(10), 0, 1).alias("stability"), ((c("row_id") * 7 + c("col_id")) % 8).cast("int").alias("cls"))


def _samples(src: str, name: str) -> str:
    return f"{name}_n AS (SELECT *, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) AS len FROM {src}), {name} AS (SELECT line_id, i, CAST(floor((400-(y1+t*(y2-y1)))/4) AS INT) AS row_id, CAST(floor((x1+t*(x2-x1))/4) AS INT) AS col_id FROM (SELECT *, least(1.0::DOUBLE, i*2.0::DOUBLE/nullif(len,0)) AS t FROM (SELECT *, unnest(range(CAST(ceil(greatest(len,2)/2) AS BIGINT))) AS i FROM {name}_n)))"


_ALONG = "alg AS (SELECT s.line_id, coalesce(avg(signal),0) AS signal, coalesce(avg(stability),0) AS stability FROM smp s LEFT JOIN lay l ON l.row_id = s.row_id AND l.col_id = s.col_id GROUP BY s.line_id)"


@query("line_samples", _samples("fx_lines", "smp"), "SELECT line_id, i, row_id, col_id FROM smp")
def line_samples(fx):
    return X.line_samples(fx.lines, "line_id")


@query("raster_samples_on_lines", LAYERS, _samples("fx_lines", "smp"), "SELECT s.line_id, s.i, round(l.signal,6)+0 AS signal FROM smp s LEFT JOIN lay l ON l.row_id = s.row_id AND l.col_id = s.col_id")
def raster_samples_on_lines(fx):
    return X.line_samples(fx.lines, "line_id").join(layers(fx), ["row_id", "col_id"], "left").select("line_id", "i", r6(c("signal")).alias("signal"))


@query("line_means", LAYERS, _samples("fx_lines", "smp"), _ALONG, "SELECT line_id, round(signal+1e-9,5)+0 AS signal, round(stability+1e-9,5)+0 AS stability FROM alg")
def line_means(fx):
    return X.along_lines(fx.lines, "line_id", layers(fx), ["signal", "stability"]).select("line_id", r6(c("signal") + num(1e-9), 5).alias("signal"), r6(c("stability") + num(1e-9), 5).alias("stability"))


@query("dominant_class", LAYERS, _samples("fx_lines", "smp"), "SELECT line_id, CAST(min(cls) AS INT) AS cls FROM (SELECT line_id, cls, count(*) AS n, max(count(*)) OVER (PARTITION BY line_id) AS m FROM smp s JOIN lay l ON l.row_id = s.row_id AND l.col_id = s.col_id GROUP BY line_id, cls) WHERE n = m GROUP BY line_id")
def dominant_class(fx):
    return X.along_lines(fx.lines, "line_id", layers(fx), [], "cls").where("cls is not null")


@query("skeleton_score", LAYERS, _samples("fx_skeleton", "smp"), _ALONG, "SELECT line_id, round_even(0.7*signal+0.3*stability,4) AS skel_score FROM alg")
def skeleton_score(fx):
    """Skeleton lines by their signal and stability."""
    return X.skeleton_scores(fx.skeleton, "line_id", layers(fx), "signal", "stability").select("line_id", "skel_score")


_CEN = "cen AS (SELECT line_id, coalesce(n,0)::DOUBLE AS dens FROM fx_lines LEFT JOIN (SELECT row_id, col_id, count(*) AS n FROM dda GROUP BY 1, 2) d ON d.row_id = CAST(floor((400-(y1+y2)/2)/4) AS INT) AND d.col_id = CAST(floor((x1+x2)/2/4) AS INT))"
_SC = "sc AS (SELECT line_id, signal, stability, dens, (line_id % 17)/17.0::DOUBLE AS betw, greatest(0, least(1, coalesce(signal/nullif((SELECT max(signal) FROM alg),0),0))) AS spec_norm, greatest(0, least(1, coalesce(stability/nullif((SELECT max(stability) FROM alg),0),0))) AS stab_norm, (line_id % 17)/17.0::DOUBLE/(16/17.0::DOUBLE) AS betw_norm, coalesce(dens/nullif((SELECT max(dens) FROM cen),0),0) AS circ_norm FROM alg JOIN cen USING (line_id))"


def scored(fx):
    d = R.line_cells(fx.lines, "line_id").groupBy("row_id", "col_id").agg(F.count("*").cast("double").alias("dens"))
    df = X.along_lines(fx.lines, "line_id", layers(fx), ["signal", "stability"]).join(X.at_centre(fx.lines, "line_id", d, "dens"), "line_id")
    df = df.withColumn("betw", (c("line_id") % 17) / num(17))
    return X.network_scores(df, {"spec": "signal", "stab": "stability", "betw": "betw", "circ": "dens"})


@query("network_scores", LAYERS, _samples("fx_lines", "smp"), _ALONG, _DDA, _CEN, _SC, "SELECT line_id, round(spec_norm,6)+0 AS spec_norm, round(circ_norm,6)+0 AS circ_norm, round(0.4*spec_norm+0.15*stab_norm+0.25*betw_norm+0.2*circ_norm,5)+0 AS arch_score FROM sc")
def network_scores(fx):
    return scored(fx).select("line_id", r6(c("spec_norm")).alias("spec_norm"), r6(c("circ_norm")).alias("circ_norm"), r6(c("arch_score"), 5).alias("arch_score"))


@query("max_norm", _DDA, "SELECT row_id, col_id, round(count(*)/(max(count(*)) OVER ())::DOUBLE,6)+0 AS v FROM dda GROUP BY row_id, col_id")
def max_norm(fx):
    d = R.line_cells(fx.lines, "line_id").groupBy("row_id", "col_id").agg(F.count("*").alias("n"))
    most = d.agg(F.max("n").alias("most"))  # one row
    return d.join(F.broadcast(most)).select("row_id", "col_id", r6(c("n") / c("most")).alias("v"))


_NEAR = "nst AS (SELECT skel, min(dist) AS d FROM sd GROUP BY skel)"
_DISC = "dsc AS (SELECT n.line_id, round_even(n.len,1) AS len, round_even(d,1) AS d, round_even(signal,4) AS sig, round_even(stability,4) AS stab FROM smp_n n JOIN alg USING (line_id) JOIN nst ON nst.skel = n.line_id WHERE n.len >= 25 AND signal >= 0.35 AND d > 15)"


@query("discovery", LAYERS, _samples("fx_skeleton", "smp"), _ALONG, SEGDIST.replace("% 10 = 3", "% 60 = 3"), _NEAR, _DISC, "SELECT line_id, len AS seg_length_m, d AS dist_to_net_m, round(0.5*sig+0.3*stab+0.2*len/((SELECT max(len) FROM dsc)+1e-9),5)+0 AS discovery_score FROM dsc")
def discovery(fx):
    df = X.discoveries(fx.skeleton, fx.lines.where("line_id % 60 = 3"), "line_id", layers(fx), "signal", "stability")
    return df.select("line_id", "seg_length_m", "dist_to_net_m", r6(c("discovery_score"), 5).alias("discovery_score"))


_AG = "ag AS (SELECT line_id, coalesce(d <= 12, false) AS near, s FROM fx_skeleton LEFT JOIN nst ON nst.skel = line_id LEFT JOIN (SELECT line_id, coalesce(signal,0) >= 0.6*(SELECT max(signal) FROM lay) AS s FROM fx_skeleton LEFT JOIN lay ON row_id = CAST(floor((400-(y1+y2)/2)/4) AS INT) AND col_id = CAST(floor((x1+x2)/2/4) AS INT)) r USING (line_id))"


def panels(fx):
    return {"lines": X.agrees_with_lines(fx.skeleton, "line_id", network_lines(fx)), "raster": X.agrees_with_raster(fx.skeleton, "line_id", layers(fx).select("row_id", "col_id", "signal"), "signal")}


@query("agreement_pct", LAYERS, SEGDIST, _NEAR, _AG, "SELECT 'lines' AS panel, count(*) FILTER (near) AS n_agree, count(*) AS total, round(avg(CAST(near AS INT))*100,6)+0 AS pct FROM ag UNION ALL SELECT 'raster', count(*) FILTER (s), count(*), round(avg(CAST(s AS INT))*100,6)+0 FROM ag")
def agreement_pct(fx):
    return X.agreement(panels(fx)).withColumn("pct", r6(c("pct")))


@query("agreement_flags", LAYERS, SEGDIST, _NEAR, _AG, "SELECT line_id, near AS lines, s AS raster FROM ag")
def agreement_flags(fx):
    p = panels(fx)
    return p["lines"].withColumnRenamed("agrees", "lines").join(p["raster"].withColumnRenamed("agrees", "raster"), "line_id")


_W15 = R.gaussian_weights(1.5)
_K15 = "k15 AS (SELECT * FROM (VALUES " + ",".join(f"({k - 6},{w!r}::DOUBLE)" for k, w in enumerate(_W15)) + ") v(k, w))"
_M = lambda i, n: f"CASE WHEN {i} < 0 THEN -{i}-1 WHEN {i} >= {n} THEN 2*{n}-1-({i}) ELSE {i} END"


@query("stability_proxy", _RAD, _IDX, "dim AS (SELECT max(row_id) + 1 AS nr, max(col_id) + 1 AS nq FROM idx)", f"b01 AS (SELECT row_id, col_id, CASE WHEN label IN (3,6) AND coastal IS NOT NULL THEN 1 - {_n01('bsi', 'idx')} ELSE 0 END AS z FROM idx)", _K15, f"s1 AS (SELECT a.row_id, a.col_id, sum(z.z*w) AS z FROM b01 a, k15, dim, b01 z WHERE z.col_id = a.col_id AND z.row_id = {_M('(a.row_id+k)', 'nr')} GROUP BY 1, 2), s2 AS (SELECT a.row_id, a.col_id, sum(z.z*w) AS z FROM s1 a, k15, dim, s1 z WHERE z.row_id = a.row_id AND z.col_id = {_M('(a.col_id+k)', 'nq')} GROUP BY 1, 2)", f"SELECT row_id, col_id, round({_n01('z', 's2')},5)+0 AS stability FROM s2")
def stability_proxy(fx):
    return _stability(fx).select("row_id", "col_id", r6(c("stability"), 5).alias("stability"))


def _stability(fx):
    """Path classes times what isn't bare, smoothed and scaled."""
    df = P.norm01(P.with_indices(P.radiance(fx.pixels)), "bsi", "bsi01")
    df = df.withColumn("z", F.when(c("label").isin(3, 6) & c("coastal").isNotNull(), num(1) - c("bsi01")).otherwise(num(0)))
    return P.norm01(R.gaussian(df, "z", 1.5, *extent(fx.pixels)), "z", "stability")


@query("path_signal")
def path_signal(fx):
    """Gabor, material, coherence and stability, weighted, smoothed and scaled."""
    df, size = P.material_score(P.with_indices(P.radiance(fx.pixels))), extent(fx.pixels)
    parts = [
        P.norm01(R.gabor(df, "red", {0.40: 1.0}), "gabor", "g01").select("row_id", "col_id", c("g01").alias("gabor")),
        P.norm01(R.coherence(df, "red", 2.0, *size), "coherence", "c01").select("row_id", "col_id", c("c01").alias("coherence")), _stability(fx).select("row_id", "col_id", "stability"),
    ]
    out = df.select("row_id", "col_id", "material")
    for p in parts:
        out = out.join(p, ["row_id", "col_id"], "left")
    return P.norm01(R.gaussian(out.withColumn("s", P.path_signal(out)), "s", 1.0, *size), "s", "signal").select("row_id", "col_id", "signal")


@query("signal_skeleton")
def signal_skeleton(fx):
    """Cells of a strong signal, small objects removed, thinned and traced to lines."""
    cells = layers(fx).where(c("signal") >= C.SIGNAL_MIN).select("row_id", "col_id")
    return skeleton_to_lines(R.skeletonize(R.remove_small(cells)), C.SEGMENT_MIN // 2)


# ---- pipelines


@query("distance_network")
def distance_network(fx):
    """Visible edges with betweenness and the chapels they join."""
    e = G.proximity_graph(fx.doors, fx.footprints, keep=["chapel_id"])
    b = G.betweenness(e.withColumn("w", c("dist"))).where("kind = 'edge'").select("a", "b", c("value").alias("betweenness"))
    return e.join(b, ["a", "b"], "left").select("a", "b", c("a_chapel_id").alias("u_chapel"), c("b_chapel_id").alias("v_chapel"), c("dist").alias("dist_m"), F.coalesce("betweenness", num(0)).alias("betweenness"))


@query("time_network")
def time_network(fx):
    """Routes by walking time from chapel 180, or from the first door that has an edge."""
    e = q_network.fete_of(fx)
    linked = G.degrees(e).join(fx.doors, c("node") == c("door_id"))
    source = linked.agg(F.coalesce(F.min(F.when(c("chapel_id") == "180", c("door_id"))), F.min("door_id")).alias("s")).first().s
    return G.path_tree(G.shortest_paths(e, source or 0))


@query("node_stats")
def node_stats(fx):
    e = q_network.edges_of(fx)
    b = G.betweenness(e.withColumn("w", c("dist"))).where("kind = 'node'").select(c("a").alias("door_id"), "value")
    d = q_network.door_heights(fx).join(G.degrees(e).withColumnRenamed("node", "door_id"), "door_id", "left").join(b, "door_id", "left")
    return d.select("chapel_id", "direction", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("value", num(0)).alias("betweenness"), c("elev").alias("elevation_m"))


@query("proximity_pipeline")
def proximity_pipeline(fx):
    """Gabriel graph past the barriers, and its spanning tree."""
    clean = R.barrier_filter(q_network.gabriel_of(fx), q_raster.cost_surface(fx))
    return G.terminal_tree(clean.select("a", "b", c("dist").alias("w")), fx.doors, "door_id").select(c("a").alias("node_u"), c("b").alias("node_v"), c("w").alias("weight"))


@query("door_roads")
def door_roads(fx):
    """Streets with their crossings and connectors counted."""
    roads = S.corridors(fx.doors)
    ends = S.crossings(roads).select(F.explode(F.array("a", "b")).alias("road")).groupBy("road").agg(F.count("*").alias("crossings"))
    joins = S.connectors(roads).groupBy(c("a").alias("road")).agg(F.count("*").alias("connectors"))
    return roads.join(ends, "road", "left").join(joins, "road", "left").fillna(0, ["crossings", "connectors"])


@query("spectral_base")
def spectral_base(fx):
    """Radiance, indices, components and classes in one table."""
    df, _ = P.pca(P.with_indices(P.radiance(fx.pixels)))
    return P.ordered_classes(P.kmeans(df, ["pc1", "pc2", "pc3"])).select("row_id", "col_id", "ndvi", "bsi", "pc1", "pc2", "pc3", "cluster")


@query("scored_network")
def scored_network(fx):
    return scored(fx).select("line_id", "arch_score", "confidence")


@query("model_agreement")
def model_agreement(fx):
    """The skeleton against four models: network lines, streets, current density and the signal."""
    roads = S.corridors(fx.doors).withColumnRenamed("road", "line_id")
    current = q_circuit.circuit_supernode(fx)
    more = {"streets": X.agrees_with_lines(fx.skeleton, "line_id", roads), "circuit": X.agrees_with_raster(fx.skeleton, "line_id", current, "current")}
    return X.agreement(panels(fx) | more)


@query("audit", "SELECT (SELECT count(*) FROM fx_footprints) AS footprints, (SELECT count(*) FROM fx_doors) AS doors, (SELECT count(*) FROM fx_labels) AS labels, (SELECT count(DISTINCT chapel_id) FROM fx_sheet) AS chapels")
def audit(fx):
    one = lambda df, name, agg: df.agg(agg.alias(name))
    out = one(fx.footprints, "footprints", F.count("*"))
    for df, name, agg in ((fx.doors, "doors", F.count("*")), (fx.labels, "labels", F.count("*")), (fx.sheet, "chapels", F.countDistinct("chapel_id"))):
        out = out.join(F.broadcast(one(df, name, agg)))
    return out


@query("tsne_sample")
def tsne_sample(fx):
    """A two-dimensional embedding of a fixed sample of pixels' components."""
    from ..operators.embed import tsne

    df, _ = P.pca(P.radiance(fx.pixels))
    h = (c("row_id").cast("long") * F.lit(2654435761) + c("col_id") * F.lit(40503) + 42) % F.lit(4294967296)
    return tsne(df.where("coastal is not null").orderBy(h, "row_id", "col_id").limit(150), ["row_id", "col_id"], [f"pc{k}" for k in range(1, 8)], 30.0, 250)


@query("proximity_segments_visible", q_network.PAIRS, q_network.BOX, q_network.EDGES, "SELECT count(*) AS n, round(avg(dist),6)+0 AS mean FROM edges")
def proximity_segments_visible(fx):
    e = J.near_pairs(fx.doors, "door_id", C.R_MAX).withColumns({"x1": c("a_x"), "y1": c("a_y"), "x2": c("b_x"), "y2": c("b_y")})
    return J.visible(e, ["a", "b"], fx.footprints).agg(F.count("*").alias("n"), r6(F.avg("dist")).alias("mean"))

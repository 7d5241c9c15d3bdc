"""Queries over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import cell_cost, num, r6
from ..operators import graph as G
from ..operators import raster as R
from ..operators import spatial_join as J
from ..operators.graph import degrees
from .q_network import BOX, PAIRS
from .registry import query

c = F.col
#: Rows and columns of the whole elevation grid.
_DIM = "dim AS (SELECT max(row_id) + 1 AS nr, max(col_id) + 1 AS nq FROM fx_dem)"


def extent(cells):
    """Rows and columns of a grid that starts at 0."""
    last = cells.agg(F.max("row_id").alias("r"), F.max("col_id").alias("q")).first()
    return (0, 0) if last.r is None else (last.r + 1, last.q + 1)


def _grad(v: str, along: str, over: str, src: str) -> str:
    w = f"OVER (PARTITION BY {over} ORDER BY {along})"
    return f"CASE WHEN lag({along}) {w} IS NULL THEN lead({v}) {w} - {v} WHEN lead({along}) {w} IS NULL THEN {v} - lag({v}) {w} ELSE (lead({v}) {w} - lag({v}) {w})/2 END"


_GRAD = f"grd AS (SELECT *, {_grad('elev', 'col_id', 'row_id', 'fx_dem')} AS dx, {_grad('elev', 'row_id', 'col_id', 'fx_dem')} AS dy FROM fx_dem)"


@query("gradient", _GRAD, "SELECT row_id, col_id, round(dx/4,6)+0 AS dx, round(dy/4,6)+0 AS dy FROM grd")
def gradient(fx):
    return R.gradient(fx.dem, "elev", 4.0).select("row_id", "col_id", r6(c("dx")).alias("dx"), r6(c("dy")).alias("dy"))


_HZ = f"hz AS (SELECT row_id, col_id, {_grad('z', 'col_id', 'row_id', 'z')} AS dx, {_grad('z', 'row_id', 'col_id', 'z')} AS dy FROM (SELECT row_id, col_id, coalesce(elev,0) AS z FROM fx_dem))"


@query("hillshade", _HZ, "SELECT row_id, col_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sin(radians(45))*cos(atan(sqrt(dx*dx+dy*dy))) + cos(radians(45))*sin(atan(sqrt(dx*dx+dy*dy)))*cos(radians(135) - atan2(-dy,dx)))),6)+0 AS shade FROM hz")
def hillshade(fx):
    return R.hillshade(fx.dem, "elev").select("row_id", "col_id", r6(c("shade")).alias("shade"))


_MASK = "msk AS (SELECT DISTINCT row_id, col_id FROM (SELECT unnest(range(100)) AS row_id) r, (SELECT unnest(range(100)) AS col_id) q, bx WHERE (col_id+0.5)*4 > xmin AND (col_id+0.5)*4 < xmax AND 400-(row_id+0.5)*4 > ymin AND 400-(row_id+0.5)*4 < ymax)"


def built(fx):
    return R.box_cells(J.boxes(fx.footprints)).select("row_id", "col_id").distinct()


@query("rasterize_mask", BOX, _MASK, "SELECT CAST(row_id AS INT) AS row_id, CAST(col_id AS INT) AS col_id FROM msk")
def rasterize_mask(fx):
    return built(fx)


@query("polygon_cells", BOX, "SELECT CAST(shp_idx AS BIGINT) AS shp_idx, count(*) AS n FROM (SELECT unnest(range(100)) AS row_id) r, (SELECT unnest(range(100)) AS col_id) q, bx WHERE (col_id+0.5)*4 > xmin AND (col_id+0.5)*4 < xmax AND 400-(row_id+0.5)*4 > ymin AND 400-(row_id+0.5)*4 < ymax GROUP BY shp_idx")
def polygon_cells(fx):
    return R.box_cells(J.boxes(fx.footprints)).groupBy("shp_idx").agg(F.count("*").alias("n"))


COST = "cst AS (SELECT g.row_id, g.col_id, 0.5/greatest(6*exp(-3.5*abs(sqrt(dx*dx/16+dy*dy/16)+0.05))/3.6, 1e-6) + CASE WHEN m.row_id IS NOT NULL THEN 1e9 ELSE 0 END AS cost FROM grd g LEFT JOIN msk m ON m.row_id = g.row_id AND m.col_id = g.col_id)"


def cost_surface(fx):
    """Walking cost of every cell by its slope, and the obstacle's where a building covers its centre."""
    df = R.gradient(fx.dem, "elev", 4.0).join(built(fx).withColumn("built", F.lit(True)), ["row_id", "col_id"], "left")
    return df.select("row_id", "col_id", cell_cost(c("dx"), c("dy"), F.coalesce("built", F.lit(False))).alias("cost"))


@query("tobler_cost", BOX, _MASK, _GRAD, COST, "SELECT row_id, col_id, round(ln(cost),6)+0 AS log_cost FROM cst")
def tobler_cost(fx):
    return cost_surface(fx).select("row_id", "col_id", r6(F.log("cost")).alias("log_cost"))


@query("layer_stack", BOX, _MASK, "SELECT d.row_id, d.col_id, round(coalesce(d.elev,0)+CASE WHEN m.row_id IS NULL THEN 0 ELSE 1000 END,6)+0 AS v FROM fx_dem d LEFT JOIN msk m ON m.row_id = d.row_id AND m.col_id = d.col_id")
def layer_stack(fx):
    df = fx.dem.join(built(fx).withColumn("b", num(1000)), ["row_id", "col_id"], "left")
    return df.select("row_id", "col_id", r6(F.coalesce("elev", num(0)) + F.coalesce("b", num(0))).alias("v"))


@query("window_read", "SELECT row_id, col_id, round(elev,6)+0 AS elev FROM fx_dem WHERE row_id BETWEEN 2 AND 7 AND col_id BETWEEN 25 AND 74")
def window_read(fx):
    return fx.dem.where("row_id between 2 and 7 and col_id between 25 and 74").select("row_id", "col_id", r6(c("elev")).alias("elev"))


@query("tile_prune", "SELECT tile, count(*) AS n FROM (SELECT CAST(floor(col_id/20.0) AS INT) AS tile, col_id FROM fx_dem) GROUP BY tile HAVING max(col_id) > 30 AND min(col_id) < 65")
def tile_prune(fx):
    """Tiles whose extent meets a region strictly."""
    t = fx.dem.groupBy(F.floor(c("col_id") / num(20)).cast("int").alias("tile")).agg(F.count("*").alias("n"), F.max("col_id").alias("hi"), F.min("col_id").alias("lo"))
    return t.where("hi > 30 and lo < 65").select("tile", "n")


@query("optional_source", "SELECT count(*) AS n FROM fx_dem WHERE false")
def optional_source(fx):
    from ..sources.files import read_optional

    return read_optional(fx.spark, f"{fx.sf_dir}/no_such_layer.parquet", "row_id int, col_id int, v double").agg(F.count("*").alias("n"))


@query("mosaic_first_valid", "t AS (SELECT row_id, col_id, 0 AS tile, CASE WHEN (row_id+col_id) % 3 = 0 THEN NULL ELSE elev END AS v FROM fx_dem WHERE col_id < 60 UNION ALL SELECT row_id, col_id, 1, elev + 1000 FROM fx_dem WHERE col_id >= 40)", "SELECT row_id, col_id, round(arg_min(v, tile) FILTER (v IS NOT NULL),6)+0 AS v FROM t GROUP BY row_id, col_id")
def mosaic_first_valid(fx):
    a = fx.dem.where("col_id < 60").select("row_id", "col_id", F.lit(0).alias("tile"), F.when((c("row_id") + c("col_id")) % 3 != 0, c("elev")).alias("v"))
    b = fx.dem.where("col_id >= 40").select("row_id", "col_id", F.lit(1).alias("tile"), (c("elev") + 1000).alias("v"))
    return R.first_valid(a.unionByName(b), "v", "tile").select("row_id", "col_id", r6(c("v")).alias("v"))


_HALF = "hlf AS (SELECT *, greatest(1, CAST(round_even(nr*0.5, 0) AS BIGINT)) AS hr, greatest(1, CAST(round_even(nq*0.5, 0) AS BIGINT)) AS hq FROM dim)"


@query("downsample", _DIM, _HALF, "SELECT CAST(i AS INT) AS row_id, CAST(j AS INT) AS col_id, round(elev,6)+0 AS elev FROM (SELECT *, unnest(range(hr)) AS i FROM hlf) a, (SELECT unnest(range(hq)) AS j FROM hlf) b JOIN fx_dem d ON d.row_id = floor(a.i*(a.nr/a.hr::DOUBLE)) AND d.col_id = floor(b.j*(a.nq/a.hq::DOUBLE))")
def downsample(fx):
    small, _, _ = R.downsample(fx.dem, *extent(fx.dem), 0.5)
    return small.select("row_id", "col_id", r6(c("elev")).alias("elev"))


_Z = "z AS (SELECT row_id, col_id, coalesce(elev,0) AS z FROM fx_dem)"


def _grid_sql(rows: str, cols: str) -> str:
    """Every cell of the new grid with its place on the old one."""
    at = lambda k, n, m: f"greatest(0.0::DOUBLE, least(({n}-1)::DOUBLE, ({k}+0.5)*({n}/({m})::DOUBLE)-0.5))"
    return f"g AS (SELECT i, j, nr, nq, {at('i', 'nr', rows)} AS r, {at('j', 'nq', cols)} AS q FROM (SELECT *, unnest(range({rows})) AS i FROM dim) a, (SELECT unnest(range({cols})) AS j FROM dim) b)"


_CORNERS = "sum(z*(CASE WHEN di=1 THEN r-floor(r) ELSE 1-(r-floor(r)) END)*(CASE WHEN dj=1 THEN q-floor(q) ELSE 1-(q-floor(q)) END))"
_MEET = "FROM g, (VALUES (0),(1)) a(di), (VALUES (0),(1)) b(dj), z WHERE row_id = least(nr-1, floor(r)+di) AND col_id = least(nq-1, floor(q)+dj) GROUP BY i, j"


@query("bilinear_up", _DIM, _Z, _grid_sql("2*nr", "2*nq"), f"SELECT CAST(i AS INT) AS row_id, CAST(j AS INT) AS col_id, round({_CORNERS} + 1e-7,5)+0 AS z {_MEET}")
def bilinear_up(fx):
    (rows, cols), z = extent(fx.dem), fx.dem.select("row_id", "col_id", F.coalesce("elev", num(0)).alias("z"))
    return R.upsample(z, "z", rows, cols, 2 * rows, 2 * cols).select("row_id", "col_id", r6(c("z") + num(1e-7), 5).alias("z"))


@query("resample_bilinear", _DIM, _Z, _grid_sql("nr*7//10", "nq*61//100"), f"SELECT CAST(i AS INT) AS row_id, CAST(j AS INT) AS col_id, round({_CORNERS} + 1e-7,4)+0 AS z {_MEET}")
def resample_bilinear(fx):
    """Onto another grid of the same extent."""
    (rows, cols), z = extent(fx.dem), fx.dem.select("row_id", "col_id", F.coalesce("elev", num(0)).alias("z"))
    return R.upsample(z, "z", rows, cols, rows * 7 // 10, cols * 61 // 100).select("row_id", "col_id", r6(c("z") + num(1e-7), 4).alias("z"))


_FREE = "fre AS (SELECT CAST(row_id AS INT) AS row_id, CAST(col_id AS INT) AS col_id FROM (SELECT unnest(range(100)) AS row_id) r, (SELECT unnest(range(100)) AS col_id) q WHERE (row_id*7+col_id*3) % 5 = 0)"
_PX = "px AS (SELECT door_id, CAST(floor((400-y)/4) AS INT) AS r, CAST(floor(x/4) AS INT) AS q FROM fx_doors)"


def _pixels_of_doors(fx):
    row, col = R.cell_of(c("x"), c("y"))
    return fx.doors.select("door_id", row.alias("row_id"), col.alias("col_id"))


def _free(fx):
    grid = fx.spark.range(10_000).select((c("id") / 100).cast("int").alias("row_id"), (c("id") % 100).cast("int").alias("col_id"))
    return grid.where((c("row_id") * 7 + c("col_id") * 3) % 5 == 0)


@query("snap_pixels", _FREE, _PX, "SELECT door_id, arg_min(f.row_id, greatest(abs(f.row_id-r),abs(f.col_id-q))*1000000 + f.row_id*1000 + f.col_id) AS row_id, arg_min(f.col_id, greatest(abs(f.row_id-r),abs(f.col_id-q))*1000000 + f.row_id*1000 + f.col_id) AS col_id FROM px JOIN fre f ON abs(f.row_id-r) <= 14 AND abs(f.col_id-q) <= 14 GROUP BY door_id")
def snap_pixels(fx):
    return R.snap(_pixels_of_doors(fx), "door_id", _free(fx), R.ring_offsets())


@query("scan_order_snap", _FREE, _PX, "SELECT door_id, arg_min(f.row_id, f.row_id*1000 + f.col_id) AS row_id, arg_min(f.col_id, f.row_id*1000 + f.col_id) AS col_id FROM px JOIN fre f ON abs(f.row_id-r) <= 5 AND abs(f.col_id-q) <= 5 GROUP BY door_id")
def scan_order_snap(fx):
    return R.snap(_pixels_of_doors(fx), "door_id", _free(fx), R.scan_offsets())


_DDA = "dda AS (SELECT DISTINCT line_id, CAST(floor(r1+k*(r2-r1)/n) AS INT) AS row_id, CAST(floor(c1+k*(c2-c1)/n) AS INT) AS col_id FROM (SELECT line_id, r1, r2, c1, c2, n, unnest(range(n+1)) AS k FROM (SELECT line_id, (400-y1)/4 AS r1, (400-y2)/4 AS r2, x1/4 AS c1, x2/4 AS c2, greatest(1, CAST(ceil(greatest(abs(x2/4-x1/4), abs((400-y2)/4-(400-y1)/4))) AS BIGINT)) AS n FROM fx_lines)))"


@query("edge_density_raster", _DDA, "SELECT row_id, col_id, count(*) AS n FROM dda GROUP BY row_id, col_id")
def edge_density_raster(fx):
    return R.line_cells(fx.lines, "line_id").groupBy("row_id", "col_id").agg(F.count("*").alias("n"))


@query("line_burn_last", _DDA, "SELECT row_id, col_id, max(line_id) AS v FROM dda GROUP BY row_id, col_id")
def line_burn_last(fx):
    return R.burn_last(R.line_cells(fx.lines, "line_id").withColumn("v", c("line_id")), "v", "line_id")


_SMP = "smp AS (SELECT a, b, ax + i*(bx-ax)/(n-1) AS x, ay + i*(by_-ay)/(n-1) AS y FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT prs.*, greatest(10, CAST(ceil(dist/0.2) AS BIGINT)) AS n FROM prs WHERE dist <= 30)))"
_BAD = "bad AS (SELECT DISTINCT a, b FROM smp LEFT JOIN (SELECT * FROM cst) g ON g.row_id = CAST(floor((400-y)/4) AS INT) AND g.col_id = CAST(floor(x/4) AS INT) WHERE cost IS NULL OR cost > (SELECT quantile_cont(cost, 0.95) FROM cst))"


@query("barrier_filtered_edges", PAIRS, BOX, _MASK, _GRAD, COST, _SMP, _BAD, "SELECT a, b FROM prs WHERE dist <= 30 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.a = prs.a AND bad.b = prs.b)")
def barrier_filtered_edges(fx):
    return R.barrier_filter(J.near_pairs(fx.doors, "door_id", 30.0), cost_surface(fx)).select("a", "b")


_W1 = R.gaussian_weights(1.0)
_MIR = lambda i, n: f"CASE WHEN {i} < 0 THEN -{i}-1 WHEN {i} >= {n} THEN 2*{n}-1-({i}) ELSE {i} END"
_KW = "kw AS (SELECT * FROM (VALUES " + ",".join(f"({k - 4},{w!r}::DOUBLE)" for k, w in enumerate(_W1)) + ") v(k, w))"


@query("gaussian", _DIM, _Z, _KW, f"g1 AS (SELECT a.row_id, a.col_id, sum(z.z*w) AS z FROM z a, kw, dim, z WHERE z.col_id = a.col_id AND z.row_id = {_MIR('(a.row_id+k)', 'nr')} GROUP BY 1, 2), g2 AS (SELECT a.row_id, a.col_id, sum(z.z*w) AS z FROM g1 a, kw, dim, g1 z WHERE z.row_id = a.row_id AND z.col_id = {_MIR('(a.col_id+k)', 'nq')} GROUP BY 1, 2)", "SELECT row_id, col_id, round(z,6)+0 AS z FROM g2")
def gaussian(fx):
    return R.gaussian(fx.dem, "elev", 1.0, *extent(fx.dem), "z").select("row_id", "col_id", r6(c("z")).alias("z"))


_BLOB = "blob AS (SELECT row_id, col_id FROM fx_dem WHERE elev IS NOT NULL AND elev > 70.5)"
_NEAR = "nb AS (SELECT a.row_id, a.col_id, b.row_id AS r2, b.col_id AS c2 FROM blob a, (VALUES (-1),(0),(1)) i(di), (VALUES (-1),(0),(1)) j(dj), blob b WHERE b.row_id = a.row_id + di AND b.col_id = a.col_id + dj)"


def blob(fx):
    return fx.dem.where("elev is not null and elev > 70.5").select("row_id", "col_id")


@query("erosion", _BLOB, _NEAR, "SELECT row_id, col_id FROM nb GROUP BY row_id, col_id HAVING count(*) = 9")
def erosion(fx):
    return R.erode(blob(fx))


@query("small_components")
def small_components(fx):
    """A recursive query over the whole grid takes SQL too long; a flood fill in the tests answers for it."""
    return R.remove_small(blob(fx), 6)


@query("skeleton_graph", _BLOB, _NEAR, "SELECT row_id AS r1, col_id AS c1, r2, c2 FROM nb WHERE r2 > row_id OR (r2 = row_id AND c2 > col_id)")
def skeleton_graph(fx):
    key = F.lit(1 << 32)
    e = R.neighbours(blob(fx))
    part = lambda x: (F.floor(c(x) / key).cast("int"), F.pmod(c(x), key).cast("int"))
    return e.select(part("a")[0].alias("r1"), part("a")[1].alias("c1"), part("b")[0].alias("r2"), part("b")[1].alias("c2"))


@query("terminal_cells", _BLOB, _NEAR, "SELECT CAST(row_id AS BIGINT)*4294967296 + col_id AS node, count(*) - 1 AS degree FROM nb GROUP BY row_id, col_id HAVING count(*) NOT IN (1, 3)")
def terminal_cells(fx):
    return degrees(R.neighbours(blob(fx))).where("degree <> 2")


@query("neighbour_offsets", "SELECT * FROM (VALUES (0,1,1.0::DOUBLE),(1,0,1.0::DOUBLE),(1,1,round(sqrt(2),6)),(1,-1,round(sqrt(2),6))) v(di,dj,dist)")
def neighbour_offsets(fx):
    from ..operators.circuit import offsets

    return fx.spark.createDataFrame([(i, j, d) for i, j, d in offsets(8)], "di int, dj int, dist double").withColumn("dist", r6(c("dist")))


@query("skeleton_lines")
def skeleton_lines(fx):
    """Thinned free cells as lines between ends and crossings."""
    from ..operators.vectorise import skeleton_to_lines

    return skeleton_to_lines(R.skeletonize(blob(fx)))


@query("free_space")
def free_space(fx):
    """Skeleton of what no building covers, after one erosion."""
    grid = fx.spark.range(10_000).select((c("id") / 100).cast("int").alias("row_id"), (c("id") % 100).cast("int").alias("col_id"))
    free = grid.join(built(fx), ["row_id", "col_id"], "left_anti")
    return R.skeletonize(R.erode(free))


@query("gabor")
def gabor(fx):
    return R.gabor(fx.dem, "elev", {0.40: 1.0})


@query("coherence")
def coherence(fx):
    return R.coherence(fx.dem, "elev", 2.0, *extent(fx.dem))


@query("space_syntax")
def space_syntax(fx):
    """Integration along the free-space skeleton."""
    return G.edge_integration(R.neighbours(free_space(fx)))

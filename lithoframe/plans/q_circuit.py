"""Queries on resistor networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import num, r6
from ..operators import circuit as K
from ..operators import raster as R
from .q_network import BOX
from .q_raster import _GRAD, _MASK, COST, cost_surface
from .registry import query

c = F.col
_NET = "net AS (SELECT a.row_id AS r1, a.col_id AS c1, b.row_id AS r2, b.col_id AS c2, 1/(greatest((a.cost+b.cost)/2, 1e-6)*o.d) AS g FROM cst a, (VALUES (0,1,1.0::DOUBLE),(1,0,1.0::DOUBLE),(1,1,sqrt(2)),(1,-1,sqrt(2))) o(i,j,d), cst b WHERE b.row_id = a.row_id+o.i AND b.col_id = a.col_id+o.j AND a.cost < 1e8 AND b.cost < 1e8)"
_KEPT = "kept AS (SELECT * FROM net WHERE g > 1e-12)"
_DIAG = "dg AS (SELECT s.row_id, s.col_id, coalesce(sum(g), 1.0::DOUBLE) AS diag FROM cst s LEFT JOIN (SELECT r1 AS r, c1 AS q, g FROM kept UNION ALL SELECT r2, c2, g FROM kept) e ON e.r = s.row_id AND e.q = s.col_id GROUP BY 1, 2)"


@query("conductance_edges", BOX, _MASK, _GRAD, COST, _NET, _KEPT, "SELECT r1, c1, r2, c2, round(g,6)+0 AS g FROM kept")
def conductance_edges(fx):
    return K.conductances(cost_surface(fx)).select("r1", "c1", "r2", "c2", r6(c("g")).alias("g"))


@query("laplacian_diag", BOX, _MASK, _GRAD, COST, _NET, _KEPT, _DIAG, "SELECT row_id, col_id, round(diag,6)+0 AS diag FROM dg")
def laplacian_diag(fx):
    cost = cost_surface(fx)
    return K.diagonal(cost, K.conductances(cost)).select("row_id", "col_id", r6(c("diag")).alias("diag"))


@query("dirichlet_rows", BOX, _MASK, _GRAD, COST, _NET, _KEPT, _DIAG, "m AS (SELECT r1, c1, r2, c2, -g AS v FROM kept WHERE NOT (r1 = 5 AND c1 = 50) UNION ALL SELECT r2, c2, r1, c1, -g FROM kept WHERE NOT (r2 = 5 AND c2 = 50) UNION ALL SELECT row_id, col_id, row_id, col_id, CASE WHEN row_id = 5 AND col_id = 50 THEN 1.0 ELSE diag END FROM dg)", "SELECT r1, c1, count(*) AS n, round(sum(v),5)+0 AS total FROM m GROUP BY 1, 2")
def dirichlet_rows(fx):
    """Row sums of the matrix: nothing but the sink's row and isolated cells keeps a sum."""
    cost = cost_surface(fx)
    e = K.conductances(cost)
    return K.dirichlet(e, K.diagonal(cost, e), (5, 50)).groupBy("r1", "c1").agg(F.count("*").alias("n"), r6(F.sum("v"), 5).alias("total"))


@query("current_scatter", BOX, _MASK, _GRAD, COST, _NET, _KEPT, "h AS (SELECT r1, c1, r2, c2, abs(g*(r1*10+c1-r2*10-c2))/2 AS i FROM kept)", "SELECT row_id, col_id, round(sum(i),5)+0 AS i FROM (SELECT r1 AS row_id, c1 AS col_id, i FROM h UNION ALL SELECT r2, c2, i FROM h) GROUP BY 1, 2")
def current_scatter(fx):
    """Half of every edge's current to either end, for potentials that are given."""
    v = lambda r, q: (c(r) * 10 + c(q)).cast("double")
    h = K.conductances(cost_surface(fx)).withColumn("i", F.abs(c("g") * (v("r1", "c1") - v("r2", "c2"))) / num(2))
    ends = h.select(c("r1").alias("row_id"), c("c1").alias("col_id"), "i").unionByName(h.select(c("r2").alias("row_id"), c("c2").alias("col_id"), "i"))
    return ends.groupBy("row_id", "col_id").agg(r6(F.sum("i"), 5).alias("i"))


def _door_cells(fx, cost):
    row, col = R.cell_of(c("x"), c("y"))
    doors = fx.doors.select("door_id", "chapel_id", row.alias("row_id"), col.alias("col_id"))
    free = cost.where("cost < 1e8").select("row_id", "col_id")
    placed = R.snap(doors, "door_id", free, R.scan_offsets()).join(cost.select("row_id", "col_id"), ["row_id", "col_id"], "left_semi")
    return [(r.door_id, r.chapel_id, (r.row_id, r.col_id)) for r in placed.orderBy("door_id").toLocalIterator()]


def _cost_window(fx):
    """The walking cost over the 100 x 100 cells of the site."""
    return cost_surface(fx).where("row_id < 100 and cost is not null")


@query("circuit_supernode")
def circuit_supernode(fx):
    """1 A at every door but the sink, which is chapel 180 or else the door nearest the mean of all (the first of equals)."""
    cost = _cost_window(fx)
    doors = _door_cells(fx, cost)
    if not doors:
        return cost.select("row_id", "col_id", num(0).alias("current"))
    mean = [sum(p[k] for _, _, p in doors) / len(doors) for k in (0, 1)]
    nearest = min((p for _, _, p in doors), key=lambda p: (p[0] - mean[0]) ** 2 + (p[1] - mean[1]) ** 2)
    sink = next((p for _, chapel, p in doors if chapel == "180"), nearest)
    return K.scaled(K.currents(cost, [([p for _, _, p in doors], sink)]))


@query("circuit_pairwise")
def circuit_pairwise(fx):
    cost = _cost_window(fx)
    doors = _door_cells(fx, cost)
    return K.scaled(K.currents(cost, [([a], b) for a, b in K.pair_sample([p for _, _, p in doors])]))


@query("cost_density_mask", BOX, _MASK, _GRAD, COST, "SELECT count(*) FILTER (cost > 1e6) AS built, count(*) FILTER (cost < 1e8) AS free, count(*) FILTER (cost IS NULL) AS unknown FROM cst")
def cost_density_mask(fx):
    return cost_surface(fx).agg(F.count_if(c("cost") > 1e6).alias("built"), F.count_if(c("cost") < 1e8).alias("free"), F.count_if(c("cost").isNull()).alias("unknown"))

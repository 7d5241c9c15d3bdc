"""Resistor networks on cost rasters: conductances, potentials by conjugate gradients, current density."""

from __future__ import annotations

import math
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import num

MAX_SOLVE_CELLS = C.MAX_CELLS


def offsets(connectivity: int = 8) -> list[tuple[int, int, float]]:
    """Forward neighbours with their distance in cells."""
    near = [(0, 1, 1.0), (1, 0, 1.0)]
    return near + [(1, 1, math.sqrt(2)), (1, -1, math.sqrt(2))] if connectivity == 8 else near


def conductances(cost: DataFrame, connectivity: int = 8) -> DataFrame:
    """(r1, c1, r2, c2, g) between neighbouring cells of cost(row_id, col_id, cost): the inverse of mean cost times distance; blocked or unknown cells conduct nothing."""
    sent = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), num(d).alias("d")) for i, j, d in offsets(connectivity)]))
    a = cost.select(F.col("row_id").alias("r1"), F.col("col_id").alias("c1"), F.col("cost").alias("a"), sent.alias("o"))
    a = a.select("r1", "c1", "a", (F.col("r1") + F.col("o.i")).alias("r2"), (F.col("c1") + F.col("o.j")).alias("c2"), F.col("o.d").alias("d"))
    b = cost.select(F.col("row_id").alias("r2"), F.col("col_id").alias("c2"), F.col("cost").alias("b"))
    g = num(1) / (F.greatest((F.col("a") + F.col("b")) / num(2), num(C.MIN_COST)) * F.col("d"))
    open_ = (F.col("a") < C.BLOCKED_COST) & (F.col("b") < C.BLOCKED_COST)
    return a.join(b, ["r2", "c2"]).where(open_).withColumn("g", g).where(F.col("g") > C.MIN_CONDUCTANCE).select("r1", "c1", "r2", "c2", "g")


def diagonal(cost: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_id, col_id, diag): the sum of a cell's conductances; 1 for a cell without any."""
    ends = edges.select(F.col("r1").alias("row_id"), F.col("c1").alias("col_id"), "g").unionByName(edges.select(F.col("r2").alias("row_id"), F.col("c2").alias("col_id"), "g"))
    return cost.select("row_id", "col_id").join(ends.groupBy("row_id", "col_id").agg(F.sum("g").alias("diag")), ["row_id", "col_id"], "left").withColumn("diag", F.coalesce("diag", num(1)))


def dirichlet(edges: DataFrame, diag: DataFrame, sink: tuple[int, int]) -> DataFrame:
    """(r1, c1, r2, c2, v): the matrix's entries with the sink's row replaced by the identity's."""
    off = edges.select("r1", "c1", "r2", "c2", (-F.col("g")).alias("v"))
    off = off.unionByName(off.select(F.col("r2").alias("r1"), F.col("c2").alias("c1"), F.col("r1").alias("r2"), F.col("c1").alias("c2"), "v"))
    at_sink = lambda r, c: (F.col(r) == sink[0]) & (F.col(c) == sink[1])
    on = diag.select(F.col("row_id").alias("r1"), F.col("col_id").alias("c1"), F.col("row_id").alias("r2"), F.col("col_id").alias("c2"), F.when(at_sink("row_id", "col_id"), num(1)).otherwise(F.col("diag")).alias("v"))
    return off.where(~at_sink("r1", "c1")).unionByName(on)


def solve(n: int, a: np.ndarray, b: np.ndarray, g: np.ndarray, current: np.ndarray, sink: int, tol: float = 1e-10) -> np.ndarray:
    """Potentials with the sink at 0 by Jacobi-preconditioned conjugate gradients; current into parts that the sink isn't connected to is dropped."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    live = label == label[sink]
    live[sink] = False
    diag = np.bincount(a, g, n) + np.bincount(b, g, n)
    diag[diag == 0] = 1

    def apply(x: np.ndarray) -> np.ndarray:
        flow = g * (x[a] - x[b])
        y = np.bincount(a, flow, n) - np.bincount(b, flow, n)
        y[~live] = 0
        return y

    x, r = np.zeros(n), np.where(live, current, 0.0)
    z = r / diag
    p, rz, goal = z.copy(), float(r @ z), tol * max(float(np.linalg.norm(r)), 1e-300)
    best, stalled = np.inf, 0
    while (now := float(np.linalg.norm(r))) > goal:
        best, stalled = (now, 0) if now < best else (best, stalled + 1)
        if stalled > n + 1000:  # more steps than there are unknowns without any gain
            raise ArithmeticError(f"potentials don't converge: residual {now:.3g} of {goal:.3g}")
        q = apply(p)
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = r / diag
        rz, old = float(r @ z), rz
        p = z + (rz / old) * p
    return x


def _network(cost: DataFrame, connectivity: int) -> tuple[dict[tuple[int, int], int], np.ndarray, np.ndarray, np.ndarray]:
    """Cells by number, and edges; the number of cells is checked before anything is collected."""
    if (n := cost.count()) > MAX_SOLVE_CELLS:
        raise ValueError(f"{n} cells; reduce the raster to {MAX_SOLVE_CELLS}")
    cells = {(r.row_id, r.col_id): k for k, r in enumerate(cost.select("row_id", "col_id").orderBy("row_id", "col_id").toLocalIterator())}
    e = conductances(cost, connectivity).toPandas()
    number = lambda r, c: np.array([cells[x] for x in zip(r, c, strict=True)], np.int64)
    return cells, number(e["r1"], e["c1"]), number(e["r2"], e["c2"]), e["g"].to_numpy()


def currents(cost: DataFrame, cases: list[tuple[list[tuple[int, int]], tuple[int, int]]], connectivity: int = 8) -> DataFrame:
    """(row_id, col_id, current): density summed over cases of (source cells with 1 A each, sink cell), one task for each case.

    A cell's density is half the sum of the currents of its edges. Sources on the sink's cell add nothing.
    """
    spark = cost.sparkSession
    cells, a, b, g = _network(cost, connectivity)
    shared = spark.sparkContext.broadcast((a, b, g))
    n, places = len(cells), np.array(sorted(cells, key=cells.get), np.int32)
    where = spark.sparkContext.broadcast(places)
    rows = [(k, [cells[s] for s in sources if s in cells], cells[sink]) for k, (sources, sink) in enumerate(cases) if sink in cells]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, g = shared.value
        for part in parts:
            for sources, sink in zip(part["sources"], part["sink"], strict=True):
                into = np.bincount(np.asarray(sources, np.int64), minlength=n).astype(float)
                into[sink] = 0
                v = solve(n, a, b, g, into, int(sink))
                flow = np.abs(g * (v[a] - v[b])) / 2
                density = np.bincount(a, flow, n) + np.bincount(b, flow, n)
                some = np.flatnonzero(density > 1e-15)
                yield pd.DataFrame({"row_id": where.value[some, 0], "col_id": where.value[some, 1], "v": density[some]})

    if not rows:
        return cost.select("row_id", "col_id", num(0).alias("current"))
    each = spark.createDataFrame(rows, "k int, sources array<long>, sink long").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
    summed = each.mapInPandas(run, "row_id int, col_id int, v double").groupBy("row_id", "col_id").agg(F.sum("v").alias("v"))
    return cost.select("row_id", "col_id").join(summed, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("v", num(0)).alias("current"))


def scaled(density: DataFrame) -> DataFrame:
    """Over its maximum, where that is positive."""
    most = density.agg(F.max("current").alias("_m"))
    return density.join(F.broadcast(most)).withColumn("current", F.when(F.col("_m") > 0, F.col("current") / F.nullif("_m", num(0))).otherwise(F.col("current"))).drop("_m")


def pair_sample(cells: list[tuple[int, int]], most: int = C.MAX_PAIRS) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of distinct cells, all or the first of a fixed integer hash's order; what is held follows the cells, not their pairs."""
    cells = sorted(set(cells))
    rank = lambda i, j: (i * 40_503 + j * 2_654_435_761 + 42) % 4_294_967_296
    pairs = heapq.nsmallest(most, ((rank(i, j), i, j) for i in range(len(cells)) for j in range(i + 1, len(cells))))
    return [(cells[i], cells[j]) for _, i, j in pairs]

"""Affine fits, convex hulls and optimal assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geometry import point_segment
from ..functions.scalars import num
from .components import components
from .spatial_join import range_pairs


def affine_fit(labels: DataFrame, points: DataFrame) -> DataFrame:
    """One row (scale, dx, dy): mean ratio of the x and y ranges, then the shift between the means."""
    side = lambda d, p: d.agg(*[f(c).alias(f"{p}{n}{c}") for c in ("x", "y") for n, f in (("m", F.avg), ("r", lambda k: F.max(k) - F.min(k)))])
    both = side(labels, "l").join(F.broadcast(side(points, "p")))
    scale = (F.col("prx") / F.nullif("lrx", num(0)) + F.col("pry") / F.nullif("lry", num(0))) / num(2)
    both = both.withColumn("scale", scale)
    return both.select("scale", (F.col("pmx") - F.col("scale") * F.col("lmx")).alias("dx"), (F.col("pmy") - F.col("scale") * F.col("lmy")).alias("dy"))


def apply_affine(labels: DataFrame, fit: DataFrame) -> DataFrame:
    return labels.join(F.broadcast(fit)).withColumns({"x": F.col("scale") * F.col("x") + F.col("dx"), "y": F.col("scale") * F.col("y") + F.col("dy")}).drop("scale", "dx", "dy")


def min_cost_matching(cost: np.ndarray) -> list[int]:
    """Column of each row (-1 if it has none) of a rectangular matrix with rows <= columns, by successive shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        slack, prev, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        while True:
            reduced = cost[row] - u[row] - v
            better = ~seen & (reduced < slack)
            slack[better], prev[better] = reduced[better], col
            col = int(np.argmin(np.where(seen, np.inf, slack)))
            step = slack[col]
            used = np.flatnonzero(seen)
            u[start] += step
            u[owner[used]] += step
            v[used] -= step
            slack[~seen] -= step
            seen[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        while col >= 0:
            back = prev[col]
            owner[col] = owner[back] if back >= 0 else start
            col = back
    out = [-1] * n
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def assign(labels: DataFrame, label_key: str, points: DataFrame, point_key: str, radius: float = C.MATCH_RADIUS) -> DataFrame:
    """(label_key, point_key, dist): one to one within radius, as many matches as possible and then the least total distance.

    The candidate graph falls into components, and each is solved on its own.
    """
    pairs = range_pairs(labels, label_key, points, point_key, radius).select(F.col(label_key).cast("string").alias("l"), F.col(point_key).cast("string").alias("p"), "dist")
    ends = pairs.select(F.concat(F.lit("l"), "l").alias("a"), F.concat(F.lit("p"), "p").alias("b"))
    comps = components(ends).select(F.col("node").alias("_n"), "comp")
    keyed = pairs.join(comps, F.concat(F.lit("l"), F.col("l")) == F.col("_n")).drop("_n")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        ls, ps = sorted(group["l"].unique()), sorted(group["p"].unique())
        table = np.full((len(ls), max(len(ls), len(ps)) + len(ls)), 1e8)
        at = {x: k for k, x in enumerate(ps)}
        row = {x: k for k, x in enumerate(ls)}
        for l, p, d in zip(group["l"], group["p"], group["dist"], strict=True):
            table[row[l], at[p]] = d
        got = [(l, ps[c], table[k, c]) for (l, k), c in zip(row.items(), min_cost_matching(table), strict=True) if table[k, c] < 1e7]
        return pd.DataFrame(got, columns=[label_key, point_key, "dist"])

    return keyed.groupBy("comp").applyInPandas(solve, f"{label_key} string, {point_key} string, dist double")


def convex_hull(points: DataFrame) -> DataFrame:
    """(i, x, y): hull vertices counter-clockwise from the leftmost lowest; collinear points go.

    Each task keeps its own hull, and one task joins the hulls.
    """

    def chain(df: pd.DataFrame) -> np.ndarray:
        pts = sorted(set(zip(df["x"], df["y"], strict=True)))
        if len(pts) < 3:
            return np.array(pts).reshape(-1, 2)
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        halves = []
        for run in (pts, pts[::-1]):
            half: list = []
            for p in run:
                while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                    half.pop()
                half.append(p)
            halves.append(half[:-1])
        return np.array(halves[0] + halves[1])

    def partial(parts):
        held = np.zeros((0, 2))
        for part in parts:
            held = chain(pd.DataFrame(np.concatenate([held, part[["x", "y"]].to_numpy()]), columns=["x", "y"]))
        yield pd.DataFrame(held, columns=["x", "y"])

    def final(parts):
        held = pd.concat(list(parts) or [pd.DataFrame({"x": [], "y": []})])
        h = chain(held)
        yield pd.DataFrame({"i": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return points.select("x", "y").where("x is not null and y is not null").mapInPandas(partial, "x double, y double").coalesce(1).mapInPandas(final, "i long, x double, y double")


def in_buffered_hull(cells: DataFrame, hull: DataFrame, buffer: float = C.HULL_BUFFER) -> DataFrame:
    """cells(x, y) with in_hull: inside the hull or within buffer of it. The hull is one row of few vertices."""
    n = F.size("_h")
    ring = hull.agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_h"))
    df = cells.join(F.broadcast(ring))
    edges = F.transform("_h", lambda p, k: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at("_h", F.pmod(k + 1, n) + 1).alias("q")))
    left = F.forall(edges, lambda e: (e["q"]["x"] - e["x1"]) * (F.col("y") - e["y1"]) - (e["q"]["y"] - e["y1"]) * (F.col("x") - e["x1"]) >= 0)
    near = F.exists(edges, lambda e: point_segment(F.col("x"), F.col("y"), e["x1"], e["y1"], e["q"]["x"], e["q"]["y"]) <= num(buffer))
    return df.withColumn("in_hull", left | near).drop("_h")

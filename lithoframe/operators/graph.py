"""Graphs as edge tables (a < b, w): proximity graphs, spanning trees, shortest paths, centrality, integration.

Algorithms that follow single paths run on one task while the graph has SMALL edges at most (its size is counted first),
and as rounds of joins beyond. All-sources measures run one source at a time in parallel over a broadcast adjacency,
whose size is checked against MAX_BROADCAST_EDGES.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geometry import distance
from ..functions.scalars import num, walking_seconds
from ..session import cut
from .components import components, with_components
from .spatial_join import cell, near_pairs, visible

SMALL = 200_000
MAX_BROADCAST_EDGES = 5_000_000
MAX_POINTS = 5_000


def proximity_graph(doors: DataFrame, footprints: DataFrame | None, key: str = "door_id", radius: float = C.R_MAX, keep: list[str] | None = None) -> DataFrame:
    """(a, b, dist and end columns) of pairs within radius that see one another past the footprints."""
    pairs = near_pairs(doors, key, radius, keep).withColumns({"x1": F.col("a_x"), "y1": F.col("a_y"), "x2": F.col("b_x"), "y2": F.col("b_y")})
    pairs = visible(pairs, ["a", "b"], footprints) if footprints is not None else pairs
    return pairs.drop("x1", "y1", "x2", "y2")


def with_walking_time(edges: DataFrame) -> DataFrame:
    """w in seconds from dist and the ends' a_elev and b_elev; the climb counts without sign."""
    return edges.withColumn("w", walking_seconds(F.col("dist"), F.abs(F.col("a_elev") - F.col("b_elev"))))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _pairs_to(points: DataFrame, key: str, max_len: float | None) -> tuple[DataFrame, float]:
    """All pairs up to a length; without one, all pairs of at most MAX_POINTS points."""
    if max_len is None:
        b = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
        if b.n > MAX_POINTS:
            raise ValueError(f"{b.n} points; name max_len beyond {MAX_POINTS}")
        max_len = 1.0 + (((b.x1 or 0) - (b.x0 or 0)) ** 2 + ((b.y1 or 0) - (b.y0 or 0)) ** 2) ** 0.5
    return near_pairs(points, key, max_len), max_len


def _empty(pairs: DataFrame, points: DataFrame, key: str, centre: tuple[Column, Column], radius: Column, inside, size: float) -> DataFrame:
    """Pairs whose region holds no third point; the region is within radius of centre, and inside() is its exact test."""
    span = lambda c: F.sequence(cell(c - radius, size), cell(c + radius, size))
    spread = pairs.withColumn("_i", F.explode(span(centre[0]))).withColumn("_j", F.explode(span(centre[1])))
    third = points.select(F.col(key).alias("_w"), F.col("x").alias("_wx"), F.col("y").alias("_wy")).withColumns({"_i": cell(F.col("_wx"), size), "_j": cell(F.col("_wy"), size)})
    hit = spread.join(third, ["_i", "_j"]).where((F.col("_w") != F.col("a")) & (F.col("_w") != F.col("b")) & inside(F.col("_wx"), F.col("_wy")))
    return pairs.join(hit.select("a", "b").distinct(), ["a", "b"], "left_anti")


def gabriel(points: DataFrame, key: str, tol: float = C.GABRIEL_TOL, max_len: float | None = None, size: float = 50.0) -> DataFrame:
    """Pairs whose diametral disk holds no third point."""
    pairs, _ = _pairs_to(points, key, max_len)
    c = (F.col("a_x") + F.col("b_x")) / num(2), (F.col("a_y") + F.col("b_y")) / num(2)
    return _empty(pairs, points, key, c, F.col("dist") / num(2), lambda x, y: distance(x, y, *c) < F.col("dist") / num(2) - num(tol), size)


def beta_skeleton(points: DataFrame, key: str, beta: float = C.BETA, tol: float = C.GABRIEL_TOL, max_len: float | None = None, size: float = 50.0) -> DataFrame:
    """Pairs whose lune (the meeting of two disks of radius beta/2 times their distance) holds no third point; beta 1 gives the Gabriel graph."""
    pairs, _ = _pairs_to(points, key, max_len)
    near, far, r = num(1 - beta / 2), num(beta / 2), num(beta / 2) * F.col("dist")
    c1 = near * F.col("a_x") + far * F.col("b_x"), near * F.col("a_y") + far * F.col("b_y")
    c2 = near * F.col("b_x") + far * F.col("a_x"), near * F.col("b_y") + far * F.col("a_y")
    middle = (F.col("a_x") + F.col("b_x")) / num(2), (F.col("a_y") + F.col("b_y")) / num(2)
    return _empty(pairs, points, key, middle, r, lambda x, y: (distance(x, y, *c1) < r - num(tol)) & (distance(x, y, *c2) < r - num(tol)), size)


def dbscan(points: DataFrame, key: str, eps: float) -> DataFrame:
    """points with cluster: groups linked by steps of eps at most, numbered from 0 by their least key."""
    found = with_components(points, near_pairs(points, key, eps).select("a", "b"), key)
    order = found.select("comp").distinct().orderBy("comp")
    numbered = order.rdd.map(lambda r: r.comp).zipWithIndex().toDF("comp long, cluster long")
    return found.join(numbered, "comp").drop("comp")


def _one_task(edges: DataFrame, work, schema: str) -> DataFrame:
    """work(pandas frame of all edges) on one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        yield work(pd.concat(held) if held else pd.DataFrame({"a": [], "b": [], "w": []}))

    return edges.select("a", "b", "w").coalesce(1).mapInPandas(run, schema)


def spanning_tree(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (a, b, w) of a minimum spanning tree of every component; ties go to the smaller (a, b)."""
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double")), "tree-edges")
    if edges.count() <= small:

        def kruskal(df: pd.DataFrame) -> pd.DataFrame:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            kept = []
            for a, b, w in sorted(zip(df["a"], df["b"], df["w"], strict=True), key=lambda e: (e[2], e[0], e[1])):
                ra, rb = root(int(a)), root(int(b))
                if ra != rb:
                    parent[ra] = rb
                    kept.append((int(a), int(b), float(w)))
            return pd.DataFrame(kept, columns=["a", "b", "w"])

        return _one_task(edges, kruskal, "a long, b long, w double")
    tree, live = None, edges.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    while not live.isEmpty():
        ends = live.select(F.col("ca").alias("c"), "a", "b", "w").unionByName(live.select(F.col("cb").alias("c"), "a", "b", "w"))
        picked = cut(ends.groupBy("c").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct(), "tree")
        tree = picked if tree is None else cut(tree.unionByName(picked), "tree")
        comps = components(tree)
        side = lambda x, c: comps.select(F.col("node").alias(x), F.col("comp").alias(c))
        live = cut(edges.join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca != cb"), "tree-live")
    return tree.select("a", "b", "w") if tree is not None else edges.limit(0)


def terminal_tree(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Spanning tree of the component that holds most terminals, all nodes being terminals; the smaller component id wins a tie."""
    found = with_components(nodes.select(F.col(key).cast("long").alias(key)), edges.select("a", "b"), key)
    best = found.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(1).select("comp")
    inside = found.join(F.broadcast(best), "comp").select(F.col(key).alias("a"))
    return spanning_tree(edges.join(inside, "a", "left_semi"))


def shortest_paths(edges: DataFrame, source: int, small: int = SMALL) -> DataFrame:
    """(node, cost, prev) of all nodes that the source reaches; equal costs take the smaller predecessor."""
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double")), "path-edges")
    if edges.count() <= small:

        def dijkstra(df: pd.DataFrame) -> pd.DataFrame:
            near = defaultdict(list)
            for a, b, w in zip(df["a"], df["b"], df["w"], strict=True):
                near[int(a)].append((int(b), w))
                near[int(b)].append((int(a), w))
            best, heap, rows = {}, [(0.0, -1, source)], []
            while heap:
                cost, prev, node = heapq.heappop(heap)
                if node in best:
                    continue
                best[node] = cost
                rows.append((node, cost, None if prev < 0 else prev))
                for other, w in near[node]:
                    if other not in best:
                        heapq.heappush(heap, (cost + w, node, other))
            out = pd.DataFrame(rows, columns=["node", "cost", "prev"])
            return out.astype({"prev": "Int64"})

        return _one_task(edges, dijkstra, "node long, cost double, prev long")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    spark = edges.sparkSession
    known = spark.createDataFrame([(source, 0.0, None)], "node long, cost double, prev long")
    front = known
    while not front.isEmpty():
        step = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("prev"))
        best = cut(known.unionByName(step).groupBy("node").agg(F.min(F.struct("cost", F.coalesce("prev", F.lit(-1)).alias("p"))).alias("m")).select("node", "m.cost", F.nullif("m.p", F.lit(-1)).alias("prev")), "paths")
        front = cut(best.join(known.select("node", F.col("cost").alias("old")), "node", "left").where("old is null or cost < old").drop("old"), "front")
        known = best
    return known


def path_tree(paths: DataFrame) -> DataFrame:
    """Edges of the shortest-path tree (a < b) with the cost of the far end."""
    return paths.where("prev is not null").select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b"), F.col("cost").alias("path_cost"))


def _adjacency(edges: DataFrame):
    """All edges, collected for a broadcast after their number is checked."""
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double")), "adjacency")
    if (n := edges.count()) > MAX_BROADCAST_EDGES:
        raise ValueError(f"{n} edges are more than the {MAX_BROADCAST_EDGES} that may be broadcast")
    near = defaultdict(list)
    for r in edges.toLocalIterator():
        near[r.a].append((r.b, r.w))
        near[r.b].append((r.a, r.w))
    return {k: sorted(v) for k, v in near.items()}


def betweenness(edges: DataFrame) -> DataFrame:
    """(kind, a, b, value): 'edge' rows a < b and 'node' rows with a = b, normalised over unordered pairs. One pass of Brandes gives both."""
    spark = edges.sparkSession
    near = _adjacency(edges)
    shared, n = spark.sparkContext.broadcast(near), len(near)

    def from_sources(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adj = shared.value
        total: dict[tuple[int, int], float] = defaultdict(float)
        for part in parts:
            for s in part["id"]:
                dist, count, before, order, heap = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0.0, s)]
                done = set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    order.append(v)
                    for u, w in adj[v]:
                        c = d + w
                        if u not in dist or c < dist[u] - 1e-12 * max(1.0, c):
                            dist[u], count[u], before[u] = c, count[v], [v]
                            heapq.heappush(heap, (c, u))
                        elif u not in done and abs(c - dist[u]) <= 1e-12 * max(1.0, c):
                            count[u] += count[v]
                            before[u].append(v)
                owed = defaultdict(float)
                for u in reversed(order):
                    for v in before[u]:
                        share = count[v] / count[u] * (1 + owed[u])
                        total[min(u, v), max(u, v)] += share
                        owed[v] += share
                    if u != s:
                        total[u, u] += owed[u]
        yield pd.DataFrame([(a, b, v) for (a, b), v in total.items()], columns=["a", "b", "value"])

    nodes = spark.createDataFrame([(int(k),) for k in sorted(near)], "id long").repartition(max(1, min(n, spark.sparkContext.defaultParallelism)))
    sums = nodes.mapInPandas(from_sources, "a long, b long, value double").groupBy("a", "b").agg(F.sum("value").alias("v"))
    scale = F.when(F.col("a") == F.col("b"), num(1 / max((n - 1) * (n - 2), 1))).otherwise(num(1 / max(n * (n - 1), 1)))
    return sums.select(F.when(F.col("a") == F.col("b"), "node").otherwise("edge").alias("kind"), "a", "b", (F.col("v") * scale).alias("value"))


def hop_depths(edges: DataFrame) -> DataFrame:
    """(node, reached, total): how many nodes each node reaches, itself included, and the sum of steps."""
    spark = edges.sparkSession
    near = _adjacency(edges.withColumn("w", num(1)))
    shared = spark.sparkContext.broadcast(near)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adj, rows = shared.value, []
        for part in parts:
            for s in part["id"]:
                seen, front, depth, total = {s}, [s], 0, 0
                while front:
                    depth += 1
                    nxt = []
                    for v in front:
                        for u, _ in adj[v]:
                            if u not in seen:
                                seen.add(u)
                                nxt.append(u)
                    total += depth * len(nxt)
                    front = nxt
                rows.append((int(s), len(seen), total))
        yield pd.DataFrame(rows, columns=["node", "reached", "total"])

    nodes = spark.createDataFrame([(int(k),) for k in sorted(near)], "id long").repartition(max(1, min(len(near), spark.sparkContext.defaultParallelism)))
    return nodes.mapInPandas(walk, "node long, reached long, total long")


def integration(edges: DataFrame) -> DataFrame:
    """(node, depth, integration): mean steps to the nodes that are reached, and 1 / (depth - 1), 0 where that has no value."""
    d = hop_depths(edges).where("reached >= 3")
    depth = F.col("total") / F.nullif(F.col("reached") - 1, F.lit(0))
    return d.select("node", depth.alias("depth"), F.when(depth - 1 > 0, num(1) / F.nullif(depth - 1, num(0))).otherwise(num(0)).alias("integration"))


def edge_integration(edges: DataFrame) -> DataFrame:
    """(a, b, integration_u, integration_v, integration_mean, integration_mean_norm)."""
    n = integration(edges)
    side = lambda x, c: n.select(F.col("node").alias(x), F.col("integration").alias(c))
    both = edges.select("a", "b").join(side("a", "integration_u"), "a").join(side("b", "integration_v"), "b")
    both = both.withColumn("integration_mean", (F.col("integration_u") + F.col("integration_v")) / num(2))
    most = both.agg(F.max("integration_mean").alias("_m"))
    return both.join(F.broadcast(most)).withColumn("integration_mean_norm", F.when(F.col("_m") > 0, F.col("integration_mean") / F.nullif("_m", num(0))).otherwise(num(0))).drop("_m")


def induced(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col(key).alias("a")), "a", "left_semi").join(nodes.select(F.col(key).alias("b")), "b", "left_semi")

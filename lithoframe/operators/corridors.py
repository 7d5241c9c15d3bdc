"""Street corridors, crossings, connectors and hubs from doors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import constants as C
from ..functions.geometry import along, crossing, distance, principal_axis
from ..functions.scalars import num
from . import graph as G
from .spatial_join import covered_length, segment_pairs

SEG = ("x1", "y1", "x2", "y2")


def split_runs(rows: DataFrame, group: list[str], order: list[str], value: str, gap: float = C.GAP, longest: float = C.MAX_LENGTH) -> DataFrame:
    """rows with sub: along each group's order of value a new run starts after a gap over `gap`, or where the run would get longer than `longest`.

    The length rule hangs on where the run began, so each part between gaps is folded in order; parts between gaps bound the fold.
    """
    w = W.Window.partitionBy(*group).orderBy(value, *order)
    step = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    parts = rows.withColumn("_step", step).withColumn("_part", F.sum("_step").over(w)).drop("_step")
    item = F.struct(F.col(value).alias("v"), *order)
    packed = parts.groupBy(*group, "_part").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    zero = F.struct(F.lit(None).cast("double").alias("start"), F.lit(-1).alias("k"), F.array().cast("array<int>").alias("out"))

    def fold(acc, x):
        new = acc["start"].isNull() | (x["v"] - acc["start"] > longest)
        k = acc["k"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, x["v"]).otherwise(acc["start"]).alias("start"), k.alias("k"), F.concat(acc["out"], F.array(k)).alias("out"))

    subs = packed.withColumn("_o", F.aggregate("_l", zero, fold, lambda acc: acc["out"])).select(*group, "_part", F.explode(F.arrays_zip("_l", "_o")).alias("z"))
    subs = subs.select(*group, "_part", F.col("z._l.v").alias("_v"), *[F.col(f"z._l.{o}").alias(f"_k_{o}") for o in order], F.col("z._o").alias("_sub"))
    offset = subs.groupBy(*group, "_part").agg(F.max("_sub").alias("_m")).withColumn("_base", F.coalesce(F.sum(F.col("_m") + 1).over(W.Window.partitionBy(*group).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = subs.join(offset.select(*group, "_part", "_base"), [*group, "_part"]).select(*group, *[F.col(f"_k_{o}").alias(o) for o in order], (F.col("_base") + F.col("_sub")).cast("long").alias("sub"))
    return rows.join(numbered, [*group, *order])


def corridors(doors: DataFrame, key: str = "door_id", eps: float = C.STREET_EPS) -> DataFrame:
    """Streets of doors(key, x, y, direction, chapel): doors to north and south make streets along x, the others along y.

    Doors are clustered, projected on their cluster's main axis (the street's own where the spread is too small), split
    into runs, and each run becomes a segment along the axis of its cluster with its ends extended.
    """
    c = F.col
    out = None
    for name, codes, axis in (("EW", ("N", "S"), (1.0, 0.0)), ("NS", ("E", "W"), (0.0, 1.0))):
        own = doors.where(c("direction").isin(*codes))
        placed = G.dbscan(own, key, eps)
        stats = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
        ux, uy = principal_axis(c("sxx"), c("syy"), c("sxy"))
        wide = (c("n") > 1) & (F.sqrt(F.greatest("sxx", "syy")) > C.STD_FLOOR)
        stats = stats.select("cluster", "mx", "my", F.when(wide, ux).otherwise(num(axis[0])).alias("ux"), F.when(wide, uy).otherwise(num(axis[1])).alias("uy"))
        placed = placed.join(stats, "cluster").withColumn("p", (c("x") - c("mx")) * c("ux") + (c("y") - c("my")) * c("uy"))
        runs = split_runs(placed, ["cluster"], [key], "p")
        seg = runs.groupBy("cluster", "sub").agg(
            F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mid"), F.first("ux").alias("ux"), F.first("uy").alias("uy"),
            F.bool_or(c("direction") == codes[0]).alias("_one"), F.bool_or(c("direction") == codes[1]).alias("_two"), F.bool_or(c("chapel_id").cast("int").between(*C.DOUBLE_CHAPELS)).alias("_forced"),
        )
        before = F.when(c("n") > 1, c("lo") - c("mid") - num(C.END_EXTENSION)).otherwise(num(-C.DEFAULT_HALF))
        after = F.when(c("n") > 1, c("hi") - c("mid") + num(C.END_EXTENSION)).otherwise(num(C.DEFAULT_HALF))
        seg = seg.select(
            F.format_string(f"{name}_%d_%d", "cluster", "sub").alias("road"), F.lit(name).alias("orientation"), "n", ((c("_one") & c("_two")) | c("_forced")).alias("is_double"),
            (c("cx") + before * c("ux")).alias("x1"), (c("cy") + before * c("uy")).alias("y1"), (c("cx") + after * c("ux")).alias("x2"), (c("cy") + after * c("uy")).alias("y2"),
        )
        out = seg if out is None else out.unionByName(seg)
    return out


def _paired(roads: DataFrame, pairs: DataFrame) -> DataFrame:
    side = lambda p: roads.select(F.col("road").alias(p), *[F.col(k).alias(f"{p}_{k}") for k in SEG])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def crossings(roads: DataFrame) -> DataFrame:
    """(a, b, x, y) of roads a < b that meet in one point."""
    touch = segment_pairs(roads.withColumnRenamed("road", "a"), "a", roads.withColumnRenamed("road", "b"), "b", 1e-9).where("a < b").select("a", "b")
    met, x, y = crossing(tuple(F.col(f"a_{k}") for k in SEG), tuple(F.col(f"b_{k}") for k in SEG))
    return _paired(roads, touch).where(met).select("a", "b", x.alias("x"), y.alias("y"))


def connectors(roads: DataFrame) -> DataFrame:
    """(a, b, ex, ey, px, py, dist): from each end of road a to the nearest point of another road b that is near, but not at, it."""
    c = F.col
    near = segment_pairs(roads.withColumnRenamed("road", "a"), "a", roads.withColumnRenamed("road", "b"), "b", C.CONNECT_MAX).where("a <> b").select("a", "b")
    both = _paired(roads, near).withColumn("e", F.explode(F.array(F.struct(c("a_x1").alias("x"), c("a_y1").alias("y")), F.struct(c("a_x2").alias("x"), c("a_y2").alias("y")))))
    t = along(c("e.x"), c("e.y"), *[c(f"b_{k}") for k in SEG])
    both = both.withColumns({"px": c("b_x1") + t * (c("b_x2") - c("b_x1")), "py": c("b_y1") + t * (c("b_y2") - c("b_y1"))})
    both = both.withColumn("dist", distance(c("e.x"), c("e.y"), c("px"), c("py"))).where((c("dist") > C.CONNECT_MIN) & (c("dist") < C.CONNECT_MAX))
    return both.select("a", "b", c("e.x").alias("ex"), c("e.y").alias("ey"), "px", "py", "dist")


def road_nodes(roads: DataFrame) -> DataFrame:
    """(node, x, y, type): crossings, and either end of every connector."""
    x = crossings(roads).select("x", "y", F.lit("intersection").alias("type"), F.concat_ws("|", "a", "b").alias("_o"))
    k = connectors(roads)
    ends = k.select(F.col("ex").alias("x"), F.col("ey").alias("y"), F.lit("connection_endpoint").alias("type"), F.concat_ws("|", "a", "b").alias("_o"))
    joints = k.select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit("connection_junction").alias("type"), F.concat_ws("|", "a", "b").alias("_o"))
    every = x.unionByName(ends).unionByName(joints)
    order = W.Window.orderBy("type", "_o", "x", "y")
    return every.withColumn("node", F.row_number().over(order).cast("long")).drop("_o")


def hubs(nodes: DataFrame, eps: float = C.HUB_EPS) -> DataFrame:
    """Hubs of road nodes: clusters of HUB_MIN nodes or with a crossing; major from HUB_MAJOR or with a crossing."""
    g = G.dbscan(nodes, "node", eps).groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("weight"), F.bool_or(F.col("type") == "intersection").alias("crossed"))
    return g.where((F.col("weight") >= C.HUB_MIN) | F.col("crossed")).select("cluster", "x", "y", "weight", ((F.col("weight") >= C.HUB_MAJOR) | F.col("crossed")).alias("is_major"))


def entrance_network(doors: DataFrame, footprints: DataFrame, key: str = "door_id", eps: float = C.ENTRANCE_EPS) -> tuple[DataFrame, DataFrame]:
    """Hubs of entrances (cluster, x, y, size, chapels) and edges door to hub and hub to hub (Gabriel), with what they cross of buildings."""
    c = F.col
    found = G.dbscan(doors, key, eps)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "chapel_id"))), lambda v: v["chapel_id"]), ", ")
    chapels = found.where("chapel_id is not null").groupBy("cluster", "chapel_id").agg(F.min(key).alias("_i")).groupBy("cluster").agg(text.alias("chapels"))
    hub = found.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("size")).join(chapels, "cluster", "left").withColumn("chapels", F.coalesce("chapels", F.lit("")))
    spokes = found.join(hub.select("cluster", c("x").alias("hx"), c("y").alias("hy")), "cluster")
    spokes = spokes.select(F.format_string("door_%d", key).alias("u"), F.format_string("hub_%d", "cluster").alias("v"), F.lit("door_to_hub").alias("edge_type"), "cluster", c("x").alias("x1"), c("y").alias("y1"), c("hx").alias("x2"), c("hy").alias("y2"))
    links = G.gabriel(hub.select("cluster", "x", "y"), "cluster", C.HUB_GABRIEL_TOL)
    links = links.select(F.format_string("hub_%d", "a").alias("u"), F.format_string("hub_%d", "b").alias("v"), F.lit("hub_to_hub").alias("edge_type"), F.lit(None).cast("long").alias("cluster"), c("a_x").alias("x1"), c("a_y").alias("y1"), c("b_x").alias("x2"), c("b_y").alias("y2"))
    edges = covered_length(spokes.unionByName(links), ["u", "v"], footprints)
    return hub, edges.withColumn("dist", distance(*[c(k) for k in SEG]))

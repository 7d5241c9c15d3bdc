"""Rasters as cell tables (row_id, col_id, v): gradients, rasterising, resampling, stencils, thinning, components.

Cells are rows, so a stencil is a join of a cell with its neighbours: each cell sends its value to the cells whose
result needs it, and one aggregation per cell gathers them. Larger kernels go axis by axis where they are separable.

Files of cells are a few bytes a cell, so their size says little of the memory that a broadcast of them takes; joins of whole
grids are therefore told to sort and merge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import constants as C
from ..functions.geometry import edges_of, within
from ..functions.scalars import num
from ..session import cut, drop
from .components import components
from .spatial_join import ring_bounds

SITE, CELL = 400.0, 4.0


def cell_of(x: Column, y: Column, site: float = SITE, size: float = CELL) -> tuple[Column, Column]:
    """Row and column of a point; rows count from the top."""
    return F.floor((num(site) - y) / num(size)).cast("int"), F.floor(x / num(size)).cast("int")


def centre_of(row: Column, col: Column, site: float = SITE, size: float = CELL) -> tuple[Column, Column]:
    return (col + num(0.5)) * num(size), num(site) - (row + num(0.5)) * num(size)


def gradient(cells: DataFrame, value: str, spacing: float = 1.0) -> DataFrame:
    """cells with dx (along columns) and dy (along rows): central differences, one-sided at the edges, NULL beside NULL."""
    for out, over, along in (("dx", "row_id", "col_id"), ("dy", "col_id", "row_id")):
        w = W.Window.partitionBy(over).orderBy(along)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
        step = F.when(first & last, num(0)).when(first, after - here).when(last, here - before).otherwise((after - before) / num(2))
        cells = cells.withColumn(out, step / num(spacing))
    return cells


def hillshade(cells: DataFrame, value: str, azimuth: float = 315, altitude: float = 45) -> DataFrame:
    """cells with shade in 0..1; unknown heights count as 0, and the gradient has unit spacing."""
    df = gradient(cells.withColumn("_z", F.coalesce(value, num(0))), "_z")
    slope, aspect = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.atan2(-F.col("dy"), F.col("dx"))
    az, alt = math.radians(360 - azimuth + 90), math.radians(altitude)
    shade = num(math.sin(alt)) * F.cos(slope) + num(math.cos(alt)) * F.sin(slope) * F.cos(num(az) - aspect)
    return df.withColumn("shade", F.greatest(num(0), F.least(num(1), shade))).drop("_z", "dx", "dy")


def box_cells(boxes: DataFrame, site: float = SITE, size: float = CELL, keep: list[str] | None = None) -> DataFrame:
    """(shp_idx, row_id, col_id, keep) of cells whose centre is inside a box (xmin, ymin, xmax, ymax)."""
    row = lambda y: (num(site) - y) / num(size) - num(0.5)
    col = lambda x: x / num(size) - num(0.5)
    run = lambda lo, hi: F.when(F.floor(lo) + 1 <= F.ceil(hi) - 1, F.sequence(F.floor(lo) + 1, F.ceil(hi) - 1))
    df = boxes.withColumn("col_id", F.explode(run(col(F.col("xmin")), col(F.col("xmax")))))
    df = df.withColumn("row_id", F.explode(run(row(F.col("ymax")), row(F.col("ymin")))))
    return df.select("shp_idx", F.col("row_id").cast("int").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), *(keep or []))


def ring_cells(polygons: DataFrame, site: float = SITE, size: float = CELL) -> DataFrame:
    """(shp_idx, row_id, col_id) of cells whose centre is inside a ring of any shape (shp_idx, ring), as with boxes not on its edge."""
    near = box_cells(ring_bounds(polygons.select("shp_idx", "ring")).withColumn("_e", edges_of(F.col("ring"))).drop("ring"), site, size, ["_e"])
    return near.where(within(*centre_of(F.col("row_id"), F.col("col_id"), site, size), F.col("_e"))).drop("_e")


def line_cells(lines: DataFrame, key: str, site: float = SITE, size: float = CELL) -> DataFrame:
    """(key, row_id, col_id) of cells that a line of two ends passes, sampled once for each cell along its longer axis."""
    c1, c2 = F.col("x1") / num(size), F.col("x2") / num(size)
    r1, r2 = (num(site) - F.col("y1")) / num(size), (num(site) - F.col("y2")) / num(size)
    steps = F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(F.abs(c2 - c1), F.abs(r2 - r1))))
    df = lines.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    t = F.col("_k") / F.col("_n").cast("double")
    return df.select(key, F.floor(r1 + t * (r2 - r1)).cast("int").alias("row_id"), F.floor(c1 + t * (c2 - c1)).cast("int").alias("col_id")).distinct()


def edge_samples(edges: DataFrame, step: float = C.BARRIER_STEP, least: int = C.BARRIER_SAMPLES) -> DataFrame:
    """edges(a, b, dist, ends) with points x, y spread evenly along them, both ends included."""
    df = edges.withColumn("_n", F.greatest(F.lit(least).cast("long"), F.ceil(F.col("dist") / num(step)))).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    t = F.col("_k") / (F.col("_n") - 1).cast("double")
    return df.withColumns({"x": F.col("a_x") + t * (F.col("b_x") - F.col("a_x")), "y": F.col("a_y") + t * (F.col("b_y") - F.col("a_y"))}).drop("_n", "_k")


def barrier_filter(edges: DataFrame, cost: DataFrame, share: float = C.BARRIER_PERCENTILE) -> DataFrame:
    """Edges none of whose samples is off the grid, without a cost, or over a percentile of all costs."""
    limit = cost.agg(F.percentile("cost", num(share)).alias("_limit"))
    row, col = cell_of(F.col("x"), F.col("y"))
    met = edge_samples(edges).withColumns({"row_id": row, "col_id": col}).join(cost.select("row_id", "col_id", "cost"), ["row_id", "col_id"], "left").join(F.broadcast(limit))
    return edges.join(met.where(F.col("cost").isNull() | (F.col("cost") > F.col("_limit"))).select("a", "b").distinct(), ["a", "b"], "left_anti")


def downsample_scale(cells: int, most: int = C.MAX_CELLS) -> float:
    return 1.0 if cells <= most else math.sqrt(most / cells)


def downsample(cells: DataFrame, rows: int, cols: int, scale: float) -> tuple[DataFrame, int, int]:
    """Nearest-cell grid of scale times the size, rounded: new cells take the cell that their index points back to."""
    h, w = max(1, round(rows * scale)), max(1, round(cols * scale))
    for axis, n, m in (("row_id", rows, h), ("col_id", cols, w)):
        ratio, here = num(n / m), F.col(axis)
        near = F.sequence(F.floor(here / ratio), F.ceil((here + 1) / ratio))  # the few indices that can point back here
        back = F.filter(near, lambda i: (i < F.lit(m)) & (F.floor(i * ratio) == here))  # noqa: B023  it is called at once
        cells = cells.withColumn("_to", F.explode(back)).withColumn(axis, F.col("_to").cast("int")).drop("_to")
    return cells, h, w


def upsample(cells: DataFrame, value: str, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """Bilinear grid of to_rows x to_cols; indices beyond the edge take the edge."""
    spark = cells.sparkSession
    grid = spark.range(to_rows * to_cols).select((F.col("id") / to_cols).cast("int").alias("row_id"), (F.col("id") % to_cols).cast("int").alias("col_id"))
    src = lambda c, n, m: F.greatest(num(0), F.least(num(n - 1), (F.col(c) + num(0.5)) * num(n / m) - num(0.5)))
    grid = grid.withColumns({"_r": src("row_id", rows, to_rows), "_c": src("col_id", cols, to_cols)})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    each = grid.withColumn("_k", corner)
    fr, fc = F.col("_r") - F.floor("_r"), F.col("_c") - F.floor("_c")
    weight = F.when(F.col("_k.i") == 1, fr).otherwise(num(1) - fr) * F.when(F.col("_k.j") == 1, fc).otherwise(num(1) - fc)
    each = each.select("row_id", "col_id", F.least(F.floor("_r") + F.col("_k.i"), F.lit(rows - 1)).cast("int").alias("_sr"), F.least(F.floor("_c") + F.col("_k.j"), F.lit(cols - 1)).cast("int").alias("_sc"), weight.alias("_w"))
    src_cells = cells.select(F.col("row_id").alias("_sr"), F.col("col_id").alias("_sc"), F.col(value).alias("_v"))
    return each.join(src_cells, ["_sr", "_sc"]).groupBy("row_id", "col_id").agg(F.sum(F.col("_v") * F.col("_w")).alias(value))


def snap(points: DataFrame, key: str, free: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """points(key, row_id, col_id) moved to the first free cell in the order of offsets; where there is none they stay."""
    ranked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(offsets)])
    each = points.select(key, "row_id", "col_id", F.explode(ranked).alias("o"))
    each = each.select(key, F.col("o.k").alias("k"), (F.col("row_id") + F.col("o.i")).cast("int").alias("row_id"), (F.col("col_id") + F.col("o.j")).cast("int").alias("col_id"))
    best = each.join(free.select("row_id", "col_id"), ["row_id", "col_id"]).groupBy(key).agg(F.min_by(F.struct("row_id", "col_id"), "k").alias("_to"))
    return points.join(best, key, "left").withColumns({"row_id": F.coalesce("_to.row_id", "row_id"), "col_id": F.coalesce("_to.col_id", "col_id")}).drop("_to")


def ring_offsets(radius: int = C.SNAP_RADIUS) -> list[tuple[int, int]]:
    """The cell itself, then ring by ring; within a ring by row and column."""
    return [(0, 0)] + [(i, j) for r in range(1, radius + 1) for i in range(-r, r + 1) for j in range(-r, r + 1) if max(abs(i), abs(j)) == r]


def scan_offsets(radius: int = C.DOOR_SNAP) -> list[tuple[int, int]]:
    """A square in raster order."""
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]


def gather(cells: DataFrame, value: str, kernel: dict[tuple[int, int], float], out: str) -> DataFrame:
    """(row_id, col_id, out): weighted sum of a cell's neighbours by offset; cells that are missing or NULL count as 0."""
    sent = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), num(w).alias("w")) for (i, j), w in kernel.items()]))
    each = cells.select("row_id", "col_id", F.col(value).alias("_v"), sent.alias("o"))
    each = each.select((F.col("row_id") - F.col("o.i")).cast("int").alias("row_id"), (F.col("col_id") - F.col("o.j")).cast("int").alias("col_id"), (F.coalesce("_v", num(0)) * F.col("o.w")).alias("_p"))
    return cells.select("row_id", "col_id").hint("merge").join(each.groupBy("row_id", "col_id").agg(F.sum("_p").alias(out)).hint("merge"), ["row_id", "col_id"], "left")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(cells: DataFrame, value: str, sigma: float, rows: int, cols: int, out: str | None = None) -> DataFrame:
    """Separable Gaussian over a grid, mirrored at its edges with the edge cell repeated; NULL and missing cells count as 0.

    Only cells that there are get a value, along the first axis too: a last row that isn't full stays as it is.
    """
    out, weights = out or value, gaussian_weights(sigma)
    r = len(weights) // 2
    df = cells.select("row_id", "col_id", F.coalesce(value, num(0)).alias("_v"))
    for axis, n in (("row_id", rows), ("col_id", cols)):
        reach = F.explode(F.sequence(F.lit(-r), F.lit(r)))
        target = F.col(axis)
        each = df.withColumn("_k", reach)
        # the output at i reads the mirrored position of i + k, so a cell p serves every i with mirror(i + k) = p
        i_direct, i_low, i_high = target - F.col("_k"), -target - 1 - F.col("_k"), 2 * n - 1 - target - F.col("_k")
        each = each.withColumn("_i", F.explode(F.array(i_direct, i_low, i_high)))
        ok = (F.col("_i") >= 0) & (F.col("_i") < n)
        w = F.element_at(F.array(*[num(x) for x in weights]), F.col("_k") + r + 1)
        other = "col_id" if axis == "row_id" else "row_id"
        here = F.bool_or((F.col("_k") == 0) & (F.col("_i") == target))  # the cell itself is among what it gets
        df = each.where(ok).groupBy(F.col("_i").cast("int").alias("_to"), other).agg(F.sum(F.col("_v") * w).alias("_v"), here.alias("_here"))
        df = df.where("_here").select(F.col("_to").alias(axis), other, "_v")
    return df.select("row_id", "col_id", F.col("_v").alias(out))


def gabor_kernels(freq: float, angles: int = 9, width: float = 0.56) -> list[tuple[dict, dict]]:
    """Real and imaginary kernels at evenly spread angles; the width follows the frequency (one octave)."""
    sigma = width / freq
    r = math.ceil(3 * sigma)
    out = []
    for a in range(angles):
        th = math.pi * a / angles
        re, im = {}, {}
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                x = j * math.cos(th) + i * math.sin(th)
                g = math.exp(-0.5 * (i * i + j * j) / sigma**2) / (2 * math.pi * sigma**2)
                if g > 1e-6:
                    re[i, j], im[i, j] = g * math.cos(2 * math.pi * freq * x), g * math.sin(2 * math.pi * freq * x)
        out.append((re, im))
    return out


def gabor(cells: DataFrame, value: str, freqs: dict[float, float] = C.GABOR_FREQ, angles: int = 9, out: str = "gabor") -> DataFrame:
    """Weighted over frequencies, the strongest magnitude over angles. All kernels gather in one aggregation per frequency."""
    total = None
    for f, share in freqs.items():
        kernels = gabor_kernels(f, angles)
        offsets = sorted({o for k in kernels for o in k[0]})
        rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.array(*[num(k[p].get((i, j), 0.0)) for k in kernels for p in (0, 1)]).alias("w")) for i, j in offsets]
        each = cells.select("row_id", "col_id", F.coalesce(value, num(0)).alias("_v"), F.explode(F.array(*rows)).alias("o"))
        each = each.select((F.col("row_id") - F.col("o.i")).cast("int").alias("row_id"), (F.col("col_id") - F.col("o.j")).cast("int").alias("col_id"), "_v", "o.w")
        sums = each.groupBy("row_id", "col_id").agg(*[F.sum(F.col("_v") * F.col("w")[k]).alias(f"s{k}") for k in range(2 * angles)])
        best = F.greatest(*[F.sqrt(F.col(f"s{2 * k}") * F.col(f"s{2 * k}") + F.col(f"s{2 * k + 1}") * F.col(f"s{2 * k + 1}")) for k in range(angles)])
        part = cells.select("row_id", "col_id").join(sums.select("row_id", "col_id", (best * num(share)).alias("_g")), ["row_id", "col_id"])
        total = part if total is None else total.unionByName(part)
    return total.groupBy("row_id", "col_id").agg(F.sum("_g").alias(out))


def coherence(cells: DataFrame, value: str, sigma: float, rows: int, cols: int, out: str = "coherence") -> DataFrame:
    """((l1 - l2) / (l1 + l2))^2 of the structure tensor's eigenvalues after Gaussian smoothing."""
    g = cut(gradient(cells.withColumn("_z", F.coalesce(value, num(0))), "_z"), "gradients")
    done = None
    for name, a, b in (("xx", "dx", "dx"), ("xy", "dx", "dy"), ("yy", "dy", "dy")):
        part = gaussian(g.withColumn("_p", F.col(a) * F.col(b)), "_p", sigma, rows, cols, name)
        done = part if done is None else done.join(part, ["row_id", "col_id"])
    spread = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + num(4) * F.col("xy") * F.col("xy"))
    ratio = spread / (F.col("xx") + F.col("yy") + num(1e-8))
    return done.select("row_id", "col_id", (ratio * ratio).alias(out))


NEAR8 = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def erode(cells: DataFrame) -> DataFrame:
    """Cells whose 3 x 3 neighbourhood is all among the cells."""
    full = gather(cells.select("row_id", "col_id").withColumn("_one", num(1)), "_one", dict.fromkeys([(0, 0), *NEAR8], 1.0), "_n")
    return full.where("_n > 8.5").select("row_id", "col_id")


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Pairs (a, b) of adjacent cells by id row * 2^32 + col; by default all eight directions, each pair once."""
    offsets = offsets or [(0, 1), (1, 0), (1, 1), (1, -1)]
    key = lambda r, c: r.cast("long") * F.lit(1 << 32) + c.cast("long")
    sent = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    a = cells.select(key(F.col("row_id"), F.col("col_id")).alias("a"), "row_id", "col_id", sent.alias("o"))
    a = a.select("a", key(F.col("row_id") + F.col("o.i"), F.col("col_id") + F.col("o.j")).alias("b"))
    return a.hint("merge").join(cells.select(key(F.col("row_id"), F.col("col_id")).alias("b")).hint("merge"), "b").select("a", "b")


def remove_small(cells: DataFrame, least: int = C.OBJECT_MIN, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cells of components (4-neighbour by default) of `least` cells or more."""
    offsets = offsets or [(0, 1), (1, 0)]
    keyed = cells.select("row_id", "col_id", (F.col("row_id").cast("long") * F.lit(1 << 32) + F.col("col_id").cast("long")).alias("id"))
    comps = components(neighbours(cells, offsets)).select(F.col("node").alias("id"), "comp")
    named = keyed.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    big = named.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("comp")
    return named.join(big, "comp", "left_semi").select("row_id", "col_id")


def skeletonize(cells: DataFrame) -> DataFrame:
    """Thin to lines of one cell: two alternating passes (Zhang and Suen 1984) until nothing goes."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # p2..p9, clockwise from the north
    live = cut(cells.select("row_id", "col_id").distinct(), "thin")
    size = live.count()
    while True:  # every round takes a cell or ends
        for step in (0, 1):
            bits = gather(live.withColumn("_one", num(1)), "_one", {o: float(1 << k) for k, o in enumerate(ring)}, "_m")
            p = [F.col("_b").bitwiseAND(F.lit(1 << k)) != 0 for k in range(8)]
            bits = bits.withColumn("_b", F.coalesce("_m", num(0)).cast("long"))
            count = F.bit_count("_b")
            turns = sum((F.when(~p[k] & p[(k + 1) % 8], 1).otherwise(0) for k in range(8)), F.lit(0))
            n, e, s, w = p[0], p[2], p[4], p[6]
            open_ = ~(n & e & s) & ~(e & s & w) if step == 0 else ~(n & e & w) & ~(n & s & w)
            before, live = live, cut(bits.where(~(count.between(2, 6) & (turns == 1) & open_)).select("row_id", "col_id"), "thin")
            drop(before)
        now = live.count()
        if now == size:
            return live
        size = now


def first_valid(tiles: DataFrame, value: str, order: str) -> DataFrame:
    """Mosaic: of each cell the value of the first tile that has one."""
    return tiles.groupBy("row_id", "col_id").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def burn_last(cells: DataFrame, value: str, order: str) -> DataFrame:
    """Raster of lines' values; the last line over a cell wins."""
    return cells.groupBy("row_id", "col_id").agg(F.max_by(value, order).alias(value))

"""Lines against rasters and against one another: samples, scores, discoveries, agreement of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geometry import distance
from ..functions.scalars import confidence, num, over_max
from ..session import cut
from .raster import cell_of
from .spatial_join import segment_pairs

SEG = ("x1", "y1", "x2", "y2")


def line_length() -> Column:
    return distance(*[F.col(k) for k in SEG])


def line_samples(lines: DataFrame, key: str, step: float = C.SAMPLE_STEP) -> DataFrame:
    """(key, i, row_id, col_id): cells at every step along lines of two ends, the far end left out, one sample at least."""
    df = lines.withColumn("_len", line_length()).withColumn("_n", F.ceil(F.greatest("_len", num(step)) / num(step)))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    t = F.when(F.col("_len") > 0, F.least(num(1), F.col("i") * num(step) / F.nullif("_len", num(0)))).otherwise(num(0))
    row, col = cell_of(F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1")))
    return df.select(key, "i", row.alias("row_id"), col.alias("col_id"))


def along_lines(lines: DataFrame, key: str, layers: DataFrame, means: list[str], mode: str | None = None, step: float = C.SAMPLE_STEP) -> DataFrame:
    """Means of layers along each line (0 where nothing is known), and the most frequent value of one layer, the smallest on a tie."""
    met = line_samples(lines, key, step).join(layers, ["row_id", "col_id"], "left")
    aggs = [F.coalesce(F.avg(c), num(0)).alias(c) for c in means]
    if mode:
        aggs.append(F.mode(mode, True).alias(mode))
    return met.groupBy(key).agg(*aggs)


def at_centre(lines: DataFrame, key: str, layer: DataFrame, value: str) -> DataFrame:
    """The layer's value at each line's middle; 0 off the grid."""
    row, col = cell_of((F.col("x1") + F.col("x2")) / num(2), (F.col("y1") + F.col("y2")) / num(2))
    return lines.select(key, row.alias("row_id"), col.alias("col_id")).join(layer, ["row_id", "col_id"], "left").select(key, F.coalesce(value, num(0)).alias(value))


def network_scores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with <part>_norm over each column's maximum, arch_score and confidence; columns maps the weights' parts to columns."""
    most = df.agg(*[F.max(col).alias(f"_most_{part}") for part, col in columns.items()])  # one row
    df = df.join(F.broadcast(most)).withColumns({f"{part}_norm": over_max(F.col(col), F.col(f"_most_{part}")) for part, col in columns.items()}).drop(*most.columns)
    score = sum((num(w) * F.col(f"{part}_norm") for part, w in C.SCORE_WEIGHTS.items()), num(0))
    return df.withColumn("arch_score", score).withColumn("confidence", confidence(F.col("arch_score")))


def skeleton_scores(lines: DataFrame, key: str, layers: DataFrame, signal: str, stability: str) -> DataFrame:
    """(key, signal, stability, skel_score): means along each line, and their weighted sum rounded half to even."""
    told, (spec, stab) = along_lines(lines, key, layers, [signal, stability]), C.SKELETON_WEIGHTS
    return told.withColumn("skel_score", F.bround(num(spec) * F.col(signal) + num(stab) * F.col(stability), 4))


def nearest_line(segments: DataFrame, network: DataFrame, key: str, reach: float = 1000.0) -> DataFrame:
    """(key, _d): the distance to the nearest line of the network; the search radius grows until all segments have one."""
    lines, found, left = network.withColumnRenamed("line_id", "_line"), None, cut(segments, "segments")
    while not left.isEmpty() and not lines.isEmpty():
        near = cut(segment_pairs(left, key, lines, "_line", reach, reach / 5).groupBy(key).agg(F.min("dist").alias("_d")), "nearest")
        found = near if found is None else found.unionByName(near)
        left, reach = cut(left.where(F.col(key).isNotNull()).join(near, key, "left_anti"), "segments"), 4 * reach
    return segments.select(key, F.lit(None).cast("double").alias("_d")).limit(0) if found is None else found


def discoveries(segments: DataFrame, network: DataFrame, key: str, layers: DataFrame, signal: str, stability: str, reach: float = 1000.0) -> DataFrame:
    """Segments far from the network that are long and show a signal, ranked by score of their rounded figures (half to even).

    Without a network every such segment is far from it, and its distance is null.
    """
    near = nearest_line(segments, network, key, reach)
    told = along_lines(segments, key, layers, [signal, stability])
    df = segments.withColumn("_len", line_length()).join(near, key, "left").join(told, key)
    keep = (F.col("_len") >= C.DISCOVERY_LENGTH) & (F.col(signal) >= C.DISCOVERY_SIGNAL) & F.coalesce(F.col("_d") > C.DISCOVERY_DIST, F.lit(True))
    df = df.where(keep).select(key, F.bround("_len", 1).alias("seg_length_m"), F.bround("_d", 1).alias("dist_to_net_m"), F.bround(signal, 4).alias("spec_signal"), F.bround(stability, 4).alias("stability_mean"))
    most = df.agg(F.max("seg_length_m").alias("_most"))  # one row
    spec, stab, length = C.DISCOVERY_WEIGHTS
    score = num(spec) * F.col("spec_signal") + num(stab) * F.col("stability_mean") + num(length) * F.col("seg_length_m") / (F.col("_most") + num(1e-9))
    return df.join(F.broadcast(most)).withColumn("discovery_score", score).drop("_most")


def agrees_with_lines(segments: DataFrame, key: str, lines: DataFrame, radius: float = C.AGREE_DIST) -> DataFrame:
    """(key, agrees): whether a line of the other model is within radius; without lines none agrees."""
    near = segment_pairs(segments, key, lines.withColumnRenamed("line_id", "_line"), "_line", radius).select(key).distinct().withColumn("agrees", F.lit(True))
    return segments.select(key).join(near, key, "left").withColumn("agrees", F.coalesce("agrees", F.lit(False)))


def agrees_with_raster(segments: DataFrame, key: str, layer: DataFrame, value: str, share: float = C.AGREE_SHARE) -> DataFrame:
    """(key, agrees): whether the raster at the segment's middle has a share of its maximum."""
    most = layer.agg(F.coalesce(F.max(value), num(0)).alias("_m"))
    met = at_centre(segments, key, layer, value).join(F.broadcast(most))
    return met.select(key, (F.col(value) >= F.when(F.col("_m") > 0, F.col("_m") * num(share)).otherwise(num(0))).alias("agrees"))


def agreement(panels: dict[str, DataFrame]) -> DataFrame:
    """(panel, n_agree, total, pct) of several models."""
    out = None
    for name, df in panels.items():
        row = df.agg(F.lit(name).alias("panel"), F.count_if("agrees").alias("n_agree"), F.count("*").alias("total"), (F.avg(F.col("agrees").cast("double")) * num(100)).alias("pct"))
        out = row if out is None else out.unionByName(row)
    return out

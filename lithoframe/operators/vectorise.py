"""Skeleton cells to lines: chains of cells with two neighbours between ends and crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .graph import degrees
from .raster import neighbours


def skeleton_to_lines(cells: DataFrame, least: int = 1) -> DataFrame:
    """(chain, n_pixels, u, v): each chain of inner cells with the terminal cells at its ends; edges between two terminals are chains of no inner cell.

    Terminals are cells whose number of neighbours isn't two. A closed loop without a terminal has NULL ends.
    """
    edges = neighbours(cells)
    deg = degrees(edges)
    ends = deg.where("degree <> 2").select(F.col("node").alias("t"))
    side = lambda x: ends.select(F.col("t").alias(x), F.lit(True).alias(f"{x}_end"))
    marked = edges.join(side("a").hint("merge"), "a", "left").join(side("b").hint("merge"), "b", "left").select("a", "b", F.coalesce("a_end", F.lit(False)).alias("ta"), F.coalesce("b_end", F.lit(False)).alias("tb"))
    inner = marked.where("not ta and not tb").select("a", "b")
    nodes = deg.where("degree = 2").select("node")
    comps = nodes.join(components(inner).hint("merge"), "node", "left").select("node", F.coalesce("comp", "node").alias("chain"))
    touch = marked.where("ta != tb").select(F.when(F.col("ta"), F.col("b")).otherwise(F.col("a")).alias("node"), F.when(F.col("ta"), F.col("a")).otherwise(F.col("b")).alias("t"))
    reach = comps.join(touch.hint("merge"), "node").groupBy("chain").agg(F.min("t").alias("u"), F.max("t").alias("v"))
    size = comps.groupBy("chain").agg(F.count("*").alias("inner"))
    chains = size.join(reach.hint("merge"), "chain", "left").select("chain", (F.col("inner") + F.when(F.col("u").isNull(), 0).otherwise(2)).alias("n_pixels"), "u", "v")
    straight = marked.where("ta and tb").select(F.col("a").alias("chain"), F.lit(2).cast("long").alias("n_pixels"), F.col("a").alias("u"), F.col("b").alias("v"))
    return chains.unionByName(straight).where(F.col("n_pixels") >= least)

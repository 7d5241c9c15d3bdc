"""Connected components by contraction: every round each node joins its least neighbour in a random order, and edges shrink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop

SMALL = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for part in parts:
            for a, b in zip(part["a"], part["b"], strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        yield pd.DataFrame([(x, root(x)) for x in parent], columns=["node", "comp"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(run, f"node {kind}, comp {kind}")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, comp) for every node of edges(a, b); comp is the least node of the component.

    Up to `small` edges (they are counted) one task does it. Beyond, rounds of joins contract the graph until it is that small:
    in a round each node points at the least of itself and its neighbours in the order of a hash, pointers are followed once more,
    and edges move to what their ends point at. The order is new in every second round (a star takes two of one order), so about
    half of the nodes go whatever the shape and the numbering. Components come back through the rounds, the last one first, as
    labels carried along would meet in few hot keys. Nothing is collected.
    """
    live, rounds, least = cut(edges.select("a", "b").where("a != b").distinct(), "edges"), [], None
    while live.count() > small:  # the node of the least hash takes its neighbours, so every round takes nodes
        rank = lambda x: F.struct(F.xxhash64(F.lit(len(rounds) // 2), x).alias("h"), F.col(x).alias("id"))  # noqa: B023, E731  it is called at once
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = cut(both.groupBy("a").agg(F.min(rank("b")).alias("_r")).select("a", F.least("_r", rank("a"))["id"].alias("p")), "parents")
        parent = first.join(first.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p"))
        parent = cut(parent.withColumn("m", F.col("a")) if least is None else parent.join(least, "a"), "parents")
        least = cut(parent.groupBy(F.col("p").alias("a")).agg(F.min("m").alias("m")), "least")  # of the nodes that a new one stands for
        ends = live.join(parent.select("a", F.col("p").alias("na")), "a").join(parent.select(F.col("a").alias("b"), F.col("p").alias("nb")), "b")
        before, live = live, cut(ends.where("na != nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        drop(before, first)
        rounds.append((parent, least))
    found = _in_one_task(live)
    if not rounds:
        return found
    found = cut(found.join(least.select(F.col("a").alias("node"), "m"), "node"), "labels")
    found = found.join(found.groupBy("comp").agg(F.min("m").alias("_m")), "comp").select("node", F.col("_m").alias("comp"))
    for parent, least in reversed(rounds):
        of = least.join(found.select(F.col("node").alias("a"), "comp"), "a", "left").select(F.col("a").alias("p"), F.coalesce("comp", "m").alias("comp"))
        found = cut(parent.join(of, "p").select(F.col("a").alias("node"), "comp"), "labels")
    return found


def with_components(nodes: DataFrame, edges: DataFrame, key: str, out: str = "comp") -> DataFrame:
    """nodes with their component; a node without an edge is its own."""
    found = components(edges).select(F.col("node").alias(key), F.col("comp").alias(out))
    return nodes.join(found, key, "left").withColumn(out, F.coalesce(out, key))

"""Connected components of an undirected edge list, in Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the groups that the pairs a-b form; at most one per member."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[x], label[y]):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    for pdf in batches:
        a, b = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node reachable from each node.

    Batches of edges are first reduced to forests where they lie.  Then rounds of
    large-star and small-star steps follow, each one aggregation and one join, until
    the edge set stays the same: O(log^2 n) rounds, each written to the shared folder.
    Only (count, hash) of the edge set reaches the driver.  Nodes without an edge to
    another node do not appear.  Null ends are left out.
    """
    e = (edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
         .mapInPandas(_contract, "a long, b long").distinct())
    cur, mark = stored(e, "edges"), None
    while True:
        tally = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tally[0] == 0 or tuple(tally) == mark:
            break
        mark = tuple(tally)
        # large-star: larger neighbours of u move to the smallest of u and its neighbours
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small-star: smaller neighbours of u, and u itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("s"))
                 .select("s.*").filter("a <> b").distinct())
        cur = stored(small, "edges")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

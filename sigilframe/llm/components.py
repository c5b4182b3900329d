"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .stores import discard, keep, scope


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to its least node for each component of the links a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b.  Hook every neighbour of a node to the least one around it."""
    e = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    # The join shuffles anew, by a hash of the node, so that the planner can split a hub's edges.
    hooked = e.withColumn("h", F.xxhash64("a")).join(least.withColumn("h", F.xxhash64("node")), "h").filter("a = node")
    if large:
        out = hooked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (id, component), the least id reachable, for ids in a link with another.

    Null ids and loops are ignored; repeated links count once; no links give an empty table.
    Each round is written to the shared folder, so a lost executor costs one round at most; the
    number of rounds grows with the logarithm of a component's size.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    spark = links.sparkSession
    e = keep(e, "links")
    before = _state(e)
    while before[0]:
        old = e
        with scope(spark):  # a round's tables are not needed behind it
            e = keep(_star(_star(e, True), False), "links", outside=True)
        discard(spark, old.inputFiles()[0].rsplit("/", 1)[0])
        after = _state(e)
        if after == before:
            break
        before = after
    members = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

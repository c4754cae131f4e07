"""Distributed union-find over an edge table, with DataFrame operations only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rounds halve the nodes that are left, in expectation; 64 rounds are enough for any table.
MAX_ROUNDS = 64


def forest(edges: pa.Table) -> pa.Table:
    """(node, parent): the least node of each component, for a table of edges in memory."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (parent := up.setdefault(x, x)) != x:
            up[x] = x = up[parent]
        return x

    for u, v in zip(*(c.to_pylist() for c in edges.columns), strict=True):
        u, v = root(u), root(v)
        up[max(u, v)] = min(u, v)
    return pa.table({"node": pa.array(up, pa.int64()), "parent": pa.array([root(x) for x in up], pa.int64())})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local: int = 0) -> DataFrame:
    """(node, root) for every node that has an edge to another node.

    Each round hooks every node to whichever of itself and its neighbours comes first in an
    order drawn anew for the round, then contracts the hooked edges. A drawn order lets the
    table shrink by a constant factor whatever its shape (sorted chains included). Hubs are
    safe: the minimum over neighbours is combined before the shuffle. Self loops, repeated
    edges and edges with a null end are ignored; with no edge left the result is empty.
    Every round ends in a written table, so a lost executor repeats one round at most. Once at
    most ``local`` edges are left, the driver joins them at once; which node of a component is
    its root is open.
    """
    spark = edges.sparkSession
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    left = materialise(
        edges.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges"
    )
    found = spark.createDataFrame([], "node long, root long")
    for turn in range(MAX_ROUNDS):
        if left.isEmpty():
            return found
        if local and left.count() <= local:
            hooks = materialise(spark.createDataFrame(forest(left.toArrow())), "hooks").toDF("root", "parent")
            if turn == 0:
                return hooks.toDF("node", "root")
            ended = found.join(hooks, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
            return materialise(ended, "roots")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("n"))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy(F.col("u").alias("node")).agg(F.min(rank(F.col("v"))).alias("first"))
        hooks = materialise(
            hooks.select("node", F.least(F.col("first"), rank(F.col("node")))["n"].alias("parent")), "hooks"
        )
        ends = (
            left.join(hooks.toDF("u", "pu"), "u").join(hooks.toDF("v", "pv"), "v").where("pu <> pv")
        )
        before, left = left, materialise(
            ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges"
        )
        discard(before)
        if turn == 0:
            found = hooks.toDF("node", "root")
        else:
            settled, found = found, materialise(
                found.join(hooks.toDF("root", "parent"), "root", "left").select(
                    "node", F.coalesce("parent", "root").alias("root")
                ),
                "roots",
            )
            discard(settled, hooks)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

"""Connected components of an edge table, by repeated hooking and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut_few


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b), the smallest node of its component.

    Each round lets every node point to the smallest node among its neighbours and itself, follows these pointers to their
    end, and replaces the nodes of the edges by the ends; what joins two nodes of one end goes. The edges shrink fast (a node
    that isn't the smallest of its neighbourhood never comes back), so there are about log(n) rounds. Every round is cut off
    into the shared checkpoint folder; minima are combined before the shuffle. Once FEW_ROWS edges or less are left one task
    joins their nodes; larger components are never gathered in one.
    """
    left, seen = cut_few(edges.select("a", "b").where("a != b").distinct())
    steps: list[DataFrame] = []
    while seen["n"] > common.FEW_ROWS:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        up = _flatten(cut_few(up)[0])
        steps.append(up)
        ends_a = up.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        ends_b = up.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = left.join(ends_a, "a").join(ends_b, "b").select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b"))
        left, seen = cut_few(left.where("a != b").distinct())
    if not steps or seen["n"]:
        kind = left.schema["a"].dataType.simpleString()
        steps.append(left.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))
    found = steps[0]
    for up in steps[1:]:
        later = up.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = found.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (node, root). A node points to itself or to a smaller one."""
    above, kind = {}, pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for edge in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ends = []
            for x in edge:
                above.setdefault(x, x)
                while above[x] != x:
                    above[x] = above[above[x]]
                    x = above[x]
                ends.append(x)
            above[max(ends)] = min(ends)
    nodes = sorted(above)
    for x in nodes:
        above[x] = above[above[x]]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([above[x] for x in nodes], kind)], ["node", "root"])


def _flatten(up: DataFrame) -> DataFrame:
    """Pointers (node, root) followed to their ends, by doubling: every pass halves the longest path."""
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        jumped, seen = cut_few(jumped, F.count_if("moved").alias("moved"))
        up = jumped.select("node", "root")
        if not seen["moved"]:
            return up

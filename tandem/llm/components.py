"""Connected components of a graph by alternating large-star and small-star steps (a distributed union-find)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import stored


def _minimum(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; written, so that the join that follows can split a node of high degree."""
    return stored(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minimum")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each node and the smallest node that these edges join it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = np.fromiter(root, np.int64, len(root))
    tops = np.fromiter(map(find, root), np.int64, len(root))
    live = nodes != tops
    yield pa.RecordBatch.from_arrays([pa.array(nodes[live]), pa.array(tops[live])], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = 1_000_000) -> DataFrame:
    """(node, component) for each node of edges (u, v): the component is its smallest node.

    Only nodes with an edge to another node appear. First each task joins up to
    about task_edges edges by itself, which leaves at most one edge for each of its
    nodes; that is all where there are no more edges than that. Then come star
    steps, each a minimum with map-side combine and a join; nothing is gathered
    by node. A graph of diameter d settles in about log(d) rounds; should
    most_rounds not do, it raises an error.
    """
    links = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")  # u > v
    tasks = -(-links.count() // task_edges)
    forest = links.coalesce(max(1, tasks)).mapInArrow(_contracted, "u long, v long")
    links = stored(forest, "forest")
    for turn in range(most_rounds):
        roots = links.select(F.col("v").alias("node")).distinct()
        # settled when every node but the roots has one root: one task's stars, or no root is a node below another
        if (turn == 0 and tasks <= 1) or (turn and links.join(roots, links["u"] == roots["node"], "left_semi").isEmpty()):
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u to u's minimum
        large = both.join(_minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        # small star: u and its smaller neighbours to the smallest of them
        low = _minimum(large)
        near = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(near.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
    raise RuntimeError("the components did not settle")

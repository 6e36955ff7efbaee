"""Connected components of an edge table: forests of blocks of edges, then alternating large and small stars; every round is
written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, tidy

#: Edges that a worker contracts at once (16 MB, and about as much again for their forest).
BLOCK_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the roots, with its root: the smallest node that the edges reach from it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def contracted(links: DataFrame, block: int = BLOCK_EDGES) -> DataFrame:
    """Links (u, v) with the same components: every block of about block links is replaced by its forest."""

    @tidy
    def run(batches):
        def emptied():
            u, v = forest(*(np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield emptied()
                held, rows = [], 0
        if rows:
            yield emptied()

    return links.coalesce(-(-links.count() // block) or 1).mapInArrow(run, "u long, v long")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60, block: int = BLOCK_EDGES) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b: long); nodes without edges are absent.

    Every block of edges is first replaced by its forest, which leaves fewer rounds. Large star links every larger neighbour
    of a node to the smallest node around it, small star every smaller one, so that components become stars in a number of
    rounds that grows with the logarithm of their size. All steps are minima by key and joins on that key: a node with very
    many neighbours is one row a task in the minimum, and a skewed join that adaptive execution splits."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialize(contracted(materialize(links, "links"), block).distinct(), "links")
    seen = _state(links)
    for _ in range(most_rounds):
        # large star: around every node, larger neighbours link to the smallest of the neighbourhood
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = _state(links)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from random hyperplane buckets, compared block by block. A round of NN-descent
joins every node's neighbours, forward and reverse, with their vectors, compares them with each other and keeps what
improves a list. A query starts at its own node and its list; each round expands its best nodes that are not yet
expanded, joins their neighbours' vectors and keeps the best. All steps are joins by node and bounded lists, so neither
graph nor vectors are held by one process; the hyperplanes are the only thing that tasks share.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do rows with a
null vec_id; of vectors of several lengths those of the most frequent one take part (the longer of equals); rows that repeat
a vec_id and vector are one row, of several vectors for a vec_id the smallest counts; ties go to the smaller vec_id; a
table with fewer candidates gives all of them; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import BROADCAST_BYTES, broadcast_if_small, groups, materialize


@dataclass(frozen=True)
class Settings:
    """neighbours: length of the lists; sample: members of each direction compared in a round; bucket: rows of a block of
    the start; links: of a node that the search follows, forward and backward; beam, expand, hops: of the search."""

    neighbours: int = 40
    sample: int = 18
    trees: int = 8
    bucket: int = 192
    start: int = 10
    rounds: int = 3
    links: int = 64
    beam: int = 240
    expand: int = 40
    hops: int = 6
    seed: int = 7


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that take part, array<float> as it stands, other numbers as array<double>."""
    held = table.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding").cast("array<float>" if held == "array<float>" else "array<double>")
    rows = table.select("vec_id", vector.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    rows = rows.where("not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (usual[0]["n"] if usual else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(column) -> np.ndarray:
    """A list column of vectors of one length as an array in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _pairs(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "s"])


def best_lists(pairs: DataFrame, k: int) -> DataFrame:
    """a, b, s: of every a the k rows with the largest s, ties to the smaller b; equal pairs count once.

    One shuffle, by a: tasks cut their own rows to k places first, equal pairs share a place. Where blocks gave a pair two
    sums that differ in the last bit, it takes two places of the list."""
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    kept = pairs.select("a", "b", "s").withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k)
    return kept.groupBy("a", "b").agg(F.max("s").alias("s"))


def initial_pairs(nodes: DataFrame, n: int, dims: int, how: Settings) -> DataFrame:
    """Best pairs within blocks of the buckets of random hyperplanes through the mean vector."""
    bits = max(0, math.ceil(math.log2(max(1, n) / how.bucket)))
    trees = how.trees if bits else 1
    keep = how.start if bits else how.neighbours
    planes = np.random.default_rng(how.seed).standard_normal((trees, max(bits, 1), dims))

    def sums(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matrix(batch.column("vector")).sum(0)] if batch.num_rows else [], pa.list_(pa.float64()))], names=["total"])

    # a batch's sum is one row; tasks' sums are added before the driver sees them
    parts = nodes.select("vector").mapInArrow(sums, "total array<double>")
    total = parts.agg(*(F.sum(F.get("total", F.lit(i))) for i in range(dims))).first() if n else None
    mean = np.array(total, float) / n if n else np.zeros(dims)

    def code(batches):
        for batch in batches:
            v = matrix(batch.column("vector")) - mean
            for t in range(trees):
                c = ((v @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(c), batch.column("node"), batch.column("vector")], names=["tree", "code", "node", "vector"])

    coded = nodes.select("node", "vector").mapInArrow(code, f"tree int, code long, node long, vector {nodes.schema['vector'].dataType.simpleString()}")
    sizes = coded.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(4.0 * how.bucket)).cast("int").alias("parts"))
    blocks = coded.join(sizes, ["tree", "code"]).withColumn("key", F.xxhash64("tree", "code", F.pmod(F.xxhash64("node"), F.col("parts")))).select("key", "node", "vector")
    blocks = blocks.repartition("key").sortWithinPartitions("key", "node")

    def compare(batches):
        for table in groups(batches, ["key"]):
            key, node, v = table.column("key").to_numpy(), table.column("node").to_numpy(), matrix(table.column("vector"))
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            for lo, hi in zip(edge, [*edge[1:], len(key)], strict=True):
                if hi - lo < 2:
                    continue
                s = v[lo:hi] @ v[lo:hi].T
                np.fill_diagonal(s, -np.inf)
                k = min(keep, hi - lo - 1)
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield _pairs(np.repeat(node[lo:hi], k), node[lo:hi][near].ravel(), np.take_along_axis(s, near, 1).ravel())

    return blocks.mapInArrow(compare, "a long, b long, s double")


def descend(graph: DataFrame, nodes: DataFrame, turn: int, how: Settings) -> DataFrame:
    """One round: the graph's pairs and those found among neighbours of neighbours, cut to the lists' length."""
    ranked = graph.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b")))
    # nearest ones first, further ones by lot, another lot in every round
    chosen = F.when(F.col("rank") <= how.sample // 2, F.col("rank")).otherwise(how.sample + F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(1 << 20)))
    lot = ranked.withColumn("lot", chosen)
    forward = lot.withColumn("pick", F.row_number().over(Window.partitionBy("a").orderBy("lot", "b"))).where(F.col("pick") <= how.sample).select(F.col("a").alias("v"), F.col("b").alias("m"))
    reverse = lot.withColumn("pick", F.row_number().over(Window.partitionBy("b").orderBy("lot", "a"))).where(F.col("pick") <= how.sample).select(F.col("b").alias("v"), F.col("a").alias("m"))
    members = forward.unionByName(reverse).unionByName(nodes.select(F.col("node").alias("v"), F.col("node").alias("m"))).distinct()
    floors = graph.groupBy("a").agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("held"))
    floors = floors.select(F.col("a").alias("m"), F.when(F.col("held") >= how.neighbours, F.col("low")).otherwise(F.lit(float("-inf"))).alias("floor"))
    rows = members.join(nodes.select(F.col("node").alias("m"), "vector").join(floors, "m", "left"), "m")
    rows = rows.select("v", "m", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")).repartition("v").sortWithinPartitions("v", "m")

    def compare(batches):
        for table in groups(batches, ["v"]):
            v, m, floor, x = table.column("v").to_numpy(), table.column("m").to_numpy(), table.column("floor").to_numpy(), matrix(table.column("vector"))
            edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])).tolist()
            found = []
            for lo, hi in zip(edge, [*edge[1:], len(v)], strict=True):
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -np.inf)
                i, j = np.nonzero(s > floor[lo:hi, None])
                found.append((m[lo:hi][i], m[lo:hi][j], s[i, j]))
            if found:
                a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
                both = np.unique(np.stack([a, b], 1), axis=0, return_index=True)[1]
                yield _pairs(a[both], b[both], s[both])

    found = rows.mapInArrow(compare, "a long, b long, s double")
    return best_lists(graph.unionByName(found), how.neighbours)


def build_graph(nodes: DataFrame, how: Settings = Settings()) -> DataFrame:
    """a, b, s: every node's list of near nodes. nodes: node, vector."""
    first = nodes.select(F.size("vector").alias("d")).limit(1).collect()
    n = nodes.count()
    graph = materialize(best_lists(initial_pairs(nodes, n, first[0]["d"] if first else 1, how), how.neighbours), "graph")
    for turn in range(how.rounds if n > how.bucket else 0):
        graph = materialize(descend(graph, nodes, turn, how), "graph")
    return graph


def broadcast_vectors(rows: DataFrame) -> DataFrame:
    """Rows of an id and a vector, with the hint of a broadcast if all of them are known to be small."""
    n, length = rows.agg(F.count(F.lit(1)), F.max(F.size(rows.columns[1]))).first()
    return broadcast_if_small(rows, n * (8 * (length or 0) + 32), BROADCAST_BYTES)


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, how: Settings = Settings()) -> DataFrame:
    """q, node, s: the beam of every query (q: its node) after the last hop."""
    own = nodes.join(queries, nodes["node"] == queries["q"])
    asked = broadcast_vectors(own.select("q", F.col("vector").alias("qv")))
    square = F.expr("aggregate(vector, 0D, (acc, x) -> acc + cast(x as double) * cast(x as double))")
    pool = own.select("q", "node", square.alias("s"), F.lit(True).alias("done"))
    pool = pool.unionByName(graph.join(queries, graph["a"] == queries["q"]).select("q", F.col("b").alias("node"), "s", F.lit(False).alias("done")))
    pool = materialize(pool, "beam")
    best = Window.partitionBy("q").orderBy(F.desc("s"), "node")
    # the search also follows links backwards
    both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    lists = materialize(best_lists(both, how.links).select(F.col("a").alias("node"), F.col("b").alias("next")), "lists")
    vectors = broadcast_vectors(nodes.select("node", "vector"))
    for _ in range(how.hops):
        open_ = pool.where("not done").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= how.expand).select("q", "node")
        seen = pool.select("q", "node")
        steps = open_.join(lists, "node").select("q", F.col("next").alias("node")).distinct().join(seen, ["q", "node"], "left_anti")
        rows = steps.join(vectors, "node").join(asked, "q")

        def score(batches):
            for batch in batches:
                s = np.einsum("ij,ij->i", matrix(batch.column("vector")), matrix(batch.column("qv")))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(s)], names=["q", "node", "s"])

        found = rows.select("q", "node", "vector", "qv").mapInArrow(score, "q long, node long, s double").withColumn("done", F.lit(False))
        # the same order as open_'s, so the same nodes are marked, without a join
        place = F.row_number().over(Window.partitionBy("q", "done").orderBy(F.desc("s"), "node"))
        marked = pool.repartition("q").select("q", "node", "s", (F.col("done") | (place <= how.expand)).alias("done"))
        pool = marked.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= how.beam).drop("rank")
        pool = materialize(pool, "beam")
    return pool.select("q", "node", "s")


def search(table: DataFrame, k: int = 20, every: int = 20, how: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose vec_id is divisible by every, the k nearest other rows found."""
    rows = materialize(valid_vectors(table), "vectors")
    nodes = materialize(rows.groupBy("vector").agg(F.min("vec_id").alias("node")).select("node", "vector"), "nodes")
    members = rows.join(nodes, "vector").select("vec_id", "node")
    members = materialize(members, "members")
    graph = build_graph(nodes, how)
    asked = members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    beam = greedy_search(asked.select("q").distinct(), graph, nodes, how)
    # of a node's copies the k + 1 smallest ids can be among the nearest of a query
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1).select("vec_id", "node")
    near = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    found = beam.join(few, "node").withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    out = asked.join(found, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("s").alias("score"))

"""Approximate nearest neighbours: a graph by NN-descent, searched greedily from several starts.

Equal vectors are one node (its members are found again at the end), so copies cannot fill each other's neighbour lists.
A first graph comes from random-projection trees: their splits are fitted on a bounded sample of SAMPLE vectors, every
vector is dealt to a leaf of every tree, and leaves are searched exactly, large ones in blocks of a bounded size. Then
NN-descent: in each round every node meets its neighbours and reverse neighbours (the nearest DEGREE of them) in one
Spark join, all pairs that meet are measured, and a node keeps the DEGREE nearest it has seen. Only measurements
that improve on a node's worst neighbour are sent on. Queries start at vectors of their own leaves and walk: each step joins
the nearest unvisited nodes of the beam with their neighbours and all their reverse neighbours (in lists of LIST at most).
A query walks until a step brings no new one of its SETTLED nearest, or its beam holds no unvisited node. The beam grows
with the logarithm of the number of nodes.

Distances within the graph are measured in single precision; results are measured again in double precision.

Defined cases: vectors that are null, all zero, or hold null, NaN or infinite components take no part; shorter vectors count
as padded with zeros; rows that repeat an id are candidates each, but not of queries with that id, whose rows are ranked
together; equal distances are ordered by id; fewer candidates than k are all returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import saved, table

K, DEGREE, TREES, LEAF, ROUNDS = 10, 24, 8, 200, 3
SAMPLE, BLOCK = 20_000, 2048
BEAM, STARTS, LIST = 200, 32, 1024
#: A walk ends when a step changes none of a query's SETTLED nearest.
SETTLED = 32


class Trees:
    """Random-projection trees with median splits, kept as arrays."""

    def __init__(self, sample: np.ndarray, leaf_share: float, trees: int, seed: int = 11):
        self.trees = []
        rng = np.random.default_rng(seed)
        depth = max(0, math.ceil(math.log2(max(1.0, 1 / leaf_share)))) if len(sample) else 0
        depth = min(depth, max(0, int(math.log2(max(1, len(sample) / 8)))))
        for _ in range(trees):
            planes = np.zeros(((1 << depth) - 1, sample.shape[1] if len(sample) else 0), np.float32)
            cuts = np.zeros((1 << depth) - 1, np.float32)
            leaf = np.zeros(len(sample), np.int64)
            for node in range(len(cuts)):
                own = np.flatnonzero(leaf == node)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    d = sample[a] - sample[b]
                    planes[node] = d if np.any(d) else rng.standard_normal(sample.shape[1])
                    side = sample[own] @ planes[node]
                    cuts[node] = np.median(side)
                    leaf[own] = 2 * node + 1 + (side > cuts[node])
            self.trees.append((planes, cuts))
        self.depth = depth

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """One column of leaf numbers for each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        for t, (planes, cuts) in enumerate(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, planes[node]) > cuts[node])
            out[:, t] = node
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(raw):
        return np.zeros((0, 0), np.float32)
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(raw.type) else np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(data, "<f4", (int(at[-1]) - int(at[0])) // 4, int(at[0])).reshape(len(raw), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(-1)[..., :, None] + (y**2).sum(-1)[..., None, :] - 2 * np.matmul(x, np.swapaxes(y, -1, -2)), 0)


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """id, v (array<double>), padded with zeros to one length."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists(x, lambda v: v != 0))
    width = good.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("w")).first().w
    return good.select(F.col("vec_id").cast("long").alias("id"), F.concat(x, F.array_repeat(F.lit(0.0), F.lit(width) - F.size("embedding"))).alias("v"))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node (smallest id of equal vectors), v, packed (single precision)."""
    packed = lambda it: (pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), pa.array([np.array(v, "<f4").tobytes() for v in b.column("v").to_pylist()], pa.binary())], ["node", "v", "packed"]) for b in it)
    return vectors.groupBy("v").agg(F.min("id").alias("node")).select("node", "v").mapInArrow(packed, "node long, v array<double>, packed binary")


def fit_trees(nodes: DataFrame, n: int) -> Trees:
    share = min(1.0, SAMPLE / max(n, 1) * 1.1)
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * share)).select("packed").limit(SAMPLE).collect() if n else []  # at most SAMPLE rows
    x = np.stack([np.frombuffer(r.packed, "<f4") for r in sample]) if sample else np.zeros((0, 0), np.float32)
    return Trees(x, LEAF / max(n, LEAF), TREES)


def dealt(nodes: DataFrame, trees: Trees) -> DataFrame:
    """node, packed, tree, leaf: every node once for each tree."""
    shared = nodes.sparkSession.sparkContext.broadcast(trees)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.leaves(_vectors(batch.column("packed")))
            for t in range(found.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("packed"), pa.array(np.full(len(found), t, np.int32)), pa.array(found[:, t])], ["node", "packed", "tree", "leaf"])

    return nodes.select("node", "packed").mapInArrow(leaves, "node long, packed binary, tree int, leaf int")


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = _squares(x, x)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    top = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
    return ids[top], np.take_along_axis(d, top, 1)


def leaf_neighbours(leaves: DataFrame, degree: int) -> DataFrame:
    """node, other, d: each node's nearest within its leaf; a leaf above BLOCK is cut into blocks by hash."""
    sizes = leaves.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / BLOCK).alias("parts"))
    blocks = leaves.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids, x = pdf["node"].to_numpy(), np.frombuffer(b"".join(pdf["packed"]), "<f4").reshape(len(pdf), -1)
        other, d = _nearest(ids, x, degree)
        return pd.DataFrame({"node": np.repeat(ids, other.shape[1]), "other": other.ravel(), "d": d.ravel().astype(np.float32)})

    return blocks.groupBy("tree", "leaf", "part").applyInPandas(search, "node long, other long, d float")


def keep_nearest(pairs: DataFrame, degree: int) -> DataFrame:
    best = Window.partitionBy("node").orderBy("d", "other")
    return pairs.repartition("node").groupBy("node", "other").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= degree).drop("r")


def descend(graph: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """One round of NN-descent over ``graph`` (node, other, d)."""
    near = Window.partitionBy("centre").orderBy("d", "member")
    back = graph.select(F.col("other").alias("centre"), F.col("node").alias("member"), "d").withColumn("r", F.row_number().over(near)).where(F.col("r") <= degree).select("centre", "member")
    meet = graph.select(F.col("node").alias("centre"), F.col("other").alias("member")).union(back).distinct()
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
    members = meet.join(nodes.select(F.col("node").alias("member"), "packed"), "member").join(worst.withColumnRenamed("node", "member"), "member", "left")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _by_key(batches, "centre"):
            ids, worst_of = pdf["member"].to_numpy(), pdf["worst"].fillna(np.inf).to_numpy(np.float32)
            x = np.frombuffer(b"".join(pdf["packed"]), "<f4").reshape(len(pdf), -1)
            cut = np.flatnonzero(np.diff(pdf["centre"].to_numpy())) + 1
            first, size = np.append(0, cut), np.diff(np.concatenate([[0], cut, [len(pdf)]]))
            a_all, b_all, d_all = [], [], []
            for m in np.unique(size[size > 1]).tolist():  # groups of one size are measured together
                for part in np.array_split(first[size == m], max(1, int((size == m).sum()) * m * m // 2_000_000)):
                    at = part[:, None] + np.arange(m)
                    d = _squares(x[at], x[at]).astype(np.float32)
                    better = (d < worst_of[at][:, :, None]) & ~np.eye(m, dtype=bool)
                    g, i, j = np.nonzero(better)
                    a_all.append(ids[at[g, i]])
                    b_all.append(ids[at[g, j]])
                    d_all.append(d[g, i, j])
            if a_all:
                a, b, d = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(d_all)
                pairs, where = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(d[where])], ["node", "other", "d"])

    found = members.repartition("centre").sortWithinPartitions("centre").mapInArrow(measure, "node long, other long, d float")
    return keep_nearest(graph.unionByName(found), degree)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``key`` that never part the rows of one key."""
    rest = None
    for batch in batches:
        pdf = batch.to_pandas()
        if rest is not None and len(rest):
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = int(np.searchsorted(pdf[key].to_numpy(), pdf[key].iloc[-1]))
        rest, pdf = pdf.iloc[last:], pdf.iloc[:last]
        if len(pdf):
            yield pdf.reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def build_graph(nodes: DataFrame, leaves: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """node, other, d."""
    graph = saved(keep_nearest(leaf_neighbours(leaves, -(-degree // 2)), degree), "graph")
    for _ in range(rounds):
        graph = saved(descend(graph, nodes, degree), "graph")
    return graph


def beam_of(n: int) -> int:
    """BEAM up to 10,000 nodes, a third of it more each time that they double."""
    return int(BEAM * (1 + math.log2(max(1.0, n / 10_000)) / 3))


def lists_of(graph: DataFrame) -> DataFrame:
    """node, others: its neighbours and reverse neighbours; those of a hub take several rows of about LIST."""
    edges = graph.select("node", "other").union(graph.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    hubs = edges.groupBy("node").count().where(F.col("count") > LIST).select("node", F.ceil(F.col("count") / LIST).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("other"), F.col("parts")), F.lit(0))
    return edges.join(hubs, "node", "left").groupBy("node", part.alias("part")).agg(F.collect_list("other").alias("others")).select("node", "others")


def walk(queries: DataFrame, leaves: DataFrame, graph: DataFrame, nodes: DataFrame, size: int = BEAM) -> DataFrame:
    """query, node: the ``size`` nearest nodes that each query's greedy walk has met. queries: query, node (its own), packed."""
    lists = saved(lists_of(graph), "lists")
    first = Window.partitionBy("tree", "leaf").orderBy(F.xxhash64("node"))
    entries = leaves.select("tree", "leaf", "node").withColumn("r", F.row_number().over(first)).where(F.col("r") <= STARTS).drop("r")
    own = leaves.select("tree", "leaf", "node").join(queries.select("query", "node"), "node").select("query", "tree", "leaf")
    new = own.join(entries, ["tree", "leaf"]).select("query", "node").distinct()
    beam = None
    best = Window.partitionBy("query").orderBy("d", "node")
    vectors = queries.select("query", F.col("packed").alias("q"))

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _vectors(batch.column("packed")), _vectors(batch.column("q"))
            d = ((x - y) ** 2).sum(1) if len(x) else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(d.astype(np.float32))], ["query", "node", "d"])

    while True:
        measured = new.join(nodes.select("node", "packed"), "node").join(vectors, "query").mapInArrow(distance, "query long, node long, d float").withColumn("visited", F.lit(False)).withColumn("fresh", F.lit(True))
        every = measured if beam is None else beam.unionByName(measured)
        met = every.repartition("query").groupBy("query", "node").agg(F.min("d").alias("d"), F.max("visited").alias("visited"), F.min("fresh").alias("fresh"))
        ranked = met.withColumn("r", F.row_number().over(best)).withColumn("turn", F.sum((~F.col("visited")).cast("int")).over(best)).where(F.col("r") <= size)
        moved = F.max(F.col("fresh") & (F.col("r") <= SETTLED)).over(Window.partitionBy("query"))
        beam = saved(ranked.withColumn("next", ~F.col("visited") & (F.col("turn") <= size // 4) & moved).select("query", "node", "d", "visited", "next"), "beam")
        if beam.where("next").isEmpty():
            return beam.select("query", "node")
        new = beam.where("next").join(lists.select("node", "others"), "node").select("query", F.explode("others").alias("node")).distinct()
        beam = beam.select("query", "node", "d", (F.col("visited") | F.col("next")).alias("visited"), F.lit(False).alias("fresh"))


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, id, score for the ids that fulfil ``is_query``; vectors: id, v."""
    nodes = saved(nodes_of(vectors), "nodes")
    n = nodes.count()
    trees = fit_trees(nodes, n)
    leaves = saved(dealt(nodes, trees), "leaves")
    graph = build_graph(nodes, leaves)
    members = saved(vectors.join(nodes.select("v", "node"), "v").select("id", "node"), "members")
    asked = members.where(is_query).select(F.col("id").alias("query_id"), "node").distinct()
    # equal queries walk once
    queries = asked.select("node").distinct().join(nodes.select("node", "packed"), "node").select(F.col("node").alias("query"), "node", "packed")
    found = walk(queries, leaves, graph, nodes, beam_of(n))
    own = members.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first().n  # rows that a query leaves out at most
    # a node's k + own smallest ids are enough: later members never come before them
    of_node = Window.partitionBy("node").orderBy("id")
    few = members.withColumn("r", F.row_number().over(of_node)).where(F.col("r") <= k + own).drop("r")
    pairs = found.join(nodes.select("node", "v"), "node").join(nodes.select(F.col("node").alias("query"), F.col("v").alias("qv")), "query")
    score = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    # the k + own nearest nodes of a query hold its k nearest rows, whichever of them are its own
    near = Window.partitionBy("query").orderBy("score", "node")
    best = pairs.select("query", "node", score.alias("score")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + own).drop("r")
    scored = best.join(few, "node").join(asked.withColumnRenamed("node", "query"), "query").where(F.col("id") != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy("score", "id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op4_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = saved(clean_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    found = nearest(vectors, F.pmod(F.col("id"), F.lit(100)) == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

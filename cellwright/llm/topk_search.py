"""Exact top-k inner-product search by block-at-a-time pruning.

Rows are dealt over document ranges of bounded size; inside a range they are ordered by locality and cut into blocks.
A block keeps, for every term (vector component), its largest and smallest weight. A query's bound for a block is the
sum over its terms of weight times that maximum (minimum, where the query's weight is negative). Blocks are taken in
order of falling bounds and scored through their forward index until the next bound is below the k-th score so far;
a bound that equals it is still scored, for ties go to the smaller id.

Queries and rows meet in a grid: groups of at most about QUERIES queries against ranges of about ROWS rows. Every
cell has a bounded size, returns k rows a query, and a window merges them.

Defined cases: vectors that are null, or hold null, NaN or infinite components, take no part; rows that repeat an id are
candidates each, but not of queries with that id, whose rows are ranked together; shorter vectors count as padded with zeros; an empty table gives no rows;
equal scores are ordered by id; other columns are ignored. Scores are exact while they fit into a long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import saved, table

ROWS, QUERIES, BLOCK = 4096, 2048, 64


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    if all(len(x) == width for x in lists):
        return np.stack(lists.to_list()).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def block_max_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of each query's best k rows but its own, -1 as id where there are fewer; and the pairs scored."""
    peak = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float64 if peak < 2**53 else np.int64  # both are exact; floats multiply faster
    low = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    pivots = rows[np.argsort(ids, kind="stable")][:: max(1, len(rows) // 32)].astype(np.float64)
    near = np.argmin((pivots**2).sum(1) - 2 * (rows.astype(np.float64) @ pivots.T), axis=1)
    order = np.lexsort((ids, near))
    rows, ids, q = rows[order].astype(kind), ids[order], queries.astype(kind)
    cuts = np.arange(0, len(rows), block)
    high, least = np.maximum.reduceat(rows, cuts, axis=0), np.minimum.reduceat(rows, cuts, axis=0)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ least.T
    best, best_ids, scored = np.full((len(q), k), low, kind), np.full((len(q), k), np.iinfo(np.int64).max), 0
    turn = np.argsort(-bounds, axis=1, kind="stable")
    for r in range(len(cuts)):
        which = turn[:, r]
        alive = np.flatnonzero((bounds[np.arange(len(q)), which] >= best[:, -1]))
        if not len(alive):
            break
        for b in np.unique(which[alive]):
            who, part = alive[which[alive] == b], slice(cuts[b], cuts[b] + block)
            s = q[who] @ rows[part].T
            s[query_ids[who][:, None] == ids[part][None, :]] = low
            scored += s.size
            all_s, all_i = np.hstack([best[who], s]), np.hstack([best_ids[who], np.broadcast_to(ids[part], s.shape)])
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    return best, np.where(best > low, best_ids, -1), scored


def exact_topk(vectors: DataFrame, is_query, k: int, rows_per_range: int = ROWS, queries_per_group: int = QUERIES) -> DataFrame:
    """vectors: ``id`` long, ``codes`` array<long>. is_query: a condition on ``id``.

    Returns query_id, rank (from 1), id, score.
    """
    size = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("codes")).alias("w")).first()
    ranges, groups, width = max(1, math.ceil(size.n / rows_per_range)), max(1, math.ceil(size.q / queries_per_group)), size.w or 0
    place = lambda n: F.pmod(F.xxhash64("id", "codes"), F.lit(n)).cast("int")
    rows = vectors.select("id", "codes", place(ranges).alias("range"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    queries = vectors.where(is_query).select("id", "codes", place(groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"))

    def cell(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        s, i, _ = block_max_topk(_matrix(q.codes, width), q.id.to_numpy(), _matrix(d.codes, width), d.id.to_numpy(), k)
        found = i.ravel() >= 0 if (d.id >= 0).all() else s.ravel() > (np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf)
        return pd.DataFrame({"query_id": np.repeat(q.id.to_numpy(), k)[found], "id": i.ravel()[found], "score": s.ravel()[found].astype(np.int64)})

    met = queries.groupBy("group", "range").cogroup(rows.groupBy("group", "range")).applyInPandas(cell, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, codes: floor(scale * x) of every vector without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("codes"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = saved(integer_vectors(table(spark, sf_dir, "embeddings")), "codes")
    found = exact_topk(vectors, F.pmod(F.col("id"), F.lit(50)) == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.c, d.c)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

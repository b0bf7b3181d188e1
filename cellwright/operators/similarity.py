"""How alike tools are, and which to combine. All pairwise measures come from one aggregation over the votes."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio, round0, safe_ln
from cellwright.operators.detect import with_scores
from cellwright.operators.evaluate import evaluate_tools, vote_patterns, with_all_scores
from cellwright.operators.votes import PATTERNS
from cellwright.session import saved


def contingency(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, n_a, n_b, n_ab, agree of every two columns of 0 and 1."""
    pairs = list(itertools.combinations(columns, 2))
    row = matrix.agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(f"n{i}") for i, c in enumerate(columns)], *[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)])
    at = {c: i for i, c in enumerate(columns)}
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{at[a]}").alias("n_a"), F.col(f"n{at[b]}").alias("n_b"), F.col(f"m{i}").alias("n_ab")) for i, (a, b) in enumerate(pairs)])
    return row.select("n", F.explode(parts).alias("r")).select("n", "r.*").withColumn("agree", F.col("n") - F.col("n_a") - F.col("n_b") + 2 * F.col("n_ab"))


def _pmi():
    return round0(safe_ln(ratio(F.col("n_ab") * F.col("n"), F.col("n_a") * F.col("n_b"))), 2)


def _kappa():
    n = F.col("n").cast("double")
    chance = (F.col("n_a") / n) * (F.col("n_b") / n) + (1 - F.col("n_a") / n) * (1 - F.col("n_b") / n)
    return round0(ratio(F.col("agree") / n - chance, 1 - chance), 4)


def _cosine():
    return round0(ratio(F.col("n_ab"), F.sqrt(F.col("n_a").cast("double")) * F.sqrt(F.col("n_b").cast("double"))), 4)


def pairwise_pmi(matrix: DataFrame, tools: list[str]) -> DataFrame:
    return contingency(matrix, tools).select("a", "b", _pmi().alias("pmi"))


def pairwise_kappa(matrix: DataFrame, tools: list[str], least: float = 0.1) -> DataFrame:
    return contingency(matrix, tools).select("a", "b", _kappa().alias("kappa")).where(F.col("kappa") >= least)


def pairwise_cosine(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """Also between the label and each tool."""
    return contingency(matrix, ["label", *tools]).select("a", "b", _cosine().alias("cosine"))


def pairwise_similarity(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """All three, on votes or on a truth matrix."""
    return contingency(matrix, tools).select("a", "b", _pmi().alias("pmi"), _kappa().alias("kappa"), _cosine().alias("cosine"))


def tool_precision(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """tool, precision (3 digits)."""
    return evaluate_tools(matrix, tools).select(F.col("name").alias("tool"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3).alias("precision"))


def tool_subsets(spark: SparkSession, tools: list[str], least: int) -> DataFrame:
    """tools (comma-separated), members: every combination of at least ``least`` tools, numbered by Spark; nothing is listed on the driver."""
    chosen = F.filter(F.array(*[F.when(F.getbit("id", F.lit(i)) == 1, F.lit(t)) for i, t in enumerate(tools)]), lambda t: t.isNotNull())
    return spark.range(1, 1 << len(tools)).where(F.bit_count("id") >= least).select(chosen.alias("members")).select(F.array_join("members", ",").alias("tools"), "members")


def evaluate_subsets(matrix: DataFrame, tools: list[str], subsets: DataFrame) -> DataFrame:
    """tools, k, tp, fp, fn and scores of every set of ``subsets`` (tools, members) with min-1 (union) to min-size.

    The sets meet the counted vote patterns alone. Up to PATTERNS patterns are broadcast; there are at most 2 ** (tools + 1).
    """
    counted = saved(vote_patterns(matrix, tools), "patterns")
    votes = F.create_map(*[x for t in tools for x in (F.lit(t), F.col(t).cast("int"))])
    small = counted.select("label", "n", votes.alias("votes"))
    small = F.broadcast(small) if counted.count() <= PATTERNS else small
    said = F.aggregate("members", F.lit(0), lambda s, m: s + F.when(F.element_at("votes", m) == 1, 1).otherwise(0))
    each = subsets.join(small).withColumn("said", said).groupBy("tools", "said", F.size("members").alias("size")).agg(*[F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).alias(name) for name, w in (("wrong", F.col("label") == 1), ("right", F.col("label") != 1))])
    by_k = each.withColumn("k", F.explode(F.sequence(F.lit(1), "size")))
    counts = by_k.groupBy("tools", "k").agg(*[F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(name) for name, c, w in (("tp", "wrong", F.col("said") >= F.col("k")), ("fp", "right", F.col("said") >= F.col("k")), ("fn", "wrong", F.col("said") < F.col("k")))])
    return with_scores(counts)


def evaluate_tool_sets(matrix: DataFrame, tools: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """``evaluate_subsets`` of a few sets."""
    return evaluate_subsets(matrix, tools, matrix.sparkSession.createDataFrame([(",".join(s), list(s)) for s in sets], "tools string, members array<string>"))


def brute_force(matrix: DataFrame, tools: list[str], least: int = 2) -> DataFrame:
    """Every combination of at least ``least`` tools."""
    return evaluate_subsets(matrix, tools, tool_subsets(matrix.sparkSession, tools, least))


def naive_bayes_subsets(train: DataFrame, test: DataFrame, tools: list[str], subsets: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """tools, tp, fp, fn and scores on ``test`` of a Bernoulli naive Bayes model for every set of ``subsets`` (tools, members).

    A tool's evidence does not depend on the others in the combination: one aggregation of ``train`` gives every tool's log
    odds for a vote and for its absence, and every model is a sum of those over its tools. The models meet the counted vote
    patterns of ``test``, so work beyond the two passes does not grow with cells.
    """
    n = lambda label, c: F.count_if((F.col("label") == 1) == label if c is None else ((F.col("label") == 1) == label) & (F.col(c) == 1)).cast("double")
    counts = train.agg(n(True, None).alias("n1"), n(False, None).alias("n0"), *[n(y, t).alias(f"{i}_{int(y)}") for i, t in enumerate(tools) for y in (True, False)])
    share = lambda i, y: (F.col(f"{i}_{y}") + smoothing) / (F.col(f"n{y}") + 2 * smoothing)
    odds = [F.struct(F.lit(t).alias("tool"), (F.ln(share(i, 1)) - F.ln(share(i, 0))).alias("yes"), (F.ln(1 - share(i, 1)) - F.ln(1 - share(i, 0))).alias("no")) for i, t in enumerate(tools)]
    model = counts.select(F.map_from_entries(F.transform(F.array(*odds), lambda r: F.struct(r["tool"], r))).alias("odds"), (F.ln(F.col("n1") + smoothing) - F.ln(F.col("n0") + smoothing)).alias("prior"))  # one row
    votes = F.create_map(*[x for t in tools for x in (F.lit(t), F.col(t).cast("int"))])
    counted = saved(vote_patterns(test, tools), "patterns")
    small = counted.select("label", "n", votes.alias("votes"))
    small = F.broadcast(small) if counted.count() <= PATTERNS else small
    each = subsets.join(small).join(F.broadcast(model))
    evidence = lambda m: F.when(F.element_at("votes", m) == 1, F.element_at("odds", m)["yes"]).otherwise(F.element_at("odds", m)["no"])
    scored = each.withColumn("flagged", F.aggregate("members", F.lit(0.0), lambda s, m: s + evidence(m)) + F.col("prior") > 0)
    of = {"tp": F.col("flagged") & (F.col("label") == 1), "fp": F.col("flagged") & (F.col("label") != 1), "fn": ~F.col("flagged") & (F.col("label") == 1)}
    return with_scores(scored.groupBy("tools").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in of.items()]))


def brute_force_naive_bayes(train: DataFrame, test: DataFrame, tools: list[str], least: int = 2) -> DataFrame:
    """``naive_bayes_subsets`` of every combination of at least ``least`` tools."""
    return naive_bayes_subsets(train, test, tools, tool_subsets(train.sparkSession, tools, least))


def best_k(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """The k most precise tools for k = 2 .. n-1; equal precisions by name."""
    ranked = sorted(tool_precision(matrix, tools).collect(), key=lambda r: (-r.precision, r.tool))
    names = [r.tool for r in ranked]
    return evaluate_tool_sets(matrix, tools, [tuple(names[:k]) for k in range(2, len(tools))])


def pmi_tool_sets(matrix: DataFrame, tools: list[str], inverse: bool = False, most: int = 5) -> DataFrame:
    """The tools of the first 1 .. ``most`` pairs by falling (rising, if inverse) PMI."""
    pairs = sorted(pairwise_pmi(matrix, tools).collect(), key=lambda r: (r.pmi if inverse else -r.pmi, r.a, r.b))
    sets = []
    for i in range(1, min(most, len(pairs)) + 1):
        s = tuple(sorted({t for r in pairs[:i] for t in (r.a, r.b)}))
        if s not in sets:
            sets.append(s)
    return evaluate_tool_sets(matrix, tools, sets)


def precision_orderings(matrix: DataFrame, tools: list[str], deltas: tuple[float, ...]) -> DataFrame:
    """delta, the scores of ``precision_ordering`` at that delta, and its tools in order.

    All rounds of all deltas read the counted vote patterns, at most 2 ** (tools + 1) rows, instead of the cells.
    """
    patterns = saved(matrix.groupBy("label", *tools).agg(F.count("*").alias("n_")), "patterns")
    out = []
    for delta in deltas:
        order: list[str] = []
        while len(order) < len(tools):
            rest = sorted(set(tools) - set(order))
            free = reduce(lambda a, b: a & b, [F.col(t) != 1 for t in order], F.lit(True))
            hits = [F.coalesce(F.sum(F.when(F.col(t) == 1, F.col("n_"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(rest)]
            right = [F.coalesce(F.sum(F.when((F.col(t) == 1) & (F.col("label") == 1), F.col("n_"))), F.lit(0)).alias(f"tp{i}") for i, t in enumerate(rest)]
            counts = patterns.where(free).agg(*hits, *right).first()
            i = max(range(len(rest)), key=lambda i: counts[f"tp{i}"] / counts[f"n{i}"] if counts[f"n{i}"] else 0.0)
            if not counts[f"n{i}"] or counts[f"tp{i}"] / counts[f"n{i}"] < delta:
                break
            order.append(rest[i])
        yes = reduce(lambda a, b: a | b, [F.col(t) == 1 for t in order], F.lit(False))
        names = {"tp": yes & (F.col("label") == 1), "fp": yes & (F.col("label") != 1), "fn": ~yes & (F.col("label") == 1), "tn": ~yes & (F.col("label") != 1)}
        out.append(patterns.agg(*[F.coalesce(F.sum(F.when(c, F.col("n_"))), F.lit(0)).alias(k) for k, c in names.items()]).select(F.lit(float(delta)).alias("delta"), "*", F.lit(",".join(order)).alias("tools")))
    return with_all_scores(reduce(DataFrame.unionByName, out))


def k_best_path(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """step, tool, hits: begins with the tool of most hits; each next one makes the largest union with the one before."""
    rows = contingency(matrix, tools).collect()  # one row a pair of tools
    hits = {r.a: r.n_a for r in rows} | {r.b: r.n_b for r in rows}
    union = {frozenset((r.a, r.b)): r.n_a + r.n_b - r.n_ab for r in rows}
    path = [min(tools, key=lambda t: (-hits.get(t, 0), t))]
    gains = [hits.get(path[0], 0)]
    while len(path) < len(tools):
        nxt = min((t for t in tools if t not in path), key=lambda t: (-union[frozenset((path[-1], t))], t))
        gains.append(union[frozenset((path[-1], nxt))])
        path.append(nxt)
    return matrix.sparkSession.createDataFrame([(i, t, int(g)) for i, (t, g) in enumerate(zip(path, gains), 1)], "step int, tool string, hits long")


def tool_distances(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """a, b, distance: the number of cells on which two tools differ (squared Euclidean distance of their vote columns)."""
    return contingency(matrix, tools).select("a", "b", (F.col("n") - F.col("agree")).alias("distance"))


def cluster_tools(matrix: DataFrame, tools: list[str], k: int, bisecting: bool = False, seed: int = 1) -> DataFrame:
    """tool, cluster: k-means of the tools, embedded so that their distances are kept (tools x tools numbers)."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.linalg import Vectors

    n, at = len(tools), {t: i for i, t in enumerate(tools)}
    d = np.zeros((n, n))
    for r in tool_distances(matrix, tools).collect():
        d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = r.distance
    centred = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centred @ d @ centred)
    points = vectors * np.sqrt(np.maximum(values, 0))
    spark: SparkSession = matrix.sparkSession
    df = spark.createDataFrame([(t, Vectors.dense(points[i])) for t, i in at.items()], ["tool", "features"]).coalesce(1)
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(df)
    return model.transform(df).select("tool", F.col("prediction").alias("cluster"))


def best_tool_per_cluster(matrix: DataFrame, tools: list[str], k: int, seed: int = 1) -> DataFrame:
    """cluster, tool, precision of each cluster's most precise tool."""
    both = cluster_tools(matrix, tools, k, seed=seed).join(tool_precision(matrix, tools), "tool")
    return both.groupBy("cluster").agg(F.min_by(F.struct("tool", "precision"), F.struct(-F.col("precision"), F.col("tool"))).alias("best")).select("cluster", "best.*")



"""Combining votes per cell without training, and reliabilities from agreement."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.spec import CLEAN, ERROR


#: Vote patterns that are broadcast at most.
PATTERNS = 100_000


def _errors(tools: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(t) == 1, 1).otherwise(0) for t in tools])


def union_all(tools: list[str]) -> Column:
    """Ternary: 1 if any tool says error, else -1."""
    return F.when(_errors(tools) > 0, ERROR).otherwise(CLEAN)


def majority(tools: list[str], tie_is_error: bool = False) -> Column:
    """Ternary: 1 if at least floor(n/2) tools, and one at least, say error, else -1.

    With tie_is_error binary: 1 if at least as many tools say 1 as say 0, else 0.
    """
    n = _errors(tools)
    if tie_is_error:
        return (n >= len(tools) - n).cast("int")
    return F.when((n >= len(tools) // 2) & (n >= 1), ERROR).otherwise(CLEAN)


def min_k(tools: list[str], k: int) -> Column:
    """Binary: 1 if at least k tools say error."""
    return (_errors(tools) >= k).cast("int")


def max_k(tools: list[str], k: int) -> Column:
    """Binary: 1 if between 1 and k tools say error."""
    return _errors(tools).between(1, k).cast("int")


def weighted_vote(tools: list[str], weights: list[float]) -> Column:
    """Sign of the weighted sum of ternary votes; 0 counts as clean."""
    total = reduce(lambda a, b: a + b, [F.col(t) * F.lit(float(w)) for t, w in zip(tools, weights)])
    return F.when(total > 0, ERROR).otherwise(CLEAN)


def precision_ordering(matrix: DataFrame, tools: list[str], delta: float) -> tuple[Column, list[str]]:
    """(prediction, tools in order): again and again the tool most precise on the cells not yet predicted, while its precision is delta or more.

    One aggregation a round over all tools left; ties go to the first by name.
    """
    rest, order, free = sorted(tools), [], F.lit(True)
    while rest:
        counts = matrix.where(free).agg(*[F.count_if(F.col(t) == 1).alias(f"n_{t}") for t in rest], *[F.count_if((F.col(t) == 1) & (F.col("label") == 1)).alias(f"tp_{t}") for t in rest]).first()
        best = max(rest, key=lambda t: counts[f"tp_{t}"] / counts[f"n_{t}"] if counts[f"n_{t}"] else 0.0)
        if not counts[f"n_{best}"] or counts[f"tp_{best}"] / counts[f"n_{best}"] < delta:
            break
        order.append(best)
        rest.remove(best)
        free = free & (F.col(best) != 1)
    return (F.when(_errors(order) > 0, 1).otherwise(0) if order else F.lit(0)), order


def gram(matrix: DataFrame, tools: list[str]) -> np.ndarray:
    """Sums of products of every two vote columns, in one aggregation; of tools x tools size."""
    row = matrix.agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(tools) for j, b in enumerate(tools) if i <= j]).first()
    out = np.zeros((len(tools), len(tools)))
    for i in range(len(tools)):
        for j in range(i, len(tools)):
            out[i, j] = out[j, i] = row[f"{i}_{j}"] or 0.0
    return out


def spectral_reliability(matrix: DataFrame, tools: list[str], alg: int = 1) -> np.ndarray:
    """One weight a tool from the leading eigenvectors of agreement and of answering together (ternary votes).

    alg 1: ratio of the two eigenvectors; alg 2: eigenvector of the element-wise ratio of the two matrices. The sign
    makes most tools reliable. Only tools x tools numbers leave Spark.
    """
    agreement = gram(matrix, tools)
    together = gram(matrix.select(*[(F.col(t) != 0).cast("int").alias(t) for t in tools]), tools)

    def leading(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        return vectors[:, int(np.argmax(values))]

    divide = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=np.abs(b) > 1e-12)
    weights = divide(leading(agreement), np.abs(leading(together))) if alg == 1 else leading(divide(agreement, together))
    return weights if weights.sum() >= 0 else -weights


def dawid_skene(triplets: DataFrame, max_iter: int = 25, tol: float = 1e-4, initial: str = "majority") -> tuple[DataFrame, dict[tuple[int, int, int], float]]:
    """(recid, attr, p_error, predicted; P(y | annotator, true)) by expectation maximisation over all cells.

    triplets: recid, attr, annotator, y. Vote patterns are counted first, so an iteration works on the different patterns
    with their counts. Priors: even prevalence; each row of a confusion matrix has 2 pseudo-counts on its diagonal and 1
    beside it. Only annotators x 2 x 2 numbers leave Spark in an iteration.
    """
    cell = triplets.groupBy("recid", "attr").agg(F.sort_array(F.collect_list(F.struct("annotator", "y"))).alias("pattern"))
    start = F.avg if initial == "majority" else F.max
    patterns = cell.groupBy("pattern").agg(F.count("*").alias("n")).cache()
    votes = patterns.select("pattern", "n", F.posexplode("pattern").alias("i", "vote")).select("pattern", "n", F.col("vote.annotator").alias("annotator"), F.col("vote.y").alias("y"))
    share = votes.groupBy("pattern").agg(start("y").alias("m"))
    posterior = patterns.join(share, "pattern").select("pattern", "n", F.when(F.col("m") >= 0.5, 0.9).otherwise(0.1).alias("p"))
    confusion: dict[tuple[int, int, int], float] = {}
    for _ in range(max_iter):
        one = posterior.select("n", "p", F.explode("pattern").alias("vote")).groupBy("vote.annotator", "vote.y").agg(F.sum(F.col("n") * F.col("p")).alias("e1"), F.sum(F.col("n") * (1 - F.col("p"))).alias("e0")).collect()
        prior = posterior.agg((F.sum(F.col("n") * F.col("p")) + 1).alias("a"), (F.sum(F.col("n")) + 2).alias("b")).first()
        sums: dict[tuple[int, int, int], float] = {}
        for a in {r.annotator for r in one}:
            for z in (0, 1):
                got = {y: 1.0 + (y == z) + sum(r[f"e{z}"] for r in one if (r.annotator, r.y) == (a, y)) for y in (0, 1)}
                for y in (0, 1):
                    sums[a, z, y] = got[y] / (got[0] + got[1])
        change = max((abs(v - confusion.get(k, 0.0)) for k, v in sums.items()), default=0.0)
        confusion = sums
        if not confusion:
            break
        table = F.create_map(*[x for (a, z, y), v in confusion.items() for x in (F.lit(f"{a}|{z}|{y}"), F.lit(float(np.log(v))))])

        def log_of(z: int, table=table) -> Column:
            """Sum of the logarithms of a pattern's votes, were z the truth."""
            return F.aggregate("pattern", F.lit(0.0), lambda s, v: s + table[F.concat_ws("|", v["annotator"].cast("string"), F.lit(str(z)), v["y"].cast("string"))])

        p1 = prior.a / prior.b
        odds = F.lit(float(np.log(p1 / (1 - p1)))) + log_of(1) - log_of(0)
        posterior = patterns.select("pattern", "n", (1 / (1 + F.exp(-odds))).alias("p"))
        if change < tol:
            break
    table = posterior.select("pattern", "p")
    if patterns.limit(PATTERNS + 1).count() <= PATTERNS:  # most cells have one pattern: no shuffle by it
        table = F.broadcast(table)
    out = cell.join(table, "pattern").select("recid", "attr", F.col("p").alias("p_error"), (F.col("p") > 0.5).cast("int").alias("predicted"))
    return out, confusion


def first_em_step(triplets: DataFrame) -> DataFrame:
    """annotator, truth, y, expected: counts of the first M-step, with each cell's majority as its truth (ties: error)."""
    guess = triplets.groupBy("recid", "attr").agg((F.avg("y") >= 0.5).cast("int").alias("truth"))
    return triplets.join(guess, ["recid", "attr"]).groupBy("annotator", "truth", "y").agg(F.count("*").alias("expected"))



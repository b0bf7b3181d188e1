"""Precision, recall and F1 of predictions, cell sets and repairs; one aggregation each."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio
from cellwright.operators.detect import with_scores
from cellwright.operators.votes import majority, min_k, union_all
from cellwright.session import saved


def _counts(pred: Column, label: Column, name: str = "", weight: str | None = None) -> list[Column]:
    count = lambda c: F.count_if(c) if weight is None else F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0))
    return [
        count((pred == 1) & (label == 1)).alias(f"tp{name}"), count((pred == 1) & (label != 1)).alias(f"fp{name}"),
        count((pred != 1) & (label == 1)).alias(f"fn{name}"), count((pred != 1) & (label != 1)).alias(f"tn{name}"),
    ]


def with_all_scores(counts: DataFrame) -> DataFrame:
    right, every = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return with_scores(counts).withColumns({"accuracy": F.round(ratio(right, every), 4), "wrong": F.col("fp") + F.col("fn")})


def evaluate(df: DataFrame, pred: Column, label: str = "label") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy (4 digits; undefined as 0), wrong."""
    return with_all_scores(df.agg(*_counts(pred, F.col(label))))


def evaluate_many(df: DataFrame, predictions: dict[str, Column], label: str = "label", weight: str | None = None) -> DataFrame:
    """``evaluate`` of many predictions over one pass: name and scores. A row counts ``weight`` times, if that is given."""
    row = df.agg(*[c for i, p in enumerate(predictions.values()) for c in _counts(p, F.col(label), f"_{i}", weight)])
    parts = F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, n in enumerate(predictions)])
    return with_all_scores(row.select(F.explode(parts).alias("r")).select("r.*"))


def evaluate_tools(matrix: DataFrame, tools: list[str]) -> DataFrame:
    return evaluate_many(matrix, {t: F.col(t) for t in tools})


def evaluate_min_k(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """min-1 (union of all) up to min-n."""
    return evaluate_many(matrix, {f"min-{k}": min_k(tools, k) for k in range(1, len(tools) + 1)})


def evaluate_votes(votes: DataFrame, detectors: list[str]) -> DataFrame:
    """Scores of ternary detectors, each on the cells where it answers, then of their majority and their union, in one pass."""
    alone = {d: F.when(F.col(d) != 0, (F.col(d) == 1).cast("int")) for d in detectors}
    return evaluate_many(votes, alone | {"majority": (majority(detectors) == 1).cast("int"), "union": (union_all(detectors) == 1).cast("int")})


def evaluate_sets(gold: DataFrame, selected: DataFrame) -> DataFrame:
    """tp, fp, fn and scores of two sets of cells (recid, attr)."""
    g, s = gold.select("recid", "attr").distinct().withColumn("g", F.lit(1)), selected.select("recid", "attr").distinct().withColumn("s", F.lit(1))
    both = g.join(s, ["recid", "attr"], "full")
    return with_scores(both.agg(F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("s").isNull()).alias("fn")))


def to_prediction(df: DataFrame, column: str, mode: str = "aggregated") -> DataFrame:
    """prediction, label from ternary votes. aggregated: -1 as 0, all else as 1; single: votes of 0 are left out."""
    if mode == "single":
        df = df.where(F.col(column) != 0)
    return df.select("recid", "attr", F.when(F.col(column) == -1, 0).otherwise(1).alias("prediction"), "label")


def evaluate_repair(clean: DataFrame, repaired: DataFrame, dirty: DataFrame) -> DataFrame:
    """Of cells (recid, attr, value): repaired, incorrect, errors, uncorrected; precision and recall of the repairs."""
    c, r, d = (df.select("recid", "attr", F.col("value").alias(n)) for df, n in ((clean, "c"), (repaired, "r"), (dirty, "d")))
    both = d.join(c, ["recid", "attr"]).join(r, ["recid", "attr"])
    changed, right, wrong = ~F.col("r").eqNullSafe(F.col("d")), F.col("r").eqNullSafe(F.col("c")), ~F.col("d").eqNullSafe(F.col("c"))
    counts = both.agg(F.count_if(changed).alias("repaired"), F.count_if(changed & ~right).alias("incorrect"), F.count_if(wrong).alias("errors"), F.count_if(wrong & ~right).alias("uncorrected"))
    p = ratio(F.col("repaired") - F.col("incorrect"), F.col("repaired"))
    r_ = F.when(F.col("errors") > 0, 1 - ratio(F.col("uncorrected"), F.col("errors"))).otherwise(0.0)
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r_, 4), "f1": F.round(ratio(2 * p * r_, p + r_), 4)})


def false_positive_profile(df: DataFrame, pred: str, by: list[str]) -> DataFrame:
    """Wrongly flagged cells counted by attribute and the given flags."""
    return df.where((F.col(pred) == 1) & (F.col("label") == 0)).groupBy("attr", *by).agg(F.count("*").alias("n"))


def vote_patterns(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """label, votes, n: how often each combination of votes occurs."""
    return matrix.groupBy("label", *tools).agg(F.count("*").alias("n"))


def threshold_table(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 when every score from the threshold on counts as an error.

    Scores are counted by value first; the running sums go over the different scores, in ranges that are written once
    (their bounds come from a sample).
    """
    by_score = scores.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    ranged = saved(by_score.repartitionByRange(F.desc("threshold")).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range_").agg(F.sum("p").alias("p_"), F.sum("q").alias("q_"))  # one row a partition
    above, every = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    totals = totals.select("range_", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"before_{c}") for c in ("p_", "q_")], F.sum("p_").over(every).alias("all_p"))
    inside = Window.partitionBy("range_").orderBy(F.desc("threshold"))
    out = ranged.join(F.broadcast(totals), "range_").select("threshold", (F.col("before_p_") + F.sum("p").over(inside)).alias("tp"), (F.col("before_q_") + F.sum("q").over(inside)).alias("fp"), "all_p")
    return with_scores(out.withColumn("fn", F.col("all_p") - F.col("tp")).drop("all_p"))


def grid_thresholds(scores: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Evaluation of a fixed list of thresholds, in one aggregation."""
    return evaluate_many(scores, {repr(t): (F.col(score) > t).cast("int") for t in thresholds}, label)



"""Whole workflows out of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators import models, similarity
from cellwright.operators.cells import topk_prefixes, truth_matrix
from cellwright.operators.evaluate import evaluate_many, evaluate_tools
from cellwright.operators.votes import min_k
from cellwright.plans import patterns
from cellwright.session import saved


def cluster_and_combine(matrix: DataFrame, train: DataFrame, test: DataFrame, tools: list[str], k: int, kinds: tuple[str, ...] = ("logistic", "naive_bayes", "tree"), seed: int = 1, on: str = "votes") -> DataFrame:
    """Tools are clustered, every cluster is bagged, and models over the clusters' votes are evaluated with their union and majority.

    on: tools are alike by their votes (votes), or by where they are right (truth).
    """
    groups: dict[int, list[str]] = {}
    for r in similarity.cluster_tools(truth_matrix(matrix, tools) if on == "truth" else matrix, tools, k, seed=seed).collect():  # one row a tool
        groups.setdefault(r.cluster, []).append(r.tool)
    return patterns.clusters(train, test, [sorted(members) for _, members in sorted(groups.items())], kinds)


def best_cluster(matrix: DataFrame, train: DataFrame, test: DataFrame, tools: list[str], k: int, seed: int = 1) -> DataFrame:
    """The cluster whose union has the highest F1 on training rows, with the full stack of classifiers."""
    groups: dict[int, list[str]] = {}
    for r in similarity.cluster_tools(matrix, tools, k, seed=seed).collect():
        groups.setdefault(r.cluster, []).append(r.tool)
    scores = evaluate_many(train, {str(c): min_k(m, 1) for c, m in groups.items()}).orderBy(F.desc("f1"), "name").first()
    return patterns.combine_classifiers(train, test, sorted(groups[int(scores.name)]))


def scored_sets(matrix: DataFrame, tools: list[str], least: int = 2) -> DataFrame:
    """tools, members: for precision, recall and F1 the sets of the best k tools, k from ``least`` on, each set once.

    The scored lists are those of ``evaluate_tools``; a list from elsewhere goes through ``cells.topk_prefixes`` in the same way.
    """
    scores = evaluate_tools(matrix, tools).unpivot("name", ["precision", "recall", "f1"], "algorithm", "score")
    number = F.array_position(F.array(*[F.lit(t) for t in tools]), F.col("name"))
    lists = scores.groupBy(F.lit("all").alias("dataset"), "algorithm").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", number.cast("string"), F.col("score").cast("string")))), "|").alias("expectations"))
    numbers = F.split("tools", ",").cast("array<int>")
    names = F.transform(numbers, lambda i: F.get(F.array(*[F.lit(t) for t in tools]), i - 1))
    return topk_prefixes(lists).where(F.size(numbers) >= least).select(names.alias("members")).distinct().select(F.array_join("members", ",").alias("tools"), "members")


def set_report(train: DataFrame, test: DataFrame, tools: list[str], subsets: DataFrame) -> DataFrame:
    """A row for every set of tools (tools, members): union, min-size and naive Bayes scores, and how alike its tools are.

    Three aggregations over the cells, whatever the number of sets: vote patterns, evidence of the tools, pairs of tools.
    """
    subsets = saved(subsets, "subsets")
    every = saved(similarity.evaluate_subsets(test, tools, subsets).join(subsets.select("tools", F.size("members").alias("size")), "tools"), "scores")
    named = lambda df, p: df.select("tools", *[F.col(c).alias(f"{p}_{c}") for c in ("precision", "recall", "f1")])
    bayes = similarity.naive_bayes_subsets(train, test, tools, subsets)
    pairs = similarity.pairwise_similarity(test, tools)  # a row a pair of tools
    alike = subsets.join(F.broadcast(pairs), F.array_contains("members", F.col("a")) & F.array_contains("members", F.col("b"))).groupBy("tools").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("pmi", "kappa", "cosine")])
    out = subsets.select("tools", F.size("members").alias("size"))
    for part in (named(every.where("k = 1"), "union"), named(every.where("k = size"), "min_size"), named(bayes, "bayes"), alike):
        out = out.join(part, "tools")
    return out


def ranked_sets(train: DataFrame, test: DataFrame, tools: list[str], subsets: DataFrame, least: int = 3) -> DataFrame:
    """``set_report`` with the F1 of a logistic regression, and the place of every set of at least ``least`` tools.

    Places go by min-size precision, then union recall, then that F1, then the name, so the order is total.
    """
    report = set_report(train, test, tools, subsets)
    members = [tuple(r.members) for r in subsets.select("members").collect()]  # candidate sets, a few a scored list
    f1 = patterns.models_of_sets(train, test, tools, sorted(members)).select(F.col("name").alias("tools"), F.col("f1").alias("logistic_f1"))
    place = F.row_number().over(Window.orderBy(F.desc("min_size_precision"), F.desc("union_recall"), F.desc("logistic_f1"), "tools"))
    both = report.join(f1, "tools")
    return both.where(F.col("size") >= least).withColumn("place", place).unionByName(both.where(F.col("size") < least).withColumn("place", F.lit(None).cast("int")))


def allocate_and_fold(train: DataFrame, test: DataFrame, tools: list[str], least: int = 3) -> tuple[list[str], DataFrame]:
    """(tools, evaluation): the set of at least ``least`` tools that is best by (min-k precision, union recall, F1), with the full stack."""
    table = similarity.brute_force(train, tools, least).withColumn("members", F.split("tools", ","))
    size = F.size("members")
    best = table.groupBy("tools").agg(
        F.max(F.when(F.col("k") == size, F.col("precision"))).alias("p"), F.max(F.when(F.col("k") == 1, F.col("recall"))).alias("r"), F.max("f1").alias("f1")
    ).orderBy(F.desc("p"), F.desc("r"), F.desc("f1"), "tools").first()
    chosen = best.tools.split(",")
    return chosen, patterns.combine_classifiers(train, test, chosen)


def predict_errors(features: DataFrame, columns: list[str], share_percent: int = 10) -> tuple[DataFrame, DataFrame]:
    """(bagging, stacking) predictions of the test cells, trained on ``share_percent`` of the cells."""
    from cellwright.operators.features import split

    train, test = split(features, share_percent)
    return models.bagging(train, test, columns), models.stacking(train, test, columns)

"""Trained models on matrices of known errors: four tools of known quality, one of noise."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share
from cellwright.operators import detect, evaluate, features, models, profile, similarity, votes
from cellwright.plans import patterns, workflows

TOOLS = ["good", "fair", "shy", "noise"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng, rows = random.Random(5), []
    for i in range(1200):
        label = int(rng.random() < 0.3)
        flip = lambda p: label if rng.random() < p else 1 - label
        rows.append((i, "a", label, flip(0.95), flip(0.85), int(label and rng.random() < 0.5), int(rng.random() < 0.5)))
    return spark.createDataFrame(rows, "recid long, attr string, label int, " + ", ".join(f"{t} int" for t in TOOLS)).repartition(3).cache()


@pytest.fixture(scope="module")
def halves(matrix):
    return features.split(matrix, 50)


def f1(df, prediction) -> float:
    return float(evaluate.evaluate(df, prediction).first().f1)


def test_samples_do_not_depend_on_partitions(matrix):
    picked = lambda df: {r.recid for r in df.where(hash_share(("recid", "attr"), 10, 3)).collect()}
    assert picked(matrix) == picked(matrix.repartition(7)) and 60 < len(picked(matrix)) < 180
    assert profile.class_balance(matrix, 0.5).first() == profile.class_balance(matrix.repartition(7), 0.5).first()


@pytest.mark.parametrize("kind", ["tree", "naive_bayes", "logistic", "perceptron", "svm"])
def test_each_model_learns_the_errors(halves, kind):
    train, test = halves
    out = models.predict(models.fit(train, kind, TOOLS), test, "p")
    assert out.columns == [*test.columns, "p"] and f1(out, F.col("p")) > 0.85


def test_bagging_and_stacking(halves):
    train, test = halves
    alone = f1(test, F.col("fair"))
    assert f1(models.bagging(train, test, TOOLS, seeds=[1, 2, 3]), F.col("bagging")) > max(0.85, alone)
    assert f1(models.bagging_on_votes(train, test, TOOLS), F.col("bagging")) > max(0.85, alone)
    assert f1(models.stacking(train, test, TOOLS), F.col("stacking")) > max(0.85, alone)


def test_logistic_regressions(halves):
    train, test = halves
    model, threshold = models.fit_lr_threshold(train, TOOLS)
    assert threshold in models.THRESHOLDS and f1(models.predict(model, test, "p", "score"), (F.col("score") > threshold).cast("int")) > 0.85
    formula, weights, intercept, threshold = models.linear_combination(train, TOOLS)
    assert weights[0] > weights[1] > abs(weights[3]) and all(t in formula for t in TOOLS)
    assert f1(models.score_linear(test, TOOLS, weights, intercept, threshold), F.col("prediction")) > 0.85
    found, best = models.grid_search_lr(train, TOOLS, folds=2, reg=(0.01, 5.0), elastic=(0.0,))
    assert best["regParam"] == 0.01


def test_trees_and_regressions(halves):
    train, test = halves
    trees = models.cross_validated_trees(train, TOOLS, seeds=[1, 2])
    assert len(trees) == 2 and all(0.85 < outside <= 1 and 0.85 < inside <= 1 for _, inside, outside in trees)
    rows = {r.model: r for r in models.regression_baseline(train, test, TOOLS, folds=2).collect()}
    assert set(rows) == {"linear", "glm"} and all(r.rmse < 0.3 and r.r2 > 0.5 and r.reg_param in (0.001, 0.01, 0.1) for r in rows.values())


def test_combined_classifiers(halves):
    out = {r.name: r for r in models.combine_classifiers(*halves, TOOLS, kinds=("tree", "naive_bayes")).collect()}
    assert {"min-1", "min-4", "majority", "second_logistic", "second_naive_bayes", "second_tree"} == set(out) - {"min-2", "min-3"}
    assert float(out["second_tree"].f1) > 0.85 and float(out["min-1"].recall) >= float(out["min-4"].recall)


def test_workflows(matrix, halves):
    train, test = halves
    chosen, scores = workflows.allocate_and_fold(train, test, TOOLS)
    assert "good" in chosen
    assert workflows.cluster_and_combine(matrix, train, test, TOOLS, 2).count() > 0
    assert workflows.best_cluster(matrix, train, test, TOOLS, 2).count() > 0


def test_orders_and_weights(matrix):
    _, order = votes.precision_ordering(matrix, TOOLS, 0.3)
    assert order[0] in ("shy", "good") and "noise" not in order[:2]
    w = votes.spectral_reliability(matrix.select("recid", "attr", *[(2 * F.col(t) - 1).alias(t) for t in TOOLS]), TOOLS)
    assert w[0] > w[3] and w[1] > w[3]
    triplets = matrix.select("recid", "attr", F.posexplode(F.array(*TOOLS)).alias("annotator", "y"))
    out, confusion = votes.dawid_skene(triplets)
    right = out.join(matrix, ["recid", "attr"]).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.9 and confusion[0, 1, 1] > confusion[3, 1, 1]


@pytest.mark.parametrize("initial", ["majority", "min_1"])
def test_dawid_skene_on_patterns_equals_that_on_triplets(matrix, initial):
    """Also where tools say nothing about some cells."""
    some = matrix.withColumn("fair", F.when(F.col("recid") % 3 > 0, F.col("fair"))).withColumn("good", F.when(F.col("recid") % 7 > 1, F.col("good")))
    cells, confusion = patterns.dawid_skene(some, TOOLS, initial=initial)
    triplets = some.select("recid", "attr", F.posexplode(F.array(*TOOLS)).alias("annotator", "y")).where("y IS NOT NULL")
    want, of = votes.dawid_skene(triplets, initial=initial)
    both = cells.join(want.withColumnsRenamed({"p_error": "p", "predicted": "q"}), ["recid", "attr"])
    row = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("p_error") - F.col("p"))).alias("apart"), F.count_if(F.col("predicted") != F.col("q")).alias("other")).first()
    assert row.n == 1200 and row.apart < 1e-9 and row.other == 0
    assert {(TOOLS.index(r.annotator), r.truth, r.y): round(r.probability, 9) for r in confusion.collect()} == {k: round(v, 9) for k, v in of.items()}
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]


def test_encoder_sees_training_rows_only(matrix):
    from pyspark.ml.functions import vector_to_array

    train = matrix.where(" + ".join(TOOLS) + " BETWEEN 1 AND 2")
    out = features.encoded_vote_features(train, matrix, TOOLS).select("n_agree", vector_to_array("agree_vector").alias("v")).distinct().collect()
    slots = {r.n_agree: list(r.v).index(1.0) for r in out}
    assert len(out) == 5 and all(len(r.v) == 3 and sum(r.v) == 1 for r in out)
    assert {slots[1], slots[2]} == {0, 1} and slots[0] == slots[3] == slots[4] == 2


def test_dawid_skene_on_patterns_without_votes_and_cells(spark, matrix, monkeypatch):
    mute = spark.createDataFrame([(-1, "a", 0, None, None, None, None)], matrix.schema)
    got = patterns.dawid_skene(matrix.unionByName(mute), TOOLS)[0].where("recid = -1").first()
    assert 0 < got.p_error < 0.5 and got.predicted == 0
    cells, confusion = patterns.dawid_skene(matrix.where("recid < -5"), TOOLS)
    assert cells.count() == 0
    assert {round(r.probability, 6) for r in confusion.where("truth = y").collect()} == {round(2 / 3, 6)}
    monkeypatch.setattr(patterns, "MOST", 3)
    with pytest.raises(ValueError):
        patterns.dawid_skene(matrix, TOOLS)


def test_frequent_values_meet_no_table_of_counts(spark, monkeypatch):
    """A value that a third of all cells have, and nulls, are dealt over many parts of the join."""
    cells = spark.range(30_000).select(F.col("id").alias("recid"), F.lit("a").alias("attr"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("v"), (F.col("id") % 6000).cast("string"))).alias("value"))
    got = detect.with_profile(cells)
    assert {r.cnt for r in got.where("value = 'hot'").select("cnt").distinct().collect()} == {10_000}
    assert got.where("value IS NULL AND cnt IS NOT NULL").count() == 0
    assert got.where("value <> 'hot'").select("cnt").distinct().collect() == [(5,)]
    plan = got._jdf.queryExecution().toString()
    assert "part_" in plan
    dictionary = spark.createDataFrame([("HOT",), ("V2",)], "v string")
    few = {tuple(r) for r in detect.lookup(cells, {"a": dictionary}).groupBy("ec_lookup").count().collect()}
    monkeypatch.setattr(detect, "DICTIONARY_ROWS", 1)
    assert few == {tuple(r) for r in detect.lookup(cells, {"a": dictionary}).groupBy("ec_lookup").count().collect()}


def test_models_on_patterns_are_those_on_cells(matrix, halves):
    """Counted patterns give the scores that training on cells gives."""
    train, test = halves
    got = {r.name: r for r in patterns.evaluate_models(train, test, TOOLS).collect()}
    want = {"bagging": f1(models.bagging_on_votes(train, test, TOOLS), F.col("bagging"))}
    for kind in ("tree", "naive_bayes", "logistic"):
        want[kind] = f1(models.predict(models.fit(train, kind, TOOLS), test, "p"), F.col("p"))
    want["min-2"] = f1(test, votes.min_k(TOOLS, 2))
    assert {k: float(got[k].f1) for k in want} == want
    assert got["bagging"].tp + got["bagging"].fp + got["bagging"].fn + got["bagging"].tn == test.count()


def test_brute_force_of_models(halves):
    train, test = halves
    three = TOOLS[:3]
    got = {r.name: float(r.f1) for r in patterns.brute_force(train, test, three).collect()}
    assert set(got) == {"good,fair", "good,shy", "fair,shy", "good,fair,shy"}
    assert got["good,fair,shy"] == f1(models.predict(models.fit(train, "logistic", three), test, "p"), F.col("p"))
    bayes = {r.tools: float(r.f1) for r in similarity.brute_force_naive_bayes(train, test, three).collect()}
    for name in got:
        assert bayes[name] == f1(models.predict(models.fit(train, "naive_bayes", name.split(",")), test, "p"), F.col("p"))


def test_clusters_on_patterns(halves):
    train, test = halves
    got = {r.name: float(r.f1) for r in patterns.clusters(train, test, [["good", "noise"], ["fair", "shy"]]).collect()}
    assert set(got) == {"union", "majority", "logistic", "naive_bayes", "tree"} and got["tree"] > 0.85
    a = models.bagging_on_votes(train, test, ["good", "noise"], "c0")
    assert got["union"] == f1(models.bagging_on_votes(train, a, ["fair", "shy"], "c1"), F.greatest("c0", "c1"))


def test_too_many_patterns_are_refused(matrix, monkeypatch):
    monkeypatch.setattr(patterns, "MOST", 3)
    with pytest.raises(ValueError):
        patterns.counted(matrix, TOOLS)


def test_orderings_by_delta(matrix):
    """From counted patterns the same order and scores as from cells."""
    for r in similarity.precision_orderings(matrix, TOOLS, (0.2, 0.9, 1.1)).collect():
        prediction, order = votes.precision_ordering(matrix, TOOLS, r.delta)
        want = evaluate.evaluate(matrix, prediction).first()
        assert (r.tools, r.tp, r.fp, r.fn, r.tn, r.f1) == (",".join(order), want.tp, want.fp, want.fn, want.tn, want.f1)


def test_ranked_sets(spark, matrix, halves):
    train, test = halves
    sets = workflows.scored_sets(matrix, TOOLS)
    names = {r.tools for r in sets.collect()}
    assert "good,fair,shy,noise" in names and all(len(n.split(",")) >= 2 for n in names)
    out = {r.tools: r for r in workflows.ranked_sets(train, test, TOOLS, sets).collect()}
    assert set(out) == names and sorted(r.place for r in out.values() if r.size >= 3) == list(range(1, 1 + sum(r.size >= 3 for r in out.values())))
    full = out["good,fair,shy,noise"]
    assert full.union_recall == f1_parts(test, votes.min_k(TOOLS, 1)).recall and full.min_size_precision == f1_parts(test, votes.min_k(TOOLS, 4)).precision
    assert all(r.place is None for r in out.values() if r.size < 3)


def f1_parts(df, prediction):
    return evaluate.evaluate(df, prediction).first()


@pytest.fixture
def watched(spark, halves):
    """Training cells that count their readings, and a function that tells how often they are read."""
    read = spark.sparkContext.accumulator(0)

    def mark(x):
        read.add(1)
        return x

    train = halves[0]
    n = train.count()

    def reads(run):
        before = read.value
        return run(), (read.value - before) / n

    return train.withColumn("label", F.udf(mark, "int")(F.col("label").cast("int"))), reads


def test_best_tools_and_clusters_read_the_cells_once(watched, halves):
    (seen, reads), test = watched, halves[1]
    got, times = reads(lambda: patterns.best_k(seen, test, TOOLS).collect())
    assert times == 1 and {r.k for r in got} == {2, 3}
    assert reads(lambda: patterns.clusters(seen, test, [["good", "noise"], ["fair", "shy"]]).collect())[1] == 1


def test_grid_and_second_level_read_the_cells_once(watched, halves):
    (seen, reads), test = watched, halves[1]
    (model, best), times = reads(lambda: patterns.grid_search_lr(seen, TOOLS, folds=2, reg=(0.01, 5.0), elastic=(0.0,)))
    assert times == 1 and best["regParam"] == 0.01 and float(patterns.evaluate_one(model, test, TOOLS).first().f1) > 0.85
    got, times = reads(lambda: patterns.combine_classifiers(seen, test, TOOLS, ("naive_bayes",)).collect())
    assert times == 1 and {"min-3", "majority", "second_tree"} <= {r.name for r in got}

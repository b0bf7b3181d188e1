"""Queries of trained models. Their rows depend on training, so most have no SQL; they are tested on a matrix of known errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share_sql
from cellwright.operators import evaluate as E
from cellwright.operators import features, models
from cellwright.plans import patterns, workflows
from cellwright.queries import customers as U
from cellwright.queries.registry import query
from cellwright.session import saved

T = U.TOOLS
COLUMNS = [*T, "missing_value", "is_top10", "fd0_lhs", "fd0_rhs", "is_integer_type"]


def _votes(spark, d):
    """(train, test) of the vote matrix, written once: training reads it many times."""
    return features.split(saved(U.matrix(spark, d), "matrix"), 30)


def _features(spark, d):
    cell = U.dirty_cells(spark, d)
    out = features.assemble([U.matrix(spark, d), features.content_features(cell, U.SPEC).drop("value"), features.fd_features(cell, U.FDS, "two").drop("value")])
    return features.split(saved(out, "features"), 30)


@query("H1_bagging")
def h1(spark, d):
    return E.evaluate(models.bagging(*_features(spark, d), COLUMNS), F.col("bagging"))


@query("H2_bagging_on_votes")
def h2(spark, d):
    return E.evaluate(models.bagging_on_votes(*_votes(spark, d), T), F.col("bagging"))


@query("H2_models_on_patterns")
def h2b(spark, d):
    return patterns.evaluate_models(*_votes(spark, d), T)


@query("F8_brute_force_logistic")
def f8(spark, d):
    return patterns.brute_force(*_votes(spark, d), T)


@query("F9_best_k_models")
def f9(spark, d):
    return patterns.best_k(*_votes(spark, d), T)


@query("H3_stacking")
def h3(spark, d):
    return E.evaluate(models.stacking(*_features(spark, d), COLUMNS), F.col("stacking"))


@query("H4_lr_threshold")
def h4(spark, d):
    train, test = _features(spark, d)
    model, threshold = models.fit_lr_threshold(train, COLUMNS)
    return E.evaluate(models.predict(model, test, "p", "score"), (F.col("score") > threshold).cast("int")).withColumn("threshold", F.lit(threshold))


@query("H5_linear_combination")
def h5(spark, d):
    train, test = _votes(spark, d)
    formula, weights, intercept, threshold = models.linear_combination(train, T)
    return E.evaluate(models.score_linear(test, T, weights, intercept, threshold), F.col("prediction")).withColumn("formula", F.lit(formula))


@query("H6_grid_search")
def h6(spark, d):
    train, test = _votes(spark, d)
    model, found = patterns.grid_search_lr(train, T)
    return patterns.evaluate_one(model, test, T).withColumn("reg_param", F.lit(found["regParam"]))


@query("H7_score_linear", U.sql("SELECT recid, attr, CAST(1 / (1 + exp(-(-2.5 + 3.0 * missing + 2.0 * default_value + 1.5 * lookup + 0.5 * fd + 4.0 * number))) > 0.4 AS INTEGER) AS prediction FROM m"))
def h7(spark, d):
    return models.score_linear(U.matrix(spark, d), T, [3.0, 2.0, 1.5, 0.5, 4.0], -2.5, 0.4).select("recid", "attr", "prediction")


def _one(kind: str):
    def run(spark, d):
        train, test = _votes(spark, d)
        return E.evaluate(models.predict(models.fit(train, kind, T), test, "p"), F.col("p"))

    return run


_TRAIN = hash_share_sql(["recid", "attr"], 30)
#: A Bernoulli model with smoothing 1, written out.
_BAYES = U.sql(f""", c AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label <> 1)::DOUBLE AS n0, {', '.join(f"(count(*) FILTER (WHERE label = 1 AND {t} = 1) + 1) / (count(*) FILTER (WHERE label = 1) + 2) AS {t}_1, (count(*) FILTER (WHERE label <> 1 AND {t} = 1) + 1) / (count(*) FILTER (WHERE label <> 1) + 2) AS {t}_0" for t in T)} FROM m WHERE {_TRAIN}),
p AS (SELECT label, ln((n1 + 1) / (n0 + 1)) + {' + '.join(f"CASE WHEN {t} = 1 THEN ln({t}_1 / {t}_0) ELSE ln((1 - {t}_1) / (1 - {t}_0)) END" for t in T)} > 0 AS flagged FROM m, c WHERE NOT {_TRAIN})
""" + U.all_scores_sql("SELECT count(*) FILTER (WHERE flagged AND label = 1) AS tp, count(*) FILTER (WHERE flagged AND label <> 1) AS fp, count(*) FILTER (WHERE NOT flagged AND label = 1) AS fn, count(*) FILTER (WHERE NOT flagged AND label <> 1) AS tn FROM p"))


query("H8_naive_bayes", _BAYES)(_one("naive_bayes"))
query("H9_decision_tree")(_one("tree"))
query("H11_perceptron")(_one("perceptron"))


@query("H8_naive_bayes_counts", U.sql("SELECT label, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {t} = 1) AS {t}" for t in T) + " FROM m GROUP BY label"))
def h8b(spark, d):
    return models.naive_bayes_counts(U.matrix(spark, d), T)


@query("H10_cross_validated_trees")
def h10(spark, d):
    train, test = _votes(spark, d)
    trees = models.cross_validated_trees(train, T)
    out = test
    for i, (model, _, _) in enumerate(trees):
        out = models.predict(model, out, f"tree{i}")
    return E.evaluate_many(out, {f"tree{i} {inside:.4f} {outside:.4f}": F.col(f"tree{i}") for i, (_, inside, outside) in enumerate(trees)})


@query("H12_linear_svm")
def h12(spark, d):
    train, test = _votes(spark, d)
    scored = models.predict(models.fit(train, "svm", T), test, "p", "margin")
    return E.threshold_table(scored.withColumn("score", F.round("margin", 6)))


@query("H13_regression_baseline")
def h13(spark, d):
    return models.regression_baseline(*_votes(spark, d), T)


@query("H14_combine_classifiers")
def h14(spark, d):
    return patterns.combine_classifiers(*_votes(spark, d), T)


@query("F12_cluster_and_combine")
def f12(spark, d):
    train, test = _votes(spark, d)
    return workflows.cluster_and_combine(train.unionByName(test), train, test, T, 2)


@query("F12_cluster_and_combine_on_truth")
def f12b(spark, d):
    train, test = _votes(spark, d)
    return workflows.cluster_and_combine(train.unionByName(test), train, test, T, 2, kinds=("logistic", "naive_bayes", "tree", "perceptron"), on="truth")


@query("F13_best_cluster")
def f13(spark, d):
    train, test = _votes(spark, d)
    return workflows.best_cluster(train.unionByName(test), train, test, T, 2)


def _set_sql() -> str:
    """Sets of the best tools by three scores, evaluated on the cells that are not for training."""
    from cellwright.queries import votes as V

    ratio = lambda a, b: f"CASE WHEN {b} <> 0 THEN {a} / ({b}) ELSE 0 END"
    p, r = ratio("tp", "hits"), ratio("tp", "every")
    scores = f"SELECT tool, unnest(['precision', 'recall', 'f1']) AS algorithm, unnest([round({p}, 4), round({r}, 4), round(CASE WHEN tp > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END, 4)]) AS score FROM hits, (SELECT sum(label) AS every FROM m)"
    number = "CASE tool " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(T)) + " END"
    test = "(SELECT * FROM m WHERE NOT " + _TRAIN + ")"
    bayes = " + ".join(f"CASE WHEN NOT list_contains(members, '{t}') THEN 0 WHEN {t} = 1 THEN ln({t}_1 / {t}_0) ELSE ln((1 - {t}_1) / (1 - {t}_0)) END" for t in T)
    said = " + ".join(f"CASE WHEN list_contains(members, '{t}') THEN {t} ELSE 0 END" for t in T)
    counts = lambda yes: f"SELECT tools, count(*) FILTER (WHERE {yes} AND label = 1) AS tp, count(*) FILTER (WHERE {yes} AND label <> 1) AS fp, count(*) FILTER (WHERE NOT {yes} AND label = 1) AS fn FROM marked GROUP BY tools"
    parts = " JOIN ".join(f"""(SELECT tools, "precision" AS {n}_precision, recall AS {n}_recall, f1 AS {n}_f1 FROM ({U.scores_sql(counts(y))})) {n}_ USING (tools)""" for n, y in (("union", "(said >= 1)"), ("min_size", "(said >= size)"), ("bayes", "flagged")))
    return V._LONG + f""", c AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label <> 1)::DOUBLE AS n0, {', '.join(f"(count(*) FILTER (WHERE label = 1 AND {t} = 1) + 1) / (count(*) FILTER (WHERE label = 1) + 2) AS {t}_1, (count(*) FILTER (WHERE label <> 1 AND {t} = 1) + 1) / (count(*) FILTER (WHERE label <> 1) + 2) AS {t}_0" for t in T)} FROM m WHERE {_TRAIN}),
scored AS (SELECT *, {number} AS nr, row_number() OVER (PARTITION BY algorithm ORDER BY score DESC, {number}) AS rk FROM ({scores})),
prefixes AS (SELECT DISTINCT list(tool ORDER BY nr) AS members FROM scored JOIN (SELECT unnest(range(2, {len(T) + 1})) AS k) ON rk <= k GROUP BY algorithm, k),
sets_ AS (SELECT array_to_string(members, ',') AS tools, members, CAST(len(members) AS INTEGER) AS size FROM prefixes),
marked AS (SELECT tools, size, label, {said} AS said, ln((n1 + 1) / (n0 + 1)) + {bayes} > 0 AS flagged FROM sets_, {test}, c),
alike AS (SELECT tools, round(avg({V._PMI}), 6) AS mean_pmi, round(avg({V._KAPPA}), 6) AS mean_kappa, round(avg({V._COSINE}), 6) AS mean_cosine FROM sets_ JOIN ({V._contingency(V._PAIRS, test)}) ON list_contains(members, a) AND list_contains(members, b) GROUP BY tools)
SELECT tools, size, union_precision, union_recall, union_f1, min_size_precision, min_size_recall, min_size_f1, bayes_precision, bayes_recall, bayes_f1, mean_pmi, mean_kappa, mean_cosine FROM sets_ JOIN {parts} JOIN alike USING (tools)"""


@query("F14_candidate_sets", U.sql(_set_sql()))
def f14a(spark, d):
    train, test = _votes(spark, d)
    return workflows.set_report(train, test, T, workflows.scored_sets(train.unionByName(test), T))


@query("F14_ranked_sets")
def f14c(spark, d):
    train, test = _votes(spark, d)
    return workflows.ranked_sets(train, test, T, workflows.scored_sets(train.unionByName(test), T))


@query("F14_allocate_and_fold")
def f14(spark, d):
    train, test = _votes(spark, d)
    chosen, scores = workflows.allocate_and_fold(train, test, T)
    return scores.withColumn("tools", F.lit(",".join(chosen)))

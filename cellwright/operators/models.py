"""Trained combination of votes and features, with pyspark.ml. Predictions join on the cell, never on row order."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share
from cellwright.operators.evaluate import evaluate_many, grid_thresholds
from cellwright.operators.votes import majority, min_k

#: Thresholds that are tried.
THRESHOLDS = [
    0.6, 0.55, 0.53, 0.5, 0.45, 0.4, 0.39, 0.38, 0.377, 0.375, 0.374, 0.37, 0.369, 0.368, 0.3675, 0.367, 0.365, 0.36, 0.34, 0.33, 0.32, 0.31,
    0.3, 0.25, 0.2, 0.17, 0.15, 0.13, 0.1, 0.09, 0.05, 0.01,
]
#: Seeds of the bagged subsamples.
SEEDS = [123, 23, 593, 941, 3, 623]

KEY = ("recid", "attr")


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features_", handleInvalid="keep")


def one_hot(columns: list[str]) -> list:
    """Stages that index and encode text columns; fitted with the pipeline on training rows only."""
    names = [f"{c}_index" for c in columns]
    return [StringIndexer(inputCols=columns, outputCols=names, handleInvalid="keep"), OneHotEncoder(inputCols=names, outputCols=[f"{c}_vector" for c in columns], dropLast=False)]


def classifier(kind: str, n_features: int, **params):
    common = {"featuresCol": "features_", "labelCol": "label"}
    if kind == "tree":
        return DecisionTreeClassifier(**common, **{"maxDepth": 5, "maxBins": 32, "impurity": "gini", **params})
    if kind == "naive_bayes":
        return NaiveBayes(**common, **{"modelType": "bernoulli", "smoothing": 1.0, **params})
    if kind == "logistic":
        return LogisticRegression(**common, **{"maxIter": 50, **params})
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(**common, **{"layers": [n_features, n_features + 1, n_features, 2], "blockSize": 128, "seed": 1234, "maxIter": 100, **params})
    if kind == "svm":
        return LinearSVC(**common, **{"maxIter": 50, **params})
    raise ValueError(kind)


def fit(train: DataFrame, kind: str, columns: list[str], **params) -> PipelineModel:
    """A fitted model; ``weightCol`` among ``params`` lets a row count as many times (not for perceptrons)."""
    return Pipeline(stages=[_assembler(columns), classifier(kind, len(columns), **params)]).fit(train.withColumn("label", F.col("label").cast("double")))


def predict(model: PipelineModel, df: DataFrame, name: str, score: str | None = None) -> DataFrame:
    """``df`` with a column of 0 or 1, and the probability (or margin) of 1 if ``score`` names one."""
    out = model.transform(df)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    extra = [vector_to_array(source)[1].alias(score)] if score else []
    return out.select(*[F.col(c) for c in df.columns], F.col("prediction").cast("int").alias(name), *extra)


def bagging(train: DataFrame, test: DataFrame, columns: list[str], fraction: float = 0.7, depth: int = 5, seeds: list[int] = SEEDS, name: str = "bagging") -> DataFrame:
    """``test`` with the majority (ties: error) of one tree for each subsample."""
    out = test
    for i, seed in enumerate(seeds):
        model = fit(train.where(hash_share(KEY, 100 * fraction, seed)), "tree", columns, maxDepth=depth)
        out = predict(model, out, f"tree{i}_")
    trees = [f"tree{i}_" for i in range(len(seeds))]
    return out.withColumn(name, majority(trees, tie_is_error=True)).drop(*trees)


def bagging_on_votes(train: DataFrame, test: DataFrame, tools: list[str], name: str = "bagging") -> DataFrame:
    return bagging(train, test, tools, fraction=0.9, depth=len(tools), name=name)


def _folds(df: DataFrame, n: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n))


def stacking(train: DataFrame, test: DataFrame, columns: list[str], bases: tuple[str, ...] = ("tree", "naive_bayes"), folds: int = 2, name: str = "stacking") -> DataFrame:
    """``test`` with the prediction of a logistic regression over the base models' predictions.

    The regression learns from out-of-fold predictions: no base model predicts rows it was trained on.
    """
    numbered = train.withColumn("fold_", _folds(train, folds))
    parts = []
    for k in range(folds):
        part = numbered.where(F.col("fold_") == k)
        for b in bases:
            part = predict(fit(numbered.where(F.col("fold_") != k), b, columns), part, f"{b}_", f"{b}_score_")
        parts.append(part)
    meta = [f"{b}_score_" for b in bases]
    top, threshold = fit_lr_threshold(reduce(DataFrame.unionByName, parts), meta)
    out = test
    for b in bases:
        out = predict(fit(train, b, columns), out, f"{b}_", f"{b}_score_")
    out = predict(top, out, "top_", "stack_score_")
    return out.withColumn(name, (F.col("stack_score_") > threshold).cast("int")).drop("top_", "stack_score_", *meta, *[f"{b}_" for b in bases])


def fit_lr_threshold(train: DataFrame, columns: list[str], max_precision: float = 1.0, max_recall: float = 1.0, thresholds: list[float] = THRESHOLDS, **params) -> tuple[PipelineModel, float]:
    """(model, threshold of the highest F1 among those within the bounds); all thresholds in one aggregation."""
    model = fit(train, "logistic", columns, **params)
    table = grid_thresholds(predict(model, train, "p_", "score"), thresholds).where((F.col("precision") <= max_precision) & (F.col("recall") <= max_recall))
    best = table.orderBy(F.desc("f1"), F.desc(F.col("name").cast("double"))).first()
    return model, float(best.name) if best else 0.5


def linear_combination(train: DataFrame, tools: list[str], **bounds) -> tuple[str, list[float], float, float]:
    """(formula, weights, intercept, threshold) of a logistic regression over votes."""
    model, threshold = fit_lr_threshold(train, tools, **bounds)
    lr = model.stages[-1]
    weights, b = [float(w) for w in lr.coefficients], float(lr.intercept)
    return " + ".join(f"{w:.4f}*{t}" for w, t in zip(weights, tools)) + f" + {b:.4f}", weights, b, threshold


def score_linear(matrix: DataFrame, tools: list[str], weights: list[float], intercept: float, threshold: float) -> DataFrame:
    """Adds score (logistic of the weighted votes) and prediction, as column expressions."""
    z = F.lit(float(intercept))
    for t, w in zip(tools, weights):
        z = z + F.lit(float(w)) * F.col(t)
    return matrix.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("prediction", (F.col("score") > threshold).cast("int"))


def grid_search_lr(train: DataFrame, columns: list[str], folds: int = 5, reg: tuple[float, ...] = (0.1, 0.2, 0.3), elastic: tuple[float, ...] = (0.0, 0.5), weightCol: str | None = None, foldCol: str = "") -> tuple[PipelineModel, dict]:
    """(best model, its parameters); a row counts ``weightCol`` times and stands in the fold ``foldCol`` names, if they are given."""
    weight = {"weightCol": weightCol} if weightCol else {}
    lr = classifier("logistic", len(columns), **weight)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.elasticNetParam, list(elastic)).build()
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="f1", **weight)
    search = CrossValidator(estimator=Pipeline(stages=[_assembler(columns), lr]), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, parallelism=4, seed=1, foldCol=foldCol)
    best = search.fit(train.withColumn("label", F.col("label").cast("double"))).bestModel
    return best, {"regParam": best.stages[-1].getRegParam(), "elasticNetParam": best.stages[-1].getElasticNetParam()}


def cross_validated_trees(train: DataFrame, columns: list[str], seeds: list[int] = SEEDS, fraction: float = 0.7) -> list[tuple[PipelineModel, float, float]]:
    """(tree, accuracy on the rows of its sample, and on those outside) for each seed."""
    out = []
    for seed in seeds:
        numbered = train.withColumn("in_", hash_share(KEY, 100 * fraction, seed))
        model = fit(numbered.where("in_"), "tree", columns)
        right = dict(predict(model, numbered, "p_").groupBy("in_").agg(F.avg((F.col("p_") == F.col("label")).cast("double"))).collect())  # two rows
        out.append((model, right.get(True, 0.0), right.get(False, 0.0)))
    return out


def naive_bayes_counts(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """label, n and, for each tool, how often it says error: all that a Bernoulli model needs."""
    return matrix.groupBy("label").agg(F.count("*").alias("n"), *[F.count_if(F.col(t) == 1).alias(t) for t in tools])


def regression_baseline(train: DataFrame, test: DataFrame, columns: list[str], folds: int = 3, reg: tuple[float, ...] = (0.001, 0.01, 0.1)) -> DataFrame:
    """model, reg_param, rmse, mae, r2 of a linear and a generalised linear regression on votes, cross-validated over ``reg``."""
    rows = []
    numeric = lambda df: _assembler(columns).transform(df.withColumn("label", F.col("label").cast("double")))
    a, b = numeric(train), numeric(test)
    for name, estimator in (("linear", LinearRegression(featuresCol="features_")), ("glm", GeneralizedLinearRegression(featuresCol="features_", family="gaussian"))):
        grid = ParamGridBuilder().addGrid(estimator.regParam, list(reg)).build()
        best = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="label", metricName="rmse"), numFolds=folds, parallelism=4, seed=1).fit(a).bestModel
        out = best.transform(b)
        rows.append((name, float(best.getRegParam()), *[float(RegressionEvaluator(labelCol="label", metricName=m).evaluate(out)) for m in ("rmse", "mae", "r2")]))
    return train.sparkSession.createDataFrame(rows, "model string, reg_param double, rmse double, mae double, r2 double")


def combine_classifiers(train: DataFrame, test: DataFrame, tools: list[str], kinds: tuple[str, ...] = ("tree", "naive_bayes", "logistic", "perceptron")) -> DataFrame:
    """Evaluation of min-k, majority and a second level of models over the models' predictions, the union and the intersection of all tools."""
    def with_all(df: DataFrame) -> DataFrame:
        for k in kinds:
            df = predict(models[k], df, k)
        return df.withColumns({"union": min_k(tools, 1), "all": min_k(tools, len(tools))})

    models = {k: fit(train, k, tools) for k in kinds}
    names = [*kinds, "union", "all"]
    a, b = with_all(train), with_all(test)
    for k in ("logistic", "naive_bayes", "tree"):
        b = predict(fit(a, k, names), b, f"second_{k}")
    return evaluate_many(b, {**{f"min-{k}": min_k(names, k) for k in range(1, len(names) + 1)}, "majority": majority(names, tie_is_error=True), **{f"second_{k}": F.col(f"second_{k}") for k in ("logistic", "naive_bayes", "tree")}})

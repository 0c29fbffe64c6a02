"""Learners of ``pyspark.ml`` behind the same names as the built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame

ESTIMATORS: dict[str, Callable[..., Estimator]] = {
    "linear_svc": LinearSVC,
    "logistic": LogisticRegression,
    "tree": DecisionTreeClassifier,
    "ml_naive_bayes": NaiveBayes,
}


def fit_estimator(rows: DataFrame, features: list[str], learner: str | Estimator, label: str = "label", **options):
    """Fit a named or a given estimator on numeric columns; returns a model for ``apply_estimator``."""
    if isinstance(learner, str):
        if learner not in ESTIMATORS:
            raise ValueError(f"unknown learner {learner!r}; choose from {sorted(ESTIMATORS)}")
        learner = ESTIMATORS[learner](**options)
    estimator = learner.copy()
    estimator.setFeaturesCol("_features").setLabelCol("_label_idx")
    estimator.setPredictionCol("_prediction")
    indexer = StringIndexer(inputCol=label, outputCol="_label_idx", stringOrderType="alphabetAsc").fit(rows)
    back = IndexToString(inputCol="_prediction", outputCol="predicted", labels=indexer.labels)
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    prepared = indexer.transform(rows).select(*features, "_label_idx")
    return Pipeline(stages=[assembler, estimator, back]).fit(prepared)


def apply_estimator(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    internal = [c for c in scored.columns if c.startswith("_") or c in {"rawPrediction", "probability"}]
    return scored.drop(*internal)

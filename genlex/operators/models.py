"""Classifiers on the feature matrix."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__x", array_to_vector(F.col("features")))


def fit_logistic(train: DataFrame, c: float = 100.0) -> PipelineModel:
    """H8: L1 logistic regression with inverse strength ``c`` (as in the usual per-sample formulation). ``train``: features array, label 0/1."""
    n = max(1, train.count())
    return Pipeline(stages=[LogisticRegression(featuresCol="__x", labelCol="label", elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False, maxIter=200)]).fit(_vectors(train))


def fit_trees(train: DataFrame, depth: int = 10, rounds: int = 912, rate: float = 0.2239, min_rows: int = 78, seed: int = 42) -> PipelineModel:
    """H9: gradient-boosted trees; close to, not equal to, other implementations of the same parameters."""
    gbt = GBTClassifier(featuresCol="__x", labelCol="label", maxDepth=depth, maxIter=rounds, stepSize=rate, minInstancesPerNode=min_rows, seed=seed)
    return Pipeline(stages=[gbt]).fit(_vectors(train))


def predict(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(word, prediction, probability)`` of one model."""
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(_vectors(rows)).select("word", (p >= threshold).cast("int").alias("prediction"), p.alias("probability"))


def predict_external(rows: DataFrame, load) -> DataFrame:
    """A model that lives in Python (a transformer, say), in Arrow batches. ``load()`` runs once per worker and returns ``score(words) -> probabilities``."""
    import pandas as pd

    def run(batches):
        score = load()
        for pdf in batches:
            q = list(score(pdf["word"].tolist()))
            yield pd.DataFrame({"word": pdf["word"], "prediction": [int(x >= 0.5) for x in q], "probability": q})

    return rows.select("word").mapInPandas(run, "word string, prediction int, probability double")

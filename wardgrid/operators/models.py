"""Baselines on flat features, by Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSIFIERS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier, "svm": LinearSVC, "perceptron": MultilayerPerceptronClassifier}
REGRESSORS = {"linear": LinearRegression, "elastic_net": lambda **k: LinearRegression(elasticNetParam=0.5, regParam=0.01, **k), "forest": RandomForestRegressor, "boosted": GBTRegressor}


def fit_baseline(train: DataFrame, columns: list[str], kind: str, task: str = "classification", **options: object) -> PipelineModel:
    """train is (label, columns...), without nulls in columns; rows without label are left out."""
    make = (CLASSIFIERS if task == "classification" else REGRESSORS)[kind]
    stages = [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error"), make(labelCol="label", featuresCol="features", **options)]
    return Pipeline(stages=stages).fit(train.where("label is not null"))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with y and score: the probability of class 1, a margin (svm), or the predicted value."""
    out = model.transform(rows)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("prediction")
    return out.withColumn("score", score).withColumn("y", F.col("label")).drop("features", "rawPrediction", "probability", "prediction")

"""Match probabilities by boosted trees."""

from __future__ import annotations

import warnings

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Settings
from kindred.operators import boosting
from kindred.operators.features import FEATURES


KINDS = ("boosted", "plain")


def classifier(kind: str, settings: Settings, label: str) -> GBTClassifier:
    """boosted: all settings. plain: the fallback, with rounds, rate, depth and seed only; every row and feature counts."""
    own = GBTClassifier(featuresCol="features", labelCol=label, maxIter=settings.trees, stepSize=settings.rate, maxDepth=settings.depth, seed=settings.seed)
    if kind == "plain":
        return own
    return own.setMinInstancesPerNode(settings.least_in_node).setSubsamplingRate(settings.subsample).setFeatureSubsetStrategy(str(settings.subsample))


def fitted(kind: str, rows: DataFrame, settings: Settings, label: str) -> PipelineModel:
    """A boosted model is grown in one stage (see boosting); by Spark's own classifier only where tasks can't wait for each
    other or share no folder. A plain one always is: it doesn't depend on what may have failed before."""
    assembler, own = VectorAssembler(inputCols=list(FEATURES), outputCol="features"), classifier(kind, settings, label)
    own._transfer_params_to_java()  # checks the settings
    if kind == "boosted" and (path := boosting.folder(rows.sparkSession)):
        return PipelineModel([assembler, boosting.fit(rows, list(FEATURES), own, label, path)])
    return Pipeline(stages=[assembler, own]).fit(rows)


def fit(rows: DataFrame, settings: Settings = DEFAULT, label: str = "label", kind: str = "boosted") -> PipelineModel:
    """Rows have the features and a label of 0 or 1; the feature order is part of the model. If the classifier of this kind
    can't be set up or fitted, the plain one is, with a warning. The rows are kept on disk meanwhile, as they are read again."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    kept = rows.select(*FEATURES, F.col(label).cast("double").alias(label)).persist(StorageLevel.DISK_ONLY)
    try:
        for k in KINDS[KINDS.index(kind) :]:
            try:
                return fitted(k, kept, settings, label)
            except (TypeError, ValueError, PySparkException) as e:
                if k == KINDS[-1]:
                    raise
                warnings.warn(f"no model of kind {k} ({type(e).__name__}: {str(e)[:200]}); the plain one is fitted", stacklevel=2)
    finally:
        kept.unpersist()


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds score, the probability of a match."""
    made = model.transform(rows).withColumn("score", F.try_element_at(vector_to_array("probability"), F.lit(2)))
    return made.drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)

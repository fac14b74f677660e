"""Feature vectors and the boosted-tree classifier."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from dayrank.config import FeatureConfig
from dayrank.schema import SAMPLE_KEY, feature_columns
from dayrank.session import shared_folder


#: Feature values of a task that trains. The trainer keeps its rows in memory, at 13 to 14 bytes a value as
#: measured, so a task holds and reads some 110 MB.
TASK_VALUES = 8_000_000


def vectors(frame: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Key, label if present, and the features by name as one vector; ids stay outside it."""
    assembler = VectorAssembler(inputCols=feature_columns(cfg.sub_windows, cfg.extras), outputCol="features")
    more = [c for c in ("label", "weight") if c in frame.columns]
    return assembler.transform(frame).select(*SAMPLE_KEY, *more, "features")


def classifier(cfg: FeatureConfig, weighted: bool = False) -> GBTClassifier:
    """Boosted trees of depth 4 on 0.8 of rows and columns, learning rate 0.02, logistic loss.

    A row adds at most 1/4 to a node's summed second derivative, so a bound of 2.5 on that sum
    needs at least 10 rows: the nearest setting Spark ML has. ``weighted`` rows count by their weight.
    """
    return GBTClassifier(
        **({"weightCol": "weight"} if weighted else {}),
        featuresCol="features",
        labelCol="label",
        maxDepth=4,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        stepSize=0.02,
        maxIter=cfg.boosting_rounds,
        minInstancesPerNode=10,
        seed=cfg.seed,
        checkpointInterval=10,
        maxMemoryInMB=512,
    )


def by_tasks(rows: DataFrame, n_rows: int, cfg: FeatureConfig) -> DataFrame:
    """Vectors dealt to as many tasks as their number asks for. Files do not do that: the features of a
    row are mostly zeros, so a file of a few MB holds rows that take a hundred times that in memory.
    What one task can hold stays as it lies. Places and order follow from the key, so that a lost
    task finds the same rows in the same order, as the trainer's random numbers go by them."""
    width = len(feature_columns(cfg.sub_windows, cfg.extras))
    tasks = -(-n_rows * width // TASK_VALUES)
    if tasks <= 1:
        return rows
    tasks = max(tasks, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *SAMPLE_KEY).sortWithinPartitions(*SAMPLE_KEY)


def train(training_set: DataFrame, cfg: FeatureConfig) -> GBTClassificationModel:
    """Fit on executors. The training set should be read from storage, as every boosting round
    that loses its cache goes back to it."""
    shared_folder(training_set.sparkSession)
    rows = by_tasks(vectors(training_set, cfg), training_set.count(), cfg)
    return classifier(cfg, "weight" in training_set.columns).fit(rows)


def predict(model: GBTClassificationModel, frame: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Purchase probability per row; the ids travel with the rows."""
    scored = model.transform(vectors(frame, cfg))
    return scored.select(*SAMPLE_KEY, vector_to_array("probability")[1].alias("prob"))


def _described(cfg: FeatureConfig) -> dict[str, object]:
    """What a stored model depends on: the features in their order and their calendar."""
    return {
        "features": feature_columns(cfg.sub_windows, cfg.extras),
        "sub_windows": list(cfg.sub_windows),
        "slot": cfg.slot,
    }


def save_model(model: GBTClassificationModel, path: str, cfg: FeatureConfig) -> None:
    """The model and, beside it, the list of its columns. The list is written last, so that a
    folder with a list holds a whole model."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(_described(cfg))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/columns")


def load_model(spark: SparkSession, path: str, cfg: FeatureConfig) -> GBTClassificationModel:
    """A stored model, if it was trained on the columns that ``cfg`` gives, in the same order."""
    stored = json.loads(spark.read.text(f"{path}/columns").first()["value"])
    wanted = _described(cfg)
    if stored != wanted:
        differ = [
            f"column {at} is {a!r} in the model and {b!r} here"
            for at, (a, b) in enumerate(zip(stored["features"], wanted["features"], strict=False))
            if a != b
        ] or [f"{key} is {stored[key]!r} in the model and {wanted[key]!r} here"
              for key in ("sub_windows", "slot") if stored[key] != wanted[key]]
        sizes = f"{len(stored['features'])} and {len(wanted['features'])} columns"
        raise ValueError(f"the model at {path} was trained on other features ({sizes}): {'; '.join(differ[:3])}")
    model = GBTClassificationModel.load(f"{path}/model")
    if model.numFeatures != len(wanted["features"]):
        raise ValueError(f"the model at {path} takes {model.numFeatures} features, its list names {len(wanted['features'])}")
    return model

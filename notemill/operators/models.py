"""``pyspark.ml`` classifiers by name, class weights, and an rbf feature map."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.evaluate import balance_weights
from notemill.operators.forest import SparseForest
from notemill.operators.linear import SquaredHinge

# Marks a grid value that leaves a parameter at its default.
UNSET = "unset"
# Projection rows that a task of ``random_fourier`` holds at a time.
HELD_ROWS = 1 << 15
# Weights of a linear model in one row of its packed form.
HELD_WEIGHTS = 1 << 15


class UnsupportedOption(ValueError):
    """An option Spark's estimator does not offer; grid runs record it as an error row."""


@dataclass(frozen=True)
class Family:
    """An estimator and the options it understands, by their option name."""

    make: Callable[[], object]
    options: Mapping[str, str]


FAMILIES: dict[str, Family] = {
    "LinearSVC": Family(
        lambda: LinearSVC(standardization=False), {"tol": "tol", "fit_intercept": "fitIntercept", "max_iter": "maxIter"}
    ),
    "MultinomialNB": Family(lambda: NaiveBayes(modelType="multinomial"), {"alpha": "smoothing"}),
    "BernoulliNB": Family(lambda: NaiveBayes(modelType="bernoulli"), {"alpha": "smoothing"}),
    "LogisticRegression": Family(
        lambda: LogisticRegression(standardization=False),
        {"tol": "tol", "fit_intercept": "fitIntercept", "max_iter": "maxIter"},
    ),
    "RandomForestClassifier": Family(
        RandomForestClassifier,
        {"n_estimators": "numTrees", "max_depth": "maxDepth", "random_state": "seed", "max_features": "featureSubsetStrategy"},
    ),
    "GradientBoostingClassifier": Family(
        GBTClassifier,
        {"learning_rate": "stepSize", "n_estimators": "maxIter", "max_depth": "maxDepth", "random_state": "seed"},
    ),
}


# Families that sum a gradient over all rows in every step.
BY_GRADIENT = ("LinearSVC", "LogisticRegression")


def make_classifier(name: str, options: Mapping[str, object], weight_sum: float | None = None):
    """Estimator of a family with the options it knows; the others are ignored.

    ``C`` of the linear families becomes ``regParam = 1 / (C * sum of weights)`` because Spark
    averages the loss. ``weight_sum`` is the number of training rows, or the sum of their weights.
    """
    if name not in FAMILIES:
        raise UnsupportedOption(f"unknown classifier {name!r}; known: {sorted(FAMILIES)}")
    family = FAMILIES[name]
    given = {k: v for k, v in options.items() if v != UNSET and v is not None}
    if name == "LinearSVC" and given.get("loss", "hinge") != "hinge":
        return squared_hinge(given)
    if name == "RandomForestClassifier":
        return sparse_forest(given)
    estimator = family.make()
    for option, value in given.items():
        if option in family.options and estimator.hasParam(family.options[option]):
            estimator._set(**{family.options[option]: value})
    if name == "LinearSVC" and given.get("penalty", "l2") != "l2":
        raise UnsupportedOption(f"penalty {given['penalty']!r} with the hinge loss: only l2")
    if name == "LogisticRegression" and given.get("penalty", "l2") == "l1":
        estimator.setElasticNetParam(1.0)
    if name in ("LinearSVC", "LogisticRegression") and "C" in given:
        if not weight_sum:
            raise UnsupportedOption("C needs the number of training rows")
        estimator.setRegParam(1.0 / (float(given["C"]) * weight_sum))
    if given.get("class_weight") == "balanced" and estimator.hasParam("weightCol"):
        estimator.setWeightCol("weight")
    return estimator


def squared_hinge(given: Mapping[str, object]) -> SquaredHinge:
    """The linear machine on the squared hinge loss, with either penalty."""
    if given["loss"] != "squared_hinge" or given.get("penalty", "l2") not in ("l1", "l2"):
        raise UnsupportedOption(f"loss {given['loss']!r} with penalty {given.get('penalty', 'l2')!r}")
    if given.get("fit_intercept", True) is False:
        raise UnsupportedOption("squared_hinge without an intercept")
    return SquaredHinge(
        C=float(given.get("C", 1.0)),
        penalty=str(given.get("penalty", "l2")),
        tol=float(given.get("tol", 1e-4)),
        max_iter=int(given.get("max_iter", 100)),
        weight="weight" if given.get("class_weight") == "balanced" else None,
    )


def sparse_forest(given: Mapping[str, object]) -> SparseForest:
    """Spark's forest makes every row as long as the vocabulary; this one costs what the rows hold."""
    return SparseForest(
        trees=int(given.get("n_estimators", 20)),
        max_depth=int(given.get("max_depth", 5)),
        max_features=str(given.get("max_features", "auto")),
        seed=int(given.get("random_state", 0)),
        weight="weight" if given.get("class_weight") == "balanced" else None,
    )


@dataclass(frozen=True)
class OneClass:
    """Stands for a model whose training rows all had one label."""

    label: int

    def transform(self, docs: DataFrame) -> DataFrame:
        sure = array_to_vector(F.array(F.lit(1.0 - self.label), F.lit(float(self.label))))
        return docs.withColumn("prediction", F.lit(float(self.label))).withColumn("probability", sure)


def with_weights(train: DataFrame) -> DataFrame:
    """Balanced class weights as a ``weight`` column; there is one weight per class to broadcast."""
    return train.join(F.broadcast(balance_weights(train).select("label", "weight")), "label")


def random_fourier(docs: DataFrame, size: int = 256, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Replace ``features`` by random Fourier features, whose dot product nears the rbf kernel.

    The projection row of a feature index is drawn from (seed, index), so no matrix is shipped and
    every task draws the same rows.
    """
    rest = [f for f in docs.schema.fields if f.name != "features"]
    shift = np.random.default_rng([seed, 1 << 40]).uniform(0, 2 * np.pi, size)
    scale = np.sqrt(2 * gamma)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            out = np.empty((len(batch), size))
            for n, (index, value) in enumerate(zip(batch["_index"], batch["_value"])):
                sums = np.zeros(size)
                # A dense vector lists its values only.
                for i, v in zip(range(len(value)) if index is None else index, value):
                    if i not in rows:
                        if len(rows) >= HELD_ROWS:
                            rows.clear()
                        rows[i] = np.random.default_rng([seed, int(i)]).normal(0, scale, size)
                    sums += v * rows[i]
                out[n] = np.sqrt(2.0 / size) * np.cos(sums + shift)
            yield batch.drop(columns=["_index", "_value"]).assign(mapped=list(out))

    held = F.unwrap_udt("features")  # as an array, a sparse vector would be as long as the vocabulary
    sparse = docs.select(*[f.name for f in rest], held["indices"].alias("_index"), held["values"].alias("_value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return sparse.mapInPandas(project, f"{schema}, mapped array<double>").select(
        *[f.name for f in rest], array_to_vector("mapped").alias("features")
    )


def polynomial(docs: DataFrame, degree: int = 2) -> DataFrame:
    """Replace ``features`` by all their products up to a degree; meant for few features."""
    if degree not in (2, 3):
        raise UnsupportedOption("the polynomial map has degree two or three")
    renamed = docs.withColumnRenamed("features", "_features")
    expand = PolynomialExpansion(degree=degree, inputCol="_features", outputCol="features")
    return expand.transform(renamed).drop("_features")


def predictions(model, test: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept columns, label, pred, score); the score is a probability where there is one."""
    out = model.transform(test)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = vector_to_array("rawPrediction")[1]
    return out.select(
        "doc_id",
        *keep,
        F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("pred"),
        score.alias("score"),
    )


def term_weights(model, names: DataFrame, fold: int) -> DataFrame:
    """(fold, term, weight) of a linear model; its coefficients already live on the driver."""
    if not hasattr(model, "coefficients"):
        return names.select(F.lit(fold).alias("fold"), "term", F.lit(None).cast("double").alias("weight"))
    spark = names.sparkSession
    held = model.coefficients.toArray()
    # As bytes: a row per weight would take ten times the room on the driver, in every fold.
    parts = [(lo, held[lo : lo + HELD_WEIGHTS].tobytes()) for lo in range(0, len(held), HELD_WEIGHTS)]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in zip(batch.column("first").to_pylist(), batch.column("part").to_pylist()):
                weight = np.frombuffer(part, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(weight), dtype=np.int32)), pa.array(weight)], names=["index", "weight"])

    weights = spark.createDataFrame(parts, "first int, part binary").mapInArrow(opened, "index int, weight double")
    return names.join(weights, "index").select(F.lit(fold).alias("fold"), "term", "weight")

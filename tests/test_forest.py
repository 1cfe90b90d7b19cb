"""Forests over sparse rows against Spark's trees."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from notemill.operators import experiments, forest, models


def data(seed=1, n=400, size=10):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.6)
    y = (x[:, 0] - 0.8 * x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y, weight=None, size=None):
    rows = []
    for i, (row, label) in enumerate(zip(x, y)):
        held = np.flatnonzero(row)
        v = Vectors.dense(row) if i % 7 == 0 and size is None else Vectors.sparse(size or len(row), held.tolist(), row[held].tolist())
        rows.append((i, int(label), float(1 if weight is None else weight[i]), v))
    return spark.createDataFrame(rows, ["doc_id", "label", "weight", "features"]).repartition(3)


def told(model, docs):
    out = model.transform(docs).select("doc_id", "prediction", vector_to_array("probability").alias("p")).orderBy("doc_id")
    return [(r["prediction"], [round(p, 9) for p in r["p"]]) for r in out.collect()]


@pytest.mark.parametrize("classes,weighted", [(2, False), (3, True)])
def test_a_tree_of_all_rows_is_that_of_spark(spark, monkeypatch, classes, weighted):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(forest, "CELLS", 3000)  # a few nodes a pass
    x, y = data()
    y = y + (classes - 2) * (x[:, 3] > 0.4)
    weight = np.random.default_rng(3).integers(1, 4, len(x)) if weighted else None
    docs = frame(spark, x, y, weight)
    held = "weight" if weighted else None
    got = forest.SparseForest(1, 4, "all", weight=held, bootstrap=False).fit(docs)
    want = DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=1)
    want = (want.setWeightCol("weight") if weighted else want).fit(docs)
    assert told(got, docs) == told(want, docs)


@pytest.mark.parametrize("max_features", ["all", "0.5"])
def test_a_forest_is_as_good_as_that_of_spark(spark, max_features):
    x, y = data()
    train, test = frame(spark, x[:250], y[:250]), frame(spark, x[250:], y[250:])
    right = lambda model: np.mean([p == label for (p, _), label in zip(told(model, test), y[250:])])
    options = {"n_estimators": 20, "max_depth": 5, "random_state": 7, "max_features": max_features}
    model = experiments.fit(train, "RandomForestClassifier", options)
    spark_model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=7, featureSubsetStrategy=max_features).fit(train)
    assert len({str(t.splits) for t in model.trees}) == 20
    assert right(model) >= right(spark_model) - 0.06
    assert told(model, test) == told(experiments.fit(train, "RandomForestClassifier", options), test)


def test_rows_cost_what_they_hold(spark):
    """Rows as long as the largest vocabulary; a forest over dense rows needs 2 GB for them alone, and more for its nodes."""
    x, y = data(n=500, size=40)
    docs = frame(spark, x, y, size=1 << 20)
    model = models.make_classifier("RandomForestClassifier", {"n_estimators": 5, "max_depth": 3, "max_features": "all"}).fit(docs)
    assert all(f < 40 for t in model.trees for f, _ in t.splits.values())
    assert np.mean([p == label for (p, _), label in zip(told(model, docs), y)]) > 0.7


@pytest.mark.parametrize("label", [None, -1.0, 0.5])
def test_labels_must_be_classes(spark, label):
    docs = spark.createDataFrame([(0, 1.0, Vectors.sparse(3, [0], [1.0])), (1, label, Vectors.sparse(3, [], []))], ["doc_id", "label", "features"])
    with pytest.raises(ValueError, match="1 of them"):
        forest.SparseForest().fit(docs)


def test_rows_without_a_value(spark):
    docs = spark.createDataFrame([(i, i % 3 // 2, Vectors.sparse(3, [], [])) for i in range(30)], ["doc_id", "label", "features"])
    model = forest.SparseForest(bootstrap=False).fit(docs)
    assert set(map(str, told(model, docs))) == {str((0.0, [round(2 / 3, 9), round(1 / 3, 9)]))}


def test_points_of_many_values():
    values, weights = np.arange(100.0), np.ones(100)
    points = forest.cut_points(values, weights, 32)
    assert len(points) == 31 and points[0] == 2.5
    assert forest.cut_points(np.array([0.0, 1.0]), np.array([5.0, 1.0]), 32) == [0.5]


def test_a_tree_that_drew_no_row(spark):
    docs = spark.createDataFrame([(0, 1, Vectors.sparse(3, [0], [1.0])), (1, 0, Vectors.sparse(3, [], []))], ["doc_id", "label", "features"])
    model = forest.SparseForest(trees=40, max_features="all").fit(docs)
    assert any(t.sums[forest.ROOT].sum() == 0 for t in model.trees)
    assert all(sum(p) == 1.0 for _, p in told(model, docs))


def test_thresholds_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 150)
    x, y = data()
    docs = frame(spark, x, y)
    model = forest.SparseForest(5, 4, "all").fit(docs)
    assert np.mean([p == label for (p, _), label in zip(told(model, docs), y)]) > 0.7

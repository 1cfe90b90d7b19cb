"""Squared hinge fits against the conditions that only the least objective meets."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from notemill.operators import experiments, linear, models


def data(seed=1, n=300, size=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.5)
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) + 0.2 > 0).astype(int)
    return x, y


def frame(spark, x, y, weight=None):
    rows = []
    for i, (row, label) in enumerate(zip(x, y)):
        held = np.flatnonzero(row)
        v = Vectors.dense(row) if i % 7 == 0 else Vectors.sparse(len(row), held.tolist(), row[held].tolist())
        rows.append((i, int(label), float(1 if weight is None else weight[i]), v))
    return spark.createDataFrame(rows, ["doc_id", "label", "weight", "features"]).repartition(3)


def slope(x, y, c, w, l1):
    full = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    short = np.maximum(0, 1 - sign * (full @ w))
    gradient = full.T @ (-2 * c * sign * short)
    return linear.pseudo_gradient(w, gradient) if l1 else gradient + w


@pytest.mark.parametrize("penalty,C", [("l2", 1.0), ("l2", 0.01), ("l1", 1.0), ("l1", 0.05)])
def test_fit_is_the_minimum(spark, monkeypatch, penalty, C):
    monkeypatch.setattr(linear, "BLOCK_ROWS", 40)
    x, y = data()
    weight = np.random.default_rng(3).random(len(x)) + 0.5
    model = linear.SquaredHinge(C, penalty, tol=1e-7, max_iter=200, weight="weight").fit(frame(spark, x, y, weight))
    # A convex objective is least where its slope, one-sided at zero weights, vanishes.
    at_start = np.abs(slope(x, y, C * weight, np.zeros(13), penalty == "l1")).max()
    assert np.abs(slope(x, y, C * weight, model.weights, penalty == "l1")).max() < 1e-5 * max(1.0, at_start)
    assert all(b <= a for a, b in zip(model.objectives, model.objectives[1:]))
    if (penalty, C) == ("l1", 0.05):
        assert 0 < np.count_nonzero(model.weights) < 10


def test_predictions_and_weights_by_the_factory(spark):
    x, y = data(5)
    docs = frame(spark, x, y).drop("weight")
    model = experiments.fit(docs, "LinearSVC", {"loss": "squared_hinge", "C": 10.0, "class_weight": "balanced"})
    found = {r["doc_id"]: r for r in models.predictions(model, docs).collect()}
    margin = x @ model.coefficients.toArray() + model.intercept
    assert all(abs(found[i]["score"] - m) < 1e-9 and found[i]["pred"] == int(m > 0) for i, m in enumerate(margin))
    assert np.mean([found[i]["pred"] == y[i] for i in found]) > 0.8
    names = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "index int, term string")
    weights = {r["term"]: r["weight"] for r in models.term_weights(model, names, 2).collect()}
    assert max(weights, key=weights.get) == "t0" and min(weights, key=weights.get) == "t1"


@pytest.mark.parametrize("options", [{"loss": "hinge", "penalty": "l1"}, {"loss": "log"}, {"loss": "squared_hinge", "penalty": "l3"}])
def test_unknown_forms_are_refused(options):
    with pytest.raises(models.UnsupportedOption):
        models.make_classifier("LinearSVC", options)

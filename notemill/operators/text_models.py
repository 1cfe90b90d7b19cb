"""Classifiers that read texts, behind one interface: learn from ``train``, predict ``test``.

They need no vectors, so any of them can be cross-validated, held out or put into a grid beside the
estimators of ``models``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators import bayes, neighbours, rules, sampling, set_neighbours, sparse_neighbours
from notemill.operators.vectors import TermOptions
from notemill.scale import cut

Predictor = Callable[[DataFrame, DataFrame, Mapping[str, object]], DataFrame]


def _rules(train: DataFrame, test: DataFrame, params: Mapping[str, object]) -> DataFrame:
    patterns = params["rules"]
    return rules.rule_predict(test, rules.rule_stats(train, patterns), patterns)


def _prints(train: DataFrame, test: DataFrame, params: Mapping[str, object]) -> DataFrame:
    prints = neighbours.class_prints(train, params.get("sample_size", 10), params.get("seed", 1))
    return neighbours.print_predict(test, prints)


def _bit_knn(train: DataFrame, test: DataFrame, params: Mapping[str, object]) -> DataFrame:
    return neighbours.bit_knn(
        test,
        params.get("sample_size", 10),
        params.get("k", 5),
        params.get("seed", 1),
        params.get("rank_vote", False),
        train,
    )


def _bit_knn_all(train: DataFrame, test: DataFrame, params: Mapping[str, object]) -> DataFrame:
    return set_neighbours.predict(train, test, params.get("k", 5))


def _text_knn(train: DataFrame, test: DataFrame, params: Mapping[str, object]) -> DataFrame:
    both = train.withColumn("fold", F.lit(0)).unionByName(test.withColumn("fold", F.lit(1)))
    options = params.get("terms", TermOptions())
    return sparse_neighbours.predict(both, [1], params.get("n_neighbors", 5), params.get("weights", "uniform"), options)


def _mined(train: DataFrame, test: DataFrame, params: Mapping[str, object]) -> DataFrame:
    return rules.mined_predict(train, test, **params)


TEXT_CLASSIFIERS: dict[str, Predictor] = {
    "rules": _rules,
    "mined_rules": _mined,
    "class_print": _prints,
    "bit_knn": _bit_knn,
    "bit_knn_all": _bit_knn_all,
    "text_knn": _text_knn,
    "majority": lambda train, test, params: bayes.majority(test, train),
}

# Read no texts, so there are none to write.
TEXTLESS = ("majority",)


def predict(name: str, train: DataFrame, test: DataFrame, params: Mapping[str, object] | None = None) -> DataFrame:
    """(doc_id, label, pred) of ``test`` by a classifier that learned from ``train``."""
    found = TEXT_CLASSIFIERS[name](train, test, params or {}).select("doc_id", "label", F.col("pred").cast("int").alias("pred"))
    # A vote has no probability: the predicted class stands for it.
    return found.withColumn("score", F.col("pred").cast("double"))


def cross_validate(
    docs: DataFrame, name: str, params: Mapping[str, object] | None = None, folds: int = 5, seed: int = 0
) -> DataFrame:
    """Predictions of all folds: (fold, doc_id, label, pred, score). Folds are drawn over ids, not texts."""
    folded = docs.join(sampling.kfold(docs.select("doc_id"), folds, seed), "doc_id")
    if name not in TEXTLESS:
        folded = cut(folded)  # every fold reads the texts several times
    columns = ["doc_id", "label", "text"]
    parts = [
        predict(
            name,
            folded.where(F.col("fold") != k).select(*columns),
            folded.where(F.col("fold") == k).select(*columns),
            params,
        ).withColumn("fold", F.lit(k))
        for k in range(folds)
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def holdout(
    docs: DataFrame, name: str, params: Mapping[str, object] | None = None, share: float = 0.2, seed: int = 0
) -> DataFrame:
    split = docs.join(sampling.holdout(docs.select("doc_id"), share, seed), "doc_id")
    columns = ["doc_id", "label", "text"]
    return predict(name, split.where("is_test = 0").select(*columns), split.where("is_test = 1").select(*columns), params)

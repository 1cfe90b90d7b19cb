"""Metrics, curves and reports over a predictions table (doc_id, fold, label, pred, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.scale import running_totals

METRICS = ("precision", "recall", "f1", "acc", "spc", "npv")


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of the four outcomes of two boolean columns, per group of ``keys``."""
    return df.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, specificity and negative predictive value."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
        _ratio(tn, tn + fp).alias("spc"),
        _ratio(tn, tn + fn).alias("npv"),
    )


def fold_metrics(predictions: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    return scores(confusion(predictions, F.col("pred") == 1, F.col("label") == 1, keys))


def fold_summary(per_fold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over folds, the population deviation of F1 and the mean outcome counts."""
    return per_fold.groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in METRICS],
        F.stddev_pop("f1").alias("std"),
        *[F.avg(c).alias(c) for c in ("tn", "fp", "fn", "tp")],
    )


def macro_scores(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall averaged over the classes."""
    predicted = predictions.groupBy(*keys, F.col("pred").alias("class")).agg(
        F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("pred") == F.col("label")).alias("hit")
    )
    actual = predictions.groupBy(*keys, F.col("label").alias("class")).agg(
        F.count(F.lit(1)).alias("n_gold")
    )
    both = predicted.join(actual, [*keys, "class"], "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("hit", "n_pred", "n_gold")}
    return both.groupBy(*keys).agg(
        F.avg(_ratio(n["hit"], n["n_pred"])).alias("precision_macro"),
        F.avg(_ratio(n["hit"], n["n_gold"])).alias("recall_macro"),
    )


def roc_bins(predictions: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Per distinct score, how many positives and negatives have it and have it or more."""
    ties = predictions.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return running_totals(ties, keys, [F.desc("score")], {"tp": "pos", "fp": "neg"})


def _sized_bins(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bins with the class sizes of their group, which are sums over the bins already written."""
    bins = roc_bins(predictions, keys)
    sizes = bins.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return bins.join(sizes, list(keys))


def roc_points(predictions: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, for the probability of class 1."""
    return _sized_bins(predictions, keys).select(
        *keys,
        _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )


def auc(predictions: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing."""
    wins = F.col("pos") * ((F.col("n_neg") - F.col("fp")) + F.col("neg") / 2)
    return (
        _sized_bins(predictions, keys)
        .groupBy(*keys)
        .agg(
            F.try_divide(F.sum(wins), F.first("n_pos").cast("double") * F.first("n_neg")).alias("auc")
        )
    )


def mean_roc(predictions: DataFrame, steps: int = 100, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Mean over folds of the curves read at equally spaced false positive rates.

    Each fold is first reduced to the last and first point on either side of every grid rate, so
    what is interpolated has ``steps + 1`` rows per fold whatever the number of documents.
    """
    points = roc_points(predictions, keys).select(*keys, "fpr", "tpr")
    corners = points.select(*keys).distinct()
    points = points.unionByName(
        corners.select(*keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    )
    cell = F.ceil(F.col("fpr") * steps).cast("int")
    point = F.struct("fpr", "tpr")
    left = points.groupBy(*keys, cell.alias("step")).agg(F.max(point).alias("low"))
    right = points.groupBy(*keys, (F.ceil(F.col("fpr") * steps).cast("int") - 1).alias("step")).agg(
        F.min(point).alias("high")
    )
    grid = corners.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    ahead = Window.partitionBy(*keys).orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    read = (
        grid.join(left, [*keys, "step"], "left")
        .join(right, [*keys, "step"], "left")
        .select(
            *keys,
            "step",
            F.max("low").over(behind).alias("low"),
            F.min("high").over(ahead).alias("high"),
        )
    )
    rate = F.col("step") / steps
    slope = F.try_divide(
        F.col("high.tpr") - F.col("low.tpr"), F.col("high.fpr") - F.col("low.fpr")
    )
    tpr = F.col("low.tpr") + F.coalesce((rate - F.col("low.fpr")) * slope, F.lit(0.0))
    return read.groupBy("step").agg(F.avg(tpr).alias("tpr")).select(rate.alias("fpr"), "tpr")


def aligned_mean_roc(points: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Mean over folds of the points at the same position of each fold's curve."""
    placed = running_totals(
        points.withColumn("_one", F.lit(1)), keys, [F.desc("threshold")], {"pos": "_one"}
    )
    return placed.groupBy("pos").agg(
        F.avg("fpr").alias("fpr"), F.avg("tpr").alias("tpr"), F.avg("threshold").alias("threshold")
    )


def misses(predictions: DataFrame) -> DataFrame:
    """Distinct ids of misclassified documents, sorted."""
    return predictions.where(F.col("pred") != F.col("label")).select("doc_id").distinct().orderBy("doc_id")


def prediction_report(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.col("doc_id").alias("mrn"), "pred", F.col("label").alias("gold"), F.col("score").alias("prob")
    )


def prediction_pivot(predictions: DataFrame, folds: int) -> DataFrame:
    """One row per document: prediction and probability of every fold, ``-`` where absent."""
    cells = []
    for k in range(folds):
        here = F.col("fold") == k
        for name, column in (("pred", "pred"), ("prob", "score")):
            value = F.max(F.when(here, F.col(column).cast("string")))
            cells.append(F.coalesce(value, F.lit("-")).alias(f"{name}_{k}"))
    return predictions.groupBy(F.col("doc_id").alias("mrn"), F.col("label").alias("gold")).agg(*cells)


def weight_pivot(weights: DataFrame, folds: int) -> DataFrame:
    """(fold, term, weight) to one row per term and one column per fold."""
    return weights.groupBy("term").agg(
        *[F.max(F.when(F.col("fold") == k, F.col("weight"))).alias(f"fold_{k}") for k in range(folds)]
    )


def balance_weights(docs: DataFrame, label: str = "label") -> DataFrame:
    """Class weights n / (classes * size of the class)."""
    sizes = docs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    both = Window.partitionBy(F.lit(0))
    return sizes.select(
        label,
        "n",
        (F.sum("n").over(both) / (F.count(F.lit(1)).over(both) * F.col("n"))).alias("weight"),
    )

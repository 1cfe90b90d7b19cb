"""Naive Bayes in closed form: counts per class and term, log odds per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.vectors import TermOptions, term_bags
from notemill.scale import cut, lookup_join


def cross_validated(
    docs: DataFrame, alpha: float = 1.0, options: TermOptions = TermOptions()
) -> DataFrame:
    """Multinomial naive Bayes over folds, each document scored by the other folds' counts.

    One pass counts the term mass per (fold, class). What a fold trains on is the sum over all
    folds minus its own, so nothing is fitted k times. The vocabulary is that of all documents.
    ``docs`` has doc_id, label, fold and text.
    """
    # Written once, one row a document, and so are the counts: neither is made again below.
    bags = cut(term_bags(docs, options, ["label", "fold"]))
    tf = bags.select("doc_id", "label", "fold", F.inline("bag"))
    by_fold = cut(
        tf.groupBy("term", "fold").agg(
            _mass(1).alias("pos"), _mass(0).alias("neg"), F.count(F.lit(1)).alias("rows")
        )
    )
    # Folds are few, so a term's counts per fold fit in one map.
    by_term = by_fold.groupBy("term").agg(
        F.sum("pos").alias("pos_all"),
        F.sum("neg").alias("neg_all"),
        F.sum("rows").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("pos", "neg")))).alias("own"),
    )
    own = F.element_at("own", F.col("fold"))
    per_doc = (
        lookup_join(tf, by_term, "term", ["doc_id"], "inner", frequency="rows")
        .withColumn("_pos", F.col("pos_all") - own["pos"])
        .withColumn("_neg", F.col("neg_all") - own["neg"])
        .groupBy("doc_id")
        .agg(
            F.sum(F.col("tf") * (F.ln(F.col("_pos") + alpha) - F.ln(F.col("_neg") + alpha))).alias("odds"),
            F.sum("tf").alias("length"),
        )
    )
    constants = _training_constants(bags, by_fold, by_term, alpha)
    odds = (
        F.coalesce("odds", F.lit(0.0))
        + F.coalesce("length", F.lit(0)) * F.col("per_token")
        + F.col("prior")
    )
    return (
        bags.select("doc_id", "label", "fold")
        .join(per_doc, "doc_id", "left")
        .join(F.broadcast(constants), "fold")  # one row per fold
        .select("doc_id", "label", "fold", odds.alias("log_odds"))
        .select(
            "*",
            (F.lit(1.0) / (1 + F.exp(-F.col("log_odds")))).alias("score"),
            (F.col("log_odds") > 0).cast("int").alias("pred"),
        )
    )


def _mass(label: int) -> Column:
    return F.sum(F.when(F.col("label") == label, F.col("tf")).otherwise(0))


def _training_constants(
    docs: DataFrame, by_fold: DataFrame, by_term: DataFrame, alpha: float
) -> DataFrame:
    """Per fold, the log prior odds and the log odds every token adds, from the other folds."""
    sizes = docs.groupBy("fold").agg(
        F.count_if(F.col("label") == 1).alias("pos_docs"),
        F.count_if(F.col("label") == 0).alias("neg_docs"),
    )
    masses = by_fold.groupBy("fold").agg(F.sum("pos").alias("pos_mass"), F.sum("neg").alias("neg_mass"))
    every = Window.partitionBy(F.lit(0))  # over one row per fold
    smoothing = by_term.agg(F.count(F.lit(1))).scalar() * alpha

    def others(column: str) -> Column:
        value = F.coalesce(column, F.lit(0))
        return F.sum(value).over(every) - value

    return (
        sizes.join(masses, "fold", "left")
        .select("fold", *[others(c).alias(c) for c in ("pos_docs", "neg_docs", "pos_mass", "neg_mass")])
        .select(
            "fold",
            (F.ln("pos_docs") - F.ln("neg_docs")).alias("prior"),
            (F.ln(F.col("neg_mass") + smoothing) - F.ln(F.col("pos_mass") + smoothing)).alias("per_token"),
        )
    )


def majority(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Every document predicted as the most frequent class of ``train``, the smaller label on a tie."""
    sizes = (docs if train is None else train).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.min_by("label", F.struct(-F.col("n"), "label"))).scalar()
    return docs.select("doc_id", "label", best.alias("pred"))

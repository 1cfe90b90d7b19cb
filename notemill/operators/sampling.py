"""Folds, splits and samples in a seeded random order that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.scale import hashed_rank, running_totals


def kfold(docs: DataFrame, k: int, seed: int = 0, ident: str = "doc_id") -> DataFrame:
    """Contiguous folds 0..k-1 over the shuffled order; the first ``n mod k`` get one row more."""
    ranked = hashed_rank(docs, ident, seed, rank="_rank", total="_n")
    return ranked.select(*docs.columns, fold_of(F.col("_rank") - 1, F.col("_n"), k).alias("fold"))


def fold_of(place: Column, n: Column, k: int) -> Column:
    base, extra = F.floor(n / k), n % k
    head = extra * (base + 1)
    return (
        F.when(place < head, F.floor(place / (base + 1)))
        .otherwise(extra + F.floor((place - head) / F.greatest(base, F.lit(1))))
        .cast("int")
    )


def holdout(docs: DataFrame, share: float, seed: int = 0, ident: str = "doc_id") -> DataFrame:
    """Add ``is_test``: 1 for exactly ``ceil(share * n)`` rows."""
    ranked = hashed_rank(docs, ident, seed, rank="_rank", total="_n")
    test = F.col("_rank") <= F.ceil(F.col("_n") * share)
    return ranked.select(*docs.columns, test.cast("int").alias("is_test"))


def percent_split(docs: DataFrame, percent: float, seed: int = 0, ident: str = "doc_id") -> DataFrame:
    """Add ``moved``: 1 for the last ``ceil(percent / 100 * n)`` rows of the shuffled order."""
    ranked = hashed_rank(docs, ident, seed, rank="_rank", total="_n")
    moved = F.col("_rank") > F.col("_n") - F.ceil(F.lit(percent) * F.col("_n") / 100)
    return ranked.select(*docs.columns, moved.cast("int").alias("moved"))


def ordered_percent_split(docs: DataFrame, percent: float, order: str) -> DataFrame:
    """``percent_split`` of the given order instead of a shuffled one."""
    ranked = running_totals(docs.withColumn("_one", F.lit(1)), [], [F.col(order)], {"_rank": "_one"})
    n = docs.agg(F.count(F.lit(1))).scalar()
    moved = F.col("_rank") > n - F.ceil(F.lit(percent) * n / 100)
    return ranked.select(*docs.columns, moved.cast("int").alias("moved"))


def stratified(
    docs: DataFrame, share: float, label: str = "label", seed: int = 0, ident: str = "doc_id"
) -> DataFrame:
    """``int(share * n)`` rows of each class."""
    ranked = hashed_rank(docs, ident, seed, [label], "_rank", "_n")
    return ranked.where(F.col("_rank") <= F.floor(F.col("_n") * share)).select(docs.columns)


def learning_sizes(least: int, most: int, step: int) -> list[float]:
    """Shares of a learning curve: least, least + step, ... below most and never above 100%."""
    return [p / 100 for p in range(least, most, step) if p <= 100]


def per_class(
    docs: DataFrame, size: int, label: str = "label", seed: int = 0, ident: str = "doc_id"
) -> DataFrame:
    """A fixed number of rows of each class.

    Only ids are ranked; the picked ones, ``size`` per class at most, are then looked up, so texts
    are not shuffled.
    """
    ranked = hashed_rank(docs.select(ident, label), ident, seed, [label], "_rank", "_n")
    picked = ranked.where(F.col("_rank") <= size).select(ident)
    return docs.join(F.broadcast(picked), ident, "left_semi")


def shuffled(docs: DataFrame, seed: int = 0, ident: str = "doc_id") -> DataFrame:
    """Add ``place``, the 1-based position in the random order."""
    return hashed_rank(docs, ident, seed, rank="place", total="_n").drop("_n")

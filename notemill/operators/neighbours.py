"""Nearest neighbours: class prints, sampled bit vectors, and exact blocked vector search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import let, overlap
from notemill.operators.sampling import per_class
from notemill.operators.vectors import entity_bits, entity_keys


def class_prints(docs: DataFrame, sample_size: int, seed: int = 1) -> DataFrame:
    """(label, bits): the union of the entity sets of a fixed-size sample of each class.

    From a plain ``explode`` Spark derives a filter on the bits and moves it below the sample: the entities of
    all documents would be made, by as few tasks as the scan has.
    """
    sample = entity_bits(per_class(docs, sample_size, seed=seed))
    return (
        sample.select("label", F.explode_outer("bits").alias("bit"))
        .where("bit IS NOT NULL")
        .groupBy("label")
        .agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    )


def print_predict(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Label of the print that shares most entities with the document, the first label on a tie.

    Prints come from a sample of fixed size, so all of them ride along as one value.
    """
    all_prints = prints.agg(F.array_sort(F.collect_list(F.struct("label", "bits")))).scalar()

    def best(bits: Column) -> Column:
        shared = F.transform(
            "_prints",
            lambda p: F.struct(
                (-overlap(p["bits"], bits)).alias("minus"), p["label"].alias("label")
            ),
        )
        return F.array_min(shared)

    return (
        docs.withColumn("_prints", all_prints)
        .select("doc_id", "label", let(entity_keys(F.col("text")), best).alias("_best"))
        .select(
            "doc_id", "label", F.col("_best.label").alias("pred"), (-F.col("_best.minus")).alias("shared")
        )
    )


def bit_knn(
    docs: DataFrame, sample_size: int, k: int, seed: int = 1, rank_vote: bool = False, train: DataFrame | None = None
) -> DataFrame:
    """Vote of the ``k`` nearest documents of a fixed-size sample per class of ``train`` (or of ``docs``).

    Distance is the number of entities only one of the two documents has; ties go to the smaller
    sample id, votes to the smaller label. With ``rank_vote`` the shared-entity counts of each
    class are sorted upwards and, for each rank, the class with the smallest count gets the vote.
    """
    sample = entity_bits(per_class(docs if train is None else train, sample_size, seed=seed)).select(
        F.struct("label", "doc_id", "bits").alias("s")
    )
    samples = sample.agg(F.array_sort(F.collect_list("s"))).scalar()

    def votes(bits: Column) -> Column:
        counted = F.transform(
            "_samples",
            lambda s: F.struct(
                overlap(s["bits"], bits).alias("shared"),
                F.size(s["bits"]).alias("size"),
                s["doc_id"].alias("sample_id"),
                s["label"].alias("label"),
            ),
        )
        return let(counted, lambda c: _rank_votes(c, k) if rank_vote else _near_votes(c, bits, k))

    return (
        docs.withColumn("_samples", samples)
        .select("doc_id", "label", let(entity_keys(F.col("text")), votes).alias("_votes"))
        .select("doc_id", "label", let(F.col("_votes"), most_votes).alias("pred"))
    )


def _near_votes(counted: Column, bits: Column, k: int) -> Column:
    near = F.array_sort(
        F.transform(
            counted,
            lambda c: F.struct(
                (c["size"] + F.size(bits) - 2 * c["shared"]).alias("distance"),
                c["sample_id"].alias("sample_id"),
                c["label"].alias("label"),
            ),
        )
    )
    return F.transform(F.slice(near, 1, k), lambda n: n["label"])


def _rank_votes(counted: Column, k: int) -> Column:
    """One vote per rank: the class whose count at that rank is smallest, the first on a tie."""
    labels = F.array_sort(F.array_distinct(F.transform(counted, lambda c: c["label"])))

    def upwards(label: Column) -> Column:
        of_label = F.filter(counted, lambda c: c["label"] == label)
        return F.array_sort(F.transform(of_label, lambda c: c["shared"]))

    def vote(rank: Column, per_label: Column) -> Column:
        at_rank = F.transform(
            per_label,
            lambda p: F.struct(F.element_at(p["counts"], rank).alias("shared"), p["label"].alias("label")),
        )
        return F.array_min(at_rank)["label"]

    per_label = F.transform(
        labels, lambda lab: F.struct(upwards(lab).alias("counts"), lab.alias("label"))
    )
    return let(
        per_label, lambda p: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda rank: vote(rank, p))
    )


def most_votes(votes: Column) -> Column:
    """The most frequent label of an array, the smallest on a tie."""
    tally = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("label")),
    )
    return F.array_min(tally)["label"]


# Rows of one side that one task compares at a time.
BLOCK_ROWS = 4096
# Queries of a block whose similarities are put in order at a time.
SLICE_ROWS = 256


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_rows: int | None = None,
    item_rows: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine ``k`` nearest items of every query: (query_id, item_id, similarity, rank).

    ``queries`` has query_id and vector, ``items`` item_id and vector. Both are dealt into blocks
    by a hash of the id. A task compares one block of each by a matrix product and keeps only the
    best ``k`` per query, so at most k rows per query and item block are shuffled, never the pairs.
    An item is not its own neighbour when the ids are equal.
    """
    n_query = _blocks(queries, query_rows, block_rows)
    n_item = _blocks(items, item_rows, block_rows)
    left = queries.select(
        "query_id",
        "vector",
        F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_item - 1))).alias("ib"),
    )
    right = items.select(
        "item_id",
        "vector",
        F.pmod(F.xxhash64("item_id"), F.lit(n_item)).cast("int").alias("ib"),
        F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"),
    )

    def compare(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        i = i.sort_values("item_id")
        ids = i["item_id"].to_numpy()
        asked = q["query_id"].to_numpy()
        sims = _unit(q["vector"]) @ _unit(i["vector"]).T
        found = []
        for lo in range(0, len(asked), SLICE_ROWS):
            part = sims[lo : lo + SLICE_ROWS]
            part[asked[lo : lo + SLICE_ROWS, None] == ids[None, :]] = -np.inf
            row, place = largest(part, k)
            found.append(pd.DataFrame({"query_id": asked[lo + row], "item_id": ids[place], "similarity": part[row, place]}))
        out = pd.concat(found)
        return out[np.isfinite(out["similarity"])]

    kept = (
        left.groupBy("qb", "ib")
        .cogroup(right.groupBy("qb", "ib"))
        .applyInPandas(compare, "query_id long, item_id long, similarity double")
    )
    return top_k(kept, k, n_item)


def largest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the ``k`` largest values of each row, the smaller place first on a tie.

    A partial sort finds each row's k-th value; only what reaches it is put in order.
    """
    np.fmax(values, -np.inf, out=values)  # not-a-number comes last
    take = min(k, values.shape[1])
    least = np.partition(values, values.shape[1] - take, axis=1)[:, -take]
    row, place = np.nonzero(values >= least[:, None])
    order = np.lexsort((place, -values[row, place], row))
    row, place = row[order], place[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[kept], place[kept]


def _blocks(df: DataFrame, rows: int | None, block_rows: int) -> int:
    rows = df.count() if rows is None else rows
    return max(1, -(-rows // block_rows))


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1, length)


# Above this many item blocks the block winners of a query are first merged in slots.
MERGE_BLOCKS = 256


def top_k(kept: DataFrame, k: int, blocks: int = 1) -> DataFrame:
    """Best ``k`` of the block winners; a query has k of them per item block.

    With many blocks they are merged in two steps, so no row gathers all blocks' winners at once.
    """
    place = F.struct((-F.col("similarity")).alias("minus"), "item_id")
    best = F.slice(F.array_sort(F.collect_list(place)), 1, k).alias("best")
    if blocks > MERGE_BLOCKS:
        slot = F.pmod(F.xxhash64("item_id"), F.lit(-(-blocks // MERGE_BLOCKS)))
        local = kept.groupBy("query_id", slot.alias("_slot")).agg(best)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        winners = local.groupBy("query_id").agg(merged)
    else:
        winners = kept.groupBy("query_id").agg(best)
    return winners.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id",
        F.col("b.item_id").alias("item_id"),
        (-F.col("b.minus")).alias("similarity"),
        (F.col("pos") + 1).alias("rank"),
    )


def knn_vote(near: DataFrame, labels: DataFrame, weights: str = "uniform") -> DataFrame:
    """Class of each query by the labels (item_id, label) of its neighbours.

    ``uniform`` counts neighbours, ``distance`` weighs them by one over the cosine distance.
    The smaller label wins a tie.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    distance = F.greatest(1 - F.col("similarity"), F.lit(1e-12))
    weight = F.lit(1.0) if weights == "uniform" else 1 / distance
    votes = (
        near.join(labels, "item_id").groupBy("query_id", "label").agg(F.sum(weight).alias("votes"))
    )
    place = F.struct((-F.col("votes")).alias("minus"), "label")
    return votes.groupBy("query_id").agg(
        F.min_by("label", place).alias("pred"), F.max("votes").alias("votes")
    )


def dense(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Array form of an ``pyspark.ml`` vector column, for ``nearest``."""
    from pyspark.ml.functions import vector_to_array

    return df.select(*names, vector_to_array(column, "float32").alias("vector"))

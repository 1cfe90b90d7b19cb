"""Concept tagging against a dictionary, concept names, and word-neighbour expansion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import char_ngrams, comma_free, let, pad, tokens, windows
from notemill.operators import postings
from notemill.operators.vectors import term_lookup
from notemill.scale import cut, lookup_join

GRAM = 3  # characters of a gram
SIMILARITY = 0.7
CONCEPT_ID = "^(-?|neg)[Cc][0-9]{7}$"
NO_NAME = "N/A"


def normalised_term(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def concept_terms(dictionary: DataFrame) -> DataFrame:
    """One concept per normalised term: preferred entries first, then the smallest id."""
    place = F.struct(F.when(F.col("ispref") == "Y", 0).otherwise(1), "cui")
    return (
        dictionary.select(normalised_term(F.col("str")).alias("term"), "cui", "ispref")
        .where("term != ''")
        .groupBy("term")
        .agg(F.min_by("cui", place).alias("cui"))
    )


def term_places(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, start, length, term): every run of up to ``longest`` tokens."""

    def places(toks: Column) -> Column:
        return F.concat(*[grams(toks, n) for n in range(1, longest + 1)])

    def grams(toks: Column, n: int) -> Column:
        return F.transform(
            windows(toks, n, " "),
            lambda term, i: F.struct(
                (i + 1).alias("start"), F.lit(n).alias("length"), term.alias("term")
            ),
        )

    # An outer explode, lest Spark make the places once more beneath the exchange of the texts, to see if there are any.
    found = docs.select("doc_id", F.explode_outer(let(tokens(F.col("text")), places)).alias("_g"))
    return found.where("_g IS NOT NULL").select("doc_id", "_g.*")


def concept_spans(docs: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """Every place where up to ``longest`` tokens of a document are a dictionary term."""
    return term_lookup(term_places(docs, longest), cut(terms), ["doc_id", "start"], "inner")


def similar_terms(strings: DataFrame, terms: DataFrame, threshold: float, size: int = GRAM) -> DataFrame:
    """(term, cui, found, similarity): the closest dictionary term of each of the ``strings`` (term).

    Similarity is the share of distinct character ``size``-grams that two padded strings have in common
    (Jaccard). A string and a term within ``threshold`` share a certain number of grams, so they share one
    of their rarest: only those are looked up, in the lists of the terms of a fitting length. Ties go to
    the smaller concept, then to the smaller term.
    """
    grams = F.array_distinct(char_ngrams(pad(F.col("term")), size, size))
    held = cut(terms.select("term", "cui", grams.alias("grams")).where(F.size("grams") > 0))
    asked = cut(strings.select("term").distinct().select("term", grams.alias("grams")).where(F.size("grams") > 0))
    frequencies = cut(held.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df")))

    def prefix(side: DataFrame, ident: str) -> DataFrame:
        """The rarest grams, so many that any partner must hold one of them."""
        placed = lookup_join(side.select(F.col("term").alias(ident), F.size("grams").alias("size"), F.explode("grams").alias("gram")), frequencies, "gram", [ident], "inner")
        inside = Window.partitionBy(ident)
        placed = placed.withColumns({
            "known": F.count(F.lit(1)).over(inside),
            "place": F.row_number().over(inside.orderBy("df", "gram")) - 1,
        })
        return placed.where(F.col("place") <= F.col("known") - F.ceil(F.col("size") * threshold - 1e-9))

    # Marked, because a string that is a term must meet it.
    marked = held.withColumn("term", F.concat(F.lit("="), F.col("term")))
    entries = prefix(marked, "item_id").select(
        F.col("gram").alias("term"), F.col("size").alias("level"), "item_id", F.col("size").alias("item_size"),
        (F.col("known") - F.col("place")).alias("item_left"),
    )
    readers = prefix(asked, "query_id").select(
        "query_id", F.col("gram").alias("term"), "size", (F.col("known") - F.col("place")).alias("left")
    )
    lists = postings.described(postings.block_sizes(entries), readers)
    opened = postings.opened(readers, lists).where(
        (F.col("level") >= F.col("size") * threshold - 1e-9) & (F.col("level") * threshold <= F.col("size") + 1e-9)
    )
    needed = F.ceil((F.col("size") + F.col("item_size")) * (threshold / (1 + threshold)) - 1e-9)
    pairs = (
        postings.met(opened, cut(postings.placed(entries, lists)), ["size", "left"])
        .where(F.least("left", "item_left") >= needed)
        .select("query_id", F.expr("substring(item_id, 2)").alias("found"))
        .distinct()
    )
    scored = pairs.join(asked.select(F.col("term").alias("query_id"), F.col("grams").alias("own")), "query_id").join(
        held.withColumnRenamed("term", "found"), "found"
    )
    shared = F.size(F.array_intersect("own", "grams"))
    near = scored.withColumn("similarity", F.round(shared / (F.size("own") + F.size("grams") - shared), 9)).where(
        F.col("similarity") >= threshold
    )
    place = F.struct(-F.col("similarity"), "cui", "found")
    return (
        near.groupBy(F.col("query_id").alias("term"))
        .agg(F.min_by(F.struct("cui", "found", "similarity"), place).alias("b"))
        .select("term", "b.*")
    )


def fuzzy_spans(docs: DataFrame, terms: DataFrame, longest: int, threshold: float = SIMILARITY) -> DataFrame:
    """Every place where up to ``longest`` tokens are similar to a dictionary term, with the closest one."""
    placed = term_places(docs, longest)
    return term_lookup(placed, cut(similar_terms(placed, terms, threshold)), ["doc_id", "start"], "inner")


def tag_fuzzy(docs: DataFrame, terms: DataFrame, longest: int, threshold: float = SIMILARITY) -> DataFrame:
    """Best non-overlapping similar spans: the most similar first, then longer, then earlier ones."""
    spans = fuzzy_spans(docs, terms, longest, threshold)
    return spans if longest == 1 else best_spans(spans, ["similarity", "length"])


def best_spans(spans: DataFrame, best: Sequence[str] = ("length",)) -> DataFrame:
    """Non-overlapping spans of each document, those of largest ``best`` first, then earlier ones.

    Documents are spread over the tasks and read in sorted order; only the token positions taken
    in the current document are held.
    """
    ordered = spans.repartition("doc_id").sortWithinPartitions(
        "doc_id", *[F.desc(c) for c in best], "start"
    )
    return ordered.mapInPandas(_keep_free_spans, ordered.schema)


def _keep_free_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, taken = None, set()
    for batch in batches:
        keep = []
        for doc, start, length in zip(batch["doc_id"], batch["start"], batch["length"]):
            if doc != current:
                current, taken = doc, set()
            places = range(start, start + length)
            free = taken.isdisjoint(places)
            if free:
                taken.update(places)
            keep.append(free)
        yield batch[keep]


def tag(docs: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """Best non-overlapping spans; single tokens cannot overlap."""
    spans = concept_spans(docs, terms, longest)
    return spans if longest == 1 else best_spans(spans)


def concept_text(best: DataFrame) -> DataFrame:
    """Concept ids of each document in text order, joined by spaces."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start", "cui"))), lambda s: s["cui"])
    return best.groupBy("doc_id").agg(F.array_join(ids, " ").alias("text"))


def preferred_names(dictionary: DataFrame) -> DataFrame:
    """First preferred entry of each concept."""
    return (
        dictionary.where("ispref = 'Y'").groupBy("cui").agg(F.min("str").alias("name"))
    )


def is_concept(term: Column) -> Column:
    return term.rlike(CONCEPT_ID)


def concept_of(term: Column) -> Column:
    """Dictionary id of a concept feature, without its negation mark."""
    return F.upper(F.regexp_replace(term, "^(-|[nN][eE][gG])", ""))


def resolve_names(features: DataFrame, dictionary: DataFrame, cache: DataFrame | None = None, column: str = "term") -> DataFrame:
    """``term (concept name)`` for concept features: the cache first, then the preferred entries."""
    names = preferred_names(dictionary)
    if cache is not None:
        names = cache.select("cui", "name").unionByName(
            names.join(cache.select("cui"), "cui", "left_anti")
        )
    keyed = features.withColumn("cui", F.when(is_concept(F.col(column)), concept_of(F.col(column))))
    named = lookup_join(keyed, names, "cui", [column])
    shown = F.concat(
        F.col(column), F.lit(" ("), comma_free(F.coalesce("name", F.lit(NO_NAME))), F.lit(")")
    )
    return named.withColumn("name", F.when(F.col("cui").isNotNull(), shown).otherwise(F.col(column)))


def expand_neighbours(
    seeds: DataFrame, edges: DataFrame, number: int, levels: int, all_levels: bool = False
) -> DataFrame:
    """Words reached from seeds over the ``number`` nearest neighbours, ``levels + 1`` hops away.

    ``seeds`` has seed and word columns, ``edges`` word, rank and neighbour. Duplicates are removed
    after every hop, so a hop multiplies the words by ``number`` at most.
    """
    near = (
        edges.where(F.col("rank") <= number)
        .groupBy("word")
        .agg(F.collect_set("neighbour").alias("near"))  # at most ``number`` words
    )
    hops, frontier = [], seeds.select("seed", "word").distinct()
    for _ in range(levels + 1):
        # A word many seeds lead to is a hot key of the frontier.
        reached = lookup_join(frontier, near, "word", ["seed"], "inner")
        frontier = reached.select("seed", F.explode("near").alias("word")).distinct()
        hops.append(frontier)
    if not all_levels:
        return frontier
    merged = hops[0]
    for hop in hops[1:]:
        merged = merged.union(hop)
    return merged.distinct()


def model_edges(model, words: Sequence[str], number: int, spark) -> DataFrame:
    """Edges of a few words from a fitted ``Word2VecModel``."""
    rows = [
        (w, i + 1, n) for w in words for i, (n, _) in enumerate(model.findSynonymsArray(w, number))
    ]
    return spark.createDataFrame(rows, "word string, rank int, neighbour string")

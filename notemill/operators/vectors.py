"""Term counts, vocabularies, TF-IDF and entity presence, in long form and as vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.scale import cut, hashed_rank, lookup_join


@dataclass(frozen=True)
class TermOptions:
    """How a text becomes terms."""

    low: int = 1
    high: int = 1
    stop_words: tuple[str, ...] = ()
    analyzer: str = "word"
    min_df: int = 1
    max_df: int | None = None
    binary: bool = False


def terms(text: Column, options: TermOptions = TermOptions()) -> Column:
    if options.analyzer == "word":
        return T.ngrams(T.without(T.tokens(text), options.stop_words), options.low, options.high)
    if options.analyzer in ("char", "char_wb"):
        return T.char_ngrams(text, options.low, options.high, options.analyzer == "char_wb")
    raise ValueError(f"unknown analyzer {options.analyzer!r}")


def bag(found: Column) -> Column:
    """(term, tf) of the distinct terms of an array, counted in the row: sorted, then cut into runs."""

    def runs(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def measured(first: Column) -> Column:
            return F.transform(
                first,
                lambda i, k: F.struct(
                    F.get(ordered, i).alias("term"),
                    (F.coalesce(F.get(first, k + 1), F.size(ordered)) - i).cast("long").alias("tf"),
                ),
            )

        return F.when(F.size(ordered) > 0, T.let(starts, measured))

    return T.let(F.array_sort(found), runs)


def term_bags(docs: DataFrame, options: TermOptions = TermOptions(), carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carried columns, bag): each row of ``docs`` is one document and stays where it is."""
    found = terms(F.col("text"), options)
    if options.binary:
        counted = F.transform(
            F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("tf"))
        )
    else:
        counted = bag(found)
    return docs.select("doc_id", *carry, counted.alias("bag"))


def term_counts(
    docs: DataFrame, options: TermOptions = TermOptions(), carry: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, carried columns, term, tf), without a shuffle.

    From a plain ``inline`` Spark derives a filter on the bag and moves it to the scan: bags would be made
    twice, the first time by as few tasks as the scan has.
    """
    return term_bags(docs, options, carry).select("doc_id", *carry, F.inline_outer("bag")).where("term IS NOT NULL")


def vocabulary(docs: DataFrame, options: TermOptions = TermOptions()) -> DataFrame:
    """(term, df, cf) within the document-frequency bounds.

    Terms are made distinct inside each document's row, so only partial counts are shuffled.
    """
    counted = (
        docs.select(F.explode_outer(F.array_distinct(terms(F.col("text"), options))).alias("term"))
        .where("term IS NOT NULL")  # see ``term_counts``
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return bounded(counted, options)


def bounded(counted: DataFrame, options: TermOptions) -> DataFrame:
    kept = counted.where(F.col("df") >= options.min_df)
    return kept if options.max_df is None else kept.where(F.col("df") <= options.max_df)


def indexed_vocabulary(vocab: DataFrame) -> DataFrame:
    """Number the terms from 0 in an order any run repeats."""
    return hashed_rank(vocab, "term", "vocabulary", rank="_rank", total="_n").select(
        *vocab.columns, (F.col("_rank") - 1).alias("index")
    )


def smoothed_idf(df: Column, n: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


# A vocabulary of at most so many bytes, counted before, is sent to every executor.
BROADCAST_BYTES = 128 << 20
ROW_BYTES = 64  # what a term's row takes beside its letters


def tfidf(docs: DataFrame, options: TermOptions = TermOptions(), carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carried columns, term, tf, tfidf), each document's weights scaled to unit length."""
    # Texts are tokenised once for the vocabulary and once for the counts: the terms of all documents
    # take many times the room of the texts when they are written in between.
    # Documents are dealt by id before, so that their terms need no exchange for the length.
    counts = term_counts(docs.select("doc_id", "text", *carry).repartition("doc_id"), options, carry)
    n = docs.agg(F.count(F.lit(1))).scalar()
    # Written once: its size is measured, and the join reads it for its hot and for its other terms.
    vocab = cut(vocabulary(docs, options))
    idf = vocab.select("term", "df", smoothed_idf(F.col("df"), n).alias("idf"))
    weighted = term_lookup(counts, idf, ["doc_id"], "inner", "df", table_bytes(vocab))
    weighted = weighted.withColumn("_w", F.col("tf") * F.col("idf"))
    return unit_length(weighted, "doc_id", "_w", "tfidf").select("doc_id", *carry, "term", "tf", "tfidf")


def term_lookup(
    rows: DataFrame,
    terms: DataFrame,
    spread: Sequence[str],
    how: str = "left",
    frequency: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """``lookup_join`` on ``term``, by sending the table to every executor where it is small enough.

    ``terms`` is measured, so it should be a written table, unless its ``size`` is told.
    """
    if (table_bytes(terms) if size is None else size) > BROADCAST_BYTES:
        return lookup_join(rows, terms, "term", spread, how, frequency)
    values = [c for c in terms.columns if c != "term"]
    return rows.join(F.broadcast(terms), "term", how).select(*rows.columns, *values)


def table_bytes(vocab: DataFrame) -> int:
    """Size of a table of terms, counted."""
    counted = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("letters")).first()
    return counted["n"] * ROW_BYTES + (counted["letters"] or 0)


def unit_length(weighted: DataFrame, doc: str, weight: str, name: str) -> DataFrame:
    """Divide by the length of the document's vector; a document's terms are bounded by its text."""
    length = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(doc)))
    return weighted.withColumn(name, F.col(weight) / length)


def entities(text: Column) -> Column:
    """Distinct words and sentences (as sorted word lists) of a lower-cased text."""

    def both(split: Column) -> Column:
        words = F.transform(F.flatten(split), lambda w: F.concat(F.lit("w|"), w))
        wholes = F.transform(split, lambda s: F.concat(F.lit("s|"), F.array_join(s, " ")))
        return F.array_distinct(F.concat(words, wholes))

    return T.let(
        F.transform(
            F.split(F.lower(text), r"\. ", -1), lambda s: F.array_sort(F.split(s, " ", -1))
        ),
        both,
    )


def entity_presence(docs: DataFrame) -> DataFrame:
    """(doc_id, entity) once per entity of a document."""
    return docs.select("doc_id", F.explode(entities(F.col("text"))).alias("entity"))


def entity_keys(text: Column) -> Column:
    """Sorted 64-bit keys of a text's entities, the set form of a bit vector."""
    return F.array_sort(F.array_distinct(F.transform(entities(text), lambda e: F.xxhash64(e))))


def entity_bits(docs: DataFrame) -> DataFrame:
    return docs.withColumn("bits", entity_keys(F.col("text")))


# The most terms a fitted vocabulary may hold; it lives on the driver as one model array.
VOCABULARY_BOUND = 1 << 20


class VocabularyTooLarge(ValueError):
    """More terms than the vectoriser may hold; raise ``min_df``."""


def preprocess(docs: DataFrame, mode: str, options: TermOptions = TermOptions()) -> PipelineModel | None:
    """Fit the stages of a mode: ``text`` and ``bits`` need none, ``count`` or ``tfidf`` a model.

    The model turns the ``terms`` column of ``prepare`` into ``features``.
    """
    if mode in ("text", "bits"):
        return None
    if mode not in ("count", "tfidf"):
        raise ValueError(f"unknown preprocessing {mode!r}")
    prepared = prepare(docs, mode, options).select("terms")
    counter = CountVectorizer(
        inputCol="terms",
        outputCol="features" if mode == "count" else "counts",
        minDF=float(options.min_df),
        binary=options.binary,
        vocabSize=VOCABULARY_BOUND,
    )
    if options.max_df is not None:
        counter.setMaxDF(float(options.max_df))
    counts: CountVectorizerModel = counter.fit(prepared)
    if len(counts.vocabulary) >= VOCABULARY_BOUND:
        raise VocabularyTooLarge(f"{VOCABULARY_BOUND} terms or more; raise min_df")
    if mode == "count":
        return PipelineModel([counts])
    fitted = IDF(inputCol="counts", outputCol="unused").fit(counts.transform(prepared))
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(fitted.idf.toArray() + 1.0), inputCol="counts", outputCol="weighted"
    )
    return PipelineModel([counts, weigh, Normalizer(p=2.0, inputCol="weighted", outputCol="features")])


def prepare(docs: DataFrame, mode: str, options: TermOptions = TermOptions()) -> DataFrame:
    if mode == "text":
        return docs
    if mode == "bits":
        return entity_bits(docs)
    return docs.withColumn("terms", terms(F.col("text"), options))

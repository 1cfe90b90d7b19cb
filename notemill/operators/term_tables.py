"""A vectoriser whose vocabulary is a table: any number of terms, nothing of it on the driver.

Fitting numbers the terms of the training texts and writes them beside their document frequencies.
Transforming looks the terms of any texts up in that table and gathers each document's own entries, so
a document's vector is as large as its text and never as large as the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.operators import vectors
from notemill.operators.vectors import TermOptions, bounded, indexed_vocabulary, smoothed_idf, table_bytes, term_bags, term_counts, term_lookup, vocabulary
from notemill.scale import cut, running_totals

MODES = ("count", "tfidf")


@dataclass(frozen=True)
class TermTable:
    """A fitted vocabulary (term, df, index), the number of training texts, and how texts become terms."""

    terms: DataFrame
    n: int
    mode: str
    options: TermOptions

    def transform(self, docs: DataFrame) -> DataFrame:
        """``docs`` without text, with ``indices`` and ``values`` in the order of the indices.

        Terms outside the vocabulary are left out; a document without any has empty lists. TF-IDF values
        are scaled to unit length. ``doc_id`` names a document; columns called indices or values are replaced.
        """
        carry = [c for c in docs.columns if c not in ("doc_id", "text", "indices", "values")]
        counts = term_counts(docs, self.options)
        known = term_lookup(counts, self.terms, ["doc_id"], "inner", "df")
        weight = F.col("tf").cast("double")
        if self.mode == "tfidf":
            weight = weight * smoothed_idf(F.col("df"), F.lit(self.n))
        entries = known.select("doc_id", F.struct("index", weight.alias("w")).alias("e"))
        gathered = entries.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list("e")).alias("_e"))
        values = F.col("_e.w")
        if self.mode == "tfidf":
            length = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
            gathered = gathered.withColumn("_length", length)
            values = F.transform("_e", lambda e: e["w"] / F.col("_length"))
        gathered = gathered.select("_doc", F.col("_e.index").alias("indices"), values.alias("values"))
        joined = docs.select("doc_id", *carry).join(gathered, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
        return joined.select(
            "doc_id",
            *carry,
            F.coalesce("indices", F.array().cast("array<long>")).alias("indices"),
            F.coalesce("values", F.array().cast("array<double>")).alias("values"),
        )

    def vectors(self, docs: DataFrame, size: int) -> DataFrame:
        """``docs`` without text, with the sparse vectors that ``pyspark.ml`` estimators read, ``size`` places long, as ``features``.

        Unlike ``transform`` it takes every row for a document, whatever its id; ids may repeat or be null.
        """
        return self.of_bags(held_bags(docs, self.options), size)

    def of_bags(self, bags: DataFrame, size: int) -> DataFrame:
        """``vectors`` of documents as ``held_bags`` gives them."""
        carry = bags.schema["_rest"].dataType.fieldNames()[1:]
        schema = T.StructType([bags.schema["_rest"], T.StructField("features", VectorUDT())])
        if table_bytes(self.terms) <= vectors.BROADCAST_BYTES:
            made = bags.mapInArrow(self._looked_up(size), schema)
        else:
            made = self._joined(bags).mapInArrow(packed_vectors(size, self.mode == "tfidf"), schema)
        return made.select(*[F.col(f"_rest.`{c}`").alias(c) for c in carry], "features")

    def _joined(self, bags: DataFrame) -> DataFrame:
        """(_rest, index, w): the places and weights of each document, as lists."""
        # All terms of a row leave the task that numbers it, so a rerun that numbers rows otherwise mixes none.
        rows = bags.select(F.monotonically_increasing_id().alias("doc_id"), "*")
        counts = rows.select("doc_id", "_rest", F.inline_outer(F.arrays_zip("term", "tf")))
        weight = F.col("tf").cast("double")
        if self.mode == "tfidf":
            weight = weight * smoothed_idf(F.col("df"), F.lit(self.n))
        known = term_lookup(counts, self.terms, ["doc_id"], "left", "df")
        # Null where the row has no term, or none that the vocabulary knows; lists leave nulls out.
        entry = F.when(F.col("index").isNotNull(), F.struct(F.col("index").cast("int").alias("index"), weight.alias("w")))
        gathered = known.groupBy("doc_id").agg(F.first("_rest").alias("_rest"), F.array_sort(F.collect_list(entry)).alias("_e"))
        return gathered.select("_rest", F.col("_e.index").alias("index"), F.col("_e.w").alias("w"))

    def _looked_up(self, size: int):
        """Bags to vectors by a table that is small enough for every task."""
        known = self.terms.select("term", F.col("index").cast("int").alias("index"), smoothed_idf(F.col("df"), F.lit(self.n)).alias("idf")).toArrow()
        held = self.terms.sparkSession.sparkContext.broadcast(known.combine_chunks())
        tfidf, pack = self.mode == "tfidf", packed_vectors(size, self.mode == "tfidf")

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = held.value.column("term").combine_chunks()
            number, idf = held.value.column("index").to_numpy(), held.value.column("idf").to_numpy()
            for batch in batches:
                row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column("term")), 0).to_numpy())
                place = pc.fill_null(pc.index_in(batch.column("term").flatten(), terms), -1).to_numpy()
                found = place >= 0
                row, place, w = row[found], place[found], batch.column("tf").flatten().to_numpy()[found].astype(np.float64)
                order = np.lexsort((number[place], row))
                row, place, w = row[order], place[order], w[order]
                offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                made = [number[place], w * idf[place] if tfidf else w]
                made = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in made]
                yield pa.RecordBatch.from_arrays([batch.column("_rest"), *made], names=["_rest", "index", "w"])

        return lambda batches: pack(lists(batches))

    def size(self) -> int:
        return self.terms.count()

    def save(self, path: str) -> None:
        """The terms as a table, the rest as one line of JSON; an existing one is replaced."""
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        line = json.dumps({"n": self.n, "mode": self.mode, "options": asdict(self.options)})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def held_bags(docs: DataFrame, options: TermOptions) -> DataFrame:
    """(_rest, term, tf): a document's other columns, its distinct terms and their counts, as arrays; null without any."""
    carry = [c for c in docs.columns if c not in ("text", "features")]
    rest = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("_rest")
    bags = term_bags(docs.select(F.lit(None).alias("doc_id"), rest, "text"), options, ["_rest"])
    return bags.select("_rest", F.col("bag.term").alias("term"), F.col("bag.tf").cast("array<int>").alias("tf"))


def packed_vectors(size: int, unit: bool):
    """Lists of places and weights as sparse vectors; of unit length, if asked for and not empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, w = batch.column("index"), batch.column("w")
            places, values = index.flatten(), w.flatten().to_numpy()
            starts = index.offsets.to_numpy() - index.offsets[0].as_py()
            if unit:
                row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                values = values / np.sqrt(np.bincount(row, values * values, batch.num_rows))[row]
            offsets = pa.array(starts.astype(np.int32))
            held = [
                pa.array(np.zeros(batch.num_rows, np.int8)),
                pa.array(np.full(batch.num_rows, size, np.int32)),
                pa.ListArray.from_arrays(offsets, places),
                pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64())),
            ]
            packed = pa.StructArray.from_arrays(held, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), packed], names=["_rest", "features"])

    return made


def fit(docs: DataFrame, mode: str = "tfidf", options: TermOptions = TermOptions()) -> TermTable:
    """Learn the vocabulary of ``docs`` (doc_id, text) within the bounds of ``options``."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    terms = cut(indexed_vocabulary(vocabulary(docs, options)))
    return TermTable(terms, docs.count(), mode, options)


def fit_bags(bags: DataFrame, mode: str, options: TermOptions) -> TermTable:
    """``fit`` on documents as ``held_bags`` gives them, with terms numbered from the most frequent on."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    terms = bounded(bags.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), options)
    placed = running_totals(terms.withColumn("_one", F.lit(1)), [], [F.desc("df"), F.col("term")], {"_place": "_one"})
    return TermTable(cut(placed.select("term", "df", (F.col("_place") - 1).alias("index"))), bags.count(), mode, options)


def load(spark: SparkSession, path: str) -> TermTable:
    (row,) = spark.read.text(f"{path}/settings").collect()
    held = json.loads(row["value"])
    options = {**held["options"], "stop_words": tuple(held["options"]["stop_words"])}
    return TermTable(spark.read.parquet(f"{path}/terms"), held["n"], held["mode"], replace(TermOptions(), **options))


def as_vectors(transformed: DataFrame, size: int, name: str = "features") -> DataFrame:
    """Add the sparse vector that ``pyspark.ml`` estimators read; ``size`` is that of the vocabulary."""
    made = F.udf(lambda i, v: SparseVector(size, i, v), VectorUDT())
    return transformed.withColumn(name, made("indices", "values"))

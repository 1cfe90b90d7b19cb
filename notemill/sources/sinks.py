"""Writers for corpora, reports and models."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.sources.note_files import FORMAT, NoteFiles


def write_corpus(docs: DataFrame, path: str, label: str = "label", mode: str = "append") -> None:
    """Partitioned by label, so a reader of one class skips the others."""
    docs.write.partitionBy(label).mode(mode).parquet(path)


def write_text(
    docs: DataFrame,
    path: str,
    label: str = "label",
    ident: str = "doc_id",
    text: str = "text",
    mode: str = "append",
    classes: Sequence[str] | None = None,
) -> None:
    """One file per row, ``<path>/<label>/<id>.txt``, as ``scans.read_labelled_corpus`` reads it.

    ``classes`` names the folders of labels 0, 1, ...; without it the label itself is the name. Two rows of
    one label and id, and names that cannot be those of files, are refused before or while writing.
    """
    folder = F.col(label).cast("string")
    if classes is not None:
        folder = F.get(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int"))
    rows = docs.select(folder.alias("label"), F.col(ident).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    twice = rows.groupBy("label", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "doc_id").first()
    if twice is not None:
        raise ValueError(f"two documents would be written to {twice['label']}/{twice['doc_id']}.txt")
    docs.sparkSession.dataSource.register(NoteFiles)
    rows.write.format(FORMAT).mode(mode).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.option("header", True).mode(mode).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_names(spark: SparkSession, model: CountVectorizerModel) -> DataFrame:
    """Vocabulary of a fitted vectoriser; its size is bounded by the vectoriser's ``vocabSize``."""
    terms = pa.array(model.vocabulary, pa.string())
    return spark.createDataFrame(pa.table({"index": pa.array(range(len(terms)), pa.int32()), "term": terms}))

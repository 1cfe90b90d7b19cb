"""The corpus pipeline: five operators over ``documents``, each stage written and read again.

Every stage judges the whole of what its predecessor kept, and its decision takes effect before the
next one starts. All but the last return the columns of ``documents``; the mix returns what it takes
of each document. No SQL check: the fingerprints and the classifier cannot be written in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import decontaminate, mixing, simhash, substrings, toxicity
from notemill.llm.tables import load
from notemill.scale import shared_folder

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; labels of the held-out quarter are not learned."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near duplicates."""
    return simhash.one_per_component(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of earlier documents cover."""
    cut = substrings.dedup_substrings(docs)
    # A text that loses nothing keeps its blanks.
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return with_text(docs, cut, text)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark windows cover."""
    marked = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark"))
    return with_text(docs, decontaminate.without_spans(marked), F.col("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def with_text(docs: DataFrame, changed: DataFrame, text) -> DataFrame:
    made = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast("long")}
    return changed.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

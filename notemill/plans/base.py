"""Registration of queries with their SQL checks, and the shared views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.sources.scans import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), spread over the cores when the scan has fewer splits."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Labelled documents: (doc_id, label, text)."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return docs.join(labels, "doc_id").select("doc_id", "label", "text")


# The same view for the SQL checks.
CORPUS_SQL = """corpus AS (
  SELECT d.doc_id, l.quality AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TOKEN_SQL = r"-c\p{Nd}+\b|[\p{L}\p{N}_]{2,}|[a-z0-9_]"


def tokens_sql(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN_SQL}')"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def shuffle_sql(seed: int, ident: str = "doc_id") -> str:
    return f"md5('{seed}|' || CAST({ident} AS VARCHAR)), {ident}"

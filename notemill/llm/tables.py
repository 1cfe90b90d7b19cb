"""Small helpers shared by the operators: row keys, written tables, and Arrow plumbing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: Unicode blanks are not blanks here, only these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null counts none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def version(text: str) -> Column:
    """Tells rows of one doc_id apart; equal rows are interchangeable."""
    return F.xxhash64(F.col(text))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def carried(docs: DataFrame, text: str, made: tuple[str, ...]) -> DataFrame:
    """(_row, _text): the text, and all other columns as one struct, which cannot clash with any name.

    Columns that carry the name of an output in ``made`` are left out: the output replaces them.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in made]
    return docs.select(F.struct(F.lit(True).alias("_"), *rest).alias("_row"), F.col(text).alias("_text"))


def restored(out: DataFrame, docs: DataFrame, text: str, made: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` in their order, then the outputs."""
    kept = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return out.select(*kept, *made)


def lists(values: pa.Array, counts) -> pa.Array:
    """``values`` cut into lists of the given lengths."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)

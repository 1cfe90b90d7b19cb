"""Readers: delimited notes, separated values, CSV, labelled folders, inventories, JSON, lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions.text import anchored, doc_id_of, strip

NOTE_SEPARATOR = "||"
EXCLUDED_LINES = "^[.*]"
# A line also ends at these characters, beside the line feed.
EXTRA_LINE_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def quote(separator: str) -> str:
    return r"\Q" + separator + r"\E"


def parse_notes(raw: DataFrame, separator: str = NOTE_SEPARATOR, id_col: int = 0) -> DataFrame:
    """Note records from a ``value`` column of raw lines; the other columns are carried along.

    Lines without the separator are dropped, the rest is stripped and split.
    """
    carried = [c for c in raw.columns if c != "value"]
    clean = F.regexp_replace("value", r"\ufffd", "")
    rows = raw.select(*carried, F.explode(F.split(clean, EXTRA_LINE_BREAKS, -1)).alias("value"))
    fields = F.split(strip(F.col("value")), quote(separator), -1)
    return (
        rows.where(F.instr("value", separator) > 0)
        .select(*carried, fields.alias("fields"))
        .select(
            *carried,
            F.get("fields", F.lit(id_col)).alias("patient_id"),
            F.get("fields", F.lit(1)).alias("patient_name"),
            "fields",
            field_from_end("fields", 2).alias("note_type"),
            field_from_end("fields", 1).alias("note_text"),
        )
    )


def field_from_end(fields: str | Column, position: int) -> Column:
    """The ``position``-th field from the end, null in shorter rows."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    return F.when(F.size(fields) >= position, F.element_at(fields, -position))


def read_notes(
    spark: SparkSession, path: str, separator: str = NOTE_SEPARATOR, id_col: int = 0
) -> DataFrame:
    """Scan delimited notes; ``seq`` follows the order of lines in each file."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    return parse_notes(raw, separator, id_col)


def parse_separated(
    raw: DataFrame,
    separator: str = ",",
    headers: Sequence[str] | str = (),
    exclude: str = EXCLUDED_LINES,
) -> DataFrame:
    """Split the ``value`` column; with headers, keep records of that width as named columns."""
    if isinstance(headers, str):
        headers = headers.split(separator)
    carried = [c for c in raw.columns if c != "value"]
    stripped = strip(F.col("value"))
    trimmed = F.when(
        F.endswith(stripped, F.lit(separator)),
        F.substring(stripped, F.lit(1), F.length(stripped) - len(separator)),
    ).otherwise(stripped)
    records = raw.where(~F.col("value").rlike(anchored(exclude))).select(
        *carried, F.split(trimmed, quote(separator), -1).alias("record")
    )
    if not headers:
        return records
    return records.where(F.size("record") == len(headers)).select(
        *carried, *[F.get("record", F.lit(i)).alias(h) for i, h in enumerate(headers)]
    )


def read_separated(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    headers: Sequence[str] | str = (),
    exclude: str = EXCLUDED_LINES,
    encoding: str = "utf-8",
) -> DataFrame:
    if encoding.lower().replace("-", "") == "utf8":
        raw = spark.read.text(path)
    else:
        # The text reader is UTF-8 only; a CSV scan whose separator never occurs keeps lines whole.
        raw = (
            spark.read.schema("value string")
            .option("encoding", encoding)
            .option("sep", "\x01")
            .option("quote", "")
            .csv(path)
        )
    return parse_separated(raw, separator, headers, exclude)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Quoted comma-separated values without a header, typed by ``schema``; a quote inside is doubled."""
    return spark.read.schema(schema).option("multiLine", False).option("escape", '"').csv(path)


def read_labelled_corpus(spark: SparkSession, path: str, classes: Sequence[str] = ("no", "yes")) -> DataFrame:
    """``<path>/<class>/<id>.txt`` as (doc_id, label, text); the label is the place in ``classes``."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    )
    label = F.array_position(
        F.array(*[F.lit(c) for c in classes]), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    )
    return files.select(
        doc_id_of(F.col("path")).alias("doc_id"), (label - 1).cast("int").alias("label"), "text"
    ).where(F.col("label") >= 0)


def file_inventory(spark: SparkSession, path: str, recurse: bool = False, full_path: bool = True) -> DataFrame:
    """Files with their sizes; the contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recurse)
        .load(path)
        .select("path", "length")
    )
    return files if full_path else files.withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """Files of one value or array each, or, with ``lines``, of one record a line, as ``sinks.write_json`` makes them."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A term or rule list, one per row: a ``.json`` array of strings or a ``.txt`` file of lines."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>") if path.endswith(".json") else F.split("value", "\n", -1)
    return whole.select(F.posexplode(items).alias("pos", "item"))


def column_positions(spec: str) -> list[tuple[int, int | None]]:
    """``2-4,6,39-`` as 1-based closed ranges; an open end is ``None``."""
    ranges: list[tuple[int, int | None]] = []
    for part in spec.split(","):
        low, dash, high = part.partition("-")
        ranges.append((int(low or 1), int(high) if high else None if dash else int(low)))
    return ranges


def cut_columns(df: DataFrame, spec: str) -> DataFrame:
    """Keep columns by 1-based position, in table order like a positional cut."""
    keep = [
        i
        for i in range(1, len(df.columns) + 1)
        if any(low <= i and (high is None or i <= high) for low, high in column_positions(spec))
    ]
    return df.select(*[df.columns[i - 1] for i in keep])


def rearrange(fields: Column, columns: Sequence[str]) -> Column:
    """Pick 1-based fields in the given order; ``a:b`` takes fields a to b."""
    parts = []
    for c in columns:
        low, colon, high = c.partition(":")
        low, high = int(low), int(high) if colon else int(low)
        parts.append(F.slice(fields, low, high - low + 1))
    return F.concat(*parts)


def grep(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def keyed_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one latest in ``order``."""
    rest = [c for c in df.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy(key).agg(latest).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keyed_strict(df: DataFrame, key: str) -> DataFrame:
    """The same rows, after making sure no key occurs twice."""
    repeated = duplicate_keys(df, key).limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate {key}: {repeated[0][0]!r}")
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan of fewer splits than cores over the cores; a larger scan stays as it is.

    Few large row groups otherwise leave heavy work on text to a few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

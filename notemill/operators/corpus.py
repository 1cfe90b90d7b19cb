"""From note records to documents: filters, grouping, trimming, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.scale import lookup_join

# Notes of one patient are first gathered over this many sequence numbers, then part after part.
PART_WIDTH = 10_000


def note_types(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("note_type").isNotNull()).select("note_type").distinct()


def of_types(notes: DataFrame, types: DataFrame | str) -> DataFrame:
    """Notes whose type is in a one-column table, or occurs anywhere in a whole text."""
    if isinstance(types, str):
        return notes.where(F.contains(F.lit(types.lower()), F.lower("note_type")))
    wanted = types.select(F.lower(types.columns[0]).alias("_type")).distinct()
    return notes.join(wanted, F.lower("note_type") == F.col("_type"), "left_semi")


def with_diagnosis(
    notes: DataFrame, diagnosis: DataFrame, key: str = "patient_id", order: str = "seq"
) -> DataFrame:
    """Notes of patients that have a diagnosis row, with its columns."""
    return lookup_join(notes, diagnosis, key, [order], "inner")


def part_of(order: str, width: int = PART_WIDTH) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def group_notes(notes: DataFrame, key: str, order: str, width: int = PART_WIDTH) -> DataFrame:
    """One row per patient with all notes as an array in order, however far apart they stand.

    Parts of bounded width are sorted on their own and then strung together, so the notes of a hot
    patient are sorted by many tasks; only the finished row is as large as the patient.
    """
    rest = [c for c in notes.columns if c not in (key, order)]
    entry = F.struct(order, *rest)
    parts = notes.groupBy(key, part_of(order, width).alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("notes")
    )
    return parts.groupBy(key).agg(F.flatten(_in_parts("notes")).alias("notes"))


def merge_text(
    notes: DataFrame, keys: Sequence[str], order: str, text: str = "text", width: int = PART_WIDTH
) -> DataFrame:
    """One row per key: its texts in order without a separator, merged in parts as in ``group_notes``."""
    parts = notes.groupBy(*keys, part_of(order, width).alias("part")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda e: e[text]), ""
        ).alias("text")
    )
    return parts.groupBy(*keys).agg(F.array_join(_in_parts("text"), "").alias("text"))


def _in_parts(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("part", column))), lambda p: p[column])


def merge_corpora(sources: Sequence[DataFrame], name: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of the same name joined in the order of their sources."""
    union = None
    for i, source in enumerate(sources):
        tagged = source.select(name, text, F.lit(i).alias("_source"))
        union = tagged if union is None else union.unionByName(tagged)
    return merge_text(union, [name], "_source", text)


def mirror_split(source: DataFrame, mirror: DataFrame, name: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose name occurs in the mirror, and the others."""
    names = mirror.select(name).distinct()
    return source.join(names, name, "left_semi"), source.join(names, name, "left_anti")


def trigger_lines(
    docs: DataFrame,
    triggers: Sequence[str],
    text: str = "text",
    dedup: bool = False,
    structured: bool = False,
) -> DataFrame:
    """Keep header lines once, and any other line once per trigger it matches (or once, deduped).

    The triggers are unrolled into one expression per line, so nothing is joined or shuffled.
    """
    triggers = sorted(set(triggers))
    lines = T.lines(F.col(text))
    if structured:
        lines = F.flatten(F.transform(lines, lambda x: T.sections(T.strip(x))))
    lines = F.transform(lines, lambda x: F.lower(T.strip(x)))

    def hits(line: Column) -> Column:
        if dedup:
            return line.rlike("|".join(f"(?:{t})" for t in triggers)).cast("int")
        total = F.lit(0)
        for t in triggers:
            total = total + line.rlike(t).cast("int")
        return total

    def copies(line: Column) -> Column:
        header = line.rlike(r":$") & (F.length(line) > 2)
        return F.when(line == "", 0).when(header, 1).otherwise(hits(line))

    kept = F.flatten(F.transform(lines, lambda x: F.array_repeat(x, copies(x))))
    return docs.withColumn(text, F.array_join(kept, "\n"))


def run_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of run counters: all records, and those that meet each named condition.

    A plain aggregate: an observation attached to the session would keep models fitted later in
    that session from being shipped to tasks.
    """
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(c).alias(k) for k, c in conditions.items()],
    )

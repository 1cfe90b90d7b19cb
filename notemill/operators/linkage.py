"""Patient to diagnosis linkage in exact, zero-padded and fuzzy tiers."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from notemill.functions.text import record_key
from notemill.scale import lookup_join

# The longest padded id and the lowest scores of a fuzzy match.
PADDED_BELOW = 7
MIN_ID_SCORE = 95
MIN_NAME_SCORE = 93

# Largest share of edits in both ids together at which a rounded ratio still reaches MIN_ID_SCORE.
EDIT_SHARE = 1 - (MIN_ID_SCORE - 0.5) / 100

# Patients, diagnoses and their keys grow with the data, however small Spark takes the exploded rows to
# be: they are never sent whole through the driver.
BY_SHUFFLE = ("merge",)

EXACT, PADDED, FUZZY = "exact", "padded", "fuzzy"


def exact_links(patients: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Patients whose id is a diagnosis id."""
    return patients.join(
        diagnosis.select(F.col("diag_id").alias("_d"), "diag_seq").hint(*BY_SHUFFLE), F.col("patient_id") == F.col("_d")
    ).select("patient_id", F.col("_d").alias("diag_id"), "diag_seq", F.lit(EXACT).alias("tier"))


def padded_links(patients: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Patients whose id is a short diagnosis id with zeros in front.

    An id without its leading zeros stands for at most ``PADDED_BELOW`` different short ids, so no
    join key gathers more diagnosis rows than that.
    """
    short = diagnosis.where(F.length("diag_id") < PADDED_BELOW).select(
        "diag_id", "diag_seq", _bare("diag_id").alias("_bare")
    )
    return (
        patients.select("patient_id", _bare("patient_id").alias("_bare"))
        .join(short.hint(*BY_SHUFFLE), "_bare")
        .where(F.length("patient_id") > F.length("diag_id"))
        .select("patient_id", "diag_id", "diag_seq", F.lit(PADDED).alias("tier"))
    )


def _bare(column: str) -> Column:
    return F.regexp_replace(column, "^0+", "")


def processed(text: Column) -> Column:
    """Lower case, every other character than a letter, digit or underscore blanked, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " "))


def _ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b).ratio())


def weighted_ratio(a: str, b: str) -> int:
    """Similarity of two processed strings, 0 to 100.

    The best of the plain ratio and, scaled by 0.95, the ratios over sorted and shared tokens.
    Strings whose lengths differ by half or more stay at or below 90, which no tier accepts, and
    are scored by the plain ratio alone.
    """
    if not a or not b:
        return 0
    plain = _ratio(a, b)
    if max(len(a), len(b)) >= 1.5 * min(len(a), len(b)):
        return plain
    left, right = a.split(), b.split()
    by_order = _ratio(" ".join(sorted(left)), " ".join(sorted(right)))
    shared = " ".join(sorted(set(left) & set(right)))
    more_left = f"{shared} {' '.join(sorted(set(left) - set(right)))}".strip()
    more_right = f"{shared} {' '.join(sorted(set(right) - set(left)))}".strip()
    by_set = _ratio(more_left, more_right)
    if shared:
        by_set = max(by_set, _ratio(shared, more_left), _ratio(shared, more_right))
    return round(max(plain, 0.95 * by_order, 0.95 * by_set))


@F.pandas_udf(IntegerType())
def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([weighted_ratio(a, b) for a, b in zip(left, right)], dtype="int32")


def allowed_edits(length: Column) -> Column:
    """Most insertions plus deletions with which a string of this length can still score.

    A rounded ratio of 95 needs ``2m / (2m + e) >= 0.945`` for m shared characters and e edits; a
    string keeps at most all its characters, so ``e <= 2 * length * 0.055 / 0.945``.
    """
    return F.floor(length * (2 * EDIT_SHARE / (1 - EDIT_SHARE))).cast("int")


# Segments of an id beyond the edits it allows: so many must come through any edits unchanged.
SURVIVORS = 2


def segment_bounds(length: Column, segments: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the ``i``-th of almost equal segments."""
    start = F.floor(i * length / segments).cast("int")
    return start, (F.floor((i + 1) * length / segments) - start).cast("int")


def _key(length: Column, i: Column, j: Column, first: Column, second: Column) -> Column:
    return F.xxhash64(length, i, j, first, second)


def segment_keys(diagnosis: DataFrame) -> DataFrame:
    """One key for every two segments of ``_d``; an id that allows e edits is cut into e + 2 segments."""
    n = F.length("_d")
    segments = allowed_edits(n) + SURVIVORS

    def cut_at(i: Column) -> Column:
        start, size = segment_bounds(n, segments, i)
        return F.substring(F.col("_d"), start + 1, size)

    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), segments - 2),
            lambda i: F.transform(F.sequence(i + 1, segments - 1), lambda j: _key(n, i, j, cut_at(i), cut_at(j))),
        )
    )
    return diagnosis.withColumn("_key", F.explode(F.array_distinct(pairs)))


def shifted_keys(patients: DataFrame) -> DataFrame:
    """The keys under which an id within reach of ``_p`` can stand.

    For each length in reach and every two segments of such an id, the parts of ``_p`` at their shifted
    places. Edits before, between and behind the two segments move them by a, b and c characters, and
    there are at least ``|a| + |b| + |c|`` of them, so only shifts within the allowed edits are tried.
    """
    n = F.length("_p")
    reach = (1 - EDIT_SHARE) / (1 + EDIT_SHARE)
    lengths = patients.withColumn("_m", F.explode(F.sequence(F.greatest(F.ceil(n * reach), F.lit(1)).cast("int"), F.floor(n / reach).cast("int"))))
    m = F.col("_m")
    tried = lengths.withColumn("_e", F.floor((n + m) * EDIT_SHARE + 1e-9).cast("int")).where(F.abs(n - m) <= F.col("_e"))
    tried = tried.withColumn("_segments", allowed_edits(m) + SURVIVORS)
    tried = tried.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_segments") - 2)))
    tried = tried.withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.col("_segments") - 1)))
    around = lambda limit: F.explode(F.sequence(-limit, limit))
    tried = tried.withColumn("_a", around(F.col("_e")))
    tried = tried.withColumn("_b", around(F.col("_e") - F.abs("_a")))
    tried = tried.where(F.abs("_a") + F.abs("_b") + F.abs(n - m - F.col("_a") - F.col("_b")) <= F.col("_e"))
    (start_i, size_i), (start_j, size_j) = (segment_bounds(m, F.col("_segments"), F.col(c)) for c in ("_i", "_j"))
    at_i, at_j = start_i + F.col("_a"), start_j + F.col("_a") + F.col("_b")
    inside = (at_i >= 0) & (at_i + size_i <= at_j) & (at_j + size_j <= n)
    part = lambda at, size: F.substring(F.col("_p"), at + 1, size)
    key = _key(m, F.col("_i"), F.col("_j"), part(at_i, size_i), part(at_j, size_j))
    # Dealt by key at once, for the join that follows; rows that come twice have one key.
    return tried.where(inside).select(*patients.columns, key.alias("_key")).repartition("_key").distinct()


def fuzzy_candidates(patients: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Pairs of ids that could reach the id score.

    Three ways lead to a high score: the same set of tokens, few edits, or the tokens of one id being
    part of the other's. Few edits leave at least two segments unchanged, at places they can be shifted
    to; two of them are joined, because one alone may be a prefix that many ids share. What the join
    finds is checked by a bounded edit distance before any score is computed.
    """
    left = patients.select("patient_id", processed(F.col("patient_id")).alias("_p")).where("_p != ''")
    right = diagnosis.select(
        "diag_id", "diag_seq", processed(F.col("diag_id")).alias("_d")
    ).where("_d != ''")
    columns = ["patient_id", "diag_id", "diag_seq"]

    def same_tokens(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("_key", F.array_join(_token_set(text), " "))

    by_tokens = same_tokens(left, "_p").join(same_tokens(right, "_d").hint(*BY_SHUFFLE), "_key")
    edits = F.floor((F.length("_p") + F.length("_d")) * EDIT_SHARE + 1e-9).cast("int")
    by_edits = (
        shifted_keys(left)
        .join(segment_keys(right).hint(*BY_SHUFFLE), "_key")
        .where(F.call_function("levenshtein", F.col("_p"), F.col("_d"), edits) >= 0)
    )
    pairs = by_tokens.select(columns).unionByName(by_edits.select(columns))
    return pairs.unionByName(_token_pairs(left, right).select(columns)).distinct()


def _token_set(text: str) -> Column:
    return F.array_sort(F.array_distinct(F.split(F.col(text), r"\s+")))


def _token_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs in which the tokens of one id are part of the other's, and which can score by that.

    The larger id stands under each of its tokens, the smaller one under its rarest only.
    """
    a = left.select("patient_id", "_p", _token_set("_p").alias("_tokens"))
    b = right.select("diag_id", "diag_seq", "_d", _token_set("_d").alias("_tokens"))
    found = _contained(b, a).unionByName(_contained(a, b))
    shorter, longer = F.least(F.length("_p"), F.length("_d")), F.greatest(F.length("_p"), F.length("_d"))
    return found.where(longer < 1.5 * shorter)


def _contained(larger: DataFrame, smaller: DataFrame) -> DataFrame:
    token = F.explode("_tokens").alias("_token")
    rest = [c for c in larger.columns if c != "_tokens"]
    own = [c for c in smaller.columns if c != "_tokens"]
    several = larger.where(F.size("_tokens") > 1)
    many = several.select(*rest, F.col("_tokens").alias("_all"), token)
    sizes = many.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        lookup_join(smaller.select(*own, F.col("_tokens").alias("_few"), token), sizes.hint(*BY_SHUFFLE), "_token", own[:1])
        .groupBy(*own, "_few")
        .agg(F.min_by("_token", F.struct(F.coalesce("_n", F.lit(0)), "_token")).alias("_token"))
    )
    pairs = many.join(rarest.hint(*BY_SHUFFLE), "_token").where(F.size(F.array_except("_few", "_all")) == 0)
    return pairs.select("patient_id", "_p", "diag_id", "diag_seq", "_d")


def fuzzy_links(patients: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Candidate pairs whose ids and ``last,first`` names both score high enough."""
    scored = (
        fuzzy_candidates(patients, diagnosis)
        .join(patients.select("patient_id", "patient_name").hint(*BY_SHUFFLE), "patient_id")
        .join(
            diagnosis.select(
                "diag_id", F.concat_ws(",", "last_name", "first_name").alias("_diag_name")
            ).hint(*BY_SHUFFLE),
            "diag_id",
        )
        .withColumn("id_score", _score(processed(F.col("patient_id")), processed(F.col("diag_id"))))
        .where(F.col("id_score") >= MIN_ID_SCORE)
        .withColumn(
            "name_score", _score(processed(F.col("patient_name")), processed(F.col("_diag_name")))
        )
        .where(F.col("name_score") >= MIN_NAME_SCORE)
    )
    return scored.select(
        "patient_id", "diag_id", "diag_seq", F.lit(FUZZY).alias("tier"), "id_score", "name_score"
    )


def link(patients: DataFrame, diagnosis: DataFrame, fuzzy: bool = True) -> DataFrame:
    """One link per matched patient.

    An exact match beats all. Otherwise the first diagnosis in file order that matches by padding
    or by fuzzy score wins, padding being tested first. ``patients`` has one row per patient_id
    (with patient_name for the fuzzy tier), ``diagnosis`` one per diag_id with its diag_seq.
    """
    exact = exact_links(patients, diagnosis)
    open_patients = patients.join(exact.select("patient_id").hint(*BY_SHUFFLE), "patient_id", "left_anti")
    columns = ["patient_id", "diag_id", "diag_seq", "tier"]
    found = padded_links(open_patients, diagnosis).select(columns)
    if fuzzy:
        found = found.unionByName(fuzzy_links(open_patients, diagnosis).select(columns))
    place = F.struct("diag_seq", F.when(F.col("tier") == PADDED, 0).otherwise(1))
    first = found.groupBy("patient_id").agg(
        F.min_by(F.struct("diag_id", "diag_seq", "tier"), place).alias("_l")
    )
    return exact.select(columns).unionByName(first.select("patient_id", "_l.*"))


def unmatched(patients: DataFrame, links: DataFrame) -> DataFrame:
    return patients.join(links.select("patient_id"), "patient_id", "left_anti")


def feature_lookup(docs: DataFrame, table: DataFrame, key: str = "mrn") -> DataFrame:
    """Left-join the structured patient row to each document by id without zeros and suffix."""
    keyed = docs.withColumn(key, record_key(F.col("doc_id").cast("string")))
    return lookup_join(keyed, table, key, ["doc_id"]).drop(key)

"""Weekly consumption over a table of lines, for notes too large for one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.features import (
    ConsumptionRules,
    body_constants,
    bucket,
    consumption_mentions,
    estimated_level,
)


def mention_table(lines: DataFrame, rules: ConsumptionRules = ConsumptionRules()) -> DataFrame:
    """Distinct (doc_id, drinks, times, unit) of the lines (doc_id, line) that refer to usage."""
    found = F.explode(consumption_mentions(F.col("line"), rules)).alias("_m")
    return lines.select("doc_id", found).select("doc_id", "_m.*").distinct()


def weekly_totals(
    mentions: DataFrame, patients: DataFrame, rules: ConsumptionRules = ConsumptionRules()
) -> DataFrame:
    """(doc_id, total, bucket) from mentions and (doc_id, gender, weight, weight_unit).

    What a mention adds is linear in its drinks, so mentions are summed per document with partial
    aggregation before the patient's row is joined.
    """
    per_mention = estimated_level(F.struct("drinks", "times", "unit"), rules)
    summed = mentions.groupBy("doc_id").agg(
        F.sum(per_mention["alcohol"]).alias("alcohol"), F.sum(per_mention["visits"]).alias("visits")
    )
    total = _total(rules).cast("long")
    return (
        summed.join(patients, "doc_id")
        .select("doc_id", total.alias("total"))
        .withColumn("bucket", bucket(F.col("total"), rules.bucket))
    )


def _total(rules: ConsumptionRules) -> Column:
    water, burn, kilos = body_constants(F.col("gender"), F.col("weight"), F.col("weight_unit"), rules)
    return (
        F.col("alcohol") / (water * kilos) - burn * F.lit(float(rules.drinking_hours)) * F.col("visits")
    ) * 10 * 100

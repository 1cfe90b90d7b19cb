"""Mixing sources to target weights: random keys, range-sorted prefix sums, exact budgets.

Every document gets a random key that any rerun repeats. Sources are range-sorted by that key into blocks;
sums inside the blocks and over earlier blocks give each document the number of words before it in its
source. A source's budget takes whole epochs first, then documents in key order; the document on which
the budget ends is taken as far as it reaches, so each source meets its budget to the word.

Only (id, source, size, key) are sorted, never texts. Blocks are cut by source and key together, so a
source of a third of all rows fills a third of the blocks.

Defined cases: a null text has no words and is taken zero times; a null source is a source of its own,
last in order; rows with equal ids and sizes are interchangeable; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm import tables
from notemill.scale import cut, seeded_hash

# Weights go round the sources in code-point order; a source repeats three times at most.
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 1


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, budget, before, taken): what the mix takes of each row."""
    sized = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            tables.n_words(text).alias("size"),
            seeded_hash(seed, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("key"),
        )
    )
    budgets = source_budgets(sized, weights, most_repeats)
    ordered = prefix_sums(sized, ["source"], [F.col("key"), F.col("doc_id"), F.col("size")], "size", "upto")
    before = F.col("upto") - F.col("size")
    s, t = ordered.alias("s"), budgets.alias("t")
    # One row a source: the side with the documents is dealt by source only if the sums are not small.
    joined = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
    epochs = F.expr("budget DIV greatest(source_size, 1)")
    rest = F.col("budget") - epochs * F.col("source_size")
    partial = F.least(F.col("size"), F.greatest(rest - before, F.lit(0)))
    return joined.select(
        "doc_id",
        F.col("s.source").alias("source"),
        "size",
        "source_size",
        "target",
        "budget",
        before.alias("before"),
        (epochs * F.col("size") + partial).cast("long").alias("taken"),
    )


def source_budgets(sized: DataFrame, weights: Sequence[int], most_repeats: int) -> DataFrame:
    """(source, source_size, target, budget): the total shared by weight under each source's ceiling.

    Each round shares what is left among the sources below their ceiling and stops once none exceeds
    it. The driver sees two sums a round.
    """
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    numbered = prefix_sums(
        sums.withColumn("one", F.lit(1)), [], [F.col("source").isNull(), F.col("source")], "one", "nth"
    )
    turn = F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("long")
    state = cut(numbered.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")))
    whole = (F.col("source_size") * most_repeats).cast("decimal(38,0)")
    while True:
        open_weight, used, total = state.agg(
            F.sum(F.when(~F.col("full"), F.col("weight"))),
            F.sum(F.when(F.col("full"), F.col("source_size") * most_repeats)),
            F.sum("source_size"),
        ).first()
        left = (total or 0) - (used or 0)
        above = ~F.col("full") & (whole * F.lit(open_weight or 0) < F.col("weight").cast("decimal(18,0)") * F.lit(left))
        if not open_weight or not state.where(above).limit(1).count():
            break
        state = cut(state.withColumn("full", F.col("full") | above))
    share = F.col("weight") * (F.lit(float(left)) / F.lit(float(open_weight or 1)))
    target = F.when(F.col("full"), (F.col("source_size") * most_repeats).cast("double")).otherwise(share)
    return state.select("source", "source_size", target.alias("target")).withColumn(
        "budget", F.floor(F.col("target") + 0.5).cast("long")
    )


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` within ``keys`` in ``order``.

    Range blocks over keys and order are written with their numbers, so a lost executor cannot renumber
    them. Inside a block the sum is a window; a block's offset is the sum of the key's earlier blocks.
    """
    n = tables.shuffle_partitions(df)
    blocks = cut(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy("_block")
    offsets = (
        blocks.groupBy("_block", *keys)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    b, o = blocks.withColumn("_in", F.sum(value).over(inside)).alias("b"), offsets.alias("o")
    same = F.col("b._block") == F.col("o._block")
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"o.{k}"))
    return b.join(o, same).select(*[f"b.{c}" for c in df.columns], (F.col("b._in") + F.col("o._offset")).alias(name))


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('1|' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
numbered AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
  FROM sized GROUP BY source),
-- Sources reach their ceiling in the order of ceiling over weight.
filled AS (
  SELECT *, CAST(SUM(source_size) OVER () AS BIGINT) - CAST(COALESCE(SUM(3 * source_size) OVER before, 0) AS BIGINT) AS left_over,
    CAST(SUM(weight) OVER () AS BIGINT) - CAST(COALESCE(SUM(weight) OVER before, 0) AS BIGINT) AS left_weight
  FROM numbered
  WINDOW before AS (ORDER BY source_size * 6 // weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT left_over, left_weight FROM filled
  WHERE 3 * source_size * left_weight >= weight * left_over
  ORDER BY left_weight DESC LIMIT 1),
budgets AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size * left_weight < weight * left_over THEN CAST(3 * source_size AS DOUBLE)
      ELSE weight * (CAST(left_over AS DOUBLE) / CAST(left_weight AS DOUBLE)) END AS target
  FROM (SELECT source, source_size, weight FROM numbered), level),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, CAST(floor(b.target + 0.5) AS BIGINT) AS budget,
    CAST(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(budget // greatest(source_size, 1) * size
    + least(size, greatest(budget - budget // greatest(source_size, 1) * source_size - before, 0)) AS BIGINT) AS taken
FROM placed
"""

"""Building blocks that keep hot keys and global orders off a single task.

* ``lookup_join``     joins rows with hot keys to a table that is unique on the key
* ``hashed_rank``     exact row numbers in a seeded random order, without a global sort
* ``ordered_blocks``  range-sorted blocks, the base of exact running totals
* ``cut``             cuts lineage through the cluster's shared checkpoint folder
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in HOT_SHARE; fewer than HOT_SHARE keys can do so.
HOT_SHARE = 10_000
# Leading hex digits of the md5 order that name a bucket: 65,536 buckets.
BUCKET_DIGITS = 4
SPREAD = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets a folder in its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "left",
    frequency: str | None = None,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per ``key``, whatever the skew of ``left``.

    Keys holding more than ``1/hot_share`` of the left rows are fewer than ``hot_share``, so their
    right rows can be broadcast whatever the data volume. All other rows take an ordinary join, in
    which the already matched hot rows, and those whose key is null, are spread over the partitions by
    the ``spread`` columns.
    ``frequency`` names a column of ``right`` that already holds the number of left rows per key;
    without it the keys are counted first.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    values = [c for c in right.columns if c != key]
    if frequency is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        hot_keys = counts.where(_is_hot(counts, "_n", hot_share)).select(key)
        hot = right.join(F.broadcast(hot_keys), key, "left_semi")
    else:
        hot = right.where(_is_hot(right, frequency, hot_share))
    hot = hot.select(
        F.col(key).alias("_hot_key"), F.struct(F.lit(1).alias("_m"), *values).alias("_hot")
    )
    cold = right.select(
        F.col(key).alias("_cold_key"),
        _no_salt(key).alias("_cold_salt"),
        F.struct(F.lit(1).alias("_m"), *values).alias("_cold"),
    )
    unmatched = F.col("_hot").isNull() & F.col(key).isNotNull()
    tagged = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").select(
        *left.columns,
        "_hot",
        F.when(unmatched, F.col(key)).alias("_key"),
        F.when(unmatched, _no_salt(key)).otherwise(_bucket_of(spread)).alias("_salt"),
    )
    joined = tagged.join(
        cold, (F.col("_key") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    ).withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    return joined.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def _no_salt(key: str) -> Column:
    """Always zero, but not a literal: the optimizer would take a literal out of the join's keys."""
    return F.pmod(F.xxhash64(key), F.lit(1)).cast("int")


def _is_hot(counts: DataFrame, n: str, hot_share: int) -> Column:
    return F.col(n) * hot_share > counts.agg(F.sum(n)).scalar()


def _bucket_of(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int")


def seeded_hash(seed: int | str, ident: str | Column) -> Column:
    """``md5('<seed>|<id>')``: a random order any engine can repeat."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat(F.lit(f"{seed}|"), ident.cast("string")))


def hashed_rank(
    df: DataFrame,
    ident: str,
    seed: int | str,
    keys: Sequence[str] = (),
    rank: str = "rank",
    total: str = "total",
) -> DataFrame:
    """Add the 1-based rank in seeded random order within ``keys`` and the size of the key's group.

    The leading digits of the hash name a bucket, so each task sorts one bucket of one key and the
    ranks continue from offsets counted per bucket: no task sees a whole group.
    """
    hashed = df.withColumn("_hash", seeded_hash(seed, ident)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    per_key = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = (
        Window.partitionBy(*per_key)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        hashed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_bucket").alias("_kb"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(*per_key)).alias(total),
        )
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy("_hash", ident)
    same = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if not keys:
        offsets = F.broadcast(offsets)  # one row per bucket at most
    return (
        hashed.withColumn("_local", F.row_number().over(local))
        .join(offsets, same)
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(rank), total)
    )


def ordered_blocks(df: DataFrame, order: Sequence[Column], block: str = "_block") -> DataFrame:
    """Range-sort into blocks and number them; the numbering is written, so a retry cannot move it."""
    return cut(df.repartitionByRange(*order).withColumn(block, F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, str],
) -> DataFrame:
    """Inclusive running sums of ``totals`` (new name -> column) in ``order`` within ``keys``.

    Rows are cut into blocks by range over keys and order together, summed inside each block, and
    lifted by the sums of the key's earlier blocks.
    """
    blocks = ordered_blocks(df, [*[F.col(k) for k in keys], *order])
    per_key = [F.col(k) for k in keys] or [F.lit(0)]
    inside = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = Window.partitionBy(*per_key).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    lifts = (
        blocks.groupBy("_block", *keys)
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
        .select(
            F.col("_block").alias("_lift_block"),
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_lift_{n}") for n in totals],
        )
    )
    same = F.col("_block") == F.col("_lift_block")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        blocks.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in totals.items()])
        .join(lifts, same)
        .select(
            *df.columns,
            *[(F.col(f"_in_{n}") + F.col(f"_lift_{n}")).alias(n) for n in totals],
        )
    )

import pytest
from pyspark.sql import functions as F

from notemill.operators import corpus, sampling
from notemill.scale import hashed_rank, lookup_join, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key")
    )


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_share", [2, 10, 10_000])
def test_lookup_join_equals_a_plain_join(spark, skewed, how, hot_share):
    right = skewed.where("key <> 'k5'").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = lookup_join(skewed, right, "key", ["id"], how, hot_share=hot_share)
    want = skewed.join(right, "key", how).select("id", "key", "n", "top")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if how == "inner":
        known = lookup_join(skewed, right, "key", ["id"], how, frequency="n", hot_share=hot_share)
        assert sorted(known.collect()) == sorted(want.collect())


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_share", [0, 3])
def test_lookup_join_spreads_hot_and_null_keys(spark, tmp_path, how, null_share):
    """Two thirds of the rows under one key, and a third of these without a key in the second case."""
    left = spark.range(30_000).select(
        F.col("id"),
        F.when((F.col("id") % 3 == 0) | (F.col("id") % 9 < 6) & (F.col("id") % 9 > 0), F.lit("hot"))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"),
    )
    if null_share:
        left = left.withColumn("key", F.when(F.col("id") % null_share == 0, None).otherwise(F.col("key")))
    right = left.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = lookup_join(left, right, "key", ["id"], how, hot_share=10).withColumn("part", F.spark_partition_id())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_key" in plan and "_salt" in plan.split("hashpartitioning(_key")[1].split(")")[0]
        joined.write.parquet(f"{tmp_path}/joined")  # with the right-hand columns
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.read.parquet(f"{tmp_path}/joined")
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    assert rows.where("key is not null and (top is null or n is null)").count() == 0
    assert sum(sizes) == (30_000 if how == "left" else left.where("key is not null").count())


def test_hashed_rank_is_a_dense_order(spark, skewed):
    ranked = hashed_rank(skewed, "id", 1, ["key"]).collect()
    by_key = {}
    for r in ranked:
        by_key.setdefault(r["key"], []).append(r["rank"])
        assert r["total"] >= r["rank"]
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_key.values())


def test_running_totals(spark, skewed):
    got = running_totals(skewed.withColumn("one", F.lit(1)), ["key"], [F.desc("id")], {"place": "one"}).collect()
    hot = sorted((r for r in got if r["key"] == "hot"), key=lambda r: -r["id"])
    assert [r["place"] for r in hot] == list(range(1, 1001))


def test_fold_sizes(spark):
    docs = spark.range(11).withColumnRenamed("id", "doc_id")
    sizes = [r["count"] for r in sampling.kfold(docs, 3).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [4, 4, 3]
    assert sampling.kfold(docs.limit(2), 3).count() == 2


def test_percent_and_stratified_sizes(spark):
    ten = spark.range(10).withColumnRenamed("id", "doc_id")
    assert sampling.percent_split(ten, 25).where("moved = 1").count() == 3
    twelve = spark.range(12).select(F.col("id").alias("doc_id"), (F.col("id") >= 7).cast("int").alias("label"))
    sizes = dict(sampling.stratified(twelve, 0.5).groupBy("label").count().collect())
    assert sizes == {0: 3, 1: 2}
    assert sampling.per_class(twelve, 4).count() == 8
    assert sampling.learning_sizes(10, 130, 30) == [0.1, 0.4, 0.7, 1.0]


def test_patients_stay_whole_and_in_order(spark):
    notes = spark.range(25_000).select(
        F.when(F.col("id") % 5000 == 7, "q").otherwise("p").alias("patient_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("text")
    )
    want = {"p": [i for i in range(25_000) if i % 5000 != 7], "q": [7, 5007, 10007, 15007, 20007]}
    for width in (30, corpus.PART_WIDTH):
        merged = {r["patient_id"]: r["text"] for r in corpus.merge_text(notes.repartition(9), ["patient_id"], "seq", width=width).collect()}
        assert merged == {k: "".join(map(str, v)) for k, v in want.items()}
        grouped = corpus.group_notes(notes, "patient_id", "seq", width=width).collect()
        assert {r["patient_id"]: [n["seq"] for n in r["notes"]] for r in grouped} == want
    again = corpus.merge_corpora([notes.where("seq < 9").withColumnRenamed("seq", "doc_id")] * 2).orderBy("doc_id").collect()
    assert [r["text"] for r in again] == [f"{i}{i}" for i in range(9)]


def test_notes_far_apart_in_a_file_make_one_document(spark, tmp_path):
    from notemill.sources.scans import read_notes

    lines = [f"{'x' if i in (5, 20_005) else 'y%d' % i}||A,B||note||text {i}" for i in range(20_100)]
    (tmp_path / "notes.txt").write_text("\n".join(lines))
    notes = read_notes(spark, str(tmp_path / "notes.txt")).select("patient_id", "seq", "note_text")
    merged = corpus.merge_text(notes, ["patient_id"], "seq", "note_text")
    assert [r["text"] for r in merged.where("patient_id = 'x'").collect()] == ["text 5text 20005"]
    assert merged.count() == 20_099

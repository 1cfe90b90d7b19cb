"""The pipeline against brute force, stage by stage, and whole over odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notemill.llm import toxicity
from test_decontaminate import brute as brute_hits
from test_simhash import brute as brute_components
from test_simhash import fingerprint
from test_substrings import brute as brute_repeats

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for d in range(240):
        ws = [f"w{(d * 31 + i * i) % 997}" for i in range(20 + d % 60)]
        if d % 8 == 0:
            ws[3::9] = ["vilescum"] * len(ws[3::9])
        labels.append((d, 0, int(d % 8 == 0)))
        if d % 10 == 1:
            ws += BENCH.split()
        if d % 10 == 2:
            ws += [f"shared{i}" for i in range(60)]
        rows.append((d, " ".join(ws), "en", f"s{d % 7}", 1))
    rows += [(d + 1000, rows[d][1], "en", "s1", 1) for d in range(0, 240, 5)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s2", 0), (None, "one two", "en", "s2", 7), rows[9]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    outputs = [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outputs[-1], folder).write.parquet(f"{tmp_path}/{number}")
        outputs.append(spark.read.parquet(f"{tmp_path}/{number}"))
        if name != "mix":
            assert outputs[-1].columns == columns
    _, clean, single, cut, decontaminated, mixed = outputs

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = toxicity.score(docs, model).where("score < 0.3")
    assert sorted(map(repr, texts(clean))) == sorted(map(repr, texts(want)))
    assert not any("vilescum" in (t or "") for _, t in texts(clean))
    assert clean.where("text NOT LIKE '%vilescum%' OR text IS NULL").count() == docs.where("text NOT LIKE '%vilescum%' OR text IS NULL").count()

    given = {(float("inf") if d is None else d): t for d, t in texts(clean)}
    roots = brute_components([(d, fingerprint(t)) for d, t in given.items()], 4)
    kept = sorted(float("inf") if d is None else d for d, _ in texts(single))
    assert kept == sorted(d for d in given if roots[d] == d)

    want = {d: (gone, text) for d, _, gone, text in brute_repeats(texts(single), 13)}
    before = dict(texts(single))
    for d, t in texts(cut):
        assert t == (want[d][1] if want[d][0] else before[d])

    hits = {d: n for d, _, n, _ in brute_hits(texts(cut), [(1, BENCH)], 10)}
    before = dict(texts(cut))
    for d, t in texts(decontaminated):
        assert (t == before[d]) == (hits[d] == 0)
    assert all(n == 0 for _, _, n, _ in brute_hits(texts(decontaminated), [(1, BENCH)], 10))
    assert decontaminated.where(F.length("text") != F.col("n_chars")).count() == 0
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1 for r in sums) and mixed.count() == decontaminated.count()


def test_whole_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100

"""Classifiers on texts in cross-validation, hold-out and grids; combinations of any length."""

from pyspark.sql import functions as F

from notemill.operators import evaluate, experiments, models, neighbours, rules, text_models, vectors


def corpus(spark, n=60):
    rows = [(i, i % 3 == 0, f"note {i} about {'fever with high fever and cough' if i % 3 == 0 else 'routine visit'} today") for i in range(n)]
    return spark.createDataFrame([(i, int(y), t) for i, y, t in rows], "doc_id long, label int, text string")


def test_every_document_is_predicted_by_models_that_have_not_seen_it(spark):
    docs = corpus(spark)
    params = {"rules": {"rules": ["fever", "visit"]}, "class_print": {}, "bit_knn": {"k": 3}, "mined_rules": {}, "majority": {}}
    for name, options in params.items():
        found = text_models.cross_validate(docs, name, options, folds=4).collect()
        assert sorted(r["doc_id"] for r in found) == list(range(60))
        right = sum(r["pred"] == r["label"] for r in found) / 60
        assert right == (2 / 3 if name == "majority" else 1.0)
        assert text_models.holdout(docs, name, options).count() == 12


def test_prints_make_the_entities_of_their_sample_only(spark, tmp_path):
    """A filter derived from an explode would make those of all documents, below the sample's join."""
    corpus(spark).write.parquet(f"{tmp_path}/docs")
    prints = neighbours.class_prints(spark.read.parquet(f"{tmp_path}/docs"), 5)
    chosen = prints._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in chosen.splitlines() if "Filter" in line and "xxhash64" in line]
    assert {r["label"] for r in prints.collect()} == {0, 1}


def test_folds_are_written_once(spark, monkeypatch):
    written = []
    kept = text_models.cut
    monkeypatch.setattr(text_models, "cut", lambda df: written.append(df.columns) or kept(df))
    assert text_models.cross_validate(corpus(spark), "class_print", {}, folds=3).count() == 60
    assert len(written) == 1
    text_models.cross_validate(corpus(spark), "majority", {}, folds=3)
    assert len(written) == 1


def test_a_grid_mixes_text_classifiers_and_records_failures(spark):
    runs = [
        experiments.RunOptions(classifier="rules", params={"rules": ["fever", "visit"]}, mode="text", folds=3),
        experiments.RunOptions(classifier="majority", mode="text", folds=3),
        experiments.RunOptions(classifier="rules", params={"rules": ["(" + "x" * 900]}, mode="text", folds=3),
    ]
    rows = {r["seq"]: r for r in experiments.run_grid(corpus(spark), runs).collect()}
    assert rows[0]["f1"] == 1.0 and rows[0]["auc"] == 1.0 and rows[1]["f1"] == 0.0
    assert rows[2]["f1"] is None and "x" * 900 in rows[2]["error"]


def test_combinations_of_four_words(spark):
    df = spark.createDataFrame([("a b c d e",)], "text string")
    found = df.select(F.explode(rules.skip_grams(F.col("text"), size=4, gap=0))).collect()
    assert {tuple(r[0].split("\n")) for r in found if r[0].count("\n") == 3} == {tuple("abcd"), tuple("bcde")}


def test_bags_count_terms_in_the_row(spark):
    docs = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["term"]): r["tf"] for r in vectors.term_counts(docs).collect()}
    assert rows == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1}
    once = vectors.term_counts(docs, vectors.TermOptions(binary=True)).collect()
    assert {(r["term"], r["tf"]) for r in once} == {("a", 1), ("b", 1), ("c", 1)}


def test_mined_rules_learn_from_train_and_keep_every_test_document(spark):
    train = spark.createDataFrame(
        [(1, 1, "high fever. high fever"), (2, 1, "high fever now"), (3, 0, "all well"), (4, 0, "all well now")],
        "doc_id long, label int, text string",
    )
    test = spark.createDataFrame([(7, 1, "high fever"), (8, 0, "all well"), (9, 0, ""), (10, 0, None)], train.schema)
    found = {r["doc_id"]: r for r in rules.mined_predict(train, test, gap=0).collect()}
    # "high", "fever" and "high fever": four hits with one added, in three documents with one added.
    assert found[7]["pos_score"] == 1 + 3 * (1 + 3) / (1 + 2) and found[7]["neg_score"] == 1 + 3 * 1.0
    assert {k: r["pred"] for k, r in found.items()} == {7: 1, 8: 0, 9: 0, 10: 0}
    assert rules.mined_predict(train, test.limit(0)).count() == 0


def test_a_model_of_one_class_predicts_it(spark):
    train = corpus(spark).where("label = 1")
    features = experiments.features_of(train, "count", vectors.TermOptions())
    model = experiments.fit(features.docs, "MultinomialNB", {"alpha": 1.0})
    assert {(r["pred"], r["score"]) for r in models.predictions(model, features.docs).collect()} == {(1, 1.0)}


def test_a_recorded_grid_exports_its_best_run(spark, tmp_path):
    runs = [
        experiments.RunOptions("majority", 3, "text"),
        experiments.RunOptions("MultinomialNB", 3, "count", params={"alpha": 1.0}),
        experiments.RunOptions("LinearSVC", 3, "tfidf", params={"max_iter": 10}),
    ]
    path = str(tmp_path / "runs")
    rows = experiments.run_grid(corpus(spark), runs, record=path)
    assert {r["seq"]: r["error"] for r in rows.collect()} == {0: None, 1: None, 2: None}
    counts = experiments.recorded(spark, path, "counts").groupBy("seq").sum("tp", "fp", "fn", "tn").collect()
    assert all(sum(r[1:]) == 60 for r in counts) and len(counts) == 3
    best = experiments.export_best(spark, rows, path)
    assert set(best) == set(experiments.RECORD_PARTS)
    assert best["misses"].count() == 0 and best["predictions"].count() == 60
    assert experiments.recorded(spark, path, "misses").where("seq = 0").count() == 20


def test_curves_take_class_sizes_from_their_bins(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.9), (0, 0, 0.1), (1, 1, 0.4), (1, 1, 0.4)]
    scored = spark.createDataFrame(rows, "fold int, label int, score double")
    points = {(r["fold"], r["threshold"]): (r["fpr"], r["tpr"]) for r in evaluate.roc_points(scored).collect()}
    assert points == {(0, 0.9): (0.5, 1.0), (0, 0.1): (1.0, 1.0), (1, 0.4): (0.0, 1.0)}
    assert {r["fold"]: r["auc"] for r in evaluate.auc(scored).collect()} == {0: 0.75, 1: None}

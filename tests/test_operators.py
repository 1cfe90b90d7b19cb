import pytest
from pyspark.sql import functions as F

from notemill.operators import bayes, concepts, corpus, evaluate, experiments, models, neighbours, rules, vectors
from notemill.operators.experiments import RunOptions
from notemill.operators.vectors import TermOptions
from notemill.sources.scans import parse_notes
from notemill.sources import sinks


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int, text string")


@pytest.fixture(scope="module")
def labelled(spark):
    good = ["calm day walk tea", "tea and walk", "quiet day tea", "walk in calm day"]
    bad = ["drink beer night", "beer and wine night", "wine drink late", "late night beer"]
    rows = [(i, int(i % 2), (bad if i % 2 else good)[i // 2 % 4] + f" n{i % 3}") for i in range(48)]
    return docs_of(spark, rows).cache()


def test_trigger_lines(spark):
    docs = docs_of(spark, [(1, 0, "Head:\nBeer and Wine daily\n\nnothing\n x: \nwine")])
    many = corpus.trigger_lines(docs, ["beer", "wine", "daily"]).first()["text"]
    assert many.split("\n") == ["head:", *["beer and wine daily"] * 3, "wine"]
    once = corpus.trigger_lines(docs, ["beer", "wine", "daily"], dedup=True).first()["text"]
    assert once.split("\n") == ["head:", "beer and wine daily", "wine"]


def test_note_filters_and_counters(spark):
    raw = spark.createDataFrame([("1||a||LAB||x", 0), ("2||b||er||y", 1), ("3||z", 2)], "value string, seq long")
    notes = parse_notes(raw)
    counts = corpus.run_counts(notes, short=F.size("fields") < 4).first()
    types = spark.createDataFrame([("lab",)], "t string")
    assert [n["patient_id"] for n in corpus.of_types(notes, types).collect()] == ["1"]
    assert (counts["records"], counts["short"]) == (3, 1)
    assert corpus.note_types(notes).count() == 3


def test_scores(spark):
    counts = spark.createDataFrame([(18, 6, 10, 70)], "tp int, fp int, fn int, tn int")
    r = evaluate.scores(counts).first()
    assert r["precision"] == 0.75
    assert r["recall"] == pytest.approx(18 / 28)
    assert r["f1"] == pytest.approx(0.692308, abs=1e-6)
    assert (r["acc"], r["spc"], r["npv"]) == (88 / 104, 70 / 76, 70 / 80)
    empty = spark.createDataFrame([(0, 0, 0, 0)], "tp int, fp int, fn int, tn int")
    assert evaluate.scores(empty).first()["f1"] == 0


def test_fold_summary_uses_the_population_deviation(spark):
    rows = [(0, *[0.5] * 6, 1, 1, 1, 1), (1, *[1.0] * 6, 3, 1, 1, 1)]
    names = ", ".join(f"{m} double" for m in evaluate.METRICS)
    folds = spark.createDataFrame(rows, f"fold int, {names}, tn long, fp long, fn long, tp long")
    r = evaluate.fold_summary(folds).first()
    assert (r["f1"], r["std"], r["tn"]) == (0.75, 0.25, 2.0)


def test_curve_and_area(spark):
    rows = [(1, 0, 1, 1, 0.9), (2, 0, 0, 1, 0.8), (3, 0, 1, 1, 0.8), (4, 0, 0, 0, 0.1)]
    p = spark.createDataFrame(rows, "doc_id long, fold int, label int, pred int, score double")
    assert evaluate.auc(p).first()["auc"] == pytest.approx(3.5 / 4)
    curve = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in evaluate.roc_points(p).collect())
    assert curve == [(0.1, 1.0, 1.0), (0.8, 0.5, 1.0), (0.9, 0.0, 0.5)]
    mean = {r["fpr"]: r["tpr"] for r in evaluate.mean_roc(p, 4).collect()}
    assert mean == {0.0: 0.5, 0.25: 0.75, 0.5: 1.0, 0.75: 1.0, 1.0: 1.0}
    assert [r["doc_id"] for r in evaluate.misses(p).collect()] == [2]
    pivot = evaluate.prediction_pivot(p, 2).where("mrn = 1").first()
    assert (pivot["pred_0"], pivot["prob_0"], pivot["pred_1"]) == ("1", "0.9", "-")


def test_tfidf_of_a_term_in_every_document_is_not_zero(spark):
    docs = docs_of(spark, [(1, 0, "aa bb"), (2, 0, "aa cc")])
    w = {(r["doc_id"], r["term"]): r["tfidf"] for r in vectors.tfidf(docs).collect()}
    idf = 1.0 + __import__("math").log(3 / 2)
    assert w[(1, "aa")] == pytest.approx(1 / (1 + idf**2) ** 0.5)


def test_fitted_stages_agree_with_the_long_form(spark, labelled, tmp_path):
    options = TermOptions(min_df=2)
    stages = vectors.preprocess(labelled, "tfidf", options)
    sinks.save_model(stages, str(tmp_path / "m"))
    again = sinks.load_model(str(tmp_path / "m"))
    row = again.transform(vectors.prepare(labelled, "tfidf", options)).where("doc_id = 3").first()
    names = stages.stages[0].vocabulary
    got = {names[i]: v for i, v in zip(row["features"].indices, row["features"].values)}
    want = {r["term"]: r["tfidf"] for r in vectors.tfidf(labelled, options).where("doc_id = 3").collect()}
    assert got == pytest.approx(want)
    assert vectors.preprocess(labelled, "text") is None


def test_rules(spark):
    docs = docs_of(spark, [(1, 1, "beer beer\nbeer beer"), (2, 1, "wine"), (3, 0, "beer tea"), (4, 0, "tea")])
    stats = rules.rule_stats(docs, ["beer", "tea"])
    got = {r["rule"]: tuple(r)[1:] for r in stats.collect()}
    assert got == {0: (3, 2, 2, 2), 1: (1, 1, 3, 3)}
    pred = {r["doc_id"]: r["pred"] for r in rules.rule_predict(docs, stats, ["beer", "tea"]).collect()}
    assert pred == {1: 1, 2: 0, 3: 1, 4: 0}
    assert rules.rule_threshold(docs, ["beer", "tea"], 2).where("pred = 1").count() == 1
    assert rules.predict_by(docs, lambda t: t.contains("wine")).where("pred = 1").count() == 1


def test_mined_rules(spark):
    docs = docs_of(spark, [(1, 1, "a b c"), (2, 0, "a x b")])
    mined = {r["combination"].replace("\n", " "): (r["pos_docs"], r["neg_docs"]) for r in rules.mine_rules(docs, 3, 1, 1).collect()}
    assert mined["a b"] == (1, 1)
    assert mined["a b c"] == (1, 0)
    assert "a c" in mined and "x b" in mined
    pattern = spark.createDataFrame([("a.\nb",)], "c string").select(rules.combination_pattern(F.col("c"), 1).alias("p")).first()["p"]
    found = spark.createDataFrame([("a. x b",), ("a. x y b",), ("ab b",)], "t string").select(F.col("t").rlike(pattern).alias("m"))
    assert [r["m"] for r in found.collect()] == [True, False, False]


def test_bayes_separates_the_classes(spark, labelled):
    from notemill.operators import sampling

    out = bayes.cross_validated(sampling.kfold(labelled, 4))
    assert out.count() == 48
    assert evaluate.fold_metrics(out, []).first()["f1"] == 1.0
    assert bayes.majority(labelled).select("pred").distinct().collect()[0]["pred"] == 0


def test_sampled_bits(spark, labelled):
    assert neighbours.bit_knn(labelled, 8, 3).where("pred <> label").count() == 0
    assert neighbours.print_predict(labelled, neighbours.class_prints(labelled, 8)).where("pred <> label").count() == 0
    assert neighbours.bit_knn(labelled, 8, 3, rank_vote=True).where("pred = label").count() == 0


def test_blocked_search_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 5))
    items = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id long, vector array<float>")
    queries = items.withColumnRenamed("item_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in neighbours.nearest(queries, items, 4, block_rows=13).collect()}
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    best = np.argsort(-sims, axis=1)[:, :4]
    assert got == {(q, r + 1): best[q, r] for q in range(60) for r in range(4)}
    labels = items.select("item_id", (F.col("item_id") % 2).alias("label"))
    near = neighbours.nearest(queries, items, 4)
    for weights in ("uniform", "distance"):
        assert neighbours.knn_vote(near, labels, weights).count() == 60


def test_merging_many_blocks_changes_nothing(spark):
    kept = spark.range(2000).select(
        (F.col("id") % 3).alias("query_id"), F.col("id").alias("item_id"), F.rand(1).alias("similarity")
    ).cache()
    plain = neighbours.top_k(kept, 7)
    assert sorted(plain.collect()) == sorted(neighbours.top_k(kept, 7, blocks=5000).collect())


def test_concepts(spark):
    entries = spark.createDataFrame(
        [("C0000001", "Heart", "Y"), ("C0000002", "heart attack", "Y"), ("C0000003", "attack, acute", "N"), ("C0000002", "mi", "N")],
        "cui string, str string, ispref string",
    )
    docs = docs_of(spark, [(1, 0, "Heart attack after attack acute; heart")])
    tagged = concepts.concept_text(concepts.tag(docs, concepts.concept_terms(entries), 2))
    assert tagged.first()["text"] == "C0000002 C0000003 C0000001"
    features = spark.createDataFrame([("-c0000002",), ("negC0000001",), ("c9999999",), ("word",)], "term string")
    cache = spark.createDataFrame([("C0000001", "HEART, the")], "cui string, name string")
    named = {r["term"]: r["name"] for r in concepts.resolve_names(features, entries, cache).collect()}
    assert named == {
        "-c0000002": "-c0000002 (heart attack)",
        "negC0000001": "negC0000001 (HEART; the)",
        "c9999999": "c9999999 (N/A)",
        "word": "word",
    }


def test_neighbour_levels(spark):
    edges = spark.createDataFrame(
        [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "d"), ("c", 1, "a"), ("d", 1, "e")], "word string, rank int, neighbour string"
    )
    seeds = spark.createDataFrame([("a", "a")], "seed string, word string")
    last = {r["word"] for r in concepts.expand_neighbours(seeds, edges, 2, 1).collect()}
    assert last == {"a", "d"}
    every = {r["word"] for r in concepts.expand_neighbours(seeds, edges, 2, 1, all_levels=True).collect()}
    assert every == {"a", "b", "c", "d"}


def test_grid_rows_and_best_run(spark):
    assert len(experiments.grid({"a": [1, 2, 1], "b": ["x", "y", "z"]})) == 6
    runs = spark.createDataFrame(
        [(0, 0.5, {"C": "1"}), (1, 0.7, {"C": "10"}), (2, 0.7, {"C": "10"}), (3, None, {"C": "10"})],
        "seq int, f1 double, options map<string,string>",
    )
    assert experiments.best_run(runs).first()["seq"] == 1
    kept = experiments.matching_runs(runs, {"f1": ">=0.6", "C": "1", "other": "x"})
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == [1, 2]
    with pytest.raises(IndexError):
        experiments.run_at(runs, 4)


def test_grid_run_keeps_failures_and_resumes(spark, labelled):
    runs = [RunOptions("LinearSVC", folds=2, params={"loss": loss, "C": 1.0, "max_iter": 5}) for loss in ("hinge", "log")]
    done = experiments.run_grid(labelled, runs).cache()
    first, second = done.orderBy("seq").collect()
    assert first["f1"] > 0.9 and first["error"] is None
    assert second["f1"] is None and "log" in second["error"]
    left = experiments.run_grid(labelled, runs, done.where("error IS NULL"))
    assert [r["seq"] for r in left.collect()] == [1]


@pytest.mark.parametrize(
    "name,mode,params",
    [
        ("LogisticRegression", "tfidf", {"C": 100.0, "class_weight": "balanced"}),
        ("BernoulliNB", "count", {"alpha": 1.0}),
        ("GradientBoostingClassifier", "count", {"learning_rate": 0.5, "n_estimators": 2}),
    ],
)
def test_families(spark, labelled, name, mode, params):
    options = RunOptions(name, folds=2, mode=mode, terms=TermOptions(binary=name == "BernoulliNB"), params=params)
    store = experiments.FeatureStore(labelled)
    assert experiments.cross_validate(store.get(options), options).summary().first()["f1"] > 0.8
    store.close()


def test_test_set_sweep_and_curve(spark, labelled):
    options = RunOptions("MultinomialNB", mode="count", params={"alpha": 1.0})
    train, test = labelled.where("doc_id < 36"), labelled.where("doc_id >= 36")
    predictions, _ = experiments.evaluate_on(train, test, options)
    assert evaluate.fold_metrics(predictions, []).first()["f1"] == 1.0
    curve = experiments.learning_curve(train, test, options, 50, 101, 50).collect()
    assert [r["fraction"] for r in curve] == [0.5, 1.0]
    features = experiments.features_of(labelled, "count", TermOptions())
    swept = experiments.sweep(features, [options, RunOptions("Unknown")]).collect()
    assert swept[0]["f1"] == 1.0 and swept[1]["f1"] == -1.0


def test_feature_maps(spark, labelled):
    features = experiments.features_of(labelled, "tfidf", TermOptions(min_df=4))
    mapped = models.random_fourier(features.docs, size=400, gamma=0.5).select("doc_id", "features").collect()
    plain = {r["doc_id"]: r["features"] for r in features.docs.select("doc_id", "features").collect()}
    by_id = {r["doc_id"]: r["features"] for r in mapped}
    import math

    for a, b in ((0, 1), (0, 2), (3, 5)):
        kernel = math.exp(-0.5 * plain[a].squared_distance(plain[b]))
        assert by_id[a].dot(by_id[b]) == pytest.approx(kernel, abs=0.15)
    assert models.polynomial(features.docs.limit(1)).count() == 1

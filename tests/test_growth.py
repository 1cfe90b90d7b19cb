"""Steps whose cost grows with the input and not with the vocabulary, the exploded rows or all pairs."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from notemill.operators import concepts, experiments, linear, linkage, models, neighbours, rules, term_tables, vectors
from notemill.operators.vectors import TermOptions
from notemill.plans.catalog import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    texts = [(i, f"alpha beta w{i % 3} shared words of text {i % 2}") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_saved_model_reads_only_the_terms_of_a_text(spark, tables):
    found = QUERIES["saved_model"](spark, tables)
    assert "vector_to_array" not in plan(found) and "toArray" not in plan(found)
    assert "UnwrapUDT" in plan(found) or "unwrap" in plan(found).lower()
    assert {(r["n"], r["n_terms"]) for r in found.collect()} == {(8.0, 8)}


def test_random_fourier_reads_sparse_and_dense_vectors_alike(spark):
    sparse = Vectors.sparse(1 << 20, [5, 1 << 19], [1.0, 2.0])
    rows = spark.createDataFrame([(0, sparse), (1, Vectors.sparse(1 << 20, [], []))], ["doc_id", "features"])
    made = models.random_fourier(rows, size=8)
    assert "vector_to_array" not in plan(made) and "UDF" not in plan(made).split("MapInPandas")[-1]
    assert made.count() == 2
    short = [(0, Vectors.sparse(3, [1], [2.0])), (1, Vectors.dense(0.0, 2.0, 0.0))]
    a, b = (r["features"].toArray() for r in models.random_fourier(spark.createDataFrame(short, ["doc_id", "features"]), size=8).orderBy("doc_id").collect())
    assert a == pytest.approx(b)


def test_random_fourier_holds_a_bounded_number_of_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, Vectors.sparse(50, [i, i + 1], [1.0, 2.0])) for i in range(40)], ["doc_id", "features"])
    want = [r["features"] for r in models.random_fourier(rows, size=8).orderBy("doc_id").collect()]
    monkeypatch.setattr(models, "HELD_ROWS", 3)
    assert [r["features"] for r in models.random_fourier(rows, size=8).orderBy("doc_id").collect()] == want


def test_largest_orders_ties_by_place():
    values = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [np.nan, 0.0, -np.inf, 0.0, np.nan], [1.0, 1.0, 1.0, 1.0, 1.0]])
    row, place = neighbours.largest(values.copy(), 2)
    assert list(zip(row, place)) == [(0, 1), (0, 2), (1, 1), (1, 3), (2, 0), (2, 1)]
    many = np.random.default_rng(0).integers(0, 9, (40, 70)).astype(float)
    row, place = neighbours.largest(many.copy(), 6)
    assert (place.reshape(40, 6) == np.argsort(-many, axis=1, kind="stable")[:, :6]).all()
    assert len(neighbours.largest(many.copy(), 100)[0]) == 40 * 70


def test_gradients_come_from_one_partition_per_core(spark, monkeypatch):
    """More partitions would each send a vector as long as the vocabulary in every step."""
    seen = []

    class Estimator:
        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())

    monkeypatch.setattr(models, "make_classifier", lambda *_: Estimator())
    rows = spark.createDataFrame([(i, i % 2, Vectors.dense(1.0)) for i in range(90)], ["doc_id", "label", "features"]).repartition(60)
    for name in models.BY_GRADIENT:
        experiments.fit(rows, name, {"C": 1.0})
    assert max(seen) <= spark.sparkContext.defaultParallelism


def test_squared_hinge_sums_without_an_exchange(spark, monkeypatch):
    """Tasks add up their blocks: one vector each, and no rows by feature."""
    w = np.array([0.5, -1.0, 0.0, 0.25])
    rows = [(0, 1.0, 1.0, Vectors.sparse(3, [0, 2], [1.0, 2.0])), (1, 0.0, 2.0, Vectors.dense(0.0, 1.0, 3.0)), (2, 1.0, 1.0, Vectors.sparse(3, [], []))]
    docs = spark.createDataFrame(rows, ["doc_id", "label", "weight", "features"]).repartition(3)
    monkeypatch.setattr(linear, "BLOCK_ROWS", 1)
    blocks = docs.select("features", "label", "weight").mapInArrow(linear.packed, linear.BLOCKS_DDL)
    loss, gradient = linear.summed(blocks, w)
    x, y, c = np.array([[1, 0, 2, 1], [0, 1, 3, 1], [0, 0, 0, 1.0]]), np.array([1, -1, 1.0]), np.array([1, 2, 1.0])
    short = np.maximum(0, 1 - y * (x @ w))
    assert loss == pytest.approx((c * short**2).sum()) and gradient == pytest.approx(x.T @ (-2 * c * y * short))
    assert linear.SUMS_DDL == "sums binary"


def test_links_never_broadcast_patients_or_keys(spark):
    """Exploded keys are taken for as small as the ids they come from."""
    people = spark.range(40).select(F.format_string("mrn%09d-%09d", "id", "id").alias("patient_id"), F.lit("a,b").alias("patient_name"))
    diagnosis = people.select(
        F.concat("patient_id", F.lit("1")).alias("diag_id"), F.lit(1).alias("diag_seq"), F.lit("a").alias("last_name"), F.lit("b").alias("first_name")
    )
    linked = linkage.fuzzy_links(people, diagnosis)
    assert linked.select("patient_id", "diag_id").where("diag_id = concat(patient_id, '1')").count() == 40
    chosen = linked._jdf.queryExecution().sparkPlan().toString()
    by_key = [line for line in chosen.splitlines() if "BroadcastHashJoin [_key" in line or "BroadcastHashJoin [patient_id" in line or "BroadcastHashJoin [diag_id" in line]
    assert by_key == []


@pytest.fixture
def placed(spark):
    docs = spark.createDataFrame([(i, "a fever and chills " * 3) for i in range(6)], "doc_id long, text string")
    terms = spark.createDataFrame([("fever", "C1"), ("and chills", "C2")], "term string, cui string")
    return docs, terms


@pytest.mark.parametrize("bound", [0, 128 << 20])
def test_spans_are_the_same_by_either_lookup(placed, monkeypatch, bound):
    docs, terms = placed
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
    spans = concepts.concept_spans(docs, terms, 2)
    assert spans.columns == ["doc_id", "start", "length", "term", "cui"]
    assert {(r["start"], r["cui"]) for r in spans.collect()} == {(2 + 4 * k, "C1") for k in range(3)} | {(3 + 4 * k, "C2") for k in range(3)}
    # A small table is sent to the texts: no place moves and no place is counted.
    assert ("Aggregate" in plan(spans)) == (bound == 0)
    fuzzy = concepts.fuzzy_spans(docs, terms, 1, 0.9)
    assert {r["cui"] for r in fuzzy.collect()} == {"C1"} and fuzzy.count() == 18


def test_mined_rules_write_no_combinations(spark, monkeypatch):
    written = []
    kept = rules.cut
    monkeypatch.setattr(rules, "cut", lambda df: written.append(df.columns) or kept(df))
    docs = spark.createDataFrame([(i, i % 2, "bad bad bad" if i % 2 else "fine fine fine") for i in range(20)], "doc_id long, label int, text string")
    assert rules.mined_predict(docs, docs).where("pred <> label").count() == 0
    assert written == [["term", "pos", "neg"]]


def test_tfidf_writes_the_vocabulary_only(spark, monkeypatch):
    written = []
    kept = vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda df: written.append(df.columns) or kept(df))
    docs = spark.createDataFrame([(0, "x", "aa bb bb"), (1, "y", "aa cc"), (2, "y", None)], "doc_id long, kind string, text string")
    found = {(r["doc_id"], r["kind"], r["term"]): r["tf"] for r in vectors.tfidf(docs, TermOptions(min_df=1), ["kind"]).collect()}
    assert found == {(0, "x", "aa"): 1, (0, "x", "bb"): 2, (1, "y", "aa"): 1, (1, "y", "cc"): 1}
    assert written == [["term", "df"]]


@pytest.mark.parametrize("bound", [0, 128 << 20])
def test_table_vectors_are_the_same_by_either_lookup(spark, monkeypatch, bound):
    docs = spark.createDataFrame([(0, "aa bb bb"), (1, "aa cc"), (2, "zz")], "doc_id long, text string")
    table = term_tables.fit(docs.where("doc_id < 2"), "count")
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
    made = table.transform(docs)
    assert ("_hot" in plan(made)) == (bound == 0)
    assert {r["doc_id"]: sum(r["values"]) for r in made.collect()} == {0: 3.0, 1: 2.0, 2: 0}


def test_terms_are_made_once_and_not_beneath_the_exchange(spark, tmp_path):
    """A filter derived from an explode would be moved to the scan, with everything it is computed from."""
    spark.createDataFrame([(0, "aa bb"), (1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").repartition(4, "doc_id")
    made = vectors.vocabulary(docs), vectors.term_counts(docs), concepts.term_places(docs, 2)
    for found, n in zip(made, (2, 2, 3)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        assert found.count() == n


def test_shares_of_a_curve_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    together = threading.Barrier(2, timeout=60)
    plain = experiments.fit
    monkeypatch.setattr(experiments, "fit", lambda *given: together.wait() is None or plain(*given))
    docs = spark.createDataFrame([(i, i % 2, "bad word" if i % 2 else "fine word") for i in range(24)], "doc_id long, label int, text string")
    options = experiments.RunOptions("MultinomialNB", mode="count", params={"alpha": 1.0})
    curve = experiments.learning_curve(docs.where("doc_id < 18"), docs.where("doc_id >= 18"), options, 50, 101, 50).collect()
    assert [(r["fraction"], r["f1"]) for r in curve] == [(0.5, 1.0), (1.0, 1.0)]


def test_vocabularies_of_fits_have_no_bound(spark, monkeypatch):
    """The vocabulary is a table; neither the driver nor a model holds it as one array."""
    monkeypatch.setattr(vectors, "VOCABULARY_BOUND", 5)
    rows = [(i, i % 2, f"w{i} {'bad' if i % 2 else 'fine'} " + " ".join(f"t{k}" for k in range(i % 7))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, label int, text string")
    runs = [experiments.RunOptions("LinearSVC", 2, params={"C": 10.0, "max_iter": 30}), experiments.RunOptions("LinearSVC", 2, params={"loss": "squared_hinge"})]
    assert {(r["error"], r["f1"]) for r in experiments.run_grid(docs, runs).collect()} == {(None, 1.0)}
    features = experiments.features_of(docs, "tfidf", TermOptions())
    assert features.size == 48 and features.names.count() == 48


@pytest.mark.parametrize("bound", [0, 128 << 20])
def test_vectors_are_those_of_the_rows_whatever_their_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
    rows = [(1, "aa bb bb"), (1, "aa cc"), (1, "aa cc"), (None, "bb"), (2, "zz"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    features = experiments.features_of(docs, "count", TermOptions(min_df=2))
    names = {r["index"]: r["term"] for r in features.names.collect()}
    assert names == {0: "aa", 1: "bb", 2: "cc"}
    made = sorted((str(r["doc_id"]), sorted((names[int(i)], v) for i, v in zip(r["features"].indices, r["features"].values))) for r in features.docs.collect())
    a, b, c = (("aa", 1.0), ("bb", 2.0), ("cc", 1.0))
    assert made == [("1", [a, b]), ("1", [a, c]), ("1", [a, c]), ("2", []), ("3", []), ("4", []), ("None", [("bb", 1.0)])]
    assert {r["features"].size for r in features.docs.collect()} == {3}
    unit = experiments.features_of(docs, "tfidf", TermOptions(min_df=2)).docs.collect()
    assert [round(r["features"].norm(2), 9) for r in unit if r["features"].numNonzeros()] == [1.0] * 4


def test_fits_side_by_side_are_bounded_by_what_the_driver_holds():
    assert experiments.at_once(1000, 4) == 4
    assert experiments.at_once(1 << 19, 4) == 2 and experiments.at_once(1 << 21, 4) == 1

"""The table-backed vectoriser against the fitted stages, and beyond their bound."""

import pytest
from pyspark.ml.classification import LogisticRegression

from notemill.operators import term_tables, vectors
from notemill.operators.vectors import TermOptions

DOCS = [(1, "the red fox and the dog", 1), (2, "a red dog", 0), (3, "the fox", 1), (4, "", 0), (5, None, 0), (6, "unseen words only", 1)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, label int")


@pytest.mark.parametrize("mode", ["count", "tfidf"])
def test_vectors_equal_those_of_the_fitted_stages(spark, docs, mode):
    options = TermOptions(1, 2, min_df=1)
    train = docs.where("doc_id <= 3")
    table = term_tables.fit(train, mode, options)
    names = {r["index"]: r["term"] for r in table.terms.collect()}
    assert sorted(names) == list(range(len(names)))
    got = {r["doc_id"]: {names[i]: round(v, 9) for i, v in zip(r["indices"], r["values"])} for r in table.transform(docs).collect()}
    stages = vectors.preprocess(train, mode, options)
    words = stages.stages[0].vocabulary
    full = docs.where("text IS NOT NULL")
    want = {}
    for r in stages.transform(vectors.prepare(full, mode, options)).collect():
        v = r["features"]
        want[r["doc_id"]] = {words[i]: round(float(x), 9) for i, x in zip(v.indices, v.values)}
    assert {d: v for d, v in got.items() if d != 5} == want
    assert got[5] == {} and got[6] == {}


def test_saved_and_loaded_with_more_terms_than_a_fitted_stage_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "VOCABULARY_BOUND", 50)
    rows = [(d, " ".join(f"w{d * 40 + i}" for i in range(40)) + " shared") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(vectors.VocabularyTooLarge):
        vectors.preprocess(docs, "count", TermOptions())
    options = TermOptions(stop_words=("w1",), max_df=1000)
    term_tables.fit(docs, "tfidf", options).save(str(tmp_path / "v"))
    table = term_tables.load(spark, str(tmp_path / "v"))
    assert (table.size(), table.n, table.options) == (2400, 60, options)
    lengths = [sum(v * v for v in r["values"]) for r in table.transform(docs).collect()]
    assert len(lengths) == 60 and all(abs(x - 1) < 1e-9 for x in lengths)


def test_estimators_read_the_vectors(docs):
    table = term_tables.fit(docs, "count")
    ready = term_tables.as_vectors(table.transform(docs), table.size())
    model = LogisticRegression(maxIter=5).fit(ready)
    assert model.numFeatures == table.size()
    with pytest.raises(ValueError):
        term_tables.fit(docs, "hashed")

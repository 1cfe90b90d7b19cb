"""The risk against its definition, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from notemill.llm import toxicity


def data(n=1500, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        toxic = rng.random() < 0.15
        ws = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(2, 6)):
                ws[rng.randrange(len(ws))] = rng.choice(["Vile", "scum", "trashy" + str(rng.randint(0, 50))])
        docs.append((d, " ".join(ws), d % 3))
        if rng.random() < 0.6:
            labels.append((d, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_the_use_of_labels(spark):
    docs, labels = data()
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    unseen = [(out[d] >= 0.3) == bool(t) for d, t in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean(unseen) > 0.95 and all(0 <= s <= 1 for s in out.values())
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    again = toxicity.fit(df, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_sample_is_bounded_and_repeats_do_not_fill_it(spark):
    docs, labels = data(400)
    df = spark.createDataFrame(docs + docs[:50], "doc_id long, text string, score int").select("doc_id", "text")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    counts = {r["toxic"]: r["count"] for r in toxicity.sample(df, known, 7, 20).groupBy("toxic").count().collect()}
    assert counts == {True: 7, False: 20}
    # One id on most rows, with equal and with different texts, is one row of the sample.
    hot = next(d for d, t in labels if t == 1 and zlib.crc32(str(d).encode()) % 4 != 2)
    many = df.select("doc_id", "text").unionByName(spark.range(5000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("you idiot "), F.col("id") % 100).alias("text")))
    rows = toxicity.sample(many, known, 1000, 1000).groupBy("toxic", "doc_id").count().collect()
    assert len(rows) <= 2000 and {r["count"] for r in rows} == {1} and hot in {r["doc_id"] for r in rows}


def test_gradient_steps_lower_the_corrected_risk():
    rng = np.random.default_rng(0)
    pos, unl = rng.random((200, 5)).astype(np.float32), rng.random((800, 5)).astype(np.float32)
    pos[:, 0] += 1
    unl[:120, 0] += 1
    weights, bias = toxicity.non_negative_pu(pos, unl, 0.15)
    risk = lambda w, b: (lambda p, m: p + max(0.0, m))(*toxicity.risks(pos @ w + b, unl @ w + b, 0.15))
    assert risk(weights, bias) < 0.6 * risk(np.zeros(5), float(np.log(0.15 / 0.85)))
    a, b = np.array([0.3, -1.0]), np.array([0.5, 2.0, -3.0])
    plus, minus = toxicity.risks(a, b, 0.2)
    log = lambda m: np.log(1 + np.exp(-m))
    assert np.isclose(plus, 0.2 * log(a).mean()) and np.isclose(minus, log(-b).mean() - 0.2 * log(-a).mean())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "vile scum"), (3, "x " * 50000), (3, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, None), (None, 1), (2, 0), (1, 1)], none.schema)):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0

"""Held-out accuracy, the use of labels, and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from notemill.llm import language

SYLLABLES = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "keit", "ß"], "fr": ["eau", "que", "é", "ment"], "es": ["ción", "ñ", "que", "ado"], "xx": ["zz", "qy", "kk"]}


def rows(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang] + ["e", "n", "a"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60)))
        out.append((d, text, lang, "s"))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = language.fit(df, per_language=100)
    assert sorted(map(len, model.families)) == [1, 2, 2] and len(model.pairs) == 2
    out = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    unseen = [out[d]["lang_pred"] == lang for d, _, lang, _ in data if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(unseen) > 100 and np.mean(unseen) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())
    wrong = [(d, t, "en" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, s) for d, t, lang, s in data]
    again = language.fit(spark.createDataFrame(wrong, df.schema), per_language=100)
    assert np.array_equal(again.pair, model.pair) and np.array_equal(again.family, model.family)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 -- !", "fr"), (None, "the thing", "en"), (4, "été", None), (5, "the " * 60000, "en"), (5, "x", "en")], "doc_id long, text string, lang string")
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df, language.fit(df)).collect()]
    assert len(out) == 7 and {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= set(out)
    none = df.where("lang = 'zz'")
    assert {r["lang_pred"] for r in language.identify(df, language.fit(none)).collect()} == {"und"}
    assert language.identify(none, language.fit(df)).count() == 0


def test_frequencies_stay_inside_documents():
    one = language.frequencies(np.frombuffer("abcÉd".encode(), np.uint8), np.array([0, 6]))
    raw = np.frombuffer("abcÉdxabcÉd".encode(), np.uint8)
    both = language.frequencies(raw, np.array([0, 6, 7, 13]))
    assert np.allclose(both[[0, 2]], one) and both[1].sum() == 0


def test_sample_is_bounded_in_rows_under_one_hot_id(spark, monkeypatch):
    held = []
    monkeypatch.setattr(language, "learn", lambda x, lang, families: held.append((x.shape[0], dict(Counter(lang)))))
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text number "), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))).alias("text"),
        F.when(F.col("id") % 5 == 0, "fr").otherwise("en").alias("lang"),
    )
    language.fit(rows, per_language=40)
    ((n, by_language),) = held
    assert n <= 80 and set(by_language) == {"en", "fr"} and max(by_language.values()) <= 40 and min(by_language.values()) >= 20

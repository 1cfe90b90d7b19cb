"""Substring dedup against brute force, with weak hashes, hot minimisers and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notemill.llm import substrings, tables, words


def brute(rows, window):
    order = lambda d: float("inf") if d is None else d
    first = {}
    split = [(order(d), (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, t), (o, ws) in zip(rows, split):
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < o:
                gone.update(range(i, i + window))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=40):
    rng = random.Random(seed)
    names = [rng.choice(["wort", "été", "x", "Mot s"]) + str(i) for i in range(vocabulary)]
    passages = [[rng.choice(names) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(names) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, n), rng.choice([" ", "\n", "\t  "]).join(ws)))
    rows += [(None, " ".join(passages[0])), (None, " ".join(passages[0])), (7, None), (8, ""), (9, "buy " * 500), (3, "buy " * 90)]
    rows += [rows[0], rows[1]]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substrings.dedup_substrings(df, **options)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("window,gram", [(13, 3), (5, 2), (2, 1)])
def test_against_brute_force(spark, window, gram):
    rows = corpus(window, 60)
    assert run(spark, rows, window=window, gram=gram) == brute(rows, window)


def test_hot_minimisers_travel_singly(spark):
    rows = [(i, " ".join(["same"] * (15 + i % 3) + [f"w{i}"])) for i in range(40)] + corpus(3, 30)
    keyed = spark.createDataFrame(rows, "doc long, text string")
    assert len(substrings.hot_minimisers(keyed, 13, 3, 32)) >= 1
    assert run(spark, rows) == brute(rows, 13)


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    """Two texts without an id whose 32-bit hashes are equal; one repeats document 1, the other nothing."""
    found = (
        spark.range(200_000)
        .select(F.concat(F.lit("a b c d e f g h i j k l m w"), F.col("id")).alias("t"))
        .groupBy(F.hash("t"))
        .agg(F.collect_list("t").alias("t"))
        .where(F.size("t") == 2)
        .first()
    )
    one, other = found["t"]
    rows = [(1, "u v " + one), (None, one), (None, other)]
    got = run(spark, rows, window=14)
    assert got == brute(rows, 14)
    assert sorted(r[2] for r in got) == [0, 0, 14]


def test_a_passage_in_all_documents_costs_a_bucket_one_entry_a_slice(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"w{i} {passage} v{i}") for i in range(900)] + [(None, passage)] * 300
    assert run(spark, rows) == brute(rows, 13)
    part = pa.RecordBatch.from_pydict(
        {"doc": [d for d, _ in rows], "text": [t for _, t in rows], "version": [bytes(16)] * len(rows)},
        schema=pa.schema([("doc", pa.int64()), ("text", pa.string()), ("version", pa.binary())]),
    )
    sent = list(substrings.super_kmers(part, 13, 2, 8, np.zeros(0, np.uint64), 0))
    passed = [b for batch in sent for b in batch.column("packed").to_pylist() if b is not None]
    pieces = [p for b in passed for p in tables.unpack(b).split(b"\n")]
    assert len(pieces) == len(set(pieces)) and sum(passage.encode() in p or p in passage.encode() for p in pieces) < 30


def test_very_long_text_and_texts_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 2000)
    rows = corpus(11, 80) + [(500, " ".join(f"n{i % 9000}" for i in range(60000))), (501, " ".join(f"n{i}" for i in range(40)))]
    assert run(spark, rows) == brute(rows, 13)


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    texts = ["a b c d", "a b x d", "a b c d"]
    raw = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)
    offsets = np.array([0, 8, 16, len(raw)])
    found = words.split_bytes(raw, offsets, words.NOT_BLANK)
    monkeypatch.setattr(words, "grams", lambda h, n: np.zeros(len(h) - n + 1, dtype=np.uint64))
    at = found.same_document(3)
    least = substrings.least_document(found, at, 3, np.array([5, 5, 4, 4, 3, 3]))
    assert least.tolist() == [3, 3, 4, 4, 3, 3]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, start int")
    assert substrings.dedup_substrings(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, n_words int, doc string")
    rows = {r["doc_id"]: r for r in substrings.dedup_substrings(odd).collect()}
    assert (rows[1]["n_words"], rows[1]["doc"], rows[2]["n_words"]) == (2, "x", 0)


def test_word_helpers():
    found = words.split_bytes(np.frombuffer(b"Ab  cAb c", np.uint8), np.array([0, 5, 5, 9]), words.NOT_BLANK, lower=True)
    assert found.per_document.tolist() == [2, 0, 2]
    text, offsets = found.joined()
    assert text == b"ab c ab c " and offsets.tolist() == [0, 3, 5, 8, 10]
    h = found.hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    long = np.frombuffer(b"x" * 5000 + b" " + b"x" * 5000 + b" " + b"x" * 4999, np.uint8)
    h = words.split_bytes(long, np.array([0, len(long)]), words.NOT_BLANK).hashes()
    assert h[0] == h[1] != h[2]
    values = np.array([5, 3, 8, 1, 9, 7], dtype=np.uint64)
    for n in range(1, 7):
        assert words.sliding_min(values, n).tolist() == [min(values[i : i + n]) for i in range(7 - n)]
        assert len(words.grams(values, n)) == 7 - n
    assert len(words.grams(values, 7)) == 0

"""Ids and texts against the library, the table against plain merging, and odd rows."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from notemill.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "b", "th", "er", "tion", "the", " ", "  ", "    ", "\n", "\t", "é", "ß", "12", "!?", "▁", "▁▁", " ", "\x00", "漢", "語", "😀", "<s>", "</s>", "<0x41>", "é", "ééé", "ing"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return sentence_pieces.Model(file.read())


def merged(model, text):
    """Plain merging: always the best neighbours, the leftmost of equals."""
    symbols = list(text)
    while len(symbols) > 1:
        scores = [model.score.get(a + b, sentence_pieces.NEVER) for a, b in zip(symbols, symbols[1:])]
        best = max(scores)
        if best == sentence_pieces.NEVER:
            break
        at = scores.index(best)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def test_table_is_the_last_token_of_every_prefix(model):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 14))).replace(" ", "▁")
        last = model.last_tokens(text)
        for stop in range(1, len(text) + 1):
            assert (last[stop] or text[stop - 1]) == merged(model, text[:stop])[-1]


def test_pairs_are_compatible_when_merging_keeps_them(model):
    rng = random.Random(2)
    pieces = list(model.id_of)
    some = [p for p in rng.sample(pieces, 400) if model.history(p) is not None]
    seen = set()
    for left, right in zip(some, reversed(some)):
        for a, b in ((left, right), (left[:1], right), (left, right[:1]), (left[-1:], left[:1])):
            if model.history(a) is None or model.history(b) is None:
                continue
            seen.add(model.compatible(a, b))
            assert model.compatible(a, b) == (merged(model, a + b) == [a, b])
    assert seen == {True, False}


def test_ids_and_texts_equal_the_library(spark, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [None, "", " ", "   ", "x" * 30000, "word and " * 20000, "語" * 5000, "".join(map(chr, range(1, 0x500)))]
    rows = [(i % 7, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, ids string, other int").repartition(3)
    coded = sentence_pieces.encode(df, PATH)
    assert coded.columns == ["doc_id", "other", "ids"]
    back = sentence_pieces.decode(coded, PATH)
    got = back.collect()
    assert len(got) == len(rows) + 5
    for r in got:
        expected = library.encode(texts[r["other"]] or "") + [library.eos_id()]
        assert r["ids"] == expected
        assert r["text"] == library.decode(expected)


def test_decodes_any_ids_as_the_library_does(model, library):
    rng = random.Random(4)
    n = library.get_piece_size()
    for _ in range(3000):
        # Many byte pieces, so that broken sequences of bytes are met.
        ids = [rng.choice([rng.randrange(n), rng.randrange(0, 259), library.piece_to_id("▁")]) for _ in range(rng.randint(0, 6))]
        assert model.decode(np.array(ids, dtype=np.int32)) == library.decode(ids), ids


def test_without_end_id_and_with_null_ids(spark, library):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    coded = sentence_pieces.encode(df, PATH, end=False)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {1: library.encode("one two"), 2: []}
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sentence_pieces.decode(nulls, PATH).collect()[0]["text"] is None


def test_empty_table_and_whole_texts_without_cuts(spark, model, library):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentence_pieces.decode(sentence_pieces.encode(empty, PATH), PATH).count() == 0
    cuts, model.cuts = model.cuts, None
    text = "The whole text, in one stretch.  Two blanks."
    assert model.encode(pa.array([text]), False)[0].as_py() == library.encode(text)
    model.cuts = cuts


def test_bounded_memory_of_pairs_and_stretches(monkeypatch, library):
    monkeypatch.setattr(sentence_pieces, "KEPT", 3)
    monkeypatch.setattr(sentence_pieces, "KEPT_PAIRS", 5)
    with open(PATH, "rb") as file:
        small = sentence_pieces.Model(file.read())
    text = "many different words that are forgotten and encoded again: many different words"
    assert small.encode(pa.array([text]), False)[0].as_py() == library.encode(text)
    assert len(small.stretches) <= 3 and sum(map(len, small.before.values())) <= 5

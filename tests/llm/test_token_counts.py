"""Counts against the tokenizer itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notemill.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, rows):
    whole = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted((tuple(r) for r in token_counts.count_tokens(df, PATH).collect()), key=repr)
    size = lambda t: (len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False)))
    assert got == sorted(((d, *size(t)) for d, t, _ in rows), key=repr)


def test_random_and_odd_texts(spark):
    rng = random.Random(4)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "12", "7", "!?", "\u00a0", "\u2003", "\x1c", "\x00", "漢", "😀", "\u0589", "\U0001f1e9", "<|endoftext|>", "<|", "|>"]
    rows = [(d, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80))), "x") for d in range(300)]
    rows += [(None, "one two", ""), (None, None, ""), (1, None, ""), (2, "", ""), (3, "other text", ""), (7, "word " * 20000, "")]
    rows += [rows[5], rows[5], rows[6], (400, "x" * 20000, ""), (401, "<|endoftext|>", "")]
    check(spark, rows)


def test_frequent_pre_tokens_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 300)
    check(spark, [(d, f"the same words, and {d} more", None) for d in range(120)])


def test_empty_table_and_other_tokenizers(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json"))

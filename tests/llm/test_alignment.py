"""Groups, links and counts against a plain comparison of byte borders over whole texts."""

import random
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from notemill.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "the", "tion", "er", " ", "  ", "   ", "\n", " \n", "\t", "é", "ß", "12", "!?", "'s", " ", "\x00", "\x1c", "漢", "語", "😀", "<s>", "<|endoftext|>", "<0x41>", "é", "×", "word", "Ünï"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def plain(texts, libraries, rule="end"):
    a, b = libraries
    with open(A, encoding="utf-8") as one, open(B, "rb") as two:
        pair = alignment.Tokenizers(one.read(), two.read())
    rows, links = [], []
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        joined = [b"".join(t[i] for i in x) for t, x in zip((pair.a_bytes, pair.b_bytes), ids)]
        if not text or joined != [whole, whole]:
            rows.append(None)
            links.append([])
            continue
        left, right = spans(ids[0], pair.a_bytes), spans(ids[1], pair.b_bytes)
        borders = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups = [([], []) for _ in borders]
        for number, side in enumerate((left, right)):
            for i, s, _ in side:
                groups[bisect_right(borders, s)][number].append(i)
        rows.append((len(left), len(right), groups))
        ends = {e: i for i, _, e in right}
        if rule == "end":
            links.append([(i, ends[e]) for i, _, e in left if e in ends])
        else:
            links.append([(i, j) for i, s, e in left for j, t, f in right if s < f and t < e])
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for row, ls in zip(rows, links):
        n_a, n_b, groups = row or (0, 0, [])
        out.append((n_a, n_b, len(groups), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), groups))
    return out


def check(spark, texts, libraries, rule="end"):
    rows = [(None if i % 5 == 0 else i % 9, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, place int").repartition(3)
    aligned = alignment.align(df, A, B, links=rule)
    assert aligned.columns == ["doc_id", "place", *alignment.MADE]
    got = sorted(aligned.collect(), key=lambda r: r["place"])
    assert [(*r[2:8], [(g["a"], g["b"]) for g in r["groups"]]) for r in got] == plain(texts, libraries, rule)
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]


def test_random_and_odd_texts(spark, libraries, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", "  ", "▁", "a▁b", "﻿", "one two", "one two", "one two"] + texts[:20]
    check(spark, texts, libraries)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    check(spark, texts, libraries, "overlap")


def test_very_long_texts_and_a_repeated_one(spark, libraries):
    check(spark, ["word and word, " * 20000, "x" * 30000, *["the same text in many rows"] * 300], libraries)


def test_cutting_texts_changes_nothing(libraries):
    with open(A, encoding="utf-8") as one, open(B, "rb") as two:
        pair = alignment.Tokenizers(one.read(), two.read())
    assert pair.cuts
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice(LETTERS) for _ in range(30))
        parts = pair.encode(pair.parts(text))
        whole = pair.encode([text])
        assert [sum(p, []) for p in parts] == [sum(w, []) for w in whole]


def test_empty_table_only_broken_texts_and_unknown_links(spark, libraries):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    check(spark, ["▁", None, "", "x▁"], libraries)
    with pytest.raises(ValueError):
        alignment.align(empty, A, B, links="start")

"""Budgets by the literal sharing rounds, and taken words against a plain loop."""

import hashlib
import random
from fractions import Fraction

import pytest

from notemill.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(sum(sizes.values()))
    while left and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = Fraction(0)
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = Fraction(3 * sizes[s])
                open_.discard(s)
    return target


def brute(rows):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, size):
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    out = []
    for s, total in sizes.items():
        budget = int(target[s] + Fraction(1, 2))
        key = lambda r: (hashlib.md5(f"1|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])
        own = sorted(((d, n) for (d, _, x), n in zip(rows, size) if x == s), key=key)
        epochs, rest = divmod(budget, total) if total else (0, 0)
        for d, n in own:
            part = min(n, max(rest, 0))
            rest -= n
            out.append((d, n, total, round(float(target[s]), 6), epochs * n + part))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(300):
        source = rng.choice(["big"] * 8 + ["é", "a", "B", "z", None])
        rows.append((d, None if d % 50 == 7 else " ".join(["w"] * rng.choice([0, 1, 9, 40])), source))
    rows += [(5000, "w " * 3000, "one"), (None, "w w", "a"), rows[3], (9, "", "empty"), (10, None, "empty")]
    if seed == 2:
        rows += [(6000 + i, "w " * 100, f"s{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df).collect()
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out), key=repr)
    assert got == brute(rows)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_budget_is_met_to_the_word(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 5 == 0]) for i in range(200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert sum(r["taken"] for r in own) == own[0]["budget"]
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(df).collect()] == [0, 0]
    assert mixing.mix(df.limit(0)).count() == 0

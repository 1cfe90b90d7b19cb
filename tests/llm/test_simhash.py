"""Fingerprints, grids and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notemill.llm import simhash
from notemill.llm.components import components


def fingerprint(text, shingle=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + shingle]), 42) for i in range(max(1, len(ws) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, max_bits):
    """Smallest id of each component; ids are unique here."""
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, f) in enumerate(fps):
        for e, g in fps[:i]:
            if (f ^ g).bit_count() <= max_bits:
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in fps}


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    base = [[f"{rng.choice('abcdé')}{rng.randint(0, 400)}" for _ in range(rng.randint(60, 200))] for _ in range(8)]
    rows = [(0, ""), (1, None), (2, "One"), (3, "one TWO Three"), (4, " \t")]
    for d in range(5, 90):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = "new" + str(rng.randint(0, 9))
        rows.append((d, rng.choice([" ", "\n"]).join(ws)))
    rng.shuffle(rows)
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    fps = sorted((d, fingerprint(t)) for d, t in rows)
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {d: f"{f:016x}" for d, f in fps}
    assert {r["doc_id"]: r["component_id"] for r in out} == brute(fps, 4)


@pytest.mark.parametrize("max_bits", [1, 4])
def test_links_of_random_fingerprints(spark, monkeypatch, max_bits):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(max_bits)
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(30):
            fps.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), max_bits)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    numbered = list(enumerate(fps))
    want = brute(numbered, max_bits)
    got = {}
    for (i, _), (f,) in zip(numbered, signed):
        got.setdefault(roots.get(f, f), []).append(i)
    assert {i: min(g) for g in got.values() for i in g} == want


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for mask in simhash.grid_masks(4):
        assert bin(mask).count("1") in range(20, 26)
    low = np.uint64(simhash.SEGMENT_BITS)
    count = lambda x: (x & low) + (x >> np.uint64(1) & low)
    one = sum(np.abs((count(a) >> np.uint64(2 * s) & np.uint64(3)).astype(int) - (count(b) >> np.uint64(2 * s) & np.uint64(3)).astype(int)) for s in range(32))
    assert (one <= np.bitwise_count(a ^ b)).all()


def test_chain_components(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 400)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(n + 1)}, 400: 400, 500: 400}
    assert components(links.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (2, "other words here", "c"), (None, text, "d"), (None, "alone", "e"), (9, None, "f"), (8, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = sorted((tuple(r) for r in simhash.one_per_component(df).collect()), key=repr)
    assert kept == sorted([(2, text, "b"), (2, "other words here", "c"), (None, "alone", "e"), (8, "", "g")], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df).where(F.col("doc_id").isNull() & F.col("component_id").isNull()).count() == 1

"""Top-k against brute force, with ties, repeated and odd vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest

from notemill.llm import topk


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[(i, tuple(math.floor(256 * x) for x in v))] = None
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(700, 5), (3, 5)])
def test_against_brute_force(spark, monkeypatch, n, k):
    monkeypatch.setattr(topk, "ROWS", 256)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 6] + 0.3 * rng.normal(size=12))]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one very common vector
    rows += [rows[1], rows[0], (None, rows[0][1]), (2000, None), (2001, [1.0, None]), (2002, [math.nan]), (2003, [math.inf]), (2004, []), (2010, [3.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    out = topk.top_k(df, every=10, k=k).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == brute(rows, 10, k)


def test_rows_repeated_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 256)
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(300)]
    hot = max(rows[1:], key=lambda r: sum(a * b for a, b in zip(r[1], rows[0][1])))
    # Equal rows, the same with other digits below the step and with trailing zeros; and every row twice.
    near = [(math.floor(256 * x) + 0.5) / 256 for x in hot[1]]
    rows += [hot] * 1000 + [(hot[0], near), (hot[0], hot[1] + [0.0, 0.0])] + rows + [(5000, [0.0, -0.0]), (5000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = topk.top_k(df, every=10, k=5).collect()
    want = [r for r in rows[:300]] + [(5000, [0.0] * 8)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == brute(want, 10, 5)
    assert topk.distinct(topk.valid(df, "vec_id", "embedding")).count() == 301


def test_blocks_are_pruned(monkeypatch):
    rng = np.random.default_rng(3)
    centres = 2 * rng.normal(size=(16, 24))
    tables = []
    for b in range(16):
        x = [list(map(float, centres[b] + 0.05 * rng.normal(size=24))) for _ in range(100)]
        table = pa.table({"vec_id": pa.array(range(b * 100, b * 100 + 100)), "x": pa.array(x, pa.list_(pa.float64()))})
        tables.append(pa.Table.from_batches([topk.block_of(table)]))
    queries = pa.table({"query_id": [-1], "version": [0], "x": [list(map(float, centres[3]))], "least": pa.array([None], pa.int64())})
    scored = []
    plain = topk.product
    monkeypatch.setattr(topk, "product", lambda a, b: (scored.append(len(b)), plain(a, b))[1])
    found = topk.search_cell(queries, pa.concat_tables(tables), 5, False)
    assert found.num_rows == 5 and all(300 <= v < 400 for v in found.column("vec_id").to_pylist())
    assert scored.count(100) <= 3  # of sixteen blocks


def test_large_numbers_stay_exact(spark):
    assert topk.product(np.array([[1 << 40, 1]]), np.array([[1 << 21, 1]])).tolist() == [[(1 << 61) + 1]]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0

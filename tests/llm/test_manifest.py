"""Leaves, subroots, root and proofs against plain hashing, for all shapes of trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from notemill.llm import manifest
from notemill.scale import ordered_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, proof string, place string, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h(*values)


def tree_of(nodes):
    """All levels; every two nodes become one, a last single one is hashed alone."""
    made = [nodes]
    while len(made[-1]) > 1:
        below = made[-1]
        made.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return made


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        out.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
        at //= 2
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = tree_of([leaf_of(r) for r in groups[lang]])
    upper = tree_of([trees[lang][-1][0] for lang in langs])
    root = upper[-1][0] if langs else None
    out = []
    for number, lang in enumerate(langs):
        for at, row in enumerate(groups[lang]):
            steps = siblings(trees[lang], at) + siblings(upper, number)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf_of(row, int(hit))
            for odd, other in steps:
                folded = h(other, folded) if odd else h(folded, other)
            out.append((row[0], leaf_of(row), trees[lang][-1][0], root, h(*[s for _, s in steps]), folded))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = manifest.manifest(df).withColumn("proof", manifest.proof_digest(F.col("proof")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == expected(rows)
    return got


def test_trees_of_many_sizes(spark):
    rows = []
    for n in (1, 2, 3, 5, 31, 32, 33, 64, 65, 1030):
        rows += [(n * 10_000 + i, f"text {i}", f"lang{n}", None, i if i % 3 else None) for i in range(n)]
    random.Random(0).shuffle(rows)
    got = check(spark, rows)
    broken = [r for r in got if r[3] != r[5]]
    assert 0 < len(broken) < len(got)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "a", None, "s", 1), (None, "", "", "", 0), (1, "é漢", "de", "q", 3),
        (1, "é漢", "de", "q", 3), (1, "other", "de", "q", None), (2, "x" * 3_000_000, "de", "q", 3_000_000), (-5, "-", "-", "-", -7),
        (7, "seven", "é", "ß", 5), (8, "eight", "z", "", 5), (9, "nine", "Z", "", 5),
    ]
    check(spark, rows)


def test_one_row_has_no_siblings(spark):
    (row,) = check(spark, [(3, "only", "en", "s", 4)])
    assert row[1] == row[2] == row[3] and row[4] == h("")


def test_one_id_and_one_group_hold_most_rows(spark):
    check(spark, [(5, "same", "en", "s", 4)] * 700 + [(i, f"t{i}", "en", "s", 2) for i in range(300)])


def test_many_groups(spark):
    check(spark, [(i, "t", f"lang {i}", "s", 2) for i in range(150)])


def test_empty_table_and_unknown_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest(empty).count() == 0
    with pytest.raises(ValueError):
        manifest.manifest(empty, group="place")


def test_only_every_few_levels_are_stored(spark):
    nodes = spark.range(2100).select(
        F.lit(0).alias("tree"), F.col("id").alias("place"), F.lit(12).alias("height"),
        F.sha2(F.col("id").cast("string"), 256).alias("node"), F.lit(None).cast("int").alias("payload"),
    )
    forest = manifest.Forest(nodes)
    # 12 levels above 2,100 nodes: stored are the levels 0, 5 and 10 only, in rows of up to 32 nodes.
    assert [s.count() for s in forest.stored] == [66, 3, 1]
    assert max(r[0] for r in forest.stored[0].select(F.size("nodes")).collect()) == 32
    tree = tree_of([h(str(i)) for i in range(2100)])
    assert forest.roots().collect()[0]["node"] == tree[-1][0]


def test_blocks_and_subtrees_are_even_under_one_hot_id(spark):
    df = spark.range(20_000).select(
        F.lit("en").alias("tree"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("ident"),
        F.lit("same").alias("node"), F.monotonically_increasing_id().alias("row"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ordered_blocks(df, [F.col("tree"), F.col("ident"), F.col("node"), F.col("row")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert max(sizes) < 3 * 20_000 / 8

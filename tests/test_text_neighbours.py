"""Pruned nearest-neighbour searches against brute force, and what they read."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notemill.operators import concepts, postings, set_neighbours, sparse_neighbours, text_models
from notemill.operators.vectors import TermOptions


def vectors(seed, n, words=300):
    """Unit vectors over terms of very uneven frequency; some are equal."""
    rng = random.Random(seed)
    out = {}
    for d in range(n):
        terms = {min(int(rng.paretovariate(0.6)), words) for _ in range(rng.randint(1, 25))}
        out[d] = {f"t{t}": rng.random() + 0.05 + math.log(1 + t) for t in terms}
        if d % 10 == 9:
            out[d] = dict(out[d - 1])
        length = math.sqrt(sum(w * w for w in out[d].values()))
        out[d] = {t: w / length for t, w in out[d].items()}
    return out


def frame(spark, held, ident):
    rows = [(d, t, w) for d, v in held.items() for t, w in v.items()]
    return spark.createDataFrame(rows, f"{ident} long, term string, w double")


@pytest.mark.parametrize("k,slots", [(1, 4096), (5, 4096), (5, 3)])
def test_sparse_search_equals_brute_force(spark, monkeypatch, k, slots):
    monkeypatch.setattr(postings, "POSTINGS", slots)  # few entries a slot: long lists are dealt out
    monkeypatch.setattr(sparse_neighbours, "FIRST_READ", 8)
    items, queries = vectors(1, 150), {d: v for d, v in vectors(1, 150).items() if d % 4 == 0} | {1000 + d: v for d, v in vectors(2, 25).items()}
    want = {}
    for q, v in queries.items():
        sims = [(-round(sum(w * own.get(t, 0.0) for t, w in v.items()), 9), i) for i, own in items.items() if i != q and set(v) & set(own)]
        want[q] = sorted(sims)[:k]
    got = {}
    for r in sparse_neighbours.sparse_nearest(frame(spark, queries, "query_id"), frame(spark, items, "item_id"), k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["similarity"], r["item_id"])
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}


@pytest.mark.parametrize("few", [0, 10**9])
def test_lists_and_blocks_find_the_same(spark, monkeypatch, few):
    """Blocks of a few texts or of all, common and rare terms, equal texts; more rows than one block holds."""
    for name, value in {"FEW_MEETINGS": few, "BLOCK_TEXTS": 40, "COMMON_TERMS": 7, "SLICE_ROWS": 5}.items():
        monkeypatch.setattr(sparse_neighbours, name, value)
    items, queries = vectors(1, 150), {d: v for d, v in vectors(1, 150).items() if d % 4 == 0}
    want = []
    for q, v in queries.items():
        sims = [(-round(sum(w * own.get(t, 0.0) for t, w in v.items()), 9), i) for i, own in items.items() if i != q and set(v) & set(own)]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(sims)[:5])]
    found = sparse_neighbours.sparse_nearest(frame(spark, queries, "query_id"), frame(spark, items, "item_id"), 5)
    assert sorted(tuple(r) for r in found.select("query_id", "item_id", "similarity", "rank").collect()) == sorted(want)


def test_texts_of_common_words_meet_in_blocks_only(spark, monkeypatch):
    """Every text shares words with every other: no exchange holds a row per pair and word, or per pair."""
    monkeypatch.setattr(sparse_neighbours, "listed_nearest", None)
    rng = random.Random(3)
    rows = [(d, int(d % 5 == 0), " ".join(rng.choice(["the", "of", "and", "in", "to", f"w{rng.randint(0, 99)}"]) for _ in range(60))) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, fold int, text string")
    found = sparse_neighbours.nearest_texts(docs, [1], 3)
    assert found.count() == 120 * 3 and found.where("similarity > 1.000001 or similarity <= 0").count() == 0


def test_sparse_search_reads_few_lists(spark):
    """Frequent terms of low weight are not read: candidates stay far below all pairs."""
    rng = random.Random(4)
    held = {}
    for d in range(400):
        v = {f"common{i}": 0.1 for i in range(20)} | {f"rare{rng.randint(0, 80)}": 1.0 for _ in range(6)}
        length = math.sqrt(sum(w * w for w in v.values()))
        held[d] = {t: w / length for t, w in v.items()}
    queries, items = frame(spark, held, "query_id"), frame(spark, held, "item_id")
    entries = items.withColumn("level", sparse_neighbours.level(F.col("w")))
    readers = queries.withColumnRenamed("w", "qw")
    terms = postings.described(sparse_neighbours.weight_blocks(entries), readers)
    dealt = postings.placed(entries, terms)
    blocks = postings.opened(readers, terms).withColumns({"bound": F.col("qw") * F.col("top"), "gain": F.col("qw") * F.col("step")})
    first = sparse_neighbours.kth_largest(sparse_neighbours.partial_sums(sparse_neighbours.first_blocks(blocks), dealt), 3)
    read = sparse_neighbours.needed_blocks(blocks, first)
    assert read.where("term LIKE 'common%'").count() == 0
    assert sparse_neighbours.partial_sums(read, dealt).count() < 400 * 399 / 2


def test_hot_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(postings, "POSTINGS", 100)
    entries = spark.range(5000).select(F.lit("hot").alias("term"), F.lit(0).alias("level"), F.col("id").alias("item_id"))
    readers = spark.range(300).select(F.col("id").alias("query_id"), F.lit("hot").alias("term"))
    terms = postings.described(postings.block_sizes(entries), readers)
    dealt = postings.placed(entries, terms)
    cells = [r["count"] for r in dealt.groupBy("term", "level", "slot", "group").count().collect()]
    assert len(cells) == 150 and max(cells) < 160
    met = postings.met(postings.opened(readers, terms), dealt, [])
    assert met.count() == 300 * 5000 - 300
    assert met.distinct().count() == met.count()


def sets(seed, n):
    rng = random.Random(seed)
    out = {}
    for d in range(n):
        out[d] = sorted({min(int(rng.paretovariate(0.7)), 500) for _ in range(rng.choice([1, 2, 5, 20, 60]))})
        if d % 7 == 6:
            out[d] = sorted(set(out[d - 1]) ^ {rng.randint(1, 500)}) or [1]
    return out


@pytest.mark.parametrize("k,slots", [(1, 4096), (4, 5)])
def test_set_search_equals_brute_force(spark, monkeypatch, k, slots):
    monkeypatch.setattr(postings, "POSTINGS", slots)
    monkeypatch.setattr(set_neighbours, "FIRST_READ", 6)
    items = sets(3, 160)
    queries = {d: v for d, v in items.items() if d % 5 == 0} | {1000 + d: v for d, v in sets(5, 30).items()} | {2000: [9999]}
    q = spark.createDataFrame(list(queries.items()), "query_id long, bits array<long>")
    i = spark.createDataFrame(list(items.items()), "item_id long, bits array<long>")
    got = {}
    for r in set_neighbours.set_nearest(q, i, k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["item_id"])
    want = {a: sorted((len(set(v) ^ set(w)), b) for b, w in items.items() if a != b)[:k] for a, v in queries.items()}
    assert {a: [v[r] for r in sorted(v)] for a, v in got.items()} == want


@pytest.mark.parametrize("few", [0, 10**9])
def test_sets_by_lists_and_by_blocks(spark, monkeypatch, few):
    """Frequent members make no candidate rows; sets that share nothing, equal sets and equal ids count alike."""
    for name, value in {"FEW_MEETINGS": few, "BLOCK_TEXTS": 40, "COMMON_TERMS": 7, "SLICE_ROWS": 5}.items():
        monkeypatch.setattr(sparse_neighbours, name, value)
    if few == 0:
        monkeypatch.setattr(set_neighbours, "candidate_pairs", None)
    items = sets(3, 160)
    queries = {d: v for d, v in items.items() if d % 5 == 0} | {2000: [9999]}
    q = spark.createDataFrame(list(queries.items()), "query_id long, bits array<long>")
    i = spark.createDataFrame(list(items.items()), "item_id long, bits array<long>")
    got = [tuple(r) for r in set_neighbours.set_nearest(q, i, 4).select("query_id", "item_id", "distance", "rank").collect()]
    want = []
    for a, v in queries.items():
        near = sorted((len(set(v) ^ set(w)), b) for b, w in items.items() if a != b)[:4]
        want += [(a, b, d, r + 1) for r, (d, b) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_set_search_makes_few_candidates(spark):
    """Near copies share their rare members; frequent members alone make no candidates."""
    rng = random.Random(8)
    held = {}
    for d in range(0, 300, 3):
        own = [rng.randrange(10**6) for _ in range(30)]
        for copy in range(3):
            held[d + copy] = sorted({*range(40), *own[copy:]})
    q = spark.createDataFrame(list(held.items()), "query_id long, bits array<long>")
    i = spark.createDataFrame(list(held.items()), "item_id long, bits array<long>")
    assert set_neighbours.candidate_pairs(q, i, 2).count() <= 300 * 5


def test_fewer_items_than_neighbours(spark):
    q = spark.createDataFrame([(1, [1, 2])], "query_id long, bits array<long>")
    i = spark.createDataFrame([(1, [1, 2]), (2, [3])], "item_id long, bits array<long>")
    assert [(r["item_id"], r["distance"]) for r in set_neighbours.set_nearest(q, i, 5).collect()] == [(2, 3)]


@pytest.mark.parametrize("name,params", [("bit_knn_all", {"k": 3}), ("text_knn", {"n_neighbors": 3, "weights": "distance", "terms": TermOptions(min_df=1)})])
def test_neighbour_classifiers_find_a_planted_rule(spark, name, params):
    rng = random.Random(2)
    rows = [(d, d % 2, " ".join([("alpha beta", "gamma delta")[d % 2], f"word{rng.randint(0, 2)}", "common text"])) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, label int, text string")
    found = text_models.cross_validate(docs, name, params, folds=2).collect()
    assert len(found) == 80 and all(r["pred"] == r["label"] for r in found)


def grams(term):
    padded = f" {term} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 1.0])
def test_similar_terms_equal_brute_force(spark, threshold):
    rng = random.Random(6)
    base = ["diabetes", "diabetic foot", "hypertension", "hypotension", "alcohol use", "alcohol abuse", "a", "ab", "été chaud", "foot"]
    terms = {b: f"C{n:07d}" for n, b in enumerate(base)} | {"".join(rng.choice("abco") for _ in range(6)): "C9" for _ in range(30)}

    def altered(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice(["", "x", s[i] * 2]) + s[i + 1 :]

    strings = {altered(b) for b in list(terms) for _ in range(3)} | set(base)
    strings = {" ".join(s.split()) for s in strings if s.strip()}  # tokens are joined by one blank
    want = {}
    for s in strings:
        near = [(-round(len(grams(s) & grams(t)) / len(grams(s) | grams(t)), 9), cui, t) for t, cui in terms.items()]
        best = min(n for n in near)
        if -best[0] >= threshold:
            want[s] = (best[1], best[2], -best[0])
    dictionary = spark.createDataFrame([(t, c) for t, c in terms.items()], "term string, cui string")
    asked = spark.createDataFrame([(s,) for s in strings] * 2, "term string")
    got = {r["term"]: (r["cui"], r["found"], r["similarity"]) for r in concepts.similar_terms(asked, dictionary, threshold).collect()}
    assert got == want and len(want) > 5


def test_similar_spans_do_not_overlap(spark):
    terms = spark.createDataFrame([("alcohol abuse", "C1"), ("abuse", "C2"), ("tobacco", "C3")], "term string, cui string")
    docs = spark.createDataFrame([(1, "history of alcohol abusse and tobaco use"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["length"], r["cui"]) for r in concepts.tag_fuzzy(docs, terms, 2, 0.6).collect()]
    assert sorted(got) == [(1, 3, 2, "C1"), (1, 6, 1, "C3")]
    assert Counter(c for *_, c in got) == {"C1": 1, "C3": 1}


def test_blocks_are_exchanged_once_however_many_meet(spark, monkeypatch):
    """Every vector goes into one block that is written; blocks meet without an exchange of copies."""
    for name, value in {"FEW_MEETINGS": 0, "BLOCK_TEXTS": 10, "BLOCKS_PER_TASK": 3}.items():
        monkeypatch.setattr(sparse_neighbours, name, value)
    rng = random.Random(4)
    docs = {d: {f"t{rng.randint(0, 30)}": rng.random() + 0.1 for _ in range(6)} for d in range(120)}
    rows = [(0, d, list(v), list(v.values())) for d, v in docs.items()]
    q = spark.createDataFrame(rows, "run int, query_id long, term array<string>, w array<double>")
    i = spark.createDataFrame(rows, "run int, item_id long, term array<string>, w array<double>")
    found = sparse_neighbours.block_nearest(q, i, 3)
    chosen = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in chosen and "CoGroup" not in chosen
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["item_id"]
    dot = lambda a, b: round(sum(x * docs[b].get(t, 0) for t, x in docs[a].items()), 9)
    want = {a: [b for s, b in sorted((-dot(a, b), b) for b in docs if b != a and dot(a, b) > 0)[:3]] for a in docs}
    assert {a: [v[r] for r in sorted(v)] for a, v in got.items()} == want

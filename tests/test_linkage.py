import random

from pyspark.sql import functions as F

from notemill.operators import linkage


def frames(spark, patients, diagnosis):
    p = spark.createDataFrame(patients, "patient_id string, patient_name string")
    d = spark.createDataFrame(
        [(i, n, last, first) for n, (i, last, first) in enumerate(diagnosis)],
        "diag_id string, diag_seq long, last_name string, first_name string",
    )
    return p, d


def test_tiers(spark):
    p, d = frames(
        spark,
        [("12345", "Doe,Jane"), ("0012345", "Doe,Jane"), ("X99", "Roe,Rex"), ("123456789", "Poe,Pat")],
        [("12345", "Doe", "Jane"), ("1234567890", "Poe", "Pat")],
    )
    links = {r["patient_id"]: (r["diag_id"], r["tier"]) for r in linkage.link(p, d).collect()}
    assert links == {
        "12345": ("12345", "exact"),
        "0012345": ("12345", "padded"),
        "123456789": ("1234567890", "fuzzy"),
    }
    assert [r["patient_id"] for r in linkage.unmatched(p, linkage.link(p, d)).collect()] == ["X99"]


def test_first_diagnosis_wins(spark):
    p, d = frames(spark, [("00012", "a,b")], [("012", "a", "b"), ("12", "a", "b")])
    assert linkage.link(p, d).first()["diag_id"] == "012"


def brute_force(patients, diagnosis):
    def clean(s):
        return "".join(c if c.isalnum() or c == "_" else " " for c in s.lower()).strip()

    out = set()
    for pid, pname in patients:
        for did, last, first in diagnosis:
            ids = linkage.weighted_ratio(clean(pid), clean(did))
            names = linkage.weighted_ratio(clean(pname), clean(f"{last},{first}"))
            if ids >= linkage.MIN_ID_SCORE and names >= linkage.MIN_NAME_SCORE:
                out.add((pid, did))
    return out


def test_fuzzy_pairs_equal_brute_force(spark):
    random.seed(7)

    def ident():
        parts = ["".join(random.choice("012") for _ in range(random.choice([4, 9, 10, 19, 20]))) for _ in range(random.choice([1, 1, 2]))]
        return random.choice(["-", " ", "/"]).join(parts)

    def alter(s):
        kind = random.randrange(6)
        i = random.randrange(len(s))
        if kind == 0:
            return s[:i] + s[i + 1 :]
        if kind == 1:
            return s[:i] + random.choice("012") + s[i:]
        if kind == 2:
            return " ".join(reversed(s.replace("-", " ").replace("/", " ").split()))
        if kind == 3:
            return s + " 9"
        if kind == 4:
            return s[:i] + "1" + s[i + 1 :]
        return s

    diagnosis = list({ident(): ("Name" + str(i % 5), "First") for i in range(60)}.items())
    diagnosis = [(i, a, b) for i, (a, b) in diagnosis]
    patients = list({alter(i) or "x": f"{a},{b}" for i, a, b in diagnosis for _ in range(2)}.items())
    p, d = frames(spark, patients, diagnosis)
    got = {(r["patient_id"], r["diag_id"]) for r in linkage.fuzzy_links(p, d).collect()}
    want = brute_force(patients, diagnosis)
    assert len(want) > 30
    assert got == want


def test_long_ids_meet_by_segments(spark):
    """Forty characters allow four edits; shared prefixes and suffixes make no candidates."""
    rng = random.Random(3)
    base = ["prefix" + "".join(rng.choice("0123456789") for _ in range(28)) + "suffix" for _ in range(40)]

    def altered(s, edits):
        for _ in range(edits):
            i = rng.randrange(len(s))
            s = s[:i] + s[i + 1 :] if rng.random() < 0.5 else s[:i] + rng.choice("0123456789") + s[i:]
        return s

    patients = [(altered(s, i % 7), "a,b") for i, s in enumerate(base)]
    p, d = frames(spark, patients, [(s, "a", "b") for s in base])
    got = {(r["patient_id"], r["diag_id"]) for r in linkage.fuzzy_links(p, d).collect()}
    want = brute_force(patients, [(s, "a", "b") for s in base])
    assert got == want and len(want) >= 20
    assert linkage.fuzzy_candidates(p, d).count() <= 2 * len(base)


def test_keys_grow_slowly_with_the_length(spark):
    ids = spark.createDataFrame([("7" * n,) for n in (8, 16, 24, 40)], "_p string")
    varied = ids.select(F.transform(F.sequence(F.lit(1), F.length("_p")), lambda i: F.char(F.lit(64) + i)).alias("c")).select(F.array_join("c", "").alias("_p"))
    counts = {len(r["_p"]): r["count"] for r in linkage.shifted_keys(varied).groupBy("_p").count().collect()}
    assert counts[8] == 1 and counts[16] <= 25 and counts[40] < 2500


def test_long_ids_meet_on_their_rarest_token(spark):
    long_id = " ".join(f"t{i:02d}x" for i in range(10))
    p, d = frames(spark, [(" ".join(f"t{i:02d}x" for i in range(9)), "a,b")], [(long_id, "a", "b"), ("t00x zz", "a", "b")])
    assert [r["diag_id"] for r in linkage.fuzzy_links(p, d).collect()] == [long_id]


def test_feature_lookup_keeps_documents_without_a_row(spark):
    docs = spark.createDataFrame([("0012.txt", "x"), ("7.txt", "y")], "doc_id string, text string")
    rows = spark.createDataFrame([("12", 1)], "mrn string, gender int")
    got = {r["doc_id"]: r["gender"] for r in linkage.feature_lookup(docs, rows).collect()}
    assert got == {"0012.txt": 1, "7.txt": None}

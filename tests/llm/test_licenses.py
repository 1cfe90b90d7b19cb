"""License scans against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from notemill.llm import licenses


def brute(rows, threshold=licenses.THRESHOLD):
    tokens = lambda t: re.findall(licenses.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    templates = sorted((n, tokens(t)) for n, t in licenses.TEMPLATES)
    vocabulary = {t for _, ts in templates for t in ts}
    df = {t: sum(t in tokens(x) for _, x in rows) for t in vocabulary}
    idf = lambda t: math.log((1 + len(rows)) / (1 + df.get(t, 0))) + 1
    vec = lambda ts: {t: ts.count(t) * idf(t) for t in ts}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))

    def best(text, path):
        out = None
        units = (text or "").split("\n") + ([text] if path and re.search(licenses.LICENSE_FILE, path) and text else [])
        for u in units:
            v = vec(tokens(u))
            for name, ts in templates:
                w = vec(ts)
                c = round(sum(v.get(t, 0) * w[t] for t in w) / (norm(v) * norm(w)), 6) if v else 0
                if c >= threshold and (out is None or (-c, name) < out):
                    out = (-c, name)
        return out

    given = {}
    for path, text in rows:
        b = best(text, path)
        if b and path and re.search(licenses.LICENSE_FILE, path):
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (b[0], path, b[1])), (b[0], path, b[1]))
    out = []
    for path, text in rows:
        b = best(text, path)
        if b:
            out.append((path, b[1], -b[0], "header", None))
            continue
        d = path.rpartition("/")[0] if path is not None else None
        while d is not None:
            if d in given:
                out.append((path, given[d][2], -given[d][0], "inherited", d))
                break
            d = None if d == "" else d.rpartition("/")[0]
        else:
            out.append((path, None, None, None, None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, license string").repartition(3)
    out = licenses.scan_licenses(df).collect()
    return sorted(((r["path"], r["license"], r["cosine"], r["origin"], r["licensed_by"]) for r in out), key=repr)


def test_against_plain_python(spark):
    mit, gpl, apache = "Released under the MIT License.", "this WORK is licensed under the GNU general public license, version 3", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("a/LICENSE", f"{mit}\nmore"), ("a/b/c/x.txt", "plain words\nand lines"), ("a/b/LICENSE", "no notice here"), ("a/b/c/d/COPYING.md", gpl),
        ("a/b/c/d/e/f.txt", None), ("a/y.txt", "text\n" + apache + "\nrest"), ("z/q.txt", "the license of this work"), ("LICENSE", "Licensed under CC BY-NC 4.0."),
        ("z/w/r.txt", ""), ("top.txt", "x"), (None, mit), (None, "x"), ("a/b2/LICENCE.txt", "nothing"), ("m/LICENSE", apache), ("m/COPYING", mit), ("m/n/o.txt", "the " * 30000 + "mit"),
        ("a/y.txt", "Released under the MIT license. extra words follow the notice"), ("k/one.txt", "under the MIT License"),
    ]
    rows += [rows[1], rows[5]] + [(f"deep/{i}/x{j}.txt", "some under the license") for i in range(3) for j in range(5)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[("a/b", None)], [(None, None), ("", "Released under the MIT License.")]])
def test_odd_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_headers(spark):
    gnu = licenses.GNU.format("GNU General Public License", "3").split()
    rows = [
        ("a/x.py", "# some program\n# Licensed under the Apache\n# License, Version 2.0\nimport os\n" + "x = y + z\n" * 30),
        ("a/y.c", "/* This work is licensed under a Creative Commons\n *\n * Attribution 4.0 International License. */\nint main"),
        ("a/z.h", "int a;\n// " + " ".join(gnu[:16]) + "\n// " + " ".join(gnu[16:32]) + "\n// " + " ".join(gnu[32:]) + "\nint b;"),
        ("a/w.h", "other words\n" + "\n".join(gnu) + "\nand more"),
        ("a/v.txt", "Licensed under\nother terms of use"),
    ] + [(f"b/{i}", f"the words of file {i} are under\nthe desk and this is all") for i in range(30)]
    got = {p: (name, origin) for p, name, _, origin, _ in run(spark, rows)}
    want = {"a/x.py": "Apache-2.0", "a/y.c": "CC-BY-4.0", "a/z.h": "GPL-3.0", "a/w.h": "GPL-3.0"}
    assert {p: n for p, (n, o) in got.items() if o == "header"} == want


def test_a_long_block_is_judged_like_a_short_one(spark):
    """The cosine does not depend on how often all words are repeated."""
    rows = [(f"a/{n}.txt", "x y\n" + "Released under the " * n + "\n" + "MIT License. " * n + "\nz") for n in (1, 5, 40, 400)]
    rows += [(f"b/{i}", f"the words of file {i} are under\nthe desk and this is all") for i in range(30)]
    got = {p: (name, cosine) for p, name, cosine, _, _ in run(spark, rows)}
    assert {got[f"a/{n}.txt"] for n in (1, 5, 40, 400)} == {("MIT", 1.0)}


def test_texts_of_licenses(spark):
    bodies = dict(licenses.license_texts())
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MIT", "MPL-2.0"} <= set(bodies)
    rows = [(f"{name}/LICENSE", "Copyright 2020 A. Holder\n" + body[len(body) // 50 :]) for name, body in bodies.items()]
    rows += [(f"{name}/src/x.txt", "no notice") for name in bodies] + [("other/LICENSE", "you may do with these files what you want")]
    got = {p: (name, origin) for p, name, _, origin, _ in run(spark, rows)}
    assert {p: n for p, (n, o) in got.items() if o == "header"} == {f"{n}/LICENSE": n for n in bodies}
    assert all(got[f"{n}/src/x.txt"] == (n, "inherited") for n in bodies)


def test_a_file_is_lowered_once_for_its_notices(spark, monkeypatch):
    """And once more if it is a licence file; each use of the text used to do that again, and to search it again."""
    kept, lowered, cut = [], licenses.lowered, licenses.cut
    monkeypatch.setattr(licenses, "lowered", lambda c: F.reverse(F.reverse(lowered(c))))
    monkeypatch.setattr(licenses, "cut", lambda df: kept.append(df) or cut(df))
    assert run(spark, [("a/LICENSE", "Released under the MIT License."), ("a/b.txt", "x")])[1][1:4] == ("MIT", 1.0, "inherited")
    plan = kept[0]._jdf.queryExecution().analyzed().toString()
    assert plan.count("reverse(reverse(") == 2


def test_pattern_of_terms_finds_them_in_any_case():
    terms = ["2", "2.0", "mit", "gnu", "general"]
    java = licenses.holding(terms)
    for text in ["(MIT)", "v. 2.0,", "x\ngnu", "mit", "2", "GENERAL\n", "a-2.0-b", "smit mit2 mitx 12 gnul", "2.01", "", "generally", "éMITé"]:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        old = re.search(r"(^|[^a-z0-9])(" + "|".join(t.replace(".", r"\.") for t in terms) + ")($|[^a-z0-9])", lower)
        assert bool(re.search(java, text)) == bool(old), text


def test_only_a_to_z_become_letters_of_terms(spark):
    rows = [("a/x", "Released under the MİT License."), ("a/y", "Released under the MITK License."), ("a/z", "ÉMIT RELEASED under THE license")]
    rows += [(f"b/{i}", f"words of file {i} under the desk") for i in range(30)]
    assert run(spark, rows) == brute(rows)

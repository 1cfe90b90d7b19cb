"""License scans with column expressions only: sparse TF-IDF cosine to templates, then inheritance by path.

Every line of a file is a candidate header, and so is every block of consecutive lines, so that a header may
be wrapped; the whole text of a licence file is one more. A candidate's vector holds term frequency times inverse document frequency; the best template at or above ``threshold``
names the licence. Files without a header of their own take the licence of the nearest ancestor
directory (their own first) that holds a licence file.

* Document frequencies count all files, for the terms of the templates; a term outside them weighs as
  one that no file holds, so no table of all terms is needed.
* Lines without a term are left out of blocks, and comment marks are no terms. A block is at most as many
  lines as the longest notice has terms, however long these are. Its dot products and a lower bound of its
  norm are sums over its lines; only blocks that can reach the threshold by these are judged.
* The whole text of a licence file is also compared with the licences' own texts (``license_texts``), if it
  holds as many of a text's terms as the threshold takes at least.
* A line can only reach the threshold if it shares one of a template's heaviest terms, those without
  which the rest of the template stays below it. One pattern of these terms finds all candidate files and lines;
  nothing that could match is left out; a block lies around such a line. All further work stays inside the row.
* Directories are joined, not files: distinct directories meet their ancestors, and the files look their
  directory up through the join that spreads hot keys.

Defined cases: a null or empty text has no header. A null path has no directory, so nothing is inherited.
Of several licence files of one directory the closest counts, then the smallest path; of equally close
templates the smallest name. Repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache, reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import let
from notemill.scale import cut, lookup_join

GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
# Notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("AGPL-3.0", GNU.format("GNU Affero General Public License", "3")),
    ("GPL-2.0", GNU.format("GNU General Public License", "2")),
    ("GPL-3.0", GNU.format("GNU General Public License", "3")),
    ("LGPL-2.1", GNU.format("GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", GNU.format("GNU Lesser General Public License", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
THRESHOLD = 0.8
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(^|/)(LICENSE|LICENCE|COPYING)(\.[A-Za-z]+)?$"
NOT_LOWERED = "\u212a\u0130"  # the Kelvin sign, and I with a dot
MADE = ("license", "cosine", "origin", "licensed_by")


@cache
def license_texts() -> tuple[tuple[str, str], ...]:
    """(name, body) of the licences whose own texts the package holds."""
    files = (resources.files("notemill.llm") / "license_texts").iterdir()
    return tuple(sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files if f.name.endswith(".txt")))


def lowered(text: Column) -> Column:
    """A-Z lower-cased; the only other letters that would become a-z are no letters of a term."""
    return F.lower(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), NOT_LOWERED, text))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))


def template_terms(spark, templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    rows = spark.createDataFrame(list(templates), "name string, body string")
    return sorted((r["name"], r["t"]) for r in rows.select("name", terms_of(lowered(F.col("body"))).alias("t")).collect())


def term_weights(files: DataFrame, text: str, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template term, and that of a term which no file holds."""
    held = files.select(F.explode(F.array_distinct(terms_of(lowered(F.col(text))))).alias("term")).where(F.col("term").isin(vocabulary))
    # One row per template term reaches the driver, and the number of files.
    counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    files_in_all = files.count()
    idf = lambda df: math.log((1 + files_in_all) / (1 + df)) + 1
    return {t: idf(counts.get(t, 0)) for t in vocabulary}, idf(0)


def vectors(templates: list[tuple[str, list[str]]], idf: dict[str, float]) -> list[tuple[str, dict[str, float], float]]:
    """(name, weights, norm) of each template."""
    out = []
    for name, terms in templates:
        weights = {t: terms.count(t) * idf[t] for t in sorted(set(terms))}
        out.append((name, weights, math.sqrt(sum(w * w for w in weights.values()))))
    return out


def heavy_terms(templates: list[tuple[str, dict[str, float], float]], threshold: float) -> list[str]:
    """Terms of which a line must hold one: without them a cosine stays below the threshold."""
    out: set[str] = set()
    for _, weights, norm in templates:
        rest = norm * norm
        for term in sorted(weights, key=lambda t: (-weights[t], t)):
            if math.sqrt(max(rest, 0.0)) < 0.999 * threshold * norm:
                break
            out.add(term)
            rest -= weights[term] ** 2
    return sorted(out)


def holding(terms: Sequence[str]) -> str:
    """A pattern of texts, lower-cased or not, that hold one of the terms; by first letters, as most words have none of them."""
    by_first: dict[str, list[str]] = {}
    for t in terms:
        by_first.setdefault(t[0], []).append(t[1:].replace(".", r"\."))
    first = "".join(by_first)
    any_of = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items())
    return f"(?<![a-z0-9A-Z])(?=[{first}{first.upper()}])(?i:{any_of})(?![a-z0-9A-Z])"


def best_template(
    line: Column, templates: list[tuple[str, dict[str, float], float]], idf: dict[str, float], unknown: float, threshold: float
) -> Column:
    """struct(cosine, name) of the closest template of a line, null below the threshold."""
    return let(terms_of(line), lambda terms: closest(terms, templates, idf, unknown, threshold))


def literal_terms(terms: Sequence[str]) -> Column:
    return F.split(F.lit(" ".join(terms)), " ")


def literal_map(values: dict[str, float]) -> Column:
    return F.map_from_arrays(
        literal_terms(list(values)), F.split(F.lit(" ".join(map(repr, values.values()))), " ").cast("array<double>")
    )


def squares(terms: Column, known: Column, idf: dict[str, float], unknown: float) -> Column:
    """Squared weights of the terms, each occurrence counted once: at most the squared norm."""
    weight = literal_map({t: w * w for t, w in idf.items()})
    others = (F.size(terms) - F.size(known)) * F.lit(unknown * unknown)
    return F.aggregate(known, others, lambda a, t: a + F.element_at(weight, t))


def known_terms(terms: Column, idf: dict[str, float]) -> Column:
    """The terms that a template holds; most words are found by their hash not to be among them."""
    return F.filter(terms, lambda t: t.isin(list(idf)))


def dot(terms: Column, weights: dict[str, float], idf: dict[str, float]) -> Column:
    own = literal_map({t: w * idf[t] for t, w in weights.items()})
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(own, t), F.lit(0.0)))


def closest(
    terms: Column, templates: list[tuple[str, dict[str, float], float]], idf: dict[str, float], unknown: float, threshold: float
) -> Column:
    weight = literal_map(idf)
    of = lambda t: F.coalesce(F.element_at(weight, t), F.lit(unknown))
    zero = F.lit(0.0)

    def closeness(both: Column, norm: Column, place: int, name: str) -> Column:
        cosine = F.round(both["products"][place] / norm, 6)
        return F.when(cosine >= threshold, F.struct((-cosine).alias("order"), F.lit(name).alias("name")))

    exact = F.sqrt(
        F.aggregate(
            F.transform(F.array_distinct(terms), lambda t: F.size(F.filter(terms, lambda u: u == t)) * of(t)),
            zero,
            lambda a, w: a + w * w,
        )
    )
    # Counting every occurrence once gives a lower bound of the norm, and spares long lines.
    def sums(known: Column) -> Column:
        products = F.array(*[dot(known, weights, idf) / size for _, weights, size in templates])
        return F.struct(F.sqrt(squares(terms, known, idf, unknown)).alias("low"), products.alias("products"))

    def tests(both: Column) -> Column:
        near = F.array_max(both["products"]) >= both["low"] * (threshold - 1e-9)
        return F.when(near, let(exact, lambda norm: F.array_min(F.array(*[closeness(both, norm, i, t[0]) for i, t in enumerate(templates)]))))

    return let(let(known_terms(terms, idf), sums), tests)


def header_blocks(
    whole: Column,
    pattern: str,
    templates: list[tuple[str, dict[str, float], float]],
    longest: int,
    idf: dict[str, float],
    unknown: float,
    threshold: float,
) -> Column:
    """The blocks of two lines or more around a line with ``pattern`` that can reach the threshold."""
    one, none = F.lit(1), F.array().cast("array<string>")
    no_dots = F.array(*[F.lit(0.0) for _ in templates])

    def measured(line: Column) -> Column:
        sums = lambda terms, known: F.struct(
            squares(terms, known, idf, unknown).alias("low"),
            F.when(F.size(known) == 0, no_dots).otherwise(F.array(*[dot(known, weights, idf) / size for _, weights, size in templates])).alias("dots"),
        )
        return let(terms_of(line), lambda terms: let(known_terms(terms, idf), lambda known: sums(terms, known)))

    def possible(held: Column, start: Column) -> Column:
        """Whether a block of two lines or more from ``start`` on could reach the threshold if one template had all dot products."""
        zero = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("most"), F.lit(0).alias("lines"), F.lit(False).alias("near"))

        def longer(a: Column, line: Column) -> Column:
            new = F.struct((a["low"] + line["low"]).alias("low"), (a["most"] + F.array_max(line["dots"])).alias("most"), (a["lines"] + 1).alias("lines"))
            near = lambda b: (b["lines"] > 1) & (b["most"] >= F.sqrt(b["low"]) * (threshold - 2e-9))
            return let(new, lambda b: F.struct(b["low"], b["most"], b["lines"], (a["near"] | near(b)).alias("near")))

        return F.aggregate(F.slice(held, start, longest), zero, longer)["near"]

    def ends(held: Column, start: Column) -> Column:
        """Numbers of lines, two or more, of the blocks from ``start`` on that can reach the threshold."""
        zero = F.struct(
            F.lit(0.0).alias("low"), no_dots.alias("dots"),
            F.lit(0).alias("lines"), F.array().cast("array<int>").alias("ends"),
        )

        def longer(a: Column, line: Column) -> Column:
            new = F.struct(
                (a["low"] + line["low"]).alias("low"), F.zip_with(a["dots"], line["dots"], lambda x, y: x + y).alias("dots"),
                (a["lines"] + 1).alias("lines"), a["ends"].alias("ends"),
            )
            near = lambda b: (b["lines"] > 1) & (F.array_max(b["dots"]) >= F.sqrt(b["low"]) * (threshold - 1e-9))
            grown = lambda b: F.when(near(b), F.concat(b["ends"], F.array(b["lines"]))).otherwise(b["ends"])
            return let(new, lambda b: b.withField("ends", grown(b)))

        return F.aggregate(F.slice(held, start, longest), zero, longer)["ends"]

    def around(lines: Column, hits: Column) -> Column:
        span = lambda low, high: F.sequence(F.greatest(low, one), F.least(high, F.size(lines)))
        near = F.array_distinct(F.flatten(F.transform(hits, lambda h: span(h - (longest - 1), h + (longest - 1)))))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: span(h - (longest - 1), h))))

        def blocks(held: Column) -> Column:
            # A first line without a term of any template only adds to the norm.
            useful = F.filter(starts, lambda i: F.coalesce(F.array_max(F.element_at(held, i)["dots"]) > 0, F.lit(False)))
            useful = F.filter(useful, lambda i: possible(held, i))
            texts = lambda i: F.transform(ends(held, i), lambda n: F.array_join(F.slice(lines, i, n), "\n"))
            return F.flatten(F.transform(useful, texts))

        held = let(near, lambda kept: F.transform(lines, lambda x, i: F.when(F.array_contains(kept, i + 1), measured(x))))
        return let(held, blocks)

    def of_lines(lines: Column) -> Column:
        hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
        return let(hits, lambda h: F.when((F.size(h) > 0) & (F.size(lines) > 1), around(lines, h)).otherwise(none))

    written = F.filter(F.split(whole, "\n"), lambda line: line.rlike("[a-z0-9]"))
    return let(written, of_lines)


def own_text(
    whole: Column, texts: list[tuple[str, dict[str, float], float]], idf: dict[str, float], unknown: float, threshold: float
) -> Column:
    """struct(order, name) of the licence whose own text is closest to a whole file, null below the threshold."""

    def least(weights: dict[str, float], size: float) -> int:
        # The terms of a text that a file holds must carry the threshold's part of its norm.
        left, n = (0.999 * threshold * size) ** 2, 0
        for w in sorted(weights.values(), reverse=True):
            if left <= 0:
                break
            left, n = left - w * w, n + 1
        return n

    least_of = [least(weights, size) for _, weights, size in texts]
    of_any = sorted({t for _, weights, _ in texts for t in weights})

    def judged(terms: Column) -> Column:
        held = lambda weights: F.size(F.array_intersect(terms, literal_terms(list(weights))))
        any_possible = reduce(or_, [held(weights) >= n for (_, weights, _), n in zip(texts, least_of, strict=True)])
        # Few files hold as many terms of all texts together as one text takes.
        enough = F.size(F.filter(F.array_distinct(terms), lambda t: t.isin(of_any))) >= min(least_of)
        return F.when(enough, F.when(any_possible, closest(terms, texts, idf, unknown, threshold)))

    return let(terms_of(whole), judged)


def scan_licenses(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    texts: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """``files`` with license, cosine, origin (header, inherited or null) and licensed_by (a directory).

    ``texts`` are (name, body) of whole licences for licence files, those of the package if not given.
    """
    spark = files.sparkSession
    terms = template_terms(spark, templates)
    bodies = template_terms(spark, license_texts() if texts is None else texts)
    all_idf, unknown = term_weights(files, text, sorted({t for _, own in terms + bodies for t in own}))
    idf = {t: all_idf[t] for t in sorted({t for _, own in terms for t in own})}
    known, whole_texts = vectors(terms, idf), vectors(bodies, all_idf)
    longest = max(len(own) for _, own in terms)
    pattern = holding(heavy_terms(known, threshold))
    raw = F.coalesce(F.col(text), F.lit(""))
    is_license_file = F.coalesce(F.col(path).rlike(LICENSE_FILE), F.lit(False))

    def headers(whole: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(pattern))
        lines = F.concat(lines, header_blocks(whole, pattern, known, longest, idf, unknown, threshold))
        lines = F.concat(lines, F.when(is_license_file, F.array(whole)).otherwise(F.array().cast("array<string>")))
        return F.array_min(F.transform(lines, lambda line: best_template(line, known, idf, unknown, threshold)))

    # A file without such a term is read once, by the pattern; the others are lower-cased once.
    best = F.when(raw.rlike(pattern), let(lowered(raw), headers))
    if whole_texts:
        best = F.array_min(F.array(best, F.when(is_license_file, own_text(lowered(raw), whole_texts, all_idf, unknown, threshold))))
    judged = files.select(
        F.struct(*[F.col(f"`{c}`") for c in files.columns if c not in MADE and c != text]).alias("_row"),
        F.col(path).alias("_path"),
        F.regexp_replace(F.col(path), r"/?[^/]*$", "").alias("_dir"),
        is_license_file.alias("_is_license_file"),
        best.alias("_best"),
    )
    # Written once, without texts: the join's counts, the directories and the files all read it.
    own = cut(judged)
    licensed = nearest_license(own)
    found = lookup_join(own, licensed, "_dir", ["_path"])
    header = F.col("_best").isNotNull()
    return found.select(
        "_row.*",
        F.when(header, F.col("_best.name")).otherwise(F.col("_license")).alias("license"),
        F.when(header, -F.col("_best.order")).otherwise(F.col("_cosine")).alias("cosine"),
        F.when(header, "header").when(F.col("_license").isNotNull(), "inherited").alias("origin"),
        F.when(~header, F.col("_from")).alias("licensed_by"),
    )


def nearest_license(own: DataFrame) -> DataFrame:
    """(_dir, _license, _cosine, _from): for every directory the licence of its nearest licensed ancestor."""
    first = F.min(F.struct("_best.order", "_path", "_best.name"))
    given = (
        own.where(F.col("_is_license_file") & F.col("_best").isNotNull())
        .groupBy(F.col("_dir").alias("_from"))
        .agg(first.alias("_first"))
        .select("_from", F.col("_first.name").alias("_license"), (-F.col("_first.order")).alias("_cosine"))
    )
    parts = F.split("_dir", "/")
    directories = own.where("_dir is not null").select("_dir").distinct()
    ancestors = directories.select(
        "_dir",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
        ).alias("a"),
    ).select("_dir", "a.depth", "a.up").where("_dir <> '' or depth = 0")
    nearest = F.max_by(F.struct("_license", "_cosine", "_from"), "depth")
    return (
        ancestors.join(given, F.col("up") == F.col("_from")).groupBy("_dir").agg(nearest.alias("n")).select("_dir", "n.*")
    )

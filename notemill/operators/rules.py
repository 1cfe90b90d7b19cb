"""Rule classifier: pattern statistics per class, scores from them, and mined patterns."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.functions.text import flat_unique_lines, sentences, words
from notemill.operators.vectors import bag, term_lookup
from notemill.scale import cut, hashed_rank
from notemill.sources.scans import read_list

Rules = Sequence[str]


def load_rules(spark: SparkSession, source: str | Rules) -> list[str]:
    """Rules from a ``.txt`` or ``.json`` file, or as given. A rule list is a parameter, not data."""
    if not isinstance(source, str):
        return list(source)
    return [r["item"] for r in read_list(spark, source).orderBy("pos").collect() if r["item"]]


def rule_hits(text: Column, rules: Rules) -> Column:
    """Array of (rule, hits), one entry per rule, computed inside the document's row."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"), F.regexp_count(text, F.lit(r)).cast("long").alias("hits")
            )
            for i, r in enumerate(rules)
        ]
    )


def document_hits(docs: DataFrame, rules: Rules, text: Column | None = None) -> DataFrame:
    """(doc columns without text, rule, hits) for every rule and document."""
    rest = [c for c in docs.columns if c != "text"]
    hits = rule_hits(F.col("text") if text is None else text, rules)
    return docs.select(*rest, F.inline(hits))


def rule_stats(docs: DataFrame, rules: Rules) -> DataFrame:
    """Per rule: 1 + matches and 1 + matching documents, in positive and in negative documents."""
    matched = document_hits(docs, rules, flat_unique_lines(F.col("text")))
    hit = F.col("hits") > 0
    pos, neg = F.col("label") == 1, F.col("label") == 0
    return matched.groupBy("rule").agg(
        (F.lit(1) + F.coalesce(F.sum(F.when(pos, F.col("hits"))), F.lit(0))).alias("pos_hits"),
        (F.lit(1) + F.count_if(pos & hit)).alias("pos_docs"),
        (F.lit(1) + F.coalesce(F.sum(F.when(neg, F.col("hits"))), F.lit(0))).alias("neg_hits"),
        (F.lit(1) + F.count_if(neg & hit)).alias("neg_docs"),
    )


def rule_predict(docs: DataFrame, stats: DataFrame, rules: Rules) -> DataFrame:
    """Sum the hits-per-document ratios of the matching rules; 1 when positive beats negative.

    The statistics have one row per rule, so they ride along as one small array; documents are
    scored in their own rows.
    """
    ratios = stats.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rule",
                    (F.col("pos_hits") / F.col("pos_docs")).alias("pos"),
                    (F.col("neg_hits") / F.col("neg_docs")).alias("neg"),
                )
            )
        )
    ).scalar()
    matching = F.transform(
        F.filter(rule_hits(F.col("text"), rules), lambda h: h["hits"] > 0), lambda h: h["rule"]
    )

    def totals(hit: Column) -> Column:
        def add(acc: Column, r: Column) -> Column:
            found = F.array_contains(hit, r["rule"])
            return F.struct(
                (acc["pos"] + F.when(found, r["pos"]).otherwise(0.0)).alias("pos"),
                (acc["neg"] + F.when(found, r["neg"]).otherwise(0.0)).alias("neg"),
            )

        start = F.struct(F.lit(1.0).alias("pos"), F.lit(1.0).alias("neg"))
        return F.aggregate("_ratios", start, add)

    rest = [c for c in docs.columns if c != "text"]
    return (
        docs.withColumn("_ratios", ratios)
        .select(*rest, T.let(matching, totals).alias("_s"))
        .select(*rest, F.col("_s.pos").alias("pos_score"), F.col("_s.neg").alias("neg_score"))
        .withColumn("pred", (F.col("pos_score") / F.col("neg_score") > 1).cast("int"))
    )


def rule_threshold(docs: DataFrame, rules: Rules, threshold: int = 1) -> DataFrame:
    """1 when at least ``threshold`` rules match."""
    matching = F.lit(0)
    for r in rules:
        matching = matching + F.col("text").rlike(r).cast("int")
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, matching.alias("matching")).withColumn(
        "pred", (F.col("matching") >= threshold).cast("int")
    )


def predict_by(docs: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """Prediction by a callable on the text column."""
    return docs.withColumn("pred", rule(F.col("text")).cast("int"))


def skip_grams(text: Column, size: int = 2, gap: int = 1, distinct: bool = True) -> Column:
    """Ordered word combinations of a text's sentences, up to ``size`` words with at most ``gap``
    words between neighbours, as words joined by a line feed; each one once, or as often as it occurs."""
    if size < 1:
        raise ValueError("combinations have at least one word")
    flat = F.regexp_replace(text, "\n", " ")
    split = F.transform(sentences(flat), lambda s: F.filter(words(s), lambda w: w != ""))

    def combine(ws: Column) -> Column:
        found = [ws]
        for words_after in range(1, size):
            found += [_apart(ws, steps) for steps in itertools.product(range(1, gap + 2), repeat=words_after)]
        return F.concat(*found) if len(found) > 1 else found[0]

    found = F.flatten(F.transform(split, combine))
    return F.array_distinct(found) if distinct else found


def _apart(ws: Column, steps: tuple[int, ...]) -> Column:
    """Words at a start and at the given distances after it, for every start."""
    reach = sum(steps)
    starts = F.when(
        F.size(ws) > reach, F.sequence(F.lit(1), F.size(ws) - reach)
    ).otherwise(F.array().cast("array<int>"))

    def pick(i: Column) -> Column:
        offset, parts = 0, [F.element_at(ws, i)]
        for s in steps:
            offset += s
            parts.append(F.element_at(ws, i + offset))
        return F.concat_ws("\n", *parts)

    return F.transform(starts, pick)


def mine_rules(docs: DataFrame, size: int = 2, gap: int = 1, min_docs: int = 2) -> DataFrame:
    """Word combinations found in at least ``min_docs`` documents, with their class counts.

    Combinations are made distinct in each document's row and counted with partial aggregation;
    the number per sentence grows linearly with its length because size and gap are fixed.
    """
    found = docs.select("label", F.explode(skip_grams(F.col("text"), size, gap)).alias("combination"))
    return (
        found.groupBy("combination")
        .agg(
            F.count_if(F.col("label") == 1).alias("pos_docs"),
            F.count_if(F.col("label") == 0).alias("neg_docs"),
        )
        .where(F.col("pos_docs") + F.col("neg_docs") >= min_docs)
    )


def mined_predict(
    train: DataFrame, test: DataFrame, share: float = 1.0, seed: int = 0, size: int = 2, gap: int = 1, min_docs: int = 2
) -> DataFrame:
    """Rules mined from a stratified share of ``train``, weighed on all of it, applied to ``test``.

    A combination weighs its hits per matching document, one added to both counts, in each class; a
    document adds up the weights of its combinations and is 1 when the positive sum is larger. The
    statistics are joined to the combinations of each document, so thousands of rules cost a join and
    no pattern is searched. ``share`` bounds the labelled sample that rules come from.
    """
    drawn = hashed_rank(train.select("doc_id", "label"), "doc_id", seed, ["label"], "_rank", "_n")
    drawn = drawn.select("doc_id", (F.col("_rank") <= F.floor(F.col("_n") * share)).alias("drawn"))
    # Texts meet the draw: their combinations take many times the room.
    found = bag(skip_grams(F.col("text"), size, gap, False)).alias("bag")
    bags = train.join(drawn.hint("shuffle_hash"), "doc_id").select("label", "drawn", found)
    # Outer, lest Spark make the bags once more beneath the exchange of the texts, to see if they hold anything.
    hits = bags.select("label", "drawn", F.inline_outer("bag")).where("term IS NOT NULL")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    weights = (
        hits.groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.max("drawn").alias("drawn"),
            _weight(pos).alias("pos"),
            _weight(neg).alias("neg"),
        )
        .where(F.col("drawn") & (F.col("docs") >= min_docs))
        .select("term", "pos", "neg")
    )
    asked = test.select("doc_id", "label", F.explode_outer(skip_grams(F.col("text"), size, gap)).alias("term"))
    return (
        term_lookup(asked, cut(weights), ["doc_id"])
        .groupBy("doc_id", "label")
        .agg(
            (1.0 + F.coalesce(F.sum("pos"), F.lit(0.0))).alias("pos_score"),
            (1.0 + F.coalesce(F.sum("neg"), F.lit(0.0))).alias("neg_score"),
        )
        .withColumn("pred", (F.col("pos_score") / F.col("neg_score") > 1).cast("int"))
    )


def _weight(of_class: Column) -> Column:
    return (1 + F.coalesce(F.sum(F.when(of_class, F.col("tf"))), F.lit(0))) / (1 + F.count_if(of_class))


def combination_pattern(combination: Column, gap: int) -> Column:
    """Regular expression of a mined combination, its words quoted and up to ``gap`` words between."""
    quoted = F.transform(
        F.split(combination, "\n"), lambda w: F.regexp_replace(w, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    )
    between = r"[\s;.]+(?:[^\s;.]+[\s;.]+){0,%d}" % gap
    return F.array_join(quoted, between)

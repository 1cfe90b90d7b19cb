"""Round trips through files and saved models: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notemill.functions import features as X
from notemill.operators import rules, sampling, term_tables, vectors
from notemill.operators.vectors import TermOptions
from notemill.plans.base import CORPUS_SQL, corpus, documents, query, shuffle_sql, table, tokens_sql
from notemill.scale import shared_folder
from notemill.sources import scans, sinks

TERMS = TermOptions(min_df=5)


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _customers(spark, sf_dir):
    note = F.concat(F.lit('say "'), "c_name", F.lit('", '), "c_mktsegment", F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", note.alias("note"))


CUSTOMERS_SQL = """SELECT c_custkey, c_name, 'say "' || c_name || '", ' || c_mktsegment || ' ' AS note FROM customer"""


@query("csv_rows", CUSTOMERS_SQL)
def csv_rows(spark, sf_dir):
    """Quoted values without a header, read under a given schema."""
    path = folder(spark, "csv")
    _customers(spark, sf_dir).write.option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    return scans.read_csv(spark, path, "c_custkey long, c_name string, note string")


@query("report_rows", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def report_rows(spark, sf_dir):
    """A report with a header, read back as text."""
    path = folder(spark, "report")
    sinks.write_report(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("header", True).csv(path)


@query("json_rows", CUSTOMERS_SQL)
def json_rows(spark, sf_dir):
    path = folder(spark, "json")
    sinks.write_json(_customers(spark, sf_dir), path)
    return scans.read_json(spark, path, "c_custkey long, c_name string, note string", lines=True)


@query(
    "file_sizes",
    """SELECT lpad(CAST(d.doc_id AS VARCHAR), 7, '0') || '.txt' AS path, CAST(strlen(d.text) AS BIGINT) AS length
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def file_sizes(spark, sf_dir):
    """The inventory of a corpus written as files."""
    path = folder(spark, "files")
    sinks.write_text(corpus(spark, sf_dir).withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 7, "0")), path)
    return scans.file_inventory(spark, path, recurse=True, full_path=False).where("path LIKE '%.txt'")


@query("term_list", "SELECT DISTINCT c_mktsegment AS item FROM customer")
def term_list(spark, sf_dir):
    """A list of terms, one per line, written by one task because a list is a parameter."""
    path = folder(spark, "terms")
    items = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    joined = items.agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "\n").alias("value"))
    joined.coalesce(1).write.text(path)
    return scans.read_list(spark, path).where("item != ''").select("item")


@query(
    "saved_model",
    f"""
WITH {CORPUS_SQL}, tf AS (SELECT doc_id, unnest({tokens_sql()}) AS term FROM corpus),
voc AS (SELECT term FROM tf GROUP BY term HAVING count(DISTINCT doc_id) >= 5)
SELECT c.doc_id, CAST(count(voc.term) AS DOUBLE) AS n, count(DISTINCT voc.term) AS n_terms
FROM corpus c LEFT JOIN tf ON tf.doc_id = c.doc_id LEFT JOIN voc ON voc.term = tf.term GROUP BY c.doc_id""",
)
def saved_model(spark, sf_dir):
    """Counts by a vectoriser that was saved and loaded."""
    docs = corpus(spark, sf_dir)
    path = folder(spark, "model")
    sinks.save_model(vectors.preprocess(docs, "count", TERMS), path)
    counted = sinks.load_model(path).transform(vectors.prepare(docs, "count", TERMS))
    # Only the terms a text has; as an array, a vector would be as long as the vocabulary.
    held = F.unwrap_udt("features")["values"]
    return counted.select(
        "doc_id",
        F.aggregate(held, F.lit(0.0), lambda a, x: a + x).alias("n"),
        F.size(F.filter(held, lambda x: x > 0)).cast("long").alias("n_terms"),
    )


@query(
    "feature_list",
    f"""
WITH {CORPUS_SQL}, tf AS (SELECT doc_id, unnest({tokens_sql()}) AS term FROM corpus),
voc AS (SELECT term FROM tf GROUP BY term HAVING count(DISTINCT doc_id) >= 5)
SELECT term, (SELECT count(*) FROM voc) AS n FROM voc""",
)
def feature_list(spark, sf_dir):
    """The names of a fitted vectoriser's features; their numbers run from 0 without a gap."""
    docs = corpus(spark, sf_dir)
    model = vectors.preprocess(docs, "count", TERMS)
    names = sinks.feature_names(spark, model.stages[0])
    return names.select("term", F.lit(names.agg(F.max("index") + 1).scalar()).cast("long").alias("n"))


@query(
    "replaced_answers",
    """
SELECT conv_id, turn, md5(CASE lower(role) WHEN 'user' THEN 'BAC_YES' WHEN 'system' THEN 'BAC_NO' ELSE text END) AS content_md5
FROM conversations""",
)
def replaced_answers(spark, sf_dir):
    """A yes or no answer takes the place of the text."""
    said = F.when(F.lower("role") == "user", "Yes").when(F.lower("role") == "system", "no").otherwise(F.col("role"))
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.md5(X.bac_yes_no_only(F.col("text"), said)).alias("content_md5"))


USAGE = ("wine", "beer", "of"), ("day", "week", "the")


@query(
    "usage_texts",
    "SELECT doc_id, regexp_matches(text, '(wine)|(beer)|(of)') AND regexp_matches(text, '(day)|(week)|(the)') AS names_usage FROM documents",
)
def usage_texts(spark, sf_dir):
    """Texts that name a beverage and a frequency, by given word lists."""
    strengths, frequencies = ({w: 1.0 for w in words} for words in USAGE)
    gate = X.usage_gate(F.col("text"), X.ConsumptionRules(strengths=strengths, frequencies=frequencies))
    return documents(spark, sf_dir).select("doc_id", gate.alias("names_usage"))


@query(
    "callable_rule",
    f"WITH {CORPUS_SQL} SELECT doc_id, label, CAST(regexp_matches(text, 'the|der') AND length(text) > 500 AS INT) AS pred FROM corpus",
)
def callable_rule(spark, sf_dir):
    """A prediction rule given as a function of the text column."""
    return rules.predict_by(corpus(spark, sf_dir), lambda text: text.rlike("the|der") & (F.length(text) > 500)).select(
        "doc_id", "label", "pred"
    )


@query(
    "rules_of_a_file",
    f"""WITH {CORPUS_SQL}
SELECT doc_id, label, CAST(regexp_matches(text, 'qu') AS INT) + CAST(regexp_matches(text, 'the [a-z]+') AS INT) AS matching,
  CAST(CAST(regexp_matches(text, 'qu') AS INT) + CAST(regexp_matches(text, 'the [a-z]+') AS INT) >= 2 AS INT) AS pred FROM corpus""",
)
def rules_of_a_file(spark, sf_dir):
    """Rules read from a list file."""
    path = folder(spark, "rules")
    spark.createDataFrame([("qu\nthe [a-z]+",)], "value string").coalesce(1).write.text(path)
    return rules.rule_threshold(corpus(spark, sf_dir), rules.load_rules(spark, path), 2)


@query(
    "table_vectors",
    f"""
WITH {CORPUS_SQL},
h AS (SELECT *, row_number() OVER (ORDER BY {shuffle_sql(0)}) <= ceil(count(*) OVER () * 0.2) AS is_test FROM corpus),
tf AS (SELECT doc_id, is_test, term, count(*) AS tf FROM (SELECT doc_id, is_test, unnest({tokens_sql()}) AS term FROM h) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE NOT is_test GROUP BY term HAVING count(*) >= 2),
voc AS (SELECT term, df, row_number() OVER (ORDER BY md5('vocabulary|' || term), term) - 1 AS index FROM df),
w AS (SELECT doc_id, index, tf * (ln((1 + (SELECT count(*) FROM h WHERE NOT is_test)) / (1 + df)) + 1) AS w
      FROM tf JOIN voc USING (term) WHERE is_test)
SELECT h.doc_id, count(index) AS n, coalesce(CAST(sum(index) AS BIGINT), 0) AS index_sum,
  round(coalesce(sum(w) / sqrt(sum(w * w)), 0), 6) AS total FROM h LEFT JOIN w USING (doc_id) WHERE is_test GROUP BY h.doc_id""",
)
def table_vectors(spark, sf_dir):
    """Held-out texts as vectors of a vocabulary that was fitted, saved as a table and loaded."""
    split = sampling.holdout(corpus(spark, sf_dir), 0.2)
    path = folder(spark, "vocabulary")
    term_tables.fit(split.where("is_test = 0"), "tfidf", TermOptions(min_df=2)).save(path)
    test = term_tables.load(spark, path).transform(split.where("is_test = 1"))
    add = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return test.select(
        "doc_id",
        F.size("indices").cast("long").alias("n"),
        add("indices", F.lit(0).cast("long")).alias("index_sum"),
        F.round(add("values", F.lit(0.0)), 6).alias("total"),
    )

"""Cross-validation of the classifiers that read texts; each check repeats the learning per fold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notemill.operators import experiments, text_models
from notemill.operators.experiments import RunOptions
from notemill.plans.base import CORPUS_SQL, corpus, query, shuffle_sql
from notemill.plans.model_queries import ENTITY_SQL, RULES
from notemill.scale import shared_folder

FOLDS = 5
SIZE, NEAREST = 10, 5


def per_fold_sql(body: str) -> str:
    """``body`` over the tables train and test, once per fold."""
    folds = [
        f"""SELECT {k} AS fold, * FROM (
WITH {CORPUS_SQL},
f AS (SELECT *, ntile({FOLDS}) OVER (ORDER BY {shuffle_sql(0)}) - 1 AS fold FROM corpus),
train AS (SELECT doc_id, label, text FROM f WHERE fold <> {k}),
test AS (SELECT doc_id, label, text FROM f WHERE fold = {k}),
{body})"""
        for k in range(FOLDS)
    ]
    return "\nUNION ALL\n".join(folds)


SAMPLE_SQL = f"""
samp AS (SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER
   (PARTITION BY label ORDER BY {shuffle_sql(1)}) AS r FROM train) WHERE r <= {SIZE})"""

MAJORITY_SQL = """n AS (SELECT label, count(*) AS n FROM train GROUP BY label)
SELECT doc_id, label, (SELECT label FROM n ORDER BY n DESC, label LIMIT 1) AS pred FROM test"""

PRINT_SQL = f"""{ENTITY_SQL.format(source="corpus")}, {SAMPLE_SQL},
print AS (SELECT DISTINCT s.label, e.entity FROM samp s JOIN entity e USING (doc_id)),
o AS (SELECT e.doc_id, p.label, count(*) AS n FROM entity e JOIN print p USING (entity) GROUP BY e.doc_id, p.label),
a AS (SELECT c.doc_id, c.label, l.label AS candidate, coalesce(o.n, 0) AS n
      FROM test c CROSS JOIN (SELECT DISTINCT label FROM samp) l
      LEFT JOIN o ON o.doc_id = c.doc_id AND o.label = l.label),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, candidate) AS r FROM a)
SELECT doc_id, label, candidate AS pred FROM r WHERE r = 1"""

KNN_SQL = f"""{ENTITY_SQL.format(source="corpus")}, {SAMPLE_SQL},
size AS (SELECT doc_id, count(*) AS n FROM entity GROUP BY doc_id),
o AS (SELECT a.doc_id, b.doc_id AS sample_id, count(*) AS n FROM samp s JOIN entity b ON b.doc_id = s.doc_id
      JOIN entity a ON a.entity = b.entity GROUP BY a.doc_id, b.doc_id),
pair AS (SELECT c.doc_id, c.label, s.doc_id AS sample_id, s.label AS sample_label, x.n + y.n - 2 * coalesce(o.n, 0) AS distance
         FROM test c CROSS JOIN samp s JOIN size x ON x.doc_id = c.doc_id JOIN size y ON y.doc_id = s.doc_id
         LEFT JOIN o ON o.doc_id = c.doc_id AND o.sample_id = s.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, sample_id) AS r FROM pair),
v AS (SELECT doc_id, label, sample_label, count(*) AS n FROM r WHERE r <= {NEAREST} GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, sample_label) AS b FROM v)
SELECT doc_id, label, sample_label AS pred FROM b WHERE b = 1"""


def _hits(rule: int, pattern: str) -> str:
    return f"SELECT {rule} AS rule, c.label, len(regexp_extract_all(f.text, '{pattern}')) AS hits FROM flat f JOIN train c USING (doc_id)"


RULE_SQL = f"""
u AS (SELECT doc_id, line, min(pos) AS pos FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM train) GROUP BY doc_id, line),
flat AS (SELECT doc_id, string_agg(line, ' ' ORDER BY pos) AS text FROM u GROUP BY doc_id),
m AS ({" UNION ALL ".join(_hits(i, r) for i, r in enumerate(RULES))}),
stats AS (SELECT rule, 1 + coalesce(sum(hits) FILTER (label = 1), 0) AS pos_hits, 1 + count(*) FILTER (label = 1 AND hits > 0) AS pos_docs,
     1 + coalesce(sum(hits) FILTER (label = 0), 0) AS neg_hits, 1 + count(*) FILTER (label = 0 AND hits > 0) AS neg_docs FROM m GROUP BY rule),
h AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS rule FROM test WHERE regexp_matches(text, '{r}')" for i, r in enumerate(RULES))})
SELECT c.doc_id, c.label, CAST((1 + coalesce(sum(pos_hits / pos_docs), 0)) / (1 + coalesce(sum(neg_hits / neg_docs), 0)) > 1 AS INT) AS pred
FROM test c LEFT JOIN h ON h.doc_id = c.doc_id LEFT JOIN stats t ON t.rule = h.rule GROUP BY c.doc_id, c.label"""


def _cross_validated(spark, sf_dir, name, **params):
    found = text_models.cross_validate(corpus(spark, sf_dir), name, params, FOLDS)
    return found.select("fold", "doc_id", "label", "pred")


@query("majority_cv", per_fold_sql(MAJORITY_SQL))
def majority_cv(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "majority")


@query("print_cv", per_fold_sql(PRINT_SQL))
def print_cv(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "class_print", sample_size=SIZE)


@query("bit_knn_cv", per_fold_sql(KNN_SQL))
def bit_knn_cv(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "bit_knn", sample_size=SIZE, k=NEAREST)


@query("rule_cv", per_fold_sql(RULE_SQL))
def rule_cv(spark, sf_dir):
    return _cross_validated(spark, sf_dir, "rules", rules=RULES)


# --- records of a grid ---------------------------------------------------------------------------

RECORD_SQL = f"""
p AS (SELECT 0 AS seq, * FROM ({per_fold_sql(RULE_SQL)}) UNION ALL SELECT 1, * FROM ({per_fold_sql(MAJORITY_SQL)})),
c AS (SELECT seq, fold, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp,
   count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 0 AND label = 0) AS tn FROM p GROUP BY seq, fold),
f AS (SELECT seq, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS f1 FROM c GROUP BY seq),
best AS (SELECT seq FROM f WHERE f1 > 0 ORDER BY f1 DESC, seq LIMIT 1)"""


def _recorded_grid(spark, sf_dir):
    runs = [
        RunOptions("rules", FOLDS, "text", params={"rules": RULES}),
        RunOptions("majority", FOLDS, "text"),
    ]
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    return experiments.run_grid(corpus(spark, sf_dir), runs, record=folder), folder


@query("run_record", f"WITH {RECORD_SQL} SELECT * FROM c")
def run_record(spark, sf_dir):
    """Outcome counts per run and fold, read back from the record of a grid."""
    _, folder = _recorded_grid(spark, sf_dir)
    counts = experiments.recorded(spark, folder, "counts")
    return counts.select("seq", "fold", "tp", "fp", "fn", "tn")


@query(
    "run_export",
    f"WITH {RECORD_SQL} SELECT CAST(seq AS INT) AS seq, doc_id FROM p JOIN best USING (seq) WHERE pred <> label",
)
def run_export(spark, sf_dir):
    """Misses of the best run of a recorded grid."""
    runs, folder = _recorded_grid(spark, sf_dir)
    return experiments.export_best(spark, runs, folder)["misses"].select(F.col("seq").cast("int").alias("seq"), "doc_id")

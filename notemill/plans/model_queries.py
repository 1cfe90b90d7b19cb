"""Sampling, vectors, closed-form classifiers, neighbours and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill.operators import bayes, evaluate, neighbours, rules, sampling, vectors
from notemill.operators.corpus import trigger_lines
from notemill.operators.vectors import TermOptions
from notemill.plans.base import (
    CORPUS_SQL,
    corpus,
    documents,
    query,
    shuffle_sql,
    strip_sql,
    table,
    tokens_sql,
)

# --- order and samples -------------------------------------------------------------------------


@query(
    "kfold",
    f"""
SELECT doc_id, CAST(ntile(7) OVER (ORDER BY {shuffle_sql(3)}) - 1 AS INT) AS fold FROM documents""",
)
def kfold(spark, sf_dir):
    return sampling.kfold(table(spark, sf_dir, "documents").select("doc_id"), 7, seed=3)


@query(
    "holdout",
    f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {shuffle_sql(0)}) <= ceil(count(*) OVER () * 0.2) AS INT) AS is_test
FROM documents""",
)
def holdout(spark, sf_dir):
    return sampling.holdout(table(spark, sf_dir, "documents").select("doc_id"), 0.2)


@query(
    "percent_split",
    f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {shuffle_sql(1)}) > count(*) OVER () - ceil(count(*) OVER () * 25.0 / 100)
  AS INT) AS moved FROM documents""",
)
def percent_split(spark, sf_dir):
    return sampling.percent_split(table(spark, sf_dir, "documents").select("doc_id"), 25, seed=1)


@query(
    "ordered_percent_split",
    """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) > count(*) OVER () - ceil(count(*) OVER () * 30.0 / 100)
  AS INT) AS moved FROM documents""",
)
def ordered_percent_split(spark, sf_dir):
    return sampling.ordered_percent_split(table(spark, sf_dir, "documents").select("doc_id"), 30, "doc_id")


@query(
    "stratified_sizes",
    f"""
WITH r AS (SELECT doc_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY {shuffle_sql(5)}) AS r,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels),
t AS (SELECT unnest([20, 40, 60, 80]) AS percent)
SELECT percent / 100 AS share, doc_id, label FROM r, t WHERE r <= floor(n * (percent / 100))""",
)
def stratified_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    parts = [
        sampling.stratified(docs, share, seed=5).select(F.lit(share).alias("share"), "doc_id", "label")
        for share in sampling.learning_sizes(20, 100, 20)
    ]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged


@query(
    "class_sample",
    f"""
WITH r AS (SELECT doc_id, quality AS label,
                  row_number() OVER (PARTITION BY quality ORDER BY {shuffle_sql(2)}) AS r FROM labels)
SELECT doc_id, label FROM r WHERE r <= 25""",
)
def class_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return sampling.per_class(docs, 25, seed=2)


@query(
    "shuffled_order",
    f"SELECT doc_id, row_number() OVER (ORDER BY {shuffle_sql(9)}) AS place FROM documents",
)
def shuffled_order(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "documents").select("doc_id"), seed=9)


# --- vectors -----------------------------------------------------------------------------------

STOPS = ("the", "of", "and", "de", "la", "und")
STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"
BIGRAMS = TermOptions(1, 2, STOPS, min_df=3)

TERMS_SQL = f"""
toks AS (SELECT doc_id, list_filter({tokens_sql()}, lambda t: NOT list_contains({STOPS_SQL}, t)) AS t FROM documents),
term AS (
  SELECT doc_id, unnest(t) AS term FROM toks
  UNION ALL
  SELECT doc_id, t[i] || ' ' || t[i + 1] AS term FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks))"""


@query(
    "vocabulary",
    f"""
WITH {TERMS_SQL}
SELECT term, count(DISTINCT doc_id) AS df FROM term GROUP BY term HAVING count(DISTINCT doc_id) BETWEEN 3 AND 200""",
)
def vocabulary(spark, sf_dir):
    options = TermOptions(1, 2, STOPS, min_df=3, max_df=200)
    return vectors.vocabulary(documents(spark, sf_dir), options)


@query(
    "tfidf_long",
    f"""
WITH {TERMS_SQL},
tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3),
w AS (SELECT doc_id, term, tf, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
      FROM tf JOIN df USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
)
def tfidf_long(spark, sf_dir):
    weighted = vectors.tfidf(documents(spark, sf_dir), BIGRAMS)
    return weighted.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "binary_terms",
    f"""SELECT doc_id, term, CAST(1 AS BIGINT) AS tf FROM (
  SELECT DISTINCT doc_id, unnest({tokens_sql()}) AS term FROM documents)""",
)
def binary_terms(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return vectors.term_counts(docs, TermOptions(binary=True))


@query(
    "char_terms",
    r"""
WITH f AS (SELECT doc_id, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, string_split(t, '') AS c FROM f),
g AS (SELECT doc_id, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM c))
SELECT term, count(DISTINCT doc_id) AS df FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 5""",
)
def char_terms(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return vectors.vocabulary(docs, TermOptions(3, 3, analyzer="char", min_df=5))


@query(
    "word_bound_char_terms",
    r"""
WITH w AS (SELECT doc_id, string_split(' ' || w || ' ', '') AS c FROM (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '\s+')) AS w FROM documents) WHERE w <> ''),
g AS (SELECT doc_id, c[i] || c[i + 1] || c[i + 2] AS term FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM w))
SELECT term, count(DISTINCT doc_id) AS df FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 5""",
)
def word_bound_char_terms(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return vectors.vocabulary(docs, TermOptions(3, 3, analyzer="char_wb", min_df=5))


@query(
    "indexed_vocabulary",
    f"""
WITH t AS (SELECT DISTINCT unnest({tokens_sql()}) AS term FROM documents)
SELECT term, row_number() OVER (ORDER BY md5('vocabulary|' || term), term) - 1 AS index FROM t""",
)
def indexed_vocabulary(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return vectors.indexed_vocabulary(vectors.vocabulary(docs)).select("term", "index")


ENTITY_SQL = """
sent AS (SELECT doc_id, list_sort(string_split(unnest(string_split(lower(text), '. ')), ' ')) AS ws FROM {source}),
entity AS (SELECT DISTINCT doc_id, 'w|' || unnest(ws) AS entity FROM sent
           UNION SELECT doc_id, 's|' || array_to_string(ws, ' ') FROM sent)"""


@query(
    "entity_presence",
    f"""
WITH {ENTITY_SQL.format(source="documents")}
SELECT entity, count(*) AS docs FROM entity GROUP BY entity""",
)
def entity_presence(spark, sf_dir):
    present = vectors.entity_presence(documents(spark, sf_dir))
    return present.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "top_terms",
    rf"""
WITH {CORPUS_SQL},
l AS (SELECT doc_id, label, lower({strip_sql("line")}) AS line FROM (
      SELECT doc_id, label, unnest(string_split(text, chr(10))) AS line FROM corpus)),
k AS (SELECT doc_id, label, line FROM (SELECT *, CASE WHEN line = '' THEN 0
        WHEN line LIKE '%:' AND length(line) > 2 THEN 1
        ELSE CAST(regexp_matches(line, 'the') AS INT) + CAST(regexp_matches(line, 'tion') AS INT)
           + CAST(regexp_matches(line, '[0-9]') AS INT) END AS n FROM l), range(3) r(c) WHERE r.c < n),
tf AS (SELECT doc_id, label, term, count(*) AS tf FROM (
       SELECT doc_id, label, unnest({tokens_sql("line")}) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, label, term, tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS w
      FROM tf JOIN df USING (term)),
u AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w),
s AS (SELECT label, term, round(sum(u), 6) AS weight FROM u GROUP BY label, term),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS rank FROM s)
SELECT label, CAST(rank AS INT) AS rank, term, weight FROM r WHERE rank <= 20""",
)
def top_terms(spark, sf_dir):
    """Trigger-trimmed labelled corpus, TF-IDF, and the 20 heaviest terms per label."""
    docs = trigger_lines(corpus(spark, sf_dir), ["the", "tion", "[0-9]"])
    weighted = vectors.tfidf(docs, TermOptions(min_df=2), ["label"])
    summed = weighted.groupBy("label", "term").agg(F.round(F.sum("tfidf"), 6).alias("weight"))
    # Spark keeps the first 20 of a label in every task before it gathers them.
    place = Window.partitionBy("label").orderBy(F.desc("weight"), "term")
    ranked = summed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= 20)
    return ranked.select("label", "rank", "term", "weight")


# --- closed-form classifiers ---------------------------------------------------------------------

RULES = ["tion", "[0-9]{3}", "der (ein|und)?", "the (of|and)", "que", "http"]
FLAT_SQL = f"""{CORPUS_SQL},
u AS (SELECT doc_id, line, min(pos) AS pos FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM corpus) GROUP BY doc_id, line),
flat AS (SELECT doc_id, string_agg(line, ' ' ORDER BY pos) AS text FROM u GROUP BY doc_id),
rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES))}) r(rule, pattern))"""


def _counts_sql(rule: int, pattern: str) -> str:
    return f"""SELECT {rule} AS rule, c.label, len(regexp_extract_all(f.text, '{pattern}')) AS hits
  FROM flat f JOIN corpus c USING (doc_id)"""


STATS_SQL = f"""{FLAT_SQL},
m AS ({" UNION ALL ".join(_counts_sql(i, r) for i, r in enumerate(RULES))}),
stats AS (SELECT rule, CAST(1 + coalesce(sum(hits) FILTER (label = 1), 0) AS BIGINT) AS pos_hits,
     1 + count(*) FILTER (label = 1 AND hits > 0) AS pos_docs,
     CAST(1 + coalesce(sum(hits) FILTER (label = 0), 0) AS BIGINT) AS neg_hits,
     1 + count(*) FILTER (label = 0 AND hits > 0) AS neg_docs FROM m GROUP BY rule)"""


@query("rule_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def rule_stats(spark, sf_dir):
    return rules.rule_stats(corpus(spark, sf_dir), RULES)


RULE_PREDICT_SQL = f"""{STATS_SQL},
h AS ({" UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule FROM corpus WHERE regexp_matches(text, '{r}')" for i, r in enumerate(RULES))}),
s AS (SELECT c.doc_id, c.label, 1 + coalesce(sum(pos_hits / pos_docs), 0) AS p,
             1 + coalesce(sum(neg_hits / neg_docs), 0) AS n
      FROM corpus c LEFT JOIN h ON h.doc_id = c.doc_id LEFT JOIN stats t ON t.rule = h.rule
      GROUP BY c.doc_id, c.label),
rule_pred AS (SELECT doc_id, label, round(p, 6) AS pos_score, round(n, 6) AS neg_score,
                     CAST(p / n > 1 AS INT) AS pred FROM s)"""


@query("rule_predict", f"WITH {RULE_PREDICT_SQL} SELECT * FROM rule_pred")
def rule_predict(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    out = rules.rule_predict(docs, rules.rule_stats(docs, RULES), RULES)
    return out.select(
        "doc_id", "label", F.round("pos_score", 6).alias("pos_score"), F.round("neg_score", 6).alias("neg_score"), "pred"
    )


@query(
    "rule_threshold",
    f"""
WITH {CORPUS_SQL}, m AS (SELECT doc_id, label,
  {" + ".join(f"CAST(regexp_matches(text, '{r}') AS INT)" for r in RULES)} AS matching FROM corpus)
SELECT doc_id, label, matching, CAST(matching >= 2 AS INT) AS pred FROM m""",
)
def rule_threshold(spark, sf_dir):
    return rules.rule_threshold(corpus(spark, sf_dir), RULES, 2)


SENTENCE_SQL = r"""
ch AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), '') AS ch FROM corpus),
ci AS (SELECT doc_id, ch, unnest(range(2, len(ch) + 1)) AS i FROM ch),
br AS (SELECT doc_id, i FROM ci WHERE regexp_full_match(ch[i], '\s') AND ch[i - 1] IN ('.', '?')
  AND NOT (i > 4 AND regexp_full_match(ch[i - 4] || ch[i - 3] || ch[i - 2], '\w\.\w'))
  AND NOT (i > 3 AND ch[i - 1] = '.' AND regexp_full_match(ch[i - 3] || ch[i - 2], '[A-Z][a-z]'))),
ends AS (SELECT doc_id, i FROM br UNION ALL SELECT doc_id, len(ch) + 1 FROM ch),
sent AS (SELECT c.doc_id, array_to_string(c.ch[b.low + 1 : b.i - 1], '') AS s FROM (
   SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), 0) AS low FROM ends) b
   JOIN ch c ON c.doc_id = b.doc_id),
ws AS (SELECT doc_id, list_filter(string_split_regex(s, '[\s;.]'), lambda w: w <> '') AS w FROM sent)"""


@query(
    "mined_rules",
    f"""
WITH {CORPUS_SQL}, {SENTENCE_SQL},
g AS (SELECT DISTINCT doc_id, unnest(w) AS combination FROM ws
  UNION SELECT DISTINCT doc_id, w[i] || chr(10) || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM ws)
  UNION SELECT DISTINCT doc_id, w[i] || chr(10) || w[i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws))
SELECT combination, count(*) FILTER (label = 1) AS pos_docs, count(*) FILTER (label = 0) AS neg_docs
FROM g JOIN corpus USING (doc_id) GROUP BY combination HAVING count(*) >= 5""",
)
def mined_rules(spark, sf_dir):
    return rules.mine_rules(corpus(spark, sf_dir), size=2, gap=1, min_docs=5)


@query(
    "mined_rule_predict",
    f"""
WITH {CORPUS_SQL}, {SENTENCE_SQL},
g AS (SELECT doc_id, unnest(w) AS term FROM ws
  UNION ALL SELECT doc_id, w[i] || chr(10) || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM ws)
  UNION ALL SELECT doc_id, w[i] || chr(10) || w[i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
s AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {shuffle_sql(0)})
        <= floor(count(*) OVER (PARTITION BY label) * 0.5) AS drawn FROM corpus),
weight AS (SELECT term,
   (1 + coalesce(sum(tf) FILTER (label = 1), 0)) / (1 + count(*) FILTER (label = 1)) AS pos,
   (1 + coalesce(sum(tf) FILTER (label = 0), 0)) / (1 + count(*) FILTER (label = 0)) AS neg
   FROM tf JOIN s USING (doc_id) GROUP BY term HAVING bool_or(drawn) AND count(*) >= 5),
p AS (SELECT c.doc_id, c.label, 1 + coalesce(sum(w.pos), 0) AS pos, 1 + coalesce(sum(w.neg), 0) AS neg
   FROM corpus c LEFT JOIN tf USING (doc_id) LEFT JOIN weight w USING (term) GROUP BY c.doc_id, c.label)
SELECT doc_id, label, round(pos, 5) AS pos_score, round(neg, 5) AS neg_score, CAST(pos / neg > 1 AS INT) AS pred FROM p""",
)
def mined_rule_predict(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    out = rules.mined_predict(docs, docs, share=0.5, min_docs=5)
    return _rounded(out, ("pos_score", "neg_score"), 5)


@query(
    "majority",
    f"""
WITH {CORPUS_SQL}, n AS (SELECT label, count(*) AS n FROM corpus GROUP BY label)
SELECT doc_id, label, (SELECT label FROM n ORDER BY n DESC, label LIMIT 1) AS pred FROM corpus""",
)
def majority(spark, sf_dir):
    return bayes.majority(corpus(spark, sf_dir))


@query(
    "balance_weights",
    """
SELECT quality AS label, count(*) AS n,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality""",
)
def balance_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    return evaluate.balance_weights(docs).withColumn("weight", F.round("weight", 6))


FOLDS = 5

NB_SQL = f"""{CORPUS_SQL},
docs AS (SELECT doc_id, label, text, CAST(ntile({FOLDS}) OVER (ORDER BY {shuffle_sql(0)}) - 1 AS INT) AS fold FROM corpus),
tf AS (SELECT doc_id, label, fold, term, count(*) AS tf FROM (
       SELECT doc_id, label, fold, unnest({tokens_sql()}) AS term FROM docs) GROUP BY ALL),
voc AS (SELECT DISTINCT term FROM tf),
mass AS (SELECT fold, term, sum(tf) FILTER (label = 1) AS pos, sum(tf) FILTER (label = 0) AS neg FROM tf GROUP BY fold, term),
allmass AS (SELECT term, sum(pos) AS pos, sum(neg) AS neg FROM mass GROUP BY term),
tot AS (SELECT fold, coalesce(sum(pos), 0) AS pos, coalesce(sum(neg), 0) AS neg FROM mass GROUP BY fold),
cls AS (SELECT fold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM docs GROUP BY fold),
rest AS (SELECT c.fold, ln((SELECT sum(pos) FROM cls) - c.pos) - ln((SELECT sum(neg) FROM cls) - c.neg) AS prior,
   ln((SELECT sum(neg) FROM tot) - t.neg + (SELECT count(*) FROM voc))
   - ln((SELECT sum(pos) FROM tot) - t.pos + (SELECT count(*) FROM voc)) AS per_token
   FROM cls c JOIN tot t USING (fold)),
odds AS (SELECT tf.doc_id, sum(tf.tf * (ln(coalesce(a.pos, 0) - coalesce(m.pos, 0) + 1)
     - ln(coalesce(a.neg, 0) - coalesce(m.neg, 0) + 1))) AS odds, sum(tf.tf) AS length
   FROM tf JOIN allmass a USING (term) JOIN mass m ON m.term = tf.term AND m.fold = tf.fold GROUP BY tf.doc_id),
raw AS (SELECT d.doc_id, d.label, d.fold,
   CAST(coalesce(o.odds, 0) + coalesce(o.length, 0) * r.per_token + r.prior AS DOUBLE) AS log_odds
   FROM docs d LEFT JOIN odds o USING (doc_id) JOIN rest r USING (fold)),
nb AS (SELECT doc_id, label, fold, round(log_odds, 4) AS score, CAST(log_odds > 0 AS INT) AS pred FROM raw)"""


def nb_predictions(spark, sf_dir):
    # Folds are drawn on ids alone; the texts meet them in one shuffle by id, where the ids are hashed:
    # left to itself, Spark may take a small table of texts for the side to broadcast.
    folds = sampling.kfold(corpus(spark, sf_dir).select("doc_id", "label"), FOLDS).hint("shuffle_hash")
    out = bayes.cross_validated(documents(spark, sf_dir).join(folds, "doc_id"))
    return out.select("doc_id", "label", "fold", F.round("log_odds", 4).alias("score"), "pred")


@query("nb_closed_form", f"WITH {NB_SQL} SELECT * FROM nb")
def nb_closed_form(spark, sf_dir):
    return nb_predictions(spark, sf_dir)


# --- metrics over predictions --------------------------------------------------------------------

RULE_FOLD_SQL = f"""{RULE_PREDICT_SQL},
p AS (SELECT doc_id, label, pred, round(pos_score - neg_score, 4) AS score,
      CAST(ntile({FOLDS}) OVER (ORDER BY {shuffle_sql(0)}) - 1 AS INT) AS fold FROM rule_pred)"""


def rule_predictions(spark, sf_dir):
    """Rule predictions with folds and a score."""
    docs = corpus(spark, sf_dir)
    out = rules.rule_predict(docs, rules.rule_stats(docs, RULES), RULES)
    scored = out.select(
        "doc_id",
        "label",
        "pred",
        F.round(F.round("pos_score", 6) - F.round("neg_score", 6), 4).alias("score"),
    )
    return sampling.kfold(scored, FOLDS)


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"


METRICS_SQL = f"""{{source}},
cm AS (SELECT fold, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp,
   count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 0 AND label = 0) AS tn FROM {{table}} GROUP BY fold),
fm AS (SELECT *, {_div("tp", "tp + fp")} AS precision, {_div("tp", "tp + fn")} AS recall,
   {_div("2 * tp", "2 * tp + fp + fn")} AS f1, {_div("tp + tn", "tp + fp + fn + tn")} AS acc,
   {_div("tn", "tn + fp")} AS spc, {_div("tn", "tn + fn")} AS npv FROM cm)"""


def _rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "fold_metrics",
    f"""
WITH {METRICS_SQL.format(source=RULE_FOLD_SQL, table="p")}
SELECT fold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(acc, 6) AS acc, round(spc, 6) AS spc, round(npv, 6) AS npv FROM fm""",
)
def fold_metrics(spark, sf_dir):
    return _rounded(evaluate.fold_metrics(rule_predictions(spark, sf_dir)), evaluate.METRICS)


@query(
    "fold_summary",
    f"""
WITH {METRICS_SQL.format(source=NB_SQL, table="nb")}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
       round(avg(acc), 6) AS acc, round(avg(spc), 6) AS spc, round(avg(npv), 6) AS npv,
       round(stddev_pop(f1), 6) AS std, round(avg(tn), 6) AS tn, round(avg(fp), 6) AS fp, round(avg(fn), 6) AS fn,
       round(avg(tp), 6) AS tp FROM fm""",
)
def fold_summary(spark, sf_dir):
    out = evaluate.fold_summary(evaluate.fold_metrics(nb_predictions(spark, sf_dir)))
    return _rounded(out, out.columns)


@query(
    "macro_scores",
    f"""
WITH {RULE_FOLD_SQL},
classes AS (SELECT fold, unnest([0, 1]) AS class FROM p),
k AS (SELECT DISTINCT fold, class FROM classes),
sides AS (SELECT k.fold, k.class, count(*) FILTER (p.pred = k.class AND p.label = k.class) AS hit,
      count(*) FILTER (p.pred = k.class) AS n_pred, count(*) FILTER (p.label = k.class) AS n_gold
      FROM k JOIN p USING (fold) GROUP BY k.fold, k.class)
SELECT fold, round(avg({_div("hit", "n_pred")}), 6) AS precision_macro, round(avg({_div("hit", "n_gold")}), 6) AS recall_macro
FROM sides WHERE n_pred + n_gold > 0 GROUP BY fold""",
)
def macro_scores(spark, sf_dir):
    out = evaluate.macro_scores(rule_predictions(spark, sf_dir), ["fold"])
    return _rounded(out, ("precision_macro", "recall_macro"))


ROC_SQL = """{source},
ties AS (SELECT fold, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
         FROM {table} GROUP BY fold, score),
run AS (SELECT fold, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
          sum(pos) OVER (PARTITION BY fold) AS n_pos, sum(neg) OVER (PARTITION BY fold) AS n_neg
        FROM ties WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
roc AS (SELECT fold, CASE WHEN n_neg = 0 THEN 0 ELSE fp / n_neg END AS fpr,
               CASE WHEN n_pos = 0 THEN 0 ELSE tp / n_pos END AS tpr, score AS threshold FROM run)"""


@query(
    "roc_points",
    f"""
WITH {ROC_SQL.format(source=NB_SQL, table="nb")}
SELECT fold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, threshold FROM roc""",
)
def roc_points(spark, sf_dir):
    return _rounded(evaluate.roc_points(nb_predictions(spark, sf_dir)), ("fpr", "tpr"))


@query(
    "auc",
    f"""
WITH {NB_SQL},
pair AS (SELECT a.fold, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS win
         FROM nb a JOIN nb b ON a.fold = b.fold AND a.label = 1 AND b.label = 0)
SELECT fold, round(CAST(avg(win) AS DOUBLE), 6) AS auc FROM pair GROUP BY fold""",
)
def auc(spark, sf_dir):
    return _rounded(evaluate.auc(nb_predictions(spark, sf_dir)), ("auc",))


@query(
    "mean_roc",
    f"""
WITH {ROC_SQL.format(source=NB_SQL, table="nb")},
pt AS (SELECT fold, fpr, tpr FROM roc UNION ALL SELECT DISTINCT fold, 0.0, 0.0 FROM roc),
grid AS (SELECT f.fold, unnest(range(21)) AS step FROM (SELECT DISTINCT fold FROM roc) f),
near AS (SELECT g.fold, g.step, g.step / 20 AS rate,
   max({{'x': fpr, 'y': tpr}}) FILTER (ceil(fpr * 20) <= g.step) AS low,
   min({{'x': fpr, 'y': tpr}}) FILTER (ceil(fpr * 20) > g.step) AS high
   FROM grid g JOIN pt USING (fold) GROUP BY g.fold, g.step)
SELECT rate AS fpr, round(avg(low.y + coalesce((rate - low.x) * (high.y - low.y) / (high.x - low.x), 0)), 6) AS tpr
FROM near GROUP BY rate""",
)
def mean_roc(spark, sf_dir):
    return _rounded(evaluate.mean_roc(nb_predictions(spark, sf_dir), steps=20), ("tpr",))


@query(
    "aligned_mean_roc",
    f"""
WITH {ROC_SQL.format(source=NB_SQL, table="nb")},
pos AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY threshold DESC) AS pos FROM roc)
SELECT pos, round(avg(fpr), 6) AS fpr, round(avg(tpr), 6) AS tpr, round(avg(threshold), 4) AS threshold FROM pos GROUP BY pos""",
)
def aligned_mean_roc(spark, sf_dir):
    points = evaluate.roc_points(nb_predictions(spark, sf_dir))
    out = evaluate.aligned_mean_roc(points)
    return _rounded(_rounded(out, ("fpr", "tpr")), ("threshold",), 4)


@query("misses", f"WITH {NB_SQL} SELECT DISTINCT doc_id FROM nb WHERE pred <> label")
def misses(spark, sf_dir):
    return evaluate.misses(nb_predictions(spark, sf_dir))


@query(
    "prediction_report",
    f"WITH {NB_SQL} SELECT doc_id AS mrn, pred, label AS gold, score AS prob FROM nb",
)
def prediction_report(spark, sf_dir):
    return evaluate.prediction_report(nb_predictions(spark, sf_dir))


@query(
    "prediction_pivot",
    f"""
WITH {RULE_FOLD_SQL}
SELECT doc_id AS mrn, label AS gold, {", ".join(
    f"coalesce(max(CAST(pred AS VARCHAR)) FILTER (fold = {k}), '-') AS pred_{k}, "
    f"coalesce(max(CAST(CAST(round(score) AS BIGINT) AS VARCHAR)) FILTER (fold = {k}), '-') AS prob_{k}"
    for k in range(FOLDS))}
FROM p GROUP BY doc_id, label""",
)
def prediction_pivot(spark, sf_dir):
    scored = rule_predictions(spark, sf_dir).withColumn("score", F.round("score").cast("long"))
    return evaluate.prediction_pivot(scored, FOLDS)


# --- neighbours ----------------------------------------------------------------------------------

SAMPLE_SQL = f"""
samp AS (SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER
   (PARTITION BY label ORDER BY {shuffle_sql(1)}) AS r FROM corpus) WHERE r <= {{size}})"""


@query(
    "class_print_vote",
    f"""
WITH {CORPUS_SQL}, {ENTITY_SQL.format(source="corpus")}, {SAMPLE_SQL.format(size=10)},
print AS (SELECT DISTINCT s.label, e.entity FROM samp s JOIN entity e USING (doc_id)),
o AS (SELECT e.doc_id, p.label, count(*) AS n FROM entity e JOIN print p USING (entity) GROUP BY e.doc_id, p.label),
a AS (SELECT c.doc_id, c.label, l.label AS candidate, coalesce(o.n, 0) AS n
      FROM corpus c CROSS JOIN (SELECT DISTINCT label FROM corpus) l
      LEFT JOIN o ON o.doc_id = c.doc_id AND o.label = l.label),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, candidate) AS r FROM a)
SELECT doc_id, label, candidate AS pred, CAST(n AS INT) AS shared FROM r WHERE r = 1""",
)
def class_print_vote(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return neighbours.print_predict(docs, neighbours.class_prints(docs, 10))


BIT_PAIRS_SQL = f"""{CORPUS_SQL}, {ENTITY_SQL.format(source="corpus")}, {SAMPLE_SQL.format(size=10)},
size AS (SELECT doc_id, count(*) AS n FROM entity GROUP BY doc_id),
o AS (SELECT a.doc_id, b.doc_id AS sample_id, count(*) AS n FROM samp s JOIN entity b ON b.doc_id = s.doc_id
      JOIN entity a ON a.entity = b.entity GROUP BY a.doc_id, b.doc_id),
pair AS (SELECT c.doc_id, c.label, s.doc_id AS sample_id, s.label AS sample_label,
            coalesce(o.n, 0) AS shared, x.n + y.n - 2 * coalesce(o.n, 0) AS distance
         FROM corpus c CROSS JOIN samp s JOIN size x ON x.doc_id = c.doc_id JOIN size y ON y.doc_id = s.doc_id
         LEFT JOIN o ON o.doc_id = c.doc_id AND o.sample_id = s.doc_id)"""


@query(
    "bit_knn",
    f"""
WITH {BIT_PAIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, sample_id) AS r FROM pair),
v AS (SELECT doc_id, label, sample_label, count(*) AS n FROM r WHERE r <= 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, sample_label) AS b FROM v)
SELECT doc_id, label, sample_label AS pred FROM b WHERE b = 1""",
)
def bit_knn(spark, sf_dir):
    return neighbours.bit_knn(corpus(spark, sf_dir), 10, 5)


@query(
    "bit_rank_vote",
    f"""
WITH {BIT_PAIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sample_label ORDER BY shared, sample_id) AS rank FROM pair),
w AS (SELECT doc_id, label, rank, arg_min(sample_label, shared * 10 + sample_label) AS winner
      FROM r WHERE rank <= 5 GROUP BY doc_id, label, rank),
v AS (SELECT doc_id, label, winner, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, winner) AS b FROM v)
SELECT doc_id, label, winner AS pred FROM b WHERE b = 1""",
)
def bit_rank_vote(spark, sf_dir):
    return neighbours.bit_knn(corpus(spark, sf_dir), 10, 5, rank_vote=True)


NEAREST_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pair AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label, list_cosine_similarity(a.v, b.v) AS similarity
         FROM e a JOIN e b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM pair)"""


def embedding_neighbours(spark, sf_dir, k):
    items = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(
        items.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        items.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")),
        k,
    )


@query(
    "embedding_neighbours",
    f"""
WITH {NEAREST_SQL}
SELECT query_id, item_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM near WHERE rank <= 5""",
)
def embedding_neighbours_query(spark, sf_dir):
    return _rounded(embedding_neighbours(spark, sf_dir, 5), ("similarity",))


@query(
    "embedding_knn",
    f"""
WITH {NEAREST_SQL},
v AS (SELECT query_id, label, count(*) AS n FROM near WHERE rank <= 5 GROUP BY query_id, label),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS b FROM v)
SELECT query_id, label AS pred, CAST(n AS DOUBLE) AS votes FROM b WHERE b = 1""",
)
def embedding_knn(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return neighbours.knn_vote(embedding_neighbours(spark, sf_dir, 5), labels)

"""Record linkage, feature tokens, concepts and word neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import features as X
from notemill.operators import concepts, consumption, corpus, linkage
from notemill.plans.base import documents, query, strip_sql, table, tokens_sql
from notemill.plans.model_queries import NEAREST_SQL, embedding_neighbours
from notemill.sources import scans
from notemill.sources.scans import spread

# --- linkage -------------------------------------------------------------------------------------

PATIENT_SQL = """
patients AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_custkey AS VARCHAR)
   WHEN 'MACHINERY' THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0')
   WHEN 'HOUSEHOLD' THEN '00' || CAST(c_custkey AS VARCHAR)
   WHEN 'FURNITURE' THEN 'X' || CAST(c_custkey AS VARCHAR)
   ELSE '9' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS patient_id FROM customer),
diagnosis AS (SELECT CAST(c_custkey AS VARCHAR) AS diag_id, c_custkey AS diag_seq FROM customer),
exact AS (SELECT patient_id, diag_id, diag_seq, 'exact' AS tier FROM patients JOIN diagnosis ON patient_id = diag_id),
padded AS (SELECT p.patient_id, d.diag_id, d.diag_seq, 'padded' AS tier FROM patients p JOIN diagnosis d
   ON length(d.diag_id) < 7 AND length(p.patient_id) > length(d.diag_id)
   AND p.patient_id = repeat('0', length(p.patient_id) - length(d.diag_id)) || d.diag_id
   WHERE p.patient_id NOT IN (SELECT patient_id FROM exact)),
first AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY diag_seq) AS r FROM padded),
links AS (SELECT * FROM exact UNION ALL SELECT patient_id, diag_id, diag_seq, tier FROM first WHERE r = 1)"""


def patients_and_diagnosis(spark, sf_dir):
    """Customers under altered ids on one side, under their own keys on the other."""
    customer = table(spark, sf_dir, "customer")
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    altered = (
        F.when(segment == "BUILDING", key)
        .when(segment == "MACHINERY", F.lpad(key, 7, "0"))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("00"), key))
        .when(segment == "FURNITURE", F.concat(F.lit("X"), key))
        .otherwise(F.concat(F.lit("9"), F.lpad(key, 8, "0")))
    )
    patients = customer.select(altered.alias("patient_id"), F.lit("").alias("patient_name"))
    diagnosis = customer.select(key.alias("diag_id"), F.col("c_custkey").alias("diag_seq"))
    return patients, diagnosis


@query("link_tiers", f"WITH {PATIENT_SQL} SELECT * FROM links")
def link_tiers(spark, sf_dir):
    return linkage.link(*patients_and_diagnosis(spark, sf_dir), fuzzy=False)


@query(
    "link_unmatched",
    f"WITH {PATIENT_SQL} SELECT patient_id FROM patients WHERE patient_id NOT IN (SELECT patient_id FROM links)",
)
def link_unmatched(spark, sf_dir):
    patients, diagnosis = patients_and_diagnosis(spark, sf_dir)
    links = linkage.link(patients, diagnosis, fuzzy=False)
    return linkage.unmatched(patients, links).select("patient_id")


@query(
    "notes_to_corpus",
    r"""
WITH notes AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '\s+$', '') AS t FROM conversations),
doc AS (SELECT n.conv_id, c.c_acctbal, CASE WHEN n.conv_id % 2 = 0 THEN 'exact' ELSE 'padded' END AS tier,
    replace(string_agg(n.t, '' ORDER BY n.turn), '. ', '.' || chr(10)) AS text
  FROM notes n JOIN customer c ON c.c_custkey = n.conv_id GROUP BY ALL),
l AS (SELECT conv_id, pos, lower({strip}) AS line FROM (
  SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc)),
k AS (SELECT conv_id, pos, line, r.c FROM (SELECT *, CASE WHEN line = '' THEN 0 WHEN line LIKE '%:' AND length(line) > 2 THEN 1
    ELSE CAST(line LIKE '%the%' AS INT) + CAST(line LIKE '%tion%' AS INT) END AS n FROM l), range(2) r(c) WHERE r.c < n),
t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos, c) AS text FROM k GROUP BY conv_id)
SELECT CAST(d.conv_id AS VARCHAR) AS doc_id, CAST(d.c_acctbal > 0 AS INT) AS label, d.tier,
  md5(coalesce(t.text, '')) AS text_md5 FROM doc d LEFT JOIN t USING (conv_id)""".replace("{strip}", strip_sql("line")),
)
def notes_to_corpus(spark, sf_dir):
    """From raw note lines to a labelled corpus: scan, link, merge by patient, trim to trigger lines."""
    ident = F.col("conv_id").cast("string")
    written = F.when(F.col("conv_id") % 2 == 0, ident).otherwise(F.concat(F.lit("00"), ident))
    raw = table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("seq"),
        F.concat_ws("||", written, F.lit(""), "role", F.regexp_replace("text", "[\r\n]", " ")).alias("value"),
    )
    notes = scans.parse_notes(raw)
    diagnosis = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("diag_id"),
        F.col("c_custkey").alias("diag_seq"),
        (F.col("c_acctbal") > 0).cast("int").alias("label"),
    )
    patients = notes.select("patient_id", F.lit("").alias("patient_name")).distinct()
    links = linkage.link(patients, diagnosis.drop("label"), fuzzy=False).join(diagnosis.select("diag_id", "label"), "diag_id")
    linked = corpus.with_diagnosis(notes, links.select("patient_id", "diag_id", "label", "tier"))
    docs = corpus.merge_text(linked, ["diag_id", "label", "tier"], "seq", "note_text")
    lines = docs.withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n")))
    trimmed = corpus.trigger_lines(lines, ["the", "tion"])
    return trimmed.select(F.col("diag_id").alias("doc_id"), "label", "tier", F.md5("text").alias("text_md5"))


# The similarity is not available in SQL. By construction an id is linked when its tokens are exchanged,
# or when one character of 22 is added or dropped; three added ones score 94, and ids of neighbouring
# customers, which differ in two characters, 91.
@query(
    "link_fuzzy",
    """
WITH c AS (SELECT c_custkey, c_mktsegment AS segment, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key FROM customer),
own AS (SELECT *, reverse(key) AS back, 'mrn' || key || '-' || reverse(key) AS diag_id FROM c)
SELECT CASE segment WHEN 'BUILDING' THEN diag_id WHEN 'MACHINERY' THEN back || ' MRN' || key
    WHEN 'HOUSEHOLD' THEN diag_id || '1' ELSE substr(diag_id, 2) END AS patient_id,
  diag_id, CAST(c_custkey AS BIGINT) AS diag_seq, CASE segment WHEN 'BUILDING' THEN 'exact' ELSE 'fuzzy' END AS tier
FROM own WHERE segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')""",
)
def link_fuzzy(spark, sf_dir):
    """All tiers: ids with a dropped or moved part, names with a changed letter."""
    customer = table(spark, sf_dir, "customer")
    key, segment = F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.col("c_mktsegment")
    own = F.concat(F.lit("mrn"), key, F.lit("-"), F.reverse(key))
    altered = (
        F.when(segment == "BUILDING", own)
        .when(segment == "MACHINERY", F.concat(F.reverse(key), F.lit(" "), F.lit("MRN"), key))
        .when(segment == "HOUSEHOLD", F.concat(own, F.lit("1")))
        .when(segment == "FURNITURE", F.substring(own, 2, 100))
        .otherwise(F.concat(F.lit("x"), own, F.lit("9x")))
    )
    name = F.concat_ws(",", "c_name", "c_mktsegment")
    patients = customer.select(altered.alias("patient_id"), F.regexp_replace(name, "G$", "g.").alias("patient_name"))
    diagnosis = customer.select(
        own.alias("diag_id"),
        F.col("c_custkey").alias("diag_seq"),
        F.col("c_name").alias("last_name"),
        F.col("c_mktsegment").alias("first_name"),
    )
    return linkage.link(patients, diagnosis)


@query(
    "feature_lookup",
    """SELECT d.doc_id, c.c_custkey AS custkey, c.c_mktsegment AS segment FROM documents d
LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = ltrim(CAST(d.doc_id AS VARCHAR), '0')""",
)
def feature_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("00"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_id")
    )
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("mrn"),
        F.col("c_custkey").alias("custkey"),
        F.col("c_mktsegment").alias("segment"),
    )
    found = linkage.feature_lookup(docs, rows)
    return found.select(
        F.regexp_extract("doc_id", r"^00(\d+)", 1).cast("long").alias("doc_id"), "custkey", "segment"
    )


@query(
    "feature_tokens",
    """
SELECT c_custkey, 'note' || CASE c_mktsegment WHEN 'BUILDING' THEN ' BAC_YES' WHEN 'MACHINERY' THEN ' BAC_NO' ELSE '' END
  || CASE WHEN c_acctbal >= 0 THEN ' BAC_50_' || CAST(floor(floor(c_acctbal) / 50) AS BIGINT) || ' BAC_VAL_'
       || CAST(floor(c_acctbal) AS BIGINT) || CASE WHEN floor(c_acctbal) > 130 THEN ' CRITICAL_BAC' ELSE '' END ELSE '' END
  || CASE c_nationkey WHEN 0 THEN ' GENDER_MALE' WHEN 1 THEN ' GENDER_FEMALE' ELSE '' END
  || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' UNKNOWN_RACE' ELSE ' RACE_' || c_nationkey END AS text
FROM customer""",
)
def feature_tokens(spark, sf_dir):
    segment = F.col("c_mktsegment")
    answer = F.when(segment == "BUILDING", "Yes").when(segment == "MACHINERY", "no").otherwise("")
    race = F.when(segment == "HOUSEHOLD", "").otherwise(F.col("c_nationkey").cast("string"))
    row = X.PatientColumns(
        bac_yes_no=answer,
        bac_value=F.floor("c_acctbal").cast("string"),
        gender=F.col("c_nationkey"),
        race=race,
        weight=F.lit(None),
        weight_unit=F.lit(None),
    )
    content = X.apply_chain(F.lit("note"), row, "bac_all_add+gender_add+race_add")
    return table(spark, sf_dir, "customer").select("c_custkey", content.alias("text"))


READING = {"patterns": ("[a-z]+ [0-9]+", "tion", "[0-9]+ of"), "positive": "the|que", "negative": "tion|un"}


def _reading_sql() -> str:
    first = " ".join(
        f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 0)" for p in READING["patterns"]
    )
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE {first} END AS mention, nullif(regexp_extract(line, '[0-9]+', 0), '') AS digits FROM l),
h AS (SELECT *, min(pos) FILTER (digits IS NULL) OVER (PARTITION BY doc_id) AS stop,
        min(pos) OVER (PARTITION BY doc_id) AS head FROM m WHERE mention IS NOT NULL),
k AS (SELECT *, CAST(digits AS DOUBLE) AS level,
        CASE WHEN regexp_matches(mention, '{READING["positive"]}') THEN 'YES'
             WHEN regexp_matches(mention, '{READING["negative"]}') THEN 'NO'
             WHEN pos = head THEN CASE WHEN CAST(digits AS DOUBLE) = 0 THEN 'NO' ELSE 'YES' END END AS said
      FROM h WHERE stop IS NULL OR pos < stop),
s AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS status,
        row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM k),
n AS (SELECT doc_id, ' NOTES_BAC_' || status || ' NOTES_BAC_VAL_' || regexp_replace(digits, '^0+(.)', '\1')
        || CASE WHEN level > 130 THEN ' NOTES_BAC_CRITICAL' ELSE '' END
        || CASE WHEN (status = 'YES' AND level = 0) OR (status = 'NO' AND level > 0)
             THEN ' NOTES_BAC_PARSE_ISSUE_OR_NOTES_CONTRADICTION' ELSE '' END AS note FROM s WHERE back = 1)
SELECT d.doc_id, coalesce(n.note, ' NOTES_BAC_UNKNOWN') AS note FROM documents d LEFT JOIN n USING (doc_id)"""


@query("reading_fold", _reading_sql())
def reading_fold(spark, sf_dir):
    read = X.reading_mentions(F.col("text"), X.ReadingRules(**READING))
    return documents(spark, sf_dir).select(
        "doc_id", F.substring(read, F.length("text") + 1, F.length(read)).alias("note")
    )


# Notes written from orders: one line per item, "<n> times <period> <quantity> <container> <drink>".
@query(
    "weekly_amount",
    """
WITH m AS (SELECT DISTINCT l_orderkey, q, size, strength, times, factor, unit FROM (
   SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q,
     CASE l_returnflag WHEN 'A' THEN 25 WHEN 'N' THEN 16 ELSE 1.5 END AS size,
     CASE l_linestatus WHEN 'O' THEN 5 ELSE 12 END AS strength,
     1 + l_linenumber % 3 AS times, CASE WHEN l_tax > 0.04 THEN 7 ELSE 1 END AS factor,
     CASE WHEN l_tax > 0.04 THEN 'daily' ELSE 'weekly' END AS unit FROM lineitem)),
d AS (SELECT l_orderkey, CAST(floor(q * CAST(size AS DOUBLE) * (CAST(strength AS DOUBLE) / 100) / 0.6) AS BIGINT) AS drinks,
        times, factor, unit FROM m),
u AS (SELECT DISTINCT l_orderkey, drinks, times, factor, unit FROM d WHERE drinks > 0),
t AS (SELECT o.o_orderkey, sum(((0.806::DOUBLE * drinks * 1.2::DOUBLE) / (CASE WHEN o_orderstatus = 'F' THEN 0.5801::DOUBLE ELSE 0.4903::DOUBLE END
        * CASE WHEN o_orderpriority = '1-URGENT' THEN 80::DOUBLE WHEN o_orderpriority = '2-HIGH' THEN 180::DOUBLE * 0.45::DOUBLE ELSE 60::DOUBLE END)
        - CASE WHEN o_orderstatus = 'F' THEN 0.015::DOUBLE ELSE 0.017::DOUBLE END * 2) * 1000 * times * factor) AS total
      FROM u JOIN orders o ON o.o_orderkey = u.l_orderkey GROUP BY o.o_orderkey)
SELECT DISTINCT l.l_orderkey AS o_orderkey, CAST(trunc(trunc(coalesce(t.total, 0)) / 10) AS BIGINT) AS total_tens
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN t ON t.o_orderkey = l.l_orderkey""",
)
def weekly_amount(spark, sf_dir):
    container = F.when(F.col("l_returnflag") == "A", "bottles").when(F.col("l_returnflag") == "N", "pints").otherwise("shots")
    drink = F.when(F.col("l_linestatus") == "O", "beer").otherwise("wine")
    period = F.when(F.col("l_tax") > 0.04, "daily").otherwise("weekly")
    line = F.concat_ws(
        " ",
        (1 + F.col("l_linenumber") % 3).cast("string"),
        F.lit("times"),
        period,
        F.col("l_quantity").cast("long").cast("string"),
        container,
        drink,
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("gender"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "80").otherwise("180").alias("weight"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "kg")
        .when(F.col("o_orderpriority") == "2-HIGH", "lb")
        .otherwise("")
        .alias("weight_unit"),
    )
    # Body-water shares at which no total is a whole number, so truncation cannot differ.
    rules = X.ConsumptionRules(article=r"\ba\b", body_water_male=0.5801, body_water_female=0.4903)
    items = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    lines = items.select(F.col("l_orderkey").alias("doc_id"), line.alias("line"))
    weekly = consumption.weekly_totals(consumption.mention_table(lines, rules), orders, rules)
    return weekly.select(F.col("doc_id").alias("o_orderkey"), (F.col("total") / 10).cast("long").alias("total_tens"))


# --- concepts ------------------------------------------------------------------------------------


def dictionary(spark, sf_dir):
    """Concepts made of the words of the benchmark passages: (cui, str, ispref)."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))))
    words = table(spark, sf_dir, "benchmark").select("item_id", word.alias("str"))
    cui = F.concat(F.lit("C"), F.lpad(F.col("item_id").cast("string"), 7, "0"))
    preferred = F.when(F.length("str") > 4, "Y").otherwise("N")
    return words.select(cui.alias("cui"), "str", preferred.alias("ispref"))


DICTIONARY_SQL = """
dict AS (SELECT DISTINCT 'C' || lpad(CAST(item_id AS VARCHAR), 7, '0') AS cui,
   unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS str FROM benchmark),
entry AS (SELECT cui, str, CASE WHEN length(str) > 4 THEN 'Y' ELSE 'N' END AS ispref FROM dict),
term AS (SELECT str AS term, min(cui) AS cui FROM entry GROUP BY str)"""


@query(
    "concept_tags",
    f"""
WITH {DICTIONARY_SQL},
t AS (SELECT doc_id, unnest({tokens_sql()}) AS term,
             generate_subscripts({tokens_sql()}, 1) AS pos FROM documents)
SELECT doc_id, count(*) AS n, md5(string_agg(cui, ' ' ORDER BY pos)) AS cuis_md5
FROM t JOIN term USING (term) GROUP BY doc_id""",
)
def concept_tags(spark, sf_dir):
    terms = concepts.concept_terms(dictionary(spark, sf_dir))
    docs = documents(spark, sf_dir)
    tagged = concepts.concept_text(concepts.tag(docs, terms, 1))
    return tagged.select(
        "doc_id",
        F.size(F.split("text", " ")).cast("long").alias("n"),
        F.md5("text").alias("cuis_md5"),
    )


# Distinct padded trigrams of a token or a term.
def _grams_sql(source: str) -> str:
    return f"""SELECT DISTINCT term, substr(' ' || term || ' ', i, 3) AS gram
  FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM {source})"""


@query(
    "concept_tags_fuzzy",
    f"""
WITH {DICTIONARY_SQL},
t AS (SELECT doc_id, unnest({tokens_sql()}) AS word,
             generate_subscripts({tokens_sql()}, 1) AS pos FROM documents),
w AS (SELECT DISTINCT word AS term FROM t),
dg AS ({_grams_sql("term")}), wg AS ({_grams_sql("w")}),
ds AS (SELECT term, count(*) AS n FROM dg GROUP BY term), ws AS (SELECT term, count(*) AS n FROM wg GROUP BY term),
common AS (SELECT wg.term AS word, dg.term, count(*) AS n FROM wg JOIN dg USING (gram) GROUP BY ALL),
sim AS (SELECT word, common.term, round(common.n / (ws.n + ds.n - common.n), 9) AS s
        FROM common JOIN ws ON ws.term = common.word JOIN ds ON ds.term = common.term),
near AS (SELECT word, cui, s FROM sim JOIN term USING (term) WHERE s >= 0.6
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY s DESC, cui, term) = 1)
SELECT doc_id, count(*) AS n, round(sum(s), 6) AS similarity, md5(string_agg(cui, ' ' ORDER BY pos)) AS cuis_md5
FROM t JOIN near USING (word) GROUP BY doc_id""",
)
def concept_tags_fuzzy(spark, sf_dir):
    """The closest concept of every word that is similar enough to a dictionary term."""
    terms = concepts.concept_terms(dictionary(spark, sf_dir))
    tagged = concepts.tag_fuzzy(documents(spark, sf_dir), terms, 1, 0.6)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start", "cui"))), lambda s: s["cui"])
    return tagged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("similarity"), 6).alias("similarity"), F.md5(F.array_join(ids, " ")).alias("cuis_md5")
    )


@query(
    "concept_spans",
    f"""
WITH RECURSIVE pair AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term, item_id FROM (
    SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, {tokens_sql()} AS w FROM benchmark))),
single AS (SELECT DISTINCT unnest({tokens_sql()}) AS term, item_id FROM benchmark),
term AS (SELECT term, 'C' || lpad(CAST(min(item_id) AS VARCHAR), 7, '0') AS cui
         FROM (SELECT * FROM pair UNION ALL SELECT * FROM single) GROUP BY term),
tok AS (SELECT doc_id, {tokens_sql()} AS w FROM documents),
two AS (SELECT t.doc_id, t.i AS start, m.cui FROM (
    SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM tok) t JOIN term m ON m.term = t.w[t.i] || ' ' || t.w[t.i + 1]),
-- In a run of adjoining pairs the first, third, ... are taken.
run AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id ORDER BY start) AS grp FROM two),
kept AS (SELECT doc_id, start, 2 AS length, cui FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY start) AS r FROM run) WHERE r % 2 = 1),
one AS (SELECT t.doc_id, t.i AS start, 1 AS length, m.cui FROM (
    SELECT doc_id, w[i] AS term, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok)) t
    JOIN term m ON m.term = t.term),
free AS (SELECT o.* FROM one o LEFT JOIN kept a ON a.doc_id = o.doc_id AND a.start = o.start
    LEFT JOIN kept b ON b.doc_id = o.doc_id AND b.start = o.start - 1 WHERE a.doc_id IS NULL AND b.doc_id IS NULL)
SELECT doc_id, CAST(start AS INT) AS start, length, cui FROM kept UNION ALL
SELECT doc_id, CAST(start AS INT), length, cui FROM free""",
)
def concept_spans(spark, sf_dir):
    """Words and word pairs of the benchmark passages as concepts; longer spans win."""
    from notemill.functions.text import ngrams, tokens

    cui = F.concat(F.lit("C"), F.lpad(F.col("item_id").cast("string"), 7, "0"))
    entries = table(spark, sf_dir, "benchmark").select(
        cui.alias("cui"),
        F.explode(F.array_distinct(ngrams(tokens(F.col("text")), 1, 2))).alias("str"),
        F.lit("Y").alias("ispref"),
    )
    docs = documents(spark, sf_dir)
    spans = concepts.tag(docs, concepts.concept_terms(entries), 2)
    return spans.select("doc_id", "start", "length", "cui")


@query(
    "concept_names",
    f"""
WITH {DICTIONARY_SQL},
pref AS (SELECT cui, min(str) AS name FROM entry WHERE ispref = 'Y' GROUP BY cui),
f AS (SELECT term FROM (SELECT DISTINCT unnest({tokens_sql()}) AS term FROM documents)
      UNION ALL SELECT lower(cui) FROM (SELECT DISTINCT cui FROM entry)
      UNION ALL SELECT '-' || lower(cui) FROM (SELECT DISTINCT cui FROM entry)
      UNION ALL SELECT 'c9999999'),
k AS (SELECT term, CASE WHEN regexp_matches(term, '^(-?|neg)[Cc][0-9]{{7}}$') THEN upper(right(term, 8)) END AS cui FROM f)
SELECT k.term, CASE WHEN k.cui IS NULL THEN k.term ELSE k.term || ' (' || coalesce(p.name, 'N/A') || ')' END AS name
FROM k LEFT JOIN pref p ON p.cui = k.cui""",
)
def concept_names(spark, sf_dir):
    from notemill.functions.text import tokens

    entries = dictionary(spark, sf_dir)
    cuis = F.lower(F.col("cui"))
    words = (
        documents(spark, sf_dir).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    )
    coded = entries.select("cui").distinct().select(
        F.explode(F.array(cuis, F.concat(F.lit("-"), cuis))).alias("term")
    )
    unknown = spark.createDataFrame([("c9999999",)], "term string")
    features = words.unionByName(coded).unionByName(unknown)
    return concepts.resolve_names(features, entries).select("term", "name")


@query(
    "neighbour_levels",
    f"""
WITH {NEAREST_SQL},
edge AS (SELECT query_id, item_id FROM near WHERE rank <= 3)
SELECT DISTINCT a.query_id AS seed, b.item_id AS word FROM edge a JOIN edge b ON b.query_id = a.item_id""",
)
def neighbour_levels(spark, sf_dir):
    """Every vector as a seed, two hops over its three nearest."""
    near = embedding_neighbours(spark, sf_dir, 3)
    edges = near.select(F.col("query_id").alias("word"), "rank", F.col("item_id").alias("neighbour"))
    seeds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seed"), F.col("vec_id").alias("word"))
    return concepts.expand_neighbours(seeds, edges, 3, 1)

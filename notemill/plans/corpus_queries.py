"""Scans, filters, grouping, trimming and text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import corpus as C
from notemill.plans.base import corpus, documents, query, strip_sql, table
from notemill.scale import shared_folder
from notemill.sources import scans as S
from notemill.sources import sinks


def note_line():
    """A raw note record made of a conversation turn."""
    return F.concat_ws(
        "||",
        F.col("conv_id").cast("string"),
        F.concat(F.lit("Doe,"), F.col("conv_id").cast("string")),
        F.col("role"),
        F.regexp_replace("text", "[\r\n]", " "),
    )


@query(
    "scan_delimited_notes",
    rf"""
WITH raw AS (
  SELECT conv_id, turn, concat_ws('||', conv_id, 'Doe,' || conv_id, role,
         regexp_replace(text, '[\r\n]', ' ', 'g')) AS value FROM conversations),
split AS (SELECT conv_id, turn, string_split({strip_sql("value")}, '||') AS f FROM raw)
SELECT conv_id, turn, f[1] AS patient_id, f[2] AS patient_name, f[len(f) - 1] AS note_type,
       len(f) AS n_fields, md5(f[len(f)]) AS note_md5
FROM split""",
)
def scan_delimited_notes(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", note_line().alias("value"))
    return S.parse_notes(raw).select(
        "conv_id",
        "turn",
        "patient_id",
        "patient_name",
        "note_type",
        F.size("fields").cast("long").alias("n_fields"),
        F.md5("note_text").alias("note_md5"),
    )


@query(
    "separated_values",
    """
SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
       c_mktsegment AS segment
FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def separated_values(spark, sf_dir):
    """Commented records (one segment) and records of another width (another) must be dropped."""
    line = F.concat(
        F.when(F.col("c_mktsegment") == "BUILDING", "*").otherwise(""),
        F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string")),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.concat(F.lit("|"), "c_mktsegment")),
        F.lit("|"),
    )
    raw = table(spark, sf_dir, "customer").select(line.alias("value"))
    return S.parse_separated(raw, "|", ["custkey", "name", "nation", "segment"])


@query("column_cut", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def column_cut(spark, sf_dir):
    return S.cut_columns(table(spark, sf_dir, "customer"), "1-2,4-")


@query(
    "column_rearrange",
    """SELECT c_custkey, c_mktsegment || ',' || CAST(c_custkey AS VARCHAR) || ',' || c_name AS line
FROM customer""",
)
def column_rearrange(spark, sf_dir):
    fields = F.split(
        F.concat_ws(
            ",", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment"
        ),
        ",",
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(S.rearrange(fields, ["4", "1:2"]), ",").alias("line")
    )


@query(
    "last_wins_map",
    """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text_md5
FROM conversations GROUP BY conv_id""",
)
def last_wins_map(spark, sf_dir):
    last = S.keyed_last(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return last.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "duplicate_keys",
    "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return S.duplicate_keys(table(spark, sf_dir, "conversations"), "conv_id")


@query(
    "line_grep",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, line FROM l WHERE regexp_matches(line, '[0-9]{3}')""",
)
def line_grep(spark, sf_dir):
    found = (
        documents(spark, sf_dir)
        .select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
    )
    return S.grep(found, "line", "[0-9]{3}")


@query("note_types", "SELECT DISTINCT role AS note_type FROM conversations")
def note_types(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").withColumnRenamed("role", "note_type")
    return C.note_types(notes)


@query(
    "typed_notes",
    "SELECT conv_id, turn, role AS note_type FROM conversations WHERE lower(role) IN ('user', 'system')",
)
def typed_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("note_type"))
    wanted = spark.createDataFrame([("USER",), ("System",)], "type string")
    return C.of_types(notes, wanted)


@query(
    "typed_notes_by_substring",
    """SELECT conv_id, turn, role AS note_type FROM conversations
WHERE contains('assistant notes; user notes', lower(role))""",
)
def typed_notes_by_substring(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("note_type"))
    return C.of_types(notes, "Assistant notes; User notes")


@query(
    "diagnosed_notes",
    """SELECT v.conv_id, v.turn, c.c_mktsegment AS label FROM conversations v
JOIN customer c ON c.c_custkey = v.conv_id WHERE c.c_acctbal > 0""",
)
def diagnosed_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    diagnosis = (
        table(spark, sf_dir, "customer")
        .where("c_acctbal > 0")
        .select(F.col("c_custkey").alias("conv_id"), F.col("c_mktsegment").alias("label"))
    )
    return C.with_diagnosis(notes, diagnosis, "conv_id", "turn")


TRIGGERS = ["the", "und ", "[0-9]{2}", "que$"]

TRIGGER_SQL = rf"""
WITH l AS (SELECT doc_id, lower({strip_sql("line")}) AS line, pos FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
c AS (SELECT doc_id, pos, line, CASE WHEN line = '' THEN 0
        WHEN line LIKE '%:' AND length(line) > 2 THEN 1 ELSE {{hits}} END AS n FROM l),
k AS (SELECT doc_id, pos, line, unnest(range(n)) AS copy FROM c)
SELECT d.doc_id, count(k.line) AS n_lines,
       md5(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos), '')) AS text_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


def _trimmed(docs):
    kept = F.col("text")
    n = F.when(kept == "", 0).otherwise(F.size(T.lines(kept)))
    return docs.select("doc_id", n.cast("long").alias("n_lines"), F.md5("text").alias("text_md5"))


@query(
    "trigger_lines",
    TRIGGER_SQL.format(hits=" + ".join(f"CAST(regexp_matches(line, '{t}') AS INT)" for t in TRIGGERS)),
)
def trigger_lines(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _trimmed(C.trigger_lines(docs, TRIGGERS))


@query(
    "trigger_lines_once",
    TRIGGER_SQL.format(hits="CAST(regexp_matches(line, '" + "|".join(TRIGGERS) + "') AS INT)"),
)
def trigger_lines_once(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _trimmed(C.trigger_lines(docs, TRIGGERS, dedup=True))


@query(
    "printable_text",
    r"""WITH p AS (SELECT doc_id, regexp_replace(text, '[^\x09-\x0d\x20-\x7e]', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM p""",
)
def printable_text(spark, sf_dir):
    kept = T.printable(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.length(kept).cast("long").alias("n"), F.md5(kept).alias("text_md5")
    )


@query(
    "upper_tokens",
    r"""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w:
  CASE WHEN regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') THEN w ELSE '' END) AS ws
  FROM documents),
z AS (SELECT doc_id, regexp_replace(array_to_string(ws, ' '), '\s{3,}', ' ', 'g') AS t FROM w)
SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM z""",
)
def upper_tokens(spark, sf_dir):
    kept = T.upper_tokens(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.length(kept).cast("long").alias("n"), F.md5(kept).alias("text_md5")
    )


@query(
    "line_dedup",
    f"""
WITH l AS (SELECT doc_id, {strip_sql("line")} AS line, pos FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
u AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY doc_id, line)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5
FROM u GROUP BY doc_id""",
)
def line_dedup(spark, sf_dir):
    kept = T.unique_lines(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(T.lines(kept)).cast("long").alias("n_lines"), F.md5(kept).alias("text_md5")
    )


@query(
    "flat_lines",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
u AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY doc_id, line)
SELECT doc_id, md5(string_agg(line, ' ' ORDER BY pos)) AS text_md5 FROM u GROUP BY doc_id""",
)
def flat_lines(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(T.flat_unique_lines(F.col("text"))).alias("text_md5")
    )


@query(
    "patient_groups",
    """SELECT conv_id, count(*) AS n_notes, arg_min(role, turn) AS first_type, max(turn) AS last_seq,
       md5(string_agg(role || text, '/' ORDER BY turn)) AS notes_md5
FROM conversations GROUP BY conv_id""",
)
def patient_groups(spark, sf_dir):
    grouped = C.group_notes(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    texts = F.transform("notes", lambda n: F.concat(n["role"], n["text"]))
    return grouped.select(
        "conv_id",
        F.size("notes").cast("long").alias("n_notes"),
        F.element_at("notes", 1)["role"].alias("first_type"),
        F.element_at("notes", -1)["turn"].alias("last_seq"),
        F.md5(F.array_join(texts, "/")).alias("notes_md5"),
    )


@query(
    "merged_text",
    """SELECT role AS label, conv_id, length(string_agg(text, '' ORDER BY turn)) AS n,
       md5(string_agg(text, '' ORDER BY turn)) AS text_md5
FROM conversations GROUP BY role, conv_id""",
)
def merged_text(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").withColumnRenamed("role", "label")
    return C.merge_text(notes, ["label", "conv_id"], "turn").select(
        "label", "conv_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5")
    )


@query(
    "merged_sources",
    """
WITH s AS (SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS text
           FROM conversations GROUP BY conv_id, role)
SELECT conv_id, md5(string_agg(text, '' ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END)) AS text_md5
FROM s GROUP BY conv_id""",
)
def merged_sources(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations")
    parts = [
        C.merge_text(notes.where(F.col("role") == role), ["conv_id"], "turn") for role in ("system", "user", "assistant")
    ]
    return C.merge_corpora(parts, "conv_id").select("conv_id", F.md5("text").alias("text_md5"))


@query(
    "mirror_split",
    """SELECT d.doc_id, CAST(l.doc_id IS NOT NULL AS INT) AS moved
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def mirror_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    moved, kept = C.mirror_split(docs, table(spark, sf_dir, "labels"))
    return moved.withColumn("moved", F.lit(1)).unionByName(kept.withColumn("moved", F.lit(0)))


@query(
    "section_labels",
    f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, ': ')) AS part,
                  generate_subscripts(string_split(text, ': '), 1) AS pos FROM documents),
l AS (SELECT doc_id, pos, {strip_sql("string_split(part, '  ')[-1]")} || ':' AS label FROM p)
SELECT doc_id, count(*) AS n_labels, md5(string_agg(label, chr(10) ORDER BY pos)) AS labels_md5
FROM l GROUP BY doc_id""",
)
def section_labels(spark, sf_dir):
    """Labels only; a label is the last line of each part of the sectioned text."""
    parts = F.split("text", ": ", -1)
    labels = F.transform(parts, lambda p: F.element_at(T.sections(p), -1))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(labels).cast("long").alias("n_labels"),
        F.md5(F.array_join(labels, "\n")).alias("labels_md5"),
    )


@query(
    "sentence_split",
    r"""
WITH c AS (SELECT doc_id, string_split(text, '') AS ch FROM documents),
i AS (SELECT doc_id, ch, unnest(range(2, len(ch) + 1)) AS i FROM c),
b AS (SELECT doc_id, i FROM i WHERE regexp_full_match(ch[i], '\s') AND ch[i - 1] IN ('.', '?')
  AND NOT (i > 4 AND regexp_full_match(ch[i - 4] || ch[i - 3] || ch[i - 2], '\w\.\w'))
  AND NOT (i > 3 AND ch[i - 1] = '.' AND regexp_full_match(ch[i - 3] || ch[i - 2], '[A-Z][a-z]')))
SELECT d.doc_id, count(b.i) + 1 AS n_sentences, coalesce(max(b.i), 0) AS last_break
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def sentence_split(spark, sf_dir):
    found = T.sentences(F.col("text"))
    last = F.length("text") - F.length(F.element_at(found, -1))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(found).cast("long").alias("n_sentences"),
        last.cast("long").alias("last_break"),
    )


@query(
    "word_split",
    r"""
WITH w AS (SELECT doc_id, string_split_regex(text, '[\s;.]') AS ws FROM documents)
SELECT doc_id, len(ws) AS n_words, len(list_filter(ws, lambda x: x = '')) AS n_empty,
       md5(array_to_string(ws, '/')) AS words_md5 FROM w""",
)
def word_split(spark, sf_dir):
    found = T.words(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(found).cast("long").alias("n_words"),
        F.size(F.filter(found, lambda w: w == "")).cast("long").alias("n_empty"),
        F.md5(F.array_join(found, "/")).alias("words_md5"),
    )


@query(
    "find_all",
    """
WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+[0-9]+') AS found FROM documents)
SELECT doc_id, len(found) AS n, found[1] AS first_match, md5(array_to_string(found, '/')) AS found_md5
FROM m""",
)
def find_all(spark, sf_dir):
    pattern = "[A-Za-z]+[0-9]+"
    found = T.find_all(F.col("text"), pattern)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(found).cast("long").alias("n"),
        T.find_all(F.col("text"), pattern, 0).alias("first_match"),
        F.md5(F.array_join(found, "/")).alias("found_md5"),
    )


@query(
    "pattern_index",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '^(?:The|Th)') THEN 3
  WHEN regexp_matches(text, '^(?:[A-Z][a-z]+ )') THEN 1 WHEN regexp_matches(text, '^(?:[0-9])') THEN 2 END
  AS found FROM documents""",
)
def pattern_index(spark, sf_dir):
    choices = {"The|Th": 3, "[A-Z][a-z]+ ": 1, "[0-9]": 2}
    return documents(spark, sf_dir).select(
        "doc_id", T.first_pattern(F.col("text"), choices).alias("found")
    )


@query(
    "criteria_map",
    """SELECT event_id, 'last' AS type, CAST(user_id AS VARCHAR) AS user_value,
       CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS VARCHAR) AS several, 4 AS n_keys FROM events""",
)
def criteria_map(spark, sf_dir):
    written = F.concat(
        F.lit("type="), "event_type", F.lit("&user="), F.col("user_id").cast("string"), F.lit("&flag&c=x=y&type=last")
    )
    return (
        table(spark, sf_dir, "events")
        .select("event_id", T.parse_map(written).alias("m"))
        .select(
            "event_id",
            F.col("m.type").alias("type"),
            F.col("m.user").alias("user_value"),
            F.col("m.flag").alias("flag"),
            F.col("m.c").alias("several"),
            F.size("m").alias("n_keys"),
        )
    )


@query(
    "snake_names",
    r"""
WITH n AS (SELECT p_partkey, regexp_replace(p_type || p_brand, '[^A-Za-z0-9]', '', 'g') || 'SizeOf' AS name FROM part)
SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'),
       '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM n""",
)
def snake_names(spark, sf_dir):
    name = F.concat(
        F.regexp_replace(F.concat("p_type", "p_brand"), "[^A-Za-z0-9]", ""), F.lit("SizeOf")
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.snake_case(name).alias("snake"))


@query(
    "one_hot",
    """SELECT doc_id, CAST(quality = 0 AS INT) AS quality_0, CAST(quality = 1 AS INT) AS quality_1 FROM labels""",
)
def one_hot(spark, sf_dir):
    hot = T.one_hot(F.col("quality"))
    return table(spark, sf_dir, "labels").select(
        "doc_id", hot[0].alias("quality_0"), hot[1].alias("quality_1")
    )


@query(
    "typed_literals",
    """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'float' WHEN 'MACHINERY' THEN 'int'
         WHEN 'FURNITURE' THEN 'none' ELSE 'string' END AS kind,
       CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) || '.5'
         WHEN 'MACHINERY' THEN CAST(c_nationkey AS VARCHAR) WHEN 'FURNITURE' THEN NULL ELSE c_mktsegment END AS value
FROM customer""",
)
def typed_literals(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    segment = F.col("c_mktsegment")
    written = (
        F.when(segment == "BUILDING", F.concat(nation, F.lit(".5")))
        .when(segment == "MACHINERY", nation)
        .when(segment == "FURNITURE", "None")
        .when(segment == "HOUSEHOLD", F.concat(F.lit("'"), segment, F.lit("'")))
        .otherwise(segment)
    )
    read = T.typed_literal(written)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", read["kind"].alias("kind"), read["value"].alias("value")
    )


@query(
    "run_counts",
    """SELECT count(*) AS records, count(*) FILTER (role = 'user') AS from_user,
       count(*) FILTER (length(text) > 200) AS long_notes FROM conversations""",
)
def run_counts(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations")
    return C.run_counts(notes, from_user=F.col("role") == "user", long_notes=F.length("text") > 200)


@query(
    "file_names",
    """SELECT doc_id, source || '-' || CAST(doc_id AS VARCHAR) AS name, ' ' || coalesce(lang, '') || ' ' AS padded FROM documents""",
)
def file_names(spark, sf_dir):
    """Ids read from file names, and padded values."""
    path = F.concat(F.lit("/notes/yes/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", path.alias("path"))
    return docs.select(
        "doc_id", T.doc_id_of(F.col("path")).alias("name"), T.pad(F.coalesce("lang", F.lit(""))).alias("padded")
    )


@query(
    "corpus_files",
    """
SELECT lpad(CAST(d.doc_id AS VARCHAR), 7, '0') AS doc_id, CAST(l.quality AS INT) AS label, md5(d.text) AS text_md5
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def corpus_files(spark, sf_dir):
    """Labelled documents under padded ids, written as one file each and read back."""
    docs = corpus(spark, sf_dir).withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 7, "0"))
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    sinks.write_text(docs, path, classes=("no", "yes"))
    return S.read_labelled_corpus(spark, path).select("doc_id", "label", F.md5("text").alias("text_md5"))

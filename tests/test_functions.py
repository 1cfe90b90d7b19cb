import pytest
from pyspark.sql import functions as F

from notemill.functions import features as X
from notemill.functions import text as T


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_snake_case(spark):
    assert value(spark, "classWeight", T.snake_case) == "class_weight"


def test_map_parsing(spark):
    assert value(spark, "a=1&b&c=x=y", T.parse_map) == {"a": "1", "b": None, "c": None}
    assert value(spark, "a=1&a=2", T.parse_map) == {"a": "2"}


def test_upper_tokens(spark):
    assert value(spark, "AB cd Ef GH", T.upper_tokens) == "AB GH"


def test_unique_lines_keep_first_and_are_stable(spark):
    once = value(spark, " x\ny\nx", T.unique_lines)
    assert once == "x\ny"
    assert value(spark, once, T.unique_lines) == once


def test_one_hot(spark):
    rows = spark.createDataFrame([(1,), (0,), (2,)], "x int").select(T.one_hot(F.col("x")).alias("h")).collect()
    assert [r["h"] for r in rows] == [[0, 1], [1, 0], [0, 0]]


def test_find_all_and_first_pattern(spark):
    assert value(spark, "a1 b22", lambda c: T.find_all(c, "[0-9]+")) == ["1", "22"]
    assert value(spark, "a", lambda c: T.find_all(c, "[0-9]+", 0)) is None
    with pytest.raises(ValueError):
        T.find_all(F.col("t"), "[0-9]*")
    assert value(spark, "weekly", lambda c: T.first_pattern(c, {"day": 7, "week": 1})) == 1


def test_sections(spark):
    got = value(spark, "Intro words.  History: Was ill. Is well.  Plan: rest", T.sections)
    assert got == ["Intro words.", "History:", "Was ill.", "Is well.", "Plan:", "", "rest:"]


def test_sentences_keep_titles_together(spark):
    assert value(spark, "Seen by Dr. Who. Left? Yes.", T.sentences) == ["Seen by Dr. Who.", "Left?", "Yes."]


def test_tokens(spark):
    assert value(spark, "-C0012345 été a b_2 x-c12 é", T.tokens) == ["-c0012345", "été", "a", "b_2", "x", "-c12"]


def test_ngrams(spark):
    words = lambda c: T.ngrams(F.split(c, " "), 1, 3)
    assert value(spark, "a b c", words) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert value(spark, "a", words) == ["a"]


def test_char_ngrams(spark):
    assert value(spark, "ab  c", lambda c: T.char_ngrams(c, 2, 2)) == ["ab", "b ", " c"]
    assert value(spark, "ab c", lambda c: T.char_ngrams(c, 3, 3, True)) == [" ab", "ab ", " c "]


@pytest.mark.parametrize(
    "text,kind,read",
    [("'x'", "string", "x"), ("1.5", "float", "1.5"), ("-3", "int", "-3"), ("True", "bool", "True"), ("None", "none", None), ("l2", "string", "l2")],
)
def test_typed_literal(spark, text, kind, read):
    got = value(spark, text, T.typed_literal)
    assert (got["kind"], got["value"]) == (kind, read)


def test_record_key_and_doc_id(spark):
    assert value(spark, "0012.txt", T.record_key) == "12"
    assert value(spark, "/a/yes/0012.txt", T.doc_id_of) == "0012"


# --- feature tokens ---------------------------------------------------------------------------------


def row(**given):
    columns = dict(bac_yes_no="", bac_value="", gender=None, race="", weight="", weight_unit="")
    columns.update(given)
    return X.PatientColumns(**{k: F.lit(v) for k, v in columns.items()})


@pytest.mark.parametrize(
    "level,expected",
    [("137", "d BAC_50_2 BAC_VAL_137 CRITICAL_BAC"), ("49", "d BAC_50_0 BAC_VAL_49"), ("12a", "d"), ("", "d")],
)
def test_bac_value(spark, level, expected):
    assert value(spark, "d", lambda c: X.bac_value(c, F.lit(level))) == expected


def test_chain(spark):
    r = row(bac_yes_no="YES", bac_value="20", gender=1, race="3")
    got = value(spark, "d", lambda c: X.apply_chain(c, r, "bac_all_add+gender_add+race_add+merge"))
    assert got == " d BAC_YES BAC_50_0 BAC_VAL_20 GENDER_FEMALE RACE_3 "
    with pytest.raises(ValueError):
        X.apply_chain(F.col("t"), r, "nothing")


@pytest.mark.parametrize(
    "text,note",
    [
        ("etoh 140", " NOTES_BAC_YES NOTES_BAC_VAL_140 NOTES_BAC_CRITICAL"),
        ("etoh 0\nelevated blood alcohol", " NOTES_BAC_NO NOTES_BAC_VAL_0"),
        (
            "seen, negative bac , later 90",
            " NOTES_BAC_NO NOTES_BAC_VAL_90 NOTES_BAC_PARSE_ISSUE_OR_NOTES_CONTRADICTION",
        ),
        ("nothing here", " NOTES_BAC_UNKNOWN"),
        ("elevated blood alcohol\netoh 140", " NOTES_BAC_UNKNOWN"),
        ("etoh 10\netoh 0", " NOTES_BAC_YES NOTES_BAC_VAL_0 NOTES_BAC_PARSE_ISSUE_OR_NOTES_CONTRADICTION"),
    ],
)
def test_reading_mentions(spark, text, note):
    assert value(spark, text, X.reading_mentions) == text + note


@pytest.mark.parametrize(
    "line,expected",
    [
        ("6 shots of rum", 9.0),
        ("2-4 bottle wine", 75.0),
        ("1/2 pint beer", 8.0),
        ("a bottle", 25.0),
        ("no size", 0.0),
        ("3 beers", 3.0),
    ],
)
def test_quantity(spark, line, expected):
    rules = X.ConsumptionRules(article=r"\ba\b")
    assert value(spark, line, lambda c: X.quantity(c, rules)) == expected


def test_quantity_takes_any_letter_a_by_default(spark):
    assert value(spark, "wants 6 shots", X.quantity) == 1.5


@pytest.mark.parametrize(
    "line,amount,unit",
    [("3 times weekly", 3.0, "weekl"), ("1-3 beers daily", 2.0, "daily"), ("the night", 1.0, "night"),
     ("0-0 daily", 2.5, "daily"), ("often", 0.0, None)],
)
def test_frequency(spark, line, amount, unit):
    got = value(spark, line, X.frequency)
    assert (got["amount"], got["unit"]) == (amount, unit)


def test_weekly_consumption(spark):
    text = "6 bottle beer 2 times daily\n6 bottle beer 2 times daily\nother"
    # The number nearest the start is the one close before the frequency word: 6, not 2.
    drinks = int(6 * 25 * (5 / 100) / 0.6)
    level = ((0.806 * drinks * 1.2) / (0.58 * 80) - 0.015 * 2) * 1000
    total = int(level * 6 * 7)
    r = row(gender=0, weight="80", weight_unit="kg")
    got = value(spark, text, lambda c: X.apply_chain(c, r, "week_cons_add"))
    assert got == f"{text} W_CONS_250_{int(total / 250)} W_CONS_VAL_{total}"
    assert value(spark, "no usage", lambda c: X.apply_chain(c, r, "week_cons_add")) == "no usage"


def test_weekly_totals_over_lines_agree_with_the_row_form(spark):
    from notemill.operators.consumption import mention_table, weekly_totals

    lines = [("p", "6 bottle beer 2 times daily"), ("p", "6 bottle beer 2 times daily"), ("p", "1 pint wine weekly")]
    patients = spark.createDataFrame([("p", 1, "10", "kg")], "doc_id string, gender int, weight string, weight_unit string")
    got = weekly_totals(mention_table(spark.createDataFrame(lines, "doc_id string, line string")), patients).first()
    text = "\n".join(line for _, line in lines)
    r = row(gender=1, weight="10", weight_unit="kg")
    assert value(spark, text, lambda c: X.apply_chain(c, r, "week_cons_add")).endswith(f" W_CONS_VAL_{got['total']}")

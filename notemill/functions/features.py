"""Feature tokens appended to a document from its patient's row or from the text itself."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions import text as T


@dataclass(frozen=True)
class PatientColumns:
    """Columns of the structured patient table that the row features read."""

    bac_yes_no: Column
    bac_value: Column
    gender: Column
    race: Column
    weight: Column
    weight_unit: Column


# Reading mentions of a measured alcohol level and the tokens they produce.
READING_PATTERNS = (
    r"etoh {0,5}\d+",
    r"\+ {0,3}etoh",
    r"blood {0,5}alcohol .{0,15}\d+",
    r"\d .{0,10}blood {0,5}alcohol",
    r"elevated {0,5}blood {0,5}alcohol",
    r"blood {0,5}alcohol {0,5}elevated",
    r"[^a-z](negative|positive) {0,5}(bac|bal)[^a-z]",
)
READING_POSITIVE = r"(\+|elevated|positive)"
READING_NEGATIVE = r"(-|negative)"
READING_UNKNOWN_TOKEN = " NOTES_BAC_UNKNOWN"
READING_YES_TOKEN = " NOTES_BAC_YES"
READING_NO_TOKEN = " NOTES_BAC_NO"
READING_VALUE_TOKEN = " NOTES_BAC_VAL_"
READING_CRITICAL_TOKEN = " NOTES_BAC_CRITICAL"
READING_CLASH_TOKEN = " NOTES_BAC_PARSE_ISSUE_OR_NOTES_CONTRADICTION"
CRITICAL_LEVEL = 130
LEVEL_BUCKET = 50


@dataclass(frozen=True)
class ReadingRules:
    """What counts as a reading, and which words decide it."""

    patterns: Sequence[str] = READING_PATTERNS
    positive: str = READING_POSITIVE
    negative: str = READING_NEGATIVE
    critical: int = CRITICAL_LEVEL


@dataclass(frozen=True)
class ConsumptionRules:
    """Words, sizes and constants of the weekly consumption estimate."""

    # Times per week by frequency word, tested in this order.
    frequencies: Mapping[str, float] = field(
        default_factory=lambda: {
            "day[^s]": 7,
            "daily": 7,
            "night": 7,
            "week ?days?": 5,
            "weekend": 2,
            "week[^sed]": 1,
            "weekly": 1,
            "wk": 1,
            "month": 0.25,
            "monthly": 0.25,
            "None": 0,
        }
    )
    # Strength in per cent by beverage word.
    strengths: Mapping[str, float] = field(
        default_factory=lambda: {
            "drink": 5,
            "beer": 5,
            "wine": 12,
            "milwaukee best ice": 5,
            "liquor": 40,
            "hennessy": 40,
            "remy": 40,
        }
    )
    # Volume in ounces by container word, tested in this order.
    sizes: Mapping[str, float] = field(
        default_factory=lambda: {
            "[^a-z]cans?[^a-z]": 12,
            "[^a-z]glass(es)?": 5,
            "bottle": 25,
            "shot": 1.5,
            "pint": 16,
            "fifth": 25,
            "large can": 22,
            "6.{0,3}pack": 72,
            "12.{0,3}pack": 144,
        }
    )
    article: str = "a"
    body_water_male: float = 0.58
    body_water_female: float = 0.49
    metabolism_male: float = 0.015
    metabolism_female: float = 0.017
    drinking_hours: float = 2
    default_weight: float = 60
    bucket: int = 250


def bac_yes_no(content: Column, answer: Column) -> Column:
    said = F.lower(answer)
    token = F.when(said == "no", " BAC_NO").when(said == "yes", " BAC_YES").otherwise("")
    return F.concat(content, F.coalesce(token, F.lit("")))


def bac_yes_no_only(content: Column, answer: Column) -> Column:
    said = F.lower(answer)
    return F.when(said == "no", "BAC_NO").when(said == "yes", "BAC_YES").otherwise(content)


def bac_value(
    content: Column, value: Column, width: int = LEVEL_BUCKET, critical: int = CRITICAL_LEVEL
) -> Column:
    """Bucket and value tokens when the value is all digits, one more above the critical level."""
    if width <= 0:
        raise ValueError("the bucket width must be positive")
    number = value.try_cast("long")
    tokens = F.concat(
        F.lit(f" BAC_{width}_"),
        bucket(number, width).cast("string"),
        F.lit(" BAC_VAL_"),
        number.cast("string"),
        F.when(number > critical, " CRITICAL_BAC").otherwise(""),
    )
    return F.concat(content, F.coalesce(F.when(value.rlike("^[0-9]+$"), tokens), F.lit("")))


def bucket(value: Column, width: float) -> Column:
    """Fixed-width bucket, truncated toward zero."""
    return (value / F.lit(width)).cast("long")


def gender(content: Column, code: Column) -> Column:
    token = F.when(code == 0, " GENDER_MALE").when(code == 1, " GENDER_FEMALE").otherwise("")
    return F.concat(content, token)


def race(content: Column, code: Column) -> Column:
    code = code.cast("string")
    known = F.when(code.rlike("^[0-9]+$"), F.concat(F.lit(" RACE_"), code))
    return F.concat(content, F.coalesce(known, F.lit(" UNKNOWN_RACE")))


def reading_mentions(content: Column, rules: ReadingRules = ReadingRules()) -> Column:
    """Append the status and value of the last reading found in the lines of the text.

    The first pattern that fits a line decides. The status carries over to later lines, and a line
    that fits without holding a number ends the search.
    """
    start = F.struct(
        F.lit(READING_UNKNOWN_TOKEN).alias("status"),
        F.lit(READING_UNKNOWN_TOKEN).alias("note"),
        F.lit(False).alias("done"),
    )

    def step(state: Column, line: Column) -> Column:
        mention = F.coalesce(
            *[F.when(line.rlike(p), F.regexp_extract(line, p, 0)) for p in rules.patterns]
        )
        return T.let(mention, lambda m: F.when(m.isNull(), state).otherwise(read(state, line, m)))

    def read(state: Column, line: Column, mention: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(line, r"\d+", 0), "^0+(?=.)", "")
        level = digits.try_cast("double")
        worded = (
            F.when(mention.rlike(rules.positive), READING_YES_TOKEN)
            .when(mention.rlike(rules.negative), READING_NO_TOKEN)
            .otherwise(state["status"])
        )
        status = F.when(
            (worded == READING_UNKNOWN_TOKEN) & level.isNotNull(),
            F.when(level == 0, READING_NO_TOKEN).otherwise(READING_YES_TOKEN),
        ).otherwise(worded)
        clash = ((status == READING_YES_TOKEN) & (level == 0)) | (
            (status == READING_NO_TOKEN) & (level > 0)
        )
        note = F.concat(
            status,
            F.lit(READING_VALUE_TOKEN),
            digits,
            F.when(level > rules.critical, READING_CRITICAL_TOKEN).otherwise(""),
            F.when(clash, READING_CLASH_TOKEN).otherwise(""),
        )
        done = state["done"]
        return F.struct(
            F.when(done, state["status"]).otherwise(status).alias("status"),
            F.when(done | level.isNull(), state["note"]).otherwise(note).alias("note"),
            (done | level.isNull()).alias("done"),
        )

    return F.concat(content, F.aggregate(T.lines(content), start, step)["note"])


def any_of(choices) -> str:
    return "|".join(f"({c})" for c in choices)


def usage_gate(content: Column, rules: ConsumptionRules = ConsumptionRules()) -> Column:
    """True when the text names both a beverage and a frequency."""
    return content.rlike(any_of(rules.strengths)) & content.rlike(any_of(rules.frequencies))


def _looked_up(line: Column, choices: Mapping[str, float]) -> Column:
    """Value of the first place in the line that fits any choice; null when none does."""
    found = F.regexp_extract(line, any_of(choices), 0)
    return T.let(found, lambda f: T.first_pattern(f, {p: float(v) for p, v in choices.items()}))


def quantity(line: Column, rules: ConsumptionRules = ConsumptionRules()) -> Column:
    """Ounces named in a line: an amount close before a container or beverage, times the container."""
    amount_re = r"\d+(?:[-/.]\d+)?"
    near = rf"{rules.article}|{amount_re}.{{0,3}}(?:{any_of(rules.sizes)}|{any_of(rules.strengths)})"

    def number(amount: Column) -> Column:
        first = F.regexp_extract(amount, r"^(\d+)", 1).try_cast("double")
        second = F.regexp_extract(amount, r"[-/](\d+)$", 1).try_cast("double")
        return (
            F.when(amount.contains("-"), (first + second) / 2)
            .when(amount.contains("/"), F.try_divide(first, second))
            .when(amount.rlike(r"^\d"), amount.try_cast("double"))
            .otherwise(1.0)
        )

    def ounces(found: Column) -> Column:
        amount = F.regexp_extract(found, rf"{rules.article}|{amount_re}", 0)
        container = F.coalesce(_looked_up(line, rules.sizes), F.lit(1.0))
        return F.when(found == "", 0.0).otherwise(T.let(amount, number) * container)

    return T.let(F.regexp_extract(line, near, 0), ounces)


# At most three characters, then at most five times a word and at most three more characters. Written
# so that only the last word can be given back: earlier words are taken whole and are followed by
# one to three characters that start and end outside a word.
UP_TO_FIVE_WORDS = r".{0,3}(?:\w++\W(?:.?\W)?){0,4}(?:\w+.{0,3})?"


def frequency(line: Column, rules: ConsumptionRules = ConsumptionRules()) -> Column:
    """Amount and word of how often: a number, a range or ``the`` before a frequency word."""
    amount_re = r"\d+(?:-\d)?"
    units = any_of(rules.frequencies)
    near = rf"the|{amount_re}{UP_TO_FIVE_WORDS}(?:{units})"

    def number(amount: Column) -> Column:
        low = F.regexp_extract(amount, r"^(\d+)", 1).try_cast("double")
        high = F.regexp_extract(amount, r"-(\d)$", 1).try_cast("double")
        mean = (low + high) / 2
        return (
            F.when(amount == "the", 1.0)
            .when(amount.contains("-"), F.when(mean == 0, 2.5).otherwise(mean))
            .otherwise(low)
        )

    def often(found: Column) -> Column:
        amount = F.regexp_extract(found, f"the|{amount_re}", 0)
        unit = F.regexp_extract(line, units, 0)
        return F.struct(
            F.when(found == "", 0.0).otherwise(T.let(amount, number)).alias("amount"),
            F.when((found != "") & (unit != ""), unit).alias("unit"),
        )

    return T.let(F.regexp_extract(line, near, 0), often)


def consumption_mentions(content: Column, rules: ConsumptionRules = ConsumptionRules()) -> Column:
    """Distinct (drinks, times, unit) of the lines that refer to usage at least twice."""
    groups = [any_of(rules.sizes), any_of(rules.frequencies), any_of(rules.strengths)]

    def hits(line: Column) -> Column:
        found = [F.size(F.regexp_extract_all(line, F.lit(g), F.lit(0))) for g in groups]
        return found[0] + found[1] + found[2]

    counted = F.transform(
        F.array_distinct(T.lines(content)),
        lambda line: F.struct(line.alias("line"), hits(line).alias("hits")),
    )
    parts = F.flatten(
        F.transform(
            F.filter(counted, lambda c: c["hits"] >= 2),
            lambda c: F.when(c["hits"] >= 4, F.split(c["line"], "and|,| {3,}", -1)).otherwise(
                F.array(c["line"])
            ),
        )
    )

    def mention(line: Column) -> Column:
        strength = F.coalesce(_looked_up(line, rules.strengths), F.lit(0.0))
        drinks = (quantity(line, rules) * (strength / 100) / 0.6).cast("long")
        return T.let(
            frequency(line, rules),
            lambda often: F.struct(
                drinks.alias("drinks"),
                often["amount"].cast("long").alias("times"),
                often["unit"].alias("unit"),
            ),
        )

    return F.array_distinct(F.transform(parts, mention))


def body_constants(
    gender_code: Column, weight: Column, weight_unit: Column, rules: ConsumptionRules
) -> tuple[Column, Column, Column]:
    """Body water share, metabolism and weight in kilograms of a patient."""
    male = F.coalesce(gender_code == 0, F.lit(False))
    water = F.when(male, rules.body_water_male).otherwise(rules.body_water_female)
    burn = F.when(male, rules.metabolism_male).otherwise(rules.metabolism_female)
    unit = F.coalesce(weight_unit, F.lit(""))
    stated = F.when(weight.cast("string").rlike("^[0-9]+$"), weight.try_cast("double"))
    stated = F.coalesce(stated, F.lit(0.0))
    converted = F.when(unit.contains("kg"), stated).when(unit.contains("lb"), stated * 0.45)
    kilos = F.when(converted >= 30, converted).otherwise(F.lit(float(rules.default_weight)))
    return water, burn, kilos


def weekly_factor(mention: Column, rules: ConsumptionRules) -> tuple[Column, Column]:
    """Whether a mention counts, and how often a week its frequency word stands for."""
    known = {p: float(v) for p, v in rules.frequencies.items()}
    counts = (mention["drinks"] > 0) & (mention["times"] > 0) & mention["unit"].isNotNull()
    return counts, F.coalesce(T.first_pattern(mention["unit"], known), F.lit(0.0))


def estimated_level(mention: Column, rules: ConsumptionRules) -> Column:
    """What a mention adds over a week: alcohol taken in, and how often it is broken down."""
    counts, per_week = weekly_factor(mention, rules)
    visits = F.when(counts, mention["times"] * per_week).otherwise(0.0)
    return F.struct(
        (F.lit(0.806) * mention["drinks"] * F.lit(1.2) * visits).alias("alcohol"),
        visits.alias("visits"),
    )


def weekly_total(
    mentions: Column,
    gender_code: Column,
    weight: Column,
    weight_unit: Column,
    rules: ConsumptionRules = ConsumptionRules(),
) -> Column:
    """Estimated blood alcohol of all mentions over a week, truncated to a whole number."""
    water, burn, kilos = body_constants(gender_code, weight, weight_unit, rules)

    def add(total: Column, mention: Column) -> Column:
        estimate = (
            (F.lit(0.806) * mention["drinks"] * F.lit(1.2)) / (water * kilos)
            - burn * F.lit(float(rules.drinking_hours))
        ) * 10 * 100
        counts, per_week = weekly_factor(mention, rules)
        return total + F.when(counts, estimate * mention["times"] * per_week).otherwise(0.0)

    return F.aggregate(mentions, F.lit(0.0), add).cast("long")


def weekly_consumption(
    content: Column,
    gender_code: Column,
    weight: Column,
    weight_unit: Column,
    rules: ConsumptionRules = ConsumptionRules(),
) -> Column:
    """Append the weekly consumption bucket and value; texts without usage lines stay as they are."""
    def described(mentions: Column) -> Column:
        total = weekly_total(mentions, gender_code, weight, weight_unit, rules)
        token = T.let(
            total,
            lambda t: F.concat(
                F.lit(f" W_CONS_{rules.bucket}_"),
                bucket(t, rules.bucket).cast("string"),
                F.lit(" W_CONS_VAL_"),
                t.cast("string"),
            ),
        )
        unreadable = F.exists(mentions, lambda m: m["drinks"].isNull())
        usable = (F.size(mentions) > 0) & ~unreadable
        return F.when(usable, F.concat(content, token)).otherwise(content)

    found = T.let(consumption_mentions(content, rules), described)
    return F.when(usage_gate(content, rules), found).otherwise(content)


RowFeature = Callable[[Column, PatientColumns], Column]

REGISTRY: dict[str, RowFeature] = {
    "bac_yn_add": lambda c, r: bac_yes_no(c, r.bac_yes_no),
    "bac_yn_only": lambda c, r: bac_yes_no_only(c, r.bac_yes_no),
    "bac_val_add": lambda c, r: bac_value(c, r.bac_value),
    "bac_all_add": lambda c, r: bac_value(bac_yes_no(c, r.bac_yes_no), r.bac_value),
    "gender_add": lambda c, r: gender(c, r.gender),
    "race_add": lambda c, r: race(c, r.race),
    "week_cons_add": lambda c, r: weekly_consumption(c, r.gender, r.weight, r.weight_unit),
    "lower_zap": lambda c, r: T.upper_tokens(c),
    "merge": lambda c, r: T.pad(c),
    "unique": lambda c, r: T.unique_lines(c),
    "bac_note_add": lambda c, r: reading_mentions(c),
}


def apply_chain(content: Column, row: PatientColumns, chain: str | Sequence[str | RowFeature]) -> Column:
    """Apply features in order; ``chain`` is ``a+b+c`` or a list of names and functions."""
    for step in chain.split("+") if isinstance(chain, str) else chain:
        if isinstance(step, str) and step not in REGISTRY:
            raise ValueError(f"unknown feature {step!r}; known: {sorted(REGISTRY)}")
        content = (REGISTRY[step] if isinstance(step, str) else step)(content, row)
    return content

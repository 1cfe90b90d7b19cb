"""Scalar, array and map functions over text (all built-in expressions)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the token, sentence and word splits must match to give the expected tokens.
TOKEN_PATTERN = r"-c\p{Nd}+(?![\p{L}\p{N}_])|[\p{L}\p{N}_]{2,}|[a-z0-9_]"
SENTENCE_BREAK = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"
WORD_BREAK = r"[\s;.]"
NOT_PRINTABLE = r"[^\x09-\x0d\x20-\x7e]"
EDGE_SPACE = r"^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` uses it.

    An expression used inside a lambda would otherwise be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove every kind of whitespace from both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unique_lines(text: Column) -> Column:
    """Stripped lines, first occurrence kept, joined again by line feeds."""
    return F.array_join(F.array_distinct(F.transform(lines(text), strip)), "\n")


def flat_unique_lines(text: Column) -> Column:
    """Distinct lines joined by single spaces."""
    return F.array_join(F.array_distinct(lines(text)), " ")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, NOT_PRINTABLE, "")


def upper_tokens(text: Column) -> Column:
    """Blank the words without an upper-case letter or with a lower-case one."""
    words = F.transform(
        F.split(text, " ", -1),
        lambda w: F.when(w.rlike("[A-Z]") & ~w.rlike("[a-z]"), w).otherwise(F.lit("")),
    )
    return F.regexp_replace(F.array_join(words, " "), r"\s{3,}", " ")


def pad(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def find_all(text: Column, pattern: str, index: int | None = None) -> Column:
    """Every full match as an array, or the match at ``index`` (null when there are none)."""
    import re

    if re.compile(pattern).match(""):
        raise ValueError(f"pattern {pattern!r} matches the empty string")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if index is None else F.get(found, F.lit(index))


def anchored(pattern: str) -> str:
    return f"^(?:{pattern})"


def first_pattern(text: Column, choices: Mapping[str, object] | Sequence[str]) -> Column:
    """Value of the first pattern that matches at the start; the pattern itself for a list."""
    pairs = choices.items() if isinstance(choices, Mapping) else [(p, p) for p in choices]
    return F.coalesce(
        *[F.when(text.rlike(anchored(p)), F.lit(v)) for p, v in pairs], F.lit(None)
    )


def parse_map(text: Column, item_sep: str = "&", key_sep: str = "=") -> Column:
    """``a=1&b`` to a map; an item with no or several separators gets a null; the last key wins."""
    items = F.split(text, _quoted(item_sep), -1)

    def latest(pairs: Column, keys: Column) -> Column:
        last = F.filter(
            pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p[0])
        )
        return F.map_from_arrays(
            F.transform(last, lambda p: p[0]),
            F.transform(last, lambda p: F.when(F.size(p) == 2, F.get(p, F.lit(1)))),
        )

    return let(
        F.transform(items, lambda i: F.split(i, _quoted(key_sep), -1)),
        lambda pairs: let(F.transform(pairs, lambda p: p[0]), lambda keys: latest(pairs, keys)),
    )


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def snake_case(name: Column) -> Column:
    wide = F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(wide, r"([a-z0-9])([A-Z])", "$1_$2"))


def one_hot(value: Column, classes: Sequence = (0, 1), hot=1, rest=0) -> Column:
    return F.array(*[F.when(value == F.lit(c), F.lit(hot)).otherwise(F.lit(rest)) for c in classes])


def sections(text: Column) -> Column:
    """Lines of a note: the sentences before each label, then the label as a header line.

    The text is cut at colon-space; the last piece after a double space of each part is its label.
    """
    parts = F.split(text, ": ", -1)

    def expand(part: Column) -> Column:
        pieces = F.split(part, "  ", -1)
        body = F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), "  ")
        label = F.concat(strip(F.element_at(pieces, -1)), F.lit(":"))
        return F.concat(sentences(body), F.array(label))

    return F.flatten(F.transform(parts, expand))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK, -1)


def words(text: Column) -> Column:
    return F.split(text, WORD_BREAK, -1)


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased word tokens; a concept id keeps its leading minus."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def without(items: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return items
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(items, lambda t: ~F.array_contains(stops, t))


def windows(items: Column, n: int, glue: str) -> Column:
    """Every run of ``n`` neighbouring items, joined by ``glue``; single lookups, no array copies."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts, lambda i: F.concat_ws(glue, *[F.get(items, i + place) for place in range(n)])
    )


def _all_windows(items: Column, low: int, high: int, glue: str) -> Column:
    made = [items if n == 1 else windows(items, n, glue) for n in range(low, high + 1)]
    return F.concat(*made) if len(made) > 1 else made[0]


def ngrams(items: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams with ``low <= n <= high``, words joined by a space."""
    return items if high == 1 else let(items, lambda w: _all_windows(w, low, high, " "))


def char_ngrams(text: Column, low: int, high: int, word_bounds: bool = False) -> Column:
    """Character n-grams, over the whole text or inside space-padded words."""
    flat = F.regexp_replace(F.lower(text), r"\s\s+", " ")

    def grams(part: Column) -> Column:
        characters = F.filter(F.split(part, ""), lambda c: c != "")
        return let(characters, lambda c: _all_windows(c, low, high, ""))

    if not word_bounds:
        return grams(flat)
    parts = F.filter(F.split(flat, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(parts, lambda w: grams(pad(w))))


def doc_id_of(path: Column) -> Column:
    """File name without its folder and ``.txt``."""
    return F.regexp_extract(path, r"([^/]+)\.txt$", 1)


def record_key(ident: Column) -> Column:
    """Up to the first dot, leading zeros removed."""
    return F.regexp_replace(F.substring_index(ident, ".", 1), "^0+", "")


def typed_literal(text: Column) -> Column:
    """Kind and value of a written argument: quoted string, float, int, bool, none or bare word."""
    quoted = text.rlike(r"""^(['"]).*\1$""")
    kind = (
        F.when(quoted, F.lit("string"))
        .when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit("float"))
        .when(text.rlike(r"^[+-]?\d+$"), F.lit("int"))
        .when(text.isin("True", "False"), F.lit("bool"))
        .when(text == "None", F.lit("none"))
        .otherwise(F.lit("string"))
    )
    value = (
        F.when(quoted, F.regexp_extract(text, r"""^(['"])(.*)\1$""", 2))
        .when(text == "None", F.lit(None))
        .otherwise(text)
    )
    return F.struct(
        kind.alias("kind"),
        value.alias("value"),
        F.when(kind.isin("float", "int"), text.try_cast("double")).alias("number"),
    )


def comma_free(text: Column) -> Column:
    return F.translate(text, ",", ";")


def checksum(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def set_bits(value: Column) -> Column:
    return F.bit_count(value)


def overlap(a: Column, b: Column) -> Column:
    """Number of shared members of two distinct-member arrays."""
    return F.size(F.array_intersect(a, b))

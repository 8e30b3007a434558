"""Column helpers shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any word occurs in the text; null text counts as no match.

    Plain substring tests, no regular expression. To ignore case, pass text
    and words in lower case, with the text lowered once in its own column.
    """
    hits = [text.contains(w) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def lower_all(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def number_or(c: Column | str, default: float = 0.0) -> Column:
    """Text to double; what does not parse becomes the default."""
    return F.coalesce(as_col(c).try_cast("double"), F.lit(float(default)))


def truthy(c: Column | str) -> Column:
    """Boolean stored as text: only 'true' in any case counts."""
    return F.coalesce(F.lower(F.trim(as_col(c).cast("string"))) == "true", F.lit(False))


def null_if_none_text(c: Column | str) -> Column:
    """The text 'None' stands for a missing value in stored files."""
    c = as_col(c)
    return F.when(c != "None", c)


def parse_mixed_timestamp(c: Column | str) -> Column:
    """Timestamps in mixed notations; bad input becomes null, never an error.

    The cast reads ISO text with 'T' or blank, with any number of fraction
    digits, and plain dates; the formats cover slashed and dotted dates.
    """
    c = F.trim(as_col(c))
    formats = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy.MM.dd HH:mm", "yyyy.MM.dd"]
    parsed = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(c.try_cast("timestamp"), *parsed)


def first_match(conditions: list[tuple[Column, str]], otherwise: str) -> Column:
    """Value of the first condition that holds."""
    out = F.when(conditions[0][0], conditions[0][1])
    for condition, value in conditions[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def classify(name: Column, classes: list[tuple[str, list[str]]], otherwise: str = "other") -> Column:
    """First class with a matching substring wins."""
    return first_match([(contains_any(name, words), label) for label, words in classes], otherwise)


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """Replace listed values and keep the others."""
    out = c
    for old, new in labels.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def strip_tags(html: Column) -> Column:
    """Tags to blanks, runs of white space to one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def code_point(number: Column) -> Column:
    """The character of a code point; null for a number that stands for none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def unescape_entities(text: Column) -> Column:
    """Character references as characters: the named ones of HTML 4, and decimal and hexadecimal numbers.

    Each distinct reference of a text is replaced once, '&amp;' last, so that nothing is decoded
    twice. What names no character stays.
    """
    names = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, " " if name == "nbsp" else chr(code))])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    found = F.filter(found, lambda e: e != "&amp;")

    def char(entity: Column) -> Column:
        body = F.substring(entity, 2, 12).substr(F.lit(1), F.char_length(entity) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 8)).cast("bigint")
        return F.coalesce(F.when(body.startswith("#"), code_point(number)).otherwise(F.try_element_at(names, body)), entity)

    out = F.aggregate(found, text, lambda t, e: F.replace(t, e, char(e)))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def text_lines(html: Column) -> Column:
    """Text nodes of a fragment, one per line, without empty lines."""
    lines = F.regexp_replace(unescape_entities(F.regexp_replace(html, "<[^>]+>", "\n")), r"[ \t\r\n]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(lines, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def year_near(anchor: Column, month: Column) -> Column:
    """Year of a month/day without year, seen from an anchor date.

    A December notice speaks of next January, a January notice of last
    December; otherwise the anchor's own year.
    """
    year = F.year(anchor)
    return (
        F.when((F.month(anchor) == 12) & (month == 1), year + 1)
        .when((F.month(anchor) == 1) & (month == 12), year - 1)
        .otherwise(year)
    )


def intraday_features(ts: Column) -> dict[str, Column]:
    """Hour of day and day of week, Monday 0."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts)}


def weekday_features(day: Column) -> dict[str, Column]:
    """Monday is 0; Wednesday is the weekly reset day."""
    weekday = F.weekday(day)
    return {
        "weekday": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "is_wednesday": (weekday == 2).cast("int"),
    }

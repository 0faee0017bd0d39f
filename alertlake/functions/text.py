"""Column expressions for text, lists, numbers and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake import dims

# Printable ASCII that neither starts nor ends with a blank. The end is \z: a dollar sign would also
# match before a final line break.
_PLAIN = r"^[!-~](?:[ -~]*[!-~])?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(dims.WHITESPACE))


def or_missing(c: Column, default: str = dims.MISSING) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def clean_text(c: Column, default: str = dims.MISSING) -> Column:
    """One visible line: breaks spelled out, control and direction marks blanked, trimmed.

    Printable ASCII without outer blanks is the common case and needs nothing.
    """
    visible = c
    for raw, shown in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        visible = F.replace(visible, F.lit(raw), F.lit(shown))
    cleaned = or_missing(strip(F.regexp_replace(visible, dims.HIDDEN_CHARS, " ")), default)
    return (
        F.when(c.isNull() | (c == ""), default).when(c.rlike(_PLAIN), c).otherwise(cleaned)
    )


def known(c: Column) -> Column:
    return c != dims.MISSING


def first_known(*cols: Column) -> Column:
    return F.coalesce(*[F.when(known(c), c) for c in cols], F.lit(dims.MISSING))


def distinct_texts(items: Column) -> Column:
    """Cleaned values of an array in first-seen order, without empty and missing ones."""
    cleaned = F.transform(items, lambda x: clean_text(x, ""))
    return F.array_distinct(F.filter(cleaned, lambda x: ~x.isin("", dims.MISSING)))


def joined(items: Column, sep: str = ", ", default: str = dims.MISSING) -> Column:
    return or_missing(F.array_join(items, sep), default)


def split_list(c: Column) -> Column:
    """Parts of a comma-joined text, trimmed, without the missing mark."""
    return F.filter(F.transform(F.split(c, ","), strip), known)


def whole_number(text: Column, default: int) -> Column:
    """Integer written as text; anything else gives the default."""
    digits = F.regexp_replace(strip(text), r"(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(default).cast("bigint"))


def clamp_level(level: Column) -> Column:
    return F.least(F.greatest(level, F.lit(0)), F.lit(16)).cast("int")


def known_user(name: Column) -> Column:
    """Cleaned account name, with parser left-overs such as "by" or "(null)" treated as missing."""
    placeholder = name.isNull() | F.lower(name).isin(dims.PLACEHOLDER_USERS)
    return F.when(placeholder, dims.MISSING).otherwise(name)


def log_user(log: Column) -> Column:
    """Account named in log text: first pattern that occurs decides."""
    first, second = (F.regexp_extract(log, p, 1) for p in dims.LOG_USER_PATTERNS)
    return let(first, lambda name: clean_text(F.when(name != "", name).otherwise(second)))


def formula_safe(c: Column) -> Column:
    """Quote cells a spreadsheet would run as a formula; the lone missing mark stays."""
    shown = F.ltrim(c, F.lit(dims.FORMULA_SKIP))
    return F.when(
        shown.rlike(dims.FORMULA_START) & (shown != dims.MISSING), F.concat(F.lit("'"), c)
    ).otherwise(c)


def duration_text(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    minutes = F.floor(s / 60)
    return (
        F.when(s < 60, F.format_string(dims.DURATION_SECONDS, s.cast("bigint")))
        .when(minutes < 60, F.format_string(dims.DURATION_MINUTES, minutes, (s % 60).cast("bigint")))
        .otherwise(F.format_string(dims.DURATION_HOURS, F.floor(minutes / 60), minutes % 60))
    )

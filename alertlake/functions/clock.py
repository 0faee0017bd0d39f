"""Event times: an instant in microseconds plus the offset it was written with.

Spark timestamps have no offset, but reports print each time in its own offset, so an
alert carries `event_us` (UTC instant, null if the text is no time) and `offset_s`.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake.functions.text import let, strip

_DATE = r"\d{4}-?\d{2}-?\d{2}|\d{4}-?W\d{2}(?:-?[1-7])?"
_CLOCK = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
_OFFSET = r"Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?"
_STAMP = rf"(?s)^({_DATE})(?:.({_CLOCK})({_OFFSET})?)?\z"
# The layout alert managers write; years and offsets every cast accepts.
_USUAL = (
    r"^(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}"
    r"(?:Z|[+-](?:0\d|1[0-4]):?(?:00|15|30|45))\z"
)
_DAY_US = 86_400_000_000


def _week_one(year: Column) -> Column:
    """Day number of the Monday of the year's first ISO week."""
    fourth = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")).try_cast("date")
    return F.unix_date(fourth) - F.weekday(fourth)


def _week_day(date: Column) -> Column:
    """Day number of an ISO-week date; null if the year has no such week."""
    plain = F.replace(date, F.lit("-"), F.lit(""))
    year = plain.substr(1, 4).try_cast("int")
    week = plain.substr(6, 2).try_cast("int")
    weekday = F.coalesce(F.nullif(plain.substr(8, 1), F.lit("")).try_cast("int"), F.lit(1))
    monday = _week_one(year) + (week - 1) * 7
    exists = (week >= 1) & (year.between(1, 9998)) & (monday < _week_one(year + 1))
    return F.when(exists, monday + weekday - 1)


def _day_number(date: Column) -> Column:
    """Days since 1970 of a calendar or ISO-week date; null if there is no such day."""
    dashed = F.concat_ws("-", date.substr(1, 4), date.substr(5, 2), date.substr(7, 2))
    calendar = F.when(F.contains(date, F.lit("-")), date).otherwise(dashed)
    return (
        F.when(date.startswith("0000"), None)
        .when(date.rlike(r"^\d{4}(?:-W\d{2}(?:-\d)?|W\d{2}\d?)\z"), _week_day(date))
        .when(date.rlike(r"^\d{4}(?:-\d{2}-\d{2}|\d{4})\z"), F.unix_date(calendar.try_cast("date")))
    )


def _two(digits: Column, at: int | Column) -> Column:
    return F.coalesce(F.substr(digits, F.lit(at) if isinstance(at, int) else at, F.lit(2)).try_cast("int"), F.lit(0))


def _clock_us(clock: Column) -> Column:
    def total(digits: Column) -> Column:
        h, m, s = _two(digits, 1), _two(digits, 3), _two(digits, 5)
        micros = F.coalesce(F.rpad(digits.substr(8, 6), 6, "0").try_cast("bigint"), F.lit(0))
        us = (h * 3600 + m * 60 + s).cast("bigint") * 1_000_000 + micros
        return F.when((h < 24) & (m < 60) & (s < 60), us)

    return let(F.replace(clock, F.lit(":"), F.lit("")), total)


def _offset_s(offset: Column) -> Column:
    def total(digits: Column) -> Column:
        h, m, s = _two(digits, 2), _two(digits, 4), _two(digits, 6)
        size = h * 3600 + m * 60 + s
        signed = F.when(digits.startswith("-"), -size).otherwise(size)
        return F.when((h < 24) & (m < 60) & (s < 60), signed)

    return F.when(offset.isin("", "Z"), 0).otherwise(
        let(F.replace(offset, F.lit(":"), F.lit("")), total)
    )


def parse_time(c: Column) -> Column:
    """ISO-8601 text to struct(event_us, offset_s); no offset means UTC; null if no time."""

    def parts(text: Column) -> Column:
        date, clock, offset = (F.regexp_extract(text, _STAMP, i) for i in (1, 2, 3))
        return F.struct(
            (_day_number(date).cast("bigint") * _DAY_US + _clock_us(clock)).alias("local_us"),
            _offset_s(offset).alias("offset_s"),
        )

    def instant(p: Column) -> Column:
        us = p["local_us"] - p["offset_s"].cast("bigint") * 1_000_000
        return F.when(
            us.isNotNull(), F.struct(us.alias("event_us"), p["offset_s"].alias("offset_s"))
        )

    usual = c.substr(24, 6)
    sign = F.when(usual.startswith("-"), -60).otherwise(60)
    minutes = _two(usual, 2) * 60 + _two(usual, F.when(F.contains(usual, F.lit(":")), 5).otherwise(4))
    quick = F.struct(
        F.unix_micros(c.try_cast("timestamp")).alias("event_us"),
        F.when(usual == "Z", 0).otherwise(sign * minutes).alias("offset_s"),
    )
    return F.when(c.rlike(_USUAL), quick).otherwise(let(let(strip(c), parts), instant))


def offset_text(offset_s: Column) -> Column:
    size = F.abs(offset_s)
    text = F.concat(
        F.when(offset_s < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 3600).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.floor(size / 60) % 60).cast("string"), 2, "0"),
    )
    seconds = F.lpad((size % 60).cast("string"), 2, "0")
    return F.when(size % 60 == 0, text).otherwise(F.concat(text, F.lit(":"), seconds))


def _local(event_us: Column, offset_s: Column) -> Column:
    return F.timestamp_micros(event_us + offset_s.cast("bigint") * 1_000_000)


def iso_text(event_us: Column, offset_s: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """Time in its own offset, cut (not rounded) to the pattern's unit."""
    return F.concat(F.date_format(_local(event_us, offset_s), pattern), offset_text(offset_s))


def seen_text(event_us: Column, offset_s: Column, timestamp: Column) -> Column:
    """Second-exact time, or the raw text where it is no time."""
    return F.coalesce(iso_text(event_us, offset_s), timestamp)


def whole_seconds(us: Column) -> Column:
    """Microseconds to seconds for spans that are never negative."""
    return F.floor(us / F.lit(1_000_000)).cast("bigint")


def zone_offset(event_us: Column, zone: str) -> Column | None:
    """Offset in seconds of a display zone at an instant; None keeps the input offset."""
    name = zone.strip()
    if name.lower() == "input":
        return None
    if name.upper() in ("UTC", "Z"):
        return F.lit(0)
    fixed = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", name)
    if fixed:
        hours, minutes = int(fixed[2]), int(fixed[3])
        if hours > 23 or minutes > 59:
            raise ValueError(f"invalid UTC offset: {zone}")
        return F.lit((hours * 3600 + minutes * 60) * (-1 if fixed[1] == "-" else 1))
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as error:
        raise ValueError(f"unknown time zone: {zone}") from error
    utc = F.timestamp_micros(event_us)
    return F.timestamp_diff("SECOND", utc, F.from_utc_timestamp(utc, name)).cast("int")


def filter_bound(text: str | None) -> int | None:
    """A since/until parameter as a UTC instant in microseconds."""
    if not text:
        return None
    try:
        moment = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as error:
        raise ValueError(f"invalid ISO-8601 time: {text}") from error
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    span = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (span.days * 86_400 + span.seconds) * 1_000_000 + span.microseconds

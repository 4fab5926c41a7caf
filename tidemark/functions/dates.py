"""Date columns. Each returns a UTC timestamp, null for anything that does not match; none ever guesses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, let

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _spaced(c: Column) -> Column:
    """Cleaned, with one blank before AM or PM, which then is in capitals."""
    return F.regexp_replace(F.regexp_replace(clean(c), r"(?i)\s*am$", " AM"), r"(?i)\s*pm$", " PM")


def _parse(c: Column, shape: str, pattern: str) -> Column:
    """The text is computed once: it is both tested and parsed."""
    return let(c, lambda x: F.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(pattern))))


def dash_seconds(c: Column) -> Column:
    """DD-MM-YYYY HH:MM:SS."""
    return _parse(clean(c), r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$", "d-M-yyyy H:mm:ss")


def dash_minutes(c: Column) -> Column:
    """DD-MM-YYYY HH:MM."""
    return _parse(clean(c), r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$", "d-M-yyyy H:mm")


def dash_half_day(c: Column) -> Column:
    """DD-MM-YYYY h:mm AM/PM."""
    return _parse(_spaced(c), r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2} [AP]M$", "d-M-yyyy h:mm a")


def slash_half_day(c: Column) -> Column:
    """DD/MM/YYYY hh:mm AM/PM."""
    return _parse(_spaced(c), r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "d/M/yyyy h:mm a")


def slash_minutes(c: Column) -> Column:
    """DD/MM/YYYY with or without HH:MM."""
    return let(clean(c), lambda x: F.coalesce(_parse(x, r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"), _parse(x, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy")))


def iso(c: Column) -> Column:
    """ISO 8601; a bare number is not a date."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(F.trim(c)))


def month_name(c: Column, strict: bool = False) -> Column:
    """DD-Mon-YYYY with or without hh:mm AM/PM; unless ``strict``, ISO text too."""
    part = lambda x, i: F.regexp_extract(x, r"^(\d{1,2}-)([A-Za-z]{3})(-.*)$", i)
    named = lambda x: F.when(x.rlike(r"^\d{1,2}-[A-Za-z]{3}-"), F.concat(part(x, 1), F.initcap(F.lower(part(x, 2))), part(x, 3)))
    parsed = lambda x: F.coalesce(_parse(x, r"^\d{1,2}-[A-Z][a-z]{2}-\d{4} \d{1,2}:\d{2} [AP]M$", "d-MMM-yyyy h:mm a"), _parse(x, r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"))
    found = let(let(_spaced(c), named), parsed)
    return found if strict else F.coalesce(found, iso(c))


def split_without_year(month: Column, day: Column, time: Column, as_of: Column) -> Column:
    """Month name, day and time: in the year of ``as_of``, or in the next if that is over 24 hours before it."""
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.trim(month), 1, 3)))
    told = F.struct(number.alias("month"), F.trim(day).alias("day"), _spaced(time).alias("clock"))
    at = lambda x, year: F.when(
        (x["month"] > 0) & x["day"].rlike(r"^\d{1,2}$") & x["clock"].rlike(r"^\d{1,2}:\d{2} [AP]M$"),
        F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", x["day"], x["month"].cast("string"), year.cast("string")), x["clock"]), F.lit("d-M-yyyy h:mm a")),
    )
    late = lambda x, this: F.when(this < as_of - F.expr("interval 1 day"), at(x, F.year(as_of) + 1)).otherwise(this)
    return let(told, lambda x: let(at(x, F.year(as_of)), lambda this: late(x, this)))


def any_format(c: Column) -> Column:
    """The first that matches of the slash, dash and month name forms."""
    return F.coalesce(slash_minutes(c), dash_half_day(c), month_name(c))


def epoch_millis(c: Column) -> Column:
    """Milliseconds since 1970; zero and null are no date."""
    return F.when(c != 0, F.timestamp_millis(c))

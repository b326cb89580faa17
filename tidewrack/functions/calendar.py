"""Calendar expressions: date ranges in short form, week anchors and period context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the days from Monday on.
DAYS = ["월", "화", "수", "목", "금", "토", "일"]


def date_range(text: Column, page_year: Column, box: Column) -> Column:
    """struct(start, end) of one or two MM.DD in a text; null without one or for an impossible day.

    December in the first box of a page belongs to the year before; an end month before
    the start month belongs to the year after the start.
    """
    found = F.regexp_extract_all(text, F.lit(r"(\d{2}\.\d{2})"), F.lit(1))
    part = lambda x, k: F.try_element_at(F.split(x, r"\."), F.lit(k)).try_cast("int")
    first, last = F.try_element_at(found, F.lit(1)), F.coalesce(F.try_element_at(found, F.lit(2)), F.try_element_at(found, F.lit(1)))
    year = page_year - F.when((part(first, 1) == 12) & (box == 0), 1).otherwise(0)
    until = year + F.when(part(last, 1) < part(first, 1), 1).otherwise(0)
    day = lambda y, x: F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, part(x, 1), part(x, 2)), F.lit("yyyy-MM-dd")))
    start, end = day(year, first), day(until, last)
    return F.when((F.size(found) > 0) & start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def week_context(day: Column) -> Column:
    """One line with the day, its name, and the first and last days of its week and of the next."""
    monday = F.trunc(day, "WEEK")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    name = F.element_at(F.array(*(F.lit(d) for d in DAYS)), F.weekday(day) + 1)
    return F.concat(iso(day), F.lit(" ("), name, F.lit(") "), iso(monday), F.lit("~"), iso(F.date_add(monday, 6)), F.lit(" "), iso(F.date_add(monday, 7)), F.lit("~"), iso(F.date_add(monday, 13)))


def last_workday_before(day: Column) -> Column:
    """The day before, or the Friday before if that falls on a weekend."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))

"""Menus: dates and halls that a question means, and the text of menu records."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .calendar import DAYS
from .text import price

#: Words for days, and their distance from today.
DAY_WORDS = {"내일모레": 2, "오늘": 0, "금일": 0, "내일": 1, "명일": 1, "모레": 2, "어제": -1}
#: Words for weeks, and the distance of their Monday from this week's.
WEEK_WORDS = {r"이번\s*주": 0, r"다음\s*주|담주": 7, r"지난\s*주": -7}
#: Characters between which a single letter means a day of the week.
BETWEEN = set(" \t\r\n,，.·~/부터까지이랑와과및")
#: Numbers of the student halls, and letters after which a number counts terms or years; the hall without a number.
NUMBERS, COUNTING, SCIENCE = (1, 2, 3, 4), "기년", "생활과학대학"
#: Halls by the text that names them in a question; the first that fits counts.
HALLS = {f"제{n}학생회관": rf"{n}\s*학(?![{COUNTING}])" for n in NUMBERS} | {SCIENCE: r"생활\s*과학"}
#: Halls that post a menu each day, in order of print.
DAILY_HALLS = ["제2학생회관", "제3학생회관", "제4학생회관", "생활과학대학"]
#: Meals and how they are printed; audiences; both in order of print.
MEALS = {"조식": "아침", "중식": "점심", "석식": "저녁"}
AUDIENCES = ["직원", "학생"]
CLOSED = "운영안함"
#: A question gets as many dates at most.
MOST_DATES = 5


#: What the scan tells apart, tried in this order at each place; the rest goes by one character.
_TOKENS = {
    "iso": r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})",
    "month_day": r"(?P<m2>\d{1,2})월\s*(?P<d2>\d{1,2})일",
    "day_only": r"(?<!\d)(?P<d3>\d{1,2})일(?!\s*요일)",
    "near": "|".join(DAY_WORDS),
    **{f"week{k}": p for k, p in enumerate(WEEK_WORDS)},
    "workdays": "평일|주중",
    "weekend": "주말",
    "weekly": r"주간\s*(?:식단|메뉴)",
    "weekday": f"[{''.join(DAYS)}]요일",
    "letter": f"[{''.join(DAYS)}]",
    "to": "[~～]",
    "since": "부터",
    "until": "까지",
    "blank": r"\s+",
    "number": r"\d+",
    "other": ".",
}
_SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _TOKENS.items()), re.S)
#: Tokens that leave a gap, beside which a single letter stands alone.
_GAPS = frozenset(("date", "near", "workdays", "weekday", "blank"))


def _tokens(text: str, today: date):
    """(kind, value, text) of each part of a question; a date that doesn't exist is a number and what follows."""
    at = 0
    while at < len(text):
        m = _SCAN.match(text, at)
        kind, g = m.lastgroup, m.groupdict()
        if kind in ("iso", "month_day", "day_only"):
            try:
                yield "date", date(int(g["y"] or today.year), int(g["m"] or g["m2"] or today.month), int(g["d"] or g["d2"] or g["d3"])), m[0]
            except ValueError:
                m = re.compile(r"\d+").match(text, at)
                yield "number", None, m[0]
        elif kind.startswith("week") and kind[4:].isdigit():
            yield "week", list(WEEK_WORDS.values())[int(kind[4:])], m[0]
            if text[m.end() : m.end() + 1] == "말":
                yield "weekend", None, ""
        else:
            value = today + timedelta(DAY_WORDS[m[0]]) if kind == "near" else DAYS.index(m[0][0]) if kind in ("weekday", "letter") else None
            yield kind, value, m[0]
        at = m.end()


def _named_days(read: list[tuple], loose: bool) -> set[int]:
    """Days of the week that tokens name: each full name, single letters (all if loose, else those that stand alone), and ranges."""
    out: set[int] = set()
    beside = lambda t: t is None or t[0] in _GAPS or t[2] == "" or t[2][-1] in BETWEEN
    named = []
    for k, (kind, value, said) in enumerate(read):
        before, after = (read[k - 1] if k else None), (read[k + 1] if k + 1 < len(read) else None)
        month = said == DAYS[0] and before is not None and before[2][-1:].isdigit() and before[0] != "date"
        if kind == "weekday" or (kind == "letter" and not month and (loose or (beside(before) and (after is None or after[0] in _GAPS or after[2][:1] in BETWEEN)))):
            out.add(value)
        if kind != "blank":
            named.append((kind if not (kind == "letter" and month) else "other", value))
    for k, (kind, first) in enumerate(named):
        shape = [x for x, _ in named[k : k + 4]]
        if kind in ("weekday", "letter") and len(shape) > 2 and shape[2] in ("weekday", "letter") and (shape[1] == "to" or (shape[1] == "since" and shape[3:] == ["until"])):
            out |= {(first + d) % 7 for d in range((named[k + 2][1] - first) % 7 + 1)}
    return out


def dates_of(question: str | None, today: date) -> list[str] | None:
    """ISO dates that a question means, five at most; null without any.

    One scan tells the question's parts apart.  Explicit dates go before day words, those
    before days of the week and weekends, and those before whole weeks, which mean Monday
    to Friday.  The first week word holds; days of the week after a second one don't
    count.  Null and empty questions mean nothing.
    """
    parts = list(_tokens(question or "", today))
    weeks = [k for k, (kind, _, _) in enumerate(parts) if kind == "week"]
    read = parts[: weeks[1]] if len(weeks) > 1 else parts
    kinds = {kind for kind, _, _ in read}
    monday = today - timedelta(today.weekday()) + timedelta(parts[weeks[0]][1] if weeks else 0)
    days = _named_days(read, bool(weeks)) | ({5, 6} if "weekend" in kinds else set())
    if not days and kinds & {"week", "workdays", "weekly"}:
        days = set(range(5))
    found = next((x for k in ("date", "near") if (x := [value for kind, value, _ in parts if kind == k])), [monday + timedelta(d) for d in days])
    return [d.isoformat() for d in sorted(set(found))[:MOST_DATES]] or None


def menu_dates(question: Column, as_of: str) -> Column:
    """``dates_of`` on a column; what a letter means depends on what stands around it, which no SQL function follows."""
    today = date.fromisoformat(as_of)

    @F.pandas_udf(ArrayType(StringType()))
    def found(q: pd.Series) -> pd.Series:
        return q.map(lambda x: dates_of(x, today))

    return found(question)


def hall_of(question: Column) -> Column:
    """The hall that a question names, else null, which means all of them."""
    return F.coalesce(*(F.when(question.rlike(p), name) for name, p in HALLS.items()))


def lines_of(text: Column) -> Column:
    """Lines with white space collapsed, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def menu_label(text: Column, name: Column, cost: Column) -> Column:
    """The name, else the first line, with its price; empty for a blank text."""
    head = F.coalesce(F.nullif(name, F.lit("")), F.try_element_at(lines_of(text), F.lit(1)), F.lit(""))
    # a price in brackets ends the label
    last = F.substring_index(head, "(", -1)
    sum_ = F.substring(last, F.lit(1), F.greatest(F.length(last) - 1, F.lit(0)))
    bracketed = F.endswith(head, F.lit(")")) & (F.instr(head, "(") > 1) & (F.length(sum_) > 0) & (F.translate(sum_, "0123456789,", "") == "")
    inner = F.concat(F.trim(F.substring(head, F.lit(1), F.length(head) - F.length(sum_) - 2)), F.lit(" "), price(sum_))
    return F.when(F.size(lines_of(text)) < 1, "").when(bracketed, inner).when(F.coalesce(cost, F.lit("")) != "", F.concat(F.trim(head), F.lit(" "), price(cost))).otherwise(head)


def menu_items(text: Column) -> Column:
    """The lines after the first."""
    return F.coalesce(F.slice(lines_of(text), 2, 1_000_000), F.array().cast("array<string>"))


def meal_name(meal: Column) -> Column:
    return F.coalesce(*(F.when(meal == k, v) for k, v in MEALS.items()), meal)


def menu_line(meal: Column, audience: Column, text: Column, name: Column, cost: Column) -> Column:
    """One printed line: meal, audience, label and items."""
    label, items = menu_label(text, name, cost), menu_items(text)
    start = F.concat(F.lit("- "), meal_name(meal), F.lit("("), audience, F.lit(")"))
    listed = F.array_join(items, ", ")
    return F.when((label != "") & (F.size(items) > 0), F.concat(start, F.lit(" "), label, F.lit(": "), listed)).when(label != "", F.concat(start, F.lit(" "), label)).otherwise(F.concat(start, F.lit(": "), listed))


def posted(hall: Column, text: Column) -> Column:
    """Whether a record is printed: a daily hall, some text, not the closed mark."""
    return hall.isin(DAILY_HALLS) & (F.trim(text) != "") & (F.replace(F.trim(text), F.lit(" ")) != CLOSED)


def place_in(value: Column, names: list[str]) -> Column:
    """The place of a value in a fixed order from 1 on; 99 if it isn't there."""
    return F.coalesce(*(F.when(value == n, k) for k, n in enumerate(names, 1)), F.lit(99))


def day_title(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" ("), F.element_at(F.array(*(F.lit(d) for d in DAYS)), F.weekday(day) + 1), F.lit(")"))

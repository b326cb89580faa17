"""Answers of the live tools over fetched pages: menus, academic calendar, registered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import campus as P
from ..functions import menus as M
from ..functions import text as T
from .menus import compact_text, daily_text

#: Printed where a day has no menu, and the heading of several days.
NO_MENU, WEEK_HEAD = "의 식단 정보가 없습니다.", "# 주간 학생식당 식단"
#: Characters of a registered page, and most days of a menu request.
PAGE_CHARS, MOST_DAYS = 3000, 5
#: Fixed value: the tool's name.
PAGE_TOOL = "fetch_page_text"


def menu_records(pages: DataFrame, hall: str | None = None) -> DataFrame:
    """Menu records of ``pages`` (day, html), of one hall or of those that post a menu each day."""
    rows = pages.select("day", F.explode(P.live_menus(F.col("html"))).alias("r")).select("day", "r.*")
    return rows.where(F.col("hall") == hall) if hall else rows.where(F.col("hall").isin(M.DAILY_HALLS))


def day_menus(asked: DataFrame, records: DataFrame) -> DataFrame:
    """day, text: the day's menu; where all is closed, the closed lines; else a fixed text.  ``asked`` (day)."""
    there = records.where(F.trim("menu_text") != "")
    open_ = daily_text(there.where(M.posted(F.col("hall"), F.col("menu_text"))))
    shut = daily_text(there.where(F.col("hall").isin(M.DAILY_HALLS)).join(open_.select("day"), "day", "left_anti"))
    found = open_.unionByName(shut)
    return asked.join(found, "day", "left").select("day", F.coalesce("menu", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(NO_MENU))).alias("text"))


def several_days(asked: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, text of requests ``asked`` (key, days as an array of dates): each day once, five at most.

    Two days are printed in full, more with the first dish of each meal only.
    """
    cut = asked.select(key, F.array_distinct(F.slice("days", 1, MOST_DAYS)).alias("days"))
    each = cut.select(key, F.size("days").alias("n"), F.posexplode("days").alias("at", "day"))
    posted = records.where(M.posted(F.col("hall"), F.col("menu_text")))
    texts = daily_text(posted).join(compact_text(posted).withColumnRenamed("menu", "short"), "day")
    rows = each.join(texts, "day", "left")
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("t"))))), lambda x: x["t"]), sep)
    made = rows.groupBy(key, "n").agg(joined("menu", "\n\n").alias("full"), joined("short", "\n\n").alias("compact"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "day"))), lambda x: F.date_format(x["day"], "yyyy-MM-dd")), ", ").alias("named"))
    body = F.when(F.col("n") <= 2, F.col("full")).otherwise(F.trim(F.concat(F.lit(f"{WEEK_HEAD}\n\n"), F.col("compact"))))
    return made.select(key, F.when((F.col("n") <= 2) & (F.col("full") == ""), F.concat(F.col("named"), F.lit(NO_MENU))).otherwise(F.rtrim(body, F.lit("\n"))).alias("text"))


def active_halls(records: DataFrame) -> DataFrame:
    """day, halls: those with a printed record, in their fixed order."""
    found = records.where(M.posted(F.col("hall"), F.col("menu_text"))).groupBy("day").agg(F.collect_set("hall").alias("s"))
    return found.select("day", F.filter(F.array(*(F.lit(h) for h in M.DAILY_HALLS)), lambda h: F.array_contains("s", h)).alias("halls"))


def default_months(today: Column) -> Column:
    return F.array(F.month(today), F.month(F.add_months(F.trunc(today, "MM"), 1)))


def short_days(text: Column) -> Column:
    """Days without their weekday in brackets and without spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"\([^)]+\)", ""), T.SPACE + "+", "")


def month_lines(pages: DataFrame, key: str, months: Column) -> DataFrame:
    """key, text: the calendar lines of ``pages`` (key, html) that touch the months, in the page's order.

    A box of another month is left out, and so is a line none of whose days is in the months.
    """
    rows = pages.select(key, months.alias("_m"), F.posexplode(P.calendar_lines(F.col("html"))).alias("at", "x"))
    days = short_days(F.col("x.days"))
    touched = F.transform(F.regexp_extract_all(days, F.lit(r"(\d{2})\.\d{2}"), F.lit(1)), lambda m: m.cast("int"))
    kept = rows.where((F.col("x.month").isNull() | F.array_contains("_m", F.col("x.month"))) & F.arrays_overlap(touched, "_m"))
    line = F.concat(F.lit("["), days, F.lit("] "), F.col("x.event"))
    # a page's lines, which were one row before
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def calendar_evidence(pages: DataFrame, key: str, today: Column, month: int | None = None) -> DataFrame:
    """key, text: today's date and the lines of a month, or of this month and the next; pages without a line give none."""
    found = month_lines(pages, key, F.array(F.lit(int(month))) if month else default_months(today))
    return found.select(key, F.concat(F.lit("오늘: "), F.date_format(today, "yyyy-MM-dd"), F.lit(" (한국 표준시)\n"), "text").alias("text"))


def page_evidence(pages: DataFrame, registry: DataFrame, by: str = "url") -> DataFrame:
    """id, source_id, title, text, url, metadata of the registered pages among ``pages`` (url, html).

    ``by``: the column by which pages meet their sources.  An address that is registered under
    several sources gives its pages to each of them; pages (source_id, url, html) that were
    fetched for a source meet it alone by "source_id".

    registry: source_id, url, title.  The text is the page's main part between navigation and
    footer, from the title on; other pages and empty ones give none.
    """
    if by not in ("url", "source_id"):
        raise ValueError("pages meet their sources by url or source_id")
    own = registry.where(F.col(by).isNotNull()).select(by, *(c for c in ("source_id", "title") if c != by))
    read = pages.join(own, by)
    text = F.rtrim(F.substring(T.body_text(T.main_text(F.col("html")), F.coalesce("title", F.lit(""))), 1, PAGE_CHARS))
    about = F.create_map(F.lit("tool"), F.lit(PAGE_TOOL), F.lit("source_id"), F.col("source_id"))
    return read.select(F.concat(F.lit("live_page_"), "source_id").alias("id"), "source_id", "title", text.alias("text"), "url", about.alias("metadata")).where("text <> ''")


def internal_name(value: Column, names: dict[str, str]) -> Column:
    """The internal name of a displayed one, after aliases; a name that isn't displayed is internal already."""
    if not names:
        return F.trim(value)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.trim(value)), F.trim(value))


def requested_board(value: Column, names: dict[str, str], aliases: dict[str, str]) -> Column:
    """struct(board, alias): the board that a request means, and the alias by which it named it; both null for a blank one.

    names: displayed to internal; aliases: internal names that stand for others.
    """
    named = internal_name(value, names)
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    meant = F.try_element_at(table, named)
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    return F.struct(F.when(~blank, F.coalesce(meant, named)).alias("board"), F.when(~blank & meant.isNotNull(), named).alias("alias"))

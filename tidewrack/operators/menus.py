"""Menu records (day, hall, meal, audience, menu_text, menu_name, price) to printed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import menus as M


def first_records(records: DataFrame, order: Column) -> DataFrame:
    """One posted record of each day, hall, meal and audience, the first by ``order``: an aggregation, combined before its shuffle."""
    kept = records.where(M.posted(F.col("hall"), F.col("menu_text")))
    rest = F.struct("menu_text", "menu_name", "price")
    return kept.groupBy("day", "hall", "meal", "audience").agg(F.min_by(rest, order).alias("r")).select("day", "hall", "meal", "audience", "r.*")


def _joined(rows: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), between)


def _placed(records: DataFrame, line: Column) -> DataFrame:
    order = (M.place_in(F.col("hall"), M.DAILY_HALLS).alias("h"), M.place_in(F.col("meal"), list(M.MEALS)).alias("m"), M.place_in(F.col("audience"), M.AUDIENCES).alias("a"))
    return records.select("day", "hall", *order, line.alias("line"))


def daily_text(records: DataFrame) -> DataFrame:
    """day, menu: a heading for each hall with its lines by meal and audience.

    A day holds a record for each hall, meal and audience at most (see ``first_records``),
    so what is collected is bounded.
    """
    line = M.menu_line(F.col("meal"), F.col("audience"), F.col("menu_text"), F.col("menu_name"), F.col("price"))
    halls = _placed(records, line).groupBy("day", "h", "hall").agg(_joined(F.struct("m", "a", "line"), "\n").alias("line"))
    blocks = halls.withColumn("line", F.concat(F.lit("## "), F.col("hall"), F.lit("\n"), F.col("line")))
    days = blocks.groupBy("day").agg(_joined(F.struct("h", "line"), "\n\n").alias("body"))
    title = M.day_title(F.col("day"))
    return days.select("day", F.concat(F.lit("# "), title, F.lit(" 학생식당 식단\n\n"), title, F.lit(" 학식 메뉴입니다.\n\n"), F.col("body")).alias("menu"))


def compact_text(records: DataFrame) -> DataFrame:
    """day, menu: a line for each hall with the first item of each meal, as weekly texts print it."""
    items = M.menu_items(F.col("menu_text"))
    first = F.coalesce(F.try_element_at(items, F.lit(1)), M.menu_label(F.col("menu_text"), F.col("menu_name"), F.col("price")))
    line = F.concat(M.meal_name(F.col("meal")), F.lit("("), F.col("audience"), F.lit(") "), first)
    halls = _placed(records, line).groupBy("day", "h", "hall").agg(_joined(F.struct("m", "a", "line"), " / ").alias("line"))
    lines = halls.withColumn("line", F.concat(F.lit("- "), F.col("hall"), F.lit(": "), F.col("line")))
    days = lines.groupBy("day").agg(_joined(F.struct("h", "line"), "\n").alias("body"))
    return days.select("day", F.concat(F.lit("## "), M.day_title(F.col("day")), F.lit("\n"), F.col("body")).alias("menu"))


def schedule_grid(rows: DataFrame, hall: str, meal: str, meals: list[str], audience: str) -> DataFrame:
    """A row for each hall and a column for each meal with its sorted audiences; empty where there are none."""
    found = rows.groupBy(hall).pivot(meal, meals).agg(F.array_join(F.array_sort(F.collect_set(audience)), ", "))
    return found.select(hall, *(F.coalesce(F.col(f"`{m}`"), F.lit("")).alias(m) for m in meals))

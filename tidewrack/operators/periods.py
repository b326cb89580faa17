"""Named periods of a calendar as a table: which one a day is in, and what questions and prompts say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import months_covered

#: The word of a term, the one of terms between terms, and words for a term's last and first day.
TERM, SHORT_TERM, LAST_DAY, FIRST_DAY = "학기", "계절학기", ("종강", "종료"), "개강"


def period_at(df: DataFrame, day: str, periods: DataFrame) -> DataFrame:
    """Adds period (label, start, end): the first by ord of the periods that hold the day, null in a gap.

    periods: label, start, end, ord; both ends belong to a period, and one that ends before it
    starts holds no day.  Days meet the months that a period touches, each day once, so
    neither table is held whole anywhere; of equal ords the earliest start, then the label counts.
    """
    held = periods.where(F.col("start") <= F.col("end")).select("ord", F.struct("label", "start", "end").alias("period"), F.explode(months_covered(F.col("start"), F.col("end"))).alias("month"))
    days = df.where(F.col(day).isNotNull()).select(F.col(day).cast("date").alias("_day")).distinct()
    met = days.join(held, F.trunc("_day", "MM") == F.col("month")).where(F.col("_day").between(F.col("period.start"), F.col("period.end")))
    first = met.groupBy("_day").agg(F.min_by("period", F.struct("ord", "period.start", "period.label")).alias("period"))
    return df.join(first, F.col(day).cast("date") == F.col("_day"), "left").drop("_day")


def boundary_dates(question: Column, period: Column) -> Column:
    """The month and the ISO date of the first or last day of the period that a question asks for; an array.

    A question needs the word of a term and a word for one of its ends; one on terms between
    terms gets nothing, nor does a day without a period.  The last day goes first.  What the
    question holds is left out.
    """
    def told(day: Column) -> Column:
        return F.array(F.concat(F.year(day).cast("string"), F.lit("년 "), F.month(day).cast("string"), F.lit("월")), F.date_format(day, "yyyy-MM-dd"))

    has = lambda word: F.contains(question, F.lit(word))
    none = F.array().cast("array<string>")
    asked = has(TERM) & ~has(SHORT_TERM) & period.isNotNull()
    last = F.when(has(LAST_DAY[0]) | has(LAST_DAY[1]), told(period["end"])).otherwise(none)
    both = F.concat(last, F.when(has(FIRST_DAY), told(period["start"])).otherwise(none))
    return F.when(F.coalesce(asked, F.lit(False)), F.filter(F.array_distinct(both), lambda x: ~F.contains(question, x))).otherwise(none)


def temporal_context(day: Column, label: Column) -> Column:
    """Lines of a prompt: the period's label if there is one, this week and the next with their workdays."""
    monday = F.trunc(day, "WEEK")
    at = lambda n, form="yyyy-MM-dd": F.date_format(F.date_add(monday, n), form)

    def week(first: int) -> list[Column]:
        return [at(first), F.lit("(월) ~ "), at(first + 6), F.lit("(일), 평일 "), at(first, "MM-dd"), F.lit("~"), at(first + 4, "MM-dd")]

    weeks = F.concat(F.lit("이번 주: "), *week(0), F.lit("\n다음 주: "), *week(7), F.lit(", 주말 "), at(12, "MM-dd"), F.lit("~"), at(13, "MM-dd"))
    return F.when(F.coalesce(label, F.lit("")) == "", weeks).otherwise(F.concat(F.lit("현재 기간: "), label, F.lit("\n"), weeks))

"""First-wins, per-group and interval operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def per_group_limit(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def conflicts(df: DataFrame, keys: list, value: str, order: list) -> DataFrame:
    """For each key: rows, duplicates (equal to the first row's value) and conflicts (others)."""
    first = F.min_by(value, F.struct(*order))
    best = df.groupBy(*keys).agg(first.alias("first"))
    same = F.col(value).eqNullSafe(F.col("first"))
    return df.join(best, keys).groupBy(*keys).agg(F.count("*").alias("rows"), (F.count_if(same) - 1).alias("duplicates"), F.count_if(~same).alias("conflicts"))


def carry_forward(df: DataFrame, value: str, by: list, order: list, to: str) -> DataFrame:
    """The last value that isn't null, down the rows of a group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def representatives_then_fill(df: DataFrame, group: str, newest: list, n: int) -> DataFrame:
    """The newest row of each group, then the newest of all, n together and newest first.

    The newest n of all are among the newest n of their groups, and these are found before
    anything is shuffled, so a group's size doesn't matter.
    """
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*newest))).where(F.col("_place") <= n)
    return placed.orderBy(F.col("_place") > 1, *newest).limit(n).drop("_place").orderBy(*newest)


def months_covered(start: Column, end: Column) -> Column:
    """First days of the months that an interval touches."""
    return F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("INTERVAL 1 MONTH"))


def period_of(df: DataFrame, day: Column, periods: DataFrame) -> DataFrame:
    """Adds the label of the first period (by ord) that holds the day; null without one.

    ``periods`` (label, start, end, ord) is a configuration table of a few rows.
    """
    every = periods.agg(F.array_sort(F.collect_list(F.struct("ord", "label", "start", "end"))).alias("_periods"))
    fits = F.filter("_periods", lambda p: (day >= p["start"]) & (day <= p["end"]))
    return df.join(F.broadcast(every)).withColumn("period", F.try_element_at(fits, F.lit(1))["label"]).drop("_periods")


def first_stage(df: DataFrame, stage: str, order: list, n: int) -> DataFrame:
    """The first n rows of the lowest stage that has any: one top-n by stage, cut to the stage of its first row."""
    best = df.orderBy(stage, *order).limit(n)
    return best.withColumn("_least", F.min(stage).over(Window.partitionBy(F.lit(0)))).where(F.col(stage) == F.col("_least")).drop("_least")


def merge(indexes: list[DataFrame]) -> DataFrame:
    """Indexes one after the other with the place of each as ``ord``; columns that one lacks are null."""
    out = indexes[0].withColumn("ord", F.lit(0))
    for k, df in enumerate(indexes[1:], 1):
        out = out.unionByName(df.withColumn("ord", F.lit(k)), allowMissingColumns=True)
    return out


def month_documents(spans: DataFrame, after: str) -> DataFrame:
    """id, text, events: one document for each month that some span (name, start, end) touches, its spans in order."""
    month = F.col("month")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    line = F.concat(F.lit("- "), iso("start"), F.when(F.col("start") == F.col("end"), "").otherwise(F.concat(F.lit(" ~ "), iso("end"))), F.lit(": "), F.col("name"))
    rows = spans.withColumn("month", F.explode(months_covered(F.col("start"), F.col("end")))).withColumn("line", line)
    months = rows.groupBy(month).agg(F.array_sort(F.collect_list(F.struct("start", "end", "name", "line"))).alias("all"), F.count("*").alias("events"))
    head = F.concat(F.year(month).cast("string"), F.lit("년 "), F.month(month).cast("string"), F.lit(f"월{after}\n\n"))
    return months.select(F.concat(F.lit("calendar_month_"), F.date_format(month, "yyyy_MM")).alias("id"), F.concat(head, F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("text"), "events")


#: Most rows of a list that names are held against.
MOST_NAMES = 10_000


def contained(df: DataFrame, key: str, name: Column, listed: DataFrame, value: str, order: str) -> DataFrame:
    """key and the first value (by order) of a short list that the name holds or that holds the name; others go.

    The list is sent to all tasks, so its length is checked; each row keeps its best match
    before anything is shuffled.
    """
    n = listed.limit(MOST_NAMES + 1).count()
    if n > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    few = listed.select(F.col(order).alias("_o"), F.col(value).alias(value))
    met = df.select(key, name.alias("_name")).join(F.broadcast(few), F.contains("_name", value) | F.contains(value, "_name"))
    return met.groupBy(key).agg(F.min_by(value, "_o").alias(value))

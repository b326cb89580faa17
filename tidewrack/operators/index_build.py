"""Builds an index in versions: one pass writes the rows, checks them and counts what the report says.

A version is there once its report is: rows whose checks failed, or whose build ended
early, stay out of sight.  Readers take the latest version that has a report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class BuildRefused(ValueError):
    """Rows of a build failed its checks; ``counts`` tells how many failed which."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(f"rows failed checks: {counts}")
        self.counts = counts


#: Rows of a notice index that are refused.
def notice_checks() -> dict[str, Column]:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return {"empty_text": blank("text"), "empty_date": blank("date"), "empty_id": blank("id")}


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The reports of all versions; None without one."""
    try:
        return spark.read.json(f"{path}/report")
    except AnalysisException:
        return None


def latest(spark: SparkSession, path: str) -> int | None:
    reports = versions(spark, path)
    return None if reports is None else reports.agg(F.max("version")).first()[0]


def build(rows: DataFrame, path: str, order: Sequence[str | Column], checks: dict[str, Column] | None = None, counts: dict[str, Column] | None = None) -> dict:
    """Write the next version of an index and its report; returns the report.

    Each file is in ``order``.  ``checks`` mark rows that must not be there, ``counts`` are
    aggregates for the report; both are taken while the rows are written, so the rows are
    made once.  If a check finds a row, the version gets no report and ``BuildRefused`` is raised.
    """
    spark, checks, counts = rows.sparkSession, checks or {}, counts or {}
    number = (latest(spark, path) or 0) + 1
    seen = Observation()
    taken = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"bad_{n}") for n, c in checks.items()), *(c.alias(n) for n, c in counts.items())]
    # observed behind the order, so that no sampling for it counts a row twice
    sorted_ = rows.sortWithinPartitions(*order).observe(seen, *taken)
    sorted_.write.mode("overwrite").parquet(f"{path}/index/version={number}")
    found = seen.get
    bad = {n: found[f"bad_{n}"] for n in checks if found[f"bad_{n}"]}
    if bad:
        raise BuildRefused(bad)
    report = {"version": number, **{n: found[n] for n in ("rows", *counts)}}
    spark.createDataFrame([report]).coalesce(1).write.mode("append").json(f"{path}/report")
    return report


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is named; ValueError if it isn't there."""
    reports = versions(spark, path)
    wanted = latest(spark, path) if version is None else version
    if reports is None or not reports.where(F.col("version") == wanted).take(1):
        raise ValueError(f"no version {wanted} under {path}")
    return spark.read.parquet(f"{path}/index/version={wanted}")

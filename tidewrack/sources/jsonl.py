"""JSON-lines and JSON-array sources and sinks of documents, questions and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id STRING, text STRING, title STRING, domain STRING, source_url STRING, source_name STRING, metadata MAP<STRING, STRING>"
TRACE = "ts STRING, source STRING, question STRING, answer STRING, doc_ids ARRAY<STRING>, doc_scores ARRAY<DOUBLE>, tools_called ARRAY<STRING>, mode STRING, latency_ms BIGINT, error STRING, type STRING, rating STRING, comment STRING"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a line that is no JSON object fails the read; blank lines are skipped, unknown keys ignored.

    Rows need an id and a text; the first without one fails when rows are read.
    """
    df = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col("id").isNull() | F.col("text").isNull(), F.raise_error(F.lit("a document needs an id and a text"))).otherwise(F.col("text"))
    return df.withColumn("text", checked).withColumn("title", F.coalesce("title", F.lit("")))


def health(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant: total, invalid, duplicate, empty, without source name and without source url."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), F.try_parse_json("value").isNull().alias("broken")).select("broken", "d.*")
    valid = ~F.col("broken") & F.col("id").isNotNull() & F.col("text").isNotNull()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return parsed.agg(
        F.count_if(valid).alias("total"), F.count_if(~valid).alias("invalid"), (F.count_if(valid) - F.count_distinct(F.when(valid, F.col("id")))).alias("duplicate"),
        F.count_if(valid & blank("text")).alias("empty"), F.count_if(valid & blank("source_name")).alias("no_source_name"), F.count_if(valid & blank("source_url")).alias("no_source_url"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with user or question, in order."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<struct<user: string, question: string>>")).alias("index", "x"))
    return rows.select("index", F.coalesce(F.nullif("x.user", F.lit("")), F.nullif("x.question", F.lit("")), F.lit("")).alias("question"))


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_trace(df: DataFrame, path: str) -> None:
    """Turns and feedback share a log; feedback has type = feedback."""
    df.write.mode("append").json(path)

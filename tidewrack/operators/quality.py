"""Retrieval and classification measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_rates(ranked: DataFrame, qid: str, relevant: str, ks: tuple[int, ...]) -> DataFrame:
    """queries and hit@k: the share of queries with a relevant row among the first k."""
    each = ranked.groupBy(qid).agg(*(F.max(((F.col("rank") <= k) & F.col(relevant)).cast("int")).alias(f"hit_{k}") for k in ks))
    return each.agg(F.count("*").alias("queries"), *(F.round(F.avg(f"hit_{k}"), 6).alias(f"hit_at_{k}") for k in ks))


def f1_by_label(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each label that is true or predicted somewhere."""
    rows = df.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    sums = rows.groupBy("label").agg(F.count_if(F.col("t") == F.col("label")).alias("support"), F.count_if(F.col("p") == F.col("label")).alias("said"), F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("both"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("said") > 0, 2 * F.col("both") / (F.col("support") + F.col("said"))).otherwise(0.0)
    return sums.select("label", "support", F.round(rate("both", "said"), 6).alias("precision"), F.round(rate("both", "support"), 6).alias("recall"), F.round(f1, 6).alias("f1"))

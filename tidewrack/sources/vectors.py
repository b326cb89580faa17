"""Embeddings kept as Parquet by corpus and model, made only where they aren't there yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_key(docs: DataFrame) -> str:
    """A digest of all ids, titles and texts that doesn't depend on their order, and their number."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct("id", "title", "text")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    row = docs.agg(F.count("*").alias("n"), F.sum(one).alias("s")).first()
    return f"{int(row.s or 0):032x}"[-32:] + f"-{row.n}"


def cached_vectors(docs: DataFrame, folder: str, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, vector of the documents; ``embed`` is asked, and its result written, only for a corpus or a model that is new.

    A table counts only if it holds a vector for each document.
    """
    spark = docs.sparkSession
    path = f"{folder}/corpus={corpus_key(docs)}/model={model.replace('/', '_')}"
    try:
        kept = spark.read.parquet(path)
        if kept.select("id").distinct().count() == docs.select("id").distinct().count():
            return kept.select("id", "vector")
    except Exception:  # noqa: BLE001 - a table that can't be read is made again
        pass
    embed(docs).select("id", "vector").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("id", "vector")

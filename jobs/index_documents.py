"""Keeps the inverted index of a growing table of documents.

Each run takes the files that came since the last one, as a stream that ends when all of
them are in: the stream's checkpoint remembers which were taken.  A document whose key is
in the index is left out, so the first text of a key stays; within the files of one batch
it is the least text.  Rows without a key are left out.  The postings of a batch lie in
the batch's own folders, and a batch that is taken again after a failure replaces them.

    python jobs/index_documents.py --config jobs/index_documents.json --documents D --out O

Under O: postings (Parquet by batch and bucket of the term), checkpoint.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.cli import log, main
from tidewrack.functions.text import TOKEN
from tidewrack.operators import postings as P
from tidewrack.runtime import as_pattern

SETTINGS = {"key": str, "text": str, "pattern": str, "slice_docs": int, "files_per_batch": int}


def index_of(spark: SparkSession, out: str) -> DataFrame | None:
    """The index under ``out``; None before a document is in it."""
    try:
        return P.read(spark, f"{out}/postings")
    except AnalysisException:
        return None


def run(spark: SparkSession, documents: str, out: str, key: str = "doc_id", text: str = "text", pattern: str = TOKEN, slice_docs: int = P.SLICE_DOCS, files_per_batch: int = 1000) -> int:
    """Take what is new, and return the number of documents added."""
    schema = spark.read.parquet(documents).schema
    counts: dict[int, int] = {}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.count()
        new = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.min(text).alias("text"))
        index = index_of(session, out)
        if index is not None:
            known = P.documents(index.where(F.col("batch") < number)).select(F.col("key").alias("doc_id"))
            new = new.join(known, "doc_id", "left_anti")
        P.add(new, f"{out}/postings", number, "doc_id", "text", pattern, slice_docs, n=rows)
        made = index_of(session, out)
        counts[number] = 0 if made is None else int(made.where(f"bucket = -1 AND batch = {number}").agg(F.sum("docs")).first()[0] or 0)
        log.info("batch %d: read %d rows, added %d documents to %s/postings", number, rows, counts[number], out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(documents))
    query = stream.select(key, text).writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("index_documents: read %s in %d batches, added %d documents", documents, len(counts), sum(counts.values()))
    return sum(counts.values())


if __name__ == "__main__":
    raise SystemExit(main(run, ["documents", "out"], SETTINGS))

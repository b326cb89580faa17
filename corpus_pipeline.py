"""A training corpus in five stages: quality, near duplicates, leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets what
it wrote as Parquet.  All but the last return the columns they got.  Stages bear null
texts (read as empty, kept null), null keys, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import line_crf, lsa_search, minhash_join, pii, spm_codec
from tidewrack.llm.arrow_text import quoted
from tidewrack.llm.store import keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line field scores at 0.5 or more; one of exactly 0.5 stays.

    The field is fitted on all labelled rows that aren't held out.  A null or empty text gets
    their share of good ones, repeated rows get equal verdicts, texts are scored whole, and an
    empty table stays empty.
    """
    field = line_crf.learn(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    inner = docs.select(*(quoted(c).alias(f"in_{c}") for c in names))
    return line_crf.score(inner, field, text="in_text").where("predicted = 1").select(*(quoted(f"in_{c}").alias(c) for c in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate class, once.

    Classes go by their root: a doc_id, or null, that stands for several texts can be the id of several.
    """
    names = docs.columns
    member = minhash_join.group(docs.select("doc_id", "text"))
    first = member.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("root", F.col("rep").alias("k_id")).agg(F.min("digest").alias("k_digest")).select("k_id", "k_digest")
    own = "k_own"
    while own in names:
        own += "_"
    keyed = docs.withColumn(own, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = keyed.join(first, keyed.doc_id.eqNullSafe(first.k_id) & (keyed[own] == first.k_digest), "left_semi")
    return found.dropDuplicates(["doc_id", own]).select(*map(quoted, names))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item, each row of a repeated one.

    Null and empty texts leak nothing; whole texts are searched; of several items that a text
    leaks one is enough, so ties don't matter.  Empty tables on either side drop nothing.
    """
    return lsa_search.without_leaks(docs, table(spark, sf_dir, "benchmark"), lsa_search.fit(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars, which must be there, follows the text.

    A null text stays null with its n_chars; repeated rows change alike, whole texts are
    read, and ties between spans go as ``pii.detect`` says.  An empty table stays empty.
    """
    out = pii.redact(docs, pii.learn())
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*map(quoted, docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_chunks, round_trip of each document."""
    return spm_codec.encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("private_data", private_data), ("token_ids", token_ids)]
#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{name}")
    return docs

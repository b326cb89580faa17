"""The jobs as queries: each runs twice into one new folder and returns what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answer_batch, index_documents
from tidewrack.plans.registry import Registry
from tidewrack.runtime import run_folder

register = Registry()
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[0-9A-Za-z가-힣]+')"


@register(f"""SELECT doc_id, term, CAST(count(*) AS INT) AS tf, CAST(n AS INT) AS length FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM
(SELECT doc_id, {_TOKENS.format("min(text)")} AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)) GROUP BY doc_id, term, n""")
def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all documents."""
    out = run_folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", out)
    index = index_documents.index_of(spark, out)
    if index is None:
        return spark.createDataFrame([], "doc_id long, term string, tf int, length int")
    held = index.where("bucket >= 0").select("term", F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("d"))
    return held.select(F.col("d.keys").alias("doc_id"), "term", F.col("d.tfs").alias("tf"), F.col("d.lengths").alias("length"))


@register(f"""WITH c AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0),
d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT conv_id, term, count(*) AS times FROM (SELECT conv_id, unnest({_TOKENS.format("question")}) AS term FROM c) GROUP BY ALL),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT conv_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rank, max(score) OVER (PARTITION BY conv_id) AS top FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, doc_id) QUALIFY rank <= 4),
e AS (SELECT r.*, source, z, '[' || rank || '] ' || source || chr(10) || CASE WHEN length(z) <= 500 THEN z ELSE rtrim(substr(z, 1, 499)) || '...' END AS block,
  CASE WHEN z = '' THEN '{answer_batch.NO_TEXT}' WHEN strpos(z, '.') BETWEEN 1 AND 180 THEN substr(z, 1, strpos(z, '.')) WHEN length(z) <= 180 THEN z ELSE rtrim(substr(z, 1, 179)) || '...' END || ' (source: ' || source || ')' AS fact
  FROM r JOIN (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS z FROM documents) USING (doc_id) WHERE score >= 0.4 * top),
p AS (SELECT conv_id, max(score) AS score, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS evidence, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids, arg_min(fact, rank) AS fact FROM e GROUP BY 1)
SELECT conv_id, question, coalesce(fact, '{answer_batch.NOTHING}') AS answer, coalesce(evidence, '') AS evidence, coalesce(doc_ids, '') AS doc_ids, score, CASE WHEN fact IS NULL THEN '{answer_batch.EMPTY}' ELSE '{answer_batch.FOUND}' END AS mode FROM c LEFT JOIN p USING (conv_id)""")
def job2_answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all chats."""
    out = run_folder(spark, "job2")
    for _ in range(2):
        answer_batch.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", out)
    return answer_batch.written(spark, out)

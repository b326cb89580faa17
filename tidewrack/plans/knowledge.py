"""Registered queries over the knowledge base: domains, back ends, evidence, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as W
from ..operators import router
from .registry import Registry, table, texts

register = Registry()
K = 4

_TOK = "regexp_extract_all(lower({}), '[0-9A-Za-z가-힣]+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the knowledge base has them: a domain for some, metadata for all, an id with a prefix."""
    k = F.col("doc_id")
    meta = F.create_map(F.lit("domain"), F.col("lang"), F.lit("label"), F.concat(F.lit("L"), F.col("source")), F.lit("n"), k.cast("string"))
    id_ = F.concat(F.when(k % 10 == 0, "Spec-").otherwise("doc_"), F.format_string("%08d", k))
    return texts(spark, sf_dir).select(id_.alias("id"), F.col("lang").alias("title"), "text", F.when(k % 2 == 0, F.col("source")).otherwise("").alias("domain"), meta.alias("metadata"), F.lit(None).cast("string").alias("source_url"), F.col("source").alias("source_name"), "doc_id")


def _base(where: str) -> str:
    return f"""x AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'Spec-' ELSE 'doc_' END || format('{{:08d}}', doc_id) AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS own FROM documents),
y AS (SELECT * FROM x WHERE {where}),
d AS (SELECT id, {_TOK.format("lang || ' ' || text")} AS t FROM y), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT item_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL),
f AS (SELECT item_id, id, coalesce(score, 0) AS score FROM (SELECT item_id FROM benchmark) CROSS JOIN (SELECT id FROM y) LEFT JOIN b USING (item_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= {K})"""


@register(f"""WITH {_base("own <> 'src3' AND (lower(lang) = 'spec' OR lower('L' || source) = 'spec' OR id LIKE 'Spec-%')")}
SELECT item_id, r.rank, r.score, id, lang AS title, 'search_knowledge_base' AS tool, 'SPEC' AS domain, CAST(doc_id AS VARCHAR) AS n FROM r JOIN y USING (id)""")
def kb_search_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of one domain, named by the ids' prefix; another domain is left out."""
    found = W.search_knowledge_base(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), K, "SPEC", {"src3"})
    return found.select("item_id", "rank", "score", "id", "title", F.col("metadata")["tool"].alias("tool"), F.col("metadata")["domain"].alias("domain"), F.col("metadata")["n"].alias("n"))


@register(f"""WITH {_base("lower('L' || source) = 'lsrc3'")} SELECT item_id, rank, score, id FROM r""")
def kb_search_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain that is left out of general search, asked for by its label: the rule is lifted."""
    return W.search_knowledge_base(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), K, "Lsrc3", {"Lsrc3", "src3"}).select("item_id", "rank", "score", "id")


@register(f"""WITH {_base("own NOT IN ('src1', 'en', 'de') AND lang = 'es'")} SELECT item_id, rank, score, id FROM r""")
def bm25_fills_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of one language: documents of score 0 fill the rankings of items that find few, the least ids first."""
    return W.retrieve(_docs(spark, sf_dir).where("lang = 'es'"), table(spark, sf_dir, "benchmark"), K, left_out=["src1", "en", "de"]).select("item_id", "rank", "score", "id")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    docs = _docs(spark, sf_dir).select("id", "doc_id").join(v, F.col("doc_id") == F.col("vec_id")).select("id", "vector")
    asked = table(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select("item_id", "text", "vector")
    return docs, asked


_DENSE = f"""n AS (SELECT item_id, id, round(list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM benchmark JOIN embeddings c ON c.vec_id = item_id, y JOIN embeddings a ON a.vec_id = doc_id),
v AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM n QUALIFY rank <= {K})"""
_SCALED = "CASE WHEN {0} IS NULL OR max({0}) OVER w - min({0}) OVER w < 1e-12 THEN 0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@register(f"""WITH {_base("own <> 'src3'")}, {_DENSE}, a AS (SELECT r.* FROM r WHERE item_id IN (SELECT vec_id FROM embeddings)),
j AS (SELECT coalesce(a.item_id, v.item_id) AS item_id, coalesce(a.id, v.id) AS id, a.score AS p, v.score AS o FROM a FULL JOIN v ON a.item_id = v.item_id AND a.id = v.id),
h AS (SELECT item_id, id, round(0.5 * {_SCALED.format("p")} + 0.5 * {_SCALED.format("o")}, 6) AS score FROM j WINDOW w AS (PARTITION BY item_id))
SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= {K}""")
def hybrid_bm25_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half BM25 over title and text, half dot product, each scaled within its list."""
    vectors, asked = _vectors(spark, sf_dir)
    return W.retrieve(_docs(spark, sf_dir), asked, K, "hybrid", vectors, {"src3"})


@register(f"""WITH {_base("own <> 'src3'")}, {_DENSE} SELECT item_id, count(*) || CASE WHEN count(*) = 1 THEN ' document' ELSE ' documents' END || ' (best score ' || regexp_replace(regexp_replace(format('{{:.10f}}', round(arg_min(score, rank), 5 - CAST(floor(log10(greatest(abs(arg_min(score, rank)), 1e-4))) AS INT))), '0+$', ''), '\\.$', '') || ')' AS summary FROM v GROUP BY item_id""")
def retrieval_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return W.best_score(W.retrieve(_docs(spark, sf_dir), asked, K, "dense", vectors, {"src3"}), "item_id")


def _router(spark: SparkSession) -> router.Model:
    from .catalog import _BIAS, _MODEL

    return router.model_of(spark.createDataFrame([(m[0], m[1]) for m in _MODEL], "term string, idf double"), spark.createDataFrame([(m[0], c, m[2 + c]) for m in _MODEL for c in range(3)], "term string, class int, weight double"), spark.createDataFrame(_BIAS, "class int, bias double"))


@register("__ROUTER__")
def router_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best class of each item is before the second."""
    made = W.margin(router.scores(table(spark, sf_dir, "benchmark"), _router(spark), "item_id", "text"), "item_id")
    return made.select("item_id", F.round("margin", 5).alias("margin"))

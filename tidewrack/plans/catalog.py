"""The registered queries of the retrieval and corpus operators, with their SQL.

Each runs over its whole tables.  Searches take the benchmark items, or every vector
whose id is divisible by 100, as their stated query set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import markup as M
from ..functions import text as T
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import retrieval as S
from ..operators import router
from ..operators import scoring as X
from . import builds, knowledge, notices, records, service, training
from .registry import Query, Registry, clean_sql, dealt, texts
from .registry import table as _table

FLAGSHIP = "hybrid_topk"
K = 4
AS_OF = "2026-06-13"
_register = Registry()

_TOK = "regexp_extract_all(lower({}), '[0-9A-Za-z가-힣]+')"
_BM25 = f"""
d AS (SELECT doc_id, {_TOK.format("text")} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL)"""
_LEX = f"""
qt AS (SELECT DISTINCT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark),
dt AS (SELECT DISTINCT doc_id, unnest({_TOK.format("source || ' ' || lang")}) AS term, 3 AS w FROM documents
  UNION ALL SELECT doc_id, term, 1 FROM (SELECT DISTINCT doc_id, unnest({_TOK.format("text")}) AS term FROM documents)),
lx AS (SELECT item_id, doc_id, CAST(sum(w) AS DOUBLE) AS score FROM dt JOIN qt USING (term) GROUP BY ALL)"""
_TOP = "(SELECT *, CAST(row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {k}) AS INT) AS rank FROM {f} QUALIFY rank <= {n})"


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bm25_top(texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"), K)


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).withColumn("title", F.concat_ws(" ", "source", "lang"))
    return X.lexical_top(docs, _table(spark, sf_dir, "benchmark"), K, "title")


def _asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return X.dense_top(v, _asked(v), K, "vec_id", "query_id")


_DENSE = "dn AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)"


@_register(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("item_id", "doc_id", "score", "rank")


@_register(f"WITH {_LEX} SELECT item_id, doc_id, score, rank FROM {_TOP.format(q='item_id', k='doc_id', f='lx', n=K)}")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("item_id", "doc_id", "score", "rank")


@_register(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM {_TOP.format(q='query_id', k='vec_id', f='dn', n=K)}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "vec_id", "score", "rank")


@_register(f"""WITH {_BM25}, {_LEX}, a AS {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)}, b AS {_TOP.format(q='item_id', k='doc_id', f='lx', n=K)},
j AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.score AS x, b.score AS y FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
m AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM j WINDOW w AS (PARTITION BY item_id)),
h AS (SELECT item_id, doc_id, round(0.5 * CASE WHEN x IS NULL OR x1 - x0 < 1e-12 THEN 0 ELSE (x - x0) / (x1 - x0) END + 0.5 * CASE WHEN y IS NULL OR y1 - y0 < 1e-12 THEN 0 ELSE (y - y0) / (y1 - y0) END, 6) AS score FROM m)
SELECT item_id, doc_id, score, rank FROM {_TOP.format(q='item_id', k='doc_id', f='h', n=K)}""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hybrid(_bm25(spark, sf_dir), _lexical(spark, sf_dir), "item_id", "doc_id", K).select("item_id", "doc_id", "score", "rank")


@_register(f"""WITH {_BM25}, r AS {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)},
f AS (SELECT *, score >= 0.4 * max(score) OVER (PARTITION BY item_id) AS ok, count(*) OVER (PARTITION BY item_id) AS n FROM r),
g AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY item_id) AS kept FROM f)
SELECT item_id, doc_id, score, CAST(n - kept AS BIGINT) AS hidden FROM g WHERE ok""")
def relative_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.relative_filter(_bm25(spark, sf_dir), "item_id").select("item_id", "doc_id", "score", F.col("hidden").cast("long").alias("hidden"))


@_register(f"""WITH {_BM25}, r AS {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)},
e AS (SELECT item_id, rank, '[' || rank || '] ' || source || chr(10) || c.t AS block FROM r JOIN documents USING (doc_id),
  LATERAL (SELECT CASE WHEN length(z) <= 500 THEN z ELSE rtrim(substr(z, 1, 499)) || '...' END AS t FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS z)) c)
SELECT item_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS evidence FROM e GROUP BY item_id""")
def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit("\n"), T.clip(F.col("text"), 500))
    rows = _bm25(spark, sf_dir).join(docs, "doc_id").select("item_id", "rank", block.alias("block"))
    return rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("evidence"))


@_register(f"WITH {_BM25.replace('FROM documents)', 'FROM documents WHERE source IS NULL OR source <> ' + chr(39) + 'src0' + chr(39) + ')')} SELECT item_id, doc_id, score, rank FROM {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)}")
def bm25_topk_domain_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics cover the documents that the filter leaves."""
    docs = texts(spark, sf_dir).where(F.col("source").isNull() | (F.col("source") != "src0"))
    return X.bm25_top(docs, _table(spark, sf_dir, "benchmark"), K)


_RANKED = f"{_BM25}, r AS {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)}"
_FACT = "CASE WHEN z = '' THEN 'No text.' WHEN strpos(z, '.') BETWEEN 1 AND 180 THEN substr(z, 1, strpos(z, '.')) WHEN length(z) <= 180 THEN z ELSE rtrim(substr(z, 1, 179)) || '...' END"


@_register(f"""WITH {_RANKED}, b AS (SELECT item_id, source, (SELECT {_FACT} FROM (SELECT trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS z)) AS fact FROM r JOIN documents d USING (doc_id) WHERE rank = 1)
SELECT item_id, coalesce(fact || ' (source: ' || source || ')', 'No evidence was found.') AS answer, CASE WHEN fact IS NULL THEN 'empty' ELSE 'fallback' END AS mode FROM benchmark LEFT JOIN b USING (item_id)""")
def fallback_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fact of the best document as the answer; a fixed text without one."""
    fact = T.first_fact(F.col("text"), "No text.")
    best = _bm25(spark, sf_dir).where("rank = 1").join(_table(spark, sf_dir, "documents"), "doc_id").select("item_id", F.concat(fact, F.lit(" (source: "), F.col("source"), F.lit(")")).alias("fact"))
    rows = _table(spark, sf_dir, "benchmark").select("item_id").join(best, "item_id", "left")
    return rows.select("item_id", F.coalesce("fact", F.lit("No evidence was found.")).alias("answer"), F.when(F.col("fact").isNull(), "empty").otherwise("fallback").alias("mode"))


@_register(f"""WITH {_RANKED}, e AS (SELECT item_id, string_agg('[' || rank || '] ' || lang || ' ' || doc_id || chr(10) || 'source: ' || source || chr(10) || (SELECT CASE WHEN length(z) <= 200 THEN z ELSE rtrim(substr(z, 1, 199)) || '...' END FROM (SELECT trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS z)), chr(10) || chr(10) ORDER BY rank) AS pack FROM r JOIN documents d USING (doc_id) GROUP BY 1)
SELECT item_id, 'Time: {AS_OF}' || chr(10) || 'Question: ' || text || chr(10) || 'Evidence:' || chr(10) || coalesce(pack, 'No evidence was retrieved from the workspace.') AS prompt FROM benchmark LEFT JOIN e USING (item_id)""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question with its numbered evidence, or a fixed text where there is none."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"), F.lit("\nsource: "), F.col("source"), F.lit("\n"), T.clip(F.col("text"), 200))
    rows = _bm25(spark, sf_dir).join(_table(spark, sf_dir, "documents"), "doc_id").select("item_id", "rank", block.alias("block"))
    packs = rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("pack"))
    asked = _table(spark, sf_dir, "benchmark").join(packs, "item_id", "left")
    return asked.select("item_id", F.concat(F.lit(f"Time: {AS_OF}\nQuestion: "), F.col("text"), F.lit("\nEvidence:\n"), F.coalesce("pack", F.lit("No evidence was retrieved from the workspace."))).alias("prompt"))


@_register(f"""WITH {_RANKED} SELECT item_id, rank AS place, doc_id, score, lang FROM r JOIN documents USING (doc_id) WHERE source IS NULL OR source <> 'src1'""")
def rehydrated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged id and score lists back to documents; ids that are no longer there go, and keep their place."""
    log = _bm25(spark, sf_dir).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("found"))
    left = _table(spark, sf_dir, "documents").where(F.col("source").isNull() | (F.col("source") != "src1")).select("doc_id", "lang")
    rows = log.select("item_id", F.posexplode("found").alias("at", "x")).select("item_id", (F.col("at") + 1).alias("place"), "x.doc_id", "x.score")
    return rows.join(left, "doc_id").select("item_id", "place", "doc_id", "score", "lang")


@_register(f"""WITH {_DENSE}, r AS {_TOP.format(q='query_id', k='vec_id', f='dn', n=K)},
e AS (SELECT query_id, max(CAST(rank <= 1 AND a.label = b.label AS INT)) AS h1, max(CAST(a.label = b.label AS INT)) AS h4
  FROM r JOIN embeddings a ON a.vec_id = r.vec_id JOIN embeddings b ON b.vec_id = r.query_id GROUP BY 1)
SELECT count(*) AS queries, round(avg(h1), 6) AS hit_at_1, round(avg(h4), 6) AS hit_at_4 FROM e""")
def retrieval_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = _dense(spark, sf_dir).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    return Q.hit_rates(ranked.withColumn("same", F.col("label") == F.col("asked")), "query_id", "same", (1, 4))


@_register(f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dn WHERE vec_id <> query_id QUALIFY rank = 1),
p AS (SELECT b.label AS t, a.label AS p FROM r JOIN embeddings a ON a.vec_id = r.vec_id JOIN embeddings b ON b.vec_id = r.query_id),
l AS (SELECT t AS label FROM p UNION SELECT p FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label) AS support, (SELECT count(*) FROM p WHERE p.p = label) AS said, (SELECT count(*) FROM p WHERE t = label AND p.p = label) AS both_ FROM l)
SELECT label, support, round(CASE WHEN said > 0 THEN both_ / said ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN both_ / support ELSE 0 END, 6) AS recall, round(2 * both_ / (support + said), 6) AS f1 FROM c""")
def label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector's label as the prediction of each query vector's."""
    v = _table(spark, sf_dir, "embeddings")
    best = X.dense_top(v, _asked(v), 1, "vec_id", "query_id", others=True)
    labels = v.select("vec_id", "label")
    pairs = best.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth")), "query_id")
    return Q.f1_by_label(pairs, "truth", "label")


@_register(f"WITH t AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.term_counts(texts(spark, sf_dir), "text")


@_register("SELECT source, lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def docs_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))


@_register("SELECT count(*) AS total, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text, count(*) FILTER (trim(coalesce(source, '')) = '') AS no_source, count(*) - count(DISTINCT text) AS repeated_texts FROM documents")
def corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    docs = _table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("total"), (F.count("*") - F.count_distinct("doc_id")).alias("duplicate_ids"), F.count_if(blank("text")).alias("empty_text"), F.count_if(blank("source")).alias("no_source"), (F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("repeated_texts"))


@_register("SELECT count(*) AS docs, CAST(sum(CAST('0x' || substr(md5(doc_id || '|' || text), 1, 12) AS BIGINT)) AS DECIMAL(38,0)) AS fingerprint FROM documents")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the corpus that doesn't depend on the order of its rows."""
    one = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text"))), 1, 12), 16, 10).cast("decimal(20,0)")
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.sum(one).cast("decimal(38,0)").alias("fingerprint"))


@_register("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each text: an aggregation by digest, so that a frequent text is combined before the shuffle."""
    docs = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k"), F.struct("doc_id", "source", "lang").alias("r"))
    return docs.groupBy("k").agg(F.min("r").alias("r")).select("r.doc_id", "r.source", "r.lang")


@_register("SELECT event_type, user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS INT) AS place FROM events QUALIFY place <= 3")
def per_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_group_limit(_table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")], 3).select("event_type", "user_id", "event_id", "place")


@_register("""WITH f AS (SELECT *, first_value(o_orderstatus) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS first FROM orders)
SELECT o_custkey, o_orderpriority, count(*) AS rows, count(*) FILTER (o_orderstatus = first) - 1 AS duplicates, count(*) FILTER (o_orderstatus <> first) AS conflicts FROM f GROUP BY ALL""")
def first_wins_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicts(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", ["o_orderkey"])


@_register("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("role") == "user", F.col("text")))
    return R.carry_forward(turns, "said", ["conv_id"], ["turn"], "asked").select("conv_id", "turn", "asked")


@_register("SELECT conv_id, max_by(text, turn) AS question, '[echo:local] ' || max_by(text, turn) AS answer FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return last.withColumn("answer", F.concat(F.lit("[echo:local] "), F.col("question")))


@_register("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) = 1 AS rep FROM events)
SELECT event_id, event_type FROM (SELECT * FROM r ORDER BY rep DESC, ts DESC, event_id LIMIT 10)""")
def representatives_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.representatives_then_fill(_table(spark, sf_dir, "events"), "event_type", [F.col("ts").desc(), F.col("event_id")], 10).select("event_id", "event_type")


@_register("""WITH s AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY 1),
m AS (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS m FROM s)
SELECT CAST(m AS DATE) AS month, count(*) AS open_orders FROM m GROUP BY 1""")
def interval_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("z"))
    return spans.select(F.explode(R.months_covered(F.col("a"), F.col("z"))).alias("month")).groupBy("month").agg(F.count("*").alias("open_orders"))


_PERIODS = [("first", "1992-01-01", "1993-12-31", 0), ("second", "1994-01-01", "1995-12-31", 1), ("overlap", "1995-06-01", "1996-12-31", 2), ("last", "1997-06-01", "1998-12-31", 3)]


@_register(f"""WITH p(label, a, z, ord) AS (VALUES {', '.join(f"('{p}', DATE '{a}', DATE '{z}', {n})" for p, a, z, n in _PERIODS)}),
o AS (SELECT o_orderkey, (SELECT label FROM p WHERE CAST(o_orderdate AS DATE) BETWEEN a AND z ORDER BY ord LIMIT 1) AS period FROM orders)
SELECT period, count(*) AS orders FROM o GROUP BY 1""")
def point_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.createDataFrame(_PERIODS, "label string, start string, end string, ord int").select("label", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "ord")
    found = R.period_of(_table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date"), periods)
    return found.groupBy("period").agg(F.count("*").alias("orders"))


@_register("""SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS orders,
string_agg(DISTINCT lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')) AS months FROM orders GROUP BY 1""")
def date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").groupBy(F.year(d).alias("year")).agg(F.min(d).cast("date").alias("first_day"), F.max(d).cast("date").alias("last_day"), F.count("*").alias("orders"), F.array_join(F.array_sort(F.collect_set(F.date_format(d, "MM"))), ",").alias("months"))


@_register("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1""")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("kinds"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@_register("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _EVENTS) + f", count(*) FILTER (event_type IS NULL OR event_type NOT IN ({', '.join(repr(k) for k in _EVENTS)})) AS others FROM events GROUP BY user_id")
def kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by user of the events of each known kind, and of all others."""
    kind = F.col("event_type")
    known = [F.count_if(kind == k).alias(k) for k in _EVENTS]
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(*known, F.count_if(kind.isNull() | ~kind.isin(_EVENTS)).alias("others"))


@_register(f"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, html, {clean_sql('html')} AS t FROM pages)")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", T.title_of(F.col("html")).alias("title"), T.clean_html(F.col("html")).alias("t"))
    return pages.select("page_id", "title", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@_register(f"SELECT doc_id, len(d.t) AS tokens, len(list_distinct(d.t)) AS distinct_tokens, c.t AS excerpt FROM (SELECT doc_id, text, {_TOK.format('text')} AS t FROM documents) d, LATERAL (SELECT CASE WHEN length(z) <= 80 THEN z ELSE rtrim(substr(z, 1, 79)) || '...' END AS t FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS z)) c")
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"), T.clip(F.col("text"), 80).alias("excerpt"))


@_register("SELECT page_id, url FROM pages WHERE contains(lower(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', '', 'g')), 'thehea') OR contains(lower(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', '', 'g')), 'enach')")
def title_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.title_key(T.title_of(F.col("html")))
    return _table(spark, sf_dir, "pages").where(F.exists(F.array(F.lit("thehea"), F.lit("enach")), lambda k: F.contains(key, k))).select("page_id", "url")


@_register("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text").cast("long")).alias("chars"))


@_register("SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src3')")
def domain_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.col("source").isNull() | ~F.col("source").isin("src0", "src3")).select("doc_id", "source")


@_register("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@_register("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT doc_id, ' ' || w || ' ' AS p FROM w),
g AS (SELECT doc_id, unnest(list_transform(range(1, length(p) - k + 2), lambda i: substr(p, i, k))) AS term FROM p, (SELECT unnest([2, 3, 4, 5]) AS k) WHERE length(p) >= k)
SELECT doc_id, count(*) AS ngrams, count(DISTINCT term) AS distinct_ngrams FROM g GROUP BY 1""")
def char_ngram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.ngram_profile(texts(spark, sf_dir), "doc_id", "text")


#: A small linear model: term, idf, and a weight for each class; bias by class.
_MODEL = [("th", 1.2, 1.5, -0.5, -0.7), ("sch", 1.9, -0.8, 1.8, -0.6), (" le", 1.7, -0.4, -0.6, 1.4), ("eau", 2.1, -0.9, -0.7, 1.9), ("ión", 2.2, -0.3, -0.4, 0.2), ("ing", 1.6, 1.1, -0.2, -0.3), ("ung", 2.0, -0.6, 1.3, -0.5)]
_BIAS = [(0, 0.2), (1, -0.1), (2, 0.0)]


_ROUTED = f"""WITH v(term, idf, w0, w1, w2) AS (VALUES {', '.join(str(m) for m in _MODEL)}), b(c, bias) AS (VALUES {', '.join(str(x) for x in _BIAS)}),
w AS (SELECT item_id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) || ' ' AS p FROM benchmark),
g AS (SELECT item_id, unnest(list_transform(range(1, length(p) - k + 2), lambda i: substr(p, i, k))) AS term FROM w, (SELECT unnest([2, 3, 4, 5]) AS k) WHERE length(p) >= k),
t AS (SELECT item_id, term, count(*) * CAST(any_value(idf) AS DOUBLE) AS x, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2 FROM g JOIN v USING (term) GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(x * x)) AS norm, sum(x * CAST(w0 AS DOUBLE)) AS s0, sum(x * CAST(w1 AS DOUBLE)) AS s1, sum(x * CAST(w2 AS DOUBLE)) AS s2 FROM t GROUP BY 1),
s AS (SELECT item_id, c AS class, round(CAST(bias AS DOUBLE) + coalesce(CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END / norm, 0), 6) AS score FROM benchmark CROSS JOIN b LEFT JOIN n USING (item_id))
"""


@_register(_ROUTED + "SELECT item_id, class, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, class) = 1")
def linear_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(m[0], m[1]) for m in _MODEL], "term string, idf double")
    weights = spark.createDataFrame([(m[0], c, m[2 + c]) for m in _MODEL for c in range(3)], "term string, class int, weight double")
    return router.decide(_table(spark, sf_dir, "benchmark"), vocabulary, weights, spark.createDataFrame(_BIAS, "class int, bias double"), "item_id", "text")


_WORDS = {"오늘 식단": [0], "내일 메뉴": [1], "이번 주말 셔틀": [0, 1], "다음주 일정": list(range(2, 9)), "plain": []}


@_register("SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {n} THEN '{w} ' || o_orderkey || '{''.join(' ' + f'2026-06-{13 + d:02}' for d in days)}'" for n, (w, days) in enumerate(_WORDS.items())) + " ELSE '오늘 ' || strftime(o_orderdate, '%Y-%m-%d') END AS expanded FROM orders")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with day and week words get the dates that they mean; one that holds a date stays."""
    k = F.col("o_orderkey")
    asked = F.coalesce(*(F.when(k % 6 == n, F.concat(F.lit(w + " "), k.cast("string"))) for n, w in enumerate(_WORDS)), F.concat(F.lit("오늘 "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.expand_dates(asked, AS_OF).alias("expanded"))


@_register("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INT) AS u, year(o_orderdate) AS y, o_custkey % 2 = 0 AS one, o_custkey % 3 AS box FROM orders),
s AS (SELECT *, TRY_CAST(format('{:04d}-{:02d}-{:02d}', y - CASE WHEN month(d) = 12 AND box = 0 THEN 1 ELSE 0 END, month(d), day(d)) AS DATE) AS a, CASE WHEN one THEN d ELSE u END AS v FROM o),
z AS (SELECT *, TRY_CAST(format('{:04d}-{:02d}-{:02d}', y - CASE WHEN month(d) = 12 AND box = 0 THEN 1 ELSE 0 END + CASE WHEN month(v) < month(d) THEN 1 ELSE 0 END, month(v), day(v)) AS DATE) AS b FROM s)
SELECT o_orderkey, CASE WHEN b IS NOT NULL THEN a END AS start_day, CASE WHEN a IS NOT NULL THEN b END AS end_day FROM z""")
def calendar_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and ranges of days in short form, in three boxes of a page for the order's year."""
    d = F.col("o_orderdate").cast("date")
    short = lambda x: F.date_format(x, "MM.dd")
    text = F.when(F.col("o_custkey") % 2 == 0, F.concat(short(d), F.lit("(월)"))).otherwise(F.concat(short(d), F.lit(" ~ "), short(F.date_add(d, (F.col("o_custkey") % 60).cast("int")))))
    span = C.date_range(text, F.year(d), F.col("o_custkey") % 3)
    return _table(spark, sf_dir, "orders").select("o_orderkey", span.alias("r")).select("o_orderkey", F.col("r.start").alias("start_day"), F.col("r.end").alias("end_day"))


@_register("""SELECT o_orderkey, strftime(d, '%Y-%m-%d') || ' (' || ['월', '화', '수', '목', '금', '토', '일'][isodow(d)] || ') ' || strftime(m, '%Y-%m-%d') || '~' || strftime(m + 6, '%Y-%m-%d') || ' ' || strftime(m + 7, '%Y-%m-%d') || '~' || strftime(m + 13, '%Y-%m-%d') AS context,
d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS workday_before FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('week', o_orderdate) AS DATE) AS m FROM orders)""")
def week_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.week_context(day).alias("context"), C.last_workday_before(day).alias("workday_before"))


@_register("""SELECT p_partkey, l AS line, CASE l WHEN 0 THEN 'k|' || p_brand || '|' || p_brand WHEN 1 THEN 'k|' || p_name || '|' || p_type || ';' || p_size WHEN 2 THEN 'k|' || p_name || '|x' ELSE p_brand || '|' || repeat('e|', CAST(p_size AS INT) - 1) || 'e' END AS cells FROM part, (VALUES (0), (1), (2), (3)) t(l)""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with cells that span rows and columns, as many as the part's size."""
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    html = F.concat(
        F.lit("<table><tr><th rowspan='3'>k</th><th colspan=2>"), "p_brand", F.lit("</th></tr><tr><td rowspan=2>"), name, F.lit("</td><td>"), kind, F.lit("<br>"), size,
        F.lit("</td></tr><tr><td>x</td></tr><tr><td>"), "p_brand", F.lit('</td><td colspan="'), size, F.lit('">e</td></tr></table><table><tr><td>no</td></tr></table>'),
    )
    part = dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), "p_partkey")
    rows = part.select("p_partkey", F.posexplode(M.table_grid(html)).alias("line", "c"))
    return rows.select("p_partkey", "line", F.replace(F.array_join("c", "|"), F.lit("\n"), F.lit(";")).alias("cells"))


_MEASURED = f"""WITH {_BM25}, {_LEX}, r AS (SELECT 'bm25' AS mode, * FROM {_TOP.format(q='item_id', k='doc_id', f='bm', n=K)} UNION ALL SELECT 'lexical', * FROM {_TOP.format(q='item_id', k='doc_id', f='lx', n=K)}),
e AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN NULL ELSE 'en' END AS expected FROM benchmark),
h AS (SELECT e.item_id, expected, m AS mode, count(r.doc_id) AS found, coalesce(bool_or(lang = expected AND rank = 1), false) AS top1, coalesce(bool_or(lang = expected), false) AS topk FROM e CROSS JOIN (VALUES ('bm25'), ('lexical')) t(m) LEFT JOIN r ON r.item_id = e.item_id AND r.mode = m LEFT JOIN documents USING (doc_id) GROUP BY ALL)"""
service.register.sql |= {name: q.replace("__MEASURED__", _MEASURED) for name, q in service.register.sql.items()}
knowledge.register.sql["router_margins"] = _ROUTED + "SELECT item_id, round(max(score) - min(score) FILTER (n = 2), 5) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC) AS n FROM s) WHERE n <= 2 GROUP BY item_id"
training.register.sql["bm25_kept_index"] = _register.sql["bm25_topk"]
_PARTS = (_register, *(m.register for m in (records, notices, builds, knowledge, service, training)))


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in _PARTS for name, q in part.sql.items()}

"""Registered queries over periods, router training, deadlines, crawls and the kept index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings, router, router_training
from ..operators import notices as N
from ..operators import periods as P
from ..runtime import as_pattern, run_folder
from ..sources import pages as G
from ..streaming import deadlines
from .registry import Registry, table, texts

register = Registry()

_PERIODS = """p AS (SELECT y * 10 + n AS ord, label, make_date(y, m1, d1) AS a, make_date(y, m2, d2) AS z FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (VALUES (1, '1학기', 3, 3, 6, 21), (2, '특강', 6, 15, 7, 20), (3, '2학기', 9, 1, 12, 20)) t(n, label, m1, d1, m2, d2)),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
h AS (SELECT o_orderkey, d, label, a, z FROM o LEFT JOIN p ON d BETWEEN a AND z QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) = 1)"""
#: Terms of each year of the orders; the second one overlaps the first, and there are gaps.
_TERMS = [(1, "1학기", "03-03", "06-21"), (2, "특강", "06-15", "07-20"), (3, "2학기", "09-01", "12-20")]


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their day and the period that it is in."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    year = orders.select(F.year("day").alias("y")).distinct()
    day = lambda s: F.to_date(F.concat(F.col("y").cast("string"), F.lit("-" + s)))
    each = F.explode(F.array(*(F.struct((F.col("y") * 10 + n).alias("ord"), F.lit(label).alias("label"), day(a).alias("start"), day(z).alias("end")) for n, label, a, z in _TERMS)))
    return P.period_at(orders, "day", year.select(each.alias("p")).select("p.*"))


_ASKED = ["이번 학기 종강일이 언제", "학기 개강", "여름 계절학기 종강일", "이번 학기 시간표", "내일 학기 종료와 개강", "학기 종강 2026-01-02"]


@register(f"""WITH {_PERIODS}, q AS (SELECT *, CASE o_orderkey % 6 {' '.join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(_ASKED))} END AS question FROM h),
e AS (SELECT *, CASE WHEN a IS NULL OR o_orderkey % 6 NOT IN (0, 4) THEN '' ELSE ' ' || year(z) || '년 ' || month(z) || '월 ' || strftime(z, '%Y-%m-%d') END AS last, CASE WHEN a IS NULL OR o_orderkey % 6 NOT IN (1, 4) THEN '' ELSE ' ' || year(a) || '년 ' || month(a) || '월 ' || strftime(a, '%Y-%m-%d') END AS first FROM q)
SELECT o_orderkey, question || CASE o_orderkey % 6 WHEN 4 THEN ' ' || strftime(d + 1, '%Y-%m-%d') || replace(last || first, ' ' || strftime(d + 1, '%Y-%m-%d'), '') ELSE last || first END AS expanded FROM e""")
def term_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on the first and last day of the term that the order's day is in, with these days."""
    k = F.col("o_orderkey") % 6
    question = F.coalesce(*(F.when(k == n, q) for n, q in enumerate(_ASKED)))
    more = P.boundary_dates(question, F.col("period"))
    return _held(spark, sf_dir).select("o_orderkey", T.expand_dates(question, F.col("day"), more).alias("expanded"))


@register(f"""WITH {_PERIODS}, m AS (SELECT *, CAST(date_trunc('week', d) AS DATE) AS m FROM h)
SELECT o_orderkey, coalesce('현재 기간: ' || label || chr(10), '') || '이번 주: ' || m || '(월) ~ ' || (m + 6) || '(일), 평일 ' || strftime(m, '%m-%d') || '~' || strftime(m + 4, '%m-%d') || chr(10)
|| '다음 주: ' || (m + 7) || '(월) ~ ' || (m + 13) || '(일), 평일 ' || strftime(m + 7, '%m-%d') || '~' || strftime(m + 11, '%m-%d') || ', 주말 ' || strftime(m + 12, '%m-%d') || '~' || strftime(m + 13, '%m-%d') AS context FROM m""")
def temporal_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on period and weeks for each order's day."""
    return _held(spark, sf_dir).select("o_orderkey", P.temporal_context(F.col("day"), F.col("period.label")).alias("context"))


@register("""WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) || ' ' AS p FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(p) - k + 2), lambda i: substr(p, i, k))) AS term FROM w, (SELECT unnest([2, 3, 4, 5]) AS k) WHERE length(p) >= k)
SELECT term, count(*) AS documents, round(ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1, 6) AS idf FROM g GROUP BY term HAVING count(*) >= 2 ORDER BY documents DESC, term LIMIT 5000""")
def router_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 terms that most documents hold; how many terms a model has is a setting of it."""
    found = router_training.vocabulary(texts(spark, sf_dir), "text", 5000)
    return found.select("term", "documents", F.round("idf", 6).alias("idf"))


def router_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, label, predicted: a router of languages, fitted on two thirds of the documents and asked for all.

    No SQL: weights come from an iteration.  The tests hold it against a fit on one machine.
    """
    docs = texts(spark, sf_dir)
    langs = docs.select("lang").where("lang IS NOT NULL").distinct().orderBy("lang").limit(router_training.MOST_CLASSES + 1)
    numbered = F.broadcast(langs.agg(F.array_sort(F.collect_list("lang")).alias("langs")))  # bounded by the classes of a model
    asked = docs.join(numbered).select("doc_id", "text", F.nullif(F.array_position("langs", F.col("lang")), F.lit(0)).cast("int").alias("label"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"))
    parts = router_training.train(asked.where("NOT held_out"), terms=5000, iterations=30)
    said = router.decide(asked, *parts, "doc_id", "text").select("doc_id", F.col("class").alias("predicted"))
    return asked.select("doc_id", "held_out", "label").join(said, "doc_id")


register.queries["router_languages"] = router_languages


_BOARDS = ["click", "error", "view"]


@register("""WITH a AS (SELECT ts, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events WHERE event_type IN ('click', 'error', 'view')),
s AS (SELECT start, count(DISTINCT event_type) FILTER (ts <= start + INTERVAL 20 MINUTE) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (ts <= start + INTERVAL 20 MINUTE) AS boards, count(*) FILTER (ts <= start + INTERVAL 20 MINUTE) AS on_time, count(*) FILTER (ts > start + INTERVAL 20 MINUTE) AS late FROM a GROUP BY 1)
SELECT start, coalesce(boards, '') AS boards, on_time, late, n = 3 AS complete FROM s WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR""")
def stage_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals of boards in stages of an hour, read as a stream; the stages that are over."""
    path, out = f"{sf_dir}/events.parquet", run_folder(spark, "stages")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(as_pattern(path))
    deadlines.append(deadlines.stages(stream, _BOARDS), f"{out}/closed", f"{out}/checkpoint").awaitTermination()
    return deadlines.closed(spark, f"{out}/closed", schema["ts"].dataType.simpleString())


@register("""WITH r AS (SELECT event_id, user_id % 500 AS board, 1 + event_id % 23 AS page, event_type = 'error' AS pinned FROM events),
c AS (SELECT board, page, count(*) FILTER (NOT pinned) AS n FROM r WHERE page <= 20 GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (PARTITION BY board ORDER BY page))
SELECT event_id, board, page, pinned FROM r SEMI JOIN (SELECT board, page FROM s WHERE place = page AND before < 20) k USING (board, page)""")
def crawled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the pages of users' boards: those that a crawl reads until it has enough."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 500).alias("board"), (1 + F.col("event_id") % 23).alias("page"), (F.col("event_type") == "error").alias("pinned"))
    return N.crawled(rows)


def bm25_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of bm25_topk from an index that is made once and searched without the texts."""
    index = postings.kept(table(spark, sf_dir, "documents"), run_folder(spark, "index"))
    return postings.search(index, table(spark, sf_dir, "benchmark"), 4)


register.queries["bm25_kept_index"] = bm25_kept_index


@register(r"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN regexp_replace(replace(html, 'charset="utf-8"', 'charset="iso-8859-1"'), '[^\x00-\x{FF}]', '?', 'g') ELSE replace(html, 'charset="utf-8"', 'charset="no-such-set"') END AS html FROM pages)
SELECT page_id, lower(coalesce(nullif(regexp_extract(html[:2000], 'charset="([\w-]+)', 1), ''), 'utf-8')) AS charset, md5(html) AS html_md5 FROM p""")
def sniffed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes in the charset that they declare: one by its own name, one in Latin-1, one under a name that nobody knows."""
    k = F.col("page_id") % 3
    named = lambda name: F.replace(F.col("html"), F.lit('charset="utf-8"'), F.lit(f'charset="{name}"'))
    latin = F.encode(F.regexp_replace(named("iso-8859-1"), r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    raw = F.when(k == 0, F.encode("html", "UTF-8")).when(k == 1, latin).otherwise(F.encode(named("no-such-set"), "UTF-8"))
    return G.with_text(table(spark, sf_dir, "pages").select("page_id", raw.alias("content"))).select("page_id", "charset", F.md5("html").alias("html_md5"))

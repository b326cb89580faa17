"""Registered queries over notice boards; orders are written as rows of five boards in two layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boards as B
from ..operators import index_build as V
from ..operators import notices as N
from ..runtime import run_folder
from .registry import Registry, dealt, table

register = Registry()

#: The five order priorities as boards.
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BOARDS = [{"board": f"b{k}", "label": f"board {k}", "title": f"notices of {p}", "url": f"http://b{k}.example/list"} for k, p in enumerate(_PRIORITIES)]
_FIRST = ["b1", "b3"]

_ITEMS = """i AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS ord, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey % 7 = 0 AS pinned, o_orderpriority || ' ' || o_custkey AS title,
'http://b' || ord || '.example/list?no=' || o_orderkey || CASE WHEN ord % 2 = 0 THEN '&p=1' ELSE '' END AS url FROM orders),
e AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ord, pinned ORDER BY k) <= 5)"""


def _line(label: bool, excerpt: str = "''") -> str:
    return f"'[' || date || ']' || {repr('[board ') + ' || ord || ' + repr(']') if label else repr('')} || ' ' || title || ' (' || o_custkey || ') — ' || url || {excerpt}"


def _text(line: str) -> str:
    newest = "string_agg({}, chr(10) ORDER BY date DESC, ord, k) FILTER ({})"
    return f"'{N.NEWEST}' || coalesce(chr(10) || {newest.format(line, 'NOT pinned')}, '') || coalesce(chr(10) || chr(10) || '{N.FIXED}' || chr(10) || {newest.format(line, 'pinned')}, '')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, with one row of its board's table."""
    key, by = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    ord_ = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    number = F.when(F.col("o_custkey") % 7 == 0, B.PINNED).otherwise(key)
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    title = F.concat("o_orderpriority", F.lit(" <b>"), by, F.lit("</b>"))
    plain = F.concat(F.lit("<table><tbody><tr><td>"), number, F.lit('</td><td> <a class="x" href="?no='), key, F.lit('&amp;p=1">'), title, F.lit("</a></td><td>"), by, F.lit("</td><td>"), day, F.lit(" </td></tr><tr><td>short</td></tr></tbody></table>"))
    marked = F.concat(F.lit("<tbody><tr><td>"), number, F.lit("</td><td><div class='b-title-box'><i>new</i><a href='?no="), key, F.lit("'>"), title, F.lit("</a></div></td><td><span class='b-writer'>"), by, F.lit("</span><span class='b-date'>"), day, F.lit("</span></td></tr></tbody>"))
    url = F.concat(F.lit("http://b"), ord_.cast("string"), F.lit(".example/list"))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), "o_orderkey")
    return orders.select(
        F.concat(F.lit("b"), ord_.cast("string")).alias("board"), F.concat(F.lit("board "), ord_.cast("string")).alias("label"), ord_.alias("ord"), F.col("o_orderkey").alias("page"), url.alias("url"),
        F.when(ord_ % 2 == 0, "plain").otherwise("marked").alias("layout"), F.when(ord_ % 2 == 0, plain).otherwise(marked).alias("html"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read_boards(_pages(spark, sf_dir))


@register(f"""WITH {_ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY date DESC, k) = 1 AS rep FROM e WHERE NOT pinned),
r AS (SELECT * EXCLUDE rep FROM (SELECT * FROM p ORDER BY rep DESC, CASE WHEN rep THEN ord END, date DESC, ord, k LIMIT 10)), x AS (SELECT * FROM e WHERE pinned ORDER BY date DESC, ord, k LIMIT 5), a AS (SELECT * FROM r UNION ALL SELECT * FROM x)
SELECT 'live_notices_all' AS id, '{N.TOGETHER}' AS title, 'http://b0.example/list' AS source_url, {_text(_line(True))} AS text FROM a""")
def recent_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boards at once: five of each, each board's newest, then the newest of all."""
    return N.recent(_items(spark, sf_dir), BOARDS).select("id", "title", "source_url", "text")


@register(f"""WITH {_ITEMS}, a AS (SELECT * FROM i WHERE ord = 2 QUALIFY row_number() OVER (PARTITION BY pinned ORDER BY date DESC, k) <= 20)
SELECT 'live_notices_b2' AS id, 'notices of 3-MEDIUM' AS title, 'http://b2.example/list' AS source_url, {_text(_line(False))} AS text FROM a""")
def notices_of_one_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.recent(_items(spark, sf_dir), BOARDS, board="b2", limit=30).select("id", "title", "source_url", "text")


@register(f"""WITH {_ITEMS}, m AS (SELECT * FROM i WHERE contains(lower(replace(title, ' ', '')), 'urgent11') OR contains(lower(replace(title, ' ', '')), 'urgent77') QUALIFY row_number() OVER (PARTITION BY ord, pinned ORDER BY k) <= 5),
a AS (SELECT *, row_number() OVER (ORDER BY pinned, date DESC, ord, k) AS n FROM m)
SELECT 'live_notices_all' AS id, {_text(_line(True, "CASE WHEN n <= 2 THEN chr(10) || '본문 발췌: ' || repeat('word ' || o_custkey || ' ', 3) || 'end' ELSE '' END"))} AS text FROM a""")
def notices_keyword_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No match on the first boards: the others are searched, and the first two matches get their bodies."""
    pages = _pages(spark, sf_dir)
    words = F.repeat(F.concat(F.lit("word <b>"), F.col("page_by"), F.lit("</b>\n")), F.lit(3))
    html = F.concat(F.lit("<nav>menu</nav><div class='other view-content'>"), words, F.lit("end</div><footer>x</footer>"))
    by = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("page_by"), "o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("ord"))
    url = F.concat(F.lit("http://b"), F.col("ord").cast("string"), F.lit(".example/list?no="), F.col("o_orderkey").cast("string"), F.when(F.col("ord") % 2 == 0, "&p=1").otherwise(""))
    details = by.select(url.alias("url"), html.alias("html"), F.when(F.col("ord") % 2 == 0, "plain").otherwise("marked").alias("layout"))
    return N.recent(N.read_boards(pages), BOARDS, details, keywords=["URGENT 1 1", " urgent 77", "", "URGENT 1 1"], first=_FIRST).select("id", "text")


@register(f"""WITH {_ITEMS}, a AS (SELECT * FROM e WHERE ord IN (1, 3) QUALIFY row_number() OVER (PARTITION BY pinned ORDER BY date DESC, ord, k) <= CASE WHEN pinned THEN 5 ELSE 3 END)
SELECT 'live_notices_all' AS id, '{N.NOT_FOUND.format("no such word").replace("'", "''")}' || chr(10) || {_text(_line(True))} AS text FROM a""")
def notices_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No match anywhere: the newest of the first boards, with a note."""
    return N.recent(_items(spark, sf_dir), BOARDS, keywords="no such word", limit=3, first=_FIRST).select("id", "text")


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board's rows over its pages: orders, some numbers of which come again on later pages."""
    o = table(spark, sf_dir, "orders")
    no = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))
    return o.select(no.cast("string").alias("no"), F.concat(F.lit("title "), "o_orderkey").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("u").alias("url"), (F.col("o_custkey") % 97 == 0).alias("pinned"), F.floor(F.col("o_orderkey") / 40).cast("long").alias("page"), F.col("o_orderkey").alias("at"))


_CRAWLED = """c AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS no, 'title ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey % 97 = 0 AS pinned, o_orderkey AS spot FROM orders),
s AS (SELECT * FROM (SELECT * FROM c WHERE pinned QUALIFY row_number() OVER (PARTITION BY no ORDER BY spot) = 1) UNION ALL SELECT * FROM (SELECT * FROM (SELECT * FROM c WHERE NOT pinned QUALIFY row_number() OVER (PARTITION BY no ORDER BY date DESC, spot) = 1) ORDER BY date DESC, spot LIMIT 20)),
d AS (SELECT o_orderkey AS no, o_orderstatus AS department, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority || o_clerk END AS body FROM (SELECT *, repeat('x', 3000) AS o_clerk FROM orders) WHERE o_orderkey % 5 <> 0),
b AS (SELECT 'notices_' || no AS id, title, CASE WHEN department IS NULL THEN title WHEN trim(body) = '' THEN chr(10) || '게시일: ' || chr(10) || '작성: ' || department || chr(10) || '(본문은 첨부파일 참조: u' || no || ')' ELSE substr(body, 1, 2500) END AS text, date, coalesce(department, '') AS department, pinned, department IS NULL AS failed FROM s LEFT JOIN d USING (no))"""


#: The same documents with whole bodies.
_WHOLE = _CRAWLED.replace("substr(body, 1, 2500)", "body")


def _documents(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    body = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat("o_orderpriority", F.repeat(F.lit("x"), F.lit(3000))))
    none = F.lit(None).cast("string")
    details = o.select(F.col("o_orderkey").cast("string").alias("no"), none.alias("title"), none.alias("date"), F.col("o_orderstatus").alias("department"), body.alias("body"), F.concat(F.lit("u"), "o_orderkey").alias("url"))
    return N.board_documents(N.board_selection(_crawled(spark, sf_dir)), details, most)


@register(f"WITH {_WHOLE} SELECT * FROM b")
def board_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pinned notices and the newest 20 others, with the whole texts of their own pages."""
    return _documents(spark, sf_dir)


@register(f"""WITH {_CRAWLED}, t AS (SELECT * FROM b WHERE NOT pinned ORDER BY date DESC, id LIMIT 20)
SELECT 'notices_board_overview' AS id, '{N.OVERVIEW.strip()}' || chr(10) || chr(10) || string_agg('[' || date || '] ' || title, chr(10) ORDER BY date DESC, id) AS text, max(date) AS date, count(*) AS posts FROM t""")
def board_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.board_overview(_documents(spark, sf_dir))


@register(f"""WITH {_CRAWLED} SELECT (SELECT count(*) FROM c) AS board_rows, count(*) FILTER (pinned) AS selected_pinned, count(*) FILTER (NOT pinned) AS selected_regular, count(*) FILTER (failed) AS detail_failed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (failed), '') AS failed_ids FROM b""")
def board_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.board_report(_crawled(spark, sf_dir), _documents(spark, sf_dir))


def _built(spark: SparkSession, sf_dir: str) -> str:
    path = run_folder(spark, "notices")
    counts = {"pinned": F.count_if("pinned"), "failed": F.count_if("failed"), "first_day": F.min("date"), "last_day": F.max("date")}
    V.build(_documents(spark, sf_dir, N.BODY), path, [F.col("date").desc(), "id"], V.notice_checks(), counts)
    return path


@register(f"WITH {_CRAWLED} SELECT * FROM b")
def built_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's documents, written as a version of an index that has no empty text or day, and read again."""
    return V.read(spark, _built(spark, sf_dir))


@register(f"WITH {_CRAWLED} SELECT CAST(1 AS BIGINT) AS version, count(*) AS rows, count(*) FILTER (pinned) AS pinned, count(*) FILTER (failed) AS failed, min(date) AS first_day, max(date) AS last_day FROM b")
def built_notices_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the build of that version counted while it wrote."""
    return V.versions(spark, _built(spark, sf_dir)).select("version", "rows", "pinned", "failed", "first_day", "last_day")

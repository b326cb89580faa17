"""Registered queries over stored and live campus pages and over the indexes made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import menus as M
from ..operators import builds as D
from ..operators import live as L
from ..operators.menus import first_records
from .records import _menus
from .registry import Registry, table

register = Registry()

_MEALS, _HALLS = list(M.MEALS), ["제1학생회관", *M.DAILY_HALLS]


def _cell(name: Column, price: Column, rest: Column, closed: Column) -> Column:
    return F.when(closed, M.CLOSED).otherwise(F.concat(F.lit('<h3 class="menu-tit03">'), name, price, F.lit("</h3><p>"), rest, F.lit("</p>")))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part for each day, hall, meal and audience, written as a table cell."""
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (n % len(names) + 1).cast("int"))
    rest = F.concat("p_type", F.lit("<br>"), "p_brand")
    made = table(spark, sf_dir, "part").select(
        k.alias("k"), F.date_add(F.lit("2026-06-08").cast("date"), (F.col("p_size") % 7).cast("int")).alias("day"), pick(_HALLS, k).alias("hall"), pick(_MEALS, k).alias("meal"), pick(M.AUDIENCES, k).alias("audience"),
        _cell(F.col("p_name"), F.when(k % 2 == 0, "(1,500)").otherwise(""), rest, k % 11 == 0).alias("cell"),
    )
    return made.groupBy("day", "hall", "meal", "audience").agg(F.min_by(F.struct("k", "cell"), "k").alias("r")).select("day", "hall", "meal", "audience", "r.*")


def _rows(cells: DataFrame, by: str, across: str, columns: list) -> DataFrame:
    """by, body: table rows of each meal and audience; a page's cells are at most its meals x audiences x columns."""
    held = cells.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "meal", "audience", F.col(across).cast("string")), "cell"))).alias("m"))
    lines = []
    for meal in _MEALS:
        for n, who in enumerate(M.AUDIENCES):
            head = f'<td class="building" rowspan="2">{meal}</td>' if not n else ""
            tds = [F.concat(F.lit("<td>"), F.coalesce(F.try_element_at("m", F.lit(f"{meal}|{who}|{c}")), F.lit("")), F.lit("</td>")) for c in columns]
            lines.append(F.concat(F.lit(f"<tr>{head}<td>{who}</td>"), *tds, F.lit("</tr>")))
    return held.select(by, F.concat(*lines).alias("body"))


def _day_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(_cells(spark, sf_dir), "day", "hall", _HALLS)
    return rows.select("day", F.concat(F.lit("<table><thead><tr><th>x</th></tr></thead><tbody>"), "body", F.lit("</tbody></table>")).alias("html"))


_G = """p AS (SELECT p_partkey AS k, DATE '2026-06-08' + CAST(p_size % 7 AS INT) AS day, ['제1학생회관', '제2학생회관', '제3학생회관', '제4학생회관', '생활과학대학'][p_partkey % 5 + 1] AS hall, p_partkey % 5 AS h, p_partkey % 3 AS m, p_partkey % 2 AS a, p_name, p_type, p_brand FROM part),
g AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY day, h, m, a ORDER BY k) = 1),
l AS (SELECT *, strftime(day, '%Y-%m-%d') || ' (' || ['월', '화', '수', '목', '금', '토', '일'][isodow(day)] || ')' AS w, ['아침', '점심', '저녁'][m + 1] || '(' || ['직원', '학생'][a + 1] || ')' AS who, p_name || CASE WHEN k % 2 = 0 THEN ' 1,500원' ELSE '' END AS label FROM g WHERE h > 0 AND k % 11 <> 0),
b AS (SELECT day, w, h, '## ' || hall || chr(10) || string_agg('- ' || who || ' ' || label || ': ' || p_type || ', ' || p_brand, chr(10) ORDER BY m, a) AS block, '- ' || hall || ': ' || string_agg(who || ' ' || p_type, ' / ' ORDER BY m, a) AS short FROM l GROUP BY day, w, h, hall),
t AS (SELECT day, w, '# ' || w || ' 학생식당 식단' || chr(10) || chr(10) || w || ' 학식 메뉴입니다.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY h) AS menu, '## ' || w || chr(10) || string_agg(short, chr(10) ORDER BY h) AS compact FROM b GROUP BY day, w)"""


@register(f"WITH {_G} SELECT d AS day, coalesce(menu, strftime(d, '%Y-%m-%d') || '{L.NO_MENU}') AS text FROM (SELECT DATE '2026-06-08' + CAST(n AS INT) AS d FROM range(9) r(n)) LEFT JOIN t ON t.day = d")
def live_day_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the menu tool prints for each of nine days; two have no menu."""
    asked = spark.range(9).select(F.date_add(F.lit("2026-06-08").cast("date"), F.col("id").cast("int")).alias("day"))
    return L.day_menus(asked, L.menu_records(_day_pages(spark, sf_dir)))


@register(f"""WITH {_G}, q AS (SELECT 1 AS request, DATE '2026-06-08' + CAST(n AS INT) AS d FROM range(2) r(n) UNION ALL SELECT 2, DATE '2026-06-08' + CAST(n AS INT) FROM range(5) r(n) UNION ALL SELECT 3, DATE '2026-07-01')
SELECT request, CASE request WHEN 1 THEN string_agg(menu, chr(10) || chr(10) ORDER BY d) WHEN 2 THEN '{L.WEEK_HEAD}' || chr(10) || chr(10) || string_agg(compact, chr(10) || chr(10) ORDER BY d) ELSE '2026-07-01{L.NO_MENU}' END AS text FROM q LEFT JOIN t ON t.day = d GROUP BY request""")
def live_week_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for two days, for more than five (one of them twice), and for a day without a menu."""
    days = {1: ["2026-06-08", "2026-06-09"], 2: [f"2026-06-{d:02}" for d in range(8, 13)] + ["2026-06-13"], 3: ["2026-07-01"]}
    asked = spark.createDataFrame(list(days.items()), "request int, days array<string>").select("request", F.col("days").cast("array<date>").alias("days"))
    return L.several_days(asked, L.menu_records(_day_pages(spark, sf_dir)), "request")


_WEEK = [f"2026-06-{d:02}" for d in range(8, 15)]


def _stored_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored weekly page for each hall, second pages with part of the records, some of them changed, and other files."""
    cells = _cells(spark, sf_dir)
    changed = cells.where("k % 2 = 0").withColumn("cell", F.when((F.col("k") % 4 == 0) & (F.col("k") % 11 != 0), F.lit("changed")).otherwise(F.col("cell")))
    heads = "".join(f"<th>{d.replace('-', '.')}<br>x</th>" for d in _WEEK)
    out = spark.createDataFrame([("raw/dining_operation_notice.html", "<p>x</p>"), ("raw/empty.html", "<p>x</p>")], "path string, html string")
    for name, df in (("a", cells), ("b", changed)):
        rows = _rows(df, "hall", "day", _WEEK)
        html = F.concat(F.lit('<ul id="childTab"><li>x</li><li class="over">'), "hall", F.lit(f'</li></ul><table class="menu-tbl"><thead><tr><th colspan="2">구분</th>{heads}</tr></thead><tbody>'), "body", F.lit("</tbody></table>"))
        out = out.unionByName(rows.select(F.concat(F.lit(f"raw/{name}_"), "hall", F.lit(".html")).alias("path"), html.alias("html")))
    return out


def _stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dining_rows(D.dining_files(_stored_menus(spark, sf_dir)))


@register(f"""WITH {_G}, x AS (SELECT day, count(*) AS records, count(DISTINCT h) AS sources, 'raw/a_' || min(hall) || '.html' AS path FROM g WHERE h > 0 AND k % 11 <> 0 GROUP BY day), y AS (SELECT day, string_agg(DISTINCT hall, ',' ORDER BY hall) FILTER (h < 4) AS a, max(CASE WHEN h = 4 THEN hall END) AS z FROM l GROUP BY day)
SELECT 'dining_' || strftime(day, '%Y-%m-%d') AS id, w || ' 학생식당 식단' AS title, menu AS text, concat_ws(',', a, z) AS halls, records, sources, path FROM t JOIN x USING (day) JOIN y USING (day)""")
def dining_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored weekly pages of five halls to a document for each day; the first record of a key counts."""
    return D.dining_documents(D.unique_records(_stored_rows(spark, sf_dir)))


@register(f"""WITH {_G} SELECT count(*) + count(*) FILTER (k % 2 = 0) AS raw, count(*) AS "unique", count(*) FILTER (k % 2 = 0 AND (k % 4 <> 0 OR k % 11 = 0)) AS duplicates, count(*) FILTER (k % 4 = 0 AND k % 11 <> 0) AS conflicts, count(*) FILTER (k % 11 = 0) AS closed FROM g""")
def dining_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.record_counts(_stored_rows(spark, sf_dir)).select("raw", "unique", F.col("duplicates").cast("long"), F.col("conflicts").cast("long"), "closed")


@register("SELECT view, count(*) AS files FROM (VALUES ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('weekly'), ('Skipped notice file'), ('No menu table found')) t(view) GROUP BY view")
def dining_file_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dining_files(_stored_menus(spark, sf_dir)).groupBy("view").agg(F.count("*").alias("files"))


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    items = F.array(*(F.struct(F.lit(n).alias("name"), (F.col("r_regionkey") * 500 + p).cast("long").alias("price")) for n, p in (("공기 밥", 100), ("라면", 2500), ("치즈토핑", 90), ("컵밥", 80), ("냉면", 12_000))))
    only = F.filter(items, lambda x: (F.col("r_regionkey") < 4) | (x["price"] < 3000) & (x["name"] != "라면"))
    return r.select(F.col("r_regionkey").cast("int").alias("ord"), F.concat(F.lit("c & "), "r_name").alias("corner"), F.lit("10:00~14:00").alias("hours"), F.lit("as asked").alias("price_range"), F.lit("n").alias("notes"), only.alias("items"), F.lit("o").alias("origins"))


_ITEMS = "[('공기 밥', 100), ('라면', 2500), ('치즈토핑', 90), ('컵밥', 80), ('냉면', 12000)]"
_RANGE = "CASE WHEN r_regionkey < 4 THEN format('{:,}', r_regionkey * 500 + 2500) || '~' || format('{:,}', r_regionkey * 500 + 12000) || '원' ELSE 'as asked' END"


@register(f"""WITH i AS (SELECT *, unnest({_ITEMS}) AS x, generate_subscripts({_ITEMS}, 1) AS n FROM region), j AS (SELECT *, x[1] AS name, r_regionkey * 500 + x[2] AS price FROM i WHERE r_regionkey < 4 OR (r_regionkey * 500 + x[2] < 3000 AND x[1] <> '라면'))
SELECT 'dining_food_court_h_c&' || replace(r_name, ' ', '') AS id, 'h 푸드코트 c & ' || r_name AS title, '# h 푸드코트 c & ' || r_name || chr(10) || chr(10) || '운영시간: 10:00~14:00' || chr(10) || '가격대: ' || {_RANGE} || chr(10) || '운영 참고: n' || chr(10) || chr(10) || '## 메뉴' || chr(10) || string_agg('- ' || name || ': ' || format('{{:,}}', price) || '원', chr(10) ORDER BY n) || chr(10) || chr(10) || '## 원산지' || chr(10) || 'o' AS text FROM j GROUP BY r_name, r_regionkey""")
def food_court_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.food_court(_corners(spark, sf_dir), "h")


_SHOWN = " || chr(10) || ".join(f"'| {h} | ' || coalesce((SELECT string_agg(DISTINCT ['직원', '학생'][a + 1], ', ' ORDER BY ['직원', '학생'][a + 1] DESC) FROM d WHERE h = {n} AND m = 0), '-') || ' | ' || coalesce((SELECT string_agg(DISTINCT ['직원', '학생'][a + 1], ', ' ORDER BY ['직원', '학생'][a + 1] DESC) FROM d WHERE h = {n} AND m = 1), '-') || ' | ' || coalesce((SELECT string_agg(DISTINCT ['직원', '학생'][a + 1], ', ' ORDER BY ['직원', '학생'][a + 1] DESC) FROM d WHERE h = {n} AND m = 2), '-') || ' |'" for n, h in enumerate(M.DAILY_HALLS, 1))


@register(f"""WITH {_G}, d AS (SELECT * FROM l WHERE isodow(day) < 6)
SELECT 'dining_operating_info' AS id, '# 학생식당 운영 안내' || chr(10) || chr(10) || '## 학생식당 주중 운영표' || chr(10) || 'raw 식단 데이터에서 실제 제공 메뉴가 확인된 끼니와 대상을 집계했습니다.' || chr(10) || chr(10) || '| 식당 | 아침 | 점심 | 저녁 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || {_SHOWN} || chr(10) || chr(10) || '## 주말 운영 여부' || chr(10) || '주말·공휴일 미운영' || chr(10) || chr(10) || '## 제1학생회관 푸드코트 개요' || chr(10) || '| 코너 | 운영시간 | 가격대 |' || chr(10) || '| --- | --- | --- |' || chr(10) || (SELECT string_agg('| c & ' || r_name || ' | 10:00~14:00 | ' || {_RANGE} || ' |', chr(10) ORDER BY r_regionkey) FROM region) || chr(10) || chr(10) || '공통: 주말 미운영.' AS text""".replace(" DESC) FROM d", ") FROM d"))
def dining_operating_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.operating_info(D.unique_records(_stored_rows(spark, sf_dir)), _corners(spark, sf_dir))


@register("""SELECT 'day' AS day, p_brand AS hall, m AS meal, CASE WHEN m = '조식' THEN '직원' ELSE '학생' END AS audience, CASE WHEN m = '조식' THEN p_name || chr(10) || p_type ELSE p_name || ':x' END AS menu_text, 'f' AS path FROM part, (VALUES ('조식'), ('석식')) t(m) WHERE p_partkey % 5 <> 0""")
def legacy_menu_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the texts of older documents; lines without an audience and documents without a hall go."""
    text = F.concat(F.lit("intro\n- 학생: before any meal\n### 조식\n- 직원:  "), "p_name", F.lit("\n  "), "p_type", F.lit("  \n- no audience here\n  nor here\n### 중식 \n### 석식\n- 학생 : "), "p_name", F.lit(":x\nplain line"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("day").alias("day"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise("").alias("hall"), F.lit("f").alias("path"), text.alias("text"))
    return D.legacy_records(docs)


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders")
    files = o.select(F.concat(F.lit("Data/Raw/"), F.when(F.col("o_custkey") % 9 == 0, "Notice_").otherwise("w"), k, F.lit(".HTML")).alias("path"))
    sources = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("data\\raw\\"), F.when(F.col("o_custkey") % 9 == 0, "notice_").otherwise("W"), k, F.lit(".html")).alias("path"), F.concat(F.lit("u"), k).alias("url"), F.lit("t").alias("fetched_at"), F.col("o_custkey").cast("string").alias("source_id"))
    return files, sources


@register("SELECT 'Data/Raw/' || CASE WHEN o_custkey % 9 = 0 THEN 'Notice_' ELSE 'w' END || o_orderkey || '.HTML' AS path, CASE WHEN o_orderkey % 3 <> 0 THEN 'u' || o_orderkey END AS url, CASE WHEN o_orderkey % 3 <> 0 THEN 't' END AS fetched_at, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS source_id FROM orders")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored file with what the source table knows of it, whatever the case and slashes of its path."""
    return D.with_source(*_files(spark, sf_dir))


@register("SELECT 'Data/Raw/w' || o_orderkey || '.HTML' AS path FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 9 <> 0")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.without_source(*_files(spark, sf_dir))


def _calendar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar page for each year of orders, named for one of five years; a line for each day and status."""
    d = F.col("o_orderdate").cast("date")
    days = table(spark, sf_dir, "orders").select(d.alias("d"), "o_orderstatus").distinct()
    until = F.date_add("d", 40)
    said = F.concat(F.date_format("d", "MM.dd"), F.lit("(월)"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" ~ "), F.date_format(until, "MM.dd"), F.lit(" (화)"))).otherwise(""))
    line = F.concat(F.lit("<li><strong>"), said, F.lit('</strong> <span class="list">event <b>'), "o_orderstatus", F.lit("</b></span></li>"))
    # a year has at most 366 days x 3 states
    months = days.groupBy(F.year("d").alias("y"), (F.month("d") % 12).alias("box")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.dayofmonth("d").alias("n"), "o_orderstatus", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    box = F.concat(F.lit('<div class="calen_box"><div class="fl_month"><strong>'), F.date_format(F.make_date(F.lit(2000), F.when(F.col("box") == 0, 12).otherwise(F.col("box")), F.lit(1)), "MM"), F.lit('월</strong></div><div class="fr_list"><ul>'), "lines", F.lit("</ul></div></div>"))
    pages = months.groupBy("y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box", box.alias("html")))), lambda x: x["html"]), "").alias("boxes"))
    named = (F.col("y") % 5 + 2023).cast("string")
    return pages.select(F.concat(F.lit("raw/c"), F.col("y").cast("string"), F.lit("_"), named, F.lit(".html")).alias("path"), F.concat(F.lit('<strong class="year">'), named, F.lit("</strong>"), "boxes").alias("html"))


_EVENTS = """o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders),
f AS (SELECT *, 'raw/c' || year(d) || '_' || (2023 + year(d) % 5) || '.html' AS path, 2023 + year(d) % 5 AS py, month(d) % 12 AS box, d + 40 AS u FROM o),
e AS (SELECT *, py - CASE WHEN month(d) = 12 THEN 1 ELSE 0 END AS sy FROM f),
x AS (SELECT path, box, day(d) AS n, s, py, 'event ' || s AS name, TRY_CAST(format('{:04d}-{:02d}-{:02d}', sy, month(d), day(d)) AS DATE) AS a0,
CASE WHEN s = 'F' THEN TRY_CAST(format('{:04d}-{:02d}-{:02d}', sy + CASE WHEN month(u) < month(d) THEN 1 ELSE 0 END, month(u), day(u)) AS DATE) ELSE TRY_CAST(format('{:04d}-{:02d}-{:02d}', sy, month(d), day(d)) AS DATE) END AS z0, d, u FROM e),
r AS (SELECT *, CASE WHEN a0 IS NOT NULL AND z0 IS NOT NULL THEN a0 END AS a, CASE WHEN a0 IS NOT NULL AND z0 IS NOT NULL THEN z0 END AS z FROM x WHERE py < 2027),
k AS (SELECT * FROM r WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, z, name ORDER BY path, box, n, s) = 1)"""


@register(f"""WITH {_EVENTS}, m AS (SELECT *, unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS m FROM k)
SELECT 'calendar_month_' || strftime(m, '%Y_%m') AS id, year(m) || '년 ' || month(m) || '월 학사일정' AS title, year(m) || '년 ' || month(m) || '월 충남대학교 학사일정입니다.' || chr(10) || chr(10) || string_agg('- ' || strftime(a, '%Y-%m-%d') || CASE WHEN a = z THEN '' ELSE ' ~ ' || strftime(z, '%Y-%m-%d') END || ': ' || name, chr(10) ORDER BY path, box, n, s) AS text, count(*) AS events, string_agg(DISTINCT CAST(py AS VARCHAR), ',' ORDER BY CAST(py AS VARCHAR)) AS page_years FROM m GROUP BY m""")
def calendar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored calendar pages to a document for each month; December in the first box belongs to the year before."""
    return D.calendar_documents(D.unique_events(D.calendar_events(D.calendar_files(_calendar_pages(spark, sf_dir)))))


@register(f"""WITH {_EVENTS}, y AS (SELECT year(a) AS y, count(*) AS n, min(a) AS a, max(z) AS z FROM k GROUP BY 1)
SELECT (SELECT count(DISTINCT path) FROM r) AS files, (SELECT count(DISTINCT path) FROM x WHERE py = 2027) AS skipped, (SELECT count(a) FROM r) AS raw, (SELECT count(*) FROM k) AS "unique", (SELECT count(a) FROM r) - (SELECT count(*) FROM k) AS duplicates, (SELECT count(*) FROM r WHERE a IS NULL) AS failures, string_agg(y || ':' || n || ' ' || a || '~' || z, ', ' ORDER BY y) AS years FROM y""")
def calendar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = D.calendar_files(_calendar_pages(spark, sf_dir))
    return D.calendar_report(files, D.calendar_events(files))


@register(f"""WITH {_EVENTS} SELECT path, '오늘: 2026-03-15 (한국 표준시)' || chr(10) || string_agg('[' || strftime(d, '%m.%d') || CASE WHEN s = 'F' THEN '~' || strftime(u, '%m.%d') ELSE '' END || '] ' || name, chr(10) ORDER BY box, n, s) AS text FROM x WHERE box IN (3, 4) GROUP BY path""")
def live_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of this month and the next on each page."""
    return L.calendar_evidence(_calendar_pages(spark, sf_dir), "path", F.lit("2026-03-15").cast("date"))


@register("""WITH m AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), d AS (SELECT 'calendar_month_' || y || '_' || format('{:02d}', m) AS id, y, m, m % 4 <> 0 AS known FROM m)
SELECT id, CASE WHEN known THEN y || '년 ' || m || '월' ELSE y || '년 ' || format('{:02d}', m) || '월' END AS title FROM d""")
def stored_month_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month documents among stored ones, where no page is left; labels lose a leading zero if year and month are known."""
    return D.stored_months(_stored_months(spark, sf_dir)).select("id", "title")


def _stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    months = table(spark, sf_dir, "orders").select(F.year(d).alias("y"), F.month(d).alias("m")).distinct()
    known, title = F.col("m") % 4 != 0, F.format_string("%04d년 %02d월", "y", "m")
    rows = months.select(F.format_string("calendar_month_%04d_%02d", "y", "m").alias("id"), title.alias("title"), title.alias("text"), F.lit(None).cast("string").alias("doc_type"), F.when(known, F.col("y")).alias("year"), F.when(known, F.col("m")).alias("month"))
    other = rows.withColumns({"id": F.concat(F.lit("event_"), "id"), "doc_type": F.lit("event")})
    return rows.unionByName(other)


@register("SELECT CAST(year(o_orderdate) AS INT) AS year, string_agg(DISTINCT month(o_orderdate), ',' ORDER BY month(o_orderdate)) AS months FROM orders GROUP BY 1")
def stored_months_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and months of month documents, from their fields or else their ids."""
    docs = _stored_months(spark, sf_dir)
    return D.months_by_year(docs.where(D.is_month(F.col("id"), F.col("doc_type"))))


@register("""SELECT 'raw/s' || n_nationkey || '.html' AS path, k AS kind, CASE k WHEN 'route' THEN n || ' 순환' END AS name, CASE k WHEN 'route' THEN '08:30' || chr(10) || '09:' || (10 + n_nationkey) || ' | x' ELSE n_name || chr(10) || 'weekdays' END AS text, CASE WHEN k = 'route' THEN CASE WHEN n = '교내' THEN 'campus_circulation' ELSE 'campus_loop' END END AS route_type,
CASE WHEN k = 'route' THEN f END AS first, CASE WHEN k = 'route' THEN '17:30' END AS last, CASE WHEN k = 'route' THEN 'gate' || chr(10) || n_name END AS stops, CASE WHEN k = 'route' THEN '10 times' END AS trips, NULL::VARCHAR AS posted FROM nation, (VALUES ('route', '교내', '08:30'), ('route', '캠퍼스', '08:10'), ('operating_summary', '', '')) t(k, n, f)""")
def shuttle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and routes of stored shuttle pages; a route takes stops and hours from the second table's line of its name."""
    k, n = F.col("n_nationkey").cast("string"), F.col("n_name")
    route = lambda name, first: F.concat(F.lit(f"<tr><td>{name}<br>순환 (내)</td><td>{first}</td><td>17:30</td><td>gate<br>"), n, F.lit("</td><td>10\n times</td></tr>"))
    plan = lambda name: F.concat(F.lit(f"<tr><th>{name}<br>순환</th><td>08:30<br>09:"), (F.col("n_nationkey") + 10).cast("string"), F.lit("</td><td></td><td>x</td></tr>"))
    html = F.concat(F.lit('<div id="txt"><h4>'), n, F.lit('</h4><ul class="h7_ul"><li>weekdays</li><li> </li></ul><table class="content_table"><tbody>'), plan("교내"), plan("캠퍼스"), F.lit('</tbody></table><table class="content_table"><tbody><tr><td>short</td></tr>'), route("교내", "08:30"), route("캠퍼스", "08:10"), F.lit("</tbody></table></div>"))
    pages = table(spark, sf_dir, "nation").select(F.concat(F.lit("raw/s"), k, F.lit(".html")).alias("path"), html.alias("html"))
    return D.shuttle_documents(pages)


def _index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a calendar's index, parts as lines of a dining index; some are broken."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    year = F.when(k % 3 == 0, F.lit('"2020"')).when(k % 3 == 1, F.lit("2025")).otherwise(F.lit("2026"))
    meta = F.when(k % 13 == 0, F.lit("[1]")).when(k % 17 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"domain": "academic_calendar", "year": '), year, F.lit("}")))
    text = F.concat(F.lit("- "), day, F.lit(": "), F.when(k % 2 == 0, "하기방학").otherwise("term"), F.lit("\\n"))
    line = F.concat(F.lit('{"id": "c'), k.cast("string"), F.lit('", "text": "'), F.when(k % 19 == 0, "").otherwise(text), F.lit('", "metadata": '), meta, F.when(k % 23 == 0, "").otherwise("}"))
    n = F.col("p_partkey")
    kind = F.when(n % 3 == 0, F.lit(', "document_type": "operating_info"')).when(n % 3 == 1, F.lit(', "document_type": "daily"')).otherwise("")
    dining = F.concat(F.lit('  {"id": "d'), n.cast("string"), F.lit('", "text": "x", "metadata": {"domain": "dining"'), kind, F.lit("}} "))
    return o.select(F.lit(0).alias("ord"), k.alias("at"), line.alias("line")).unionByName(p.select(F.lit(1).alias("ord"), n.alias("at"), dining.alias("line"))).unionByName(p.select(F.lit(2).alias("ord"), n.alias("at"), F.lit(" ").alias("line")))


_STATES = """s AS (SELECT 0 AS ord, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, 'c' || o_orderkey AS id, CASE WHEN k % 13 = 0 OR k % 19 = 0 OR k % 23 = 0 THEN 'failed' WHEN k % 17 <> 0 AND k % 3 = 1 THEN 'trimmed' ELSE 'kept' END AS state, CASE WHEN k % 17 = 0 THEN NULL ELSE 'academic_calendar' END AS domain FROM orders
UNION ALL SELECT 1, p_partkey, NULL, 'd' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE 'skipped' END, 'dining' FROM part),
t AS (SELECT *, ord = 0 AND domain IS NOT NULL AND k % 2 = 0 AND state = 'kept' AS more, '- ' || strftime(d, '%Y-%m-%d') || ': ' || CASE WHEN k % 2 = 0 THEN '하기방학' ELSE 'term' END AS body, d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS w FROM s)"""


@register(f"""WITH {_STATES} SELECT ord, id, CASE WHEN ord = 1 THEN 'x' WHEN more THEN body || chr(10) || '- ' || strftime(w, '%Y-%m-%d') || ': 제1학기 종강(하기방학 직전, 추정)' ELSE body || chr(10) END AS text, domain FROM t WHERE state = 'kept'""")
def clean_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged index: valid lines, no calendar of earlier years, no daily menus, ends of semesters added."""
    return D.merged(_index_lines(spark, sf_dir)).select("ord", "id", "text", "domain")


@register(f"""WITH {_STATES} SELECT count(*) AS total, count(*) FILTER (state = 'kept') AS valid, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'trimmed') AS trimmed, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (more) AS derived FROM t""")
def clean_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_counts(_index_lines(spark, sf_dir))


@register("""SELECT doc_id AS page, 'd 2026학년도 졸업요건 - 페이지 ' || doc_id AS title, '출처: s' || chr(10) || '학과: d' || chr(10) || '교육과정적용연도: 2026' || chr(10) || '페이지: ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || source END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '[표]' || chr(10) || lang || ' | ' || source || chr(10) || 'x' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || '이 페이지는 이미지 기반 내용이 있어 OCR 후 보강이 필요합니다.' ELSE '' END AS text FROM documents""")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted pages, their tables and notes as texts."""
    k = F.col("doc_id")
    tables = F.when(k % 2 == 0, F.array(F.array(F.array("lang", "source"), F.array(F.lit("x"))))).otherwise(F.array().cast("array<array<array<string>>>"))
    pages = table(spark, sf_dir, "documents").select(k.alias("page"), F.when(k % 3 == 0, " ").otherwise(F.concat("source", F.lit(" "))).alias("text"), tables.alias("tables"), (k % 7 == 0).alias("needs_ocr"))
    return D.page_documents(pages, "s", "d", "2026")


@register("SELECT doc_id AS id, lang AS title, CAST(n_chars AS VARCHAR) AS text, source AS source_url, lang AS source_name, 'graduation' AS domain, source AS department, doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'stated' ELSE 'file' END AS provenance_status, true AS curated FROM documents")
def curated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("n_chars").cast("string").alias("text"), F.col("source").alias("source_url"), F.col("lang").alias("source_title"), F.col("source").alias("department"), F.when(F.col("doc_id") % 2 == 0, "stated").alias("provenance_status"))
    return D.curated(docs, "file")


@register("""SELECT 'one' AS source_id, '안내문서 다른것' AS title, CASE WHEN o_orderkey % 3 = 0 THEN '2026학년도 안내문서 ' ELSE '안내문서 ' END || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ' 만족도조사 x' ELSE '' END AS full_text, o_orderkey FROM orders""".replace("SELECT 'one'", "SELECT o_orderkey, rtrim(split_part(full_text, '만족도조사', 1)) AS text FROM (SELECT 'one'", 1) + ")")
def page_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main parts of pages from behind their navigation words to their footers."""
    from ..functions import text as T

    k = F.col("o_orderkey")
    html = F.concat(F.lit("<div>head</div><main class='m'>본문 바로가기 menu 사이트맵<br>"), F.when(k % 3 == 0, "start 2026학년도 ").otherwise("start "), F.lit("<b>안내문서</b> "), "o_orderpriority", F.when(k % 5 == 0, " 만족도조사 x").otherwise(""), F.lit("</main><footer>f</footer>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.body_text(T.main_text(html), "안내 안내문서 다른것").alias("text"))

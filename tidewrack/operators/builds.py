"""Stored pages and records to index documents, their reports, and the merge of all indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import campus as P
from ..functions import menus as M
from ..functions import text as T
from .live import active_halls
from .menus import daily_text
from .relational import keep_first, months_covered

#: Years of calendar files that are read, and the least year of calendar documents in the merged index.
CALENDAR_YEARS, LEAST_YEAR = (2023, 2024, 2025, 2026), 2026
#: Dining documents that go to the merged index.
STABLE_DINING = ("operating_info", "food_court_corner")
#: Vacations and the semester that ends on the last weekday before each.
VACATIONS = {"하기방학": "제1학기", "동기방학": "제2학기"}
#: Side dishes, which don't count for a corner's prices.
SIDES = ("공기밥", "치즈추가", "구운계란2개", "마라맛", "½우동", "주먹밥2개")


def path_key(path: Column) -> Column:
    """Paths as the source table names them: forward slashes, small letters."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def with_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds url, fetched_at and source_id of ``sources`` (path, …) to each file; nulls where there is none."""
    known = sources.select(path_key(F.col("path")).alias("_key"), "url", "fetched_at", "source_id")
    return files.withColumn("_key", path_key(F.col("path"))).join(known, "_key", "left").drop("_key")


def without_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files that the source table doesn't know; notice files needn't be there."""
    name = F.lower(F.element_at(F.split("path", r"[\\/]"), -1))
    asked = files.where(~F.contains(name, F.lit("notice")) & ~F.contains(name, F.lit("dining_operation"))).withColumn("_key", path_key(F.col("path")))
    return asked.join(sources.select(path_key(F.col("path")).alias("_key")), "_key", "left_anti").select("path")


def dining_files(files: DataFrame) -> DataFrame:
    """path, view, records of stored dining pages (path, html); a page is parsed once, however many of these are asked for."""
    return files.select("path", F.explode(F.array(P.dining_file(F.col("path"), F.col("html")))).alias("f")).select("path", "f.view", "f.records")


def dining_rows(parsed: DataFrame) -> DataFrame:
    """One row for each record, in the order of paths and of places in a page."""
    rows = parsed.where(F.col("view").isin("weekly", "daily")).select("path", F.posexplode("records").alias("at", "r"))
    return rows.select("path", "at", F.col("r.day").cast("date").alias("day"), "r.hall", "r.meal", "r.audience", "r.menu_text", "r.menu_name", "r.price")


KEYS = ("day", "hall", "meal", "audience")


def _flat(c: Column) -> Column:
    return F.translate(c, " \n", "")


def unique_records(rows: DataFrame) -> DataFrame:
    """The first record of each day, hall, meal and audience."""
    return keep_first(rows, list(KEYS), ["path", "at"])


def record_counts(rows: DataFrame) -> DataFrame:
    """raw, unique, duplicates, conflicts and closed records, as one row.

    A later record of a key is a duplicate if it says the same as the first, white space
    aside, else a conflict.
    """
    first = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min_by(_flat(F.col("menu_text")), F.struct("path", "at")).alias("kept"))
    same = rows.select(*KEYS, _flat(F.col("menu_text")).alias("flat")).groupBy(*KEYS, "flat").agg(F.count("*").alias("m"))
    joined = first.join(same, [*KEYS]).groupBy(*KEYS).agg(F.first("n").alias("n"), F.first("kept").alias("kept"), F.sum(F.when(F.col("flat") == F.col("kept"), F.col("m"))).alias("equal"))
    return joined.agg(F.sum("n").alias("raw"), F.count("*").alias("unique"), F.sum(F.col("equal") - 1).alias("duplicates"), F.sum(F.col("n") - F.col("equal")).alias("conflicts"), F.count_if(F.col("kept") == M.CLOSED).alias("closed"))


def dining_documents(records: DataFrame) -> DataFrame:
    """id, title, text, halls, records, sources, path of each day with a printed record."""
    kept = records.where(M.posted(F.col("hall"), F.col("menu_text")))
    about = records.where(F.col("hall").isin(M.DAILY_HALLS) & (F.replace(F.trim("menu_text"), F.lit(" ")) != M.CLOSED)).groupBy("day").agg(F.count("*").alias("records"), F.count_distinct("path").alias("sources"), F.min("path").alias("path"))
    made = daily_text(kept).join(about, "day").join(active_halls(kept), "day")
    return made.select(F.concat(F.lit("dining_"), F.date_format("day", "yyyy-MM-dd")).alias("id"), F.concat(M.day_title(F.col("day")), F.lit(" 학생식당 식단")).alias("title"), F.col("menu").alias("text"), F.array_join("halls", ",").alias("halls"), "records", "sources", "path")


def standalone(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of records with one that is neither empty nor closed."""
    flat = F.replace(F.trim("menu_text"), F.lit(" "))
    return records.groupBy(*keys).agg(F.bool_or((flat != "") & (flat != M.CLOSED)).alias("standalone"))


def main_dish(name: Column) -> Column:
    """Not a side dish, a topping or a cup."""
    flat = F.replace(name, F.lit(" "))
    return ~flat.isin(*SIDES) & ~F.contains(flat, F.lit("토핑")) & ~F.startswith(flat, F.lit("컵"))


def price_range(items: Column, otherwise: Column) -> Column:
    """Least and greatest price of the main dishes of array<struct<name, price>>; without any, a stated text."""
    prices = F.transform(F.filter(items, lambda x: main_dish(x["name"])), lambda x: x["price"])
    num = lambda c: F.format_number(c.cast("decimal(38,0)"), 0)
    return F.when(F.size(prices) > 0, F.concat(num(F.array_min(prices)), F.lit("~"), num(F.array_max(prices)), F.lit("원"))).otherwise(otherwise)


def food_court(corners: DataFrame, hall: str) -> DataFrame:
    """id, title, text of each corner (corner, hours, price_range, notes, items, origins) of a food court."""
    line = F.transform("items", lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), T.price(x["price"].cast("string"))))
    title = F.concat(F.lit(f"{hall} 푸드코트 "), "corner")
    text = F.concat(F.lit("# "), title, F.lit("\n\n운영시간: "), "hours", F.lit("\n가격대: "), price_range(F.col("items"), F.col("price_range")), F.lit("\n운영 참고: "), "notes", F.lit("\n\n## 메뉴\n"), F.array_join(line, "\n"), F.lit("\n\n## 원산지\n"), "origins")
    return corners.select(F.concat(F.lit(f"dining_food_court_{hall}_"), F.regexp_replace("corner", "[^0-9A-Za-z가-힣&()]", "")).alias("id"), title.alias("title"), F.trim(text).alias("text"))


def operating_info(records: DataFrame, corners: DataFrame) -> DataFrame:
    """id, text: which meals each hall has for whom on weekdays, and the food court's corners, as one document."""
    kept = records.where(M.posted(F.col("hall"), F.col("menu_text")) & (F.weekday("day") < 5))
    by_meal = kept.groupBy("hall", M.meal_name(F.col("meal")).alias("meal")).agg(F.collect_set("audience").alias("s"))
    order = F.array(*(F.lit(a) for a in M.AUDIENCES))
    said = F.array_join(F.concat(F.filter(order, lambda a: F.array_contains("s", a)), F.array_sort(F.array_except("s", order))), ", ")
    grid = by_meal.select("hall", "meal", said.alias("who")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "hall", "meal"), "who"))).alias("m"))
    cell = lambda h, m: F.coalesce(F.try_element_at("m", F.lit(f"{h}|{m}")), F.lit("-"))
    rows = [F.concat(F.lit(f"| {h} | "), F.concat_ws(" | ", *(cell(h, m) for m in M.MEALS.values())), F.lit(" |")) for h in M.DAILY_HALLS]
    listed = corners.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("| "), "corner", F.lit(" | "), "hours", F.lit(" | "), price_range(F.col("items"), F.col("price_range")), F.lit(" |")).alias("line")))), lambda x: x["line"]), "\n").alias("court"))
    head = "# 학생식당 운영 안내\n\n## 학생식당 주중 운영표\nraw 식단 데이터에서 실제 제공 메뉴가 확인된 끼니와 대상을 집계했습니다.\n\n| 식당 | 아침 | 점심 | 저녁 |\n| --- | --- | --- | --- |\n"
    text = F.concat(F.lit(head), F.concat_ws("\n", *rows), F.lit("\n\n## 주말 운영 여부\n주말·공휴일 미운영\n\n## 제1학생회관 푸드코트 개요\n| 코너 | 운영시간 | 가격대 |\n| --- | --- | --- |\n"), "court", F.lit("\n\n공통: 주말 미운영."))
    # one row each
    return grid.join(F.broadcast(listed)).select(F.lit("dining_operating_info").alias("id"), text.alias("text"))


def legacy_records(documents: DataFrame) -> DataFrame:
    """day, hall, meal, audience, menu_text, path of older index documents (id, day, hall, path, text).

    Their texts hold a heading for each meal, below it items of an audience, and indented
    lines that go on.  Documents without a day or a hall are left out.
    """
    lines = documents.where("day IS NOT NULL AND hall <> ''").select("id", "day", "hall", "path", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", F.rtrim("raw"))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_meal, is_item = F.startswith("line", F.lit("### ")), F.startswith("line", F.lit("- "))
    told = lines.withColumn("meal", F.last(F.when(is_meal, F.trim(F.substring("line", 5, 1_000_000))), ignorenulls=True).over(w))
    told = told.withColumn("part", F.sum((is_meal | (is_item & F.col("meal").isNotNull())).cast("int")).over(w))
    payload = F.substring("line", 3, 1_000_000)
    head = is_item & F.contains(payload, F.lit(":")) & F.col("meal").isNotNull()
    said = F.when(head, F.trim(F.substring(payload, F.instr(payload, ":") + 1, F.length(payload)))).when(F.startswith("line", F.lit("  ")), F.trim("line"))
    rows = told.select("id", "day", "hall", "path", "meal", "part", "at", F.when(head, F.trim(F.substring_index(payload, ":", 1))).alias("audience"), said.alias("said"))
    # a part is what stands below one item of one document
    made = rows.groupBy("id", "day", "hall", "path", "meal", "part").agg(F.max("audience").alias("audience"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("at", "said")))), lambda x: x["said"]), "\n").alias("menu_text"))
    return made.where("meal <> '' AND audience <> ''").select("day", "hall", "meal", "audience", "menu_text", "path")


def first_source(options: Sequence[tuple[str, DataFrame]]) -> tuple[str, DataFrame | None]:
    """Name and rows of the first source that has any; ("none", None) without one."""
    return next(((name, df) for name, df in options if not df.isEmpty()), ("none", None))


def calendar_files(files: DataFrame) -> DataFrame:
    """path, year, skipped, lines; pages of other years than the wanted ones are skipped as well."""
    named = F.regexp_extract("path", r"_(\d{4})\.html$", 1).try_cast("int")
    parsed = files.select("path", P.calendar_file(F.col("path"), F.col("html")).alias("f"), named.alias("named")).select("path", "named", "f.*")
    other = ~F.coalesce(F.col("named").isin(*CALENDAR_YEARS), F.lit(False))
    return parsed.select("path", "year", F.coalesce("skipped", F.when(other, "Not a target year file")).alias("skipped"), "lines")


def calendar_events(parsed: DataFrame) -> DataFrame:
    """path, at, page_year, name, start, end, days of each line of the pages that are read; start is null for days that can't be read."""
    rows = parsed.where("skipped IS NULL").select("path", F.col("year").alias("page_year"), F.posexplode("lines").alias("at", "x"))
    span = C.date_range(F.col("x.days"), F.col("page_year"), F.col("x.box"))
    return rows.select("path", "at", "page_year", F.col("x.event").alias("name"), F.col("x.days").alias("days"), span.alias("s")).select("path", "at", "page_year", "name", "days", "s.start", "s.end")


def unique_events(events: DataFrame) -> DataFrame:
    """Each event once, by its days and name; the first page counts."""
    return keep_first(events.where("start IS NOT NULL"), ["start", "end", "name"], ["path", "at"])


def calendar_report(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """files, skipped, raw, unique, duplicates, failures and years with their first and last day and months, as one row."""
    read = parsed.agg(F.count_if(F.col("skipped").isNull()).alias("files"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"))
    once = unique_events(events)
    counts = events.agg(F.count("start").alias("raw"), F.count_if(F.col("start").isNull()).alias("failures"))
    years = once.groupBy(F.year("start").alias("y")).agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("z"))
    said = years.agg(F.sum("n").alias("unique"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "n", "a", "z"))), lambda x: F.format_string("%d:%d %s~%s", x["y"], x["n"], x["a"].cast("string"), x["z"].cast("string"))), ", ").alias("years"))
    return read.join(F.broadcast(counts)).join(F.broadcast(said)).select("files", "skipped", "raw", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), (F.col("raw") - F.coalesce("unique", F.lit(0))).cast("long").alias("duplicates"), "failures", "years")


def calendar_documents(once: DataFrame) -> DataFrame:
    """id, title, text, events, page_years of each month that an event touches, in the order of pages."""
    rows = once.withColumn("month", F.explode(months_covered(F.col("start"), F.col("end"))))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    line = F.concat(F.lit("- "), iso("start"), F.when(F.col("start") == F.col("end"), "").otherwise(F.concat(F.lit(" ~ "), iso("end"))), F.lit(": "), F.col("name"))
    made = rows.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("path", "at", line.alias("line")))).alias("all"), F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("page_year")), ",").alias("page_years"))
    label = F.concat(F.year("month").cast("string"), F.lit("년 "), F.month("month").cast("string"), F.lit("월"))
    return made.select(F.concat(F.lit("calendar_month_"), F.date_format("month", "yyyy_MM")).alias("id"), F.concat(label, F.lit(" 학사일정")).alias("title"), F.concat(label, F.lit(" 충남대학교 학사일정입니다.\n\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("text"), "events", "page_years")


def is_month(id_: Column, kind: Column) -> Column:
    return F.coalesce(F.startswith(id_, F.lit("calendar_month_")), F.lit(False)) | F.coalesce(kind == "month", F.lit(False))


def stored_months(documents: DataFrame) -> DataFrame:
    """Month documents among stored ones (id, title, text, doc_type, year, month), their labels without a leading zero."""
    padded, natural = F.format_string("%04d년 %02d월", "year", "month"), F.format_string("%04d년 %d월", "year", "month")
    fixed = lambda c: F.when(F.col("year").isNull() | F.col("month").isNull(), F.col(c)).otherwise(F.replace(F.col(c), padded, natural))
    return documents.where(is_month(F.col("id"), F.col("doc_type"))).withColumns({c: fixed(c) for c in ("title", "text")})


def months_by_year(documents: DataFrame) -> DataFrame:
    """year, months of month documents, from their fields or else from their ids."""
    named = lambda k: F.regexp_extract("id", r"^calendar_month_(\d{4})_(\d{2})$", k).try_cast("int")
    known = F.col("year").isNotNull() & F.col("month").isNotNull()
    rows = documents.select(F.when(known, F.col("year")).otherwise(named(1)).alias("year"), F.when(known, F.col("month")).otherwise(named(2)).alias("month")).where("year IS NOT NULL AND month IS NOT NULL")
    return rows.groupBy("year").agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"))


def shuttle_documents(files: DataFrame) -> DataFrame:
    """path, kind, name, text, route_type, first, last, stops, trips, posted of stored shuttle pages."""
    rows = files.select("path", F.explode(P.shuttle_records(F.col("path"), F.col("html"))).alias("r")).select("path", "r.*")
    kind = F.when(F.col("kind") == "route", F.when(F.contains("name", F.lit("교내")), "campus_circulation").otherwise("campus_loop"))
    return rows.select("path", "kind", "name", "text", kind.alias("route_type"), "first", "last", "stops", "trips", "posted")


def intact(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose bytes (path, content) have the digest that the source table (path, sha256) states; any other one fails the read."""
    rows = files.join(sources.select("path", "sha256"), "path")
    return rows.withColumn("content", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch: "), "path")).cast("binary"))).drop("sha256")


def page_documents(pages: DataFrame, source: str, department: str, year: str) -> DataFrame:
    """page, title, text of extracted pages (page, text, tables, needs_ocr): heading lines, text, tables, a note where text is missing."""
    head = F.concat(F.lit(f"출처: {source}\n학과: {department}\n교육과정적용연도: {year}\n페이지: "), F.col("page").cast("string"))
    body = F.when(F.trim("text") != "", F.concat(F.lit("\n\n"), F.trim("text"))).otherwise("")
    tables = F.array_join(F.transform("tables", lambda t: F.concat(F.lit("\n\n[표]"), F.array_join(F.transform(t, lambda r: F.concat(F.lit("\n"), F.array_join(r, " | "))), ""))), "")
    note = F.when(F.col("needs_ocr"), "\n\n이 페이지는 이미지 기반 내용이 있어 OCR 후 보강이 필요합니다.").otherwise("")
    return pages.select("page", F.concat(F.lit(f"{department} {year}학년도 졸업요건 - 페이지 "), F.col("page").cast("string")).alias("title"), F.concat(head, body, tables, note).alias("text"))


def page_report(pages: DataFrame) -> DataFrame:
    """pages, to_scan (numbers of pages without text), tables and characters by page, as one row."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", c.alias("v")))), lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["v"].cast("string"))), ",")
    return pages.agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page")))), ",").alias("to_scan"), listed(F.size("tables")).alias("tables"), listed(F.length("text")).alias("chars"))


def curated(docs: DataFrame, provenance: str) -> DataFrame:
    """Curated documents under the index's names; a stated provenance goes before the file's own."""
    return docs.select("id", "title", "text", "source_url", F.col("source_title").alias("source_name"), F.lit("graduation").alias("domain"), "department", F.col("id").alias("source_id"), F.coalesce("provenance_status", F.lit(provenance)).alias("provenance_status"), F.lit(True).alias("curated"))


def semester_ends(text: Column) -> Column:
    """Lines for the last weekday before each vacation that a month's text names, but those it holds already."""
    names = "|".join(VACATIONS)
    found = F.regexp_extract_all(text, F.lit(rf"\d{{4}}-\d{{2}}-\d{{2}}:\s*(?:{names})"), F.lit(0))

    def line(x: Column) -> Column:
        day, vacation = F.to_date(F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd"))), F.regexp_extract(x, names, 0)
        semester = F.coalesce(*(F.when(vacation == v, s) for v, s in VACATIONS.items()))
        return F.concat(F.lit("- "), F.date_format(C.last_workday_before(day), "yyyy-MM-dd"), F.lit(": "), semester, F.lit(" 종강("), vacation, F.lit(" 직전, 추정)"))

    return F.array_distinct(F.filter(F.transform(found, line), lambda x: x.isNotNull() & ~F.contains(text, x)))


def index_lines(lines: DataFrame) -> DataFrame:
    """Adds what becomes of each JSON line (ord, at, line) of the indexes, read in the order of ord.

    state: failed (no object with an id and a text, or with metadata that is no object),
    trimmed (a calendar month of an earlier year), skipped (a daily menu) or kept; id, text
    with derived lines, domain and derived, their number.  Blank lines are left out.
    """
    v = F.try_parse_json("line")
    got = lambda p, t="string": F.try_variant_get("v", p, t)
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    rows = lines.where(F.trim("line") != "").withColumn("v", v)
    rows = rows.withColumns({"id": got("$.id"), "said": got("$.text"), "domain": got("$.metadata.domain"), "type": got("$.metadata.document_type"), "meta": kind("$.metadata"), "year": F.when(kind("$.metadata.year") == "BIGINT", got("$.metadata.year", "long"))})
    whole = F.col("v").isNotNull() & F.startswith(F.trim("line"), F.lit("{")) & (F.coalesce("id", F.lit("")) != "") & (F.coalesce("said", F.lit("")) != "") & (F.col("meta").isNull() | (F.col("meta") == "VOID") | F.startswith("meta", F.lit("OBJECT")))
    calendar, dining = F.coalesce(F.col("domain") == "academic_calendar", F.lit(False)), F.coalesce(F.col("domain") == "dining", F.lit(False))
    state = F.when(~F.coalesce(whole, F.lit(False)), "failed").when(calendar & (F.coalesce("year", F.lit(LEAST_YEAR)) < LEAST_YEAR), "trimmed").when(dining & ~F.coalesce(F.col("type").isin(*STABLE_DINING), F.lit(False)), "skipped").otherwise("kept")
    more = F.when(calendar, semester_ends(F.col("said"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("state", state).withColumn("more", F.when(F.col("state") == "kept", more))
    text = F.when(F.size("more") > 0, F.concat(F.regexp_replace("said", T.SPACE + "+$", ""), F.lit("\n"), F.array_join("more", "\n"))).otherwise(F.col("said"))
    return rows.select("ord", "at", "line", "state", "id", text.alias("text"), "domain", F.coalesce(F.greatest(F.size("more"), F.lit(0)), F.lit(0)).alias("derived"))


def merged(lines: DataFrame) -> DataFrame:
    """The kept documents of all indexes."""
    return index_lines(lines).where("state = 'kept'")


def merge_counts(lines: DataFrame) -> DataFrame:
    """total, valid, failed, trimmed, skipped, derived, as one row."""
    n = lambda s: F.count_if(F.col("state") == s)
    return index_lines(lines).agg(F.count("*").alias("total"), n("kept").alias("valid"), n("failed").alias("failed"), n("trimmed").alias("trimmed"), n("skipped").alias("skipped"), F.coalesce(F.sum("derived"), F.lit(0)).alias("derived"))

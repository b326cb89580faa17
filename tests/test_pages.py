"""Parsers and builds that the registered queries don't reach."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import boards as B
from tidewrack.functions import campus as P
from tidewrack.operators import builds as D
from tidewrack.operators import notices as N


def test_daily_page_and_views():
    page = '<div class="menu-navi weekly"><span class="term">2026.06.09 (화)</span></div><ul id="childTab"><li class="over">2026-06-09</li></ul><table class="menu-tbl"><thead><tr><th colspan=2>구분</th><th>제2학생회관</th><th>생활과학대학</th></tr></thead><tbody><tr><td class="building">중식</td><td>학생</td><td>a<br>b</td><td>메뉴운영내역 없음</td></tr></tbody></table>'
    assert P.dining_view("x/d.html", page) == "daily"
    assert P.dining_records("d.html", page) == [{"day": "2026-06-09", "hall": "제2학생회관", "meal": "중식", "audience": "학생", "menu_text": "a\nb", "menu_name": None, "price": None}]
    assert P.dining_view("Dining_Operation.html", page) == "Skipped notice file" and P.dining_records("notice.html", page) == []


def test_calendar_pages():
    assert P.calendar_state("a/academic_calendar.html", "")["skipped"] == "Skipped file"
    assert P.calendar_state("c_2025.html", "<p>")["skipped"] == "No year tag found"
    assert P.calendar_state("c_2025.html", '<strong class="year">x</strong>')["skipped"] == "Invalid year: x"
    assert P.calendar_state("c_2025.html", '<strong class="year">2025</strong>')["skipped"] == "No calen_box elements found"


def test_geology_notice():
    page = '<html><head><title>Geological Sciences Shuttle Notice</title><meta property="og:description" content="more"></head><table id="mb_announcement_tr_title"><tr><td><span style="float:right">2026-03-01 09:00</span></td></tr></table><div id="hwpEditorBoardContent">{"t":"셔틀 안내","x":1} {"t" : "가"} {"t":"abc"}</div></html>'
    (one,) = P.shuttle_page("raw/geo_notice_1.html", page)
    assert (one["kind"], one["name"], one["text"], one["posted"]) == ("notice", "Shuttle", "셔틀 안내\nmore", "2026-03-01")
    assert P.shuttle_page("geo_notice.html", "<p>x</p>") == [] and P.shuttle_page("s.html", "<p>") == []


def test_notice_bodies():
    assert B.body_of('<div class="x-content">a</div><section id="b-content">the <b>body</b></section>', "marked") == "the body"
    assert B.body_of("<div class='content'></div><p>whole page</p>", "plain") == "whole page"
    assert B.body_of("로그인 목록 목록 이전글 다음글 x", "plain") == "" and B.body_of(None, None) == ""
    short = "<tbody><tr><td>공지</td><td><a href='/v?a=1&amp;b=2'>t</a></td><td>who</td><td>26.03.01</td><td>9</td></tr><tr><td>1</td></tr></tbody>"
    assert B.marked_rows(short, "http://h.example/list") == [{"title": "t", "author": "who", "date": "2026-03-01", "url": "http://h.example/v?a=1&b=2", "pinned": True}]
    assert N.keyword_list(" a ") == ["a"] and N.keyword_list([" a", "a", "", "b", "c", "d"]) == ["a", "b", "c"] and N.keyword_list(None) == []


def test_unknown_board_has_no_notices(spark):
    items = N.read_boards(spark.createDataFrame([], "board string, label string, ord int, page long, url string, layout string, html string"))
    boards = [{"board": "b", "label": "l", "title": "t", "url": "u"}]
    assert N.recent(items, boards, board="x").count() == 0 and N.recent(items, boards).count() == 0 and N.recent(items, boards, keywords="k", first=["b"]).count() == 0


def test_integrity_and_page_report(spark):
    good, bad = b"one", b"two"
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad))], "path string, content binary")
    sources = spark.createDataFrame([("a", hashlib.sha256(good).hexdigest()), ("b", hashlib.sha256(good).hexdigest())], "path string, sha256 string")
    assert D.intact(files.where("path = 'a'"), sources).count() == 1
    with pytest.raises(Exception, match="digest mismatch"):
        D.intact(files, sources).collect()
    pages = spark.createDataFrame([(2, "", [], True), (1, "abc", [[["x"]]], False)], "page int, text string, tables array<array<array<string>>>, needs_ocr boolean")
    assert tuple(D.page_report(pages).first()) == (2, "2", "1:1,2:0", "1:3,2:0")


def test_sources_fall_back_in_order(spark):
    empty, some = spark.range(0), spark.range(2)
    assert D.first_source([("pages", empty), ("report", some)])[0] == "report" and D.first_source([("pages", empty)]) == ("none", None)
    rows = spark.createDataFrame([("h", "운영 안함"), ("h", " "), ("i", "밥")], "hall string, menu_text string")
    assert {(r.hall, r.standalone) for r in D.standalone(rows, ["hall"]).collect()} == {("h", False), ("i", True)}


def test_semester_ends(spark):
    text = "- 2026-06-22: 하기방학\n- 2026-12-19:동기방학\n- 2026-06-19: 제1학기 종강(하기방학 직전, 추정)"
    assert spark.createDataFrame([(text,)], "t string").select(D.semester_ends(F.col("t")).alias("x")).first().x == ["- 2026-12-18: 제2학기 종강(동기방학 직전, 추정)"]


def test_registered_pages(spark):
    from tidewrack.operators import live

    pages = spark.createDataFrame([("u1", "<main>side note Guide book. text &amp; more</main>"), ("u1", None), ("u2", "<main></main>"), ("u3", "<main>Guide</main>"), (None, "<main>x</main>"), ("u4", "<main>plain</main>")], "url string, html string").withColumn("title", F.lit("clash"))
    registry = spark.createDataFrame([("a", "u1", "the Guide book"), ("b", "u2", "x"), ("c", "u9", "x"), ("d", None, "x"), ("e", "u4", None)], "source_id string, url string, title string")
    got = {r.id: (r.text, r.url, r.metadata) for r in live.page_evidence(pages.select("url", "html"), registry).collect()}
    assert got == {"live_page_a": ("Guide book. text & more", "u1", {"tool": "fetch_page_text", "source_id": "a"}), "live_page_e": ("plain", "u4", {"tool": "fetch_page_text", "source_id": "e"})}
    long = spark.createDataFrame([("u1", "<main>" + "y" * 5000 + "</main>")], "url string, html string")
    assert [len(r.text) for r in live.page_evidence(long, registry).collect()] == [live.PAGE_CHARS]


def test_requested_boards(spark):
    from tidewrack.operators import live

    df = spark.createDataFrame([("Shown ",), ("internal",), ("other",), (" ",), (None,), ("unknown",)], "v string")
    asked = live.requested_board(F.col("v"), {"Shown": "internal", "Aliased": "other"}, {"other": "site"})
    assert [tuple(r.x) for r in df.select(asked.alias("x")).collect()] == [("internal", None), ("internal", None), ("site", "other"), (None, None), (None, None), ("unknown", None)]
    assert [tuple(r.x) for r in df.limit(1).select(live.requested_board(F.col("v"), {}, {}).alias("x")).collect()] == [("Shown", None)]


def test_representatives_of_hot_groups(spark):
    from tidewrack.operators import relational

    rows = [(k, "hot", k % 50) for k in range(3000)] + [(9000, "a", 1), (9001, None, 2), (9002, "a", 1)]
    df = spark.createDataFrame(rows, "k int, g string, t int")
    newest = [F.col("t").desc(), F.col("k")]
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    for n in (1, 2, 5, 4000):
        first = {}
        for r in order:
            first.setdefault(r[1], r)
        reps = sorted(first.values(), key=lambda r: (-r[2], r[0]))
        rest = [r for r in order if r not in reps]
        want = sorted((reps + rest)[:n], key=lambda r: (-r[2], r[0]))
        assert [tuple(r) for r in relational.representatives_then_fill(df, "g", newest, n).collect()] == want
    plan = relational.representatives_then_fill(df, "g", newest, 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_pages_that_were_fetched_for_a_source_meet_it_alone(spark):
    from tidewrack.operators import live

    pages = spark.createDataFrame([("a", "u1", "<main>one</main>"), ("b", "u1", "<main>two</main>"), ("c", None, "<main>three</main>")], "source_id string, url string, html string")
    registry = pages.select("source_id", "url", F.lit("t").alias("title"))
    got = {(r.id, r.text, r.url) for r in live.page_evidence(pages, registry, "source_id").collect()}
    assert got == {("live_page_a", "one", "u1"), ("live_page_b", "two", "u1"), ("live_page_c", "three", None)}
    assert live.page_evidence(pages.drop("source_id"), registry).count() == 4


def test_board_documents_have_whole_bodies(spark):
    body = "x" * (N.BODY + 500) + " end"
    selected = spark.createDataFrame([("1", "t", "2026-01-01", "u", False)], "no string, title string, date string, url string, pinned boolean")
    details = spark.createDataFrame([("1", "t", "2026-01-01", "d", body, "u")], "no string, title string, date string, department string, body string, url string")
    assert N.board_documents(selected, details).first().text == body
    assert N.board_documents(selected, details, N.BODY).first().text == body[: N.BODY]


def test_the_query_of_board_documents_has_whole_bodies(spark):
    from tidewrack.plans import notices

    got = notices.board_documents(spark, "/root/testdata/sf0.1").where("NOT failed AND text LIKE '%xxx%'")
    assert {r.n for r in got.select(F.length(F.regexp_replace("text", "[^x]", "")).alias("n")).collect()} == {3000}

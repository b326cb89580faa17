from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import menus as M
from tidewrack.functions import text as T

TODAY = date(2026, 6, 13)


@pytest.mark.parametrize("question,want", [
    ("내일 학식", "2026-06-14"), ("어제 학식", "2026-06-12"), ("담주 화요일", "2026-06-16"), ("다음주 평일 식단", "2026-06-15 2026-06-16 2026-06-17 2026-06-18 2026-06-19"),
    ("이번 주말 식단", "2026-06-13 2026-06-14"), ("16일 메뉴", "2026-06-16"), ("일요일 메뉴", "2026-06-14"), ("2026-02-30 메뉴", None), ("11월 메뉴", None), ("금~월 메뉴", "2026-06-08 2026-06-12 2026-06-13 2026-06-14"), ("", None), (None, None),
    ("13월 5일 메뉴", "2026-06-05"), ("다음 주말", "2026-06-20 2026-06-21"), ("월부터 수까지 학식", "2026-06-08 2026-06-09 2026-06-10"), ("토핑 메뉴", None), ("다음주 토핑", "2026-06-20"), ("화, 목 학식", "2026-06-09 2026-06-11"),
    ("수요일부터 금요일까지 다음주", "2026-06-17 2026-06-18 2026-06-19"), ("지난주 월 이번주 화", "2026-06-01"), ("주중 식단", "2026-06-08 2026-06-09 2026-06-10 2026-06-11 2026-06-12"), ("2026-06-20이랑 6월 3일 오늘", "2026-06-03 2026-06-20"), ("1일~3일", "2026-06-01 2026-06-03"), ("이번 주 금요일", "2026-06-12"),
])
def test_dates_of(question, want):
    assert M.dates_of(question, TODAY) == (want.split() if want else None)


@pytest.mark.parametrize("text,name,cost,want", [("밥(1,500)\n국", None, None, "- 점심(학생) 밥 1,500원: 국"), ("밥", "정식", "4500", "- 점심(학생) 정식 4,500원"), (" \n", None, None, "- 점심(학생): "), ("밥\n 국  물 \n\n김치", "", "", "- 점심(학생) 밥: 국 물, 김치")])
def test_menu_line(spark, text, name, cost, want):
    row = spark.createDataFrame([("중식", "학생", text, name, cost)], "m string, a string, t string, n string, c string")
    assert row.select(M.menu_line(*(F.col(c) for c in "matnc")).alias("x")).first().x == want


def brute_merge(tokens, table):
    out, i = tokens[:1], 1
    while i < len(tokens):
        for k in range(4, 0, -1):
            if len(run := tuple(out[-1:] + tokens[i : i + k])) == k + 1 and run in table:
                out[-1], i = table[run], i + k
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_merge_compounds(spark):
    table = {("a", "b"): "ab", ("ab", "c"): "abc", ("b", "c", "d", "e", "f"): "bf", ("c", "c"): "c"}
    texts = ["a b c", "b c d e f a b", "c c c c", "", "a", "x a b b c d e f"]
    rows = spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "k int, t array<string>")
    got = {r.k: r.m for r in rows.select("k", T.merge_compounds(F.col("t"), table).alias("m")).collect()}
    assert got == {k: brute_merge(t.split(), table) for k, t in enumerate(texts)}


@pytest.mark.parametrize("text,want", [('{"a": 1, "b": "x"}', {"a": "1", "b": "x"}), ("[1]", {}), ("{bad", {}), ("", {}), (None, {})])
def test_object_of(spark, text, want):
    assert (spark.createDataFrame([(text,)], "x string").select(T.object_of(F.col("x")).alias("y")).first().y or {}) == want


def test_a_stored_page_is_parsed_once(spark):
    from tidewrack.operators import builds as D

    files = spark.createDataFrame([("raw/a.html", "<p>x</p>")], "path string, html string")
    plan = D.dining_rows(D.dining_files(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [(r.view, r.records) for r in D.dining_files(files).collect()] == [("No menu table found", [])]

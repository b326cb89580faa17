"""Stages in batches and streams, crawls that stop, and periods of days."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text as T
from tidewrack.operators import notices as N
from tidewrack.operators import periods as P
from tidewrack.streaming import deadlines as D

AT = "ts timestamp, event_type string"


def at(hour, minute, second=0):
    return datetime(2026, 6, 13, hour, minute, second)


def rows(df):
    return [(r.start.hour, r.boards, r.on_time, r.late, r.complete) for r in df.orderBy("start").collect()]


def test_stages_of_a_batch(spark):
    data = [(at(1, 0), "a"), (at(1, 20), "b"), (at(1, 20, 1), "c"), (at(1, 5), "a"), (at(2, 30), "a"), (at(3, 1), "x"), (None, "a"), (at(4, 1), None)]
    got = rows(D.stages(spark.createDataFrame(data, AT), ["a", "b", "c"]))
    assert got == [(1, "a,b", 3, 1, False), (2, "", 0, 1, False)]
    assert rows(D.stages(spark.createDataFrame(data, AT), ["a", "b"]))[0] == (1, "a,b", 3, 0, True)
    assert rows(D.stages(spark.createDataFrame([], AT), ["a"])) == []


def test_a_stream_drops_what_comes_after_a_stage_is_over(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*data):
        spark.createDataFrame(list(data), AT).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(AT).parquet(source)
        D.append(D.stages(stream, ["a", "b"], delay="10 minutes"), out, str(tmp_path / "checkpoint")).awaitTermination()
        return rows(D.closed(spark, out))

    put((at(1, 1), "a"), (at(2, 5), "a"))
    first = run()
    assert first == []  # the watermark is 1:55
    put((at(1, 10), "b"), (at(3, 30), "a"))  # still in time for both stages
    assert run() == [(1, "a,b", 2, 0, True), (2, "a", 1, 0, False)]
    put((at(1, 12), "b"), (at(2, 6), "b"), (at(3, 2), "b"), (at(6, 0), "a"))  # the first two stages are over
    assert run() == [(1, "a,b", 2, 0, True), (2, "a", 1, 0, False), (3, "b", 1, 1, False)]
    assert run() == rows(D.closed(spark, out)) and len(rows(D.closed(spark, out))) == 3


def brute_crawl(table, enough, most):
    out = []
    for board in {b for b, *_ in table if b is not None}:
        regular = page = 0
        while regular < enough and page < most:
            page += 1
            own = [r for r in table if r[0] == board and r[1] == page]
            out += own
            if not own:
                break
            regular += sum(not pinned for *_, pinned in own)
    return sorted(out, key=str)


@pytest.mark.parametrize(("enough", "most"), [(3, 20), (1, 2), (100, 4), (5, 1)])
def test_crawl_stops_as_a_loop_over_pages_does(spark, enough, most):
    import random

    r = random.Random(enough)
    table = [(r.choice("abcd"), r.choice([1, 1, 2, 2, 3, 4, 5, 6, 8]), r.random() < 0.4) for _ in range(80)] + [("late", 2, False), ("zero", 0, False), (None, 1, False), ("pins", 1, True), ("pins", 2, False)]
    df = spark.createDataFrame(table, "board string, page int, pinned boolean")
    assert sorted(map(tuple, N.crawled(df, enough, most).collect()), key=str) == brute_crawl(table, enough, most)
    assert N.crawled(df.limit(0), enough, most).count() == 0


PERIODS = [("spring", date(2026, 3, 3), date(2026, 6, 21), 1), ("extra", date(2026, 6, 15), date(2026, 7, 20), 2), ("turned", date(2026, 9, 9), date(2026, 9, 1), 0), ("open", None, date(2026, 1, 1), 0)]


def test_periods_with_gaps_and_overlaps(spark):
    periods = spark.createDataFrame(PERIODS, "label string, start date, end date, ord int")
    days = [(1, date(2026, 3, 2)), (2, date(2026, 3, 3)), (3, date(2026, 6, 21)), (4, date(2026, 6, 22)), (5, date(2026, 7, 21)), (6, None), (7, date(2026, 3, 3)), (8, date(2026, 9, 5))]
    df = spark.createDataFrame(days, "k int, day date")
    got = {r.k: r.label for r in P.period_at(df, "day", periods).select("k", "period.label").collect()}
    assert got == {1: None, 2: "spring", 3: "spring", 4: "extra", 5: None, 6: None, 7: "spring", 8: None}
    assert {r.period for r in P.period_at(df, "day", periods.limit(0)).collect()} == {None}


def test_term_boundaries(spark):
    """A term's last and first day for questions on them; none for short terms, other questions, or between periods."""
    periods = spark.createDataFrame(PERIODS[:1], "label string, start date, end date, ord int")
    asked = ["이번 학기 종강일이 언제인가요?", "이번 학기 개강일", "이번 여름 계절학기 종강일", "이번 학기 시간표", "학기 종강 2026년 6월", "학기 종료 개강", None]
    df = spark.createDataFrame([(k, q, date(2026, 6, 13)) for k, q in enumerate(asked)] + [(9, asked[0], date(2026, 8, 1))], "k int, q string, day date")
    held = P.period_at(df, "day", periods)
    more = {r.k: r.m for r in held.select("k", P.boundary_dates(F.col("q"), F.col("period")).alias("m")).collect()}
    assert more == {0: ["2026년 6월", "2026-06-21"], 1: ["2026년 3월", "2026-03-03"], 2: [], 3: [], 4: ["2026-06-21"], 5: ["2026년 6월", "2026-06-21", "2026년 3월", "2026-03-03"], 6: [], 9: []}
    said = {r.k: r.x for r in held.select("k", T.expand_dates(F.col("q"), F.col("day"), P.boundary_dates(F.col("q"), F.col("period"))).alias("x")).collect()}
    assert said[0] == asked[0] + " 2026년 6월 2026-06-21" and said[3] == asked[3] and said[9] == asked[0]


def test_temporal_context(spark):
    df = spark.createDataFrame([(date(2026, 6, 13), "제1학기"), (date(2026, 6, 14), None), (date(2026, 12, 28), "")], "day date, label string")
    week = "이번 주: 2026-06-08(월) ~ 2026-06-14(일), 평일 06-08~06-12\n다음 주: 2026-06-15(월) ~ 2026-06-21(일), 평일 06-15~06-19, 주말 06-20~06-21"
    assert [r.c for r in df.select(P.temporal_context(F.col("day"), F.col("label")).alias("c")).collect()][:2] == ["현재 기간: 제1학기\n" + week, week]

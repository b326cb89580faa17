"""Versions of an index: checks, reports and order."""

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import index_build as B

ROW = "id string, text string, date string"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = spark.createDataFrame([(f"n{k:03d}", f"text {k}", f"2026-06-{k % 28 + 1:02d}") for k in range(200)], ROW).repartition(3)
    counts = {"latest": F.max("date"), "chars": F.sum(F.length("text"))}
    with pytest.raises(ValueError, match="no version"):
        B.read(spark, path)
    first = B.build(rows, path, [F.col("date").desc(), "id"], B.notice_checks(), counts)
    assert first == {"version": 1, "rows": 200, "latest": "2026-06-28", "chars": sum(len(f"text {k}") for k in range(200))}
    assert sorted(map(tuple, B.read(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    second = B.build(rows.limit(3), path, ["id"])
    assert second == {"version": 2, "rows": 3} and B.read(spark, path).count() == 3 and B.read(spark, path, 1).count() == 200
    assert {r.version: r.rows for r in B.versions(spark, path).collect()} == {1: 200, 2: 3}
    for f in (tmp_path / "i/index/version=1").glob("*.parquet"):
        own = [(r.date, r.id) for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own, key=lambda x: (tuple(-ord(c) for c in x[0]), x[1]))


def test_a_refused_build_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "i")
    good = spark.createDataFrame([("a", "t", "2026-06-13")], ROW)
    B.build(good, path, ["id"], B.notice_checks())
    bad = spark.createDataFrame([("a", " ", "2026-06-13"), ("b", "t", None), ("c", None, ""), ("d", "t", "2026-06-13")], ROW)
    with pytest.raises(B.BuildRefused) as told:
        B.build(bad, path, ["id"], B.notice_checks())
    assert told.value.counts == {"empty_text": 2, "empty_date": 2}
    assert [r.id for r in B.read(spark, path).collect()] == ["a"] and B.latest(spark, path) == 1
    # the next good build takes the place of the refused one
    assert B.build(good.withColumn("id", F.lit("z")), path, ["id"], B.notice_checks())["version"] == 2
    assert [r.id for r in B.read(spark, path).collect()] == ["z"]


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    assert B.build(spark.createDataFrame([], ROW), path, ["id"], B.notice_checks()) == {"version": 1, "rows": 0}
    assert B.read(spark, path).count() == 0


def test_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit("d").alias("date")).mapInArrow(count, ROW)
    B.build(rows, str(tmp_path / "i"), ["id"], B.notice_checks(), {"texts": F.count("text")})
    assert made.value == 100
